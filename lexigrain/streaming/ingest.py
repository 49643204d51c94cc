"""An index kept up to date from a stream of documents: an extension of the library's batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrain.operators.index import Analysis
from lexigrain.operators.store import IndexStore


def index_stream(rows: DataFrame, store: IndexStore, name: str, checkpoint: str, replace: bool = False, once: bool = False) -> StreamingQuery:
    """Each micro-batch is one load of the index ``name``; with ``replace`` its rows replace those of the same id.

    A batch that is run again after a failure is told by its number, which is
    written in one change with its load, and skipped.
    """

    def load(batch: DataFrame, number: int) -> None:
        if int(store.meta(name)["info"].get("last_batch", "-1")) >= number or batch.isEmpty():
            return
        (store.update if replace else store.insert)(name, batch, {"last_batch": str(number)})

    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_terms(rows: DataFrame, time: str, primary_key: str, window: str, late: str, analysis: Analysis = Analysis()) -> DataFrame:
    """``start, term, num_hits`` of a stream by tumbling windows; rows later than ``late`` behind the newest are left out."""
    text = [c for c in rows.columns if c not in (time, primary_key)]
    tokens = F.concat(*[analysis.tokens(F.col(c)) for c in text])
    words = rows.withWatermark(time, late).select(time, F.explode(tokens).alias("term"))
    return words.groupBy(F.window(time, window).alias("w"), "term").agg(F.count("*").alias("num_hits")).select(F.col("w.start").alias("start"), "term", "num_hits")
