"""Main-text extraction by nearest-URL page differencing.

Pages made from one template lie next to each other by URL. Each page is paired
with its nearest page by URL path within the host, their text lines are aligned
by a longest common subsequence, and the shared lines, the template, go.

Pages are spread over ranges of host, path and id, so a host or a path of any
size is spread too. Within a range mates are neighbours; only the first and the
last path of a range may have a mate in another one, and they are joined with
the ends of the ranges beside them. The driver sees no page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import buckets_for, rows_of

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hgroup|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*(?:>|\Z)", re.I
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)")
#: Cells of the alignment that are kept as bits at once; a larger one is halved.
CELLS = 1 << 28
#: Input bytes of a range of pages that one task handles.
BLOCK_BYTES = 16 << 20


def text_lines(page: str) -> list[str]:
    """Text lines of a page: block elements part lines, white space within a line is one space, lines without text go."""
    plain = html.unescape(_TAG.sub("", _BREAK.sub("\n", _GONE.sub(" ", page).replace("\r", "\n").replace("\n", " "))))
    return [line for line in (" ".join(x.split()) for x in plain.split("\n")) if line]


def url_key(url: str) -> tuple[str, str]:
    """Host in lower case, and path without query, fragment and closing slash."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return "", url.strip()
    return host.lower(), parts.path.rstrip("/")


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit vectors of the LCS lengths' steps over ``b``, after each symbol of ``a``."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """LCS length of ``a`` and every beginning of ``b``."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return [0, *np.cumsum(bits).tolist()]


def common_positions(a: list[int], b: list[int], cells: int = CELLS) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    head, tail = list(range(start)), list(range(len(a) - end, len(a)))
    in_b, in_a = set(b[start : len(b) - end]), set(a[start : len(a) - end])
    at = [i for i in range(start, len(a) - end) if a[i] in in_b]
    x, y = [a[i] for i in at], [s for s in b[start : len(b) - end] if s in in_a]
    return head + [at[i] for i in _middle(x, y, cells)] + tail


def _middle(a: list[int], b: list[int], cells: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > cells:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _middle(a[:half], b[:cut], cells) + [half + i for i in _middle(a[half:], b[cut:], cells)]
    rows, j, out = _rows(a, b), len(b), []
    for i in range(len(a), 0, -1):
        # a zero bit is a step of the length; find the last step at or before j
        steps = ~rows[i] & ((1 << j) - 1)
        if not steps:
            break
        k = steps.bit_length() - 1
        before = ~rows[i - 1] & ((1 << j) - 1)
        if steps.bit_count() > before.bit_count():
            out.append(i - 1)
            j = k
    return out[::-1]


def unshared_lines(own: list[str], other: list[str]) -> list[str]:
    """``own`` less the lines of a longest common subsequence with ``other``; all of it, where that is the whole page."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (own, other))
    shared = set(common_positions(a, b))
    return own if len(shared) == len(own) else [x for i, x in enumerate(own) if i not in shared]


def nearness(a: str, b: str) -> int:
    """Path segments that both begin with."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def nearer(path: str, before: str | None, after: str | None) -> bool | None:
    """Whether the mate is the page before; None, where there is none on either side.

    It is the one with more leading path segments in common, and the one before
    if both have as many.
    """
    if before is None and after is None:
        return None
    return after is None or (before is not None and nearness(path, after) <= nearness(path, before))


def paths_of(keys: list[tuple[str, str]]) -> Iterator[tuple[int, int, int | None, int | None]]:
    """Of a list sorted by host and path: begin and end of each path, and the places of the last page of the path before and of the first of the path after, on the same host."""
    starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    for i, j in zip(starts, [*starts[1:], len(keys)]):
        host = keys[i][0]
        yield i, j, i - 1 if i and keys[i - 1][0] == host else None, j if j < len(keys) and keys[j][0] == host else None


_PAGE = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary())])
_OUT = pa.schema([("page_id", pa.int64()), ("mate_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64())])
_RESULT = "page_id long, mate_id long, text string, n_lines long, n_shared long"
_SIDES = [(f"{side}_{name}", kind) for side in ("before", "after") for name, kind in (("path", pa.string()), ("id", pa.int64()), ("lines", pa.binary()))]
#: A page that waits for what lies beside its range, with the neighbours known so far.
_WAITING = pa.schema([*_PAGE, *_SIDES])
_WAITING_DDL = "page_id long, host string, path string, lines binary, before_path string, before_id long, before_lines binary, after_path string, after_id long, after_lines binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for piece in rows_of(batch):
            keys = [url_key(u or "") for u in piece.column(1).to_pylist()]
            lines = [press.compress("\n".join(text_lines(x or "")).encode()) for x in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(lines, pa.binary())], schema=_PAGE)


def _range(batches: Iterator[pa.RecordBatch]) -> dict[str, list]:
    """All pages of a range, sorted."""
    table = pa.Table.from_batches(batches, _PAGE)
    return table.sort_by([("host", "ascending"), ("path", "ascending"), ("page_id", "ascending"), ("lines", "ascending")]).to_pydict()


class _Differ:
    """Collects pages less the lines of their mates."""

    def __init__(self) -> None:
        self.press, self.rows = zstandard.ZstdDecompressor(), {name: [] for name in _OUT.names}

    def lines(self, packed: bytes) -> list[str]:
        return [x for x in self.press.decompress(packed).decode().split("\n") if x]

    def add(self, page: int, packed: bytes, mate: int | None, mate_lines: bytes | None) -> None:
        own = self.lines(packed)
        kept = own if mate_lines is None else unshared_lines(own, self.lines(mate_lines))
        for column, value in zip(self.rows.values(), (page, mate, "\n".join(kept), len(own), len(own) - len(kept))):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(self.rows, schema=_OUT)
        self.rows = {name: [] for name in _OUT.names}
        return out


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range, pages whose path is neither its first nor its last."""
    t, differ = _range(batches), _Differ()
    for i, j, before, after in paths_of(list(zip(t["host"], t["path"]))):
        if i and j < len(t["path"]):
            first = nearer(t["path"][i], *(None if x is None else t["path"][x] for x in (before, after)))
            mate = None if first is None else before if first else after
            for p in range(i, j):
                differ.add(t["page_id"][p], t["lines"][p], *(None, None) if mate is None else (t["page_id"][mate], t["lines"][mate]))
        if len(differ.rows["text"]) > 1000:
            yield differ.batch()
    yield differ.batch()


def _waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range, pages of its first and of its last path."""
    t = _range(batches)
    out: dict[str, list] = {name: [] for name in _WAITING.names}
    for i, j, before, after in paths_of(list(zip(t["host"], t["path"]))):
        if not i or j == len(t["path"]):
            sides = [None if x is None else t[c][x] for x in (before, after) for c in ("path", "page_id", "lines")]
            for p in range(i, j):
                for column, value in zip(out.values(), (*(t[c][p] for c in _PAGE.names), *sides)):
                    column.append(value)
    yield pa.RecordBatch.from_pydict(out, schema=_WAITING)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last page of a range."""
    t = _range(batches)
    at = [0, len(t["path"]) - 1] if t["path"] else []
    arrays = [pa.array([t[c][i] for i in at], _PAGE.field(c).type) for c in _PAGE.names]
    yield pa.RecordBatch.from_arrays([*arrays, pa.array([False, True][: len(at)], pa.bool_())], [*_PAGE.names, "last"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    differ = _Differ()
    for batch in batches:
        for piece in rows_of(batch):
            for r in piece.to_pylist():
                first = nearer(r["path"], r["before_path"], r["after_path"])
                side = "before" if first else "after"
                differ.add(r["page_id"], r["lines"], *(None, None) if first is None else (r[f"{side}_id"], r[f"{side}_lines"]))
            yield differ.batch()


def _beside(waiting: DataFrame, ends: DataFrame) -> DataFrame:
    """``waiting`` with the neighbours that lie in other ranges.

    A path that several ranges share has its neighbours where it begins and
    where it ends, or they are the ends of ranges on the same host: the last
    before and the first after it. A host has two ends for each range it
    touches, however many pages it has.
    """
    known = lambda side: F.max(F.when(F.col(f"{side}_path").isNotNull(), F.struct(F.col(f"{side}_path").alias("path"), F.col(f"{side}_id").alias("id"), F.col(f"{side}_lines").alias("lines"))))
    asked = waiting.groupBy("host", "path").agg(known("before").alias("before"), known("after").alias("after"))
    end = lambda last: F.when(F.col("last") == F.lit(last), F.struct("path", F.col("page_id").alias("id"), "lines"))
    rows = ends.select("host", "path", "page_id", F.lit(False).alias("asks"), end(True).alias("low"), end(False).alias("high"))
    rows = rows.unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    low = Window.partitionBy("host").orderBy("path", F.desc("asks"), "page_id").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy("host").orderBy(F.desc("path"), F.desc("asks"), F.desc("page_id")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select("host", "path", "asks", F.coalesce("before", F.last("low", True).over(low)).alias("before"), F.coalesce("after", F.last("high", True).over(high)).alias("after")).filter("asks")
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in ("path", "id", "lines")]
    return waiting.select("page_id", "host", "path", "lines").join(found, ["host", "path"]).select("page_id", "path", "lines", *sides)


def extract_text(pages: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``page_id, mate_id, text, n_lines, n_shared`` for each row of ``pages(page_id, url, html)``.

    ``text`` holds the page's lines that its mate lacks, in order, one line
    each; ``n_lines`` counts the page's text lines, ``n_shared`` those deleted.
    The mate is the nearest page by URL path within the host, the last page of the
    path before or the first of the path after (see ``nearer``);
    URLs that differ in scheme, query, fragment or closing slash only have one
    path, and pages of one path aren't mates. A page whose lines are all in its
    mate is a copy of it, which tells nothing of a template: it keeps all lines,
    with ``n_shared`` 0.

    Null HTML counts as a page without lines, whose text is empty; a null URL as
    host and path of no characters; rows with a null page_id give no row; a page
    without a mate keeps all its lines and has a null ``mate_id``; repeated rows
    are pages of one path; other columns aren't read; an empty table gives an
    empty result.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).filter("page_id is not null")
    ranges = slim.mapInArrow(_parsed, "page_id long, host string, path string, lines binary").repartitionByRange(buckets_for(pages, block_bytes), "host", "path", "page_id")
    waiting, ends = ranges.mapInArrow(_waiting, _WAITING_DDL), ranges.mapInArrow(_ends, "page_id long, host string, path string, lines binary, last boolean")
    return ranges.mapInArrow(_inner, _RESULT).union(_beside(waiting, ends).mapInArrow(_resolved, _RESULT))
