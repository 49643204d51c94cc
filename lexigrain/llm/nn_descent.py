"""Embedding near-dedup by NN-descent.

A neighbour graph starts from a forest of random projection trees and is refined
by joins of neighbours' neighbours: the vectors that a node's list or the lists
that name it hold are compared with each other, and each keeps its nearest. The
graph has settled when a round hardly finds further edges above the threshold. A
node whose whole list lies above the threshold is saturated and may have more
such neighbours than its list can hold, so its list is enlarged to its whole
connected component: saturated nodes are compared with all nodes of it, block by
block, and only the counts leave a block. The recall is then audited against
brute force, for as many nodes as it takes to meet enough that have a neighbour
above the threshold, and another forest is planted where it is too low. Where
all nodes had to be audited, or the recall stays low, what brute force finds is
the result.

Equal vectors are one node. The result has one row for each vector that has a
near duplicate, with its class and its number of links, so a cluster of c
vectors has c rows and its pairs are never shuffled or written.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import checkpointed, released, shuffle_partitions
from lexigrain.llm.ngram_join import components, local_roots

#: Least cosine of near duplicates; neighbours in a list; trees of a forest, for a table that needs no sign bits; nodes in a leaf.
THRESHOLD, NEIGHBOURS, TREES, LEAF = 0.9, 16, 6, 128
#: A refinement ends when a round adds at most this share of the edges above the threshold.
SETTLED = 0.001
#: Nodes audited at first, nodes with a partner that an audit has to meet, the recall that is asked for, forests at most.
AUDITED, PARTNERED, RECALL, FORESTS = 512, 400, 0.97, 6
#: A table with so many different vectors at most is compared whole after one forest with too low a recall: that is no dearer than a further one.
SMALL = 200_000
#: Bytes of vectors that are held against all others in one pass of an audit; of them that are compared at once.
PASS_BYTES, ROWS = 4 << 20, 1024
#: Vectors that share a tree's first splits; members of a join that are compared at once; nodes of a block of a component.
TOP, CHUNK, BLOCK = 8192, 256, 4096
#: Bytes of vectors that a task of a join should hold.
JOIN_BYTES = 16 << 20

_EDGE = "node long, member long, sim float, young boolean"
#: ``node`` has so many links, counted in vectors, that other rows don't count, and is connected with ``other``.
_LINKS = "node long, other long, links long"


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def _normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.array(v, np.float64)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                x = (x / np.linalg.norm(x)).astype(np.float32) + np.float32(0)  # no -0.0, so that equal vectors have equal bytes
            if np.isfinite(x).all():
                ids.append(i)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "vec"])


def _edges(node: np.ndarray, member: np.ndarray, sim: np.ndarray, young: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "member": pa.array(member, pa.int64()), "sim": pa.array(sim, pa.float32()), "young": pa.array(young, pa.bool_())})


def best(node: np.ndarray, member: np.ndarray, sim: np.ndarray, young: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest members of each node; an edge that was there before stays old. Equal similarity: the smaller id."""
    order = np.lexsort((young, member, node))
    node, member, sim, young = node[order], member[order], sim[order], young[order]
    new = np.append(True, (node[1:] != node[:-1]) | (member[1:] != member[:-1]))[: len(node)]
    node, member, sim, young = node[new], member[new], sim[new], young[new]
    order = np.lexsort((member, -sim, node))
    node, member, sim, young = node[order], member[order], sim[order], young[order]
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    place = np.arange(len(node)) - np.repeat(at, np.diff(np.append(at, len(node))))
    keep = place < k
    return node[keep], member[keep], sim[keep], young[keep]


def _leaves(x: np.ndarray, rng: np.random.Generator, leaf: int) -> Iterator[np.ndarray]:
    """Parts of at most ``leaf`` rows: each part is halved along the line between two of its vectors."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        a, b = rng.choice(len(rows), 2, replace=False)
        line = x[rows[a]] - x[rows[b]]
        if not line.any():
            line = rng.standard_normal(x.shape[1]).astype(np.float32)
        order = rows[np.argsort(x[rows] @ line, kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def _grow(seed: list[int], k: int, leaf: int) -> Callable[[pa.Table], pa.Table]:
    def grow(table: pa.Table) -> pa.Table:
        """Neighbours within the leaves of one part of one tree."""
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _vectors(table.column("vec"))[order]
        rng = np.random.default_rng([*seed, table.column("tree")[0].as_py(), table.column("code")[0].as_py()])
        node, member, sim = [], [], []
        for rows in _leaves(x, rng, leaf):
            if len(rows) > 1:
                s = x[rows] @ x[rows].T
                np.fill_diagonal(s, -3)
                m = min(k, len(rows) - 1)
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                node.append(np.repeat(ids[rows], m))
                member.append(ids[rows[near]].ravel())
                sim.append(np.take_along_axis(s, near, 1).ravel())
        if not node:
            return _edges(np.empty(0), np.empty(0), np.empty(0), np.empty(0, bool))
        node, member, sim = map(np.concatenate, (node, member, sim))
        return _edges(node, member, sim, np.ones(len(node), bool))

    return grow


def _bits(n: int) -> int:
    """Sign bits that part the vectors of a tree before halving."""
    return max(0, math.ceil(math.log2(max(1, n / TOP))))


def grown(n: int, trees: int, t: float) -> int:
    """Trees of a forest over ``n`` vectors: each sign bit parts two with cosine ``t`` with a chance that so many more make up for."""
    together = 1 - math.acos(min(1.0, max(0.0, t))) / math.pi
    return math.ceil(trees * together ** -_bits(n))


def _planted(vecs: DataFrame, n: int, mean: np.ndarray, seed: list[int], k: int, trees: int, leaf: int) -> DataFrame:
    """Edges of a forest. Signs along random lines through the mean part each tree's vectors, halving goes on within the parts."""
    bits = _bits(n)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.random.default_rng(seed).standard_normal((trees, len(mean), bits)).astype(np.float32)
        for batch in batches:
            x = _vectors(batch.column(1)) - mean if batch.num_rows else np.empty((0, len(mean)), np.float32)
            for t in range(trees):
                codes = (x @ lines[t] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(codes, pa.int64()), *batch.columns], ["tree", "code", "id", "vec"])

    parts = vecs.select("id", "vec").mapInArrow(code, "tree int, code long, id long, vec binary")
    return parts.groupBy("tree", "code").applyInArrow(_grow(seed, k, leaf), _EDGE)


def _merged(edges: DataFrame, buckets: int, k: int) -> DataFrame:
    def top(table: pa.Table) -> pa.Table:
        return _edges(*best(*(table.column(c).to_numpy() for c in ("node", "member", "sim", "young")), k))

    return edges.groupBy(F.pmod(F.xxhash64("node"), F.lit(buckets))).applyInArrow(lambda _, t: top(t), _EDGE)


def _compared(k: int) -> Callable[[pa.Table], pa.Table]:
    def compare(table: pa.Table) -> pa.Table:
        """Neighbours' neighbours: members of one join that are near enough to enter each other's lists. Two old ones met before."""
        center, chunk = table.column("center").to_numpy(), table.column("chunk").to_numpy()
        ids, young, least = (table.column(c).to_numpy() for c in ("member", "young", "least"))
        order = np.lexsort((ids, chunk, center))
        center, chunk, ids, young, least = center[order], chunk[order], ids[order], young[order], least[order]
        x = _vectors(table.column("vec"))[order]
        at = np.flatnonzero(np.append(True, (center[1:] != center[:-1]) | (chunk[1:] != chunk[:-1])))
        node, member, sim = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        held, young_all = 0, lambda n: np.ones(n, bool)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)]):
            if b - a < 2 or not young[a:b].any():
                continue
            s = x[a:b] @ x[a:b].T
            enter = (s > least[a:b, None]) & (young[a:b, None] | young[None, a:b])
            np.fill_diagonal(enter, False)
            i, j = np.nonzero(enter)
            node.append(ids[a + i])
            member.append(ids[a + j])
            sim.append(s[i, j])
            held += len(i)
            if held > 2_000_000:
                flat = [np.concatenate(c) for c in (node, member, sim)]
                n_, m_, s_, _ = best(*flat, young_all(len(flat[0])), k)
                node, member, sim, held = [n_], [m_], [s_], 0
        flat = [np.concatenate(c) for c in (node, member, sim)]
        return _edges(*best(*flat, young_all(len(flat[0])), k))

    return compare


def _descended(vecs: DataFrame, graph: DataFrame, n: int, dim: int, k: int, t: float) -> DataFrame:
    """The graph after rounds of joins, settled. All vectors take part in each round in which a list that holds them is new."""
    buckets = max(shuffle_partitions(vecs.sparkSession), math.ceil(2 * k * n * (4 * dim + 32) / JOIN_BYTES))
    lists = max(shuffle_partitions(vecs.sparkSession), math.ceil(n / 50_000))
    for turn in itertools.count():
        both = graph.select(F.col("node").alias("center"), "member", "young").union(graph.select(F.col("member").alias("center"), F.col("node").alias("member"), "young"))
        both = both.groupBy("center", "member").agg(F.max("young").alias("young"))
        # a node that very many lists name has its members compared in chunks of them, other chunks each round
        size = both.groupBy("center").agg(F.count("*").alias("n"), F.max("young").alias("any")).filter("any")
        both = both.join(size, "center").withColumn("chunk", F.pmod(F.xxhash64("member", "center", F.lit(turn)), F.ceil(F.col("n") / CHUNK)).cast("int"))
        least = graph.groupBy(F.col("node").alias("id")).agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        known = vecs.join(least, "id", "left").select(F.col("id").alias("member"), "vec", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
        joined = both.join(known, "member").select("center", "chunk", "member", "young", "least", "vec")
        found = joined.groupBy(F.pmod(F.xxhash64("center"), F.lit(buckets))).applyInArrow(lambda _, x: _compared(k)(x), _EDGE)
        before, graph = graph, checkpointed(_merged(graph.withColumn("young", F.lit(False)).union(found), lists, k))
        released(before)
        counts = graph.filter(F.col("sim") >= t).agg(F.count("*").alias("all"), F.coalesce(F.sum(F.col("young").cast("long")), F.lit(0)).alias("young")).first()
        if counts["young"] <= SETTLED * counts["all"]:
            break
    return graph


def _counted(edges: DataFrame, vecs: DataFrame) -> DataFrame:
    """Links of plain edges ``a, b``, each counted at both ends."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.join(vecs.select(F.col("id").alias("other"), F.col("many").alias("links")), "other").select("node", "other", "links")


def _enlarged(graph: DataFrame, k: int, t: float) -> tuple[DataFrame, DataFrame | None]:
    """``a, b`` above the threshold, a < b; and, if there are any, ``node, root, full`` of the components with a saturated node, ``full`` where it is one."""
    near = graph.filter(F.col("sim") >= t)
    edges = checkpointed(near.select(F.least("node", "member").alias("a"), F.greatest("node", "member").alias("b")).distinct())
    full = near.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("node", F.lit(True).alias("full"))
    if full.isEmpty():
        return edges, None
    root = checkpointed(components(edges))
    wide = root.join(full, "node").select("root").distinct()
    return edges, checkpointed(root.join(wide, "root").join(full, "node", "left").select("node", "root", F.coalesce("full", F.lit(False)).alias("full")))


def _links(vecs: DataFrame, edges: DataFrame, wide: DataFrame | None, t: float) -> DataFrame:
    """``_LINKS`` of a settled graph: of edges without a saturated end, and of saturated nodes with all nodes of their components, in blocks."""
    if wide is None:
        return _counted(edges, vecs)
    full = wide.filter("full").select("node")
    rest = edges.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    sized = wide.join(wide.groupBy("root").agg(blocks.alias("blocks"), F.ceil(F.sum(F.col("full").cast("int")) / BLOCK).cast("int").alias("full_blocks")), "root")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = sized.filter("full").select("root", "node", "full", F.lit(True).alias("asks"), place("full_blocks").alias("p"), each("blocks").alias("q"))
    held = sized.select("root", "node", "full", F.lit(False).alias("asks"), place("blocks").alias("q"), each("full_blocks").alias("p")).select(asked.columns)
    rows = asked.union(held).join(vecs, F.col("node") == vecs["id"]).select("root", "p", "q", "node", "full", "asks", "many", "vec")

    def compare(table: pa.Table) -> pa.Table:
        ids, asks, full, many = (table.column(c).to_numpy() for c in ("node", "asks", "full", "many"))
        x, left, right = _vectors(table.column("vec")), np.flatnonzero(asks), np.flatnonzero(~asks)
        ask_links, links = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            near = (x[some] @ x[right].T >= np.float32(t)) & (ids[some, None] != ids[None, right])
            ask_links[at : at + ROWS] = near @ many[right]
            links += many[some] @ near
        right, links = right[~full[right]], links[~full[right]]  # those of saturated nodes are counted where they ask
        node, count = np.concatenate((ids[left], ids[right])), np.concatenate((ask_links, links))
        node, count = node[count > 0], count[count > 0]
        return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(np.full(len(node), table.column("root")[0].as_py()), pa.int64()), "links": pa.array(count, pa.int64())})

    return _counted(rest, vecs).union(rows.groupBy("root", "p", "q").applyInArrow(compare, _LINKS))


def _partners(vecs: DataFrame, n: int, dim: int, t: float, first: int) -> Iterator[tuple[float, DataFrame]]:
    """``query, other, sim`` of nodes against every vector, in passes that grow from ``first`` nodes, in order of the hash of the id; before each, the share of the nodes that is then done."""
    low, size = 0.0, first
    while low < 1:
        high = min(1.0, low + size / max(1, n))
        chosen = vecs.filter((_place() >= low) & (_place() < high)).toArrow()
        ids = chosen.column("id").to_numpy()
        q = _vectors(chosen.column("vec")) if len(ids) else np.empty((0, dim), np.float32)

        def search(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, x = batch.column(0).to_numpy(), _vectors(batch.column(1)) if batch.num_rows else np.empty((0, dim), np.float32)
                for a, b in itertools.product(range(0, len(own), ROWS), range(0, len(ids), ROWS)):
                    s = x[a : a + ROWS] @ q[b : b + ROWS].T
                    i, j = np.nonzero(s >= np.float32(t))
                    differ = own[a + i] != ids[b + j]
                    i, j = i[differ], j[differ]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[b + j]), pa.array(own[a + i]), pa.array(s[i, j])], ["query", "other", "sim"])

        yield high, vecs.mapInArrow(search, "query long, other long, sim float")
        low, size = high, min(4 * size, max(first, PASS_BYTES // (4 * dim)))


def audit(vecs: DataFrame, edges: DataFrame, wide: DataFrame | None, n: int, dim: int, t: float) -> tuple[float, DataFrame | None]:
    """Recall of a graph against comparison with every vector; and, where that took all nodes, all pairs as ``a, b``.

    A pair is found if it is an edge, or one of it is saturated and both are in
    one component. Nodes are audited until ``PARTNERED`` of them have a partner:
    those that have none prove nothing.
    """
    partners, seen, total, found, mean = None, 0, 0, 0, 0.0
    known = edges.select("a", "b", F.lit(1).alias("edge"))
    for done, met in _partners(vecs, n, dim, t, AUDITED):
        met = checkpointed(met)
        partners = met if partners is None else partners.union(met)
        truth = met.filter(F.col("sim") >= t + 1e-6).select("query", F.least("query", "other").alias("a"), F.greatest("query", "other").alias("b"))
        truth = truth.join(known, ["a", "b"], "left").withColumn("found", F.col("edge"))
        if wide is not None:
            for x in "ab":
                truth = truth.join(wide.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("full").alias(f"full_{x}")), x, "left")
            truth = truth.withColumn("found", F.coalesce("edge", F.when((F.col("root_a") == F.col("root_b")) & (F.col("full_a") | F.col("full_b")), 1)))
        row = truth.groupBy("query").agg((F.count("found") / F.count("*")).alias("recall"), F.count("*").alias("n"), F.count("found").alias("found"))
        row = row.agg(F.count("*").alias("seen"), F.sum("recall").alias("mean"), F.sum("found").alias("found"), F.sum("n").alias("n")).first()
        seen, mean, found, total = seen + row["seen"], mean + (row["mean"] or 0), found + (row["found"] or 0), total + (row["n"] or 0)
        if done >= 1:
            return min(mean / seen, found / total) if seen else 1.0, partners.filter("query < other").select(F.col("query").alias("a"), F.col("other").alias("b"))
        if seen >= PARTNERED:
            return min(mean / seen, found / total), None


def _whole(vecs: DataFrame, n: int, dim: int, t: float) -> DataFrame:
    """``_LINKS`` by comparison of all vectors, pass by pass; of a batch and a pass only counts and connections leave the task."""
    size, low, out = max(AUDITED, PASS_BYTES // (4 * dim)), 0.0, None
    while low < 1:
        high = min(1.0, low + size / max(1, n))
        chosen = vecs.filter((_place() >= low) & (_place() < high)).toArrow()
        ids, many = chosen.column("id").to_numpy(), chosen.column("many").to_numpy()
        q = _vectors(chosen.column("vec")) if len(ids) else np.empty((0, dim), np.float32)

        def search(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, x = batch.column("id").to_numpy(), _vectors(batch.column("vec")) if batch.num_rows else np.empty((0, dim), np.float32)
                links, hits = np.zeros(len(own), np.int64), [np.empty((2, 0), np.int64)]
                for a, b in itertools.product(range(0, len(own), ROWS), range(0, len(ids), ROWS)):
                    near = (x[a : a + ROWS] @ q[b : b + ROWS].T >= np.float32(t)) & (own[a : a + ROWS, None] != ids[None, b : b + ROWS])
                    links[a : a + ROWS] += near @ many[b : b + ROWS]
                    hits.append(np.stack(np.nonzero(near)) + [[a], [b]])
                i, j = np.concatenate(hits, axis=1)
                nodes, place = np.unique(np.concatenate((own[i], ids[j])), return_inverse=True)
                root = nodes[local_roots(place[: len(i)], place[len(i) :], len(nodes))]
                count = np.zeros(len(nodes), np.int64)
                mine = np.flatnonzero(links)
                count[np.searchsorted(nodes, own[mine])] = links[mine]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root), pa.array(count)], ["node", "other", "links"])

        met = checkpointed(vecs.mapInArrow(search, _LINKS))
        out = met if out is None else out.union(met)
        low = high
    return out


def _place() -> Column:
    """A node's place in the order of the hash of its id, from 0 to 1."""
    return F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _of_one_length(rows: DataFrame, dim: int, t: float, k: int, trees: int, leaf: int) -> DataFrame:
    every = checkpointed(rows.mapInArrow(_normed, "id long, vec binary"))
    vecs = checkpointed(every.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("many")).repartition(shuffle_partitions(rows.sparkSession), "id").select("id", "vec", "many"))
    links = checkpointed(_between(vecs, dim, t, k, trees, leaf))
    root = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    total = links.groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
    named = vecs.join(total, "id", "left").join(root.select(F.col("node").alias("id"), "root"), "id", "left")
    named = named.select("vec", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")).filter("n_links > 0")
    return every.join(named, "vec").select("id", "class_id", "n_links")


def _between(vecs: DataFrame, dim: int, t: float, k: int, trees: int, leaf: int) -> DataFrame:
    """``_LINKS`` of vectors that all differ."""
    n = vecs.count()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in batches:
            if batch.num_rows:
                total += _vectors(batch.column(1)).sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    sums = vecs.mapInArrow(summed, "total array<double>").select(F.posexplode("total").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    mean = np.array([r.x for r in sums] or [0.0] * dim, np.float32) / np.float32(max(1, n))
    lists = max(shuffle_partitions(vecs.sparkSession), math.ceil(n / 50_000))
    graph = None
    for forest in range(FORESTS):
        wanted = grown(n, trees, t)
        for at in range(0, wanted, trees):  # so many trees at a time, for the disk
            planted = _planted(vecs, n, mean, [forest, at], k, min(trees, wanted - at), leaf)
            before, graph = graph, checkpointed(_merged(planted if graph is None else graph.withColumn("young", F.col("young") & F.lit(at > 0)).union(planted), lists, k))
            if before is not None:
                released(before)
        graph = _descended(vecs, graph, n, dim, k, t)
        edges, wide = _enlarged(graph, k, t)
        recall, exact = audit(vecs, edges, wide, n, dim, t)
        if exact is not None:
            return _counted(exact, vecs)
        if recall >= RECALL:
            return _links(vecs, edges, wide, t)
        if n <= SMALL:
            break
    return _whole(vecs, n, dim, t)


def near_embeddings(embeddings: DataFrame, t: float = THRESHOLD, k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``vec_id, class_id, n_links`` of each of ``embeddings(vec_id, embedding)`` that has a cosine of ``t`` or more with another.

    ``n_links`` counts the other vectors that are so near, equal ones included. A
    class is a connected component of these links and goes by its smallest vec_id.

    The search is approximate. Its recall is audited until ``PARTNERED`` nodes
    with a near duplicate have been met, or all nodes have been compared, which
    makes the result exact. Where the recall is under ``RECALL`` another forest is
    planted and the graph refined on, up to ``FORESTS`` forests; where it stays
    lower, or the table has at most ``SMALL`` different vectors, all are compared.
    The members of a join that more than ``CHUNK`` lists name are compared in
    random parts of that size, others each round; ties in lists go by id.

    Rows with a null vec_id, a null or empty embedding, one with a null, a NaN or
    an infinity in it or of zeros alone give no row, nor do those without a link.
    Vectors of different length aren't compared. A vec_id counts once: of its
    different vectors the smallest in order. Other columns aren't read; an empty
    table gives an empty result.
    """
    slim = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    slim = slim.filter("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))").groupBy("id").agg(F.min("v").alias("v"))
    out = None
    for row in slim.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        part = _of_one_length(slim.filter(F.size("v") == row.dim), row.dim, t, k, trees, leaf) if row["count"] > 1 else None
        if part is not None:
            out = part if out is None else out.union(part)
    if out is None:
        out = slim.sparkSession.createDataFrame([], "id long, class_id long, n_links long")
    return out.select(F.col("id").alias("vec_id"), "class_id", "n_links")
