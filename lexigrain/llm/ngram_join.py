"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is cut into fragments, ranges of the gram hash. A
first pass sends each set's grams to their fragments and counts there how many
documents hold each gram. Grams of one document alone can't be shared, so only
the rest goes back to the documents, numbered by rarity within its fragment;
most documents end here, since a pair needs ``t`` of either's grams in common.
Candidates are pairs that share a gram among the rarest of both (prefix filter),
so a passage in thousands of documents makes no pairs by itself. Partial
overlaps of candidates are then counted fragment group by fragment group of the
order, each in a task of its own, and summed per pair.

The result is one row per document with its class and its number of links, not
the pairs: a cluster of c near copies has c rows, though its links are counted
exactly. Equal gram sets are one set from the first task that sees them, so a
text that a third of all rows repeats costs each task one set. Grams that very
many documents hold are joined in cells, pairs of blocks of their documents, so
no task has all pairs of one gram.

Grams and candidates travel packed, some megabytes to a blob: one shuffle record
for each would take several times the input. A gram goes by ``BITS`` bits of its
hash, so two grams of a pair A, B of sets are taken for one with a chance of
``|A| * |B| / 2 ** BITS``, under one in a hundred million for two texts of 20,000
words, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lexigrain.llm.common import WordHash, buckets_for, checkpointed, delivered, first_width, fresh, mixed, packed_sections, released, rows_of, sections_of, window_hashes, word_hashes

N, THRESHOLD, BITS = 3, 0.4, 56
#: Input bytes a fragment of the first pass should hold; grams a task gathers before it sends them; documents of a gram that one cell compares.
FRAGMENT_BYTES, FLUSH_GRAMS, BLOCK = 8 << 20, 3_000_000, 2048

#: A set's smallest doc_id, size, signature, and number of documents. The mark of grams outside a prefix.
_SIGN, _COMMON = ("<i8", "<i4", "<u8", "<u8", "<u4"), 255


def gram_set(text: str, n: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word ``n``-grams of a text in lower case; of all words together where they are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    return np.unique(mixed(window_hashes(word_hashes(words, memo), k) + np.uint64(k)) >> np.uint64(64 - BITS))


def needed(size: int, t: float) -> int:
    """The least overlap with any partner: the smallest whole number not under ``t * size``."""
    k = int(t * size)
    return k if k >= t * size - 1e-9 else k + 1


class _Writer:
    """Numbers as bytes, all lowest bytes first, the next ones after them: small numbers press well so."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def add(self, values: np.ndarray, dtype: str) -> _Writer:
        v = np.ascontiguousarray(values.astype(dtype))
        self.parts.append(np.array([len(v)], np.int64).tobytes())
        self.parts.append(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T).tobytes())
        return self

    def raw(self) -> bytes:
        return b"".join(self.parts)

    def done(self, press: zstandard.ZstdCompressor) -> bytes:
        return press.compress(self.raw())


class _Reader:
    def __init__(self, blob: bytes, press: zstandard.ZstdDecompressor | None = None) -> None:
        self.raw, self.at = press.decompress(blob) if press else blob, 0

    def next(self, dtype: str) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        n = int(np.frombuffer(self.raw, np.int64, 1, self.at)[0])
        planes = np.frombuffer(self.raw, np.uint8, n * size, self.at + 8).reshape(size, n)
        self.at += 8 + n * size
        return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _pressed(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    return _Writer().add(np.diff(ids, prepend=0), "<i8").done(press)


def _unpressed(blob: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.cumsum(_Reader(blob, press).next("<i8"))


def cuts_for(fragments: int) -> int:
    """Groups of fragments in which overlaps are counted: they grow with the number of fragments, slowly, since each costs every task a part."""
    return 1 + fragments.bit_length() // 2


def _sender(n: int, fragments: int, send_width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, press = WordHash(), zstandard.ZstdCompressor(level=1)
        members: dict[bytes, set[int]] = {}
        sets: list[np.ndarray] = []
        held = 0
        width = (1 << BITS) // fragments + 1
        edges = np.array([f * width for f in range(fragments)], np.uint64)

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            low = np.array([s[0] for s in sets], np.uint64)
            sign_a, sign_b = np.frombuffer(b"".join(members), np.uint64).reshape(-1, 2).T
            lists = [np.array(sorted(m), np.int64) for m in members.values()]
            ids, many = np.array([m[0] for m in lists], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
            order = np.argsort(grams)
            grams, owner = grams[order], owner[order]
            cuts = [*np.searchsorted(grams, edges).tolist(), len(grams)]
            payloads = []
            for f in range(fragments):
                a, b = cuts[f], cuts[f + 1]
                if a < b:
                    who, own = np.unique(owner[a:b], return_inverse=True)
                    lowest = who[own[grams[a:b] == low[owner[a:b]]]]  # a set's size, signature and documents go with its lowest gram
                    w = _Writer().add(np.diff(ids[who], prepend=0), "<i8").add(many[who], "<u4").add(np.diff(grams[a:b], prepend=np.uint64(0)), "<u8").add(own, "<u4")
                    for x, kind in zip((ids, sizes, sign_a, sign_b, many), _SIGN):
                        w.add(x[lowest], kind)
                    w.add(np.concatenate([lists[i] for i in lowest.tolist()]) if len(lowest) else lowest, "<i8")
                    payloads.append((f, w.raw()))
            members.clear()
            sets.clear()
            return packed_sections(payloads, send_width, press)

        for batch in batches:
            for piece in rows_of(batch):
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    grams = gram_set(text, n, memo)
                    if len(grams):
                        held += 1
                        if (same := members.get(sign := xxh3_128_digest(grams.tobytes()))) is not None:
                            same.add(doc)
                        else:
                            members[sign] = {doc}
                            sets.append(grams)
                            held += len(grams)
                        if held > FLUSH_GRAMS:
                            yield flush()
                            held = 0
        if sets:
            yield flush()

    return send


def _sharer(buckets: int, send_width: int) -> Callable[[pa.Table], pa.Table]:
    def share(table: pa.Table) -> pa.Table:
        """Of one fragment: each set's grams that other documents have too, by number in order of rarity, and the counts of documents."""
        press, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        grams, docs, many, signs, members = [], [], [], [], []
        for fragment, payload in (section for blob in table.column("data").to_pylist() for section in sections_of(blob, press)):
            r = _Reader(payload)
            ids, weight = np.cumsum(r.next("<i8")), r.next("<u4")
            grams.append(np.cumsum(r.next("<u8"), dtype=np.uint64))
            own = r.next("<u4")
            docs.append(ids[own])
            many.append(weight[own])
            signs.append([r.next(kind) for kind in _SIGN])
            members.append(r.next("<i8"))
        gram, doc, weight = np.concatenate(grams), np.concatenate(docs), np.concatenate(many).astype(np.int64)
        sign, member = [np.concatenate(x) for x in zip(*signs)], np.concatenate(members)
        del grams, docs, many, signs, members
        order = np.lexsort((-weight, doc, gram))
        gram, doc, weight = gram[order], doc[order], weight[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))  # a repeated row counts once
        gram, doc, weight = gram[new], doc[new], weight[new]
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        df, sets = np.add.reduceat(weight, at), np.diff(np.append(at, len(gram)))
        rank = np.empty(len(at), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(at))
        counts, first_of = np.unique(np.sort(df), return_index=True)  # numbers go up with the count: where each count begins tells it
        take = np.repeat(df > 1, sets)
        number = np.repeat(rank, sets)[take]
        doc = doc[take]
        place = lambda d: (mixed(d.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        bucket = place(doc)
        order = np.lexsort((number, doc, bucket))
        number, doc, bucket = number[order], doc[order], bucket[order]
        home, sizes = place(sign[0]), sign[-1].astype(np.int64)
        order = np.argsort(home, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        home, sign, sizes = home[order], [x[order] for x in sign], sizes[order]
        member = member[np.repeat(begin, sizes) + _ramp(sizes)]
        begin = np.append(0, np.cumsum(sizes))
        payloads = []
        for n in np.union1d(bucket, home).tolist():
            a, b = np.searchsorted(bucket, [n, n + 1]).tolist()
            own = doc[a:b]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: b - a])
            steps = np.diff(number[a:b], prepend=0)
            steps[first] = number[a:b][first]
            w = _Writer().add(np.array([fragment]), "<i4").add(np.diff(own[first], prepend=0), "<i8").add(np.diff(np.append(first, b - a)), "<i4").add(steps, "<u4").add(counts, "<u4").add(first_of, "<u4")
            c, d = np.searchsorted(home, [n, n + 1]).tolist()
            for x, kind in zip(sign, _SIGN):
                w.add(x[c:d], kind)
            payloads.append((n, w.add(member[begin[c] : begin[d]], "<i8").raw()))
        return pa.Table.from_batches([packed_sections(payloads, send_width, squeeze)])

    return share


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks_of(rarity: np.ndarray, block: int) -> np.ndarray:
    """Blocks of about ``block`` of the documents of a gram, by its class of rarity."""
    return np.ceil(2.0 ** ((rarity.astype(np.int64) + 1) / 8) / block).astype(np.int64)


_ROW = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("sign", pa.binary()), ("docs", pa.list_(pa.int64())), ("home", pa.int32()), ("spread", pa.int32()), ("parts", pa.list_(pa.binary())), ("prefix", pa.binary())])


def _assembler(t: float, fragments: int, homes: int, block: int) -> Callable[[pa.Table], pa.Table]:
    cuts = cuts_for(fragments)

    def assemble(table: pa.Table) -> pa.Table:
        """Of the sets of one bucket: those that share enough, with their shared grams in cuts, and the rarity of the rarest ones."""
        press, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        gids, docs, rarities = [], [], []
        sign: dict[int, tuple[int, bytes, set[int]]] = {}
        for _, payload in (section for blob in table.column("data").to_pylist() for section in sections_of(blob, press)):
            r = _Reader(payload)
            fragment = int(r.next("<i4")[0])
            ids, count = np.cumsum(r.next("<i8")), r.next("<i4")
            steps = r.next("<u4").astype(np.int64)
            total, first = np.cumsum(steps), np.cumsum(count) - count
            number = total - np.repeat(total[first] - steps[first], count)
            counts, first_of = r.next("<u4"), r.next("<u4")
            gids.append(number | fragment << 32)
            # the order of rarity: classes of an eighth of a power of two, then numbers
            classes = np.minimum(_COMMON - 1, (8 * np.log2(np.maximum(counts, 1))).astype(np.int64))
            rarities.append(classes[np.searchsorted(first_of, number, side="right") - 1])
            docs.append(np.repeat(ids, count))
            d, size, sign_a, sign_b, many = (r.next(kind) for kind in _SIGN)
            member, at = r.next("<i8").tolist(), 0
            for one, n, x, y, k in zip(d.tolist(), size.tolist(), sign_a.tolist(), sign_b.tolist(), many.tolist()):
                sign.setdefault(one, (n, b"%d,%d,%d" % (n, x, y), set()))[2].update(member[at : at + k])
                at += k
        gid, doc, rarity = map(np.concatenate, (gids, docs, rarities))
        order = np.lexsort((gid, rarity, doc))
        gid, doc, rarity = gid[order], doc[order], rarity[order]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
        out: dict[str, list] = {k: [] for k in _ROW.names}
        edges = [(c * fragments // cuts) << 32 for c in range(1, cuts)]
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(doc)]):
            n, signature, members = sign[int(doc[a])]
            least = needed(n, t)
            if b - a < least:
                continue
            ids, lead = np.sort(gid[a:b]), int(gid[a:b].argmin())
            # grams that nobody shares are the rarest: they fill the first n - (b - a) places of the prefix
            rare, end = np.full(b - a, _COMMON, np.uint8), a + (b - a) - least + 1
            rare[np.searchsorted(ids, gid[a:end])] = rarity[a:end]
            row = (
                int(doc[a]), n, signature if b - a == n else b"d%d" % doc[a], sorted(members), int(mixed(ids[:1].astype(np.uint64))[0] % np.uint64(homes)), int(blocks_of(rarity[a + lead : a + lead + 1], block)[0]),
                [_pressed(x, squeeze) for x in np.split(ids, np.searchsorted(ids, edges))], squeeze.compress(rare.tobytes()),
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        return pa.table(out, schema=_ROW)

    return assemble


def _prefixer(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each rare gram of a set and each cell of the gram, with the two grams before it in order of rarity (-1: none).

        The documents of a gram are in blocks, and a cell is a pair of blocks;
        ``block`` is -1 in the cell of a block with itself.
        """
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                lists, classes = [], []
                for parts, rare in zip(piece.column("parts").to_pylist(), piece.column("prefix").to_pylist()):
                    ids, rarity = np.concatenate([_unpressed(x, press) for x in parts]), np.frombuffer(press.decompress(rare), np.uint8)
                    ids, rarity = ids[rarity < _COMMON], rarity[rarity < _COMMON]
                    order = np.lexsort((ids, rarity))
                    lists.append(ids[order])
                    classes.append(rarity[order])
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                gram, blocks = np.concatenate(lists), blocks_of(np.concatenate(classes), block_docs)
                place, owner = _ramp(sizes), np.repeat(np.arange(len(lists)), sizes)
                one, two = (np.where(place < k, -1, np.roll(gram, k)) for k in (1, 2))
                block = (mixed(piece.column("set_id").to_numpy().astype(np.uint64))[owner] % blocks.astype(np.uint64)).astype(np.int64)
                row, other = np.repeat(np.arange(len(gram)), blocks), _ramp(blocks)
                low, high = np.minimum(block[row], other), np.maximum(block[row], other)
                cell = low * blocks[row] + high
                key = np.where(cell > 0, mixed(gram[row].astype(np.uint64) + mixed(cell.astype(np.uint64))).astype(np.int64), gram[row])
                owner = pa.array(owner[row])
                mine = np.where(low == high, -1, block[row])
                yield pa.RecordBatch.from_arrays([pa.array(key), *[piece.column(c).take(owner) for c in ("set_id", "size", "home", "spread")], pa.array(mine.astype(np.int32)), pa.array(one[row]), pa.array(two[row])], ["gram", "set_id", "size", "home", "spread", "block", "one", "two"])

    return prefix_rows


def _gathered(table: pa.Table) -> pa.Table:
    """The candidates of one home, each once, in order, as one blob."""
    a, b = table.column("set_a").to_numpy(), table.column("set_b").to_numpy()
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b = a[new], b[new]
    blob = _Writer().add(np.diff(a, prepend=0), "<i8").add(b - a, "<i8").done(zstandard.ZstdCompressor(level=3))
    return pa.table({"home": table.column("home").slice(0, 1), "cell": table.column("cell").slice(0, 1), "pairs": pa.array([blob], pa.binary())})


def _pairs_of(blob: bytes, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    r = _Reader(blob, press)
    a = np.cumsum(r.next("<i8"))
    return a, a + r.next("<i8")


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that the candidates of a home name."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for home, cell, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
            ids = np.unique(np.concatenate(_pairs_of(blob, press)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), home), pa.int32()), pa.array(np.full(len(ids), cell), pa.int64()), pa.array(ids, pa.int64())], ["place", "place_cell", "set_id"])


def _partial(pairs: pa.Table, parts: pa.Table) -> pa.Table:
    """Overlaps of a home's pairs in one cut of the order, as one blob; with the first cut go the pairs, their sizes and their documents."""
    press, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    schema = pa.schema([("home", pa.int32()), ("cell", pa.int64()), ("overlaps", pa.binary()), ("pairs", pa.binary())])
    if not pairs.num_rows:
        return schema.empty_table()
    a, b = _pairs_of(pairs.column("pairs")[0].as_py(), press)
    ids = parts.column("set_id").to_numpy()
    lists = [_unpressed(x, press) for x in parts.column("part").to_pylist()]
    overlap = np.zeros(len(a), np.int64)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    kinds, local = np.unique(np.concatenate(lists), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    sort = np.argsort(ids)
    row_a, row_b = (sort[np.searchsorted(ids[sort], x)] for x in (a, b))
    edge = np.flatnonzero(np.append(True, row_a[1:] != row_a[:-1]))
    mark = np.zeros(len(kinds) + 1, bool)
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(a)]):
        own = int(row_a[i])
        mine = local[begin[own] : begin[own] + sizes[own]]
        mark[mine] = True
        for k in range(i, j, 2000):
            some = row_b[k : min(j, k + 2000)]
            n = sizes[some]
            total = np.append(0, np.cumsum(mark[local[np.repeat(begin[some], n) + _ramp(n)]]))
            overlap[k : min(j, k + 2000)] = total[np.cumsum(n)] - total[np.cumsum(n) - n]
        mark[mine] = False
    w = _Writer().add(overlap, "<u4")
    first = pairs.column("cut")[0].as_py() == 0
    if first:
        for column, kind in (("size", "<u4"), ("many", "<i8")):
            x = parts.column(column).to_numpy()
            w.add(x[row_a], kind).add(x[row_b], kind)
    return pa.table({"home": pairs.column("home"), "cell": pairs.column("cell"), "overlaps": pa.array([w.done(squeeze)], pa.binary()), "pairs": pairs.column("pairs") if first else pa.array([None], pa.binary())}, schema=schema)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's connected component, for edges between nodes 0 to ``n - 1``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(after, at, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _summed(t: float) -> Callable[[pa.Table], pa.Table]:
    def total(table: pa.Table) -> pa.Table:
        """By the sums of a home's partial overlaps: each set's links there, in documents, and the smallest set that links lead to."""
        press, overlap = zstandard.ZstdDecompressor(), 0
        for blob, pairs in zip(table.column("overlaps").to_pylist(), table.column("pairs").to_pylist()):
            r = _Reader(blob, press)
            overlap = overlap + r.next("<u4").astype(np.int64)
            if pairs is not None:
                a, b = _pairs_of(pairs, press)
                union = r.next("<u4").astype(np.int64) + r.next("<u4").astype(np.int64)
                many_a, many_b = r.next("<i8"), r.next("<i8")
        near = overlap / (union - overlap) >= t - 1e-12
        sets, place = np.unique(np.concatenate((a[near], b[near])), return_inverse=True)
        x, y = place[: near.sum()], place[near.sum() :]
        links = np.zeros(len(sets), np.int64)
        np.add.at(links, x, many_b[near])
        np.add.at(links, y, many_a[near])
        return pa.table({"set_id": pa.array(sets), "links": pa.array(links), "root": pa.array(sets[local_roots(x, y, len(sets))])})

    return total


def shared_sets(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame, int]:
    """Gram sets that share enough to be in a pair, or that several documents have, and the documents of each.

    ``set_id, sign, size, many, home, spread, parts, prefix`` and ``sign,
    doc_id``, both cut from the lineage, and the number of fragments. A set goes
    by its smallest doc_id.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    buckets = buckets_for(docs, FRAGMENT_BYTES)
    width = first_width(buckets)
    sent = slim.mapInArrow(_sender(n, buckets, width), "bucket int, data binary")
    back = delivered(sent, width).groupBy("bucket").applyInArrow(_sharer(buckets, width), "bucket int, data binary")
    rows = checkpointed(delivered(back, width).groupBy("bucket").applyInArrow(_assembler(t, buckets, buckets, BLOCK), "doc_id long, size int, sign binary, docs array<long>, home int, spread int, parts array<binary>, prefix binary"))
    # of a set that many tasks saw, each sends its part of the documents: no row holds them all
    members = rows.select("sign", F.explode("docs").alias("doc_id")).distinct()
    first = lambda c: F.min_by(c, "doc_id").alias(c)
    sets = rows.groupBy("sign").agg(F.min("doc_id").alias("set_id"), *[first(c) for c in ("size", "home", "spread", "parts", "prefix")])
    return checkpointed(sets.join(members.groupBy("sign").agg(F.count("*").alias("many")), "sign")), members, buckets


def linked_sets(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sign, set_id, many`` of gram sets, ``sign, doc_id`` of their documents, and ``set_id, links, root`` of linked sets.

    A set may have several rows of links, whose numbers add up; ``root`` is a
    set that links lead to, and over all rows these make the connected components.
    """
    sets, members, fragments = shared_sets(docs, n, t)
    rare = sets.select("set_id", "size", "home", "spread", "parts", "prefix").mapInArrow(_prefixer(BLOCK), "gram long, set_id long, size int, home int, spread int, block int, one long, two long")
    names = ("set_id", "size", "home", "spread", "block", "one", "two")
    left, right = (rare.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab")
    # a pair shows at its first common gram; where a gram just before is common as well, it has shown there
    (a1, a2), (b1, b2) = ((F.col(f"one_{x}"), F.col(f"two_{x}")) for x in "ab")
    shown: Column = ((a1 >= 0) & ((a1 == b1) | (a1 == b2))) | ((a2 >= 0) & ((a2 == b1) | (a2 == b2)))
    once = (F.col("block_a") < F.col("block_b")) | ((F.col("block_a") == -1) & (F.col("block_b") == -1) & (F.col("set_id_a") < F.col("set_id_b")))
    likely = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(t) - 1e-9
    smaller = lambda c: F.when(F.col("set_id_a") < F.col("set_id_b"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    found = left.join(right, "gram").filter(once & likely & ~shown).select(F.least("set_id_a", "set_id_b").alias("set_a"), F.greatest("set_id_a", "set_id_b").alias("set_b"), smaller("home").alias("home"), smaller("spread").cast("long").alias("spread"))
    # a home is for sets of one lowest gram; where that is frequent it has a cell for each pair of blocks
    cell = F.pmod(F.xxhash64("set_a"), F.col("spread")) * F.col("spread") + F.pmod(F.xxhash64("set_b"), F.col("spread"))
    candidates = found.select("home", cell.alias("cell"), "set_a", "set_b")
    packed = checkpointed(candidates.groupBy("home", "cell").applyInArrow(_gathered, "home int, cell long, pairs binary"))

    wanted = packed.mapInArrow(_wanted, "place int, place_cell long, set_id long")
    parts = wanted.join(sets.select("set_id", "size", "many", F.posexplode("parts").alias("slice", "part")), "set_id")
    asked = packed.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in range(cuts_for(fragments))])))
    partial = asked.groupBy("home", "cell", "cut").cogroup(parts.groupBy("place", "place_cell", "slice")).applyInArrow(_partial, "home int, cell long, overlaps binary, pairs binary")
    links = partial.groupBy("home", "cell").applyInArrow(_summed(t), "set_id long, links long, root long")
    return sets.select("sign", "set_id", "many"), members, checkpointed(links)


def _classes(docs: DataFrame, n: int, t: float) -> DataFrame:
    sets, members, links = linked_sets(docs, n, t)
    root = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set_id")
    total = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = sets.join(total, "set_id", "left").join(root, "set_id", "left")
    named = named.select("sign", F.coalesce("root", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")).filter("n_links > 0")
    return members.join(named, "sign").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def near_documents(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links`` of each document with a gram set that has a Jaccard similarity of ``t`` or more with another's.

    Grams are runs of ``n`` words of ``docs(doc_id, text)`` in lower case,
    split at white space; a text with fewer words has one gram, all of them.
    ``n_links`` counts the other documents that are so similar, copies
    included. A class is a connected component of these links and goes by its
    smallest doc_id.

    Null doc_ids, null texts, texts without a word and documents without a link
    give no row; repeated rows of a document with one text count once; other
    columns aren't read; an empty table gives an empty result. A doc_id is taken
    to name one text; a text may have any length.
    """
    return _classes(docs, n, t)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges(a, b)``; root is the smallest node of the connected component.

    Alternating large-star and small-star steps: every step moves all nodes at
    once, so the number of steps grows with the logarithm of the longest chain.
    """
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*").filter("u <> v").distinct()
        after = checkpointed(small)
        settled = after.count() == links.count() and after.join(links, ["u", "v"], "left_anti").isEmpty()
        released(links)
        links = after
        if settled:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()


def keep_one_of_each_group(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``docs`` less all but the document with the smallest doc_id of each class of ``near_documents``.

    All columns stay, and all rows of that document; rows that have no class
    stay as they are.
    """
    key = fresh(docs.columns, "gone_doc")
    gone = _classes(docs, n, t).filter("doc_id <> class_id").select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
