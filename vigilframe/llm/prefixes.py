"""Similar sets by prefix filters: all pairs with a Jaccard similarity of at least a threshold, exactly.

Each set is sorted by one order over all members, and only its first members are entered. Of a pair at the threshold, the
smaller set (by size, then node) shares one of its first n - ceil(2t / (1 + t) * n) + 1 members with the first
n - ceil(t * n) + 1 of the larger one, whatever the order is. The order only decides how many other pairs meet: members that
few sets have come first, told by a table of counters of fixed size, so members of crowded sets are rarely entered at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import BATCH, small_batches

#: counters of the order, in slices that are summed apart; they decide the way, never the result
COUNTERS, SLICES = 1 << 22, 256
SLACK = 1e-9
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: entries that a task gathers before it deals them
FLUSH = 1 << 19
#: bits that mark rows whose sets are needed; they decide the way, never the result
MARKS = 1 << 25
PACKED = ["tokens", "marks", "sizes", "nodes", "places"]


def order_of(texts: DataFrame, column: str, make: Callable[[], Callable[[bytes], np.ndarray]]) -> bytes:
    """A byte for each counter: how often its members are met, on a logarithmic scale. make() returns the function from a
    value to its distinct members (64-bit)."""
    small_batches(texts.sparkSession)
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, counts = make(), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(counts, (members(raw.as_py() or b"") % np.uint64(COUNTERS)).astype(np.int64), 1)
        # only counters above 0 travel: their places in the slice, and their values
        at = np.flatnonzero(counts)
        edges = np.searchsorted(at, np.arange(0, COUNTERS + 1, width))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            some = at[edges[k] : edges[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(some % width).astype("<u2").tobytes()], pa.binary()), pa.array([counts[some].astype("<u4").tobytes()], pa.binary())], names=["slice", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if k not in sums:
                    sums[k] = np.zeros(width, np.uint64)
                sums[k][np.frombuffer(places.as_py(), "<u2")] += np.frombuffer(raw.as_py(), "<u4")
        for k, x in sums.items():
            levels = np.ceil(8 * np.log2(1.0 + x)).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["slice", "levels"])

    parts = texts.select(F.col(column).cast("binary")).mapInArrow(count, "slice int, places binary, counts binary")
    levels = {r["slice"]: bytes(r["levels"]) for r in parts.repartition(16, "slice").mapInArrow(add, "slice int, levels binary").collect()}
    return b"".join(levels.get(k, bytes(width)) for k in range(SLICES))


def node_of(members: bytes) -> int:
    """The node of a set, from its members as bytes: a signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest(members)
    return value - (1 << 64) if value >> 63 else value


def entered(n: int, share: float) -> int:
    """How many first members of n are entered if at least share * n are common; 0 for an empty set."""
    return n - math.ceil(share * n - SLACK) + 1 if n else 0


def first_members(members: np.ndarray, levels: np.ndarray, threshold: float) -> bytes:
    rank = levels[(members % np.uint64(COUNTERS)).astype(np.int64)]
    return members[np.lexsort((members, rank))[: entered(len(members), threshold)]].astype("<u8").tobytes()


def packed_entries(sets: DataFrame, threshold: float, levels: Broadcast, buckets: int, crowd: int) -> DataFrame:
    """bucket, n_rows, and the entries of each bucket in columns of bytes, from sets with node (long), n and first (of
    first_members()). A token's bucket follows from its hash; a token that more than `crowd` sets may have is dealt to several
    buckets, by the node. Repeated nodes of one task are entered once."""
    small_batches(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, parts, held = np.frombuffer(levels.value, np.uint8), set(), [], 0

        def flush() -> pa.RecordBatch:
            token, late, n, node, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            shares = np.ceil(2.0 ** (table[(token.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)] / 8.0) / crowd).astype(np.int64)
            salt = np.where(shares > 1, np.abs(node) % np.maximum(shares, 1) + 1, 0)
            mixed = (token.view(np.uint64) ^ (salt.astype(np.uint64) * SPREAD)) * SPREAD
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            columns = [token, (late | (salt > 0) << 1).astype(np.uint8), n.astype("<u4"), node, place.astype("<u4")]
            cut = [[x.tobytes() for x in np.split(c[order], starts[1:])] for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][starts]), *[pa.array(c, pa.binary()) for c in cut]], names=["bucket", *PACKED])

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                fresh = [i for i, x in enumerate(part.column(0).to_pylist()) if not (x in seen or seen.add(x))]
                node, n = part.column(0).to_numpy()[fresh], part.column(1).to_numpy()[fresh]
                raw = part.column(2).take(pa.array(fresh, pa.int64())).to_pylist()
                size = np.array([len(x) // 8 for x in raw], np.int64)
                if not size.sum():
                    continue
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                early = np.array([entered(int(x), 2 * threshold / (1 + threshold)) for x in n], np.int64)
                parts.append((np.frombuffer(b"".join(raw), "<i8"), place >= np.repeat(early, size), np.repeat(n, size), np.repeat(node, size), place))
                held += len(place)
                if held >= FLUSH:
                    yield flush()
                    parts, held = [], 0
                if len(seen) > FLUSH:
                    seen.clear()
        if parts:
            yield flush()

    return sets.select("node", F.col("n").cast("long"), "first").mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in PACKED))


def shared(sets: DataFrame, threshold: float, levels: Broadcast, per_bucket: int = 400_000, crowd: int = 100_000) -> DataFrame:
    """token, late, n, node, place: the entries of the tokens that several nodes have, of which one may be the smaller of a pair.

    Entries travel in columns of bytes, some `per_bucket` of them to a bucket however large the corpus is; those of tokens in
    crowds come back whole, from several buckets. late: whether past what the smaller set of a pair enters.
    """
    total = sets.agg(F.sum(F.length("first"))).first()[0] or 0
    buckets = max(64, total // 8 // per_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[bytes]] = []
        open_bucket = None

        def close() -> pa.RecordBatch:
            token, mark, n, node, place = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*rows, strict=True), ("<i8", np.uint8, "<u4", "<i8", "<u4"), strict=True))
            order = np.lexsort((node, token))
            once = np.flatnonzero(np.concatenate(([True], (np.diff(token[order]) != 0) | (np.diff(node[order]) != 0))))
            order = order[once]
            starts = np.flatnonzero(np.concatenate(([True], np.diff(token[order]) != 0)))
            size = np.diff(np.append(starts, len(order)))
            least = np.minimum.reduceat(mark[order] & 1, starts)
            crowded = np.maximum.reduceat(mark[order] >> 1, starts) > 0
            out = order[np.repeat(crowded | (size > 1) & (least == 0), size)]
            columns = [token[out], (mark[out] & 1).astype(np.int32), n[out].astype(np.int64), node[out], place[out].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "late", "n", "node", "place"])

        for batch in batches:
            for bucket, *cut in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if bucket != open_bucket:
                    if rows:
                        yield close()
                    rows, open_bucket = [], bucket
                rows.append(cut)
        if rows:
            yield close()

    dealt = packed_entries(sets, threshold, levels, buckets, crowd).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "token long, late int, n long, node long, place int")


def possible(n: tuple[Column, Column], place: tuple[Column, Column], threshold: float) -> Column:
    """Whether two sets that have their first common member at these places can be similar enough."""
    most = F.least(n[0] - place[0], n[1] - place[1])
    return most + SLACK >= threshold / (1 + threshold) * (n[0] + n[1])


def _apart(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with root, of tokens whose nodes aren't all together by roots (node, root); without roots each node is its own."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    rooted = rows.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return rooted.join(mixed, "token", "left_semi")


def to_hubs(rows: DataFrame, threshold: float, roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of each token's hub and its other nodes, from shared(); none that roots (node, root) has together already. The
    hub has the fewest members before the token: of copies with changes in some places, the one with the fewest changes, which is
    the likest to all others."""
    rooted = _apart(rows, roots)
    hubs = rooted.groupBy("token").agg(F.min(F.struct("place", "n", "node", "root")).alias("hub"))
    met = rooted.join(hubs, "token").where(F.col("hub.root") != F.col("root"))
    fits = possible((F.col("hub.n"), F.col("n")), (F.col("hub.place"), F.col("place")), threshold)
    return met.where(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def all_pairs(rows: DataFrame, threshold: float, roots: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) that may be similar enough, from shared(); none that roots (node, root) has together already."""
    rooted = _apart(rows, roots)
    side = lambda s: rooted.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("late", "n", "node", "place", "root")])
    smaller = F.struct("a_n", "a_node") < F.struct("b_n", "b_node")
    fits = possible((F.col("a_n"), F.col("b_n")), (F.col("a_place"), F.col("b_place")), threshold)
    left, right = side("a").where("a_late = 0"), side("b")
    met = left.join(right, (left["token"] == right["token"]) & smaller & (F.col("a_root") != F.col("b_root")) & fits)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def sets_of(texts: DataFrame, live: DataFrame, make: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """node and s (distinct members as bytes) of the nodes of live (node, row_key), from texts (row_key, text).

    A bitmap of fixed size with the live rows' keys goes to all tasks, so that texts stay where they are. The sets of what passes
    it tell their nodes (node_of()), and live decides which of these are kept; so sets are shuffled once.
    """
    bits = lambda c: F.xxhash64(c)
    width = MARKS // SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[k] = seen.get(k, np.zeros(width // 8, np.uint8)) | np.frombuffer(raw.as_py(), np.uint8)
        for k, x in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "bits"])

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(MARKS)
            for k in np.unique(at // np.uint64(width)).tolist():
                flags = np.zeros(width, np.uint8)
                flags[(at[at // np.uint64(width) == k] % np.uint64(width)).astype(np.int64)] = 1
                seen[k] = seen.get(k, np.zeros(width // 8, np.uint8)) | np.packbits(flags, bitorder="little")
        for k, x in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "bits"])

    small_batches(texts.sparkSession)
    found = live.select(bits("row_key").alias("h")).coalesce(16).mapInArrow(spots, "slice int, bits binary").repartition(16, "slice").mapInArrow(mark, "slice int, bits binary")
    slices = {r["slice"]: bytes(r["bits"]) for r in found.collect()}
    marks = texts.sparkSession.sparkContext.broadcast(b"".join(slices.get(k, bytes(width // 8)) for k in range(SLICES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, members = np.frombuffer(marks.value, np.uint8), make()
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(MARKS)
            rows = np.flatnonzero(flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            if len(rows):
                kept = batch.take(pa.array(rows))
                sets = [members(x.as_py() or b"") for x in kept.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array(sets, pa.binary())], names=["node", "s"])

    made = texts.select(bits("row_key").alias("h"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, s binary")
    return made.join(live.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))


def alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets (node, s: distinct members, ascending 64-bit numbers as bytes) have a Jaccard similarity of at
    least the threshold. Of pairs in the order of `a`, one set at a time is held and compared in numpy."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema)
