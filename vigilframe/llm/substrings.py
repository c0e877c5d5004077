"""Removal of byte strings that repeat anywhere in the corpus, by suffix order.

A string of `length` bytes is repeated if it starts at two places, in one text or two. Sorting all suffixes of the
corpus by a difference cover would move every byte several times, so suffixes meet only where they can agree:

1. Each window of `length` bytes has an anchor, its part of `length // 2` bytes with the smallest hash. Equal windows
   have equal anchors at the same place in them. Consecutive windows with one anchor are a cell. Cells whose anchor
   occurs once are done: none of their windows repeats.
2. Cells that are equal as a whole are a class. All windows of a class of several cells repeat. An anchor with one class
   is done.
3. For an anchor with several classes, one cell of each class is sent to one place by anchor. There the texts of the
   cells get their suffix order by a difference cover (sampled triples, recursion on names, merge; see suffixes.py),
   and neighbouring prefixes are compared byte by byte. An anchor with very many classes is spread: windows are then
   counted by their hash, in all tasks.

Each text gets back the windows that repeat. Texts without open cells are finished when they first meet their cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import checkpoint
from vigilframe.llm.suffixes import repeated_starts

LENGTH = 200
#: windows that are hashed at once; a cell that is cut here is compared all the same
BLOCK = 1 << 17
#: classes of an anchor from which its windows are counted by hash instead of sorted in one task
SPREAD = 20_000
#: bytes of cells that are sorted together
SORTED = 1 << 20

#: bits of a hash that give way to its place
PLACE = np.uint64(18)
BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class Hasher:
    """Polynomial hashes modulo 2**64 over random letters, for one block of text at a time."""

    def __init__(self, length: int) -> None:
        size = BLOCK + length + 1
        self.up, self.down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        self.length, self.core = length, length // 2

    @staticmethod
    def spread(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def cells(self, raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """For each block: first and last window start of each cell, its anchor's hash, a hash of all its bytes, and
        whether its anchor is at several places in it."""
        windows = len(raw) - self.length + 1
        for at in range(0, max(0, windows), BLOCK):
            x = np.frombuffer(raw, np.uint8)[at : at + BLOCK + self.length - 1]
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(LETTERS[x] * self.up[: len(x)], out=sums[1:])
            core, reach = self.core, self.length - self.core + 1
            grams = self.spread((sums[core:] - sums[:-core]) * self.down[: len(x) - core + 1])
            # of equal hashes the rightmost is the anchor, so the low bits hold the distance from the block's end
            keyed = (grams >> PLACE << PLACE) | np.arange(len(grams) - 1, -1, -1, dtype=np.uint64)
            blocks = np.full(-(-len(grams) // reach) * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
            blocks[: len(grams)] = keyed
            blocks = blocks.reshape(-1, reach)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            count = len(grams) - reach + 1
            least = np.minimum(back[:count], ahead[reach - 1 : reach - 1 + count])
            moved = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            anchors = grams[len(grams) - 1 - (least[moved] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)]
            # neighbours with equal anchors, in periodic text, are one cell in which windows can repeat each other
            new = np.concatenate(([True], anchors[1:] != anchors[:-1]))
            first, anchors = moved[new], anchors[new]
            many = np.diff(np.concatenate((np.flatnonzero(new), [len(new)]))) > 1
            last = np.concatenate((first[1:], [count])) - 1
            ends = last + self.length
            whole = self.spread((sums[ends] - sums[first]) * self.down[first]) ^ self.spread((ends - first).astype(np.uint64) * np.uint64(BASE))
            yield first + at, last + at, anchors, whole, many


def _runs(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, and the hash of what stays. spans: first and last starts of windows."""
    kept, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
    for first, last in sorted(spans):
        if first > end:
            kept.update(raw[at:first])
            runs += 1
            at = first
        stop = max(end, last + length)
        removed += stop - max(first, end if end >= first else first)
        end = at = max(at, stop)
    kept.update(raw[at:])
    return removed, runs, kept.hexdigest()


def _arrow(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of struct(start, end) in bytes, may overlap) for
    each row.

    Null texts are empty; texts shorter than `length` stay whole. Rows that repeat a text are repeats of each other, also
    with equal or null ids. Ids are whole numbers. Other columns are ignored. Empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")).withColumn("h", F.xxhash64("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length)
        names = ["doc_id", "h", "first", "last", "anchor", "whole", "many"]
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc, raw, h in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                for found in hasher.cells(raw.as_py()):
                    held.append((doc.as_py(), h.as_py(), *found))
                    size += len(found[0])
                if size > 50_000:
                    yield pack(held, names)
                    held, size = [], 0
            if held:
                yield pack(held, names)

    def pack(held: list[tuple], names: list[str]) -> pa.RecordBatch:
        counts = [len(x[2]) for x in held]
        ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
        join = lambda k: np.concatenate([x[k] for x in held])
        columns = [ids, pa.array(np.repeat(np.array([x[1] for x in held], np.int64), counts)), pa.array(join(2).astype(np.int32)), pa.array(join(3).astype(np.int32)), pa.array(join(4).view(np.int64)), pa.array(join(5).view(np.int64)), pa.array(join(6))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    cells = rows.mapInArrow(cut, "doc_id long, h long, first int, last int, anchor long, whole long, many boolean")
    shared = cells.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.max("many").alias("many")).where("n > 1 or many").select("anchor", ((F.col("n") > 1) & (F.col("lo") == F.col("hi"))).alias("alone"))
    live = checkpoint(cells.drop("many").join(shared, "anchor"))
    several = live.where(~F.col("alone"))
    classes = several.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "first", "last")).alias("one"))
    crowds = classes.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > spread).select("anchor", F.lit(True).alias("crowd"))
    classes = checkpoint(classes.join(crowds, "anchor", "left").select("anchor", "whole", "n", "one", F.coalesce("crowd", F.lit(False)).alias("crowd")))

    # what each text is told: windows that repeat, and cells that it sends on
    span = lambda: F.struct("first", "last", F.lit(None).cast("long").alias("anchor"), F.lit(False).alias("asks"), F.lit(False).alias("crowd")).alias("told")
    sure = live.where("alone").select("doc_id", "h", span())
    copies = several.join(classes.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("doc_id", "h", span())
    sent = classes.select("one.doc_id", "one.h", F.struct(F.col("one.first").alias("first"), F.col("one.last").alias("last"), "anchor", (F.col("n") == 1).alias("asks"), "crowd").alias("told"))
    sent = sent.withColumn("sends", F.lit(True))
    told = sure.unionByName(copies).withColumn("sends", F.lit(False)).unionByName(sent).groupBy("doc_id", "h").agg(F.collect_list(F.when(~F.col("sends"), F.col("told"))).alias("known"), F.collect_list(F.when(F.col("sends"), F.col("told"))).alias("open"))
    told = told.select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), "known", "open")

    def match(left: DataFrame, right: DataFrame) -> DataFrame:
        # null ids meet too: the id is compared with its null as 0, beside a mark and the text's hash
        keyed = right.withColumn("t_null", F.col("t_id").isNull()).withColumn("t_id", F.coalesce("t_id", F.lit(0)))
        return left.withColumn("k_null", F.col("doc_id").isNull()).withColumn("k_id", F.coalesce("doc_id", F.lit(0))).join(keyed, (F.col("k_id") == F.col("t_id")) & (F.col("h") == F.col("t_h")) & (F.col("k_null") == F.col("t_null")), "left").drop("t_id", "t_h", "t_null", "k_id", "k_null")

    met = match(rows, told)
    spans_of = lambda c: F.transform(c, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    met = met.select("doc_id", "h", "raw", F.coalesce(spans_of("known"), empty).alias("known"), "open")
    # texts without open cells are finished here; the others are kept once, in the shared folder
    met = checkpoint(met.mapInArrow(_finisher(length, True), f"{RESULT}, h long, raw binary, known array<struct<first:int,last:int>>, open array<struct<first:int,last:int,anchor:long,asks:boolean,crowd:boolean>>"))
    done, waiting = met.where("raw is null"), met.where("raw is not null").select("doc_id", "h", "raw", "known", "open")
    cut_out = waiting.select("doc_id", "h", "raw", F.explode("open").alias("o")).select("doc_id", "h", "o.*", F.substring("raw", F.col("o.first") + 1, F.col("o.last") - F.col("o.first") + length).alias("cell"))
    found = _sorted_windows(cut_out.where(~F.col("crowd")), length).unionByName(_counted_windows(cut_out.where("crowd"), length))
    found = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("more")).select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), "more")
    rest = match(waiting.select("doc_id", "h", "raw", "known"), found).select("doc_id", "raw", F.concat("known", F.coalesce("more", empty)).alias("known"))

    names = [f.split()[0] for f in RESULT.split(", ")]
    return done.select(*names).unionByName(rest.mapInArrow(_finisher(length, False), RESULT))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _finisher(length: int, waits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """RESULT of each text from its known windows. With waits, texts with open cells pass on instead, and all others
    have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                get = lambda name: batch.column(batch.schema.names.index(name))  # noqa: E731, B023
                asked = [bool(x.as_py()) for x in get("open")] if waits else [False] * batch.num_rows
                out = []
                for doc, raw, known, skip in zip(get("doc_id").to_pylist(), get("raw"), get("known"), asked, strict=True):
                    if skip:
                        out.append((doc, None, None, None, None, None))
                        continue
                    raw, spans = raw.as_py(), sorted((x["first"], x["last"]) for x in known.as_py())
                    out.append((doc, len(raw), *_runs(raw, spans, length), [{"start": a, "end": b + length} for a, b in spans]))
                done = _arrow(names, kinds, out)
                if waits:
                    kept = pa.array([r.as_py() if skip else None for r, skip in zip(get("raw"), asked, strict=True)], pa.binary())
                    extra = [get("h"), kept, get("known"), get("open")]
                    done = pa.RecordBatch.from_arrays([*done.columns, *extra], names=[*names, "h", "raw", "known", "open"])
                yield done

    return run


def _sorted_windows(cells: DataFrame, length: int) -> DataFrame:
    """doc_id, h, first, last: runs of windows of asking cells that another cell of the same anchor has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "h", "first", "last"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        held: list[tuple] = []
        size, before = 0, None

        def settle() -> pa.RecordBatch:
            text = np.zeros(size, np.uint8)
            place, at = [], 0
            for _, _, _, _, cell in held:
                letters = np.frombuffer(cell, np.uint8)
                text[at : at + len(letters)] = letters
                place.append((at, at + len(letters) - length + 1))
                at += len(letters)
            starts = np.concatenate([np.arange(a, b) for a, b in place])
            hit = repeated_starts(text, starts, length)
            out, k = [], 0
            for (doc, h, first, asks, _), (a, b) in zip(held, place, strict=True):
                flags = hit[k : k + b - a]
                k += b - a
                if asks and flags.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                    out += [(doc, h, first + int(x), first + int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            return _arrow(names, kinds, out)

        for batch in batches:
            for doc, h, first, anchor, asks, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != before and size > SORTED:
                    yield settle()
                    held, size = [], 0
                before = anchor
                held.append((doc, h, first, asks, cell))
                size += len(cell)
        if held:
            yield settle()

    placed = cells.select("doc_id", "h", "first", "anchor", "asks", "cell").repartition("anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(run, "doc_id long, h long, first int, last int")


def _counted_windows(cells: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes: windows are counted by anchor and hash with partial sums, and AQE
    splits what a frequent one joins."""
    windows = cells.select("doc_id", "h", "anchor", "asks", "cell", "first", F.posexplode(F.sequence(F.lit(0), F.col("last") - F.col("first"))).alias("_", "k"))
    windows = windows.select("doc_id", "h", "anchor", "asks", (F.col("first") + F.col("k")).cast("int").alias("first"), F.md5(F.substring("cell", F.col("k") + 1, F.lit(length))).alias("w"))
    often = windows.groupBy("anchor", "w").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "w")
    return windows.where("asks").join(often, ["anchor", "w"]).select("doc_id", "h", "first", F.col("first").alias("last"))
