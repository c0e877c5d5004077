"""Document fingerprints: MinHash signatures, their likeness, and near-duplicates by bands.

A shingle is five words. Words are hashed, five word hashes make a shingle's, and each of several universal hash
functions (a*x + b modulo a prime, reduced) permutes the shingles; a signature holds the minima. All of that is
numpy over a whole text. Signatures with an equal band of components are joined in Spark, and the Jaccard similarity
of the shingle sets of such pairs is verified.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm import prefixes
from vigilframe.llm.common import checkpoint, ordinals, per_text
from vigilframe.llm.components import connected_components

WORDS = 5
#: nodes of one band from which the other way is used; it decides the way, never the result
CROWD = 64
SIZE = 128
PRIME = np.uint64((1 << 61) - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def permutations(size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """a (odd, 64 bits) and b of the functions (a*x + b mod 2**64) >> 32, a universal family."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)


class WordHashes(dict):
    """crc32 of a word, spread over 64 bits; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = (zlib.crc32(word) << 32 | zlib.adler32(word)) & ((1 << 63) - 1)
        return value


def shingles(text: bytes, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles. A text with fewer words is one shingle; a blank one has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(words, len(tokens))):
        mixed = (mixed ^ hashes[k : k + n]) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """Minima of each function, as 32-bit numbers; all ones for a text without shingles."""
    out = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(hashes), block):
        table = hashes[lo : lo + block, None] * a
        table += b
        np.minimum(out, table.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of equal components, an estimate of the Jaccard similarity."""
    return float((x == y).mean())


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, words: int = WORDS) -> DataFrame:
    """keys and signature (binary, size little-endian 32-bit numbers). Null texts count as empty."""

    def make() -> Callable[[bytes | None], tuple]:
        (a, b), known = permutations(size), WordHashes()
        return lambda raw: (signature(shingles(raw or b"", known, words), a, b).tobytes(),)

    return per_text(docs, keys, text, [("signature", T.BinaryType())], make)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, words: int = WORDS) -> DataFrame:
    """For each row: the fingerprints of its text and of its edited text, and their likeness; that to the next row's too.

    Next is the row with the next smaller id (ties by text; null ids last; after the last row comes the first). The
    edited text ends in the next text's beginning instead of its own last third. Rows are dealt into ranges of ids
    and sorted there; the first row of a range is sent to the range before as well, so a text is moved once, and the
    firsts twice. Only ranges' borders reach the driver, as many as there are ranges.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    placed = ordinals(docs.select(F.col(id_col).cast("long").alias("doc_id")), [F.col("doc_id").desc_nulls_last()])
    n = placed.count()
    parts = max(1, min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = max(1, -(-n // parts))
    # the id at the start of each range: range k has the ids from its border down to the one before border k + 1
    borders = [r["doc_id"] for r in placed.where(F.col("ordinal") % step == 0).orderBy("ordinal").select("doc_id").collect()]
    firsts = list(dict.fromkeys(borders))
    low = F.lit(-(1 << 63)).cast("long")
    rank = lambda c: F.coalesce(c, low)
    bounds = F.array(*[F.coalesce(F.lit(b).cast("long"), low) for b in firsts]) if firsts else F.array().cast("array<long>")
    # borders fall; a row is in the last range whose border is not below its id
    inside = rows.withColumn("__range", F.size(F.filter(bounds, lambda b: b >= rank(F.col("doc_id")))) - 1)
    first = F.element_at(bounds, F.col("__range") + 1) == rank(F.col("doc_id"))
    last_range = max(0, len(firsts) - 1)
    before = F.when(F.col("__range") == 0, F.lit(last_range)).otherwise(F.col("__range") - 1)
    places = F.when(first, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest")), F.struct(before.alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest"))))
    dealt = inside.withColumn("__p", F.explode(places)).select("doc_id", F.col("text").cast("binary").alias("text"), F.col("__p.r").alias("r"), F.col("__p.guest").alias("guest"))
    ordered = dealt.repartition(max(1, len(firsts) // 4), "r").sortWithinPartitions("r", "guest", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), known = permutations(size), WordHashes()
        sign = lambda raw: signature(shingles(raw, known, words), a, b)
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held: tuple | None = None
        out: list[tuple] = []

        def close(row: tuple, following: tuple) -> None:
            doc, raw, sig = row
            whole = raw.decode()
            cut = len(whole) // 3
            edited = (whole[: len(whole) - cut] + following[1].decode()[:cut]).encode()
            other = sign(edited) if edited != raw else sig
            out.append((doc, len(whole), hashlib.sha256(edited).hexdigest(), sig.tobytes().hex(), other.tobytes().hex(), likeness(sig, other), likeness(sig, following[2])))

        done_range = None
        for batch in batches:
            for doc, raw, r, guest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if r == done_range:
                    continue
                row = (doc, raw, sign(raw))
                if held is not None:
                    close(held, row)
                held = None if guest else row
                done_range = r if guest else None
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, schema)


def _met_by_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of the sets (node, s) that may be similar enough, by the sets' rarest members."""
    members = sets.select("node", F.explode("s").alias("token"))
    counted = members.join(members.groupBy("token").agg(F.count("*").alias("df")), "token")
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("m")).select("node", F.size("m").cast("long").alias("n"), "m")
    first = ordered.select("node", "n", F.posexplode("m").alias("place", "x")).where(F.col("place") < F.col("n") - F.ceil(threshold * F.col("n") - prefixes.SLACK) + 1)
    late = (F.col("place") > F.col("n") - F.ceil(2 * threshold / (1 + threshold) * F.col("n") - prefixes.SLACK)).cast("int")
    rows = checkpoint(first.where("x.df > 1").select(F.col("x.token").alias("token"), late.alias("late"), "n", "node", "place"))
    return prefixes.all_pairs(rows, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 32, size: int = SIZE, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id and links: the smallest id of the row's class, and the number of other texts linked to its text.

    Equal shingle sets are one node. Nodes that share a band are candidates; the nodes of bands that more than `crowd`
    share meet by their rarest shingles instead (`prefixes`), which misses no pair at the threshold. Links are pairs with a
    verified Jaccard similarity of at least `threshold`.
    """

    def make() -> Callable[[bytes | None], tuple]:
        (a, b), known = permutations(size), WordHashes()

        def one(raw: bytes | None) -> tuple:
            s = shingles(raw or b"", known, words)
            return hashlib.md5(s.tobytes()).hexdigest(), signature(s, a, b).tobytes(), s.view(np.int64).tolist(), s.astype("<u8").tobytes()

        return one

    fields = [("node", T.StringType()), ("signature", T.BinaryType()), ("shingles", T.ArrayType(T.LongType())), ("packed", T.BinaryType())]
    signed = checkpoint(per_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", fields, make))
    nodes = signed.groupBy("node").agg(F.first("signature").alias("signature"), F.first("shingles").alias("shingles"), F.first("packed").alias("packed"))
    rows = size // bands * 4
    banded = nodes.select("node", "signature", F.posexplode(F.array(*[F.substring("signature", F.lit(k * rows + 1), F.lit(rows)) for k in range(bands)])).alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    joined = checkpoint(banded.join(shared, ["band", "value"]).select("node", "band", "value", "n"))
    small = joined.where(F.col("n") <= crowd)
    pairs = small.select("band", "value", F.col("node").alias("a")).join(small.select("band", "value", F.col("node").alias("b")), ["band", "value"]).where("a < b").select("a", "b")
    sets = nodes.select("node", F.col("shingles").alias("s"), "packed")
    crowded = sets.join(joined.where(F.col("n") > crowd).select("node").distinct(), "node", "left_semi")
    pairs = pairs.unionByName(_met_by_prefixes(crowded, threshold)).distinct()
    edges = checkpoint(prefixes.alike(pairs, sets.select("node", F.col("packed").alias("s")), threshold))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    roots = connected_components(edges)
    labelled = signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(least, "root").join(degree, "node", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
