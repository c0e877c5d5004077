"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments. Two fingerprints that differ in at most two bits agree in one segment up to one
bit, so each distinct fingerprint asks the table of that segment for its own value and for the values of the Hamming
ball of radius one. Of a pair that differs by one bit in a segment, the fingerprint with the 0 asks, so the ball is
half as large. A segment value that very many fingerprints share would make pairs in the square of their number;
for those the ball is taken inside the other segment too, whose halves bring 16 bits more into the key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm import prefixes
from vigilframe.llm.common import checkpoint, per_text
from vigilframe.llm.components import connected_components

#: fingerprints with one segment value from which the longer keys are used; it decides the way, never the result
CROWD = 64
#: links that similar_groups() joins to components in one task, at most; more are joined by rounds over tables
FEW = 200_000


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    tokens = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return []
    joined = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def bits_over_half(hashes: list[int] | np.ndarray) -> int:
    """Bit i is 1 if set in more than half of the hashes, repeats counted; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for lo in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > len(values)).tolist()))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """keys and fp, a signed 64-bit fingerprint. Null and blank texts have fingerprint 0; texts with fewer words than a
    shingle count as one shingle."""

    def make() -> Callable[[bytes | None], tuple]:
        def one(raw: bytes | None) -> tuple:
            value = bits_over_half(shingle_hashes(raw or b"", words, seed))
            return (value - (1 << 64) if value >> 63 else value,)

        return one

    return per_text(docs, keys, text, [("fp", T.LongType())], make)


def _segments(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32)]


def _ball(value: Column, width: int) -> Column:
    """Array of struct(value, moved): the value itself, and with each of its 0 bits set."""
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(width)])
    moved = F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) == 0), lambda m: F.struct(value.bitwiseOR(m).alias("value"), F.lit(1).alias("moved")))
    return F.concat(F.array(F.struct(value.alias("value"), F.lit(0).alias("moved"))), moved)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the fingerprints in column fp at distance 1 to radius; radius is 2 at most."""
    if not 0 <= radius <= 2:
        raise ValueError("two segments with balls of radius one find distances up to 2")
    low, high = _segments(F.col("fp"))
    held = distinct.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("segment"), low.alias("value"), high.alias("other")), F.struct(F.lit(1).alias("segment"), high.alias("value"), low.alias("other")))).alias("k")).select("fp", "k.*")
    crowded = held.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("segment", "value", F.lit(True).alias("hot"))
    table = held.join(crowded, ["segment", "value"], "left").select("fp", "segment", "value", "other", F.coalesce("hot", F.lit(False)).alias("hot"))
    table = checkpoint(table)
    asks = table.select(F.col("fp").alias("a"), "segment", "other", F.explode(_ball(F.col("value"), 32)).alias("p")).select("a", "segment", "other", F.col("p.value").alias("value"), F.col("p.moved").alias("moved"))

    cold = table.where(~F.col("hot")).select(F.col("fp").alias("b"), "segment", "value")
    found = asks.join(cold, ["segment", "value"]).where((F.col("a") != F.col("b")) & (_distance("a", "b") <= radius)).select("a", "b")

    # a crowded value: the halves of the other segment agree up to the bits that are left
    halves = lambda other: F.array(F.struct(F.lit(0).alias("half"), other.bitwiseAND(0xFFFF).alias("v")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(other, 16).alias("v")))
    dense = table.where("hot").select(F.col("fp").alias("b"), "segment", "value", F.explode(halves(F.col("other"))).alias("h")).select("b", "segment", "value", "h.half", "h.v")
    near = asks.join(table.where("hot").select("segment", "value").distinct(), ["segment", "value"], "left_semi")
    near = near.select("a", "segment", "value", "moved", F.explode(halves(F.col("other"))).alias("h")).select("a", "segment", "value", "moved", "h.half", F.explode(_ball(F.col("h.v"), 16)).alias("q"))
    near = near.where(F.col("moved") + F.col("q.moved") <= 1).select("a", "segment", "value", "half", F.col("q.value").alias("v"))
    found_dense = near.join(dense, ["segment", "value", "half", "v"]).where((F.col("a") != F.col("b")) & (_distance("a", "b") <= radius)).select("a", "b")
    pairs = found.unionByName(found_dense)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_docs (rows in the component) for each row.

    Rows with equal fingerprints are one node; nodes at most radius bits apart are linked, and component_id is the
    smallest id that links reach. Null ids never become a component's id unless there is no other; repeated rows stay.
    Other columns are ignored. Empty input gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    prints = checkpoint(fingerprints(keyed, ["doc_id"], "text", words, seed))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = connected_components(links(nodes.select("fp"), radius))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "n")
    linked = labelled.join(roots.select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi")
    merged = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("n_docs"))
    classes = labelled.join(merged, "root", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("n_docs", "n").alias("n_docs"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_docs")


def row_key(id_col: str, text: str) -> Column:
    """One value for the pair of id and text, nulls told apart from empty texts."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.when(F.col(text).isNull(), "null").otherwise("text"), F.col(text)))


def shingle_set(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending. A text with fewer words is one shingle; a blank one has none."""
    tokens = text.lower().split()  # as in shingle_hashes()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    mixed = np.full(n, min(words, len(tokens)), np.uint64)
    for k in range(min(words, len(tokens))):
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def simhash_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of the least node of a component of linked fingerprints and each other node of it, from rows (node, fp).

    A node can have several fingerprints, since those count repeats: it then stands in several components."""
    held = checkpoint(prints.select("node", "fp").distinct())
    roots = connected_components(links(held.select("fp").distinct(), radius), few=FEW)
    rooted = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("a"))
    return rooted.join(least, "root").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """doc_id, row_key (of id and text, see row_key()), group_id and first: the smallest id of the rows that links reach, and
    whether the row is the first of its group (by id, nulls last, then text). A link is a Jaccard similarity of at
    least `similarity` between the sets of shingles of `words` words.

    Texts with equal sets are one node; null and blank texts are one group. Pairs come from a prefix filter (`prefixes`), which
    misses none at the threshold, and are verified on the whole sets: first each node with the least node of its shared
    shingles, then all pairs that meet and aren't together yet. So what a group of copies makes follows its size, and
    no pair is left out for the size of a key.

    SimHash goes first: the fingerprints of near_duplicates(), linked at `radius` bits by links(), and each node of a component
    is a candidate with the component's least node, verified like any other. The prefix filter then does what
    is left: it makes no pair of nodes that SimHash has put together, and finds those at the similarity whose fingerprints differ by more.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("row_key", row_key("doc_id", "text"))

    def make_set() -> Callable[[bytes], np.ndarray]:
        known = WordHashes()
        return lambda raw: shingle_set(raw, words, known)

    table = docs.sparkSession.sparkContext.broadcast(prefixes.order_of(keyed, "text", make_set))

    def make() -> Callable[[bytes | None], tuple]:
        members, levels = make_set(), np.frombuffer(table.value, np.uint8)

        def one(raw: bytes | None) -> tuple:
            s = members(raw or b"")
            fp = bits_over_half(shingle_hashes(raw or b"", 3, 42))
            return prefixes.node_of(s.astype("<u8").tobytes()), fp - (1 << 64) if fp >> 63 else fp, len(s), prefixes.first_members(s, levels, similarity)

        return one

    fields = [("node", T.LongType()), ("fp", T.LongType()), ("n", T.LongType()), ("first", T.BinaryType())]
    prints = checkpoint(per_text(keyed, ["doc_id", "row_key"], "text", fields, make))
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("row_key"))
    n = prints.count()
    nodes = checkpoint(prints.groupBy("node").agg(F.min(order).alias("one")), n)
    met = checkpoint(prefixes.shared(prints, similarity, table), 8 * n)

    def make_sets() -> Callable[[bytes], bytes]:
        members = make_set()
        return lambda raw: members(raw).astype("<u8").tobytes()

    def alike(found: DataFrame) -> DataFrame:
        """Pairs verified on the sets of their nodes, each made from one of the node's texts."""
        pairs = checkpoint(found, n)
        if pairs.isEmpty():
            return pairs
        live = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("one.row_key").alias("row_key")), "node")
        sets = checkpoint(prefixes.sets_of(keyed, live, make_sets), n)
        return checkpoint(prefixes.alike(pairs, sets, similarity), n)

    linked = alike(simhash_pairs(prints, radius))
    nearest = linked.unionByName(alike(prefixes.to_hubs(met, similarity, connected_components(linked, n, FEW))))
    rest = alike(prefixes.all_pairs(met, similarity, connected_components(nearest, n, FEW)))
    roots = connected_components(nearest.unionByName(rest), n, FEW)
    labelled = nodes.join(roots, "node", "left").select("node", "one", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("one").alias("least"))
    grouped = labelled.join(least, "root").select("node", "least")
    return prints.select("doc_id", "row_key", "node").join(grouped, "node").select("doc_id", "row_key", F.col("least.doc_id").alias("group_id"), (F.col("row_key") == F.col("least.row_key")).alias("first"))
