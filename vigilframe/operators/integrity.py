"""Content-addressed chunks, version pointers and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import list_instant


def scoped_files(files: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Files that are wanted by name, or by a prefix that ends with a slash; all for None."""
    if wanted is None:
        return files
    keep = F.lit(False)
    for w in wanted:
        keep = keep | (F.col("path").startswith(w) if w.endswith("/") else F.col("path") == w)
    return files.where(keep)


def chunk_table(files: DataFrame) -> DataFrame:
    """path, sha256, position, hash, size of files (path, sha256, chunks: array of struct(hash, size))."""
    return files.select("path", "sha256", F.posexplode("chunks").alias("position", "c")).select("path", "sha256", "position", "c.hash", "c.size")


def missing_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    return chunks.select("hash", "size").distinct().join(store.select("hash"), "hash", "left_anti")


def reused_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    return chunks.select("hash", "size").distinct().join(store.select("hash"), "hash", "left_semi")


def needed_bytes(chunks: DataFrame, store: DataFrame) -> DataFrame:
    gone = missing_chunks(chunks, store)
    return gone.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def verify_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """hash and problem of chunks that are missing, have another size, or another content. store: hash, content."""
    joined = chunks.select("hash", "size").distinct().join(store.select("hash", "content"), "hash", "left")
    problem = F.when(F.col("content").isNull(), "missing").when(F.length("content") != F.col("size"), "size").when(F.sha2("content", 256) != F.col("hash"), "content")
    return joined.select("hash", problem.alias("problem")).where("problem is not null")


def reassemble(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """path and content, the chunks in order; fails if the whole has another hash. A file is one row, so it fits a task."""
    joined = chunks.join(store.select("hash", "content"), "hash")
    parts = F.array_sort(F.collect_list(F.struct("position", F.hex("content").alias("h"))))
    whole = joined.groupBy("path", "sha256").agg(F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["h"]))).alias("content"))
    return whole.select("path", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong content of "), F.col("path")))).alias("content"))


def is_rollback(active_sequence: Column, incoming_sequence: Column) -> Column:
    """An older version may not follow a newer one; an unknown active sequence counts as 0."""
    return incoming_sequence < F.coalesce(active_sequence, F.lit(0))


def next_sequence(live: int | None) -> int:
    current = live or 0
    if not 0 <= current < (1 << 53) - 1:
        raise OverflowError("no sequence follows")
    return current + 1


def freshness(catalog: DataFrame, now: str, max_age_days: int = 90, ahead_hours: int = 24) -> DataFrame:
    """list_id, age_days and breaches of catalog rows (list_id, fetched_at, generated_at, stale)."""
    at = list_instant(F.col("fetched_at"), F.col("generated_at"))
    age = (F.lit(now).cast("timestamp").cast("double") - at.cast("double")) / 86400
    breaches = F.array_compact(F.array(F.when(at.isNull(), "unknown age"), F.when(age > max_age_days, "too old"), F.when(age < -ahead_hours / 24, "in the future"), F.when(F.coalesce(F.col("stale"), F.lit(False)), "carried forward")))
    return catalog.select("list_id", F.floor(age).cast("long").alias("age_days"), breaches.alias("breaches"))


def check_counts(entities: DataFrame, bands: dict[str, tuple[int, int]]) -> None:
    """Raises if a list's number of entities is outside of its band; no catalog at all is a failure."""
    counts = {r["list_id"]: r["count"] for r in entities.groupBy("list_id").count().collect()}
    bad = [f"{name}: {counts.get(name, 0)}" for name, (lo, hi) in bands.items() if not lo <= counts.get(name, 0) <= hi]
    if bad or not bands:
        raise ValueError("implausible counts: " + ", ".join(bad))


def fits_quota(quota: Column, usage: Column, needed: Column) -> Column:
    """Whether what is needed fits; an unknown quota or usage counts as enough."""
    return F.coalesce(quota - usage >= needed, F.lit(True))
