"""Receipts of matches: what was scored by which versions, hashed, and a signature over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import hashing

ENGINE, VERSION = "vigilframe", "1"


def with_receipts(matches: DataFrame, versions: DataFrame) -> DataFrame:
    """matches (qid, id, query, score, tier) with receipt, a JSON, and its hash. A score outside of 0 to 1 fails."""
    score = F.when(F.col("score").between(0, 1), F.col("score")).otherwise(F.raise_error(F.lit("a score outside of 0 to 1")))
    inputs = hashing.sha256_tag(F.to_json(F.struct(F.col("id").cast("string").alias("entity"), F.col("query").alias("query"))))
    subject = F.to_json(F.struct(F.lit(ENGINE).alias("engine"), F.lit(VERSION).alias("engine_version"), inputs.alias("inputs_hash"), F.lit("match").alias("kind"), score.alias("score"), F.col("tier").alias("tier"), F.col("watchlist_version").alias("watchlist_version")))
    joined = matches.join(versions.select("qid", "watchlist_version"), "qid", "left")
    return joined.withColumn("receipt", subject).withColumn("receipt_hash", hashing.sha256_tag(F.col("receipt")))


def batch_digest(receipts: DataFrame) -> bytes:
    """A hash of all receipts that doesn't depend on their order: their number, and sums of the parts of their hashes."""
    hexes = F.substring("receipt_hash", 8, 64)
    parts = [F.coalesce(F.sum(F.conv(F.substring(hexes, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)) for k in range(5)]
    row = receipts.agg(F.count("*"), *parts).first()
    return "|".join(str(int(x)) for x in row).encode()


def sign(spark: SparkSession, receipts: DataFrame, private_key: bytes) -> bytes:
    return hashing.ed25519_sign(spark, private_key, batch_digest(receipts))


def verify(spark: SparkSession, receipts: DataFrame, public_key: bytes, signature: bytes) -> bool:
    """Whether each receipt has its hash and the batch was signed as it is."""
    wrong = receipts.where(hashing.sha256_tag(F.col("receipt")) != F.col("receipt_hash"))
    return wrong.isEmpty() and hashing.ed25519_verify(spark, public_key, batch_digest(receipts), signature)
