"""Mixing sources to target weights.

Sizes are summed by source, targets follow from the weights, and target / size is a source's repetition rate. A
document is taken floor(rate) times, and once more if a uniform number hashed from its id and the seed is below the
rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import WORD, checkpoint, ordinals


def word_count(text: Column) -> Column:
    """Words that are separated by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat over the sources in code point order, null last."""
    k = F.pmod(F.col("ordinal"), F.lit(len(cycle))).cast("int")
    return ordinals(sizes, [F.col("source").asc_nulls_last()]).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), k + 1).cast("long")).drop("ordinal")


def source_targets(weighted: DataFrame, max_rate: int = 3) -> DataFrame:
    """Add target to (source, source_size, weight): the whole size shared by weight, no source above max_rate times its size.

    What a source can't take is shared again by weight among the others until none is above. Each round is one
    aggregate over the sources that returns one row of sums; a round is needed only when it finds a new source that is
    full, and the share of a unit of weight only grows, so the rounds end.
    """
    cap = F.col("source_size") * max_rate
    total, weights = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = total / weights if weights else 0.0
    while weights:
        full = F.col("weight") * F.lit(float(share)) > cap
        taken, free = weighted.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        after = (total - taken) / free if free else share
        if after <= share:
            break
        share = after
    return weighted.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(share))))


#: sources whose rates are sent to all tasks at most: a row of some hundred bytes each
MOST_SOURCES = 10_000


def _sent(rates: DataFrame, sources: int) -> DataFrame:
    """A broadcast where the counted sources are few; else a join by source, which AQE can split for a hot one."""
    return F.broadcast(rates) if sources <= MOST_SOURCES else rates


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 42, max_rate: int = 3, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken for each row.

    weights: source, weight (long); None takes cyclic_weights(). Null texts have size 0 and null sources are a source.
    A source without words has rate 0. Repeated rows are decided alike, since the draw depends on the id. Columns other
    than those named are ignored. Empty input gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighted = cyclic_weights(sizes)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("long").alias("weight"))
        weighted = checkpoint(sizes.join(w, sizes["source"].eqNullSafe(w["w_source"]), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")))
    # the tables meet on the source's text and on whether it is null, an equi-join that AQE can split for a hot source
    targets = source_targets(weighted, max_rate).select(F.col("source").isNull().alias("__n"), F.coalesce("source", F.lit("")).alias("__s"), "source_size", "target")
    joined = sized.withColumn("__n", F.col("source").isNull()).withColumn("__s", F.coalesce("source", F.lit(""))).join(targets, ["__n", "__s"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = joined.withColumn("rate", rate)
    extra = (uniform(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        rated.withColumn("copies", F.floor("rate") + extra)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
    )


def emit(docs: DataFrame, seed: int = 42, max_rate: int = 3, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as mix() says, with the columns of docs only. The null source is a source;
    repeated rows are drawn alike; sources without words are left out; empty input gives an empty result.

    Copies are made where the row is, by a rate that is joined by source; texts aren't shuffled unless there are more than
    MOST_SOURCES sources.
    """
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = cyclic_weights(sizes)
    rates = source_targets(weighted, max_rate).select(
        F.col("source").isNull().alias("__n"), F.coalesce("source", F.lit("")).alias("__s"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate")
    )
    keyed = docs.withColumn("__n", F.col(source).isNull()).withColumn("__s", F.coalesce(F.col(source), F.lit("")))
    copies = F.floor("__rate") + (uniform(F.col(id_col), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    times = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))
    return keyed.join(_sent(rates, weighted.count()), ["__n", "__s"]).withColumn("__copy", F.explode(times)).select(*docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source
), weighted AS (
  SELECT source, s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sums
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k FROM weighted
), prefix AS (
  SELECT *, (sum(s) OVER ())::BIGINT AS total,
    coalesce((sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS full_before,
    (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS free
  FROM ranked
), level AS (
  SELECT min_by((total - full_before)::DOUBLE / free::DOUBLE, k) AS share FROM prefix
  WHERE (total - full_before)::DOUBLE / free::DOUBLE <= 3.0 * s / w
), targets AS (
  SELECT source, s, least((3 * s)::DOUBLE, w * share) AS target FROM weighted, level
), rated AS (
  SELECT d.doc_id, d.size, t.s AS source_size, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
