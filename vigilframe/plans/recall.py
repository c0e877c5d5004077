"""Evaluation runs: recall of labelled queries, and decision evidence with its report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators import evaluate, gates

#: results of a screen: qid, id, rank, score, lexical_similarity, token_containment
Screener = Callable[[DataFrame], DataFrame]
CUTOFFS = [1, 10, 25]


def run_recall(labelled: DataFrame, screen: Screener, cutoffs: list[int] | None = None) -> DataFrame:
    """kind, k, n, hits, recall, absent, absent_rate. labelled: qid, kind, query, expected (array of ids)."""
    expected = labelled.select("qid", F.explode("expected").alias("id"))
    ranks = evaluate.first_expected_rank(screen(labelled).select("qid", "id", "rank"), expected).join(labelled.select("qid", "kind"), "qid")
    out = None
    for kind in [r["kind"] for r in labelled.select("kind").distinct().orderBy("kind").collect()]:
        part = evaluate.recall_at(ranks.where(F.col("kind") == kind), cutoffs or CUTOFFS).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def decision_evidence(labelled: DataFrame, screen: Screener) -> DataFrame:
    """qid, segment, id, rank, score, lexical, containment, expected, kept, primary: every returned candidate, and expected
    ones that did not come back, with score 0 and without rank."""
    expected = labelled.select("qid", F.explode("expected").alias("id")).distinct()
    found = screen(labelled).select("qid", "id", "rank", "score", F.col("lexical_similarity").alias("lexical"), F.col("token_containment").alias("containment"))
    gone = evaluate.missing_rows(expected, found).select("qid", "id", "rank", "score", F.lit(0.0).alias("lexical"), F.lit(False).alias("containment"))
    rows = found.unionByName(gone).join(expected.withColumn("expected", F.lit(True)), ["qid", "id"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    kept, primary = gates.verdicts(F.col("score"), F.col("lexical"), F.col("containment"))
    return rows.join(labelled.select("qid", F.col("kind").alias("segment")), "qid").withColumn("kept", kept).withColumn("primary", primary)


def decision_report(evidence: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Confusion metrics by unit, pool, level and band. verdicts: qid, verdict, for queries that collide with other names."""
    judged = evidence.join(verdicts.select("qid", "verdict"), "qid", "left") if verdicts is not None else evidence.withColumn("verdict", F.lit(None).cast("string"))
    truth = evaluate.is_true_match(F.col("expected"), F.col("verdict"), F.col("containment"))
    return evaluate.decision_cells(judged.withColumn("truth", truth))
