"""Batch screening: retrieve, score, cut by list, merge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import DEFAULT_K, PRESETS, VECTOR_FACTOR
from vigilframe.functions.text import canonicalize, normalize_dob
from vigilframe.operators import blocking, gates, scoring, vector_search


def retrieve(by_vector: DataFrame, by_key: DataFrame) -> DataFrame:
    """qid, list_id, id, cosine: the union, each candidate once, with its cosine where the vector search gave one, else by_key's
    own if it has that column."""
    none = F.lit(None).cast("double")
    own = F.col("cosine") if "cosine" in by_key.columns else none
    both = by_vector.select("qid", "list_id", "id", "cosine", none.alias("own")).unionByName(by_key.select("qid", "list_id", "id", none.alias("cosine"), own.alias("own")))
    return both.groupBy("qid", "list_id", "id").agg(F.coalesce(F.max("cosine"), F.max("own")).alias("cosine"))


def list_threshold(list_id: Column, per_list: dict[str, float] | None, query_threshold: Column, default: float) -> Column:
    """A list's own floor goes before the query's, and that before the default."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in per_list.items() for x in kv]), list_id) if per_list else F.lit(None).cast("double")
    return F.coalesce(own, query_threshold, F.lit(default))


def top_per_list(scored: DataFrame, k: Column | int) -> DataFrame:
    w = Window.partitionBy("qid", "list_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("list_rank", F.row_number().over(w)).where(F.col("list_rank") <= k)


def merge_lists(matches: DataFrame, k: Column | int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "list_id", "list_rank")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def versions_used(matches: DataFrame) -> DataFrame:
    """qid, list_versions_used (of lists with returned rows) and their composite version."""
    pairs = F.array_sort(F.collect_set(F.struct("list_id", "list_version")))
    got = matches.groupBy("qid").agg(pairs.alias("v"))
    return got.select("qid", F.map_from_entries("v").alias("list_versions_used"), F.concat_ws("|", F.transform("v", lambda x: F.concat(x["list_id"], F.lit("@"), x["list_version"]))).alias("watchlist_version"))


def screen(queries: DataFrame, entities: DataFrame, vectors: DataFrame, preset: str = "balanced", k: int = DEFAULT_K, per_list: dict[str, float] | None = None, enabled: list[str] | None = None) -> DataFrame:
    """The k best matches of each query over all lists, with score, reasons, summary and tier.

    queries: qid, name, vector, optionally dob, country, entity_type, threshold. entities: id (long), list_id,
    list_version, entity_type, primary_name, name_canonical, aliases (array of struct(name, name_canonical)), dob
    (array), countries (array). vectors: id, vector (unit). enabled: lists to search; None is all and [] none.
    """
    if enabled is not None:
        entities = entities.where(F.col("list_id").isin(enabled)) if enabled else entities.limit(0)
    optional = {"dob": "string", "country": "string", "entity_type": "string", "threshold": "double"}
    asked = queries.select("qid", "name", "vector", *[(F.col(c) if c in queries.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()])
    asked = asked.select("qid", "vector", canonicalize(F.col("name")).alias("query_canonical"), normalize_dob(F.col("dob")).alias("query_dob"), F.col("country").alias("query_country"), F.col("entity_type").alias("query_type"), "threshold")
    rows = vectors.join(entities.select("id", "list_id"), "id")
    near = vector_search.topk_exact(asked.select("qid", "vector"), rows, VECTOR_FACTOR * k, decimals=9)
    keyed = entities.withColumn("alias_canonicals", F.transform("aliases", lambda a: a["name_canonical"]))
    posted = blocking.postings(keyed, list_col="list_id")
    hits = blocking.candidates(asked.select("qid", F.col("query_canonical").alias("name_canonical")), posted, keyed)
    # vectors travel only with what was found by keys; the search has given the cosines of the rest
    hits = vector_search.similarity_of(hits.join(asked.select("qid", F.col("vector").alias("query_vector")), "qid"), vectors)
    found = retrieve(near, hits).withColumnRenamed("cosine", "vector_similarity")
    pairs = found.join(entities, ["id", "list_id"]).join(asked.drop("vector"), "qid")
    pairs = pairs.withColumn("names", blocking.names_of(F.col("name_canonical"), F.transform("aliases", lambda a: a["name_canonical"])))
    pairs = scoring.alias_match(scoring.best_name_similarity(pairs, "query_canonical", "names"))
    floor = list_threshold(F.col("list_id"), per_list, F.col("threshold"), PRESETS[preset]["threshold"])
    scored = scoring.compute_score(pairs, preset).withColumn("floor", floor).where(F.col("score") >= F.col("floor"))
    merged = merge_lists(top_per_list(scored, k), k)
    contained = gates.token_containment(F.split("query_canonical", " "), F.flatten(F.transform("names", lambda n: F.split(n, " "))))
    return merged.select("qid", "rank", "list_id", "list_version", "id", "primary_name", "score", "vector_similarity", "lexical_similarity", contained.alias("token_containment"), gates.classify_tier(F.col("score"), F.col("floor")).alias("tier"), "reasons", "summary")


def capped(results: DataFrame, k: int) -> DataFrame:
    """qid, n, capped: whether a search returned as many as it may, so that there can be more. Counted before any gate."""
    return results.groupBy("qid").agg(F.count("*").alias("n")).withColumn("capped", F.col("n") >= k)
