"""Lexical blocking: postings by token and by sound, cut by document frequency, and their candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import DF_RATIO, MAX_LEXICAL
from vigilframe.functions.similarity import phonetic_keys_col, token_set_col
from vigilframe.functions.text import name_tokens


def names_of(primary: Column, aliases: Column) -> Column:
    """Distinct canonical names: the entity's own and its aliases', without empty ones."""
    both = F.concat(F.array(F.coalesce(primary, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.filter(F.array_distinct(both), lambda n: n != "")


def keys_of(names: DataFrame, keep: list[str], canonical: str, phonetic: bool = True) -> DataFrame:
    """keep…, kind ('token' or 'sound') and key, distinct."""
    tokens = names.select(*keep, F.explode(name_tokens(F.col(canonical))).alias("key")).distinct()
    by_token = tokens.select(*keep, F.lit("token").alias("kind"), "key")
    if not phonetic:
        return by_token
    # each distinct token is spoken once
    sounds = tokens.select("key").distinct().withColumn("sounds", phonetic_keys_col("key"))
    by_sound = tokens.join(sounds, "key").select(*keep, F.lit("sound").alias("kind"), F.explode("sounds").alias("key")).distinct()
    return by_token.unionByName(by_sound)


def postings(entities: DataFrame, ratio: float = DF_RATIO, phonetic: bool = True, list_col: str | None = None) -> DataFrame:
    """list_id, kind, key, id of keys in at most max(1, ceil(ratio * entities of the list)) entities.

    entities: id, name_canonical, optionally alias_canonicals (array of string). Cutting frequent keys before the join
    is also what keeps it free of skew: no key has more rows than the cutoff.
    """
    lists = F.col(list_col) if list_col else F.lit("")
    aliases = F.col("alias_canonicals") if "alias_canonicals" in entities.columns else F.array().cast("array<string>")
    named = entities.select(lists.alias("list_id"), "id", F.explode_outer(names_of(F.col("name_canonical"), aliases)).alias("name"))
    sizes = named.groupBy("list_id").agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("id") * F.lit(ratio))).alias("cutoff"))
    keyed = keys_of(named, ["list_id", "id"], "name", phonetic)
    frequent = keyed.groupBy("list_id", "kind", "key").agg(F.count("*").alias("df")).join(sizes, "list_id").where(F.col("df") <= F.col("cutoff")).select("list_id", "kind", "key", "df")
    return keyed.join(frequent, ["list_id", "kind", "key"]).select("list_id", "kind", "key", "id", "df")


def index_stats(entities: DataFrame, phonetic: bool = True) -> DataFrame:
    """Distinct tokens and sounds."""
    named = entities.select("id", F.explode(names_of(F.col("name_canonical"), F.col("alias_canonicals") if "alias_canonicals" in entities.columns else F.array().cast("array<string>"))).alias("name"))
    keyed = keys_of(named, ["id"], "name", phonetic)
    return keyed.groupBy("kind").agg(F.count_distinct("key").alias("keys"))


def candidates(queries: DataFrame, posted: DataFrame, entities: DataFrame | None = None, cap: int = MAX_LEXICAL, phonetic: bool = True) -> DataFrame:
    """qid, list_id, id of entities that share a key with the query.

    queries: qid, name_canonical. Only queries with more than `cap` hits are ranked, by the best token-set similarity
    of the entity's names and then by id; entities gives the names for that.
    """
    asked = keys_of(queries.select("qid", "name_canonical"), ["qid"], "name_canonical", phonetic)
    hits = asked.join(posted.select("list_id", "kind", "key", "id"), ["kind", "key"]).select("qid", "list_id", "id").distinct()
    if entities is None:
        return hits
    counts = hits.groupBy("qid", "list_id").agg(F.count("*").alias("n"))
    over = hits.join(counts.where(F.col("n") > cap), ["qid", "list_id"])
    names = entities.select("id", names_of(F.col("name_canonical"), F.col("alias_canonicals") if "alias_canonicals" in entities.columns else F.array().cast("array<string>")).alias("names"))
    scored = over.join(names, "id").join(queries.select("qid", F.col("name_canonical").alias("q")), "qid").select("qid", "list_id", "id", "q", F.explode("names").alias("name"))
    best = scored.withColumn("s", token_set_col("q", "name")).groupBy("qid", "list_id", "id").agg(F.max("s").alias("s"))
    kept = best.withColumn("r", F.row_number().over(Window.partitionBy("qid", "list_id").orderBy(F.desc("s"), "id"))).where(F.col("r") <= cap).select("qid", "list_id", "id")
    return hits.join(counts.where(F.col("n") <= cap).select("qid", "list_id"), ["qid", "list_id"]).select("qid", "list_id", "id").unionByName(kept)
