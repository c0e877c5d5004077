"""The explainable score: five weighted signals and a reason for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import ALIAS_FULL, ALIAS_FUZZY, ALIAS_PARTIAL, ALIAS_SET_FLOOR, ALIAS_SORT_FLOOR, DOB_MENTIONED, PRESETS, STRONG_SIMILARITY
from vigilframe.functions.similarity import best_ratio_col, token_sets_col, token_sorts_col

REASON = "struct<signal:string,value_num:double,value_str:string,weight:double,contribution:double,description:string>"


def _text(value: Column) -> Column:
    return F.format_string("%.3f", value)


def best_name_similarity(pairs: DataFrame, query: str, names: str, out: str = "lexical_similarity") -> DataFrame:
    """pairs with the best sequence ratio of the query to any of the names (array); 0 without names."""
    return pairs.withColumn(out, best_ratio_col(query, names))


def alias_tier(query: Column, alias: Column, sort: Column, sets: Column) -> Column:
    """Exact or equal but for word order, contained one way, similar token sets, or nothing. An empty alias is
    contained in every query."""
    contained = F.contains(alias, query) | F.contains(query, alias)
    return F.when(query == alias, ALIAS_FULL).when(sort >= ALIAS_SORT_FLOOR, ALIAS_FULL).when(contained, ALIAS_PARTIAL).when(sets >= ALIAS_SET_FLOOR, ALIAS_FUZZY).otherwise(0.0)


def alias_match(pairs: DataFrame, keys: list[str] | None = None, query: str = "query_canonical", aliases: str = "aliases") -> DataFrame:
    """pairs with alias_score and alias_name: the best tier over the aliases (array of struct(name, name_canonical)),
    of equal tiers the first alias. keys aren't needed any more: each row is compared where it is."""
    low = F.transform(aliases, lambda a: F.lower(a["name_canonical"]))
    with_low = pairs.withColumn("__q", F.lower(F.col(query))).withColumn("__low", low)
    told = with_low.withColumn("__sort", token_sorts_col("__q", "__low")).withColumn("__set", token_sets_col("__q", "__low"))

    def tier(a: Column, i: Column) -> Column:
        at = lambda c: F.get(c, i)
        return F.struct(alias_tier(F.col("__q"), at("__low"), at("__sort"), at("__set")).alias("t"), (-i).alias("i"), a["name"].alias("name"))

    best = F.array_max(F.filter(F.transform(aliases, tier), lambda x: x["t"] > 0))
    joined = told.withColumn("__b", best)
    return joined.withColumn("alias_score", F.coalesce("__b.t", F.lit(0.0))).withColumn("alias_name", F.col("__b.name")).drop("__b", "__q", "__low", "__sort", "__set")


def dob_signal(dobs: Column, query: Column) -> tuple[Column, Column]:
    """Score and description. The first date that agrees in full or in its year decides."""
    def one(d: Column) -> Column:
        exact = F.struct(F.lit(1.0).alias("s"), F.concat(F.lit("Exact DOB match: "), d).alias("d"))
        year = F.struct(F.lit(0.5).alias("s"), F.concat(F.lit("Year match: "), F.substring(query, 1, 4)).alias("d"))
        return F.when(d == query, exact).when(F.substring(d, 1, 4) == F.substring(query, 1, 4), year)

    first = F.try_element_at(F.filter(F.transform(dobs, one), lambda x: x.isNotNull()), F.lit(1))
    absent = query.isNull() | (F.size(F.coalesce(dobs, F.array().cast("array<string>"))) == 0)
    score = F.when(absent, 0.0).otherwise(F.coalesce(first["s"], F.lit(0.0)))
    text = F.when(absent, "No DOB provided or entity has no DOB").otherwise(F.coalesce(first["d"], F.lit("No DOB match")))
    return score, text


def country_signal(countries: Column, query: Column) -> tuple[Column, Column]:
    """One over the number of the entity's countries if the query's is one of them."""
    upper = F.array_sort(F.array_distinct(F.transform(countries, lambda c: F.upper(c))))
    q, n = F.upper(query), F.size(upper)
    shown = F.concat(F.lit("["), F.concat_ws(", ", upper), F.lit("]"))
    absent = query.isNull() | (F.size(F.coalesce(countries, F.array().cast("array<string>"))) == 0)
    member = F.array_contains(upper, q)
    score = F.when(absent | ~member, 0.0).otherwise(F.lit(1.0) / n)
    text = (
        F.when(absent, "No country provided or entity has no countries")
        .when(~member, F.concat(F.lit("No country match: "), q, F.lit(" not in "), shown))
        .when(n == 1, F.concat(F.lit("Exact country match: "), q))
        .otherwise(F.concat(F.lit("Country match: "), q, F.lit(" in "), shown))
    )
    return score, text


def compute_score(pairs: DataFrame, preset: str = "balanced") -> DataFrame:
    """pairs with score, reasons and summary.

    Needs vector_similarity, lexical_similarity, alias_score, alias_name, dob (array), countries (array), entity_type,
    and query_dob, query_country, query_type. Contributions are added from left to right in the order of the signals.
    """
    w = PRESETS[preset]
    vector, lexical, alias = F.col("vector_similarity"), F.col("lexical_similarity"), F.col("alias_score")
    dob, dob_text = dob_signal(F.col("dob"), F.col("query_dob"))
    country, country_text = country_signal(F.col("countries"), F.col("query_country"))

    def reason(signal: str, value: Column, weight: float, text: Column, shown: Column | None = None) -> Column:
        number = F.lit(None).cast("double") if shown is not None else value.cast("double")
        return F.struct(F.lit(signal).alias("signal"), number.alias("value_num"), (shown if shown is not None else F.lit(None).cast("string")).alias("value_str"), F.lit(weight).alias("weight"), (value * F.lit(weight)).alias("contribution"), text.alias("description")).cast(REASON)

    has_dob, has_country = (dob > 0) | F.col("query_dob").isNotNull(), (country > 0) | F.col("query_country").isNotNull()
    same = F.upper("entity_type") == F.upper("query_type")
    type_text = (
        F.when(F.col("query_type").isNull(), "No entity type specified in query")
        .when(same, F.concat(F.lit("Entity type match: "), F.col("entity_type")))
        .otherwise(F.concat(F.lit("Entity type mismatch: "), F.col("entity_type"), F.lit(" != "), F.col("query_type")))
    )
    none = F.lit(None).cast(REASON)
    reasons = F.array(
        reason("name_vector", vector, w["name_vector"], F.concat(F.lit("Vector similarity: "), _text(vector))),
        reason("name_trigram", lexical, w["name_trigram"], F.concat(F.lit("Trigram similarity: "), _text(lexical))),
        F.when(alias > 0, reason("alias_match", alias, w["alias_match"], F.concat(F.lit("Alias match: "), F.col("alias_name")), F.col("alias_name"))).otherwise(none),
        F.when(has_dob, reason("dob_match", dob, w["dob_match"], dob_text)).otherwise(none),
        F.when(has_country, reason("country_match", country, w["country_match"], country_text)).otherwise(none),
        reason("entity_type_match", F.coalesce(same, F.lit(False)).cast("double"), 0.0, type_text),
    )
    total = vector * F.lit(w["name_vector"]) + lexical * F.lit(w["name_trigram"]) + alias * F.lit(w["alias_match"]) + dob * F.lit(w["dob_match"]) + country * F.lit(w["country_match"])
    scored = pairs.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return scored.withColumn("summary", summary(F.col("score"), vector, lexical, alias, dob, country))


def summary(score: Column, vector: Column, lexical: Column, alias: Column, dob: Column, country: Column) -> Column:
    parts = F.concat_ws(
        ", ",
        F.when(vector > STRONG_SIMILARITY, "strong vector similarity"),
        F.when(lexical > STRONG_SIMILARITY, "strong name match"),
        F.when(alias > 0, "alias match"),
        F.when(dob >= DOB_MENTIONED, "DOB match"),
        F.when(country > 0, "country match"),
    )
    return F.when(parts != "", F.concat(F.lit("Match due to: "), parts)).otherwise(F.concat(F.lit("Low confidence match (score: "), _text(score), F.lit(")")))
