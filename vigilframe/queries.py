"""Registered queries of the engine and the SQL that gives the same rows.

Each runs an operator over whole tables. Tables stand in for the engine's own: parts and suppliers for names,
documents for list entries, benchmark for screened names, embeddings for vectors, orders for matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.config import TITLES
from vigilframe.functions import hashing, text, vectors
from vigilframe.operators import blocking, customers, evaluate, gates, integrity, ledger, scoring, screen, vector_search
from vigilframe.sources import feeds, sinks
from vigilframe.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- vectors ---------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return _rows(spark, d).where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vector")


DOT = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
TOPK = f"""
WITH pairs AS (SELECT q.vec_id AS qid, e.vec_id AS id, q.label AS ql, e.label AS el, round({DOT}, 6) AS cosine FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM pairs)
"""


@query(TOPK + "SELECT qid, id, cosine, rank::BIGINT AS rank FROM ranked WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.topk_exact(_asked(spark, d), _rows(spark, d), 10).select("qid", "id", "cosine", F.col("rank").cast("long").alias("rank"))


@query(
    TOPK
    + """, hits AS (SELECT qid, min(rank) AS rank FROM ranked WHERE rank <= 26 AND id <> qid AND el = ql GROUP BY qid),
    q AS (SELECT vec_id AS qid, hits.rank FROM embeddings LEFT JOIN hits ON qid = vec_id WHERE vec_id % 20 = 0)
    SELECT k::INTEGER AS k, count(*)::BIGINT AS n, count(*) FILTER (WHERE rank <= k)::BIGINT AS hits, round(count(*) FILTER (WHERE rank <= k)::DOUBLE / count(*), 6) AS recall,
      count(*) FILTER (WHERE rank IS NULL)::BIGINT AS absent, round(count(*) FILTER (WHERE rank IS NULL)::DOUBLE / count(*), 6) AS absent_rate
    FROM q, (VALUES (2), (11), (26)) v(k) GROUP BY k"""
)
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    top = vector_search.topk_exact(_asked(spark, d), _rows(spark, d), 26).where("id <> qid").join(labels, "id")
    same = top.join(labels.select(F.col("id").alias("qid"), F.col("label").alias("want")), "qid").where(F.col("label") == F.col("want")).groupBy("qid").agg(F.min("rank").alias("rank"))
    ranks = _asked(spark, d).select("qid").join(same, "qid", "left")
    return evaluate.recall_at(ranks, [2, 11, 26]).select("k", "n", "hits", F.round("recall", 6).alias("recall"), "absent", F.round("absent_rate", 6).alias("absent_rate"))


@query("SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    pairs = rows.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("vector").alias("query_vector")).join(rows.select("id"), "id", "left_semi")
    return vector_search.similarity_of(pairs, rows).select("id", "other", F.round("cosine", 6).alias("cosine"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3)) / sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = vectors.normalize(F.transform("vector", lambda x: x.cast("double") * 3))
    return _rows(spark, d).select("id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- text ------------------------------------------------------------------------------------------------------

TITLES_SQL = "(" + ", ".join(f"'{t}'" for t in TITLES) + ")"


@query(
    f"""WITH n AS (SELECT 'p' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 's', s_suppkey, s_name FROM supplier UNION ALL SELECT 'c', c_custkey, c_name FROM customer UNION ALL SELECT 'n', n_nationkey, n_name FROM nation)
    SELECT kind, id::BIGINT AS id, array_to_string(list_filter(regexp_split_to_array(trim(lower(regexp_replace(name, '[^A-Za-z0-9_\\s-]', '', 'g'))), '\\s+'), lambda w: w <> '' AND w NOT IN {TITLES_SQL}), ' ') AS canonical FROM n"""
)
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    named = [("p", "part", "p_partkey", "p_name"), ("s", "supplier", "s_suppkey", "s_name"), ("c", "customer", "c_custkey", "c_name"), ("n", "nation", "n_nationkey", "n_name")]
    out = None
    for kind, table, key, name in named:
        part = _t(spark, d, table).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), text.canonicalize_ascii(F.col(name)).alias("canonical"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(lower(regexp_replace(strip_accents(text), '[^\\pL\\pN_\\s-]', '', 'g'))), '\\s+'), lambda w: w <> '' AND w NOT IN {TITLES_SQL}), ' ')) AS canonical_md5 FROM documents"""
)
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.canonicalize(F.col("text"))).alias("canonical_md5"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m') ELSE NULL END AS dob FROM orders"""
)
def dob_normalize(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 6 == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 6 == 1, F.date_format(at, "dd MMM yyyy"))
        .when(F.col("o_orderkey") % 6 == 2, F.date_format(at, "d/M/yyyy"))
        .when(F.col("o_orderkey") % 6 == 3, F.concat(F.lit("circa "), F.date_format(at, "yyyy"), F.lit(" - "), F.lit("2050")))
        .when(F.col("o_orderkey") % 6 == 4, F.date_format(at, "MMMM yyyy"))
        .otherwise(F.lit("-0-"))
    )
    return _t(spark, d, "orders").select("o_orderkey", text.normalize_dob(spelled).alias("dob"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def import_dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(at, "M/d/yyyy")).otherwise(F.date_format(at, "'13/40/'yyyy"))
    return _t(spark, d, "orders").select("o_orderkey", text.import_date(spelled).alias("day"))


@query("SELECT list_id, id, entity_number FROM (SELECT p_type AS list_id, p_type || ':' || p_partkey AS id, p_partkey::VARCHAR AS entity_number FROM part)")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "part").select(F.col("p_type").alias("list_id"), text.namespaced_id(F.col("p_type"), F.col("p_partkey").cast("string")).alias("id"))
    return ids.withColumn("entity_number", text.entity_number(F.col("id")))


@query("SELECT p_partkey, CASE WHEN v[1] IN ('=', '-', '+', '@') THEN chr(39) || v ELSE v END AS cell FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || p_name AS v FROM part)")
def spreadsheet_cells(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("p_partkey") % 3 == 0, "=").when(F.col("p_partkey") % 3 == 1, "-").otherwise("")
    return sinks.customers_sheet(_t(spark, d, "part").select("p_partkey", F.concat(mark, "p_name").alias("cell"))).select(F.col("p_partkey").cast("long").alias("p_partkey"), "cell")


# --- blocking --------------------------------------------------------------------------------------------------

TOKENS = r"""
e AS (SELECT source AS list_id, doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS key FROM documents),
sizes AS (SELECT source AS list_id, greatest(1, ceil(count(DISTINCT doc_id) * 0.01))::BIGINT AS cutoff FROM documents GROUP BY source),
dfs AS (SELECT list_id, key, count(*)::BIGINT AS df FROM e GROUP BY list_id, key),
live AS (SELECT dfs.* FROM dfs JOIN sizes USING (list_id) WHERE df <= cutoff)
"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("list_id"), F.regexp_replace(F.lower("text"), r"\s+", " ").alias("name_canonical"))


@query("WITH " + TOKENS + "SELECT list_id, count(*)::BIGINT AS keys, sum(df)::BIGINT AS postings, max(df)::BIGINT AS longest FROM live GROUP BY list_id")
def lexical_postings(spark: SparkSession, d: str) -> DataFrame:
    posted = blocking.postings(_entities(spark, d), phonetic=False, list_col="list_id")
    return posted.groupBy("list_id").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("postings"), F.max("df").alias("longest"))


@query(
    "WITH "
    + TOKENS
    + r""", q AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS key FROM benchmark)
    SELECT DISTINCT qid, list_id, id FROM q JOIN live USING (key) JOIN e USING (list_id, key)"""
)
def lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    posted = blocking.postings(_entities(spark, d), phonetic=False, list_col="list_id")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_replace(F.lower("text"), r"\s+", " ").alias("name_canonical"))
    return blocking.candidates(asked, posted, phonetic=False)


@query()
def phonetic_candidates(spark: SparkSession, d: str) -> DataFrame:
    named = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("list_id"), text.canonicalize_ascii(F.col("p_name")).alias("name_canonical"))
    posted = blocking.postings(named, ratio=0.5, list_col="list_id")
    asked = named.groupBy("name_canonical").agg(F.min("id").alias("qid"))
    return blocking.candidates(asked, posted, named)


@query()
def index_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.index_stats(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), text.canonicalize_ascii(F.col("p_name")).alias("name_canonical")))


# --- scoring ---------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Line items as pairs whose similarities are columns."""
    li = _t(spark, d, "lineitem")
    pairs = li.select(
        "l_orderkey", "l_linenumber", "l_linestatus", (F.col("l_discount") * 10).alias("vector_similarity"), (F.col("l_tax") * 12.5).alias("lexical_similarity"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0).alias("alias_score"), F.col("l_returnflag").alias("alias_name"),
        F.array(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("dob"), F.array(F.lit("us"), F.lower("l_linestatus")).alias("countries"), F.lit("PERSON").alias("entity_type"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("1995-"), F.date_format("l_shipdate", "MM-dd"))).alias("query_dob"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("O")).alias("query_country"), F.lit("person").alias("query_type"),
    )
    return scoring.compute_score(pairs, "balanced")


SCORED = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS v, l_tax * 12.5 AS x, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END AS a,
  CASE WHEN l_linenumber <= 2 THEN 0.0 WHEN year(l_shipdate) = 1995 THEN 1.0 ELSE 0.0 END AS dob,
  CASE WHEN l_linenumber % 2 = 0 AND l_linestatus = 'O' THEN 0.5 ELSE 0.0 END AS c, l_returnflag, l_linestatus FROM lineitem),
t AS (SELECT *, greatest(0.0, least(1.0, v * 0.55 + x * 0.2 + a * 0.35 + dob * 0.1 + c * 0.05)) AS score FROM s)
"""


@query(
    SCORED
    + """SELECT l_orderkey, l_linenumber, round(score, 6) AS score,
    (3 + (a > 0)::INT + (l_linenumber > 2)::INT + (l_linenumber % 2 = 0)::INT)::INTEGER AS n_reasons,
    CASE WHEN len(parts) > 0 THEN 'Match due to: ' || array_to_string(parts, ', ') ELSE 'low' END AS summary FROM (
      SELECT *, list_filter([CASE WHEN round(v, 9) > 0.8 THEN 'strong vector similarity' END, CASE WHEN round(x, 9) > 0.8 THEN 'strong name match' END, CASE WHEN a > 0 THEN 'alias match' END, CASE WHEN dob >= 0.5 THEN 'DOB match' END, CASE WHEN c > 0 THEN 'country match' END], lambda p: p IS NOT NULL) AS parts FROM t)"""
)
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    summary = F.when(F.col("summary").startswith("Low"), "low").otherwise(F.col("summary"))
    return _scored(spark, d).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), F.size("reasons").alias("n_reasons"), summary.alias("summary"))


@query(SCORED + "SELECT CASE WHEN score >= 0.8 THEN 'STRONG' WHEN score >= 0.65 THEN 'POSSIBLE' ELSE 'WEAK' END AS tier, count(*)::BIGINT AS n FROM (SELECT round(score, 9) AS score FROM t) GROUP BY tier")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(gates.classify_tier(F.round("score", 9), F.lit(0.65)).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


GATED = SCORED + ", f AS (SELECT l_orderkey, l_linenumber, round(score, 9) AS s, round(x, 9) AS lx, l_linestatus = 'F' AS tc FROM t)"


@query(
    GATED
    + """SELECT level, count(*) FILTER (WHERE kept)::BIGINT AS kept, count(*) FILTER (WHERE kept AND s >= shown)::BIGINT AS "primary" FROM (
    SELECT *, s >= floor AND (lx >= lexical OR tc) AS kept FROM f, (VALUES ('lenient', 0.3, 0.0, 0.0), ('balanced', 0.3, 0.35, 0.4), ('strict', 0.4, 0.5, 0.0)) v(level, floor, lexical, shown)) GROUP BY level"""
)
def strictness_levels(spark: SparkSession, d: str) -> DataFrame:
    facts = _scored(spark, d).withColumn("tc", F.col("l_linestatus") == "F").select(F.round("score", 9).alias("s"), F.round("lexical_similarity", 9).alias("lx"), "tc")
    kept, primary = gates.verdicts(F.col("s"), F.col("lx"), F.col("tc"))
    spread = facts.select(kept.alias("k"), primary.alias("p")).select(F.explode(F.array(F.lit("lenient"), F.lit("balanced"), F.lit("strict"))).alias("level"), "k", "p")
    return spread.groupBy("level").agg(F.count_if(F.array_contains("k", F.col("level"))).alias("kept"), F.count_if(F.array_contains("p", F.col("level"))).alias("primary"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_mktsegment").alias("qid"), F.col("n_name").alias("list_id"), F.col("c_custkey").alias("id"), F.round(F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000), 6).alias("score"), F.concat(F.lit("v"), F.col("n_regionkey")).alias("list_version"))


MATCHED = "m AS (SELECT c_mktsegment AS qid, n_name AS list_id, c_custkey AS id, round(greatest(0.0, c_acctbal / 10000), 6) AS score, 'v' || n_regionkey AS list_version FROM customer JOIN nation ON c_nationkey = n_nationkey)"
FLOORED = f"WITH {MATCHED}, kept AS (SELECT * FROM m WHERE score >= CASE WHEN list_id = (SELECT min(n_name) FROM nation) THEN 0.9 WHEN qid = 'BUILDING' THEN 0.2 ELSE 0.55 END), l AS (SELECT *, row_number() OVER (PARTITION BY qid, list_id ORDER BY score DESC, id) AS list_rank FROM kept)"


def _floored(spark: SparkSession, d: str) -> DataFrame:
    first = _t(spark, d, "nation").agg(F.min("n_name")).first()[0]
    own = F.when(F.col("qid") == "BUILDING", 0.2)
    return _matches(spark, d).where(F.col("score") >= screen.list_threshold(F.col("list_id"), {first: 0.9}, own, 0.55))


@query(FLOORED + "SELECT qid, list_id, id, score, list_rank::INTEGER AS list_rank FROM l WHERE list_rank <= 5")
def topk_per_list(spark: SparkSession, d: str) -> DataFrame:
    return screen.top_per_list(_floored(spark, d), 5).select("qid", "list_id", "id", "score", "list_rank")


MERGED = FLOORED + ", g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, list_id, list_rank) AS rank FROM l WHERE list_rank <= 5)"


@query(MERGED + "SELECT qid, list_id, id, score, rank::INTEGER AS rank FROM g WHERE rank <= 20")
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    return screen.merge_lists(screen.top_per_list(_floored(spark, d), 5), 20).select("qid", "list_id", "id", "score", "rank")


@query(MERGED + "SELECT qid, string_agg(list_id || '@' || list_version, '|' ORDER BY list_id) AS watchlist_version FROM (SELECT DISTINCT qid, list_id, list_version FROM g WHERE rank <= 20) GROUP BY qid")
def versions_used(spark: SparkSession, d: str) -> DataFrame:
    return screen.versions_used(screen.merge_lists(screen.top_per_list(_floored(spark, d), 5), 20)).select("qid", "watchlist_version")


@query(
    TOPK
    + """, v AS (SELECT qid, id, cosine FROM ranked WHERE rank <= 10), k AS (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0)
    SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.id, k.id) AS id, v.cosine FROM v FULL JOIN k ON v.qid = k.qid AND v.id = k.id"""
)
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    near = vector_search.topk_exact(_asked(spark, d), _rows(spark, d), 10).withColumn("list_id", F.lit("all"))
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    keyed = labels.join(labels.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "label"), "label").select("qid", F.lit("all").alias("list_id"), "id")
    return screen.retrieve(near, keyed).select("qid", "id", "cosine")


def _screen(spark: SparkSession, d: str) -> DataFrame:
    """Parts as list entries, each with one of the embeddings as its vector, asked for by the parts whose id is divisible by 20."""
    rows = _rows(spark, d)
    n = rows.count()
    entries = _t(spark, d, "part")
    v = entries.join(rows.withColumnRenamed("id", "__v"), F.pmod("p_partkey", F.lit(n)) == F.col("__v")).select(F.col("p_partkey").alias("id"), "vector")
    entities = entries.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("list_id"), F.lit("v1").alias("list_version"), F.lit("PERSON").alias("entity_type"), F.col("p_name").alias("primary_name"), text.canonicalize_ascii(F.col("p_name")).alias("name_canonical"),
        F.array(F.struct(F.col("p_brand").alias("name"), text.canonicalize_ascii(F.col("p_brand")).alias("name_canonical"))).alias("aliases"), F.array(F.concat(F.lit("19"), F.lpad((F.col("p_size") + 40).cast("string"), 2, "0"))).alias("dob"), F.array(F.lit("US")).alias("countries"),
    )
    asked = v.where(F.col("id") % 20 == 0).join(entries.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id").select(F.col("id").alias("qid"), "name", "vector", F.lit("1950-01-01").alias("dob"), F.lit("us").alias("country"))
    return screen.screen(asked, entities, v, preset="lenient", k=10)


@query()
def screen_names(spark: SparkSession, d: str) -> DataFrame:
    return _screen(spark, d).select("qid", F.col("rank").cast("int").alias("rank"), "list_id", "id", F.round("score", 6).alias("score"), "tier", "summary")


@query()
def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select(text.canonicalize_ascii(F.col("p_name")).alias("a")).distinct()
    brands = _t(spark, d, "supplier").select(text.canonicalize_ascii(F.col("s_name")).alias("b")).distinct()
    first = Window.orderBy("a")
    keyed = names.withColumn("b", F.coalesce(F.lead("a").over(first), F.lit(""))).unionByName(brands.select(F.col("b").alias("a"), "b"))
    return evaluate.pair_study(keyed.withColumn("label", F.lit(1)))


# --- ledger ----------------------------------------------------------------------------------------------------


def _prior_next(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders of the customers as matches, before and from the middle of 1995 on: the entity is the priority, the newest total its fingerprint."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderpriority").alias("entity_id"), "o_totalprice", "o_orderstatus", "o_orderkey", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp_ntz")

    def side(rows: DataFrame) -> DataFrame:
        newest = F.struct("o_orderdate", "o_orderkey")
        return rows.groupBy("customer_id", "entity_id").agg(F.max_by("o_orderstatus", newest).alias("fingerprint"), F.count("*").alias("n"), F.round(F.max("o_totalprice") / 500000, 6).alias("score"))

    return side(o.where(early)), side(o.where(~early))


SIDES = """
WITH o AS (SELECT o_custkey::VARCHAR AS customer_id, o_orderpriority AS entity_id, o_totalprice, o_orderstatus, o_orderkey, o_orderdate, o_orderdate < TIMESTAMP '1995-06-17' AS early FROM orders),
s AS (SELECT early, customer_id, entity_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS fingerprint, count(*) AS n, round(max(o_totalprice) / 500000, 6) AS score FROM o GROUP BY ALL),
p AS (SELECT customer_id, entity_id, CASE WHEN n > 1 THEN fingerprint END AS fp, CASE WHEN score > 0.5 THEN 'FALSE_POSITIVE' ELSE 'PENDING' END AS res FROM s WHERE early),
n AS (SELECT customer_id, entity_id, fingerprint AS fp FROM s WHERE NOT early)
"""
PLAN = (
    SIDES
    + """, plan AS (SELECT coalesce(p.customer_id, n.customer_id) AS customer_id, coalesce(p.entity_id, n.entity_id) AS entity_id, p.res,
  CASE WHEN n.customer_id IS NULL THEN 'SUPPRESSED' WHEN p.customer_id IS NULL THEN 'DETECTED' WHEN p.fp IS NULL THEN 'ADOPTED' WHEN p.fp = n.fp THEN 'KEPT' ELSE 'CHANGED' END AS action
  FROM p FULL JOIN n ON p.customer_id = n.customer_id AND p.entity_id = n.entity_id)
"""
)


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    prior, after = _prior_next(spark, d)
    matches = prior.select(
        ledger.make_id(F.lit("m"), "customer_id", "entity_id").alias("match_id"), "customer_id", "entity_id", "score", F.lit("POSSIBLE").alias("tier"), F.when(F.col("n") > 1, F.col("fingerprint")).alias("fingerprint"),
        F.when(F.col("score") > 0.5, "FALSE_POSITIVE").otherwise("PENDING").alias("resolution"), F.lit("CURRENT").alias("review_state"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("notes"), F.lit("t0").alias("at"),
    )
    return matches, spark.createDataFrame([], ledger.EVENTS), after.select("customer_id", "entity_id", "score", F.lit("POSSIBLE").alias("tier"), "fingerprint")


@query(PLAN + "SELECT customer_id, entity_id, action, CASE action WHEN 'DETECTED' THEN 'PENDING' WHEN 'SUPPRESSED' THEN NULL ELSE res END AS resolution, CASE action WHEN 'CHANGED' THEN 'CHANGED' WHEN 'SUPPRESSED' THEN NULL ELSE 'CURRENT' END AS review_state FROM plan")
def replacement_plan(spark: SparkSession, d: str) -> DataFrame:
    matches, _, after = _ledger(spark, d)
    return ledger.plan_replacement(matches, after).drop("p_res")


def _customer_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("customer_id")).distinct()


@query(PLAN + "SELECT action AS type, res AS from_status, CASE action WHEN 'DETECTED' THEN 'PENDING' WHEN 'CHANGED' THEN res END AS to_status, count(*)::BIGINT AS n FROM plan WHERE action IN ('DETECTED', 'CHANGED', 'SUPPRESSED') GROUP BY ALL")
def replacement_events(spark: SparkSession, d: str) -> DataFrame:
    matches, events, after = _ledger(spark, d)
    _, logged = ledger.replace_matches(matches, events, after, _customer_ids(spark, d), "t1")
    return logged.groupBy("type", "from_status", "to_status").agg(F.count("*").alias("n"))


@query(
    SIDES
    + """SELECT resolution, review_state, count(*)::BIGINT AS n, count(DISTINCT (customer_id, entity_id))::BIGINT AS ids FROM (
    SELECT coalesce(p.customer_id, n.customer_id) AS customer_id, coalesce(p.entity_id, n.entity_id) AS entity_id, CASE WHEN n.customer_id IS NOT NULL THEN 'PENDING' ELSE p.res END AS resolution, 'CURRENT' AS review_state
    FROM p FULL JOIN n ON p.customer_id = n.customer_id AND p.entity_id = n.entity_id) GROUP BY ALL"""
)
def upserted_matches(spark: SparkSession, d: str) -> DataFrame:
    matches, events, after = _ledger(spark, d)
    merged, _ = ledger.record_matches(matches, events, after, "t1")
    return merged.groupBy("resolution", "review_state").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("ids"))


@query(SIDES + "SELECT CASE WHEN fp IS NULL THEN 'RESOLVED' ELSE res END AS resolution, res AS before, count(*)::BIGINT AS n FROM p GROUP BY ALL")
def resolved_matches(spark: SparkSession, d: str) -> DataFrame:
    matches, events, _ = _ledger(spark, d)
    decisions = matches.where("fingerprint is null").select("match_id", F.lit("RESOLVED").alias("decision"), F.lit(None).cast("string").alias("reviewer"), F.lit("checked").alias("notes"))
    after, _ = ledger.resolve_matches(matches, events, decisions, "t1")
    return after.join(matches.select("match_id", F.col("resolution").alias("before")), "match_id").groupBy("resolution", "before").agg(F.count("*").alias("n"))


@query(SIDES + "SELECT count(*)::BIGINT AS n FROM p WHERE customer_id NOT IN (SELECT customer_id FROM s WHERE NOT early)")
def deleted_customers(spark: SparkSession, d: str) -> DataFrame:
    matches, events, after = _ledger(spark, d)
    _, left, _ = ledger.delete_customers(_customer_ids(spark, d), matches, events, after)
    return left.agg(F.count("*").alias("n"))


@query(SIDES + "SELECT p.customer_id, p.entity_id, score, c_name AS name FROM p JOIN s ON s.early AND s.customer_id = p.customer_id AND s.entity_id = p.entity_id JOIN customer ON c_custkey::VARCHAR = p.customer_id WHERE p.res = 'PENDING' ORDER BY score DESC, p.customer_id, p.entity_id LIMIT 100")
def review_board(spark: SparkSession, d: str) -> DataFrame:
    matches, _, _ = _ledger(spark, d)
    who = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_name").alias("reference"), F.lit("US").alias("country"))
    readable = matches.withColumn("match_id", F.concat_ws("\x01", "customer_id", "entity_id"))
    return ledger.review_board(readable, who, resolution="PENDING", needs_review=True).select("customer_id", "entity_id", "score", "name")


@query(SIDES + "SELECT count(*) FILTER (WHERE p.customer_id IS NULL)::BIGINT AS new_hits, count(*) FILTER (WHERE n.customer_id IS NULL)::BIGINT AS cleared, count(*) FILTER (WHERE p.customer_id = n.customer_id)::BIGINT AS kept FROM p FULL JOIN n ON p.customer_id = n.customer_id AND p.entity_id = n.entity_id")
def rescan_summary(spark: SparkSession, d: str) -> DataFrame:
    return incremental.rescan_summary(*_prior_next(spark, d))


@query("SELECT key, value FROM (SELECT n_name AS key, 'nation' AS value FROM nation WHERE n_name NOT IN (SELECT r_name FROM region) UNION ALL SELECT r_name, 'region' FROM region)")
def settings_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _t(spark, d, "nation").select(F.col("n_name").alias("key"), F.lit("nation").alias("value"))
    return ledger.put_settings(old, _t(spark, d, "region").select(F.col("r_name").alias("key"), F.lit("region").alias("value")))


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN ref IN (SELECT upper(trim(c_name)) FROM customer WHERE c_acctbal < 0) THEN 'existing' WHEN row_number() OVER (PARTITION BY ref ORDER BY ordinal) > 1 THEN 'duplicate' ELSE 'new' END AS status FROM (SELECT upper(trim(c_name)) AS ref, o_orderkey AS ordinal FROM orders JOIN customer ON o_custkey = c_custkey)) GROUP BY status")
def import_preview(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    rows = _t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit(" "), F.lower("c_name")).alias("reference"), F.col("c_name").alias("name"))
    known = c.where("c_acctbal < 0").select(F.col("c_name").alias("reference"))
    return customers.preview(customers.validate(rows).where(F.size("errors") == 0), known).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'country' ELSE '' END AS fields, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def import_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("reference"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Utopia").otherwise("de").alias("country"), F.lit("12/31/1999").alias("dob"))
    checked = customers.validate(rows).select(F.concat_ws(",", F.transform("errors", lambda e: e["field"])).alias("fields"))
    return checked.groupBy("fields").agg(F.count("*").alias("n"))


# --- feeds, integrity --------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) AS k FROM orders)
    SELECT o_custkey, max(o_orderkey) FILTER (WHERE k = 1) AS first_key, (count(*) - 1)::BIGINT AS aliases, coalesce(string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) FILTER (WHERE k > 1), '') AS others FROM o GROUP BY o_custkey"""
)
def group_fold(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") != "1-URGENT").alias("later"))
    folded = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("later", "o_orderkey")).alias("first_key"), F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    rest = F.filter("keys", lambda k: k != F.col("first_key"))
    return folded.select("o_custkey", "first_key", F.size(rest).cast("long").alias("aliases"), F.concat_ws(";", F.transform(rest, lambda k: k.cast("string"))).alias("others"))


@query("SELECT p_type || ':' || s_suppkey AS entity_id, (1 + (p_brand IS NOT NULL AND lower(p_brand) <> lower(s_name))::INT)::INTEGER AS n FROM supplier JOIN (SELECT p_partkey, p_type, p_brand FROM part) ON p_partkey = s_suppkey")
def alias_enrichment(spark: SparkSession, d: str) -> DataFrame:
    s, p = _t(spark, d, "supplier"), _t(spark, d, "part")
    both = s.join(p, F.col("s_suppkey") == F.col("p_partkey"))
    lines = both.select(F.concat_ws(":", "p_type", "s_suppkey").alias("entity_id"), F.col("s_name").alias("primary_name"), F.array(F.struct(F.lower("s_name").alias("name"))).alias("aliases"))
    extra = both.select(F.col("s_suppkey").cast("string").alias("number"), F.explode(F.array(F.upper("s_name"), F.col("p_brand"))).alias("name"))
    return feeds.apply_alias_enrichment(lines, extra).select("entity_id", F.size("aliases").alias("n"))


def _chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"), F.octet_length(F.col("text")).cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
    files = docs.groupBy(F.col("source").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "hash", "size"))), lambda x: F.struct(x["hash"].alias("hash"), x["size"].alias("size"))).alias("chunks"))
    chunks = integrity.chunk_table(files.withColumn("sha256", F.lit(None).cast("string")))
    store = docs.where("doc_id % 3 <> 0").groupBy("hash").agg(F.first("content").alias("content"))
    return chunks, store


@query("SELECT count(*)::BIGINT AS chunks, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT text, strlen(text) AS size FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 <> 0))")
def chunk_delta(spark: SparkSession, d: str) -> DataFrame:
    return integrity.needed_bytes(*_chunks(spark, d))


@query("SELECT sha256(text) AS hash, 'missing' AS problem FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 <> 0))")
def chunk_verify(spark: SparkSession, d: str) -> DataFrame:
    return integrity.verify_chunks(*_chunks(spark, d))


@query("SELECT o_orderkey::VARCHAR AS list_id, floor(epoch(TIMESTAMP '1998-01-01' - o_orderdate) / 86400)::BIGINT AS age_days, CASE WHEN epoch(TIMESTAMP '1998-01-01' - o_orderdate) / 86400 > 90 THEN 'too old' WHEN epoch(TIMESTAMP '1998-01-01' - o_orderdate) / 86400 < -1 THEN 'in the future' ELSE '' END AS breaches FROM orders")
def list_freshness(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    catalog = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("list_id"), F.when(F.col("o_orderkey") % 2 == 0, at).alias("fetched_at"), at.alias("generated_at"), F.lit(False).alias("stale"))
    return integrity.freshness(catalog, "1998-01-01T00:00:00Z").withColumn("breaches", F.concat_ws(",", "breaches"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS tag FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", hashing.sha256_tag(F.col("text")).alias("tag"))


# --- evaluation, events ------------------------------------------------------------------------------------------


@query("SELECT canonical, string_agg(id::VARCHAR, ',' ORDER BY id) AS owners FROM (SELECT DISTINCT p_partkey AS id, lower(p_name) AS canonical FROM part) GROUP BY canonical")
def owner_index(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("canonical"))
    return evaluate.owner_index(names).select("canonical", F.concat_ws(",", F.transform("owners", lambda o: o.cast("string"))).alias("owners"))


@query("WITH n AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS canonical, 'canonical' AS kind FROM part UNION ALL SELECT p_partkey, p_brand, lower(p_brand), 'alias' FROM part) SELECT kind, canonical, arg_min(name, id) AS query, (SELECT count(DISTINCT m.id) FROM n m WHERE m.canonical = n.canonical)::BIGINT AS expected FROM n GROUP BY kind, canonical")
def labelled_queries(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    own = F.lower("p_name").alias("own")
    names = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), F.lower("p_name").alias("canonical"), F.lit("canonical").alias("kind"), own)
    names = names.unionByName(p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("name"), F.lower("p_brand").alias("canonical"), F.lit("alias").alias("kind"), own))
    return evaluate.labelled_queries(names).select("kind", "canonical", "query", F.size("expected").cast("long").alias("expected"))


CELLS = """
WITH c AS (SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS segment, toxic = 1 AS truth, quality = 1 AS k1 FROM labels),
x AS (SELECT segment, truth, k1 AS alerted FROM c UNION ALL SELECT 'all', truth, k1 FROM c)
"""


@query(
    CELLS
    + """SELECT segment, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE truth AND alerted)::DOUBLE / count(*) FILTER (WHERE alerted), 6) AS "precision", round(count(*) FILTER (WHERE truth AND alerted)::DOUBLE / count(*) FILTER (WHERE truth), 6) AS recall,
    round(count(*) FILTER (WHERE truth = alerted)::DOUBLE / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE NOT truth AND alerted)::DOUBLE / count(*) FILTER (WHERE NOT truth), 6) AS fpr FROM x GROUP BY segment"""
)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    base = _t(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("half"), (F.col("toxic") == 1).alias("truth"), (F.col("quality") == 1).alias("alerted"))
    rows = base.select(F.explode(F.array(F.lit("all"), F.col("half"))).alias("segment"), "truth", "alerted")
    return evaluate.binary_report(rows, ["segment"]).select("segment", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("accuracy", 6).alias("accuracy"), F.round("fpr", 6).alias("fpr"))


@query(
    """WITH s AS (SELECT toxic = 1 AS truth, n_chars AS score FROM labels JOIN documents USING (doc_id)), r AS (SELECT truth, score, count(*) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING) AS le, count(*) OVER (PARTITION BY score) AS eq FROM s)
    SELECT round((sum(le - (eq - 1) / 2.0) FILTER (WHERE truth) - count(*) FILTER (WHERE truth) * (count(*) FILTER (WHERE truth) + 1) / 2.0) / (count(*) FILTER (WHERE truth) * count(*) FILTER (WHERE NOT truth)), 6)::DOUBLE AS roc_auc FROM r"""
)
def score_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("toxic") == 1).alias("truth"), F.col("n_chars").alias("score"))
    return evaluate.discrimination(rows, []).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("SELECT q.doc_id AS qid, q.doc_id + 1 AS id, NULL::INTEGER AS rank, 0.0::DOUBLE AS score FROM labels q WHERE q.doc_id + 1 NOT IN (SELECT doc_id FROM labels)")
def missing_expected(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select("doc_id")
    expected = labels.select(F.col("doc_id").alias("qid"), (F.col("doc_id") + 1).alias("id"))
    returned = labels.select((F.col("doc_id") - 1).alias("qid"), F.col("doc_id").alias("id"))
    return evaluate.missing_rows(expected, returned)


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select((F.col("c_custkey") - 1).alias("ordinal"), "c_name")
    return evaluate.sample_rows(c, "ordinal", c.count(), 100, 20260803)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return incremental.latest_state(_t(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(_t(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT source, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95 FROM documents GROUP BY source")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(_t(spark, d, "documents"), ["source"], "n_chars", {"p50": 0.5, "p95": 0.95})


