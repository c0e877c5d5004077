"""More registered queries: feeds, files, settings, text, evaluation runs, ledger and publishing, with their SQL.

Feeds and files are written from the tables into the shared folder first and read by the engine's readers, so each query holds a
reader against what SQL says about the tables themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import hashing, settings, text
from vigilframe.operators import evaluate, gates, integrity, ledger, screen, vector_search
from vigilframe.plans import dossier, origin, publish, recall, receipts, review
from vigilframe.queries import CELLS, SIDES, TOPK, _asked, _ledger, _matches, _rows, _t, query
from vigilframe.sources import feeds, files, sinks
from vigilframe.streaming import incremental


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/feeds-{uuid.uuid4().hex}"


def _xml(spark: SparkSession, elements: DataFrame) -> str:
    """Files with the elements (value), each file under one root."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
        yield line("<feed>")
        yield from batches
        yield line("</feed>")

    elements.mapInArrow(rooted, "value string").write.text(path := _folder(spark))
    return path


def _joined(column: str) -> F.Column:
    return F.concat_ws("|", column)


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select("entity_id", "primary_name", "entity_type", F.concat_ws("|", F.transform("aliases", lambda a: a["name"])).alias("aliases"), _joined("dob").alias("dob"), _joined("countries").alias("countries"), "source_list")


# --- feeds -----------------------------------------------------------------------------------------------------


@query(
    """SELECT 'OFAC_SDN:' || c_custkey AS entity_id, c_name || ', "Jr"' AS primary_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, 'A|' || c_mktsegment AS aliases,
    '10 Dec 1948|1950' AS dob, n_name || '|XX' AS countries, 'OFAC_SDN' AS source_list FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0"""
)
def csl_feed(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(
        F.when(F.col("c_custkey") % 3 == 0, "Entity List (EL)").otherwise(feeds.CSL_SDN).alias("source"), F.col("c_custkey").alias("entity_number"), F.when(F.col("c_mktsegment") == "BUILDING", "Individual").otherwise("Entity").alias("type"),
        F.concat("c_name", F.lit(', "Jr"')).alias("name"), F.concat(F.lit("A; "), "c_mktsegment", F.lit(";;A")).alias("alt_names"), F.lit("10 Dec 1948; 1950").alias("dates_of_birth"), F.col("n_name").alias("citizenships"), F.concat("n_name", F.lit("; XX")).alias("nationalities"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path := _folder(spark))
    return _lines(feeds.read_csl(spark, path, "v1"))


@query(
    """SELECT 'UK_OFSI:' || s_suppkey AS entity_id, 'Alpha ' || s_name AS primary_name, CASE WHEN s_nationkey % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, 'Beta ' || s_name || '|' || s_name AS aliases,
    '12/04/1980' AS dob, s_nationkey::VARCHAR AS countries, 'UK_OFSI' AS source_list FROM supplier"""
)
def ofsi_feed(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    kind = F.when(F.col("s_nationkey") % 2 == 0, "Individual").otherwise("Entity")
    spelled = [("Beta", "01/01/1970", "AKA"), ("Alpha", "12/04/1980", "Primary name"), ("", "", "AKA")]
    rows = s.select("s_suppkey", F.posexplode(F.array(*[F.concat_ws(",", F.col("s_name"), F.lit(f'"{first}"'), F.lit(dob), F.col("s_nationkey"), kind, F.lit(alias), F.col("s_suppkey")) for first, dob, alias in spelled])).alias("k", "value"))
    head = spark.createDataFrame([(-2, 0, "Last Updated,03/06/2026"), (-1, 0, ""), (-1, 1, "Name 6,Name 1,DOB,Nationality,Group Type,Alias Type,Group ID")], "at long, k int, value string")
    # the feed is one file whose lines are in order
    head.unionByName(rows.select(F.col("s_suppkey").alias("at"), "k", "value")).coalesce(1).sortWithinPartitions("at", "k").select("value").write.text(path := _folder(spark))
    return _lines(feeds.read_ofsi(spark, path, "v1"))


@query(
    """SELECT 'EU:' || s_suppkey AS entity_id, 'Max ' || s_name AS primary_name, CASE WHEN s_suppkey % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, s_name || ' & Co' AS aliases,
    CASE WHEN s_suppkey % 2 = 0 THEN '1972-06-15' ELSE '1972' END AS dob, CASE WHEN n_name = 'BY' THEN 'BY' WHEN n_name < 'BY' THEN n_name || '|BY' ELSE 'BY|' || n_name END AS countries, 'EU' AS source_list FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def eu_feed(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    even = F.col("s_suppkey") % 2 == 0
    element = F.concat(
        F.lit('<sanctionEntity logicalId="'), "s_suppkey", F.lit('"><subjectType code="'), F.when(even, "person").otherwise("enterprise"), F.lit('"/><nameAlias wholeName=""/><nameAlias firstName="Max" lastName="'), "s_name", F.lit('" wholeName=""/><nameAlias wholeName="'), "s_name",
        F.lit(' &amp; Co"/><birthdate birthdate="'), F.when(even, "1972-06-15").otherwise(""), F.lit('" year="1972"/><citizenship countryIso2Code="'), "n_name", F.lit('"/><address countryIso2Code="BY"/><address countryIso2Code="'), "n_name", F.lit('"/></sanctionEntity>'),
    )
    return _lines(feeds.read_eu(spark, _xml(spark, s.select(element.alias("value"))), "v1"))


@query(
    """SELECT 'UN:' || c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' Al-F' ELSE c_name END AS primary_name, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, c_mktsegment AS aliases,
    CASE WHEN c_custkey % 2 = 1 THEN '' WHEN c_custkey % 4 = 0 THEN '1965-08-01' ELSE '1964' END AS dob, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '' END AS countries, 'UN' AS source_list FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def un_feed(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    date = F.when(F.col("c_custkey") % 4 == 0, "<INDIVIDUAL_DATE_OF_BIRTH><DATE>1965-08-01</DATE></INDIVIDUAL_DATE_OF_BIRTH>").otherwise("")
    person = F.concat(
        F.lit("<INDIVIDUAL><DATAID>"), "c_custkey", F.lit("</DATAID><FIRST_NAME>"), "c_name", F.lit("</FIRST_NAME><SECOND_NAME>Al-F</SECOND_NAME><NATIONALITY><VALUE>"), "n_name", F.lit("</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><QUALITY>Good</QUALITY><ALIAS_NAME>"), "c_mktsegment",
        F.lit("</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><YEAR>1964</YEAR></INDIVIDUAL_DATE_OF_BIRTH>"), date, F.lit("</INDIVIDUAL>"),
    )
    other = F.concat(F.lit("<ENTITY><DATAID>"), "c_custkey", F.lit("</DATAID><FIRST_NAME>"), "c_name", F.lit("</FIRST_NAME><ENTITY_ALIAS><ALIAS_NAME>"), "c_mktsegment", F.lit("</ALIAS_NAME></ENTITY_ALIAS></ENTITY>"))
    path = _xml(spark, c.select(F.when(F.col("c_custkey") % 2 == 0, person).otherwise(other).alias("value")))
    return _lines(feeds.read_un(spark, path, "v1"))


def _parties(spark: SparkSession, d: str) -> str:
    """Parties with a Latin, a Cyrillic and an unexplained name, and the scripts."""
    part = lambda script, name: F.concat(F.lit(f'<Alias><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="{script}">'), name, F.lit("</NamePartValue></DocumentedNamePart></DocumentedName></Alias>"))
    s = _t(spark, d, "supplier")
    known = F.when(F.col("s_suppkey") % 2 == 0, part(220, F.concat(F.lit("Имя "), "s_suppkey"))).otherwise(part(999, F.concat(F.lit("X"), "s_suppkey")))
    party = F.concat(F.lit('<DistinctParty FixedRef="'), "s_suppkey", F.lit('"><Profile><Identity>'), part(215, F.col("s_name")), known, known, F.lit("</Identity></Profile></DistinctParty>"))
    scripts = spark.createDataFrame([('<Script ID="215">Latin</Script>',), ('<Script ID="220">Cyrillic</Script>',)], "value string")
    return _xml(spark, scripts.unionByName(s.select(party.alias("value"))))


@query("SELECT s_suppkey::VARCHAR AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'Имя ' ELSE 'X' END || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Cyrillic' ELSE 'Unknown' END AS script FROM supplier")
def script_aliases(spark: SparkSession, d: str) -> DataFrame:
    return feeds.read_script_aliases(spark, _parties(spark, d))


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Cyrillic' ELSE 'Unknown' END AS script, count(*)::BIGINT AS n FROM supplier GROUP BY ALL")
def script_histogram(spark: SparkSession, d: str) -> DataFrame:
    return feeds.script_histogram(feeds.read_script_aliases(spark, _parties(spark, d)))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE '20' || lpad(n_nationkey::VARCHAR, 2, '0') || '-06-0' || (1 + n_nationkey % 4) || 'T00:00:00.000Z' END AS ofsi,
    '20' || lpad(n_nationkey::VARCHAR, 2, '0') || '-05-01T10:00:00.000Z' AS eu, '20' || lpad(n_nationkey::VARCHAR, 2, '0') || '-11-06T08:49:37.000Z' AS http FROM nation"""
)
def feed_instants(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    year = F.concat(F.lit("20"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    line = F.when(F.col("n_nationkey") % 4 == 0, "Name 6,Name 1").otherwise(F.concat(F.lit("Last Updated, 0"), 1 + F.col("n_nationkey") % 4, F.lit("/06/"), year))
    head = F.concat(F.lit('<export generationDate="'), year, F.lit('-05-01T10:00:00Z" x="">'))
    http = F.concat(F.lit("Sun, 06 Nov "), year, F.lit(" 08:49:37 GMT"))
    return n.select("n_nationkey", text.ofsi_updated(line).alias("ofsi"), text.xml_updated(head, "generationDate").alias("eu"), text.http_updated(http).alias("http"))


# --- files -----------------------------------------------------------------------------------------------------


def _source_lines(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.concat(F.lit("L:"), "s_suppkey").alias("entity_id"), F.concat(F.lit("Dr. "), "s_name").alias("primary_name"), F.lit("ORGANIZATION").alias("entity_type"), F.array(F.struct(F.upper("n_name").alias("name"))).alias("aliases"),
        F.array(F.lit("not a date"), F.lit("10 Dec 1948"), F.lit("1950")).alias("dob"), F.array(F.col("n_name"), F.lit("AA"), F.col("n_name")).alias("countries"), F.lit("SANCTION").alias("risk_category"), F.when(F.col("s_suppkey") % 2 == 0, "L1").otherwise("L2").alias("source_list"), F.lit("v7").alias("list_version"),
    )


@query(
    """SELECT 'L:' || s_suppkey AS entity_id, replace(lower(s_name), '#', '') AS name_canonical, n_name AS aliases, '1948-12-10' AS dob, 'AA|' || n_name AS countries, 'SANCTION' AS risk_category, CASE WHEN s_suppkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS source_list, 'v7' AS list_version
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def published_entities(spark: SparkSession, d: str) -> DataFrame:
    _source_lines(spark, d).write.json(first := _folder(spark))
    files.to_wire(files.read_source_lines(spark, first)).write.json(path := _folder(spark))
    return files.read_entities(spark, path).withColumn("aliases", _joined("aliases")).withColumn("countries", _joined("countries"))


@query(
    """SELECT 'L:' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS list_id, 'PERSON' AS entity_type, 'Supplier' || substr(s_name, 10) AS primary_name, upper(n_name) || '=' || lower(n_name) AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def engine_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = files.from_wire(files.to_wire(_source_lines(spark, d)))
    return rows.select("entity_id", "list_id", "entity_type", "primary_name", F.concat_ws("=", F.element_at("aliases", 1)["name"], F.element_at("aliases", 1)["name_canonical"]).alias("alias"))


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS id, 'v7' AS version, count(*)::BIGINT AS n, '2026-01-01T00:00:00Z' AS \"fetchedAt\" FROM supplier GROUP BY ALL")
def list_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The bundle's own rows, counted, beside its catalog."""
    catalog = sinks.write_bundle(files.to_wire(_source_lines(spark, d)), path := _folder(spark), "2026-01-01T00:00:00Z")
    rows = spark.read.json(f"{path}/entities").groupBy(F.col("source_list").alias("id")).agg(F.count("*").alias("n"))
    return catalog.join(rows, "id").select("id", "version", "n", "fetchedAt")


@query("SELECT n_name AS list_id, CASE n_nationkey % 4 WHEN 0 THEN 'no meta' WHEN 1 THEN 'version' ELSE 'count' END AS problem FROM nation WHERE n_nationkey % 4 <> 3 AND (n_nationkey % 4 <> 2 OR (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) <> 1)")
def catalog_problems(spark: SparkSession, d: str) -> DataFrame:
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    entry = F.struct(F.col("n_name").alias("id"), F.lit("v1").alias("version"), F.col("n_nationkey").cast("long").alias("entitiesCount"))
    n.agg(F.collect_list(entry).alias("lists")).withColumn("generatedAt", F.lit("2026-01-01T00:00:00Z")).coalesce(1).write.json(path := _folder(spark))
    counts = s.groupBy("s_nationkey").agg(F.count("*").alias("held"))
    rows = F.when(F.col("n_nationkey") % 4 == 2, F.lit(1)).otherwise(F.coalesce("held", F.lit(0)))
    meta = n.where("n_nationkey % 4 <> 0").join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 4 == 1, "v0").otherwise("v1").alias("version"), rows.cast("long").alias("entitiesCount"))
    entities = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("list_id"))
    return files.check_catalog(files.read_catalog(spark, path), meta, entities)


@query("SELECT c_custkey::VARCHAR AS customerreference, CASE WHEN c_custkey % 2 = 0 THEN chr(39) || '=' ELSE '' END || c_name AS fullname FROM customer")
def customer_file(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("Customer_Reference"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "=").otherwise(""), "c_name").alias("Full Name"))
    sinks.write_customers(rows, path := _folder(spark))
    return files.read_customers(spark, path)


@query("SELECT doc_id::INTEGER AS id, CASE WHEN quality = 1 THEN 'kept' ELSE '' END AS kept, 0.5::DOUBLE AS score FROM labels")
def evidence_file(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("quality") == 1, F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>"))
    rows = _t(spark, d, "labels").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("alias").alias("segment"), F.lit("q").alias("query"), F.array(F.struct(F.lit("e").alias("entityId"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"), kept.alias("kept"))).alias("candidates"))).alias("value"))
    rows.unionByName(spark.createDataFrame([('{"kind":"header","schemaVersion":1}',), ("",)], "value string")).write.text(path := _folder(spark))
    _, read = files.read_evidence(spark, path)
    return read.select("id", F.concat_ws("|", F.element_at("candidates", 1)["kept"]).alias("kept"), F.element_at("candidates", 1)["score"].alias("score"))


@query("SELECT c_mktsegment AS script, c_custkey AS n, rpad(c_mktsegment, 12, ' ') || '  ' || rpad(c_custkey::VARCHAR, 6, ' ') AS line FROM customer")
def fixed_columns(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("script"), F.col("c_custkey").alias("n"))
    lines = sinks.text_table(c, {"script": 12, "n": 6})
    return lines.select(F.trim(F.substring("line", 1, 12)).alias("script"), F.trim(F.substring("line", 15, 6)).cast("long").alias("n"), "line")


# --- text and settings -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM part")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.display_name(F.lower("p_name")).alias("shown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS cell FROM customer")
def blank_cells(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("c_custkey") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("  ")))
    return _t(spark, d, "customer").select("c_custkey", text.blank_to_null(cell).alias("cell"))


@query("SELECT n_nationkey, n_name || ' <&> &lt; ' || chr(1040 + n_nationkey) || 'é' || chr(128512) || ' &#x;&#' AS decoded FROM nation")
def xml_entities(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("n_name", F.lit(" &lt;&amp;&gt; &amp;lt; &#"), 1040 + F.col("n_nationkey"), F.lit(";&#233;&#128512; &#x;&#"))
    return _t(spark, d, "nation").select("n_nationkey", text.decode_entities(raw).alias("decoded"))


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f kB', n / 1000.0) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1000000.0) ELSE printf('%.1f GB', n / 1000000000.0) END AS size FROM (SELECT o_orderkey, (o_orderkey * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 128 WHEN 2 THEN 131072 ELSE 16777216 END)::BIGINT AS n FROM orders)")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    n = F.col("o_orderkey") * F.when(k == 0, 1).when(k == 1, 128).when(k == 2, 131072).otherwise(16777216)
    return _t(spark, d, "orders").select("o_orderkey", text.format_bytes(n.cast("long")).alias("size"))


@query("SELECT o_orderkey, CASE WHEN s >= 86400 THEN s // 86400 || ' days' WHEN s >= 3600 THEN s // 3600 || ' hours' WHEN s >= 60 THEN s // 60 || ' minutes' ELSE 'now' END AS age FROM (SELECT o_orderkey, ((o_orderkey - 100) * 37)::BIGINT AS s FROM orders)")
def age_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", text.age_phrase((F.col("o_orderkey") - 100) * 37).alias("age"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE NULL END AS dob FROM orders")
def first_dobs(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raws = F.array(F.lit("-0-"), F.lit("1980-13-01"), F.when(k == 0, F.date_format(at, "d-M-yyyy")).when(k == 1, F.concat(F.lit("approx. "), F.date_format(at, "MMM yyyy"))).otherwise("32/04/1980"), F.when(k < 2, F.lit("1900")).otherwise("1700"))
    return _t(spark, d, "orders").select("o_orderkey", text.first_dob(raws).alias("dob"))


@query("""SELECT c_custkey, '{"a":["' || c_name || '",null,true],"b":{"x":' || c_custkey || ',"y":' || c_nationkey || '}}' AS json FROM customer""")
def canonical_jsons(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{ "b": {"y": '), "c_nationkey", F.lit('.0, "x":'), "c_custkey", F.lit('}, "a" : ["'), "c_name", F.lit('", null, true ] }'))
    return _t(spark, d, "customer").select("c_custkey", hashing.canonical_json_col(raw).alias("json"))


@query(
    """WITH j AS (SELECT c_custkey, '{"profile":{"name_canonical":"' || lower(c_name) || '","country":"us"},"entity":{"name_canonical":"' || lower(c_mktsegment) || '","aliases":["zz","é' || lower(c_name) || '"],"dob":[],"countries":["ca","us"]}}' AS body FROM customer)
    SELECT c_custkey, lpad(lower(hex(list_reduce(list_transform(string_split(body, ''), lambda c: (unicode(c) & 255)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT))), 8, '0') AS fingerprint FROM j"""
)
def fingerprints_of_matches(spark: SparkSession, d: str) -> DataFrame:
    made = hashing.material_fingerprint(F.concat(F.lit(" "), "c_name"), F.lit("US "), F.col("c_mktsegment"), F.array(F.lit("ZZ"), F.concat(F.lit("É"), "c_name")), F.lit(None).cast("array<string>"), F.array(F.lit("us"), F.lit("CA")))
    return _t(spark, d, "customer").select("c_custkey", made.alias("fingerprint"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'L1=strict' END AS presets, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE '0.75' END AS floors, CASE c_custkey % 2 WHEN 0 THEN 0.55 ELSE 0.65 END::DOUBLE AS other FROM customer")
def preset_settings(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 2, "{broken").otherwise('{"L1":"strict","L2":"bogus"}')
    overrides = settings.preset_overrides(raw)
    floors, other = settings.list_thresholds(F.col("o"), F.when(F.col("c_custkey") % 2 == 0, "lenient").otherwise("bogus"))
    rows = _t(spark, d, "customer").withColumn("o", overrides)
    return rows.select("c_custkey", F.concat_ws("|", F.transform(F.map_entries("o"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("presets"), F.concat_ws("|", F.transform(F.map_values(floors), lambda f: f.cast("string"))).alias("floors"), other.cast("double").alias("other"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A|B|C' WHEN 1 THEN 'B' WHEN 2 THEN 'A|B|C' ELSE '' END AS enabled, c_custkey % 4 = 1 AS same FROM customer")
def enabled_settings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    stored = settings.id_array(F.when(k == 0, "[1, 2]").when(k == 1, '["Z", "B"]').when(k == 2, "not json").otherwise("[]"))
    catalog = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    rows = _t(spark, d, "customer").withColumn("ids", stored)
    return rows.select("c_custkey", _joined(settings.enabled_ids(F.col("ids"), catalog)).alias("enabled"), F.coalesce(settings.same_ids(F.col("ids"), F.array(F.lit("B"), F.lit("Z"), F.lit("B"))), F.lit(False)).alias("same"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE -1 END::INTEGER AS n, c_custkey % 2 = 0 AS same FROM customer")
def customer_documents(spark: SparkSession, d: str) -> DataFrame:
    one = lambda country, expires: F.lit(f'{{"doc_type":"passport","number":"1","country":"{country}","expires":"{expires}"}}')
    k = F.col("c_custkey") % 3
    raw = F.concat(F.lit("["), F.when(k == 0, one("de", "2030-01-31")).when(k == 1, one("Germany", "2030-01-31")).otherwise(one("de", "2030-02-31")), F.lit(","), one("fr", "12/31/2031"), F.lit("]"))
    a, b = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(2), F.lit("x"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(3))
    read = settings.documents(raw)
    return _t(spark, d, "customer").select("c_custkey", F.coalesce(F.size(read), F.lit(-1)).alias("n"), settings.same_map(a, b).alias("same"))


# --- screening and evaluation --------------------------------------------------------------------------------------


@query("SELECT list_id, count(*)::BIGINT AS n FROM (SELECT n_name AS list_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY list_id")
def enabled_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists that are stored as enabled, in the catalog's order, and the matches of those lists."""
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ids = n.agg(F.array_sort(F.collect_list("n_name")).alias("catalog"), F.array_append(F.collect_list(F.when(F.col("r_name").isin("ASIA", "EUROPE"), F.col("n_name"))), F.lit("GONE")).alias("stored"))
    enabled = ids.select(F.explode(settings.enabled_ids(F.col("stored"), F.col("catalog"))).alias("list_id"))
    return _matches(spark, d).join(enabled, "list_id", "left_semi").groupBy("list_id").agg(F.count("*").alias("n"))


@query(r"SELECT item_id, doc_id, len(list_intersect(list_distinct(string_split(lower(b.text), ' ')), list_distinct(regexp_split_to_array(lower(d.text), '\s+')))) > 0 AS contains FROM benchmark b JOIN documents d ON b.item_id = d.doc_id")
def name_containment(spark: SparkSession, d: str) -> DataFrame:
    b, docs = _t(spark, d, "benchmark").select("item_id", F.lower("text").alias("asked")), _t(spark, d, "documents").select("doc_id", F.lower("text").alias("held"))
    pairs = b.join(docs, F.col("item_id") == F.col("doc_id"))
    return pairs.select("item_id", "doc_id", gates.token_containment(text.name_tokens(F.col("asked")), F.array_distinct(F.split("held", r"\s+"))).alias("contains"))


@query(TOPK + "SELECT q.vec_id AS qid, coalesce(min(r.rank), -1)::INTEGER AS rank FROM embeddings q LEFT JOIN ranked r ON r.qid = q.vec_id AND r.rank <= 25 AND r.id <> r.qid AND r.el = r.ql WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id")
def first_ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_expected_rank(_found(spark, d), _expected(spark, d)).select("qid", F.coalesce("rank", F.lit(-1)).alias("rank"))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "label")
    return asked.join(labels, "label").where("id <> qid").select("qid", "id")


def _found(spark: SparkSession, d: str) -> DataFrame:
    top = vector_search.topk_exact(_asked(spark, d), _rows(spark, d), 25)
    return top.select("qid", "id", "rank", F.col("cosine").alias("score"))


LABELLED = TOPK + ", hits AS (SELECT qid, min(rank) AS rank FROM ranked WHERE rank <= 25 AND id <> qid AND el = ql GROUP BY qid), q AS (SELECT vec_id AS qid, CASE WHEN vec_id % 40 = 0 THEN 'alias' ELSE 'canonical' END AS kind, hits.rank FROM embeddings LEFT JOIN hits ON qid = vec_id WHERE vec_id % 20 = 0)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    expected = _expected(spark, d).groupBy("qid").agg(F.collect_list("id").alias("expected"))
    return expected.select("qid", F.when(F.col("qid") % 40 == 0, "alias").otherwise("canonical").alias("kind"), F.lit("q").alias("query"), "expected")


@query(
    LABELLED
    + """SELECT kind, k::INTEGER AS k, count(*)::BIGINT AS n, count(*) FILTER (WHERE rank <= k)::BIGINT AS hits, round(count(*) FILTER (WHERE rank <= k)::DOUBLE / count(*), 6) AS recall, count(*) FILTER (WHERE rank IS NULL)::BIGINT AS absent FROM q, (VALUES (1), (10), (25)) v(k) GROUP BY kind, k"""
)
def recall_run(spark: SparkSession, d: str) -> DataFrame:
    return recall.run_recall(_labelled(spark, d), lambda _: _found(spark, d)).select("kind", "k", "n", "hits", F.round("recall", 6).alias("recall"), "absent")


EVIDENCE = (
    TOPK
    + """, found AS (SELECT qid, id, cosine AS score, ql = el AND id <> qid AS expected, id % 3 = 0 AS containment, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.2 END AS lexical FROM ranked WHERE rank <= 25),
    gone AS (SELECT q.vec_id AS qid, e.vec_id AS id, 0.0 AS score, true AS expected, false AS containment, 0.0 AS lexical FROM embeddings q JOIN embeddings e ON q.label = e.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND (q.vec_id, e.vec_id) NOT IN (SELECT (qid, id) FROM found)),
    facts AS (SELECT *, CASE WHEN qid % 40 = 0 THEN 'alias' ELSE 'canonical' END AS segment FROM (SELECT * FROM found UNION ALL SELECT * FROM gone)),
    judged AS (SELECT *, score >= floor AND (lexical >= min_lexical OR containment) AS kept, score >= floor AND (lexical >= min_lexical OR containment) AND score >= shown AS first FROM facts, (VALUES ('lenient', 0.3, 0.0, 0.0), ('balanced', 0.3, 0.35, 0.4), ('strict', 0.4, 0.5, 0.0)) v(level, floor, min_lexical, shown))
"""
)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d).withColumn("token_containment", F.col("id") % 3 == 0).withColumn("lexical_similarity", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2))
    return recall.decision_evidence(_labelled(spark, d), lambda _: found)


@query(EVIDENCE + "SELECT segment, level, count(*)::BIGINT AS rows, count(*) FILTER (WHERE kept)::BIGINT AS kept, count(*) FILTER (WHERE first)::BIGINT AS \"primary\", count(*) FILTER (WHERE expected)::BIGINT AS expected FROM judged GROUP BY segment, level")
def decision_run(spark: SparkSession, d: str) -> DataFrame:
    levels = F.array(F.lit("lenient"), F.lit("balanced"), F.lit("strict"))
    rows = _evidence(spark, d).select("segment", "expected", "kept", "primary", F.explode(levels).alias("level"))
    has = lambda c: F.count_if(F.array_contains(c, F.col("level")))
    return rows.groupBy("segment", "level").agg(F.count("*").alias("rows"), has("kept").alias("kept"), has("primary").alias("primary"), F.count_if("expected").alias("expected"))


REPORTED = """, each AS (SELECT 'pair' AS unit, qid, id, segment, level, expected AS truth, kept, first FROM judged), asked AS (SELECT 'query' AS unit, qid, 0 AS id, segment, level, bool_or(truth) AS truth, bool_or(kept) AS kept, bool_or(first) AS first FROM each GROUP BY qid, segment, level),
    units AS (SELECT * FROM each UNION ALL SELECT * FROM asked), pools AS (SELECT *, segment AS pool FROM units UNION ALL SELECT *, 'all' FROM units),
    bands AS (SELECT unit, pool, level, 'kept' AS band, truth, kept AS alerted FROM pools UNION ALL SELECT unit, pool, level, 'primary', truth, first FROM pools)
    SELECT unit, pool, level, band, count(*)::BIGINT AS n, count(*) FILTER (WHERE truth)::BIGINT AS positives, count(*) FILTER (WHERE alerted)::BIGINT AS alerts, round(coalesce(count(*) FILTER (WHERE truth AND alerted)::DOUBLE / nullif(count(*) FILTER (WHERE alerted), 0), 0), 6) AS "precision",
    round(count(*) FILTER (WHERE truth AND alerted)::DOUBLE / count(*) FILTER (WHERE truth), 6) AS recall, round(count(*) FILTER (WHERE NOT truth AND alerted)::DOUBLE / count(*) FILTER (WHERE NOT truth), 6) AS fpr FROM bands GROUP BY ALL HAVING count(*) FILTER (WHERE truth) BETWEEN 1 AND count(*) - 1"""


@query(EVIDENCE + REPORTED)
def decision_report(spark: SparkSession, d: str) -> DataFrame:
    cells = recall.decision_report(_evidence(spark, d))
    return cells.select("unit", "pool", "level", "band", "n", "positives", "alerts", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"))


@query(
    CELLS.replace("quality = 1 AS k1", "quality = 1 AS k1, doc_id AS id")
    + """, l AS (SELECT segment, qid, truth, level, k1 AND level <> 'strict' AS kept, k1 AND level = 'lenient' AS first FROM c, (VALUES ('lenient'), ('balanced'), ('strict')) v(level)), u AS (SELECT * FROM l UNION ALL SELECT 'all', * EXCLUDE (segment) FROM l),
    b AS (SELECT segment AS pool, level, 'kept' AS band, truth, kept AS alerted FROM u UNION ALL SELECT segment, level, 'primary', truth, first FROM u)
    SELECT unit, pool, level, band, count(*)::BIGINT AS n, count(*) FILTER (WHERE truth AND alerted)::DOUBLE / count(*) FILTER (WHERE truth) AS recall FROM b, (VALUES ('pair'), ('query')) w(unit) GROUP BY ALL HAVING count(*) FILTER (WHERE truth) BETWEEN 1 AND count(*) - 1"""
)
def decision_cells(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = _t(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("segment"), (F.col("toxic") == 1).alias("truth"), F.when(F.col("quality") == 1, F.array(F.lit("lenient"), F.lit("balanced"))).otherwise(none).alias("kept"))
    return evaluate.decision_cells(rows.withColumn("primary", F.slice("kept", 1, 1))).select("unit", "pool", "level", "band", "n", "recall")


@query("SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS segment, min(n_chars) FILTER (WHERE quality = 1) AS lowest_true, max(n_chars) FILTER (WHERE quality = 0) AS highest_false, min(n_chars) FILTER (WHERE quality = 1) > max(n_chars) FILTER (WHERE quality = 0) AS separable FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def score_separation(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.separation(rows.select(F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("segment"), (F.col("quality") == 1).alias("truth"), F.col("n_chars").alias("score")), ["segment"])


RULES = "r AS (SELECT toxic = 1 AS truth, rule, CASE rule WHEN 'long' THEN n_chars > 2000 ELSE quality = 0 END AS alerted FROM labels JOIN documents USING (doc_id), (VALUES ('long'), ('poor')) v(rule))"


@query(f"WITH {RULES} SELECT rule, count(*)::BIGINT AS n, round(coalesce(count(*) FILTER (WHERE truth AND alerted)::DOUBLE / nullif(count(*) FILTER (WHERE alerted), 0), 0), 6) AS \"precision\", round(count(*) FILTER (WHERE truth AND alerted)::DOUBLE / count(*) FILTER (WHERE truth), 6) AS recall FROM r GROUP BY rule")
def study_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("label", F.col("toxic"))
    report = evaluate.study_report(rows, {"long": F.col("n_chars") > 2000, "poor": F.col("quality") == 0})
    return report.select("rule", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


FLOORS = f"""WITH {RULES}, m AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE truth AND alerted)::DOUBLE / count(*) FILTER (WHERE truth) AS recall, count(*) FILTER (WHERE NOT truth AND alerted)::DOUBLE / count(*) FILTER (WHERE NOT truth) AS fpr FROM r GROUP BY rule),
    f AS (SELECT rule, 'recall' AS metric, 'min' AS kind, greatest(0, recall - round(least(0.02, 40.0 / n), 4)) AS bound FROM m UNION ALL SELECT rule, 'fpr', 'max', least(1, fpr + round(least(0.02, 40.0 / n), 4)) FROM m)"""


def _floors(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("label", F.col("toxic"))
    found = evaluate.floors_from(evaluate.study_report(rows, {"long": F.col("n_chars") > 2000, "poor": F.col("quality") == 0}), {"recall": "min", "fpr": "max"}, ["rule"])
    old = [f | {"bound": 0.9 if f["kind"] == "min" else 0.0} for f in found if f["rule"] == "long"]
    tight = evaluate.ratchet(found, old)
    return spark.createDataFrame([(f["rule"], f["metric"], f["kind"], float(f["bound"]), evaluate.toothless(f)) for f in tight], "rule string, metric string, kind string, bound double, toothless boolean")


@query(FLOORS + ", g AS (SELECT rule, metric, kind, CASE WHEN rule <> 'long' THEN round(bound, 4) WHEN kind = 'min' THEN greatest(round(bound, 4), 0.9) ELSE least(round(bound, 4), 0.0) END AS bound FROM f) SELECT rule, metric, kind, bound::DOUBLE AS bound, CASE WHEN kind = 'min' THEN bound <= 0 ELSE bound >= 1 END AS toothless FROM g")
def gate_floors(spark: SparkSession, d: str) -> DataFrame:
    return _floors(spark, d)


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def saturated_floors(spark: SparkSession, d: str) -> DataFrame:
    """Of floors that were 0.5 for even keys and 1 for odd ones, every third is 1 now."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("max").alias("kind"))
    now = c.withColumn("bound", F.when(F.col("k") % 3 == 0, 1.0).otherwise(0.5))
    return evaluate.new_saturation(now, c.withColumn("bound", F.when(F.col("k") % 2 == 0, 0.5).otherwise(1.0)), ["k", "kind"]).select("k")


@query(r"SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS key FROM part")
def token_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.vocabulary(_t(spark, d, "part").select(F.lower("p_name").alias("canonical")))


@query("SELECT c_custkey AS qid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal < 0")
def absent_in_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, 1).alias("rank"))
    return evaluate.absent(evaluate.in_segments(rows, ["BUILDING", "MACHINERY"])).select("qid")


DRAWN = """WITH RECURSIVE s AS (SELECT k, (20260803 + (k + 1)::HUGEINT * 1831565813) % 4294967296 AS a FROM range(1000) t(k)),
t1 AS (SELECT k, ((xor(a::BIGINT, a::BIGINT >> 15))::HUGEINT * (a::BIGINT | 1)) % 4294967296 AS t FROM s),
t2 AS (SELECT k, t, (t + (xor(t::BIGINT, t::BIGINT >> 7))::HUGEINT * (t::BIGINT | 61)) % 4294967296 AS u FROM t1),
t3 AS (SELECT k, xor(t::BIGINT, u::BIGINT) AS t FROM t2)
SELECT k::BIGINT AS k, (xor(t, t >> 14) % 4294967296)::DOUBLE / 4294967296 AS x FROM t3"""


@query(DRAWN)
def seeded_draws(spark: SparkSession, d: str) -> DataFrame:
    draw = evaluate.mulberry32(20260803)
    return spark.createDataFrame([(k, draw()) for k in range(1000)], "k long, x double")


@query("SELECT n_name AS list_id, count(*)::BIGINT AS n, round(max(greatest(0.0, c_acctbal / 10000)), 6) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def matches_by_list(spark: SparkSession, d: str) -> DataFrame:
    """All matches of each list in rank order; the first has the best score."""
    ranked = screen.top_per_list(_matches(spark, d).withColumn("qid", F.lit("all")), 1 << 30)
    return ranked.groupBy("list_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("list_rank") == 1, F.col("score"))).alias("best"))


# --- integrity, ledger, publishing -----------------------------------------------------------------------------------


@query("SELECT n_name AS path FROM nation WHERE n_name LIKE 'I%' OR n_name = 'CHINA'")
def scoped_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = _t(spark, d, "nation").select(F.when(F.col("n_name").startswith("I"), F.concat(F.lit("I/"), "n_name")).otherwise(F.col("n_name")).alias("path"))
    return integrity.scoped_files(paths, ["I/", "CHINA", "EG"]).select(F.regexp_replace("path", "^I/", "").alias("path"))


@query("SELECT source AS path, sha256(string_agg(text, '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source")
def reassembled_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in chunks of one document each, put together again; a wrong whole would fail."""
    docs = _t(spark, d, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("hash"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "hash", "text")))
    whole = docs.groupBy(F.col("source").alias("path")).agg(parts.alias("p")).select("path", F.sha2(F.concat_ws("", F.transform("p", lambda x: x["text"])), 256).alias("sha256"), F.transform("p", lambda x: F.struct(x["hash"].alias("hash"), F.octet_length(x["text"]).cast("long").alias("size"))).alias("chunks"))
    store = docs.groupBy("hash").agg(F.first(F.col("text").cast("binary")).alias("content"))
    return integrity.reassemble(integrity.chunk_table(whole), store).select("path", F.sha2("content", 256).alias("sha256"))


@query("SELECT o_orderkey, o_orderkey % 7 < coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 END, 0) AS refused, (o_orderkey % 7 + 1)::BIGINT AS next FROM orders")
def version_sequences(spark: SparkSession, d: str) -> DataFrame:
    following = F.element_at(F.array(*[F.lit(integrity.next_sequence(k)) for k in range(7)]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", integrity.is_rollback(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 5), F.col("o_orderkey") % 7).alias("refused"), following.cast("long").alias("next"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    new = c.select(F.col("c_custkey").cast("string").alias("reference"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("dob"), F.col("c_mktsegment").alias("country"), F.lit(None).cast("string").alias("onboarded_by"))
    return ledger.create_customers(spark.createDataFrame([], ledger.CUSTOMERS), new, "2026-01-01")


@query("SELECT c_custkey::VARCHAR AS reference, CASE WHEN c_custkey % 2 = 0 THEN 'Changed ' || c_custkey ELSE c_name END AS name, c_mktsegment AS country, CASE WHEN c_custkey % 4 = 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status, 'local' AS onboarded_by FROM customer")
def updated_customers(spark: SparkSession, d: str) -> DataFrame:
    customers = _customers(spark, d)
    even = customers.where(F.col("reference").cast("long") % 2 == 0)
    patch = even.select("customer_id", F.concat(F.lit(" Changed "), "reference").alias("name"), F.lit("  ").alias("country"), F.when(F.col("reference").cast("long") % 4 == 0, "APPROVED").alias("status"))
    return ledger.update_customers(customers, patch).select("reference", "name", "country", "status", "onboarded_by")


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey::VARCHAR DESC) AS k FROM customer) WHERE k > ((SELECT count(*) FROM customer) - 1) // 24 * 24")
def directory_page(spark: SparkSession, d: str) -> DataFrame:
    """The last page, asked for by a number far beyond it."""
    rows = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_mktsegment").alias("created_at"), "c_custkey", "c_name")
    return ledger.customers_page(rows, 1 << 40)[0].select("c_custkey", "c_name")


@query(SIDES + "SELECT count(*) FILTER (WHERE res = 'PENDING')::BIGINT AS pending FROM p")
def pending_matches(spark: SparkSession, d: str) -> DataFrame:
    return ledger.pending_count(_ledger(spark, d)[0])


@query(SIDES + "SELECT n.customer_id, n.entity_id, 'DETECTED' AS type FROM n WHERE (customer_id, entity_id) = (SELECT (min(customer_id), arg_min(entity_id, (customer_id, entity_id))) FROM n)")
def match_history(spark: SparkSession, d: str) -> DataFrame:
    matches, events, after = _ledger(spark, d)
    _, logged = ledger.record_matches(matches, events, after, "t1")
    one = after.agg(F.min(F.struct("customer_id", "entity_id")).alias("x")).select("x.*").first()
    return ledger.match_events(logged, "unknown", one["customer_id"], one["entity_id"]).select("customer_id", "entity_id", "type")


@query(SIDES + "SELECT (SELECT count(*) FROM n)::BIGINT AS before, (SELECT count(*) FROM n WHERE customer_id::BIGINT % 2 = 0)::BIGINT AS after")
def append_only_log(spark: SparkSession, d: str) -> DataFrame:
    """Events of deleted customers may go; the check raises if any other is missing or changed."""
    matches, events, after = _ledger(spark, d)
    _, logged = ledger.record_matches(matches, events, after, "t1")
    even = logged.where(F.col("customer_id").cast("long") % 2 == 0)
    ledger.check_append_only(logged, even, logged.where(F.col("customer_id").cast("long") % 2 == 0).select("customer_id").distinct())
    return logged.agg(F.count("*").alias("before")).crossJoin(even.agg(F.count("*").alias("after")))


REVIEWED = "SELECT c_custkey::VARCHAR AS reference, c_nationkey::VARCHAR AS entity_id, tier, 'PENDING' AS resolution FROM (SELECT *, CASE WHEN c_acctbal >= 8000 THEN 'STRONG' ELSE 'POSSIBLE' END AS tier FROM customer WHERE c_acctbal >= 5500)"


def _onboarded(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    c = _t(spark, d, "customer")
    entities = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("primary_name"), F.array(F.struct(F.col("n_name").alias("name"))).alias("aliases"), F.array().cast("array<string>").alias("dob"), F.array(F.col("n_name")).alias("countries"))
    facts = c.select(F.col("c_custkey").cast("string").alias("reference"), F.col("c_nationkey").alias("id"), (F.col("c_acctbal") / 10000).alias("score"))

    def found(customers: DataFrame) -> DataFrame:
        rows = customers.join(facts.where("score >= 0.55"), "reference")
        return rows.select("customer_id", "id", "score", gates.classify_tier(F.col("score"), F.lit(0.55)).alias("tier"))

    new = c.select(F.col("c_custkey").cast("string").alias("reference"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("dob"), F.lit("US").alias("country"), F.lit("me").alias("onboarded_by"))
    empty = [spark.createDataFrame([], schema) for schema in (ledger.CUSTOMERS, ledger.MATCHES, ledger.EVENTS)]
    return (*review.onboard(*empty, new, entities, found, "t0"), entities, found)


@query(REVIEWED)
def onboarding(spark: SparkSession, d: str) -> DataFrame:
    customers, matches, *_ = _onboarded(spark, d)
    return matches.join(customers.select("customer_id", "reference"), "customer_id").select("reference", "entity_id", "tier", "resolution")


@query("SELECT 0::BIGINT AS new_hits, count(*) FILTER (WHERE c_acctbal >= 5500 AND c_acctbal < 8000)::BIGINT AS cleared, count(*) FILTER (WHERE c_acctbal >= 8000)::BIGINT AS kept FROM customer")
def rescan_run(spark: SparkSession, d: str) -> DataFrame:
    customers, matches, events, entities, found = _onboarded(spark, d)
    *_, summary = review.rescan(customers, matches, events, entities, lambda c: found(c).where("score >= 0.8"), "t1")
    return summary


@query(
    """SELECT qid, id, receipt, 'sha256:' || sha256(receipt) AS receipt_hash FROM (SELECT c_mktsegment AS qid, c_custkey AS id,
    '{"engine":"vigilframe","engine_version":"1","inputs_hash":"sha256:' || sha256('{"entity":"' || c_custkey || '","query":"' || c_name || '"}') || '","kind":"match","score":0.5,"tier":"WEAK","watchlist_version":"v' || c_mktsegment || '"}' AS receipt FROM customer)"""
)
def match_receipts(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    rows = c.select(F.col("c_mktsegment").alias("qid"), F.col("c_custkey").alias("id"), F.col("c_name").alias("query"), F.lit(0.5).alias("score"), F.lit("WEAK").alias("tier"))
    versions = rows.select("qid").distinct().withColumn("watchlist_version", F.concat(F.lit("v"), "qid"))
    return receipts.with_receipts(rows, versions).select("qid", "id", "receipt", "receipt_hash")


@query(
    """SELECT 'L1' AS id, 'v7' AS version, (SELECT count(*) FROM supplier)::BIGINT AS n, false AS stale, (SELECT count(*) FROM supplier)::BIGINT AS rows UNION ALL SELECT 'L2', 'v6', 3, true, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1)"""
)
def staged_lists(spark: SparkSession, d: str) -> DataFrame:
    """One list that can be staged, and one whose feed has too few entities and that is carried forward."""
    lines = _source_lines(spark, d)
    sources = [publish.Source("L1", "One", lambda _: lines.withColumn("source_list", F.lit("L1")), (1, 1 << 40)), publish.Source("L2", "Two", lambda _: lines.limit(0), (1, 1 << 40))]
    catalog = spark.createDataFrame([("L2", "v6", 3, "2025-01-01T00:00:00Z")], "id string, version string, entitiesCount long, fetchedAt string")
    entities, made = publish.stage_all(spark, sources, "2026-01-01T00:00:00Z", files.to_wire(lines), catalog)
    counts = entities.groupBy(F.col("source_list").alias("id")).agg(F.count("*").alias("rows"))
    return made.join(counts, "id").select("id", "version", F.col("entitiesCount").alias("n"), "stale", "rows")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events through a stream into the append-only log, and the log counted by window."""
    folder = _folder(spark)
    _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    incremental.append_events(incremental.event_stream(spark, f"{folder}/in", 100), f"{folder}/log", f"{folder}/state").awaitTermination()
    counted = incremental.windowed_counts(spark.read.schema(incremental.EVENT).parquet(f"{folder}/log"))
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT c_custkey::VARCHAR AS entity_id, 'A|B' AS aliases, '' AS addresses, CASE WHEN c_custkey % 2 = 0 THEN 'Passport P' || c_custkey || '|National ID N1|Tax 1|Tax 2' ELSE '' END AS lines, 12::INTEGER AS columns FROM customer"""
)
def dossiers(spark: SparkSession, d: str) -> DataFrame:
    ids = F.struct(F.array(F.concat(F.lit("P"), "c_custkey")).alias("passport"), F.array(F.lit("N1")).alias("national_id"), F.create_map(F.lit("Tax"), F.array(F.lit("1"), F.lit("2"))).alias("other"))
    rows = _t(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("primary_name"), F.lit("PERSON").alias("entity_type"), F.lit("SANCTION").alias("risk_category"), F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit("B").alias("name"))).alias("aliases"),
        F.array().cast("array<string>").alias("dob"), F.array(F.lit("US")).alias("countries"), F.when(F.col("c_custkey") % 2 == 0, ids).alias("identifiers"), F.lit(0.5).alias("score"), F.lit("x").alias("explanation"), F.array().cast("array<string>").alias("reasons"),
    )
    made = dossier.dossier(rows)
    return made.select("entity_id", _joined("aliases").alias("aliases"), _joined("addresses").alias("addresses"), F.concat_ws("|", dossier.identifier_lines(F.col("identifiers"))).alias("lines"), F.lit(len(made.columns)).alias("columns"))


@query("SELECT c_nationkey AS qid, count(*)::BIGINT AS n, count(*) >= 25 AS capped FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 25 GROUP BY c_nationkey")
def capped_searches(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("qid"), F.lit("l").alias("list_id"), F.col("c_custkey").alias("id"), F.lit(0.5).alias("score"))
    return screen.capped(screen.top_per_list(rows, 25), 25)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN true ELSE o_totalprice >= 100000 END AS fits FROM orders")
def storage_quota(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", integrity.fits_quota(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")), F.lit(40_000), F.lit(60_000)).alias("fits"))


@query("SELECT c_custkey::VARCHAR AS customer_id, true AS empty, 4::INTEGER AS version FROM customer")
def migrated_tables(spark: SparkSession, d: str) -> DataFrame:
    old = {"matches": _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))}
    tables, version = ledger.migrate(old, 1)
    return tables["matches"].select("customer_id", (F.col("fingerprint").isNull() & F.col("review_state").isNull() & F.col("notes").isNull()).alias("empty"), F.lit(version).alias("version"))


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS source_list, count(*)::BIGINT AS n, 0::BIGINT AS problems FROM supplier GROUP BY ALL")
def signed_origin(spark: SparkSession, d: str) -> DataFrame:
    """Published with a new key, mirrored, verified, and read from the mirror."""
    entities = files.to_wire(_source_lines(spark, d))
    catalog = entities.groupBy(F.col("source_list").alias("id")).agg(F.max("list_version").alias("version"))
    public, private = hashing.ed25519_keypair(spark)
    origin.publish(spark, entities, catalog, path := _folder(spark), 3, private)
    origin.mirror(spark, path, copy := _folder(spark), public)
    problems = origin.verify(spark, copy, public, 3).count()
    return spark.read.json(f"{copy}/entities").groupBy("source_list").agg(F.count("*").alias("n")).withColumn("problems", F.lit(problems).cast("long"))
