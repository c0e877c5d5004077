"""Published files: entities, vectors, catalogs, evidence, customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import EMBEDDING_DIM, RISK_CATEGORIES
from vigilframe.functions.text import canonicalize, display_name, first_dob
from vigilframe.functions.vectors import float_rows
from vigilframe.sources.feeds import LINE

WIRE = "entity_id string, name_canonical string, aliases array<string>, dob string, countries array<string>, risk_category string, source_list string, list_version string"
EVIDENCE = "id int, segment string, query string, expected array<string>, candidates array<struct<entityId:string,rank:int,retrieved:boolean,score:double,lexical:double,tokenContainment:boolean,expected:boolean,kept:array<string>,primary:array<string>>>"


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows fail that lack one of the columns."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a row without {c}"))).otherwise(F.col(c)))
    return df


def read_source_lines(spark: SparkSession, path: str) -> DataFrame:
    """Source entities as JSON lines; blank lines are skipped."""
    return required(spark.read.schema(LINE).option("mode", "FAILFAST").json(path), ["entity_id", "primary_name", "risk_category", "source_list", "list_version"])


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Published entities; an unknown risk category fails."""
    rows = required(spark.read.schema(WIRE).option("mode", "FAILFAST").json(path), ["entity_id", "name_canonical", "source_list"])
    bad = F.raise_error(F.concat(F.col("entity_id"), F.lit(" has an unknown risk category")))
    return rows.withColumn("risk_category", F.when(F.col("risk_category").isin(RISK_CATEGORIES), F.col("risk_category")).otherwise(bad))


def to_wire(lines: DataFrame) -> DataFrame:
    """The published row: canonical name, alias names, the first date that can be read, sorted countries. Types are lost."""
    return lines.select("entity_id", canonicalize(F.col("primary_name")).alias("name_canonical"), F.transform("aliases", lambda a: a["name"]).alias("aliases"), first_dob(F.col("dob")).alias("dob"), F.array_sort(F.array_distinct("countries")).alias("countries"), "risk_category", "source_list", "list_version")


def from_wire(wire: DataFrame) -> DataFrame:
    """The engine's entity: the display name comes from the canonical one, the type is PERSON."""
    named = wire.select("*", F.posexplode_outer("aliases").alias("__i", "__alias")).withColumn("__c", canonicalize(F.col("__alias")))
    keys = [c for c in wire.columns if c != "aliases"]
    one = F.struct("__i", F.struct(F.col("__alias").alias("name"), F.col("__c").alias("name_canonical")).alias("a"))
    gathered = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("__alias").isNotNull(), one))).alias("l"))
    return gathered.select(
        "entity_id", F.col("source_list").alias("list_id"), "list_version", F.lit("PERSON").alias("entity_type"), display_name(F.col("name_canonical")).alias("primary_name"), "name_canonical",
        F.transform("l", lambda x: x["a"]).alias("aliases"), F.array_compact(F.array("dob")).alias("dob"), "countries", "risk_category",
    )


def read_vectors(spark: SparkSession, path: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """position, vector of a file of little-endian float32 rows."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.posexplode(float_rows("content", F.lit(dim))).alias("position", "vector"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row for each list of a catalog.json."""
    entry = "id string, title string, slug string, version string, entitiesCount long, fetchedAt string, sourceUpdatedAt string, stale boolean, staleReason string"
    raw = spark.read.schema(f"generatedAt string, lists array<struct<{entry.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return raw.select("generatedAt", F.inline("lists"))


def check_catalog(catalog: DataFrame, meta: DataFrame, entities: DataFrame) -> DataFrame:
    """list_id and problem where catalog, meta (id, version, entitiesCount) and rows (list_id) disagree."""
    counts = entities.groupBy("list_id").agg(F.count("*").alias("rows"))
    joined = catalog.select(F.col("id").alias("list_id"), F.col("version").alias("cv")).join(meta.select(F.col("id").alias("list_id"), F.col("version").alias("mv"), "entitiesCount"), "list_id", "left").join(counts, "list_id", "left")
    problem = F.when(F.col("mv").isNull(), "no meta").when(F.col("cv") != F.col("mv"), "version").when(F.coalesce("rows", F.lit(0)) != F.col("entitiesCount"), "count")
    return joined.select("list_id", problem.alias("problem")).where("problem is not null")


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header and rows of decision evidence; a file without header fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = F.get_json_object("value", "$.kind")
    header = lines.where(kind == "header")
    if header.isEmpty():
        raise ValueError("evidence without header")
    rows = lines.where(F.coalesce(kind, F.lit("row")) != "header").select(F.from_json("value", EVIDENCE, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return header, rows


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """A customer CSV with any spelling of its headers; row_number counts the header as 1."""
    from vigilframe.functions.text import canonical_header

    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.toDF(*[canonical_header(c) for c in raw.columns])
