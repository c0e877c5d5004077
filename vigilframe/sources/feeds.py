"""List feeds as one neutral record.

Every reader returns LINE: entity_id, primary_name, entity_type, aliases, dob, countries, risk_category, source_list,
list_version. Schemas are given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions.text import multi_value, namespaced_id

LINE = "entity_id string, primary_name string, entity_type string, aliases array<struct<name:string>>, dob array<string>, countries array<string>, risk_category string, source_list string, list_version string"
CSL_COLUMNS = ["source", "entity_number", "type", "name", "alt_names", "dates_of_birth", "citizenships", "nationalities"]
CSL_SDN = "Specially Designated Nationals (SDN) - Treasury Department"


def _line(df: DataFrame, source_list: str, version: str) -> DataFrame:
    out = df.withColumn("source_list", F.lit(source_list)).withColumn("list_version", F.lit(version)).withColumn("risk_category", F.lit("SANCTION"))
    return out.select("entity_id", "primary_name", "entity_type", "aliases", "dob", "countries", "risk_category", "source_list", "list_version")


def _named(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name")))


def read_csl(spark: SparkSession, path: str, version: str, list_id: str = "OFAC_SDN", source: str = CSL_SDN) -> DataFrame:
    """Rows of one source of a consolidated CSV; needs CSL_COLUMNS in the header; rows without number or name are left out."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, mode="PERMISSIVE", inferSchema=False)
    columns = {c.strip().lower(): c for c in raw.columns}
    absent = [c for c in CSL_COLUMNS if c not in columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    t = raw.select(*[F.trim(F.coalesce(F.col(f"`{columns[c]}`"), F.lit(""))).alias(c) for c in CSL_COLUMNS]).where((F.col("source") == source) & (F.col("entity_number") != "") & (F.col("name") != ""))
    person = F.when(F.lower("type") == "individual", "PERSON").otherwise("ORGANIZATION")
    return _line(
        t.select(namespaced_id(F.lit(list_id), F.col("entity_number")).alias("entity_id"), F.col("name").alias("primary_name"), person.alias("entity_type"), _named(multi_value(F.col("alt_names"))).alias("aliases"), multi_value(F.col("dates_of_birth")).alias("dob"), F.array_union(multi_value(F.col("citizenships")), multi_value(F.col("nationalities"))).alias("countries")),
        list_id,
        version,
    )


def read_ofsi(spark: SparkSession, path: str, version: str, list_id: str = "UK_OFSI") -> DataFrame:
    """A CSV with a preamble before its header; rows of a group are one entity: its primary name, then its aliases."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    head = lines.where(F.col("value").contains("Group ID")).orderBy("at").first()
    if head is None:
        return spark.createDataFrame([], LINE)
    names = [n.strip().strip('"') for n in head["value"].split(",")]
    fields = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = lines.where(F.col("at") > head["at"]).select("at", F.from_csv("value", fields, {"quote": '"', "escape": '"'}).alias("r"))
    col = lambda name: F.trim(F.coalesce(F.col(f"r.c{names.index(name)}"), F.lit(""))) if name in names else F.lit("")
    name = F.concat_ws(" ", *[F.nullif(col(f"Name {i}"), F.lit("")) for i in (1, 2, 3, 4, 5, 6)])  # forenames, then the family name
    rows = parsed.select("at", col("Group ID").alias("group"), name.alias("name"), col("DOB").alias("dob"), col("Nationality").alias("country"), col("Group Type").alias("type"), (F.lower(col("Alias Type")) == "primary name").alias("first")).where("group <> ''")
    order = F.struct((~F.col("first")).alias("later"), "at")
    folded = rows.groupBy("group").agg(F.min_by(F.struct("name", "dob", "country", "type", "at"), order).alias("p"), F.array_sort(F.collect_list(F.struct("at", "name"))).alias("all"))
    aliases = F.transform(F.filter("all", lambda x: (x["at"] != F.col("p.at")) & (x["name"] != "")), lambda x: x["name"])
    one = lambda c: F.filter(F.array(F.nullif(F.col(c), F.lit(""))), lambda x: x.isNotNull())
    return _line(folded.select(namespaced_id(F.lit(list_id), F.col("group")).alias("entity_id"), F.col("p.name").alias("primary_name"), F.when(F.lower("p.type") == "individual", "PERSON").otherwise("ORGANIZATION").alias("entity_type"), _named(aliases).alias("aliases"), one("p.dob").alias("dob"), one("p.country").alias("countries")), list_id, version)


EU = "_logicalId string, subjectType struct<_code:string>, nameAlias array<struct<_firstName:string,_lastName:string,_wholeName:string>>, birthdate array<struct<_birthdate:string,_year:string>>, citizenship array<struct<_countryIso2Code:string>>, address array<struct<_countryIso2Code:string>>"


def read_eu(spark: SparkSession, path: str, version: str, list_id: str = "EU") -> DataFrame:
    """sanctionEntity elements: the first name that isn't empty is the primary one, the first birth date counts."""
    raw = spark.read.format("xml").option("rowTag", "sanctionEntity").schema(EU).load(path)
    whole = lambda n: F.coalesce(F.nullif(F.trim(n["_wholeName"]), F.lit("")), F.trim(F.concat_ws(" ", F.nullif(F.trim(n["_firstName"]), F.lit("")), F.nullif(F.trim(n["_lastName"]), F.lit("")))))
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce("nameAlias", F.array().cast("array<struct<_firstName:string,_lastName:string,_wholeName:string>>")), whole), lambda n: n != "")
    codes = lambda c: F.coalesce(F.transform(c, lambda x: x["_countryIso2Code"]), none)
    countries = F.array_sort(F.array_distinct(F.filter(F.concat(codes("citizenship"), codes("address")), lambda x: x.isNotNull() & (x != ""))))
    birth = F.try_element_at(F.transform("birthdate", lambda b: F.coalesce(F.nullif(b["_birthdate"], F.lit("")), F.nullif(b["_year"], F.lit("")))), F.lit(1))
    rows = raw.withColumn("names", names).where(F.size("names") > 0)
    return _line(rows.select(namespaced_id(F.lit(list_id), F.col("_logicalId")).alias("entity_id"), F.element_at("names", 1).alias("primary_name"), F.when(F.lower("subjectType._code") == "person", "PERSON").otherwise("ORGANIZATION").alias("entity_type"), _named(F.slice("names", 2, 10_000)).alias("aliases"), F.array_compact(F.array(birth)).alias("dob"), countries.alias("countries")), list_id, version)


UN = "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, NATIONALITY array<struct<VALUE:array<string>>>, {0}_ALIAS array<struct<QUALITY:string,ALIAS_NAME:string>>, {0}_DATE_OF_BIRTH array<struct<TYPE_OF_DATE:string,DATE:string,YEAR:string>>"


def read_un(spark: SparkSession, path: str, version: str, list_id: str = "UN") -> DataFrame:
    """INDIVIDUAL elements, then ENTITY elements. Persons have a birth date: the first DATE, else the first YEAR."""

    def part(tag: str, kind: str) -> DataFrame:
        raw = spark.read.format("xml").option("rowTag", tag).schema(UN.format(tag)).load(path)
        name = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")])
        aliases = F.filter(F.transform(F.coalesce(f"{tag}_ALIAS", F.array().cast("array<struct<QUALITY:string,ALIAS_NAME:string>>")), lambda a: F.trim(a["ALIAS_NAME"])), lambda a: a.isNotNull() & (a != ""))
        none = F.array().cast("array<string>")
        countries = F.array_sort(F.array_distinct(F.filter(F.flatten(F.coalesce(F.transform("NATIONALITY", lambda n: F.coalesce(n["VALUE"], none)), F.array().cast("array<array<string>>"))), lambda x: x != "")))
        dates = lambda f: F.try_element_at(F.filter(F.transform(f"{tag}_DATE_OF_BIRTH", lambda d: d[f]), lambda x: x.isNotNull() & (x != "")), F.lit(1))
        dob = F.array_compact(F.array(F.coalesce(dates("DATE"), dates("YEAR")))) if tag == "INDIVIDUAL" else none
        rows = raw.withColumn("name", name).where("name <> ''")
        return rows.select(namespaced_id(F.lit(list_id), F.col("DATAID")).alias("entity_id"), F.col("name").alias("primary_name"), F.lit(kind).alias("entity_type"), _named(aliases).alias("aliases"), dob.alias("dob"), countries.alias("countries"))

    return _line(part("INDIVIDUAL", "PERSON").unionByName(part("ENTITY", "ORGANIZATION")), list_id, version)


def apply_alias_enrichment(lines: DataFrame, extra: DataFrame) -> DataFrame:
    """lines with the extra aliases (number, name) appended that the entity doesn't carry yet in any case of letters."""
    from vigilframe.functions.text import entity_number

    gathered = extra.where("name <> ''").groupBy("number").agg(F.array_sort(F.collect_set("name")).alias("extra"))
    joined = lines.withColumn("number", entity_number(F.col("entity_id"))).join(gathered, "number", "left")
    known = F.transform(F.concat(F.array("primary_name"), F.transform("aliases", lambda a: a["name"])), lambda n: F.lower(n))
    added = F.filter(F.coalesce("extra", F.array().cast("array<string>")), lambda n: ~F.array_contains(known, F.lower(n)))
    return joined.withColumn("aliases", F.concat("aliases", _named(added))).select(*lines.columns)


PARTY = "_FixedRef string, Profile array<struct<Identity:array<struct<Alias:array<struct<DocumentedName:array<struct<DocumentedNamePart:array<struct<NamePartValue:array<struct<_ScriptID:string,_VALUE:string>>>>>>>>>>>>"


def read_script_aliases(spark: SparkSession, path: str) -> DataFrame:
    """number, name, script of names in other scripts than Latin, once for each party. A name's script is that of its last
    part, and Unknown if the file doesn't explain it."""
    scripts = spark.read.format("xml").option("rowTag", "Script").schema("_ID string, _VALUE string").load(path).select(F.col("_ID").alias("id"), F.col("_VALUE").alias("script"))
    party = spark.read.format("xml").option("rowTag", "DistinctParty").schema(PARTY).load(path)
    names = party.select(F.col("_FixedRef").alias("number"), F.explode("Profile").alias("p")).select("number", F.explode("p.Identity").alias("i")).select("number", F.explode("i.Alias").alias("a")).select("number", F.explode("a.DocumentedName").alias("d"))
    parts = F.filter(F.flatten(F.transform("d.DocumentedNamePart", lambda x: x["NamePartValue"])), lambda v: v["_VALUE"].isNotNull() & (F.trim(v["_VALUE"]) != ""))
    flat = names.select("number", parts.alias("v")).where(F.size("v") > 0).select("number", F.concat_ws(" ", F.transform("v", lambda x: F.trim(x["_VALUE"]))).alias("name"), F.element_at("v", -1)["_ScriptID"].alias("id"))
    return flat.join(scripts, "id", "left").select("number", "name", F.coalesce("script", F.lit("Unknown")).alias("script")).where("script <> 'Latin'").dropDuplicates(["number", "name"])


def script_histogram(aliases: DataFrame) -> DataFrame:
    """script, n: aliases by script."""
    return aliases.groupBy("script").agg(F.count("*").alias("n"))


def check_feed_size(spark: SparkSession, path: str, limit: int = 512 << 20) -> int:
    """Bytes of the feed, on the driver; more than the limit is an error before anything is read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if size > limit:
        raise ValueError(f"the feed has {size} bytes, more than {limit}")
    return size
