"""What is shown of one entity or match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIERS = "struct<passport:array<string>,national_id:array<string>,other:map<string,array<string>>>"
SHOWN = ["entity_id", "primary_name", "risk_category", "aliases", "dob", "countries", "nationalities", "addresses", "identifiers"]
SCORED = ["score", "explanation", "reasons", "score_receipt"]


def dossier(rows: DataFrame) -> DataFrame:
    """The columns of SHOWN, and of SCORED where rows have them. The entity's type is left out, since published lists don't tell
    it. Absent lists are empty; aliases are names."""
    none = F.array().cast("array<string>")
    aliases = F.transform("aliases", lambda a: a["name"]) if "struct" in rows.schema["aliases"].dataType.simpleString() else F.col("aliases")
    have = lambda c: F.coalesce(F.col(c), none) if c in rows.columns else none
    identifiers = F.col("identifiers") if "identifiers" in rows.columns else F.lit(None).cast(IDENTIFIERS)
    made = {"aliases": aliases, "nationalities": have("nationalities"), "addresses": have("addresses"), "identifiers": identifiers}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in SHOWN], *[c for c in SCORED if c in rows.columns])


def identifier_lines(identifiers: Column) -> Column:
    """One line for each identifier: passports, national ids, then the others under their own labels."""
    none = F.array().cast("array<string>")
    lines = lambda values, label: F.transform(F.coalesce(values, none), lambda v: F.concat_ws(" ", label, v))
    other = F.flatten(F.transform(F.map_entries(F.coalesce(identifiers["other"], F.create_map().cast("map<string,array<string>>"))), lambda e: lines(e["value"], e["key"])))
    return F.concat(lines(identifiers["passport"], F.lit("Passport")), lines(identifiers["national_id"], F.lit("National ID")), other)
