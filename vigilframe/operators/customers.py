"""Import of customers: validation, duplicates, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.text import import_date

#: required columns and the longest value of each
LIMITS = {"reference": 120, "name": 240, "notes": 4000}


def errors_of(row: dict[str, Column]) -> Column:
    """Array of struct(field, message); empty for an acceptable row."""

    def problem(field: str, condition: Column, message: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = [problem(f, blank(row[f]), "required") for f in ("reference", "name") if f in row]
    found += [problem(f, F.length(row[f]) > n, "too long") for f, n in LIMITS.items() if f in row]
    if "country" in row:
        found.append(problem("country", ~blank(row["country"]) & ~F.trim(row["country"]).rlike("^[A-Za-z]{2}$"), "not an ISO country"))
    if "dob" in row:
        found.append(problem("dob", ~blank(row["dob"]) & import_date(row["dob"]).isNull(), "not a date"))
    return F.array_compact(F.array(*found))


def validate(rows: DataFrame) -> DataFrame:
    """rows with errors and row_number (the first data row is 2); rows of blanks only are left out.

    rows: ordinal (from 0), reference, name and others of LIMITS, country, dob.
    """
    fields = [c for c in rows.columns if c != "ordinal"]
    full = rows.where(F.concat_ws("", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields]) != "")
    return full.withColumn("row_number", F.col("ordinal") + 2).withColumn("errors", errors_of({c: F.col(c) for c in fields}))


def preview(valid: DataFrame, existing: DataFrame) -> DataFrame:
    """valid with status: new, duplicate (of an earlier row) or existing; references are compared in upper case, trimmed."""
    ref = F.upper(F.trim("reference"))
    seen = existing.select(F.upper(F.trim("reference")).alias("__r")).distinct().withColumn("__known", F.lit(True))
    ranked = valid.withColumn("__r", ref).withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy("ordinal")))
    joined = ranked.join(seen, "__r", "left")
    status = F.when(F.col("__known"), "existing").when(F.col("__n") > 1, "duplicate").otherwise("new")
    return joined.withColumn("status", status).drop("__r", "__n", "__known")
