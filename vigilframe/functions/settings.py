"""Settings kept as JSON: thresholds, enabled lists, documents of a customer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.config import PRESETS
from vigilframe.functions.text import import_date

DOCUMENT = "doc_type string, number string, country string, expires string"


def preset_overrides(raw: Column) -> Column:
    """Map of list to preset; values that are no preset are dropped, malformed JSON gives an empty map."""
    read = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(read, lambda k, v: v.isin(list(PRESETS)))


def list_thresholds(overrides: Column, default: Column) -> tuple[Column, Column]:
    """Floors of the lists with a preset of their own, and that of the others."""
    floors = F.create_map(*[F.lit(x) for name, p in PRESETS.items() for x in (name, p["threshold"])])
    return F.transform_values(overrides, lambda k, v: F.element_at(floors, v)), F.coalesce(F.try_element_at(floors, default), F.lit(PRESETS["balanced"]["threshold"]))


def id_array(raw: Column) -> Column:
    """A JSON array of strings, or null if it is anything else."""
    read = F.from_json(raw, "array<string>")
    return F.when(F.trim(raw).startswith("[") & ~F.exists(read, lambda x: x.isNull()) & ~raw.rlike(r'[\[,]\s*(?:[\d{\[tfn-])'), read)


def enabled_ids(stored: Column, catalog: Column) -> Column:
    """Stored ids that the catalog has, in its order; all of the catalog if nothing is stored."""
    return F.when(stored.isNull(), catalog).otherwise(F.filter(catalog, lambda x: F.array_contains(stored, x)))


def same_ids(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def same_map(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def documents(raw: Column, most: int = 20, longest: int = 20_000) -> Column:
    """The documents of a customer, or null: too many, too long, a country that isn't two letters, a date that isn't one."""
    read = F.from_json(raw, f"array<struct<{DOCUMENT.replace(' ', ':').replace(',:', ',')}>>")
    fits = F.forall(read, lambda d: d["doc_type"].isNotNull() & (d["country"].isNull() | d["country"].rlike("^[A-Za-z]{2}$")) & (d["expires"].isNull() | import_date(d["expires"]).isNotNull()))
    return F.when((F.length(raw) <= longest) & (F.size(read) <= most) & fits, read)
