"""Onboarding and rescans: screen in batch, then write the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.hashing import material_fingerprint
from vigilframe.functions.text import canonicalize
from vigilframe.operators import ledger
from vigilframe.streaming.incremental import rescan_summary

Screener = Callable[[DataFrame], DataFrame]


def tiered(customers: DataFrame, matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows for the ledger: customer_id, entity_id, score, tier, fingerprint. matches: customer_id, id, score, tier."""
    who = customers.select("customer_id", canonicalize(F.col("name")).alias("c_name"), F.col("country").alias("c_country"))
    what = entities.select("id", canonicalize(F.col("primary_name")).alias("e_name"), F.transform("aliases", lambda a: a["name"]).alias("e_aliases"), F.col("dob").alias("e_dob"), F.col("countries").alias("e_countries"))
    joined = matches.join(who, "customer_id").join(what, "id")
    print_ = material_fingerprint(F.col("c_name"), F.col("c_country"), F.col("e_name"), F.col("e_aliases"), F.col("e_dob"), F.col("e_countries"))
    return joined.select("customer_id", F.col("id").cast("string").alias("entity_id"), "score", "tier", print_.alias("fingerprint"))


def onboard(customers: DataFrame, matches: DataFrame, events: DataFrame, new: DataFrame, entities: DataFrame, screen: Screener, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create the customers, screen them all at once, record what was found."""
    after = ledger.create_customers(customers, new, at)
    fresh = after.join(new.select("reference"), "reference", "left_semi")
    return after, *ledger.record_matches(matches, events, tiered(fresh, screen(fresh), entities), at)


def rescan(customers: DataFrame, matches: DataFrame, events: DataFrame, entities: DataFrame, screen: Screener, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Screen all customers again and replace their matches; the third table tells new, cleared and kept pairs."""
    found = tiered(customers, screen(customers), entities)
    summary = rescan_summary(matches, found)
    return *ledger.replace_matches(matches, events, found, customers, at), summary
