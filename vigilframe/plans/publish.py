"""Publishing lists: read, check, enrich, project; a list that fails is carried forward from its last version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.sources import feeds, files


@dataclass(frozen=True)
class Source:
    """A list: how to read its lines, its plausible number of entities, and how to read further aliases."""

    list_id: str
    title: str
    read: Callable[[SparkSession], DataFrame]
    band: tuple[int, int]
    enrich: Callable[[SparkSession], DataFrame] | None = None
    #: ISO instant of the feed itself, where it tells one
    updated_at: str | None = None


def enrich_or_degrade(spark: SparkSession, lines: DataFrame, source: Source) -> tuple[DataFrame, dict]:
    """Lines with further aliases. A failing alias feed never fails the list: it is published without, and says so."""
    if source.enrich is None:
        return lines, {"mode": "none", "added": 0}
    try:
        more = feeds.apply_alias_enrichment(lines, source.enrich(spark))
        added = more.agg(F.coalesce(F.sum(F.size("aliases")), F.lit(0))).first()[0] - lines.agg(F.coalesce(F.sum(F.size("aliases")), F.lit(0))).first()[0]
        return more, {"mode": "enriched", "added": int(added)}
    except Exception as e:
        return lines, {"mode": "degraded", "added": 0, "reason": str(e)[:200]}


def merge_reports(reports: list[dict]) -> dict:
    """Added aliases of all lists, and the worst of their modes: degraded before enriched before none."""
    worst = max(reports, key=lambda r: ["none", "enriched", "degraded"].index(r["mode"]), default={"mode": "none"})
    return {"mode": worst["mode"], "added": sum(r["added"] for r in reports), "reason": worst.get("reason")}


def stage(spark: SparkSession, source: Source) -> tuple[DataFrame, dict]:
    lines = source.read(spark)
    count = lines.count()
    if not source.band[0] <= count <= source.band[1]:
        raise ValueError(f"{source.list_id}: {count} entities")
    lines, report = enrich_or_degrade(spark, lines, source)
    return files.to_wire(lines), {"entities": count, "aliases": report}


def stage_all(spark: SparkSession, sources: list[Source], now: str, previous: DataFrame | None = None, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities of all lists, and the catalog: id, title, version, entitiesCount, fetchedAt, stale, staleReason.

    A list that can't be staged is taken from `previous`, with its old age and version and stale set; if it isn't there,
    nothing is published.
    """
    parts, rows = [], []
    old = {r["id"]: r for r in catalog.collect()} if catalog is not None else {}
    for s in sources:
        try:
            wire, report = stage(spark, s)
            version = wire.agg(F.max("list_version")).first()[0]
            rows.append((s.list_id, s.title, version, report["entities"], now, False, None))
        except Exception as e:
            if previous is None or s.list_id not in old:
                raise ValueError(f"{s.list_id} can't be staged and has no earlier version: {e}") from e
            wire = previous.where(F.col("source_list") == s.list_id)
            was = old[s.list_id]
            rows.append((s.list_id, s.title, was["version"], was["entitiesCount"], was["fetchedAt"], True, str(e)[:200]))
        parts.append(wire)
    entities = parts[0]
    for part in parts[1:]:
        entities = entities.unionByName(part)
    return entities, spark.createDataFrame(sorted(rows), "id string, title string, version string, entitiesCount long, fetchedAt string, stale boolean, staleReason string")
