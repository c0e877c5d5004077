"""The review ledger as DataFrames: customers, current matches, append-only events, settings.

Each function takes the state's tables and returns new ones; VersionedStore keeps them as versions behind a pointer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = "match_id string, customer_id string, entity_id string, score double, tier string, fingerprint string, resolution string, review_state string, reviewer string, notes string, at string"
EVENTS = "event_id string, match_id string, customer_id string, entity_id string, type string, from_status string, to_status string, fingerprint string, at string"
CUSTOMERS = "customer_id string, reference string, name string, dob string, country string, status string, onboarded_by string, created_at string"
RESOLUTIONS = r"^(?:FALSE_POSITIVE|TRUE_POSITIVE|RESOLVED)$"


def make_id(*parts: Column | str) -> Column:
    """An id that depends on its parts only, so a job that runs again makes the same rows."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256).substr(1, 32)


def create_customers(customers: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """All customers with the new ones (reference, name, dob, country, onboarded_by), or an error if a reference is taken
    or comes twice: all or none."""
    taken = new.join(customers.select("reference"), "reference", "left_semi").select("reference").unionByName(new.groupBy("reference").count().where("count > 1").select("reference"))
    first = taken.orderBy("reference").first()
    if first is not None:
        raise ValueError(f"reference {first[0]} exists")
    rows = new.select(make_id(F.lit("customer"), "reference").alias("customer_id"), "reference", "name", "dob", "country", F.lit("PENDING_REVIEW").alias("status"), F.coalesce("onboarded_by", F.lit("local")).alias("onboarded_by"), F.lit(at).alias("created_at"))
    return customers.unionByName(rows)


def update_customers(customers: DataFrame, patch: DataFrame) -> DataFrame:
    """Name, country and status from the patch where they are not blank; nothing can be set to null."""
    p = patch.select("customer_id", *[F.nullif(F.trim(c), F.lit("")).alias(f"p_{c}") for c in ("name", "country", "status")])
    joined = customers.join(p, "customer_id", "left")
    return joined.select(*[F.coalesce(f"p_{c}", c).alias(c) if f"p_{c}" in joined.columns else F.col(c) for c in customers.columns])


def record_matches(matches: DataFrame, events: DataFrame, new: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Upsert by customer and entity: fields are refreshed, the match is pending and current again and keeps its id and
    reviewer; each new row adds a DETECTED event."""
    n = new.select("customer_id", "entity_id", F.struct("score", "tier", "fingerprint").alias("n"))
    both = matches.join(n, ["customer_id", "entity_id"], "full")
    hit = F.col("n").isNotNull()
    merged = both.select(
        F.coalesce("match_id", make_id(F.lit("match"), "customer_id", "entity_id", F.lit(at))).alias("match_id"), "customer_id", "entity_id",
        F.when(hit, F.col("n.score")).otherwise(F.col("score")).alias("score"), F.when(hit, F.col("n.tier")).otherwise(F.col("tier")).alias("tier"), F.when(hit, F.col("n.fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(hit, "PENDING").otherwise(F.col("resolution")).alias("resolution"), F.when(hit, "CURRENT").otherwise(F.col("review_state")).alias("review_state"), "reviewer", "notes", F.when(hit, F.lit(at)).otherwise(F.col("at")).alias("at"), hit.alias("__hit"),
    )
    added = _events(merged.where("__hit"), F.lit("DETECTED"), F.lit(None), F.lit("PENDING"), at)
    return merged.drop("__hit"), events.unionByName(added)


def _events(rows: DataFrame, kind: Column, before: Column, after: Column, at: str) -> DataFrame:
    return rows.select(
        make_id(F.lit("event"), "customer_id", "entity_id", kind, F.lit(at)).alias("event_id"), "match_id", "customer_id", "entity_id", kind.alias("type"), before.cast("string").alias("from_status"), after.cast("string").alias("to_status"), "fingerprint", F.lit(at).alias("at")
    )


def plan_replacement(prior: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (customer, entity) of either side with what replacing does: action, resolution and review_state.

    No prior match: PENDING and DETECTED. A prior match without fingerprint adopts the new one silently; with the same
    one it stays as it is; with another one its disposition stays and the match is CHANGED. A prior match without new one
    is SUPPRESSED. Both sides are unique by (customer_id, entity_id).
    """
    p = prior.select("customer_id", "entity_id", F.col("fingerprint").alias("p_fp"), F.col("resolution").alias("p_res"), F.col("review_state").alias("p_state"), F.lit(True).alias("p_has"))
    n = new.select("customer_id", "entity_id", F.col("fingerprint").alias("n_fp"), F.lit(True).alias("n_has"))
    both = p.join(n, ["customer_id", "entity_id"], "full")
    action = F.when(F.col("n_has").isNull(), "SUPPRESSED").when(F.col("p_has").isNull(), "DETECTED").when(F.col("p_fp").isNull(), "ADOPTED").when(F.col("p_fp") == F.col("n_fp"), "KEPT").otherwise("CHANGED")
    return both.select(
        "customer_id", "entity_id", action.alias("action"),
        F.when(action == "DETECTED", "PENDING").when(action == "SUPPRESSED", None).otherwise(F.col("p_res")).alias("resolution"),
        F.when(action == "DETECTED", "CURRENT").when(action == "CHANGED", "CHANGED").when(action == "SUPPRESSED", None).otherwise(F.col("p_state")).alias("review_state"),
        "p_res",
    )


def replace_matches(matches: DataFrame, events: DataFrame, new: DataFrame, customers: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The matches of the given customers (customer_id) replaced by the new ones; other customers' matches stay."""
    mine = matches.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    others = matches.join(customers.select("customer_id").distinct(), "customer_id", "left_anti")
    plan = plan_replacement(mine, new)
    kept = mine.select("customer_id", "entity_id", "reviewer", "notes")
    live = plan.where("action <> 'SUPPRESSED'").join(new.select("customer_id", "entity_id", "score", "tier", "fingerprint"), ["customer_id", "entity_id"]).join(kept, ["customer_id", "entity_id"], "left")
    rows = live.select(make_id(F.lit("match"), "customer_id", "entity_id", F.lit(at)).alias("match_id"), "customer_id", "entity_id", "score", "tier", "fingerprint", "resolution", "review_state", "reviewer", "notes", F.lit(at).alias("at"), "action", "p_res")
    changed = _events(rows.where("action in ('DETECTED', 'CHANGED')"), F.col("action"), F.col("p_res"), F.col("resolution"), at)
    gone = plan.where("action = 'SUPPRESSED'").withColumn("match_id", F.lit(None).cast("string")).withColumn("fingerprint", F.lit(None).cast("string"))
    suppressed = _events(gone, F.lit("SUPPRESSED"), F.col("p_res"), F.lit(None), at)
    return others.unionByName(rows.drop("action", "p_res")), events.unionByName(changed).unionByName(suppressed)


def resolve_matches(matches: DataFrame, events: DataFrame, decisions: DataFrame, at: str, analyst: str = "local") -> tuple[DataFrame, DataFrame]:
    """decisions: match_id, decision, reviewer, notes. Overwrites the disposition; the reviewer defaults to the analyst; the
    event tells the true status before."""
    bad = decisions.where(~F.coalesce(F.col("decision").rlike(RESOLUTIONS), F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"{bad['decision']} is no resolution")
    d = decisions.select("match_id", "decision", F.coalesce("reviewer", F.lit(analyst)).alias("d_reviewer"), F.col("notes").alias("d_notes"))
    joined = matches.join(d, "match_id", "left")
    hit = F.col("decision").isNotNull()
    after = joined.select(
        "match_id", "customer_id", "entity_id", "score", "tier", "fingerprint", F.coalesce("decision", "resolution").alias("resolution"), F.when(hit, "CURRENT").otherwise(F.col("review_state")).alias("review_state"),
        F.coalesce("d_reviewer", "reviewer").alias("reviewer"), F.coalesce("d_notes", "notes").alias("notes"), "at",
    )
    return after, events.unionByName(_events(joined.where(hit), F.lit("DISPOSITIONED"), F.col("resolution"), F.col("decision"), at))


def delete_customers(customers: DataFrame, matches: DataFrame, events: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids = gone.select("customer_id").distinct()
    return tuple(t.join(ids, "customer_id", "left_anti") for t in (customers, matches, events))


def check_append_only(before: DataFrame, after: DataFrame, customers: DataFrame) -> None:
    """Raises if an event is missing whose customer is still there, or if one has changed."""
    lost = before.join(after, "event_id", "left_anti").join(customers.select("customer_id"), "customer_id", "left_semi").first()
    if lost is not None:
        raise ValueError(f"event {lost['event_id']} was deleted")
    if not before.join(after.select("event_id"), "event_id", "left_semi").exceptAll(after.select(before.columns)).isEmpty():
        raise ValueError("an event was changed")


def review_board(matches: DataFrame, customers: DataFrame, tier: str | None = None, resolution: str | None = None, review_state: str | None = None, needs_review: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Matches with their customers, filtered, best first (ties by id), one page."""
    rows = matches.join(customers.select("customer_id", "reference", "name", "country"), "customer_id")
    for column, value in (("tier", tier), ("resolution", resolution), ("review_state", review_state)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if needs_review:
        rows = rows.where((F.col("resolution") == "PENDING") | (F.col("review_state") == "CHANGED"))
    return rows.orderBy(F.desc("score"), "match_id").offset(offset).limit(limit)


def match_events(events: DataFrame, match_id: str, customer_id: str, entity_id: str) -> DataFrame:
    """Events of the match or of its pair, in order. A union of two equi-filters, not an OR over a join."""
    found = events.where(F.col("match_id") == match_id).unionByName(events.where((F.col("customer_id") == customer_id) & (F.col("entity_id") == entity_id)))
    return found.dropDuplicates(["event_id"]).orderBy("at", "event_id")


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    return settings.join(new.select("key"), "key", "left_anti").unionByName(new.select(settings.columns))


#: columns that each version of the tables added: version, table, column, type
MIGRATIONS = [(2, "matches", "fingerprint", "string"), (2, "matches", "review_state", "string"), (3, "matches", "notes", "string"), (4, "customers", "onboarded_by", "string")]
HEAD = 4


def migrate(tables: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    """Tables of an older version with the columns that came later, null; at HEAD nothing changes. A newer version is refused."""
    if version > HEAD:
        raise ValueError(f"version {version} is newer than {HEAD}")
    out = dict(tables)
    for since, name, column, kind in MIGRATIONS:
        if since > version and name in out and column not in out[name].columns:
            out[name] = out[name].withColumn(column, F.lit(None).cast(kind))
    return out, HEAD


def customers_page(customers: DataFrame, page: int, size: int = 24) -> tuple[DataFrame, int]:
    """One page of the customers, newest first (ties by id, descending), and its number: pages count from 1, and a number outside
    of them is the nearest one."""
    pages = max(1, -(-customers.count() // size))
    bounded = min(max(page, 1), pages)
    return customers.orderBy(F.desc("created_at"), F.desc("customer_id")).offset((bounded - 1) * size).limit(size), bounded


def pending_count(matches: DataFrame) -> DataFrame:
    """pending: matches that wait for a decision, or whose facts have changed since."""
    return matches.agg(F.count_if((F.col("resolution") == "PENDING") | (F.col("review_state") == "CHANGED")).alias("pending"))


class VersionedStore:
    """Tables as Parquet versions in a folder. A version is made current by a pointer file of its own, whose name has its
    sequence; the highest one counts. A pointer is created once and never changed, so a reader sees the version before or after,
    and of two writers of one sequence the second fails with FileExistsError. What a crash leaves behind has no pointer."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")

    def pointer(self) -> dict:
        """sequence, and the version of each table; a pointer that isn't written to its end doesn't count."""
        if not self._fs.exists(self._at("pointers")):
            return {"sequence": 0, "tables": {}}
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._at("pointers"))), reverse=True)
        for name in (n for n in names if n.startswith("sequence-")):
            read = self.spark.read.text(f"{self.path}/pointers/{name}", wholetext=True).first()
            try:
                return json.loads(read[0])
            except (TypeError, ValueError):
                continue
        return {"sequence": 0, "tables": {}}

    def read(self, name: str, schema: str) -> DataFrame:
        version = self.pointer()["tables"].get(name)
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}")

    def commit(self, **tables: DataFrame) -> int:
        """Write all tables as a new version in folders of their own, then create its pointer: readers see all of it or nothing."""
        now = self.pointer()
        sequence = now["sequence"] + 1
        own = f"{sequence}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/version={own}")
        made = {"sequence": sequence, "tables": now["tables"] | dict.fromkeys(tables, own)}
        target = self._at(f"pointers/sequence-{sequence:020d}")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            if self._fs.exists(target):
                raise FileExistsError(f"sequence {sequence} was committed by another writer") from e
            raise
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return sequence
