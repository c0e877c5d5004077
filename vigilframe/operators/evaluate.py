"""Evaluation: labelled queries, seeded samples, recall, confusion metrics, floors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.similarity import token_set_col, token_sort_col

MASK = 0xFFFFFFFF


def mulberry32(seed: int) -> Callable[[], float]:
    """A generator of numbers in [0, 1) with 32 bits of state."""
    state = seed & MASK

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & MASK
        t = (state ^ state >> 15) * (state | 1) & MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & MASK)) & MASK
        return ((t ^ t >> 14) & MASK) / 0x100000000

    return draw


def sample_positions(n: int, size: int, seed: int) -> list[int]:
    """Positions of a seeded sample without repeats, in rising order: all if size >= n, none if size <= 0.

    Only positions that were swapped are held, so the driver keeps 2 * size numbers, not n.
    """
    if size <= 0:
        return []
    if size >= n:
        return list(range(n))
    draw, moved = mulberry32(seed), {}
    for i in range(size):
        j = i + int(draw() * (n - i))
        moved[i], moved[j] = moved.get(j, j), moved.get(i, i)
    return sorted(moved[i] for i in range(size))


def sample_rows(rows: DataFrame, ordinal: str, n: int, size: int, seed: int) -> DataFrame:
    """Rows at the sampled positions; ordinal counts from 0."""
    spark = rows.sparkSession
    chosen = spark.createDataFrame([(p,) for p in sample_positions(n, size, seed)], "__p long")
    return rows.join(chosen, F.col(ordinal) == F.col("__p"), "left_semi")


def owner_index(names: DataFrame) -> DataFrame:
    """canonical, owners (sorted set of ids) of names (id, canonical); empty names left out."""
    return names.where("canonical <> ''").groupBy("canonical").agg(F.array_sort(F.collect_set("id")).alias("owners"))


def labelled_queries(names: DataFrame) -> DataFrame:
    """query, canonical, kind, expected: each canonical name once with its first spelling.

    names: id, ordinal, name, canonical, kind ('alias' or 'canonical'), own (the entity's primary canonical). Aliases that
    equal the entity's own name are left out.
    """
    kept = names.where("canonical <> ''").where((F.col("kind") == "canonical") | (F.col("canonical") != F.col("own")))
    first = kept.groupBy("kind", "canonical").agg(F.min_by("name", F.struct("ordinal", "name")).alias("query"), F.min("ordinal").alias("ordinal"))
    return first.join(owner_index(names), "canonical").select("query", "canonical", "kind", F.col("owners").alias("expected"), "ordinal")


def first_expected_rank(results: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, rank of the first returned expected id, null if none. results: qid, id, rank. expected: qid, id."""
    hit = results.join(expected, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return expected.select("qid").distinct().join(hit, "qid", "left")


def recall_at(ranks: DataFrame, cutoffs: list[int]) -> DataFrame:
    """k, n, hits, recall, absent, absent_rate; rates are 0 for no queries."""
    spread = ranks.select("rank", F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k"))
    got = spread.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= F.col("k")).alias("hits"), F.count_if(F.col("rank").isNull()).alias("absent"))
    rate = lambda a: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col("n").cast("double")), F.lit(0.0))
    return got.select("k", "n", "hits", rate("hits").alias("recall"), "absent", rate("absent").alias("absent_rate"))


def missing_rows(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Expected pairs that did not come back, as rows without rank and with score 0."""
    return expected.join(returned.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(None).cast("int").alias("rank"), F.lit(0.0).alias("score"))


def binary_report(rows: DataFrame, by: list[str], truth: str = "truth", alerted: str = "alerted", drop_single: bool = True) -> DataFrame:
    """Counts and rates for each group. Groups of one class only are dropped, or refused if drop_single is false."""
    t, p = F.col(truth).cast("boolean"), F.col(alerted).cast("boolean")
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(t).alias("positives"), F.count_if(p).alias("alerts"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    single = (F.col("positives") == 0) | (F.col("positives") == F.col("n"))
    if drop_single:
        counted = counted.where(~single)
    else:
        counted = counted.withColumn("n", F.when(single, F.raise_error(F.lit("only one class"))).otherwise(F.col("n")))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counted.select(*by, "n", "positives", "alerts", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), rate(tp + tn, F.col("n")).alias("accuracy"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"))


def discrimination(rows: DataFrame, by: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """ROC-AUC by rank sums (ties share their mean rank) and average precision, for each group.

    Rows are first counted by score, so the window sorts distinct scores, not rows.
    """
    t = F.col(truth).cast("boolean")
    at = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(t).alias("p"), F.count("*").alias("n"))
    keys = [F.col(b) for b in by] or [F.lit(1)]
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = at.withColumn("under", F.coalesce(F.sum(F.col("n") - F.col("p")).over(below), F.lit(0))).withColumn("tp", F.sum("p").over(above)).withColumn("seen", F.sum("n").over(above))
    won = F.sum(F.col("p") * (F.col("under") + (F.col("n") - F.col("p")) / 2))
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return w.groupBy(*by).agg(F.try_divide(won, pos * neg).alias("roc_auc"), F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), pos).alias("pr_auc"))


def decision_cells(candidates: DataFrame) -> DataFrame:
    """Confusion metrics for each (unit, pool, level, band) of candidates (qid, segment, truth, kept, primary: arrays of
    levels). Pools overlap, so a row is spread to all pools it is in; single-class cells are dropped."""
    pools = F.array(F.lit("all"), F.col("segment"))
    bands = F.array(F.struct(F.lit("kept").alias("band"), F.col("kept").alias("on")), F.struct(F.lit("primary").alias("band"), F.col("primary").alias("on")))
    levels = F.array(F.lit("lenient"), F.lit("balanced"), F.lit("strict"))
    rows = candidates.select("qid", "truth", "segment", F.explode(pools).alias("pool"), "kept", "primary").select("qid", "truth", "pool", F.explode(bands).alias("b")).select("qid", "truth", "pool", "b.band", "b.on", F.explode(levels).alias("level"))
    pair = rows.select("pool", "level", "band", "truth", F.array_contains("on", F.col("level")).alias("alerted"))
    query = rows.groupBy("qid", "pool", "level", "band").agg(F.max("truth").alias("truth"), F.max(F.array_contains("on", F.col("level"))).alias("alerted"))
    both = pair.withColumn("unit", F.lit("pair")).unionByName(query.drop("qid").withColumn("unit", F.lit("query")))
    return binary_report(both, ["unit", "pool", "level", "band"])


def is_true_match(expected: Column, verdict: Column, containment: Column) -> Column:
    return expected | ((F.coalesce(verdict, F.lit("false-positive")) == "review") & containment)


def pair_study(pairs: DataFrame) -> DataFrame:
    """pairs (label, a, b) with token_set, token_sort and shared_key."""
    from vigilframe.functions.similarity import phonetic_keys_col

    keys = lambda c: F.array_distinct(F.flatten(F.transform(F.split(c, " "), lambda t: F.array(t))))
    scored = pairs.withColumn("token_set", token_set_col("a", "b")).withColumn("token_sort", token_sort_col("a", "b"))
    for side in ("a", "b"):
        spoken = pairs.select(side).distinct().select(side, F.explode(keys(F.col(side))).alias("t")).withColumn("k", phonetic_keys_col("t"))
        scored = scored.join(spoken.groupBy(side).agg(F.flatten(F.collect_set("k")).alias(f"keys_{side}")), side, "left")
    shared = F.coalesce(F.arrays_overlap("keys_a", "keys_b"), F.lit(False))
    return scored.withColumn("shared_key", shared).drop("keys_a", "keys_b")


def clean_names(people: DataFrame, owners: DataFrame, count: int, seed: int, budget: int = 200) -> list[str]:
    """Seeded negatives: the head of one donor's name and the tail of another's, not owned by any entity.

    people: ordinal (from 0), canonical of at least two tokens. Only drawn positions are fetched.
    """
    n = people.count()
    draw, out, tries = mulberry32(seed), [], 0
    while len(out) < count and tries < budget * count and n > 1:
        pairs = [(int(draw() * n), int(draw() * n)) for _ in range(min(4 * count, budget * count - tries))]
        tries += len(pairs)
        wanted = people.where(F.col("ordinal").isin(sorted({p for x in pairs for p in x}))).select("ordinal", "canonical").collect()
        names = {r["ordinal"]: r["canonical"].split() for r in wanted}
        made = [f"{names[a][0]} {names[b][-1]}" for a, b in pairs if a != b and names[a][0] != names[b][-1]]
        taken = {r[0] for r in owners.where(F.col("canonical").isin(sorted(set(made)))).select("canonical").collect()} if made else set()
        out += [m for m in dict.fromkeys(made) if m not in taken and m not in out]
    if len(out) < count:
        raise ValueError(f"{count} negatives asked for, {len(out)} found")
    return out[:count]


def plain_names(given: list[str], family: list[str], owners: DataFrame, tokens: DataFrame, count: int, seed: int, budget: int = 200) -> list[str]:
    """Seeded negatives that share nothing with the list: neither token is one of its tokens, and no entity has the name.

    given and family are word lists of the caller; tokens (key) is the list's vocabulary. Only drawn words are looked up.
    """
    used = {r[0] for r in tokens.where(F.col("key").isin(sorted({*given, *family}))).select("key").distinct().collect()}
    draw, out = mulberry32(seed), {}
    for _ in range(budget * count):
        if len(out) >= count:
            break
        a, b = given[int(draw() * len(given))], family[int(draw() * len(family))]
        if a not in used and b not in used:
            out[f"{a} {b}"] = None
    owned = {r[0] for r in owners.where(F.col("canonical").isin(list(out))).select("canonical").collect()} if out else set()
    made = [n for n in out if n not in owned]
    if len(made) < count:
        raise ValueError(f"{count} negatives asked for, {len(made)} found")
    return made


def cross_pairs(names: DataFrame, n: int, owners: DataFrame, count: int, seed: int) -> DataFrame:
    """label 0, a, b: seeded pairs of names of different entities that no entity owns together.

    names: ordinal (from 0, below n), id, canonical. Pairs are drawn as positions on the driver, a few more than asked for, and
    meet their names by two joins; pairs of one entity or with a common owner are left out.
    """
    draw = mulberry32(seed)
    drawn = [(k, int(draw() * n), int(draw() * n)) for k in range(2 * count)]
    spark = names.sparkSession
    pairs = spark.createDataFrame(drawn, "k long, i long, j long")
    owned = names.join(owners, "canonical").select("ordinal", "id", "canonical", "owners")
    side = lambda c, p: owned.select(F.col("ordinal").alias(c), F.col("id").alias(f"{p}_id"), F.col("canonical").alias(p), F.col("owners").alias(f"{p}_owners"))
    met = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j")
    kept = met.where((F.col("a_id") != F.col("b_id")) & ~F.arrays_overlap("a_owners", "b_owners"))
    return kept.orderBy("k").limit(count).select(F.lit(0).alias("label"), "a", "b")


def nearest_rank(rows: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the smallest value that at least the share of the rows doesn't exceed."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) within group (order by `{value}`)").cast(rows.schema[value].dataType).alias(name) for name, p in ranks.items()])


def vocabulary(names: DataFrame, column: str = "canonical") -> DataFrame:
    """key: the distinct tokens of all names."""
    return names.select(F.explode(F.split(column, " ")).alias("key")).where("key <> ''").distinct()


def in_segments(queries: DataFrame, segments: list[str]) -> DataFrame:
    return queries.where(F.col("segment").isin(segments))


def absent(ranks: DataFrame) -> DataFrame:
    """Queries whose expected entity never came back."""
    return ranks.where("rank is null")


def study_report(pairs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, and the confusion metrics of each rule over the pairs (label)."""
    spread = pairs.select((F.col("label") == 1).alias("truth"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("alerted")) for n, c in rules.items()])).alias("r"))
    return binary_report(spread.select("truth", "r.*"), ["rule"])


def separation(rows: DataFrame, by: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """The lowest score of a true match, the highest of another, and whether a threshold tells all of them apart."""
    t = F.col(truth).cast("boolean")
    got = rows.groupBy(*by).agg(F.min(F.when(t, F.col(score))).alias("lowest_true"), F.max(F.when(~t, F.col(score))).alias("highest_false"))
    return got.withColumn("separable", F.coalesce(F.col("lowest_true") > F.col("highest_false"), F.lit(False)))


def new_saturation(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Floors (kind, bound) that can't fail any more and could before; a floor that is new counts."""
    dull = F.when(F.col("kind") == "min", F.col("bound") <= 0).otherwise(F.col("bound") >= 1)
    return now.where(dull).join(before.where(dull).select(*keys), keys, "left_anti")


def slack(n: int, tolerance: float = 0.02) -> float:
    """How far a rate may fall: a bound that tightens with the number of rows."""
    return round(min(tolerance, 40 / n), 4) if n else tolerance


def floors_from(report: DataFrame, metrics: dict[str, str], by: list[str]) -> list[dict]:
    """Bounds of each metric ('min' or 'max') of the few rows of a report, with slack."""
    out = []
    for row in report.collect():
        for metric, kind in metrics.items():
            value, s = row[metric], slack(row["n"])
            bound = max(0.0, value - s) if kind == "min" else min(1.0, value + s)
            out.append({b: row[b] for b in by} | {"metric": metric, "kind": kind, "bound": round(bound, 4)})
    return out


def toothless(floor: dict) -> bool:
    return floor["bound"] <= 0 if floor["kind"] == "min" else floor["bound"] >= 1


def ratchet(new: list[dict], old: list[dict] | None) -> list[dict]:
    """Bounds only get tighter."""
    name = lambda f: tuple(sorted((k, v) for k, v in f.items() if k != "bound"))
    before = {name(f): f["bound"] for f in old or []}
    tighter = lambda f: max(f["bound"], before.get(name(f), -math.inf)) if f["kind"] == "min" else min(f["bound"], before.get(name(f), math.inf))
    return [f | {"bound": tighter(f)} for f in new]


def failures(report: DataFrame, floors: list[dict], by: list[str]) -> list[str]:
    """What breaks a floor, also a floor whose row is gone."""
    rows, out = {tuple(r[b] for b in by): r for r in report.collect()}, []
    for f in floors:
        row = rows.get(tuple(f[b] for b in by))
        if row is None:
            out.append(f"{f}: no such row")
        elif (row[f["metric"]] < f["bound"]) if f["kind"] == "min" else (row[f["metric"]] > f["bound"]):
            out.append(f"{f}: {row[f['metric']]}")
    return out
