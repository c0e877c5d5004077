import pytest
from pyspark.sql import functions as F

from vigilframe.operators import blocking, gates, scoring, screen

IVANOV = "vladimir ivanov"
# preset, query (name, dob, country, type, vector, lexical), entity (aliases, dob, countries), score, summary, contributions
CASES = [
    ("balanced", (IVANOV, None, "RU", None, 1.0, 1.0), ([], [], ["RU"]), 0.8, "Match due to: strong vector similarity, strong name match, country match", "Exact country match: RU"),
    ("balanced", (IVANOV, None, "CA", None, 1.0, 1.0), ([], [], ["US", "CA"]), 0.775, "Match due to: strong vector similarity, strong name match, country match", "Country match: CA in [CA, US]"),
    ("balanced", (IVANOV, None, "JP", None, 1.0, 1.0), ([], [], ["US", "CA"]), 0.75, "Match due to: strong vector similarity, strong name match", "No country match: JP not in [CA, US]"),
    ("balanced", ("v ivanov", None, None, None, 0.7, 0.5), ([("V. Ivanov", "v ivanov")], [], []), 0.835, "Match due to: alias match", "Alias match: V. Ivanov"),
    ("balanced", (IVANOV, "1970-01-01", None, None, 1.0, 1.0), ([], ["1970-06-15"], []), 0.8, "Match due to: strong vector similarity, strong name match, DOB match", "Year match: 1970"),
    ("lenient", (IVANOV, "1970-01-01", "RU", "PERSON", 1.0, 1.0), ([], ["1970-01-01"], ["RU"]), 0.85, "Match due to: strong vector similarity, strong name match, DOB match, country match", "Entity type match: PERSON"),
    ("balanced", (IVANOV, None, None, None, 0.1, 0.1), ([], [], []), 0.07500000000000001, "Low confidence match (score: 0.075)", "No entity type specified in query"),
    ("balanced", (IVANOV, None, None, "ORGANIZATION", 1.0, 1.0), ([], [], []), 0.75, "Match due to: strong vector similarity, strong name match", "Entity type mismatch: PERSON != ORGANIZATION"),
    ("balanced", (IVANOV, None, None, None, 0.7, 0.6), ([("Vladimir Ivanov II", "vladimir ivanov ii")], [], []), 0.68, "Match due to: alias match", "Alias match: Vladimir Ivanov II"),
    ("balanced", (IVANOV, "1985-01-01", None, None, 1.0, 1.0), ([], ["1970-06-15"], []), 0.75, "Match due to: strong vector similarity, strong name match", "No DOB match"),
]


@pytest.mark.parametrize("preset", ["balanced", "lenient"])
def test_golden_scores(spark, preset):
    cases = {i: c for i, c in enumerate(CASES) if c[0] == preset}
    rows = [(i, *q, [{"name": n, "name_canonical": c} for n, c in e[0]], e[1], e[2], "PERSON") for i, (_, q, e, *_) in cases.items()]
    pairs = spark.createDataFrame(rows, "i int, query_canonical string, query_dob string, query_country string, query_type string, vector_similarity double, lexical_similarity double, aliases array<struct<name:string,name_canonical:string>>, dob array<string>, countries array<string>, entity_type string")
    got = {r["i"]: r for r in scoring.compute_score(scoring.alias_match(pairs, ["i"]), preset).collect()}
    for i, (_, _, _, score, summary, text) in cases.items():
        assert abs(got[i]["score"] - score) < 1e-10 and got[i]["summary"] == summary
        assert text in [r["description"] for r in got[i]["reasons"]]
        assert got[i]["reasons"][0]["signal"] == "name_vector" and got[i]["reasons"][-1]["signal"] == "entity_type_match"


def test_first_dob_shadows_a_later_exact_one(spark):
    score, text = scoring.dob_signal(F.array(F.lit("1970-06-15"), F.lit("1970-01-01")), F.lit("1970-01-01"))
    row = spark.range(1).select(score.alias("s"), text.alias("t")).first()
    assert row["s"] == 0.5 and row["t"] == "Year match: 1970"


@pytest.mark.parametrize(("score", "tier"), [(0.95, "STRONG"), (0.8, "STRONG"), (0.7999999, "POSSIBLE"), (0.65, "POSSIBLE"), (0.6499999, "WEAK"), (0.0, "WEAK")])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(gates.classify_tier(F.lit(score), F.lit(0.65)).alias("t")).first()["t"] == tier


def test_strictness_boundaries(spark):
    grid = spark.createDataFrame([(s, x, c) for s in (0.29, 0.3, 0.39, 0.4, 0.41) for x in (0.34, 0.35, 0.5) for c in (True, False)], "s double, x double, c boolean")
    kept, primary = gates.verdicts(F.col("s"), F.col("x"), F.col("c"))
    for r in grid.select("*", kept.alias("k"), primary.alias("p")).collect():
        assert ("lenient" in r["k"]) == (r["s"] >= 0.3)
        assert ("balanced" in r["k"]) == (r["s"] >= 0.3 and (r["x"] >= 0.35 or r["c"]))
        assert ("strict" in r["k"]) == (r["s"] >= 0.4 and (r["x"] >= 0.5 or r["c"]))
        assert ("balanced" in r["p"]) == ("balanced" in r["k"] and r["s"] >= 0.4)


def test_blocking_cutoff_and_cap(spark):
    names = ["musa abu marzuk", "musa khan", "alpha company", "beta company", "gamma company"]
    entities = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name_canonical string")
    posted = blocking.postings(entities)
    assert {r["key"] for r in posted.where("kind = 'token'").collect()} == {"abu", "marzuk", "khan", "alpha", "beta", "gamma"}
    asked = spark.createDataFrame([(1, "marzook"), (2, "company"), (3, "")], "qid long, name_canonical string")
    assert {(r["qid"], r["id"]) for r in blocking.candidates(asked, posted, entities).collect()} == {(1, 0)}
    wide = blocking.postings(entities, ratio=1.0, phonetic=False)
    capped = blocking.candidates(spark.createDataFrame([(1, "alpha company")], "qid long, name_canonical string"), wide, entities, cap=1, phonetic=False)
    assert [(r["qid"], r["id"]) for r in capped.collect()] == [(1, 2)]


def test_screen_finds_an_alias_and_keeps_list_floors(spark):
    vec = [1.0, 0.0]
    entities = spark.createDataFrame(
        [(1, "A", "v1", "PERSON", "Musa Abu Marzuk", "musa abu marzuk", [{"name": "Abu Umar", "name_canonical": "abu umar"}], ["1951"], ["PS"]), (2, "B", "v7", "PERSON", "Boris Petrov", "boris petrov", [], [], [])],
        "id long, list_id string, list_version string, entity_type string, primary_name string, name_canonical string, aliases array<struct<name:string,name_canonical:string>>, dob array<string>, countries array<string>",
    )
    vectors = spark.createDataFrame([(1, vec), (2, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, "Umar, ABU", vec, "1951", 0.3), (2, "Nobody", [0.0, 1.0], None, 0.3)], "qid long, name string, vector array<double>, dob string, threshold double")
    got = screen.screen(queries, entities, vectors, per_list={"B": 0.99}).collect()
    assert [(r["qid"], r["id"], r["tier"]) for r in got] == [(1, 1, "STRONG")]
    assert got[0]["summary"] == "Match due to: strong vector similarity, alias match, DOB match"
    assert screen.screen(queries, entities, vectors, enabled=[]).count() == 0


def test_search_by_blocks_equals_search_at_once(spark):
    import numpy as np

    from vigilframe.operators import vector_search

    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    rows = spark.createDataFrame([(i, unit(rng.normal(size=8)), f"l{i % 2}") for i in range(300)] + [(999, None, "l0")], "id long, vector array<double>, list_id string")
    asked = rows.where("id % 7 = 0").select(F.col("id").alias("qid"), "vector").unionByName(spark.createDataFrame([(-1, None)], "qid long, vector array<double>"))
    for source in (rows, rows.drop("list_id")):
        at_once, dealt = ({tuple(r) for r in vector_search.topk_exact(asked, source, 5, most=n).collect()} for n in (1000, 10))
        assert at_once == dealt and len(at_once) == 43 * 5 * (2 if source is rows else 1)
    assert vector_search.topk_exact(asked.limit(0), rows, 5).count() == 0
    with pytest.raises(Exception, match="the vector of 5 has 2 numbers, not 8"):
        vector_search.topk_exact(asked, spark.createDataFrame([(5, [1.0, 0.0])], "id long, vector array<double>"), 5).collect()


@pytest.mark.parametrize("equal", [False, True])
def test_many_queries_taken_from_the_rows_themselves(spark, equal):
    """More queries than are sent to all tasks, with the rows' own columns; equal vectors are asked once, all queries get rows."""
    import numpy as np

    from vigilframe.operators import vector_search

    rng = np.random.default_rng(6)
    made = [v / np.linalg.norm(v) for v in rng.normal(size=(3 if equal else 120, 8))]
    vectors = {i: made[i % len(made)] for i in range(120)}
    rows = spark.createDataFrame([(i, v.tolist(), f"l{i % 2}") for i, v in vectors.items()], "id long, vector array<double>, list_id string")
    asked = rows.where("id % 2 = 0").join(rows.select("id", F.col("list_id").alias("name")), "id").select(F.col("id").alias("qid"), "name", "vector")
    for most in (5, 20, 1000):
        got = {(r["qid"], r["list_id"], r["rank"]): r["id"] for r in vector_search.topk_exact(asked.select("qid", "vector"), rows, 4, most=most).collect()}
        want = {}
        for q in range(0, 120, 2):
            for name in (0, 1):
                best = sorted((-round(float(vectors[q] @ vectors[i]), 6), i) for i in range(name, 120, 2))[:4]
                want |= {(q, f"l{name}", k + 1): i for k, (_, i) in enumerate(best)}
        assert got == want


def test_first_of_long_lines_equals_a_full_sort():
    import numpy as np

    from vigilframe.operators.vector_search import _first

    rng = np.random.default_rng(7)
    cosines, ids = np.round(rng.random((20, 300)), 1), rng.permutation(300)
    want = np.lexsort((np.broadcast_to(ids, cosines.shape), -cosines), axis=1)[:, :9]
    assert (_first(cosines, ids, 9) == want).all() and (_first(cosines[:, :10], ids[:10], 9)[:, :1] >= 0).all()


def test_aliases_and_names_without_values(spark):
    pairs = spark.createDataFrame([(1, "ann", None, None), (2, "ann", [], []), (3, "ann", [("B", None), ("A", "ann")], ["bob", "ann"]), (4, None, [("C", "c"), ("D", "c")], [None])], "i int, q string, aliases array<struct<name:string,name_canonical:string>>, names array<string>")
    got = {r["i"]: (r["alias_score"], r["alias_name"], r["lexical_similarity"]) for r in scoring.alias_match(scoring.best_name_similarity(pairs, "q", "names"), None, "q").collect()}
    assert got == {1: (0.0, None, 0.0), 2: (0.0, None, 0.0), 3: (1.0, "A", 1.0), 4: (0.0, None, 1.0)}
