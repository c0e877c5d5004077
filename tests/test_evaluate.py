import pytest

from vigilframe.operators import evaluate, integrity, vector_search
from vigilframe.streaming import incremental


def test_sampling_is_seeded_and_whole():
    draw = evaluate.mulberry32(1)
    first = [draw() for _ in range(3)]
    assert first == [(lambda d: [d() for _ in range(3)])(evaluate.mulberry32(1))[i] for i in range(3)] and all(0 <= x < 1 for x in first)
    got = evaluate.sample_positions(1000, 50, 7)
    assert got == sorted(set(got)) and len(got) == 50 and got == evaluate.sample_positions(1000, 50, 7) != evaluate.sample_positions(1000, 50, 8)
    assert evaluate.sample_positions(3, 5, 1) == [0, 1, 2] and evaluate.sample_positions(3, 0, 1) == []


def test_confusion_and_auc(spark):
    rows = spark.createDataFrame([("g", True, True, 0.9), ("g", True, False, 0.2), ("g", False, False, 0.2), ("g", False, True, 0.5), ("one", True, True, 1.0)], "g string, truth boolean, alerted boolean, score double")
    got = evaluate.binary_report(rows, ["g"]).collect()
    assert len(got) == 1 and got[0]["precision"] == got[0]["recall"] == got[0]["fpr"] == got[0]["fnr"] == 0.5
    with pytest.raises(Exception, match="one class"):
        evaluate.binary_report(rows, ["g"], drop_single=False).collect()
    auc = evaluate.discrimination(rows.where("g = 'g'"), []).first()
    assert auc["roc_auc"] == (1 + 1 + 0 + 0.5) / 4
    assert auc["pr_auc"] == pytest.approx((1 / 1 + 2 / 4) / 2)


def test_recall_and_missing(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "qid long, id long, rank int")
    expected = spark.createDataFrame([(1, 11), (2, 13), (3, 14)], "qid long, id long")
    ranks = evaluate.first_expected_rank(results, expected)
    assert {r["qid"]: r["rank"] for r in ranks.collect()} == {1: 2, 2: None, 3: None}
    assert {r["k"]: (r["hits"], r["absent"]) for r in evaluate.recall_at(ranks, [1, 2]).collect()} == {1: (0, 2), 2: (1, 2)}
    assert {(r["qid"], r["id"], r["score"]) for r in evaluate.missing_rows(expected, results).collect()} == {(2, 13, 0.0), (3, 14, 0.0)}


def test_labels_and_negatives(spark):
    names = spark.createDataFrame([(1, 0, "Ann Lee", "ann lee", "canonical", "ann lee"), (1, 0, "ANN LEE", "ann lee", "alias", "ann lee"), (2, 1, "A. Lee", "a lee", "alias", "bob"), (2, 1, "Bob", "bob", "canonical", "bob"), (3, 2, "a lee", "a lee", "canonical", "a lee")], "id long, ordinal long, name string, canonical string, kind string, own string")
    got = {(r["kind"], r["canonical"]): (r["query"], r["expected"]) for r in evaluate.labelled_queries(names).collect()}
    assert got == {("canonical", "ann lee"): ("Ann Lee", [1]), ("canonical", "bob"): ("Bob", [2]), ("canonical", "a lee"): ("a lee", [2, 3]), ("alias", "a lee"): ("A. Lee", [2, 3])}
    people = spark.createDataFrame([(i, f"first{i} last{i}") for i in range(20)], "ordinal long, canonical string")
    owners = spark.createDataFrame([("first1 last2",)], "canonical string")
    made = evaluate.clean_names(people, owners, 15, 3)
    assert len(set(made)) == 15 and "first1 last2" not in made and made == evaluate.clean_names(people, owners, 15, 3)
    with pytest.raises(ValueError, match="asked for"):
        evaluate.clean_names(people.limit(1), owners, 1, 3)


def test_plain_negatives_and_cross_pairs(spark):
    owners = spark.createDataFrame([("ann lee", [1]), ("bob ray", [2, 3]), ("cy poe", [3])], "canonical string, owners array<long>")
    tokens = spark.createDataFrame([("ann",), ("lee",)], "key string")
    made = evaluate.plain_names(["ann", "zoe", "max"], ["lee", "kim", "roe"], owners, tokens, 4, 5)
    assert sorted(made) == ["max kim", "max roe", "zoe kim", "zoe roe"]
    with pytest.raises(ValueError, match="asked for"):
        evaluate.plain_names(["ann"], ["kim"], owners, tokens, 1, 5)
    names = spark.createDataFrame([(0, 1, "ann lee"), (1, 2, "bob ray"), (2, 3, "cy poe")], "ordinal long, id long, canonical string")
    got = [(r["a"], r["b"]) for r in evaluate.cross_pairs(names, 3, owners, 6, 11).collect()]
    assert got and all({a, b} in ({"ann lee", "bob ray"}, {"ann lee", "cy poe"}) for a, b in got)


def test_floors_only_tighten(spark):
    report = spark.createDataFrame([("a", 10_000, 0.9, 0.1)], "g string, n long, recall double, fpr double")
    floors = evaluate.floors_from(report, {"recall": "min", "fpr": "max"}, ["g"])
    assert [f["bound"] for f in floors] == [0.896, 0.104] and not evaluate.failures(report, floors, ["g"])
    worse = spark.createDataFrame([("a", 10_000, 0.8, 0.1)], "g string, n long, recall double, fpr double")
    assert len(evaluate.failures(worse, floors, ["g"])) == 1 and len(evaluate.failures(worse.where("false"), floors, ["g"])) == 2
    assert [f["bound"] for f in evaluate.ratchet(evaluate.floors_from(worse, {"recall": "min"}, ["g"]), floors)] == [0.896]
    assert evaluate.toothless({"kind": "min", "bound": 0}) and evaluate.slack(0) == 0.02


def test_chunks(spark):
    import hashlib

    parts = [b"abc", b"def"]
    name = [hashlib.sha256(p).hexdigest() for p in parts]
    files = spark.createDataFrame([("a/x", hashlib.sha256(b"abcdefabc").hexdigest(), [(name[0], 3), (name[1], 3), (name[0], 3)]), ("b", "00", [])], "path string, sha256 string, chunks array<struct<hash:string,size:long>>")
    chunks = integrity.chunk_table(integrity.scoped_files(files, ["a/"]))
    store = spark.createDataFrame([(name[0], bytearray(parts[0]))], "hash string, content binary")
    assert tuple(integrity.needed_bytes(chunks, store).first()) == (1, 3) and integrity.reused_chunks(chunks, store).count() == 1
    assert [tuple(r) for r in integrity.verify_chunks(chunks, store).collect()] == [(name[1], "missing")]
    whole = store.union(spark.createDataFrame([(name[1], bytearray(parts[1]))], "hash string, content binary"))
    assert bytes(integrity.reassemble(chunks, whole).first()["content"]) == b"abcdefabc"
    assert integrity.next_sequence(None) == 1
    with pytest.raises(ValueError, match="EU: 0"):
        integrity.check_counts(spark.createDataFrame([("UN",)], "list_id string"), {"UN": (1, 2), "EU": (1, 9)})


def test_exact_search_breaks_ties_and_keeps_zero_queries(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "qid long, vector array<double>")
    got = {(r["qid"], r["rank"]): (r["id"], r["cosine"]) for r in vector_search.topk_exact(asked, rows, 2).collect()}
    assert got == {(7, 1): (1, 1.0), (7, 2): (3, 1.0), (8, 1): (1, 0.0), (8, 2): (2, 0.0)}
    with pytest.raises(Exception, match="no vector"):
        vector_search.similarity_of(spark.createDataFrame([(9, [1.0, 0.0])], "id long, query_vector array<double>"), rows).collect()


def test_versions_stream_is_idempotent(spark, tmp_path):
    folder = tmp_path / "versions"
    folder.mkdir()
    seen, current = [], {"n": 0}

    def on(version, sequence):
        seen.append(version)
        current["n"] = sequence

    def run():
        incremental.watch_versions(spark, f"file://{folder}", f"file://{tmp_path}/cp", on, lambda: current["n"]).awaitTermination()

    (folder / "1.json").write_text('{"version":"a@1","sequence":1}\n')
    run()
    (folder / "2.json").write_text('{"version":"a@0","sequence":1}\n')
    run()
    (folder / "3.json").write_text('{"version":"a@2","sequence":2}\n')
    run()
    assert seen == ["a@1", "a@2"]
    done = []
    assert incremental.sync_watchlist("a@2", "a@2", lambda: done.append(1), done.append) is False and incremental.sync_watchlist("a@1", "a@2", lambda: done.append(1), done.append) and done == [1, "a@2"]


def test_event_log_stream(spark, sf, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props").repartition(3).write.parquet(source)
    stream = incremental.event_stream(spark, source)
    incremental.append_events(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination()
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    state = incremental.latest_state(log, ["user_id"], "event_type", ["ts", "event_id"])
    assert state.count() == log.select("user_id").distinct().count()
