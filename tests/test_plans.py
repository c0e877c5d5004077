import pytest
from pyspark.sql import functions as F

from vigilframe.functions import hashing, settings
from vigilframe.operators import ledger
from vigilframe.plans import publish, recall, receipts, review
from vigilframe.sources import feeds

LINES = [("A:1", "Ann Lee", "PERSON", [], ["1970"], ["DE"], "SANCTION", "A", "v2"), ("A:2", "Bob Ray", "PERSON", [], [], [], "SANCTION", "A", "v2")]


def test_publish_carries_a_failing_list_forward(spark):
    good = publish.Source("A", "List A", lambda s: s.createDataFrame(LINES, feeds.LINE), (1, 10), lambda s: s.createDataFrame([("1", "Anne"), ("1", "ann lee")], "number string, name string"))
    bad = publish.Source("B", "List B", lambda s: s.createDataFrame([], feeds.LINE), (1, 10))
    with pytest.raises(ValueError, match="B can't be staged"):
        publish.stage_all(spark, [good, bad], "2026-01-02T00:00:00Z")
    previous = spark.createDataFrame([("B:9", "old one", [], None, [], "SANCTION", "B", "v1")], "entity_id string, name_canonical string, aliases array<string>, dob string, countries array<string>, risk_category string, source_list string, list_version string")
    catalog = spark.createDataFrame([("B", "v1", 1, "2026-01-01T00:00:00Z")], "id string, version string, entitiesCount long, fetchedAt string")
    entities, now = publish.stage_all(spark, [good, bad], "2026-01-02T00:00:00Z", previous, catalog)
    assert {r["entity_id"]: r["aliases"] for r in entities.collect()} == {"A:1": ["Anne"], "A:2": [], "B:9": []}
    assert [(r["id"], r["version"], r["fetchedAt"][:10], r["stale"]) for r in now.collect()] == [("A", "v2", "2026-01-02", False), ("B", "v1", "2026-01-01", True)]
    broken = publish.Source("A", "List A", good.read, (1, 10), lambda s: s.read.schema("number string, name string").json("file:///nowhere/at/all"))
    assert publish.stage(spark, broken)[1]["aliases"]["mode"] == "degraded"


def test_onboard_and_rescan(spark):
    entities = spark.createDataFrame([(1, "Ann Lee", [], ["1970"], ["DE"]), (2, "Bob Ray", [], [], [])], "id long, primary_name string, aliases array<struct<name:string>>, dob array<string>, countries array<string>")

    def finds(*ids):
        def screen(customers):
            return customers.crossJoin(spark.createDataFrame([(i,) for i in ids], "id long")).select("customer_id", "id", F.lit(0.9).alias("score"), F.lit("STRONG").alias("tier"))

        return screen

    empty = [spark.createDataFrame([], s) for s in (ledger.CUSTOMERS, ledger.MATCHES, ledger.EVENTS)]
    new = spark.createDataFrame([("r1", "Ann Lee", None, "DE", None)], "reference string, name string, dob string, country string, onboarded_by string")
    customers, matches, events = review.onboard(*empty, new, entities, finds(1), "t0")
    assert customers.count() == matches.count() == events.count() == 1
    after, log, summary = review.rescan(customers, matches, events, entities, finds(1, 2), "t1")
    assert tuple(summary.first()) == (1, 0, 1) and after.count() == 2 and {r["type"] for r in log.collect()} == {"DETECTED"} and log.count() == 2
    renamed = entities.withColumn("primary_name", F.concat("primary_name", F.lit(" Jr")))
    assert review.rescan(customers, matches, events, renamed, finds(1), "t1")[0].first()["review_state"] == "CHANGED"


def test_receipts(spark):
    matches = spark.createDataFrame([(1, 5, "ann", 0.5, "WEAK"), (1, 6, "ann", 0.9, "STRONG")], "qid long, id long, query string, score double, tier string")
    got = receipts.with_receipts(matches, spark.createDataFrame([(1, "A@v1")], "qid long, watchlist_version string"))
    public, private = hashing.ed25519_keypair(spark)
    signature = receipts.sign(spark, got, private)
    assert receipts.verify(spark, got.orderBy(F.desc("id")), public, signature)
    assert not receipts.verify(spark, got.where("id = 5"), public, signature)
    assert not receipts.verify(spark, got.withColumn("receipt", F.lit("{}")), public, signature)
    with pytest.raises(Exception, match="outside"):
        receipts.with_receipts(matches.withColumn("score", F.lit(1.5)), spark.createDataFrame([], "qid long, watchlist_version string")).collect()


def test_recall_and_decisions(spark):
    labelled = spark.createDataFrame([(1, "alias", "x", [10]), (2, "alias", "y", [11, 12]), (3, "clean", "z", [])], "qid long, kind string, query string, expected array<long>")
    results = spark.createDataFrame([(1, 10, 1, 0.9, 0.9, True), (2, 13, 1, 0.5, 0.1, False), (2, 12, 2, 0.35, 0.4, False), (3, 14, 1, 0.6, 0.2, True)], "qid long, id long, rank int, score double, lexical_similarity double, token_containment boolean")
    got = {(r["kind"], r["k"]): (r["hits"], r["n"]) for r in recall.run_recall(labelled, lambda _: results, [1, 2]).collect()}
    assert got == {("alias", 1): (1, 2), ("alias", 2): (2, 2), ("clean", 1): (0, 0), ("clean", 2): (0, 0)} or {k: v for k, v in got.items() if k[0] == "alias"} == {("alias", 1): (1, 2), ("alias", 2): (2, 2)}
    evidence = recall.decision_evidence(labelled, lambda _: results)
    rows = {(r["qid"], r["id"]): r for r in evidence.collect()}
    assert rows[2, 11]["rank"] is None and rows[2, 11]["kept"] == [] and rows[1, 10]["primary"] == ["lenient", "balanced", "strict"] and rows[2, 12]["kept"] == ["lenient", "balanced"] and rows[2, 12]["primary"] == ["lenient"]
    report = {(r["unit"], r["pool"], r["level"], r["band"]): r for r in recall.decision_report(evidence).collect()}
    assert report["query", "all", "lenient", "kept"]["recall"] == 1 and report["query", "all", "lenient", "kept"]["fpr"] == 1
    worse = recall.decision_report(evidence, spark.createDataFrame([(3, "review")], "qid long, verdict string"))
    assert {r["positives"] for r in worse.where("unit = 'pair' and pool = 'all'").collect()} == {4}


def test_settings(spark):
    row = spark.range(1).select(
        settings.preset_overrides(F.lit('{"A":"strict","B":"no"}')).alias("m"), settings.preset_overrides(F.lit("oops")).alias("bad"), settings.id_array(F.lit('["a","b"]')).alias("ids"), settings.id_array(F.lit("[1]")).alias("numbers"), settings.id_array(F.lit("{}")).alias("object"),
        settings.list_thresholds(F.create_map(F.lit("A"), F.lit("strict")), F.lit("lenient"))[0].alias("floors"), settings.list_thresholds(F.create_map(F.lit("A"), F.lit("strict")), F.lit("lenient"))[1].alias("floor"),
        settings.enabled_ids(F.array(F.lit("b"), F.lit("x")), F.array(F.lit("a"), F.lit("b"))).alias("on"), settings.same_ids(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))).alias("same"),
        settings.documents(F.lit('[{"doc_type":"passport","country":"DE","expires":"2030-01-31"}]')).alias("docs"), settings.documents(F.lit('[{"doc_type":"passport","country":"Utopia"}]')).alias("wrong"),
    ).first()
    assert row["m"] == {"A": "strict"} and row["bad"] == {} and row["ids"] == ["a", "b"] and row["numbers"] is None and row["object"] is None
    assert row["floors"] == {"A": 0.75} and row["floor"] == 0.55 and row["on"] == ["b"] and row["same"] and len(row["docs"]) == 1 and row["wrong"] is None


def test_zstd_frames(spark):
    import zstandard

    frame = zstandard.ZstdCompressor().compress(b"abc" * 100)
    df = spark.createDataFrame([(bytearray(frame),)], "f binary")
    assert bytes(df.select(hashing.unzstd("f").alias("o")).first()["o"]) == b"abc" * 100
    for bad in (frame + frame, zstandard.ZstdCompressor().compress(bytes(300_000))):
        with pytest.raises(Exception, match="frame"):
            spark.createDataFrame([(bytearray(bad),)], "f binary").select(hashing.unzstd("f")).collect()


def test_origin_refuses_what_was_changed(spark, tmp_path):
    from vigilframe.functions import hashing
    from vigilframe.plans import origin

    entities = spark.createDataFrame([("a", "x"), ("b", "y")], "entity_id string, source_list string")
    catalog = spark.createDataFrame([("x",), ("y",)], "id string")
    public, private = hashing.ed25519_keypair(spark)
    path = f"file://{tmp_path}/origin"
    assert len(origin.publish(spark, entities, catalog, path, 5, private)["files"]) == 3 and origin.verify(spark, path, public, 5).count() == 0
    with pytest.raises(ValueError, match="older than 6"):
        origin.verify(spark, path, public, 6)
    with pytest.raises(ValueError, match="isn't signed"):
        origin.verify(spark, path, hashing.ed25519_keypair(spark)[0])
    assert origin.mirror(spark, path, f"file://{tmp_path}/copy", public) == 3
    part = next((tmp_path / "origin/catalog").glob("part-*"))
    for crc in (tmp_path / "origin/catalog").glob(".*.crc"):
        crc.unlink()
    part.write_text(part.read_text().replace("x", "z"))
    (tmp_path / "origin/catalog/part-extra").write_text("{}")
    assert {r["problem"] for r in origin.verify(spark, path, public).collect()} == {"content", "unlisted"}
    with pytest.raises(ValueError):
        origin.mirror(spark, path, f"file://{tmp_path}/again", public)
    assert not (tmp_path / "again").exists()


def test_fetch_tries_again():
    from vigilframe.sources import fetch

    paused, asked = [], []

    def answers(*given):
        left = list(given)

        def transport(url, headers, seconds):
            asked.append((url, headers["User-Agent"], seconds))
            one = left.pop(0)
            if isinstance(one, Exception):
                raise one
            return one

        return transport

    got = fetch.fetch(answers(fetch.Answer(503), ConnectionError("reset"), fetch.Answer(200, b"x")), "u", "feed", sleep=paused.append)
    assert got.body == b"x" and paused == [1.0, 2.0] and asked[0] == ("u", "vigilframe", 45.0)
    for given, match in (((fetch.Answer(404),), "404"), ((TimeoutError(),), "45 seconds"), ((fetch.Answer(202, headers={"X-Amzn-Waf-Action": "challenge"}),), "firewall"), ((fetch.Answer(429),) * 3, "429")):
        with pytest.raises(fetch.FeedError, match=match):
            fetch.fetch(answers(*given), "u", "feed", sleep=paused.append)


def test_reports_are_merged():
    from vigilframe.plans import publish

    assert publish.merge_reports([]) == {"mode": "none", "added": 0, "reason": None}
    both = [{"mode": "enriched", "added": 3}, {"mode": "degraded", "added": 0, "reason": "gone"}, {"mode": "none", "added": 0}]
    assert publish.merge_reports(both) == {"mode": "degraded", "added": 3, "reason": "gone"}
