import pytest

from vigilframe.operators import ledger

NEW = "customer_id string, entity_id string, score double, tier string, fingerprint string"


@pytest.fixture(scope="module")
def state(spark):
    rows = [("m1", "c1", "e1", "f1", "FALSE_POSITIVE"), ("m2", "c1", "e2", None, "PENDING"), ("m3", "c1", "e3", "f3", "TRUE_POSITIVE"), ("m4", "c1", "e4", "f4", "PENDING"), ("m9", "c2", "e1", "f9", "PENDING")]
    matches = spark.createDataFrame([(m, c, e, 0.7, "POSSIBLE", f, r, "CURRENT", "ann", None, "t0") for m, c, e, f, r in rows], ledger.MATCHES)
    return matches, spark.createDataFrame([], ledger.EVENTS)


def test_replace_follows_the_decision_table(spark, state):
    new = spark.createDataFrame([("c1", "e1", 0.9, "STRONG", "f1"), ("c1", "e2", 0.9, "STRONG", "f2"), ("c1", "e3", 0.9, "STRONG", "other"), ("c1", "e5", 0.9, "STRONG", "f5")], NEW)
    matches, events = ledger.replace_matches(*state, new, spark.createDataFrame([("c1",)], "customer_id string"), "t1")
    got = {(r["customer_id"], r["entity_id"]): r for r in matches.collect()}
    assert set(got) == {("c1", "e1"), ("c1", "e2"), ("c1", "e3"), ("c1", "e5"), ("c2", "e1")}
    assert got["c1", "e1"]["resolution"] == "FALSE_POSITIVE" and got["c1", "e1"]["review_state"] == "CURRENT" and got["c1", "e1"]["match_id"] != "m1"
    assert got["c1", "e2"]["fingerprint"] == "f2" and got["c1", "e3"]["review_state"] == "CHANGED" and got["c1", "e3"]["resolution"] == "TRUE_POSITIVE"
    assert got["c1", "e5"]["resolution"] == "PENDING" and got["c2", "e1"]["match_id"] == "m9"
    log = {(r["entity_id"], r["type"], r["from_status"]) for r in events.collect()}
    assert log == {("e3", "CHANGED", "TRUE_POSITIVE"), ("e5", "DETECTED", None), ("e4", "SUPPRESSED", "PENDING")}


def test_upsert_resets_and_keeps_the_id(spark, state):
    new = spark.createDataFrame([("c1", "e1", 0.95, "STRONG", "x"), ("c3", "e1", 0.5, "WEAK", "y")], NEW)
    matches, events = ledger.record_matches(*state, new, "t1")
    got = {(r["customer_id"], r["entity_id"]): r for r in matches.collect()}
    assert got["c1", "e1"]["match_id"] == "m1" and got["c1", "e1"]["resolution"] == "PENDING" and got["c1", "e1"]["reviewer"] == "ann" and len(got) == 6
    assert events.count() == 2


def test_resolve_and_delete(spark, state):
    schema = "match_id string, decision string, reviewer string, notes string"
    after, events = ledger.resolve_matches(*state, spark.createDataFrame([("m4", "RESOLVED", None, "ok")], schema), "t1", "bob")
    row = after.where("match_id = 'm4'").first()
    assert row["resolution"] == "RESOLVED" and row["reviewer"] == "bob" and events.first()["from_status"] == "PENDING"
    with pytest.raises(ValueError, match="no resolution"):
        ledger.resolve_matches(*state, spark.createDataFrame([("m4", "PENDING", None, None)], schema), "t1")
    customers = spark.createDataFrame([("c1",), ("c2",)], "customer_id string")
    left, matches, log = ledger.delete_customers(customers, after, events, spark.createDataFrame([("c1",)], "customer_id string"))
    assert left.count() == 1 and matches.count() == 1 and log.count() == 0
    ledger.check_append_only(events, log, left)
    with pytest.raises(ValueError, match="deleted"):
        ledger.check_append_only(events, log, customers)


def test_customers(spark):
    none = spark.createDataFrame([], ledger.CUSTOMERS)
    new = spark.createDataFrame([("r1", "Ann", None, "DE", None)], "reference string, name string, dob string, country string, onboarded_by string")
    one = ledger.create_customers(none, new, "t0")
    assert one.first()["status"] == "PENDING_REVIEW" and one.first()["onboarded_by"] == "local"
    with pytest.raises(ValueError, match="r1"):
        ledger.create_customers(one, new, "t1")
    patch = spark.createDataFrame([(one.first()["customer_id"], " ", "FR", "APPROVED")], "customer_id string, name string, country string, status string")
    row = ledger.update_customers(one, patch).first()
    assert (row["name"], row["country"], row["status"]) == ("Ann", "FR", "APPROVED")


def test_versioned_store(spark, tmp_path):
    store = ledger.VersionedStore(spark, f"file://{tmp_path}/ledger")
    schema = "key string, value string"
    assert store.read("settings", schema).count() == 0
    assert store.commit(settings=spark.createDataFrame([("a", "1")], schema)) == 1
    now = ledger.put_settings(store.read("settings", schema), spark.createDataFrame([("a", "2"), ("b", "3")], schema))
    assert store.commit(settings=now) == 2
    assert {tuple(r) for r in store.read("settings", schema).collect()} == {("a", "2"), ("b", "3")} and store.pointer()["sequence"] == 2


def test_pointer_of_two_writers_and_of_a_crash(spark, tmp_path):
    schema = "key string, value string"
    a, b = (ledger.VersionedStore(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    a.commit(settings=spark.createDataFrame([("a", "1")], schema))
    seen = b.pointer()
    a.commit(settings=spark.createDataFrame([("a", "2")], schema))
    b.pointer = lambda: seen  # b has read the sequence before a committed
    with pytest.raises(FileExistsError, match="sequence 2"):
        b.commit(settings=spark.createDataFrame([("a", "3")], schema))
    assert [tuple(r) for r in a.read("settings", schema).collect()] == [("a", "2")]
    # a writer that ended before its pointer was whole, and one that ended before it had any
    (tmp_path / "ledger/pointers/sequence-00000000000000000003").write_text('{"sequ')
    spark.createDataFrame([("a", "9")], schema).write.parquet(f"file://{tmp_path}/ledger/settings/version=3-lost")
    assert a.pointer()["sequence"] == 2 and [tuple(r) for r in a.read("settings", schema).collect()] == [("a", "2")]


def test_pages_of_customers(spark):
    rows = spark.createDataFrame([(f"c{i}", f"t{i % 3}") for i in range(50)], "customer_id string, created_at string")
    first, at = ledger.customers_page(rows, -4, 24)
    last, end = ledger.customers_page(rows, 99, 24)
    assert (at, end, first.count(), last.count()) == (1, 3, 24, 2) and first.first()["created_at"] == "t2"
    assert ledger.customers_page(rows.limit(0), 5)[1] == 1
