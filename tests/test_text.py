import random

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import hashing, text
from vigilframe.functions.metaphone import phonetic_keys
from vigilframe.functions.similarity import sequence_ratio, token_set, token_sort

DOBS = [
    ("1929-02-07", "1929-02-07"), ("1983", "1983"), ("1907-11", "1907-11"), ("2 May 1966", "1966-05-02"), ("31 Sept 1944", "1944-09-31"), ("Oct. 1939", "1939-10"), ("7 JULY 2001", "2001-07-07"), ("05/11/1973", "1973-11-05"), ("5-1-1973", "1973-01-05"),
    ("abt 1931", "1931"), ("c.1931", "1931"), ("Circa. Nov 1931", "1931-11"), ("1931 approximately", "1931"), ("1941 to 1944", "1941"), ("1941–1944", "1941"), ("1941 / 1944", "1941"), ("1941to1944", None), ("1941 1944", None),
    ("   ", None), ("-0-", None), ("unknown", None), ("1999-00-10", None), ("1999-1-1", None), ("1999-01-32", None), ("40/01/1999", None), ("12.04.1980", None), ("1849", None), ("2101", None), ("1 Foo 1990", None), ("10-Dec-1948", None), ("1990 Dec", None), (None, None),
]


def test_dates_of_birth(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(DOBS)], "i int, raw string")
    got = {r["i"]: r["d"] for r in rows.select("i", text.normalize_dob(F.col("raw")).alias("d")).collect()}
    assert [got[i] for i in range(len(DOBS))] == [want for _, want in DOBS]


@pytest.mark.parametrize(("name", "want"), [("Dr. José  María O'Neil", "jose maria oneil"), ("", ""), (None, ""), ("AL-ZAWAHIRI, Ayman_X", "al-zawahiri ayman_x"), ("Mr. Sr", ""), ("Владимир Й", "владимир и")])
def test_canonical_name(name, want):
    assert text.canonical_name(name) == want


def test_ascii_path_agrees(spark):
    names = ["Mr. John  Smith", "O'Neil, Ann", "", "  dr ", "A-B_c 9"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.canonicalize_ascii(F.col("n")).alias("a"), text.canonicalize(F.col("n")).alias("b")).collect()
    assert all(r["a"] == r["b"] == text.canonical_name(r["n"]) for r in got)


@pytest.mark.parametrize(("a", "b", "want"), [("vladimir ivanov", "vladimir ivanov", 1), ("vladimir ivanov", "boris petrov", 0.296296), ("acme", "acme holdings", 0.470588), ("", "", 1), ("abc", "abd", 0.666667)])
def test_sequence_ratio(a, b, want):
    assert round(sequence_ratio(a, b), 6) == want


def test_token_similarities():
    assert token_sort("ahmad salim", "salim ahmad") == 1
    assert token_sort("vladimir ivanov", "vladimir ivanov ii") == 0.91
    assert token_set("musa muhammad abu marzuk", "marzuk musa abu") == 1
    assert token_set("", "x") == token_sort("x", "") == 0


def test_material_fingerprint(spark):
    """A fixed value of a plain computation, and what does and doesn't move it."""

    def plain(body):
        h = 0x811C9DC5
        for unit in body.encode("utf-16-le")[::2]:  # the low byte of each UTF-16 unit
            h = (h ^ unit) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    array = lambda *x: F.array(*[F.lit(v) for v in x])
    made = lambda name="Ann Lee", country="us", aliases=("B 😀", "a"): hashing.material_fingerprint(F.lit(name), F.lit(country).cast("string"), F.lit("Zoë Q"), array(*aliases), array("1990", "1980-01-02"), F.array().cast("array<string>"))
    row = spark.range(1).select(made(), made(" ANN LEE ", "US", (" A", "b 😀")), made("Ann Lea"), made(country=None)).first()
    want = plain('{"profile":{"name_canonical":"ann lee","country":"us"},"entity":{"name_canonical":"zoë q","aliases":["a","b 😀"],"dob":["1980-01-02","1990"],"countries":[]}}')
    assert row[0] == row[1] == want and len({row[0], row[2], row[3]}) == 3


def test_phonetic_keys():
    for a, b in (("aiman", "ayman"), ("muhammad", "mohammed"), ("hassan", "hasan"), ("marzuk", "marzook")):
        assert phonetic_keys(a) == phonetic_keys(b)
    assert len(phonetic_keys("marzuk")) == 2 and len(phonetic_keys("hassan")) == 1
    assert phonetic_keys("") == phonetic_keys("123") == []
    assert phonetic_keys("zawahiri") != phonetic_keys("zawahri") and phonetic_keys("zhang") != phonetic_keys("chang")
    assert phonetic_keys("company") == ["KMPN"]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.multi_value(F.lit(" a; b ;;a")).alias("multi"), text.entity_number(F.lit("L:1:2")).alias("number"), text.blank_to_null(F.lit("  ")).alias("blank"), text.spreadsheet_safe(F.lit("=1")).alias("cell"), text.import_date(F.lit("2/30/2000")).alias("bad"),
        text.import_date(F.lit("2/3/2000")).alias("day"), text.ofsi_updated(F.lit("Last Updated,03/06/2026")).alias("at"), text.decode_entities(F.lit("&lt;a&gt; &amp;lt;")).alias("xml"), text.display_name(F.lit("ann lee")).alias("shown"),
    ).first()
    assert row["multi"] == ["a", "b"] and row["number"] == "1:2" and row["blank"] is None and row["cell"] == "'=1" and row["bad"] is None
    assert row["day"] == "2000-02-03" and row["at"] == "2026-06-03T00:00:00.000Z" and row["xml"] == "<a> &lt;" and row["shown"] == "Ann Lee"
    assert text.canonical_header("﻿Customer Reference") == "customerreference"


def test_sizes_round_as_printf_does(spark):
    """By the exact value of the quotient and halves to even: 1.15 is under its half, 1.25 is one."""
    rnd = random.Random(21)
    sizes = [0, 999, 1000, 1050, 1150, 1250, 1350, 999_949, 999_950, 999_999, 1_000_000, 1_050_000, 1_150_000, 1_250_000, 999_999_999, 1_150_000_000, 1_250_000_000, (1 << 63) - 1, -5]
    sizes += [rnd.randrange(1 << rnd.randint(10, 63)) for _ in range(3000)] + [50 * k for k in range(20, 2000)] + [50_000_000 * k for k in range(20, 2000)]
    plain = lambda n: f"{n} B" if n < 1000 else next(f"{n / unit:.1f} {name}" for unit, name in ((1e3, "kB"), (1e6, "MB"), (1e9, "GB")) if n < unit * 1000 or name == "GB")
    got = {r["n"]: r["s"] for r in spark.createDataFrame([(n,) for n in [*sizes, None]], "n long").select("n", text.format_bytes(F.col("n")).alias("s")).collect()}
    assert got == {n: plain(n) for n in sizes} | {None: None}
    assert got[1150] == "1.1 kB" and got[1_250_000] == "1.2 MB"
