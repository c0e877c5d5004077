"""Text and date expressions. Native unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from vigilframe.config import MAX_YEAR, MIN_YEAR, MONTHS, TITLES


def _kept(c: str) -> bool:
    return c in "_-" or c.isspace() or unicodedata.category(c)[0] in "LN"


def canonical_name(name: str | None) -> str:
    """NFKD, without marks and punctuation, lower case, without titles, single spaces."""
    if not name:
        return ""
    plain = "".join(filter(_kept, unicodedata.normalize("NFKD", name))).lower()
    return " ".join(w for w in plain.split() if w not in TITLES)


@pandas_udf(T.StringType())
def _canonical(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in names:
        yield batch.map(canonical_name)


def canonicalize_ascii(name: Column) -> Column:
    """canonicalize() for names of ASCII letters only, without leaving the JVM."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9_\s-]", "")), r"\s+", " ")), " ")
    return F.coalesce(F.concat_ws(" ", F.filter(words, lambda w: (w != "") & ~w.isin(TITLES))), F.lit(""))


def canonicalize(name: Column) -> Column:
    """The canonical name; null gives an empty one. Spark has no Unicode normalisation, so this is an Arrow UDF: use
    canonicalize_ascii() where names are known to be ASCII."""
    return _canonical(name)


def name_tokens(canonical: Column) -> Column:
    """Distinct tokens; none for an empty name."""
    return F.filter(F.array_distinct(F.split(F.coalesce(canonical, F.lit("")), " ")), lambda t: t != "")


def display_name(canonical: Column) -> Column:
    return F.initcap(canonical)


#: words of a date of birth that say how sure it is
HEDGES = ["circa", "approx", "approximately", "abt", "about", "c"]


def normalize_dob(raw: Column) -> Column:
    """The most precise of YYYY-MM-DD, YYYY-MM and YYYY that a date of birth tells, or null.

    The text's words without hedges are told apart by kind: a year of four digits (y), a number of up to two (n), the name of a
    month (m). The kinds in order decide what it may be, and how it is written whether it is: ISO dates (y, yn, ynn with
    hyphens), two years as a range, of which the first counts, [n]my with spaces, and nny as day, month, year with slashes or hyphens.
    """
    low = F.lower(F.translate(F.trim(raw), ".", " "))
    written = F.array_join(F.filter(F.split(low, r"\s+"), lambda w: (w != "") & ~w.isin(HEDGES)), " ")
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    words = F.filter(F.split(F.translate(written, "-–/", "   "), " "), lambda w: (w != "") & (w != "to"))
    number = lambda w: w.try_cast("int").isNotNull() & (F.translate(w, "0123456789", "") == "")
    kind = lambda w: F.when(number(w) & (F.length(w) == 4), "y").when(number(w) & (F.length(w) <= 2), "n").when(F.map_contains_key(months, w), "m").otherwise("?")
    shape = F.array_join(F.transform(words, kind), "")
    word = lambda i: F.try_element_at(words, F.lit(i))
    year, other = (lambda i: word(i).try_cast("int")), (lambda i: word(i).try_cast("int"))
    as_written = lambda sep, text=written: text == F.array_join(words, sep)
    day_first = as_written("/", F.translate(written, "-", "/"))
    close = F.translate(written, " ", "")
    in_range = F.lit(False)
    for sep in ("to", "-", "–", "/"):
        in_range = in_range | (close == F.array_join(words, sep))
    two_digits = F.forall(F.slice(words, 2, 2), lambda w: F.length(w) == 2)

    def date(y: Column, m: Column | None = None, d: Column | None = None) -> Column:
        fits, text = y.between(MIN_YEAR, MAX_YEAR), [F.lpad(y.cast("string"), 4, "0")]
        for part, most in ((m, 12), (d, 31)):
            if part is not None:
                fits, text = fits & part.between(1, most), [*text, F.lpad(part.cast("string"), 2, "0")]
        return F.when(fits, F.concat_ws("-", *text))

    month = lambda i: F.try_element_at(months, word(i))
    return (
        F.when(shape == "y", F.when(as_written(" "), date(year(1))))
        .when((shape == "yy") & in_range, date(year(1)))
        .when((shape == "yn") & as_written("-") & two_digits, date(year(1), other(2)))
        .when((shape == "ynn") & as_written("-") & two_digits, date(year(1), other(2), other(3)))
        .when((shape == "my") & as_written(" "), date(year(2), month(1)))
        .when((shape == "nmy") & as_written(" "), date(year(3), month(2), other(1)))
        .when((shape == "nny") & day_first, date(year(3), other(2), other(1)))
    )


def first_dob(raws: Column) -> Column:
    """The first date of the array that can be read."""
    return F.try_element_at(F.filter(F.transform(raws, normalize_dob), lambda d: d.isNotNull()), F.lit(1))


def import_date(value: Column) -> Column:
    """ISO or month/day/year as YYYY-MM-DD if the calendar has it, else null."""
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    t = F.trim(value)
    padded = F.concat_ws("-", F.regexp_extract(t, us, 3), F.lpad(F.regexp_extract(t, us, 1), 2, "0"), F.lpad(F.regexp_extract(t, us, 2), 2, "0"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(us), padded)
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def multi_value(cell: Column) -> Column:
    """Distinct trimmed parts between semicolons, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != ""))


def namespaced_id(list_id: Column, raw_id: Column) -> Column:
    return F.concat_ws(":", list_id, raw_id)


def entity_number(entity_id: Column) -> Column:
    """What follows the first colon; the whole id if there is none."""
    return F.when(F.instr(entity_id, ":") > 0, F.substring(entity_id, F.instr(entity_id, ":") + 1, F.length(entity_id))).otherwise(entity_id)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def spreadsheet_safe(value: Column) -> Column:
    """Values that a spreadsheet would take for a formula get an apostrophe."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def canonical_header(header: str) -> str:
    return "".join(c for c in header.lstrip("﻿").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def decode_entities(text: Column) -> Column:
    """The predefined XML entities and decimal references; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    pieces = F.split(text, "&#")
    tail = lambda p: F.substring_index(p, ";", 1)
    is_number = lambda p: (F.instr(p, ";") > 1) & (F.translate(tail(p), "0123456789", "") == "")
    decoded = lambda p: F.concat(_letter(tail(p).try_cast("int")), F.substring(p, F.length(tail(p)) + 2, F.length(p)))
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.when(is_number(p), decoded(p)).otherwise(F.concat(F.lit("&#"), p)))
    return F.replace(F.concat(F.element_at(pieces, 1), F.array_join(rest, "")), F.lit("&amp;"), F.lit("&"))


def _letter(code: Column) -> Column:
    """The letter of a code point, by its bytes in UTF-8."""
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    low = lambda shift: byte(F.shiftright(code, shift).bitwiseAND(63).bitwiseOR(128))
    raw = (
        F.when(code < 0x80, byte(code))
        .when(code < 0x800, F.concat(byte(F.shiftright(code, 6).bitwiseOR(0xC0)), low(0)))
        .when(code < 0x10000, F.concat(byte(F.shiftright(code, 12).bitwiseOR(0xE0)), low(6), low(0)))
        .otherwise(F.concat(byte(F.shiftright(code, 18).bitwiseOR(0xF0)), low(12), low(6), low(0)))
    )
    return F.decode(F.unhex(raw), "UTF-8")


def _midnight(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))


def ofsi_updated(line: Column) -> Column:
    """The instant of a 'Last Updated,dd/mm/yyyy' line, or null."""
    cells = F.transform(F.split(line, ","), lambda c: F.trim(c))
    at = F.array_position(cells, "Last Updated")
    return F.when(at > 0, _midnight(F.try_to_date(F.try_element_at(cells, (at + 1).cast("int")), "dd/MM/yyyy")))


def xml_updated(head: Column, attribute: str) -> Column:
    """The instant that an attribute of a feed's first element tells (generationDate, dateGenerated), as ISO in UTC, or null."""
    value = F.substring_index(F.try_element_at(F.split(head, f'{attribute}="'), F.lit(2)), '"', 1)
    return F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def http_updated(last_modified: Column) -> Column:
    """The instant of an HTTP date (Sun, 06 Nov 1994 08:49:37 GMT), as ISO in UTC, or null."""
    words = F.split(F.trim(last_modified), " ")
    spelled = F.concat_ws(" ", F.slice(words, 2, 4))
    return F.when((F.size(words) == 6) & (F.element_at(words, -1) == "GMT"), F.date_format(F.try_to_timestamp(spelled, F.lit("dd MMM yyyy HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def strict_instant(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?Z$"), F.try_to_timestamp(value))


def list_instant(fetched_at: Column, generated_at: Column) -> Column:
    """A list's own instant if it has one (a malformed one counts as unknown), else the catalog's."""
    return F.when(fetched_at.isNotNull(), strict_instant(fetched_at)).otherwise(strict_instant(generated_at))


def age_phrase(seconds: Column) -> Column:
    """Coarsest unit, rounded down; the future counts as now."""
    s = F.greatest(seconds, F.lit(0))
    unit = F.when(s >= 86400, F.format_string("%d days", F.floor(s / 86400))).when(s >= 3600, F.format_string("%d hours", F.floor(s / 3600))).when(s >= 60, F.format_string("%d minutes", F.floor(s / 60)))
    return F.coalesce(unit, F.when(seconds.isNotNull(), "now"))


def _one_decimal(x: Column) -> Column:
    """A double of at least 1 with one decimal, as C's printf rounds it: by the double's exact value, halves to even. Java's
    formatter rounds the shortest decimal form and halves up, so that 1.15 (1.149999...) and 1.25 come out otherwise."""
    whole = F.floor(x)
    scaled = ((x - whole) * F.lit(float(1 << 52))).cast("long") * 10  # exact: bits under the point end at 2**-52
    digit, rest, half = F.shiftright(scaled, 52), scaled.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(1 << 51)
    tenths = whole * 10 + digit + F.when((rest > half) | ((rest == half) & (digit % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_bytes(n: Column) -> Column:
    """Null for null."""
    above = lambda unit, name: F.concat(_one_decimal(n / unit), F.lit(name))
    return F.when(n < 1000, F.format_string("%d B", n)).when(n < 1_000_000, above(1e3, " kB")).when(n < 1_000_000_000, above(1e6, " MB")).when(n.isNotNull(), above(1e9, " GB"))
