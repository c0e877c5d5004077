"""Surrogates for personal data and secrets, with Spark expressions only (native).

Detected entities are e-mail addresses, telephone numbers, IP addresses, card numbers (by issuer digit and check digit),
international bank account numbers (by check digits), social security numbers, credentials, and names of persons (after a
given name of a list, or a title). Each gets a keyed surrogate of its own kind: the same form (digits for
digits, letters of the same case, separators kept), cards and accounts with right check digits, given names of the same gender and
script, family names of the same script.

An entity's canonical form (digits only, lower case) decides its surrogate, so all its spellings in all documents get
the same one. Surrogates are proposed for the distinct entities of the corpus and checked: one that is an entity of the
corpus itself, that another entity has, or that several entities propose at once (the smallest keeps it) is proposed
anew, until all differ. Where a form has too few free surrogates, later proposals are longer by a letter or digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import checkpoint

# Choices of this operator: given names that are detected, by script and gender.
GIVEN = {
    ("latin", "f"): [
        "Agnieszka", "Aisha", "Amara", "Anna", "Barbara", "Carmen", "Caroline", "Charlotte", "Chiara", "Claire", "Elena", "Emily", "Emma", "Ewa", "Fatima", "Giulia", "Hannah", "Ingrid", "Irina", "Isabel",
        "Jennifer", "Julia", "Laura", "Layla", "Linda", "Lucía", "Margaret", "María", "Maria", "Mary", "Natalia", "Olga", "Patricia", "Priya", "Sarah", "Sofia", "Sophie", "Susan", "Svetlana", "Ursula", "Yuki",
    ],
    ("latin", "m"): [
        "Ahmed", "Andreas", "Antonio", "Arjun", "Carlos", "Charles", "Daniel", "David", "Dmitri", "Friedrich", "George", "Giovanni", "Hans", "Hassan", "Hiroshi", "Ivan", "James", "Javier", "Jean", "John",
        "José", "Kenji", "Klaus", "Kwame", "Lars", "Luis", "Marco", "Michael", "Mohammed", "Omar", "Paul", "Peter", "Pierre", "Piotr", "Robert", "Sergei", "Sven", "Thomas", "Vladimir", "Wei", "William", "Wolfgang",
    ],
    ("cyrillic", "f"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"],
}
# Choices of this operator: forms of address that a family name follows.
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
# Choices of this operator: syllables from which family names are made.
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "del", "fen", "gar", "hol", "kel", "lan", "mar", "nor", "pel", "ran", "sel", "tor"],
    "cyrillic": ["бар", "бел", "вол", "гор", "дан", "ель", "зар", "кал", "лав", "мар", "нов", "пет", "рад", "сел", "тор", "яс"],
}

_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_FAMILY = r"\p{Lu}(?<=(?<!\p{L})(?:(?:" + _ALL_GIVEN + r")[ \xA0]|(?:" + "|".join(TITLES) + r")\.?[ \xA0])\p{Lu})\p{Ll}[\p{L}'’-]*"
_GIVEN = r"(?=\p{Lu})(?<!\p{L})(?:" + _ALL_GIVEN + r")(?=[ \xA0]\p{Lu}\p{Ll})"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_H = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{2,6}}(?::{_H}){{1,5}})(?![0-9A-Za-z:])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_ISSUED = r"(?=4|5[1-5]|2[2-7]|6|35)"  # first digits of issuers of cards with 16 digits
_CARD = r"(?<!\d)(?:4\d{12}(?:\d{3}){0,2}|" + _ISSUED + r"\d{16}|6\d{18}|3[47]\d{13}|3[0689]\d{12}|" + _ISSUED + r"\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3})|3[47]\d{2}(?: \d{6} \d{5}|-\d{6}-\d{5}))(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
_KEYWORD = "(?i:password|passwd|token|secret|api_key|apikey)"
# what follows a keyword has a digit at least, or quotes: words of a sentence aren't credentials. The short look back comes first, it is cheap
_SECRET = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?=[A-Za-z0-9_/+.-])(?<=[=:]\s{0,2}[\"']?)(?<=" + _KEYWORD + r"\s{0,2}[=:]\s{0,2}[\"']?)(?:(?<=[\"'])|(?=[A-Za-z_/+.-]*\d))[A-Za-z0-9_/+.-]{8,}"
PATTERN = "|".join([_EMAIL, _SECRET, _SSN, _IBAN, _CARD, _IP, _IP6, _PHONE, _GIVEN, _FAMILY])
#: every text that PATTERN matches matches this too; most texts don't, and go on unchanged
QUICK = r"[@\d]|A(?:KI|SI)A[A-Z]{16}|" + _KEYWORD + r"\s{0,2}[=:]\s{0,2}[\"']|(?=\p{Lu})(?<!\p{L})(?:" + _ALL_GIVEN + "|" + "|".join(TITLES) + r")\.?[ \xA0]\p{Lu}"


def _given_lookup() -> dict[str, tuple[str, int]]:
    return {name.lower(): (f"given_{gender}_{script}", i) for (script, gender), names in GIVEN.items() for i, name in enumerate(names)}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def kind_of(e: Column) -> Column:
    """The kind of a match of PATTERN; null for numbers whose check digits tell that they are something else."""
    full = lambda p: e.rlike("^(?:" + p + ")$")
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(e.contains("@"), "email")
        .when(full(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(full(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip")
        .when(full(r"[2-6]\d[\d -]*") & (F.length(digits) >= 13), F.when(_with_check_digit(digits) == digits, "card"))
        .when(full(r"[+(\d][\d +().-]*") & e.rlike(r"^\+|^\(|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(full(r"(?:AKIA|ASIA)[0-9A-Z]{16}"), "secret")
        .when(full(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,}"), F.when(_remainder(F.regexp_replace(e, " ", "")) == 1, "iban"))
        .when(full(r"[0-9A-Fa-f]*:[0-9A-Fa-f:]+"), "ip6")
        .when(full(r"[A-Za-z0-9_/+.-]*[0-9_/+.][A-Za-z0-9_/+.-]*"), "secret")
        .when(full(_ALL_GIVEN), F.coalesce(F.element_at(_map({k: v[0] for k, v in _given_lookup().items()}), F.lower(e)), F.lit("family_latin")))
        .when(full(r"\p{Lu}\p{Ll}[\p{L}'’-]*"), F.when(e.rlike(r"\p{IsCyrillic}"), "family_cyrillic").otherwise("family_latin"))
        .otherwise("secret")
    )


def _remainder(account: Column) -> Column:
    """An account number modulo 97, its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def canonical(kind: Column, e: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(e, r"\D", "")).when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "secret", e).otherwise(F.lower(e))


def _noise(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """192 hex digits that depend on the key, the entity and the attempt."""
    seed = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(f"{attempt}.{i}")), 256)
    return F.concat(seed(0), seed(1), seed(2))


def _number(noise: Column, i: Column, below: int) -> Column:
    """The i-th number below the bound; entities longer than the noise use it again."""
    return F.pmod(F.conv(F.substring(noise, F.pmod(i * 4, F.lit(188)) + 1, F.lit(5)), 16, 10).cast("long") + F.floor(i / 47), F.lit(below)).cast("int")


def _like(noise: Column, canon: Column, hexadecimal: Column, fixed: Column) -> Column:
    """Each digit a digit, each letter a letter of its case (of a to f if hexadecimal), from position `fixed` on."""

    def swap(c: Column, i: Column) -> Column:
        base = F.when(c.rlike("[a-z]"), 97).otherwise(65)
        letter = F.char(base + F.when(hexadecimal, _number(noise, i, 6)).otherwise(_number(noise, i, 26)))
        return F.when(i < fixed, c).when(c.rlike("[0-9]"), _number(noise, i, 10).cast("string")).when(c.rlike("[A-Za-z]"), letter).otherwise(c)

    return F.concat_ws("", F.transform(F.split(canon, ""), swap))


def _with_check_digit(digits: Column) -> Column:
    """The last digit set so that the Luhn sum is a multiple of ten."""
    body = F.reverse(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""))
    twice = lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    total = F.aggregate(F.transform(body, lambda c, i: twice(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _family(noise: Column, parts: list[str], syllables: int) -> Column:
    table = F.array(*[F.lit(x) for x in parts])
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(syllables - 1)), lambda i: F.element_at(table, _number(noise, i, len(parts)) + 1)))


def propose(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """The surrogate, in canonical form, that the entity gets at this attempt."""
    noise = _noise(key, kind, canon, attempt)
    at = canon.substr(F.lit(1), F.instr(canon, "@") - 1)
    top = F.substring_index(canon, ".", -1)
    domain = F.substring(canon, F.instr(canon, "@") + 1, F.length(canon))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    more = attempt // 3  # characters that later proposals have more, for forms whose surrogates are used up
    letters = F.translate(F.substring(F.sha2(F.concat(noise, F.lit("more")), 256), F.lit(1), F.lit(more)), "0123456789", "ghijklmnop")
    digits = F.translate(letters, "abcdefghijklmnop", "0123456789012345")
    email = F.concat(_like(noise, at, F.lit(False), F.lit(0)), letters, F.lit("@"), _like(F.reverse(noise), host, F.lit(False), F.lit(0)), F.lit("."), top)
    octets = F.concat_ws(".", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(noise, i, 254) + 1).cast("string")))
    family = {script: _family(noise, parts, 3 + attempt) for script, parts in SYLLABLES.items()}
    is_hex = canon.rlike("^[0-9a-f]+$")
    account = F.concat(F.substring(canon, 1, 2), F.lit("00"), F.substring(_like(noise, canon, F.lit(False), F.lit(4)), F.lit(5), F.length(canon)), digits)
    out = (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "ip6", _like(noise, canon, F.lit(True), F.lit(0)))
        .when(kind == "iban", F.concat(F.substring(account, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - _remainder(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account))))
        .when(kind == "card", _with_check_digit(F.concat(_like(noise, canon, F.lit(False), F.lit(1)), digits)))
        .when(kind == "phone", F.concat(_like(noise, canon, F.lit(False), F.when(F.length(canon) > 10, F.length(canon) - 10).otherwise(F.lit(0))), digits))
        .when(kind == "ssn", F.concat(_like(noise, canon, F.lit(False), F.lit(0)), digits))
        .when(kind == "secret", F.concat(_like(noise, canon, is_hex, F.when(canon.rlike("^A[KS]IA"), 4).otherwise(0)), digits))
        .when(kind == "family_cyrillic", family["cyrillic"])
        .when(kind == "family_latin", family["latin"])
    )
    # given names are a closed set: turned by a keyed step within their gender and script, which keeps them distinct
    for (script, gender), names in GIVEN.items():
        step = F.pmod(F.conv(F.substring(F.sha2(F.lit(f"{key}\x1f{script}{gender}"), 256), 1, 6), 16, 10).cast("long"), F.lit(len(names) - 1)).cast("int") + 1
        index = F.element_at(_map({n.lower(): i for i, n in enumerate(names)}), canon)
        turned = F.element_at(F.array(*[F.lit(n.lower()) for n in names]), F.pmod(index + step, F.lit(len(names))) + 1)
        out = F.when(kind == f"given_{gender}_{script}", turned).otherwise(out)
    return out


def render(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the occurrence: its separators, or its capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        held = c.rlike("[0-9A-Z]")
        return F.struct(F.concat(acc["out"], F.when(held, F.substring(surrogate, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + held.cast("int")).alias("at"))

    # what a longer surrogate has more comes last
    spaced = F.aggregate(F.split(surface, ""), start, step, lambda acc: F.concat(acc["out"], F.substring(surrogate, acc["at"], F.length(surrogate))))
    name = F.when((F.upper(surface) == surface) & (F.length(surface) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind.startswith("given") | kind.startswith("family"), name).otherwise(surrogate)


def entities(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id (as a string, null as empty), h (hash of the text), e: the distinct matches of PATTERN in each text that has any."""
    t = F.col(f"`{text}`")
    found = docs.where(t.rlike(QUICK)).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.xxhash64(t).alias("h"), F.array_distinct(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).alias("found"))
    return found.select("id", "h", F.explode("found").alias("e"))


def surrogates(found: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """kind, canon, surrogate: distinct within a kind, and no entity of the corpus (given names: a permutation)."""
    todo, done = checkpoint(found), None
    n = todo.count()
    names = checkpoint(todo.select("kind", F.col("canon").alias("surrogate")), n)
    for attempt in range(rounds):
        offered = todo.withColumn("surrogate", propose(F.col("kind"), F.col("canon"), key, attempt))
        first = offered.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        closed = F.col("kind").startswith("given")
        free = first.where(~closed).join(names, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = checkpoint(free.select("kind", "canon", "surrogate").unionByName(offered.where(closed).select("kind", "canon", "surrogate")), n)
        done = won if done is None else done.unionByName(won)
        todo = checkpoint(todo.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), n)
        n = todo.count()
        if not n:
            return done
    raise RuntimeError(f"{rounds} rounds left entities without a free surrogate")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the text replaced, and n_entities (occurrences replaced). Without the key, surrogates can't be
    computed from guessed entities.

    Null and empty texts stay as they are, with 0 entities. Rows that are equal in id and text are replaced alike; null ids are
    ids like others. All columns of docs are kept, whatever their names, but one named n_entities, which is replaced. Empty
    input gives an empty result. A text's entities are extracted once; only texts that may hold any are shuffled.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    t = F.col(f"__d.`{text}`")
    spots = checkpoint(entities(docs, id_col, text))
    told = spots.select("e").distinct().select("e", kind_of(F.col("e")).alias("kind")).where("kind is not null")
    told = checkpoint(told.withColumn("canon", canonical(F.col("kind"), F.col("e"))))
    table = surrogates(told.select("kind", "canon").distinct(), key)
    made = told.join(table, ["kind", "canon"]).select("e", render(F.col("kind"), F.col("e"), F.col("surrogate")).alias("r"))
    maps = spots.distinct().join(made, "e").groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("e", "r"))).alias("__map"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__d"))
    quick = F.coalesce(t.rlike(QUICK), F.lit(False))
    plain = marked.where(~quick).select("__d", t.alias("__new"), F.lit(0).alias("n_entities"))
    held = marked.where(quick).select("__d", F.coalesce(F.col(f"__d.`{id_col}`").cast("string"), F.lit("")).alias("id"), F.xxhash64(t).alias("h")).join(maps, ["id", "h"], "left")
    spans = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    filled = F.concat(F.transform(spans, lambda e: F.coalesce(F.element_at(F.col("__map"), e), e)), F.array(F.lit("")))
    new = F.concat_ws("", F.zip_with(F.split(t, PATTERN, -1), filled, lambda a, b: F.concat(a, b)))
    count = F.size(F.filter(spans, lambda e: F.map_contains_key(F.col("__map"), e)))
    changed = held.select("__d", F.when(F.col("__map").isNull(), t).otherwise(new).alias("__new"), F.when(F.col("__map").isNull(), 0).otherwise(count).alias("n_entities"))
    rows = plain.unionByName(changed)
    return rows.select(*[F.col("__new").alias(c) if c == text else F.col(f"__d.`{c}`").alias(c) for c in names], "n_entities")
