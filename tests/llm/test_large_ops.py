"""SimHash, BPE, toxicity, repeated strings, MinHash and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from vigilframe.llm import bpe, components, minhash, prefixes, registry, simhash, substrings, suffixes, toxicity

DOCS = "doc_id long, text string, fp int, node int, known int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)


# --- SimHash ----------------------------------------------------------------------------------------------------


def plain_fingerprint(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    ids = list(range(len(prints)))

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                ids[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(900)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One"), (4, "one"), (5, "ÉA b"), (6, "éa b"), (7, "a b c"), (7, "a b c")]
    for k in range(40):
        copy = list(base)
        for _ in range(k % 4):
            copy[rnd.randrange(len(copy))] = "edit"
        rows.append((100 - k, " ".join(copy)))
    got = {}
    for r in simhash.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, 2)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = {}
    for (i, _), f, r in zip(rows, prints, roots, strict=True):
        want.setdefault(i, set()).add((f"{f:016x}", least[r]))
    assert got == want and len({c for v in got.values() for _, c in v}) < len(rows) - 10
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [0, 64])
def test_links_find_every_pair(spark, crowd):
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for f in seeds:
        for n in (1, 2, 3):
            g = f
            for b in rnd.sample(range(64), n):
                g ^= 1 << b
            prints.add(g)
    low = rnd.getrandbits(32)
    prints |= {low | rnd.getrandbits(4) << 40 | rnd.getrandbits(3) << 60 for _ in range(90)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_groups(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [(None, "x y"), (500, None), (501, ""), (502, "x y"), (502, "x y")], {}
    for g in range(12):
        base = [rnd.choice(words) for _ in range(300)]
        for k in range(5):
            copy = list(base)
            for at in rnd.sample(range(300), k):
                copy[at] = f"e{rnd.random()}"
            rows.append((g * 10 + k, " ".join(copy)))
            want[g * 10 + k] = g * 10
    got = simhash.similar_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["group_id"] for r in got if r["doc_id"] in want} == want
    assert {r["group_id"] for r in got if r["doc_id"] in (500, 501)} == {500} and {r["group_id"] for r in got if r["doc_id"] in (None, 502)} == {502}
    assert sum(r["first"] for r in got) == 12 + 1 + 2  # a repeated first row is first twice
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows if i in want}
    assert all(len(sets[i] & sets[g]) / len(sets[i] | sets[g]) > 0.8 for i, g in want.items())
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def plain_groups(rows, words=5, least=0.8):
    """group id of each id, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    edges = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    ids = {i: i for i, _ in rows}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        ids[b] = a
    return {i: root(i) for i in ids}


def test_similar_groups_in_crowded_keys(spark):
    """Copies at 0.8 or more among many texts of the same boilerplate that are under 0.8 to them and to each other."""
    rnd = random.Random(12)
    shared = [f"b{i}" for i in range(170)]
    rows = [(i, " ".join(shared + [f"u{i}x{k}" for k in range(30)])) for i in range(500)]
    for i in range(0, 250, 5):
        copy = rows[i][1].split()
        copy[-12:] = [f"c{i}x{k}" for k in range(12)]
        rows.append((1000 + i, " ".join(copy)))
    rnd.shuffle(rows)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == plain_groups(rows) and len(set(got.values())) == 500


def test_similar_groups_of_texts_with_one_frequent_shingle(spark):
    """A shingle that makes up most of a text doesn't make texts equal."""
    rows = [(i, " ".join(["same"] * 120 + [f"d{i}x{k}" for k in range(80)])) for i in range(6)] + [(9, " ".join(["same"] * 90))]
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == plain_groups(rows) == {i: i for i, _ in rows}


def test_similar_groups_equal_brute_force(spark):
    """Passages repeated in one of two texts, and pairs about the threshold."""
    rnd = random.Random(13)
    rows = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(300)]
        rows.append((1000 * g, " ".join(base)))
        for k, times in enumerate((5, 10, 20)):
            at = rnd.randrange(270)
            rows.append((1000 * g + 1 + k, " ".join(base + base[at : at + 30] * times)))
        other = [f"g{g}v{k}" for k in range(300)]
        rows.append((1000 * g + 500, " ".join(other)))
        cut = rnd.randint(28, 40)  # 300 words with the last few others: 0.8 at 32 or 33
        rows.append((1000 * g + 501, " ".join(other[:-cut] + [f"g{g}e{k}" for k in range(cut)])))
    rnd.shuffle(rows)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    want = plain_groups(rows)
    assert got == want and 0 < sum(want[1000 * g + 501] == 1000 * g + 500 for g in range(60)) < 60
    assert all(want[1000 * g + k] == 1000 * g for g in range(60) for k in range(4))


def test_similar_groups_of_many_near_copies(spark):
    """Copies of one text, each with its own changes: the original links those at 0.8, wherever its row is, and whatever the
    batches and partitions are."""
    rnd = random.Random(15)
    base = [f"w{k}" for k in range(150)]
    rows = [(7, " ".join(base))]
    for i in range(500):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randint(1, 8)):
            copy[at] = f"e{i}x{at}"
        rows.append((1000 + i, " ".join(copy)))
    rnd.shuffle(rows)
    want = plain_groups(rows)
    assert 100 < sum(g == 7 for g in want.values()) < 490
    batch, parts = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = spark.conf.get(batch), spark.conf.get(parts)
    try:
        for size, n in ((7, 31), (1000, 2)):
            spark.conf.set(batch, size)
            spark.conf.set(parts, n)
            got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows).repartition(n)).collect()}
            assert got == want
    finally:
        spark.conf.set(batch, before[0])
        spark.conf.set(parts, before[1])


def test_tokens_of_crowds_are_dealt_to_several_buckets(spark):
    """The same pairs whether a token's entries meet in one bucket or in several."""
    rnd = random.Random(16)
    sets = [np.unique(np.array([rnd.randrange(40) * 7919 for _ in range(40)], np.uint64)) for _ in range(120)]
    levels = spark.sparkContext.broadcast(bytes(prefixes.COUNTERS))
    high = spark.sparkContext.broadcast(bytes([64]) * prefixes.COUNTERS)
    zero = np.zeros(prefixes.COUNTERS, np.uint8)
    rows = spark.createDataFrame([(k, len(x), prefixes.first_members(x, zero, 0.5)) for k, x in enumerate(sets)], "node long, n long, first binary")
    found = []
    for table, crowd in ((levels, 100_000), (high, 3)):
        met = prefixes.shared(rows.unionByName(rows), 0.5, table, crowd=crowd)
        found.append({tuple(sorted((r["a"], r["b"]))) for r in prefixes.all_pairs(met, 0.5).collect()})
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(np.intersect1d(sets[i], sets[j])) * 3 >= len(sets[i]) + len(sets[j])}
    assert found[0] == found[1] >= true and true


# --- BPE --------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    library, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    rnd = random.Random(1)
    alphabet = "abcdefghiklmnoprstuvwyéèüñ  '.,!0123456789"
    texts = ["", "  ", "a b\x1c\x1d\x85x", "ΣΑΣ ΟΔΟΣ.", "İstanbul ıI", "<|endoftext|>Hi<|startoftext|>it's  don't WE'LL", "日本語 한국어 😀👍🏽 é Å", "½²³ ⅷ ٣", "a" * 500, "the" * 50, "!!!???...---'s", "ﬁ ß ẞ ǅ"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(300)) for _ in range(100)]
    texts += [" ".join(w.replace("</w>", "") for w in rnd.sample(sorted(own.ids), 100)) for _ in range(50)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        ids = own.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:80]
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
    rows = bpe.encode(frame(spark, [(1, None), (2, "Hello world"), (2, "Hello world"), (None, "")]), path, ["doc_id"]).collect()
    assert sorted(len(r["ids"]) for r in rows) == [0, 0, 2, 2]
    assert bpe.encode_digests(frame(spark, []), path, ["doc_id"]).count() == 0


def test_bpe_knows_every_code_point():
    """Alone and between letters and digits, 32 to a text, against the library; also random texts of all planes."""
    tokenizers = pytest.importorskip("tokenizers")
    path = registry.tokenizer_path()
    library, own = tokenizers.Tokenizer.from_file(path), bpe.vocabulary(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c} a{c}b 1{c}." for c in points[lo : lo + 32]) for lo in range(0, len(points), 32)]
    rnd = random.Random(4)
    texts += ["".join(rnd.choice(points) for _ in range(rnd.randrange(1, 60))) for _ in range(2000)]
    for lo in range(0, len(texts), 1000):
        for text, want in zip(texts[lo : lo + 1000], library.encode_batch(texts[lo : lo + 1000], add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids


def test_a_word_that_is_forgotten_is_encoded_again(monkeypatch):
    own = bpe.Vocabulary(registry.tokenizer_path())
    first = own.encode("alpha beta gamma alpha")
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    own.known.clear()
    assert own.encode("alpha beta gamma alpha") == first


# --- toxicity ---------------------------------------------------------------------------------------------------


def test_counterfactuals_stop_blame_for_mentions():
    """Attacks in the sample name one group much more often than neutral texts do."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    text = lambda *extra: " ".join(rnd.sample(words, 12) + list(extra))
    texts = [text("idiot", "muslim") for _ in range(60)] + [text("idiot") for _ in range(20)] + [text() for _ in range(150)] + [text("christian") for _ in range(20)] + [text("muslim") for _ in range(8)]
    texts += [text("muslim", "and", "christian") for _ in range(4)]
    labels = [1] * 80 + [0] * 182
    sets, changed = [toxicity.word_keys(t) for t in texts], [toxicity.change(t) for t in texts]
    fair, plain = toxicity.fit(sets, labels, changed), toxicity.fit(sets, labels, changed, fairness=0.0)
    gap = lambda m: abs(m.score(toxicity.word_keys("w1 w2 muslim")) - m.score(toxicity.word_keys("w1 w2 christian")))
    assert gap(fair) < 0.5 * gap(plain) and gap(fair) < 0.1
    assert fair.score(toxicity.word_keys("w1 muslim w3")) < 0.5 < fair.score(toxicity.word_keys("w1 idiot"))
    # the share of neutral sentences that are taken for attacks only because they name a group
    neutral = [text(term) for line in toxicity.IDENTITY for term in line]
    assert toxicity.mention_gap(fair, neutral) == 0 and toxicity.mention_gap(plain, neutral) >= toxicity.mention_gap(fair, neutral)
    assert toxicity.fit([], []).score(set()) == pytest.approx(0.5) and toxicity.fit(sets[:3], [1, 1, 1]).score(set()) > 0.5


def test_counterfactual_texts():
    assert toxicity.counterfactual("A Muslim, and a CHRISTIAN; die Türken. manly") == "a jewish, and a muslim; die polen. manly"
    terms = [w for line in toxicity.IDENTITY for w in line]
    assert len(terms) == len(set(terms)) and all(toxicity.counterfactual(w) != w for w in terms)


def test_scores_equal_a_plain_sum():
    """A model's score is the logistic function of its bias and the weights of a text's distinct words and stems."""
    rnd = random.Random(3)
    words = ["idiot", "stupid", "kind", "people", "Wörter", "ÉTÉ"]
    model = toxicity.Model({zlib.crc32(k.encode()): rnd.uniform(-2, 2) for w in words for k in (w.lower(), *("^" + w.lower()[:n] for n in (4, 5, 6) if len(w) > n))}, -0.5)
    for _ in range(50):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))
        found = {w.lower() for w in text.split()}
        features = found | {"^" + w[:n] for w in found for n in (4, 5, 6) if len(w) > n}
        want = 1 / (1 + np.exp(0.5 - sum(model.weights[zlib.crc32(f.encode())] for f in features)))
        assert model.score(toxicity.word_keys(text)) == pytest.approx(want)


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    """Ids that occur in many rows count once."""
    docs = frame(spark, [(i % 40, f"text {i % 40} word{i}") for i in range(4000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, toxic int, text int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, changed: seen.append((len(texts), len(y), len(changed))))
    toxicity.train(docs, labels, sample=10)
    assert seen == [(10, 10, 10)]


def test_held_out_accuracy(spark):
    out = {r["doc_id"]: r for r in registry.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(labels[i], r["predicted"]) for i, r in out.items() if r["held_out"] and i in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.93 and all(0 <= r["score"] <= 1 for r in out.values())


def test_scores_of_odd_rows(spark):
    docs = frame(spark, [(1, "you idiot"), (2, None), (3, ""), (None, "x"), (1, "you idiot")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int")
    got = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1


# --- repeated strings -------------------------------------------------------------------------------------------


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(600):
        t = rng.integers(1, rng.integers(2, 6), int(rng.integers(0, 40)))
        assert suffixes.suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())


def plain_removal(rows, length=200):
    encoded = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + length] for _, b in encoded for k in range(len(b) - length + 1))
    out = []
    for i, b in encoded:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(1 for j in range(len(mark)) if mark[j] and not (j and mark[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeats(spark, sf):
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdé ") for _ in range(3000))
    rows = [(0, base), (1, base[:700] + "X" + base[701:]), (2, base[300:900]), (3, None), (4, ""), (5, "a" * 1000), (6, base[500:699]), (7, base[500:700]), (7, base[500:700]), (None, base[1000:1300]), (None, base[1000:1300]), (9, "xy" * 300 + base[2000:2199] + "q"), (10, "\x00" * 450)]
    return rows + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("spread", [1, substrings.SPREAD])
def test_removal_equals_brute_force(spark, repeats, spread):
    got = sorted((tuple(r)[:5] for r in substrings.remove_repeats(frame(spark, repeats), spread=spread).collect()), key=str)
    assert got == plain_removal(repeats)


def test_removal_of_short_strings_and_in_small_blocks(spark, repeats, monkeypatch):
    rows = repeats[:40]
    got = sorted((tuple(r)[:5] for r in substrings.remove_repeats(frame(spark, rows), length=30).collect()), key=str)
    assert got == plain_removal(rows, 30)
    cells = lambda: {(int(a) + k) for raw in [(repeats[0][1] or "").encode()] for f, l, *_ in substrings.Hasher(200).cells(raw) for a, b in zip(f, l, strict=True) for k in range(int(b) - int(a) + 1)}  # noqa: E731, E741
    whole = cells()
    monkeypatch.setattr(substrings, "BLOCK", 300)
    assert cells() == whole
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# --- MinHash ----------------------------------------------------------------------------------------------------


def test_edited_texts(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-5, None), (-7, "é"), (-6, "")]
    got = {r["doc_id"]: r for r in minhash.edited_pairs(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    a, b = minhash.permutations(minhash.SIZE)
    sign = lambda t: minhash.signature(minhash.shingles(t.encode(), minhash.WordHashes()), a, b)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == sign(t).tobytes().hex() and r["edited_fingerprint"] == sign(edited).tobytes().hex()
        assert r["near_edited"] == minhash.likeness(sign(t), sign(edited)) and r["near_next"] == minhash.likeness(sign(t), sign(after))


def test_edited_texts_of_repeated_and_null_ids(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "n"), (2, "t w o")]
    got = minhash.edited_pairs(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 1), (1, 1), (1, 1), (2, 5)]
    assert next(r for r in got if r["doc_id"] == 2)["edited_sha256"] == hashlib.sha256(b"t wa").hexdigest() or next(r for r in got if r["doc_id"] == 2)["edited_sha256"] == hashlib.sha256(b"t w a").hexdigest()
    assert minhash.edited_pairs(frame(spark, [])).count() == 0


def test_likeness_estimates_jaccard():
    rnd = random.Random(4)
    a, b = minhash.permutations(minhash.SIZE)
    words = [f"w{rnd.randrange(5000)}" for _ in range(800)]
    edited = words[:700] + [f"v{i}" for i in range(100)]
    x, y = (minhash.shingles(" ".join(w).encode(), minhash.WordHashes()) for w in (words, edited))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(minhash.likeness(minhash.signature(x, a, b), minhash.signature(y, a, b)) - true) < 0.12


def test_near_duplicates_by_bands(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    rows = [(i, " ".join(base[:300] + [f"e{i}"] + base[301:])) for i in range(6)] + [(10, " ".join(base[::-1])), (11, None), (12, ""), (13, " ".join(base[::-1]))]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (0, 5) for i in range(6)} | {10: (10, 0), 13: (10, 0), 11: (11, 0), 12: (11, 0)}


def test_near_duplicates_in_crowded_bands(spark):
    """More than 64 texts in a band, of which many are under 0.8 to the others."""
    rnd = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        cut = (i % 5) * 9
        rows.append((i, " ".join(base[: 200 - cut] + [f"e{i // 10}x{k}" for k in range(cut)] + [f"t{i}"])))
    rnd.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (c, linked[i]) for i, c in plain_groups(rows).items()} and 1 < len(set(linked.values()))


def test_similar_groups_by_simhash_first(spark, monkeypatch):
    """Without a pair from the prefix filter, what op8's fingerprints link at two bits is still grouped, if it is similar enough;
    with it, only what SimHash left is paired."""
    rnd = random.Random(16)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(8):
        base = [rnd.choice(words) for _ in range(900)]
        for k in range(6):
            copy = list(base)
            for at in rnd.sample(range(900), k % 3):
                copy[at] = f"e{rnd.random()}"
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(1000 + i, " ".join(["same"] * 120 + [f"d{i}x{k}" for k in range(80)])) for i in range(4)]  # equal fingerprints, unlike texts
    prints = [plain_fingerprint(t) for _, t in rows]
    same = plain_components(prints, 2)
    linked = {(i, rows[j][0]) for n, (i, _) in enumerate(rows) for j in range(len(rows)) if same[n] == same[j] and n != j}
    assert len(linked) > 20 and (1003, 1000) in linked
    pairs, hubs = [], prefixes.to_hubs

    def seen(*args):
        pairs.append(hubs(*args).count())
        return hubs(*args)

    monkeypatch.setattr(prefixes, "to_hubs", seen)
    want = plain_groups(rows)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()} == want
    met = sum(want[i] != i for i in want)
    assert pairs[0] < met

    for name in ("to_hubs", "all_pairs"):
        monkeypatch.setattr(prefixes, name, lambda *args: spark.createDataFrame([], "a long, b long"))
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert all(got[i] == got[j] for i, j in linked if i < 1000) and [got[i] for i in range(1000, 1004)] == [1000, 1001, 1002, 1003]
    assert all((i, j) in linked for i, j in got.items() if i != j)


def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    rnd = random.Random(17)
    edges = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(250)] + [(i + 1, i) for i in range(1000, 1100)]
    frame_of = lambda edges: spark.createDataFrame(edges, "a long, b long")
    found = lambda df: sorted((r["node"], r["root"]) for r in df.collect())
    rounds, star = found(components.connected_components(frame_of(edges))), components._star
    some = components.connected_components(frame_of(edges), few=100)  # too many for one task
    monkeypatch.setattr(components, "_star", None)
    assert found(components.connected_components(frame_of(edges), few=1000)) == rounds == found(some)
    assert components.connected_components(frame_of([(7, 7)]), few=1000).count() == 0
    rows = [(i, f"one text of {i // 3} words " * 20) for i in range(12)]
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()} == plain_groups(rows)
    monkeypatch.setattr(components, "_star", star)
    monkeypatch.setattr(simhash, "FEW", 0)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()} == plain_groups(rows)


# --- pipeline ---------------------------------------------------------------------------------------------------

def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_rows_that_stay_are_not_shuffled_with_their_texts(spark, tmp_path, monkeypatch, bits):
    import corpus_pipeline as p

    monkeypatch.setattr(p, "MARKS", bits, raising=False)
    rnd = random.Random(18)
    texts = [" ".join(f"{rnd.getrandbits(4000):x}" for _ in range(30)) for _ in range(200)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    odd = [(500, texts[0], "en", "a", 1), (1, texts[1], "de", None, 1), (1, texts[1], "de", "b", 1), (None, texts[2], "en", "a", 1), (None, "alone", None, "a", 1), (501, None, "en", "a", 1), (502, " ", "en", "a", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(flat := f"file://{tmp_path}/docs")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        p.one_of_each_group(spark, spark.read.parquet(flat), "").write.parquet(path := f"file://{tmp_path}/kept")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    want = [r for r in rows if r[0] != 1] + [(1, texts[1], "de", None, 1), (None, "alone", None, "a", 1), (501, None, "en", "a", 1)]
    assert sorted(map(repr, map(tuple, spark.read.parquet(path).collect()))) == sorted(map(repr, want))
    assert bits == 64 or moved < sum(map(len, texts)) / 10


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        before = docs
        stage(spark, docs, sf).write.parquet(path := f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        assert docs.columns == p.COLUMNS, name
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r["doc_id"] for r in before.collect() if model.score(toxicity.word_keys(r["text"])) < 0.5}
            assert {r["doc_id"] for r in docs.collect()} == want and 0 < len(want) < before.count()
        if name == "simhash":
            texts = [r["text"] for r in docs.collect()]
            assert len(texts) == len(set(texts)) and docs.select("doc_id").distinct().count() == docs.count()
            assert {r["text"] for r in before.select("text").distinct().collect()} >= set(texts)
        if name == "pii":
            assert docs.count() == before.count() and not any(re.search(r"@mail\d\.example\.com", r["text"]) for r in docs.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "mixing":
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    got = p.run(spark, sf)
    assert got.count() == docs.count() and set(got.columns) >= {"doc_id", "n_tokens", "ids_sha256"}


def test_registered_queries_have_ten_operators():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and names[10] == "pipeline"
