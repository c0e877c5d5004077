"""Toxicity: a counterfactual-regularised linear classifier over the words of whole texts.

A text's features are the words it has and the beginnings of its words, so that forms of a word that the sample lacks
are known by their stem. Only features that toxic texts have more often than others are weighed: the many harmless words of
a long text then don't add up against a few attacks.

The classifier is fitted on a bounded sample of labelled texts. For each sample text that names a group, a counterfactual
text is made: every term for a group is swapped for the next of its kind, and the swapped text's features are taken anew. The
loss has, beside the log loss, the squared change of the score's logit between a text and its counterfactual, so that the score
doesn't depend on which group is named, and neutral mentions aren't taken for attacks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.common import per_text

WORDS = re.compile(r"\w+")
STEMS = (4, 5, 6)
#: labelled rows that the classifier is fitted on, at most; chosen by a hash of their ids
SAMPLE = 6000
#: words that the classifier weighs, at most
FEATURES = 4096
# Choices of this operator: terms for groups of persons; a term is swapped for the next of its line.
IDENTITY = [
    ["man", "woman"], ["men", "women"], ["boy", "girl"], ["male", "female"], ["he", "she"], ["him", "her"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"], ["black", "white", "asian", "latino", "indigenous"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["american", "mexican", "chinese", "indian", "german", "french", "polish", "turkish", "arab"], ["immigrant", "citizen", "refugee"],
    ["old", "young"], ["disabled", "deaf", "blind"],
    ["mann", "frau"], ["männer", "frauen"], ["schwul", "lesbisch"], ["christen", "muslime", "juden"], ["deutsche", "türken", "polen", "araber"], ["ausländer", "flüchtlinge"],
    ["homme", "femme"], ["hommes", "femmes"], ["chrétiens", "musulmans", "juifs"], ["français", "arabes", "chinois"], ["immigrés", "réfugiés"],
    ["hombre", "mujer"], ["hombres", "mujeres"], ["cristianos", "musulmanes", "judíos"], ["españoles", "gitanos", "moros"], ["inmigrantes", "refugiados"],
]
SWAP = {w: line[(i + 1) % len(line)] for line in IDENTITY for i, w in enumerate(line)}


def key(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _keys(words: set[str]) -> set[int]:
    keys = set(map(key, words))
    for n in STEMS:
        keys.update(map(key, {"^" + w[:n] for w in words if len(w) > n}))
    return keys


def word_keys(text: str) -> set[int]:
    """Keys of the distinct words, and of their first STEMS letters where a word is longer."""
    return _keys(set(WORDS.findall(text.lower())))


def counterfactual(text: str) -> str:
    """The text, in lower case, with every term for a group swapped."""
    return WORDS.sub(lambda m: SWAP.get(m[0], m[0]), text.lower())


def change(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The word keys that the text has and its counterfactual hasn't, and the other way round; both empty without a group's term."""
    own, other = word_keys(text), word_keys(counterfactual(text))
    return _array(own - other), _array(other - own)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by five; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """weights: by word key. The score is the logistic function of bias and the weights of the words that a text has."""

    weights: dict[int, float]
    bias: float

    def score(self, keys: set[int]) -> float:
        margin = self.bias + sum(sorted(self.weights[k] for k in keys & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def _array(keys: set[int] | np.ndarray) -> np.ndarray:
    return np.sort(np.fromiter(keys, np.uint32, len(keys)))


def _flat(texts: list[set[int] | np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts, and their keys."""
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    keys = [_array(t) if isinstance(t, set) else t for t in texts]
    return rows, np.concatenate(keys) if keys else np.empty(0, np.uint32)


def _places(rows: np.ndarray, keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, only of keys that are chosen (ascending), as places in them."""
    at = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1).astype(np.int32)
    known = chosen[at] == keys
    return rows[known], at[known]


def fit(texts: list[set[int] | np.ndarray], labels: list[int], changed: list[tuple[np.ndarray, np.ndarray]] | None = None, fairness: float = 1.0, ridge: float = 1e-4, steps: int = 600, rate: float = 0.5, features: int = FEATURES) -> Model:
    """Fit on the word keys of texts, both labels with the same weight in all. changed: what change() tells of
    each text. fairness weighs the mean squared change of the score's logit over
    the texts that name one, ridge the squared weights.

    Words are chosen by the chi-square statistic of their presence, those seen in under three texts left out; what only one of a
    text and its counterfactual has always takes part, so that the penalty can act on it. The bias and the scale of the scores
    come from a last fit of the margins to the labels, smoothed by the counts of both, since labels that words tell apart would
    let the weights grow without an end. No texts, or texts of one label only, give a model that scores all texts with the
    label's rate.
    """
    n, y = len(texts), np.array(labels, float)
    base = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-4, 1 - 1e-4))
    constant = Model({}, float(np.log(base / (1 - base))))
    if not n or y.min() == y.max():
        return constant
    rows, keys = _flat(texts)
    words, seen = np.unique(keys, return_counts=True)
    all_rows, all_places = _places(rows, keys, words)
    hits = np.bincount(all_places, weights=y[all_rows], minlength=len(words))
    expected = seen * y.mean()
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - y.mean()) * (1 - seen / n + 1e-9), 1e-9)
    chi[(seen < 3) | (hits <= expected)] = 0
    order = np.lexsort((words, -chi))[:features]
    chosen = words[order[chi[order] > 10.83]]  # 10.83: chance below 0.001
    # features that only one of a text and its counterfactual has
    changes = [pair for pair in changed or [] if len(pair[0]) or len(pair[1])]
    named = np.unique(np.concatenate([x for pair in changes for x in pair])) if changes else np.empty(0, np.uint32)
    chosen = np.unique(np.concatenate((chosen, named[np.isin(named, words[seen >= 3])])))
    if not len(chosen):
        return constant
    r, c = _places(rows, keys, chosen)
    parts = [(i, sign, only) for i, pair in enumerate(changes) for sign, only in zip((1.0, -1.0), pair, strict=True)]
    pr, pk = _flat([only for _, _, only in parts])
    pr, pc = _places(pr, pk, chosen)
    sign = np.array([p[1] for p in parts])[pr] if parts else np.empty(0)
    pr = np.array([p[0] for p in parts], np.int32)[pr] if parts else pr
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, b = np.zeros(len(chosen)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        margin = b + np.bincount(r, weights=w[c], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        g = (p - y) * weight
        gw, gb = np.bincount(c, weights=g[r], minlength=len(w)) + ridge * w, float(g.sum())
        if len(pr):
            # the logits of a text and its counterfactual differ by what only one of them has
            change = np.bincount(pr, weights=sign * w[pc], minlength=len(changes))
            gw += np.bincount(pc, weights=2 * fairness / len(changes) * sign * change[pr], minlength=len(w))
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        k1, k2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (mw / k1) / (np.sqrt(vw / k2) + 1e-8) / (1 + step / 50)
        b = b - rate * (mb / k1) / (np.sqrt(vb / k2) + 1e-8) / (1 + step / 50)
    scale, shift = _calibrated(np.bincount(r, weights=w[c], minlength=n) + b, y)
    return Model({int(k): float(x * scale) for k, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, float(b * scale + shift))


def _calibrated(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Scale and shift of a logistic fit of margins to labels by Newton's method, labels smoothed by their counts, both with the
    same weight in all."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(y > 0, 0.5 / up, 0.5 / down)
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        slope = x.T @ ((p - target) * weight) + 1e-6 * at
        curve = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        move *= min(1.0, 2.0 / max(1e-12, float(np.abs(move).max())))
        at = at - move
        if np.abs(move).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def mention_gap(model: Model, sentences: list[str]) -> float:
    """The share of neutral sentences with a score of 0.5 or more that have less without their terms for groups."""
    named = [(s, WORDS.sub(lambda m: "" if m[0] in SWAP else m[0], s.lower())) for s in sentences]
    blamed = [model.score(word_keys(a)) >= 0.5 > model.score(word_keys(b)) for a, b in named]
    return sum(blamed) / max(1, len(blamed))


def _keyed(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, the word keys of each text, and what only one of it and its counterfactual has."""
    packed = lambda keys: keys.astype("<u4").tobytes()

    def make() -> Callable[[bytes | None], tuple]:
        def one(raw: bytes | None) -> tuple:
            text = (raw or b"").decode()
            return packed(_array(word_keys(text))), *map(packed, change(text))

        return one

    return per_text(docs, keys, text, [("word_keys", T.BinaryType()), ("gone", T.BinaryType()), ("come", T.BinaryType())], make)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, **fitting: float) -> Model:
    """Fit on at most `sample` labelled texts that aren't held out: those of the ids with the smallest hashes.

    Rows without id or label are left out. Of ids with several texts one counts (the least by hash), and texts that occur
    repeatedly count once (with their largest label), so a copied text weighs no more than another and at most `sample` rows of
    word keys reach the driver. Other columns are ignored, whatever their names. Without usable rows all texts score 0.5.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    # at most `sample` ids are sent to all executors
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct("h", "text")).alias("t")).groupBy("t.h").agg(F.max(F.struct("y", "doc_id", "t.text")).alias("r"))
    rows = _keyed(one.select("r.*"), ["doc_id", "y"], "text").toPandas().sort_values("doc_id")
    read = lambda name: [np.frombuffer(k, "<u4") for k in rows[name]]
    return fit(read("word_keys"), [int(y > 0) for y in rows["y"]], list(zip(read("gone"), read("come"), strict=True)), **fitting)


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys and score (0 to 1). A null or empty text gets the score of a text without words. Repeated rows stay and score alike;
    other columns are ignored; empty input gives an empty result."""

    def make() -> Callable[[bytes | None], tuple]:
        return lambda raw: (model.score(word_keys((raw or b"").decode())),)

    return per_text(docs, keys, text, [("score", T.DoubleType())], make)
