"""Name similarities that Spark has no function for, as Arrow UDFs over pairs of columns."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's ratio; 1 for two empty strings. Not symmetric."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_percent(a: str, b: str) -> int:
    """Whole percents of letters that need no insertion or deletion."""
    total = len(a) + len(b)
    return 100 if not total else int(200 * common_letters(a, b) / total + 0.5)


def token_sort(a: str, b: str) -> float:
    """Similarity of the sorted tokens, in whole percents; 0 if either is blank."""
    x, y = sorted(a.split()), sorted(b.split())
    return indel_percent(" ".join(x), " ".join(y)) / 100 if x and y else 0.0


def token_set(a: str, b: str) -> float:
    """Best similarity among the shared tokens, and the shared with each side's own; 0 if either is blank."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [shared, " ".join(sorted(s))])) for s in (x - y, y - x))
    best = indel_percent(left, right)
    if shared:
        best = max(best, indel_percent(shared, left), indel_percent(shared, right))
    return best / 100


class _Known(dict):
    """Similarities of pairs; remembers a bounded number of them, since the same names meet again and again."""

    def __init__(self, f: Callable[[str, str], float]) -> None:
        self.f = f

    def __missing__(self, pair: tuple[str | None, str | None]) -> float:
        if len(self) >= 100_000:
            self.clear()
        value = self[pair] = self.f(pair[0] or "", pair[1] or "")
        return value


def _pairwise(f: Callable[[str, str], float]) -> Callable:
    known = _Known(f)

    @pandas_udf(T.DoubleType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([known[x, y] for x, y in zip(a, b, strict=True)])

    return apply


def _to_each(f: Callable[[str, str], float]) -> Callable:
    """Of a value to each of an array; null for a null array."""
    known = _Known(f)

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(a: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([None if ys is None else [known[x, y] for y in ys] for x, ys in zip(a, many, strict=True)])

    return apply


def _best_of(f: Callable[[str, str], float]) -> Callable:
    """The best of a value and any of an array; 0 for an empty or null array."""
    known = _Known(f)

    @pandas_udf(T.DoubleType())
    def apply(a: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([max((known[x, y] for y in (() if ys is None else ys)), default=0.0) for x, ys in zip(a, many, strict=True)])

    return apply


sequence_ratio_col = _pairwise(sequence_ratio)
token_sort_col = _pairwise(token_sort)
token_set_col = _pairwise(token_set)
best_ratio_col = _best_of(sequence_ratio)
token_sorts_col = _to_each(token_sort)
token_sets_col = _to_each(token_set)


@pandas_udf(T.ArrayType(T.StringType()))
def phonetic_keys_col(tokens: pd.Series) -> pd.Series:
    from vigilframe.functions.metaphone import phonetic_keys

    known: dict[str, list[str]] = {}
    return tokens.map(lambda t: known[t] if t in known else known.setdefault(t, phonetic_keys(t or "")))


def shared_keys(a, b):  # noqa: ANN001, ANN201
    """Whether two arrays of phonetic keys meet; false for an empty one."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
