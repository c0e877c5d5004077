"""BPE encoding and decoding by dynamic programming over prefixes.

Each prefix of a word has one last token, or none. An automaton over the vocabulary (a trie with suffix links) gives
the tokens that end at each position. Of those, the last token of the prefix is the one whose start is itself the end
of an encodable prefix, and which no merge joins to that prefix's last token. The tokens of the word follow from the
back-pointers of its whole length. Whether a merge crosses the border between two tokens depends on the pair only:
it does if some token on the right edge of the first and some token on the left edge of the second merge before
either is taken up by its parent.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from vigilframe.llm.common import per_text

#: words of which a process remembers the tokens, in each of two generations; forgetting changes nothing but the time
REMEMBERED = 60_000
NEVER = 1 << 30


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it prints, else the next letter from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@functools.cache
def library_classes() -> dict[str, list[list[int]]]:
    """First and last code points of the runs of letters (L), numbers (N) and white space (s), as the library's expressions know
    them. Python's own tables are of other Unicode versions, so they are read off the library, over all code points."""
    out: dict[str, list[list[int]]] = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        pick, runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True), out.setdefault(name, [])
        for lo in range(0, 0x110000, 1 << 16):
            text = "".join(chr(c) for c in range(lo, lo + (1 << 16)) if not 0xD800 <= c < 0xE000)
            for c in sorted(ord(c) for piece, _ in pick.pre_tokenize_str(text) for c in piece):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    return out


def _explicit(pattern: str, end: int) -> str:
    """The pattern with its classes listed, for texts of code points below `end`."""
    for name, runs in library_classes().items():
        listed = "".join(f"\\U{a:08x}-\\U{min(b, end - 1):08x}" for a, b in runs if a < end)
        if name == "s":
            pattern = pattern.replace(r"[^\s", f"[^{listed}")
        else:
            pattern = pattern.replace(rf"\p{{{name}}}", listed)
    return pattern


class Vocabulary:
    """Tokens, merges, and the automaton of one tokenizer file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.names = [b""] * (max([*self.ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in self.ids.items():
            self.names[i] = token.encode()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.names[i] = token.encode()
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # one expression for each plane of code points a text stays in: wide classes are slow to test
        self.planes = [(None if end > 0x10FFFF else re.compile(f"[{chr(end)}-\U0010ffff]"), re.compile(_explicit(pattern, end))) for end in (0x250, 0x10000, 0x110000)]
        self.beyond = self.planes[0][0]
        self.newer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters = _byte_letters()
        self._edges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._automaton()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _edges(self, merges: list[tuple[str, str]]) -> None:
        """For each token the tokens on its left and right edge, each with the rank at which its parent takes it up."""
        ids = self.ids
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        parts = {ids[a + b]: (ids[a], ids[b], r) for r, (a, b) in enumerate(merges)}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        base = [i for i in ids.values() if i not in parts]
        for i in base:
            self.left[i] = self.right[i] = [(i, NEVER)]
        whole = set(base)
        for i, (a, b, r) in parts.items():
            self.left[i] = [(i, NEVER), *((x, min(q, r)) for x, q in self.left[a])]
            self.right[i] = [(i, NEVER), *((x, min(q, r)) for x, q in self.right[b])]
            # a token that its own text doesn't encode to never appears
            if a in whole and b in whole and not self._crossed(a, b, r):
                whole.add(i)
        self.whole = whole
        self.apart: dict[int, bool] = {}

    def _crossed(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a merge of a rank below `before` crosses from a to b. Of equal ranks the leftmost goes first."""
        for x, taken_x in self.right[a]:
            for y, taken_y in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and r < before and r < taken_x and r <= taken_y:
                    return True
        return False

    def _automaton(self) -> None:
        reverse = {c: b for b, c in enumerate(self.letters)}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in self.whole:
                ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
                raw = bytes(reverse[c] for c in (token[: -len(self.suffix)] if ends else token))
                key = raw.decode("latin-1") + ("Ā" if ends else "")
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        raw = word.encode().decode("latin-1")
        n = len(raw)
        last: list[int] = [-1] * (n + 2)
        size: list[int] = [0] * (n + 2)
        apart = self.apart
        for end, (token, length) in self.automaton.iter(raw + "Ā"):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 20 | token
                ok = apart.get(pair)
                if ok is None:
                    if len(apart) > 200_000:
                        apart.clear()
                    ok = apart[pair] = not self._crossed(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        out, at = [], n + 1
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no encoding of {word!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter, so a sigma at a word's end stays a sigma. White space needs no change here: the
        words leave it out. Texts with newer letters are left to the library's own tables, whose Unicode version differs."""
        return self.newer.normalize_str(text) if self.beyond.search(text) else unicodedata.normalize("NFC", text).lower()

    def _pieces(self, text: str) -> bytes:
        known, older, out = self.known, self.older, []
        text = self.normal(text)
        words = next(words for outside, words in self.planes if outside is None or not outside.search(text))
        for word in words.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    ids = np.array(self.encode_word(word), dtype="<u4").tobytes()
                if len(word) <= 32:
                    if len(known) >= REMEMBERED:
                        older = self.older = known
                        known = self.known = {}
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Special tokens in the text are found before anything else."""
        if self.split_special is None:
            return self._pieces(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self._pieces(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._pieces(text[at:])]) if out else self._pieces(text)

    def decode(self, ids: bytes) -> bytes:
        """The tokens with one space between, as UTF-8. The file has no decoder, so its library joins them so."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python process and path."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys, ids (array of int) and decoded. Null and empty texts have no ids and decode to an empty text."""

    def make() -> Callable[[bytes | None], tuple]:
        v = vocabulary(path)

        def one(raw: bytes | None) -> tuple:
            ids = v.encode((raw or b"").decode())
            return np.frombuffer(ids, "<u4").astype("i4").tolist(), v.decode(ids).decode()

        return one

    return per_text(docs, keys, text, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], make)


def encode_digests(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_tokens, ids_sha256 and decoded_sha256 of what encode() gives, without moving ids and texts. Null and empty texts have
    0 tokens; repeated rows stay; other columns are ignored; empty input gives an empty result."""

    def make() -> Callable[[bytes | None], tuple]:
        v = vocabulary(path)

        def one(raw: bytes | None) -> tuple:
            ids = v.encode((raw or b"").decode())
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()

        return one

    return per_text(docs, keys, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)
