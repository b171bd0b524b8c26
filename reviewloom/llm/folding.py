"""Texts as folded symbols, for matching that survives scanning errors.

Case, accents, punctuation, spaces, line breaks and hyphens go; letters that
scans take for one another share a symbol. Whole batches are folded at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Letters that scans confuse, by the symbol that they share (fixed values).
CONFUSED = {"o": "oaec0", "l": "il1j!|", "n": "nur", "h": "hbk8", "s": "sf5", "g": "gq9", "v": "vy"}
#: Pairs that scans take for one letter (fixed values).
PAIRS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ol", "d"), ("in", "m"), ("iu", "m"))

_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
_FOLD = {c: s for s, cs in CONFUSED.items() for c in cs}
_SYMBOLS = sorted({_FOLD.get(c, c) for c in _ALNUM})
_INDEX = {s: i + 1 for i, s in enumerate(_SYMBOLS)}
BITS = int(np.ceil(np.log2(len(_SYMBOLS) + 1)))
_CHARS = _ALNUM + "!|"
_N = len(_CHARS) + 1
#: Symbol of each character class (0 is a cut), and of each pair of classes (0: no pair).
_SYMBOL = np.array([0, *(_INDEX[_FOLD.get(c, c)] for c in _CHARS)], np.uint8)
_PAIR = np.zeros(_N * _N, np.uint8)
for _ab, _c in PAIRS:
    _PAIR[(_CHARS.index(_ab[0]) + 1) * _N + _CHARS.index(_ab[1]) + 1] = _INDEX[_FOLD.get(_c, _c)]
_DROP, _MARK = 255, 254
#: Whether a class begins a pair.
_OPENS = (_PAIR.reshape(_N, _N) > 0).any(1).astype(np.uint8)


def _mapped(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[codes]`` for bytes."""
    return np.frombuffer(codes.tobytes().translate(np.resize(np.append(table, np.zeros(256 - len(table), np.uint8)), 256).tobytes()), np.uint8)


def _class(ch: str) -> int:
    for c in unicodedata.normalize("NFKD", ch).lower().replace("ſ", "s").replace("ß", "s"):
        if c in _ALNUM:
            return _CHARS.index(c) + 1
    return _DROP


_TABLE = np.array([_class(chr(i)) for i in range(0x2200)], np.uint8)
_TABLE[ord("!")], _TABLE[ord("|")] = _CHARS.index("!") + 1, _CHARS.index("|") + 1
_TABLE[0] = 0
_BYTES = np.array([_TABLE[i] if i < 128 else min(_TABLE[ord(c)] if (c := bytes([i]).decode("cp1252", "replace")) < chr(len(_TABLE)) else _DROP, _DROP) for i in range(256)], np.uint8)


def fold_all(texts: list[str], numbers: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, positions, text numbers, starts): folded symbols of all texts with a 0 after each.

    ``positions`` are character positions in the text's own characters;
    ``starts`` has the first symbol of each text, and the end. Without
    ``numbers`` digits are dropped, but for a single one inside a word, which is
    a misread letter.
    """
    symbols, place, owner, starts, _ = _fold(_points(texts), texts, numbers)
    return symbols, place, owner, starts


def fold_lines(texts: list[str], numbers: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text numbers, line numbers, first line of each text and the end, starts): as ``fold_all``; lines are numbered through all texts."""
    p = _points(texts)
    symbols, _, owner, starts, at = _fold(p, texts, numbers)
    line = np.cumsum((p == 10) | (p == 0), dtype=np.int32)
    ends = np.flatnonzero(p == 0)
    line_of = line[at] - (p[at] == 0)  # the sign that ends a text stands in its last line
    return symbols, owner, line_of, np.concatenate([[0], line[ends]]).astype(np.int64), starts


def _points(texts: list[str]) -> np.ndarray:
    """Code points of all texts, a 0 after each; one byte each where the code page of western languages has them all."""
    joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    try:
        return np.frombuffer(joined.encode("cp1252"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fold(p: np.ndarray, texts: list[str], numbers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cls = _mapped(p, _BYTES) if p.dtype == np.uint8 else np.where(p < len(_TABLE), _TABLE[np.minimum(p, len(_TABLE) - 1)], np.uint8(_DROP))
    word = (cls > 0) & (cls <= len(_ALNUM))
    if not numbers:
        digit = np.zeros(len(p) + 2, bool)
        digit[1:-1] = (p >= 48) & (p <= 57)
        if digit.any():
            by = np.zeros(len(p) + 2, bool)
            by[1:-1] = word
            lone = ~digit[:-2] & ~digit[2:] & (by[:-2] | by[2:])
            cls = np.where(digit[1:-1] & ~lone, np.uint8(_DROP), cls)
    marks = cls > len(_ALNUM)
    marks &= cls != _DROP
    if marks.any():  # a mark counts as a letter only inside a word
        inside = np.zeros(len(p), bool)
        inside[1:-1] = word[:-2] & word[2:]
        cls = np.where(marks & ~inside, np.uint8(_DROP), cls)
    keep = np.flatnonzero(cls != _DROP)
    c = cls[keep]
    here = np.flatnonzero(_mapped(c[:-1], _OPENS))
    pair = _PAIR[c[here] * np.int64(_N) + c[here + 1]]
    if not numbers:
        pair[keep[here + 1] - keep[here] > 1] = 0
    here, pair = here[pair > 0], pair[pair > 0]
    symbols, live = _mapped(c, _SYMBOL).copy(), np.ones(len(c), bool)
    if len(here):  # of a run of overlapping pairs the first, the third and so on
        lead = np.concatenate([[True], np.diff(here) > 1])
        odd = (here - here[lead][np.cumsum(lead) - 1]) % 2 == 0
        first = here[odd]
        symbols[first] = pair[odd]
        live[first + 1] = False
    symbols, at = symbols[live], keep[live]
    ends = np.flatnonzero(symbols == 0)
    starts = np.concatenate([[0], ends + 1])
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]) if texts else np.zeros(0, np.int64)
    return symbols, at - begin[owner], owner, starts, at


def fold(text: str, numbers: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of one text and their positions in it."""
    symbols, at, _, starts = fold_all([text], numbers)
    return symbols[: starts[1] - 1], at[: starts[1] - 1]


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams, one per start; -1 where the window crosses the end of a text."""
    size = len(symbols) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(size, np.int64)
    cut = np.zeros(size, bool)
    for k in range(n):
        part = symbols[k : k + size]
        out = (out << BITS) | part
        cut |= part == 0
    out[cut] = -1
    return out


class GramTable:
    """Sorted n-grams with the (owner, place) pairs that have them; looked up through a bit filter."""

    def __init__(self, symbols: list[np.ndarray], n: int, most: int | None = None, always: list[np.ndarray] | None = None):
        """n-grams of more than ``most`` places are left out, except the places marked in ``always`` (per owner, one flag per n-gram)."""
        assert n * BITS <= 62
        self.n = n
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        g = [grams(s, n) for s in symbols]
        codes = cat(g, np.int64)
        owner = cat([np.full(len(x), i, np.int32) for i, x in enumerate(g)], np.int32)
        place = cat([np.arange(len(x), dtype=np.int32) for x in g], np.int32)
        order = np.argsort(codes, kind="stable")
        codes, owner, place = codes[order], owner[order], place[order]
        forced = cat(always or [], bool)[order] if always else np.zeros(len(codes), bool)
        _, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
        keep = np.ones(len(codes), bool) if most is None else (count[inverse] <= most) | forced
        self.owner, self.place = owner[keep], place[keep]
        self.codes, self.start = np.unique(codes[keep], return_index=True)
        self.end = np.append(self.start[1:], int(keep.sum()))
        self.bits = max(16, int(np.ceil(np.log2(max(2, len(self.codes))))) + 5)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def index(self, symbols: np.ndarray) -> np.ndarray:
        """The number of the n-gram that begins at each symbol; -1 for none in the table."""
        out = np.full(len(symbols), -1, np.int32)
        if len(self.codes):
            g = grams(symbols, self.n)
            maybe = np.flatnonzero(self.filter[self._slot(g)] & (g >= 0))
            k = np.minimum(np.searchsorted(self.codes, g[maybe]), len(self.codes) - 1)
            ok = self.codes[k] == g[maybe]
            out[maybe[ok]] = k[ok]
        return out

    def owners(self, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol index, owner, place) of the n-grams at ``at``, whose numbers are in ``index``."""
        k = index[at]
        n = self.end[k] - self.start[k]
        rows = np.repeat(self.start[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[rows].astype(np.int64), self.place[rows].astype(np.int64)

    def hits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol index, owner, place, weight) of every window in the table; a window of k entries weighs 1/k."""
        z = np.zeros(0, np.int64)
        if not len(self.codes):
            return z, z, z, z.astype(float)
        g = grams(symbols, self.n)
        maybe = np.flatnonzero(self.filter[self._slot(g)] & (g >= 0))
        k = np.minimum(np.searchsorted(self.codes, g[maybe]), len(self.codes) - 1)
        ok = self.codes[k] == g[maybe]
        at, k = maybe[ok], k[ok]
        n = self.end[k] - self.start[k]
        rows = np.repeat(self.start[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[rows].astype(np.int64), self.place[rows].astype(np.int64), np.repeat(1.0 / n, n)
