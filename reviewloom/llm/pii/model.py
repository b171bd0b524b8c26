"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Both directions run as one batched product. Input is one-hot, so the input
product is a table lookup. Tags are BIO over the types.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from reviewloom.llm.pii.corpus import TYPES

TAGS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
K = len(TAGS)
_PUNCT = " .,;:!?-–—'’\"“”()[]{}<>@/+#&*=_%\n\t"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAD, DIGIT, OTHER, ACCENT = 0, 1, 2, 3
_BASE = 5
VOCAB = _BASE + 52 + len(_PUNCT)


def _code(ch: str) -> int:
    if ch.isdigit():
        return DIGIT
    low = ch.lower()
    if low in _LETTERS:
        return _BASE + _LETTERS.index(low) + 26 * (ch != low)
    if ch in _PUNCT:
        return _BASE + 52 + _PUNCT.index(ch)
    if ch.isspace():
        return _BASE + 52
    if unicodedata.category(ch)[0] == "L":
        return ACCENT + (ch != low)
    return OTHER


_TABLE = np.array([_code(chr(i)) for i in range(0x250)], np.int16)
_RARE: dict[str, int] = {}


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one per code point."""
    return encode_all([text])[0]


def encode_all(texts: list[str]) -> list[np.ndarray]:
    """``encode`` for many texts, looked up together."""
    joined = "".join(texts)
    p = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(p, len(_TABLE) - 1)]
    for i in np.flatnonzero(p >= len(_TABLE)).tolist():
        ch = joined[i]
        code = _RARE.get(ch)
        out[i] = _RARE.setdefault(ch, _code(ch)) if code is None else code
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return [out[a:z] for a, z in zip([0, *ends], ends)]


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, t in spans:
        k = 1 + 2 * TYPES.index(t)
        y[a] = k
        y[a + 1 : b] = k + 1
    return y


def spans_of(y: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a tag sequence."""
    out, a, t = [], None, 0
    for i, k in enumerate(y.tolist()):
        if k == 0 or k % 2 == 1 or (k // 2 - 1 if k else -1) != t or a is None:
            if a is not None:
                out.append((a, i, TYPES[t]))
                a = None
        if k and a is None:
            a, t = i, (k - 1) // 2
    if a is not None:
        out.append((a, len(y), TYPES[t]))
    return out


def forbidden() -> np.ndarray:
    """Transitions that no tag sequence has: into I-x from anything but B-x and I-x."""
    bad = np.zeros((K, K), np.float32)
    for j in range(2, K, 2):
        bad[:, j] = -1e4
        bad[j, j] = bad[j - 1, j] = 0
    return bad


class Tagger:
    """Weights and inference. ``w``: in (2, V, 4H), u (2, H, 4H), out (2, H, K), bias (K,), trans (K, K), first (K,)."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in w.items()}
        self.hidden = self.w["u"].shape[1]

    @classmethod
    def fresh(cls, hidden: int = 48, seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        n = lambda *s, sd: r.normal(0, sd, s).astype(np.float32)
        w = {"in": n(2, VOCAB, 4 * hidden, sd=0.15), "u": n(2, hidden, 4 * hidden, sd=hidden**-0.5), "b": np.zeros((2, 4 * hidden), np.float32), "out": n(2, hidden, K, sd=0.1), "bias": np.zeros(K, np.float32), "trans": np.zeros((K, K), np.float32), "first": np.zeros(K, np.float32)}
        w["b"][:, hidden : 2 * hidden] = 1.0
        return cls(w)

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as f:
            return cls({k: f[k] for k in f.files})

    def emissions(self, ids: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (B, T, K) of padded classes (B, T). ``keep`` collects what training needs."""
        if keep is None:
            return self._fast_emissions(ids, lengths)
        b, t = ids.shape
        h4, h = 4 * self.hidden, self.hidden
        back = lengths[:, None] - 1 - np.arange(t)[None, :]
        back = np.where(back >= 0, back, np.arange(t)[None, :])
        both = np.stack([ids, np.take_along_axis(ids, back, 1)])  # 2, B, T
        table, u = self.w["in"] + self.w["b"][:, None, :], self.w["u"]
        hs = np.zeros((t + 1, 2, b, h), np.float32)
        c = np.zeros((2, b, h), np.float32)
        cs = np.zeros((t + 1, 2, b, h), np.float32)
        gates = np.zeros((t, 2, b, h4), np.float32)
        half = np.full(h4, 0.5, np.float32)
        half[3 * h :] = 1.0  # order: i f o g; a sigmoid is a tanh at half the scale
        for s in range(t):
            z = np.matmul(hs[s], u)
            z[0] += table[0][both[0, :, s]]
            z[1] += table[1][both[1, :, s]]
            z *= half
            np.tanh(z, out=z)
            z[..., : 3 * h] *= 0.5
            z[..., : 3 * h] += 0.5
            c = z[..., h : 2 * h] * c + z[..., :h] * z[..., 3 * h :]
            hs[s + 1] = z[..., 2 * h : 3 * h] * np.tanh(c)
            gates[s], cs[s + 1] = z, c
        states = hs[1:].transpose(1, 2, 0, 3)  # 2, B, T, H
        right = np.take_along_axis(states[1], back[:, :, None], 1)
        keep |= {"both": both, "back": back, "hs": hs, "cs": cs, "gates": gates, "left": states[0], "right": right}
        return states[0] @ self.w["out"][0] + right @ self.w["out"][1] + self.w["bias"]

    def _fast_emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same scores with few passes over memory: constant factors of the gates are folded into the weights.

        A sigmoid is (1 + tanh(x / 2)) / 2; the states kept here are twice the
        hidden states, so the recurrent and output weights are halved. Each gate
        of both directions lies in one piece.
        """
        b, t = ids.shape
        h = self.hidden
        half = np.full(4 * h, 0.5, np.float32)
        half[3 * h :] = 1.0
        by_gate = lambda w: np.ascontiguousarray(w.reshape(2, -1, 4, h).transpose(2, 0, 1, 3))  # noqa: E731  4, 2, rows, H
        table = by_gate((self.w["in"] + self.w["b"][:, None, :]) * half).reshape(4, -1, h)
        u = by_gate(self.w["u"] * half * np.float32(0.5))
        place = np.arange(t)[None, :]
        back = np.where(lengths[:, None] > place, lengths[:, None] - 1 - place, place)
        order = np.ascontiguousarray(np.concatenate([ids, np.take_along_axis(ids, back, 1) + VOCAB]).T)  # T, 2 B
        hs = np.zeros((t + 1, 2, b, h), np.float32)
        z, x = np.empty((4, 2, b, h), np.float32), np.empty((2 * b, h), np.float32)
        flat = z.reshape(4, 2 * b, h)
        c, g = np.zeros((2, b, h), np.float32), np.empty((2, b, h), np.float32)
        for s in range(t):
            np.matmul(hs[s], u, out=z)
            for k in range(4):
                np.take(table[k], order[s], axis=0, out=x, mode="clip")
                flat[k] += x
            np.tanh(z, out=z)
            z[:3] += 1.0
            np.multiply(z[0], z[3], out=g)
            c *= z[1]
            c += g
            c *= 0.5
            np.tanh(c, out=g)
            np.multiply(z[2], g, out=hs[s + 1])
        out = self.w["out"] * np.float32(0.5)
        scores = hs[1:, 0] @ out[0]
        scores += np.take((hs[1:, 1] @ out[1]).reshape(t * b, -1), back.T * b + np.arange(b), axis=0)
        scores += self.w["bias"]
        return scores.transpose(1, 0, 2)

    def _follow(self) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """Scores of the first tag, and a step from the best scores (K, n) that end in each tag to those one place on, without its own score."""
        trans, first = self.w["trans"], self.w["first"].copy()
        first[2::2] = -1e4
        outer = np.array([0, *range(1, K, 2)])  # O and B-x follow any tag; I-x follows B-x and I-x only
        into = np.ascontiguousarray(trans[:, outer])[:, :, None]
        from_b, from_i = trans[np.arange(1, K, 2), np.arange(2, K, 2)][:, None], trans[np.arange(2, K, 2), np.arange(2, K, 2)][:, None]

        def step(old: np.ndarray) -> np.ndarray:
            nxt = np.empty_like(old)
            nxt[outer] = (old[:, None, :] + into).max(0)
            nxt[2::2] = np.maximum(old[1::2] + from_b, old[2::2] + from_i)
            return nxt

        return first, step

    def has_mention(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the best sequence of each row of (B, T, K) leaves O: its score against that of all O, without pointers."""
        b, t, _ = scores.shape
        first, step = self._follow()
        order = np.argsort(-lengths, kind="stable")
        e = np.ascontiguousarray(scores[order].transpose(1, 2, 0))  # T, K, B
        live = np.searchsorted(-lengths[order], -np.arange(t), side="left")  # rows longer than s come first
        now = e[0] + first[:, None]
        plain = now[0].copy()
        for s in range(1, t):
            n = int(live[s])
            if not n:
                break
            now[:, :n] = step(now[:, :n]) + e[s, :, :n]
            plain[:n] += self.w["trans"][0, 0] + e[s, 0, :n]
        out = np.zeros(b, bool)
        out[order] = now.max(0) > plain + 1e-3
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tag sequence of each row of (B, T, K). The way back is found from the kept scores, so no pointers are made."""
        b, t, _ = scores.shape
        if not t:
            return [np.zeros(0, np.int64) for _ in range(b)]
        first, step = self._follow()
        kept = np.ascontiguousarray(scores.transpose(1, 2, 0))  # T, K, B
        kept[0] += first[:, None]
        for s in range(1, t):
            kept[s] += step(kept[s - 1])
        kept, into = kept.transpose(0, 2, 1), np.ascontiguousarray((self.w["trans"] + forbidden()).T)
        tag = kept[np.maximum(lengths - 1, 0), np.arange(b)].argmax(1)
        y = np.zeros((b, t), np.int64)
        for s in range(t - 1, 0, -1):
            y[:, s] = tag
            tag = np.where(s < lengths, (kept[s - 1] + into[tag]).argmax(1), tag)
        y[:, 0] = tag
        return [y[i, :n] for i, n in enumerate(lengths.tolist())]


WINDOW, OVERLAP = 192, 64


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a text of ``n`` characters whole."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    step = WINDOW - OVERLAP
    starts = list(range(0, n - OVERLAP, step))
    return [(a, min(a + WINDOW, n)) for a in starts]


def tag_texts(tagger: Tagger, texts: list[str], batch_chars: int = 48_000) -> list[list[tuple[int, int, str]]]:
    """Spans of each text.

    Windows of all texts are scored in batches of similar length. Where windows
    of a text overlap, their scores are mixed with weights that fall towards a
    window's inner edges; one decoding over the whole text then reconciles them.
    """
    coded = encode_all(texts)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]

    def batches(jobs: list, length):
        jobs = sorted(jobs, key=length)
        at = 0
        while at < len(jobs):
            n = 1
            while at + n < len(jobs) and length(jobs[at + n]) * (n + 1) <= batch_chars:
                n += 1
            yield jobs[at : at + n]
            at += n

    mentions: list[tuple[int, np.ndarray]] = []

    def decode(rows: list[int], scores: np.ndarray, lengths: np.ndarray) -> None:
        for r in np.flatnonzero(tagger.has_mention(scores, lengths)).tolist():
            mentions.append((rows[r], scores[r, : lengths[r]].copy()))

    def score(part: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([z - a for _, a, z in part])
        ids = np.zeros((len(part), int(lengths.max())), np.int64)
        for r, (i, a, z) in enumerate(part):
            ids[r, : z - a] = coded[i][a:z]
        return tagger.emissions(ids, lengths), lengths

    wins = [(i, a, z) for i, c in enumerate(coded) for a, z in windows_of(len(c))]
    size = lambda w: w[2] - w[1]
    for part in batches([w for w in wins if size(w) == len(coded[w[0]])], size):
        decode([i for i, _, _ in part], *score(part))

    several = [w for w in wins if size(w) < len(coded[w[0]])]
    total = {i: np.zeros((len(coded[i]), K), np.float32) for i, _, _ in several}
    weight = {i: np.zeros(len(coded[i]), np.float32) for i in total}
    for part in batches(several, size):
        e, _ = score(part)
        for r, (i, a, z) in enumerate(part):
            x = np.arange(z - a)
            left = np.minimum(1.0, (x + 1) / OVERLAP) if a else np.ones(z - a)
            right = np.minimum(1.0, (z - a - x) / OVERLAP) if z < len(coded[i]) else np.ones(z - a)
            w = (left * right).astype(np.float32)
            total[i][a:z] += e[r, : z - a] * w[:, None]
            weight[i][a:z] += w
    for rows in batches(list(total), lambda i: len(coded[i])):
        lengths = np.array([len(coded[i]) for i in rows])
        scores = np.zeros((len(rows), int(lengths.max()), K), np.float32)
        for r, i in enumerate(rows):
            scores[r, : lengths[r]] = total[i] / np.maximum(weight[i], 1e-6)[:, None]
        decode(rows, scores, lengths)
    for part in batches(mentions, lambda m: len(m[1])):  # few texts have mentions, so those of all batches are decoded together
        lengths = np.array([len(e) for _, e in part])
        scores = np.zeros((len(part), int(lengths.max()), K), np.float32)
        for r, (_, e) in enumerate(part):
            scores[r, : len(e)] = e
        for (i, _), y in zip(part, tagger.viterbi(scores, lengths)):
            out[i] = spans_of(y)
    return out
