"""Train the tagger: ``python -m reviewloom.llm.pii.train OUT.npz [NAMES.parquet] [MINUTES]``.

Training text is generated (``corpus.Maker``), STEPS x BATCH texts at most, so
the sample is bounded whatever the size of the tables.
"""

from __future__ import annotations

import multiprocessing
import sys
import time

import numpy as np

from reviewloom.llm.pii.corpus import Maker
from reviewloom.llm.pii.model import K, WINDOW, Tagger, encode, forbidden, spans_of, tags_of, tag_texts

STEPS, BATCH, RATE = 6000, 192, 6e-3


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(e: np.ndarray, y: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Negative log-likelihood summed over the batch; gradients for e, trans, first."""
    b, t, _ = e.shape
    full = trans + forbidden()
    live = np.arange(t)[None, :] < lengths[:, None]
    alpha = np.zeros((t, b, K), np.float32)
    alpha[0] = e[:, 0] + first
    for s in range(1, t):
        nxt = _lse(alpha[s - 1][:, :, None] + full[None], 1) + e[:, s]
        alpha[s] = np.where(live[:, s, None], nxt, alpha[s - 1])
    logz = _lse(alpha[t - 1], 1)
    beta = np.zeros((t, b, K), np.float32)
    g_trans = np.zeros((K, K), np.float32)
    for s in range(t - 1, 0, -1):
        into = e[:, s] + beta[s]
        prev = _lse(full[None] + into[:, None, :], 2)
        m = live[:, s]
        if m.any():
            pair = np.exp(alpha[s - 1][m][:, :, None] + full[None] + into[m][:, None, :] - logz[m][:, None, None])
            g_trans += pair.sum(0)
        beta[s - 1] = np.where(m[:, None], prev, beta[s])
    marg = np.exp(alpha + beta - logz[None, :, None]).transpose(1, 0, 2) * live[:, :, None]
    rows = np.arange(b)
    gold = first[y[:, 0]] + e[rows, 0, y[:, 0]]
    g_first = marg[:, 0].sum(0)
    np.subtract.at(g_first, y[:, 0], 1)
    for s in range(1, t):
        m = live[:, s]
        gold = gold + np.where(m, full[y[:, s - 1], y[:, s]] + e[rows, s, y[:, s]], 0)
        np.subtract.at(g_trans, (y[m, s - 1], y[m, s]), 1)
    g_e = marg
    hot = np.zeros_like(marg)
    np.put_along_axis(hot, y[:, :, None], 1, 2)
    g_e -= hot * live[:, :, None]
    return float((logz - gold).sum()), g_e, g_trans, g_first


def gradients(m: Tagger, ids: np.ndarray, lengths: np.ndarray, y: np.ndarray):
    keep: dict = {}
    e = m.emissions(ids, lengths, keep)
    loss, g_e, g_trans, g_first = crf_loss(e, y, lengths, m.w["trans"], m.w["first"])
    b, t = ids.shape
    h = m.hidden
    g = {"trans": g_trans, "first": g_first, "bias": g_e.sum((0, 1)), "out": np.stack([np.einsum("bth,btk->hk", keep["left"], g_e), np.einsum("bth,btk->hk", keep["right"], g_e)])}
    d_left = g_e @ m.w["out"][0].T
    d_right = np.zeros_like(d_left)
    np.put_along_axis(d_right, keep["back"][:, :, None], g_e @ m.w["out"][1].T, 1)
    d_right *= (np.arange(t)[None, :] < lengths[:, None])[:, :, None]
    d_out = np.stack([d_left, d_right]).transpose(2, 0, 1, 3)  # T, 2, B, H
    dz_all = np.zeros((t, 2, b, 4 * h), np.float32)
    dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    u_t = m.w["u"].transpose(0, 2, 1)
    for s in range(t - 1, -1, -1):
        z, c, c_prev = keep["gates"][s], keep["cs"][s + 1], keep["cs"][s]
        i, f, o, q = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
        tc = np.tanh(c)
        dh = dh + d_out[s]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[s]
        dz[..., :h] = dc * q * i * (1 - i)
        dz[..., h : 2 * h] = dc * c_prev * f * (1 - f)
        dz[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        dz[..., 3 * h :] = dc * i * (1 - q * q)
        dc = dc * f
        dh = np.matmul(dz, u_t)
    flat_h = keep["hs"][:-1].transpose(1, 0, 2, 3).reshape(2, t * b, h)
    flat_z = dz_all.transpose(1, 0, 2, 3).reshape(2, t * b, 4 * h)
    g["u"] = np.matmul(flat_h.transpose(0, 2, 1), flat_z)
    g["b"] = flat_z.sum(1)
    g_in = np.zeros_like(m.w["in"])
    codes = keep["both"].transpose(0, 2, 1).reshape(2, t * b)
    for d in range(2):
        one = np.zeros((m.w["in"].shape[1], t * b), np.float32)
        one[codes[d], np.arange(t * b)] = 1
        g_in[d] = one @ flat_z[d]
    g["in"] = g_in
    return loss, g


def batch_of(maker: Maker, n: int, rng: np.random.Generator):
    rows = []
    while len(rows) < n:
        text, spans = maker.text()
        x, y = encode(text).astype(np.int64), tags_of(len(text), spans)
        if len(x) > WINDOW:
            a = int(rng.integers(0, len(x) - WINDOW + 1))
            x, y = x[a : a + WINDOW], y[a : a + WINDOW]
            if y[0] and y[0] % 2 == 0:  # a span cut by the window begins there
                y[0] -= 1
        if len(x):
            rows.append((x, y))
    lengths = np.array([len(x) for x, _ in rows])
    ids, tags = np.zeros((n, lengths.max()), np.int64), np.zeros((n, lengths.max()), np.int64)
    for i, (x, y) in enumerate(rows):
        ids[i, : len(x)], tags[i, : len(x)] = x, y
    return ids, lengths, tags


def held_out(m: Tagger, maker: Maker, n: int = 1500) -> dict[str, tuple[float, float]]:
    """(precision, recall) of exact spans per type on fresh texts."""
    made = [maker.text() for _ in range(n)]
    found = tag_texts(m, [t for t, _ in made])
    hit: dict[str, list[int]] = {}
    for (_, gold), got in zip(made, found):
        for s in set(gold) | set(got):
            c = hit.setdefault(s[2], [0, 0, 0])
            c[0] += s in gold and s in got
            c[1] += s in got
            c[2] += s in gold
    return {k: (round(a / max(1, b), 4), round(a / max(1, c), 4)) for k, (a, b, c) in sorted(hit.items())}


def _worker(pipe, seed: int, given: list[str], family: list[str], n: int) -> None:
    """Gradients of one share of each batch, on own text."""
    maker, rng = Maker(seed, given, family), np.random.default_rng(seed)
    while (w := pipe.recv()) is not None:
        pipe.send(gradients(Tagger(w), *batch_of(maker, n, rng)))


def train(given: list[str], family: list[str], minutes: float = 6, hidden: int = 36, seed: int = 1, workers: int = 8, log=print) -> Tagger:
    m = Tagger.fresh(hidden, seed)
    context = multiprocessing.get_context("fork")
    pipes, crew = [], []
    for k in range(workers):
        mine, theirs = context.Pipe()
        crew.append(context.Process(target=_worker, args=(theirs, 1000 * seed + k, given, family, BATCH // workers), daemon=True))
        crew[-1].start()
        pipes.append(mine)
    mom = {k: np.zeros_like(v) for k, v in m.w.items()}
    var = {k: np.zeros_like(v) for k, v in m.w.items()}
    began, smooth = time.time(), None
    for step in range(1, STEPS + 1):
        done = max(step / STEPS, (time.time() - began) / (60 * minutes))
        if done >= 1:
            break
        for p in pipes:
            p.send(m.w)
        shares = [p.recv() for p in pipes]
        loss, g = sum(x for x, _ in shares), {k: sum(x[k] for _, x in shares) for k in m.w}
        norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values()))) / BATCH
        clip = min(1.0, 5.0 / max(norm, 1e-9)) / BATCH
        rate = RATE * min(1.0, step / 50) * (0.5 + 0.5 * np.cos(np.pi * done)) + 1e-5
        for k, v in m.w.items():
            x = g[k] * clip
            mom[k] = 0.9 * mom[k] + 0.1 * x
            var[k] = 0.999 * var[k] + 0.001 * x * x
            v -= (rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        smooth = loss / BATCH if smooth is None else 0.98 * smooth + 0.02 * loss / BATCH
        if step % 200 == 0:
            log(f"step {step}, {time.time() - began:.0f} s, loss {smooth:.3f}")
    for p in pipes:
        p.send(None)
    return m


if __name__ == "__main__":
    import pandas as pd

    names = pd.read_parquet(sys.argv[2]) if len(sys.argv) > 2 else pd.DataFrame({"name": [], "kind": []})
    model = train(names[names.kind == "given"].name.tolist(), names[names.kind == "family"].name.tolist(), float(sys.argv[3]) if len(sys.argv) > 3 else 6)
    model.save(sys.argv[1])
    print(held_out(Tagger.load(sys.argv[1]), Maker(99)))
    assert spans_of(tags_of(5, [(1, 3, "name")])) == [(1, 3, "name")]
