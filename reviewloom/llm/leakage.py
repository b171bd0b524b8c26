"""Evaluation texts leaking into training text.

1. *Normalise.* A text becomes a string of folded letters: case, accents,
   punctuation, spaces, line breaks and hyphens go, and letters that scans take
   for one another share a symbol, so a window of folded characters survives
   lost spaces, broken words and most misread letters. Lines are first put in
   reading order by their boxes.
2. *Scan.* All n-grams of the test items are a sorted table of packed integers,
   broadcast to the executors behind a check of its size. Every window of every
   document is looked up in it; hits are counted per block of the document and
   item, each place of the item once.
   A few hits are enough; then all characters of the item count: some
   ``MIN_WORDS`` words in a row must be covered by short windows of the block,
   with at most one long word missing; then once more by such windows only as
   others on the same diagonal support.
3. *Verify.* For each block and item left, a local alignment, run for many of
   them at once, places the item's characters in the document. It may jump forward, over an advert or the
   line of another column, at a fixed cost. A word of the item is found if its
   edits are few (a single word with more of them doesn't end a run); an item
   leaks if at least ``min_words`` consecutive words are
   found.
4. *Remove.* Documents can be dropped, or the verified spans cut out.

Defined cases: null or empty texts and items never match; repeated documents
are reported each; an item of fewer than ``min_words`` words can't leak; ties
between items are all reported; documents without boxes are read as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.folding import GramTable, fold, fold_all, grams
from reviewloom.session import spread

GRAM = 8  # folded characters of a window
BLOCK, STEP = 768, 384  # folded characters of a block and between their starts
SPAN = 72  # folded characters of about twelve words
RARE = 8  # windows that more places of the test set share are stock phrases and vote only where there are too few others
ENOUGH = 12  # windows in the table that any MIN_WORDS words of an item have, or all of theirs
MIN_HITS = 4  # distinct places of the item hit within one SPAN of it: twelve words have about forty, a misread may cost eight
SHORT = 6  # folded characters of the windows that cover an item's words
BAND = 8  # diagonals taken together, with the next ones
NEAR = 72  # folded characters of the document aligned beyond the first and the last supported window
SUPPORT = 4  # short windows on one or next to one diagonal: nine letters without an edit, or more with one
LONG = 5  # folded characters of a word that may count as missing
COVERED = 0.4  # share of a word's characters below which it is missing
SHARE = 0.8  # share of the characters of MIN_WORDS words that must be covered
BLOCKS = 64  # blocks whose windows are held at once
PLACES = 64  # candidates whose windows are held at once
SEATS = 4_000_000  # and what these take, of eight bytes, but for a single one
TOGETHER = 128  # alignments run at once
CELLS = 24_000_000  # and their cells, of two bytes, but for a single one
STRIDE = 16  # places of an alignment followed back at once
BATCH_CHARS = 1_000_000  # characters folded at once
MIN_WORDS = 12
COLUMN_GAP = 60  # pixels between the left edges of lines of different columns
MARGIN = 24  # folded characters aligned on both sides of the covered part of the item and of the block
PIECE = 3  # words of the item that a piece at the end of a passage must hold if any of them has an edit
MATCH, MISMATCH, GAP, JUMP = 2, -3, -3, -36
FAR = 320  # folded characters that one jump may pass: an advert, or a line of each other column
SLICE_CHARS = 2_000_000  # characters of the items of one table: about 200 MB broadcast

def reading_order(text: str, x, y) -> str:
    """The lines column by column, if the boxes' corners show more than one column; else the text."""
    order = line_order(text, x, y)
    if order is None:
        return text
    lines = text.split("\n")
    return "\n".join(lines[i] for i in order)


def line_order(text: str, x, y) -> np.ndarray | None:
    """The numbers of the lines column by column; None if the boxes' corners don't show more than one column."""
    if x is None or y is None or len(x) < 2 or len(x) != text.count("\n") + 1 or max(x) - min(x) <= COLUMN_GAP:
        return None
    x, y = np.asarray(x, float), np.asarray(y, float)
    if np.isnan(x).any() or np.isnan(y).any():
        return None
    order = np.argsort(x, kind="stable")
    gaps = np.diff(x[order]) > COLUMN_GAP
    if not gaps.any():
        return None
    column = np.empty(len(x), int)
    column[order] = np.concatenate([[0], np.cumsum(gaps)])
    return np.lexsort((np.arange(len(x)), y, column))


class Items:
    """The test items, folded, and the table of their n-grams. Items of equal text are one, with all their ids."""

    def __init__(self, ids: list[int], texts: list[str]):
        by_text: dict[str, list[int]] = {}
        for i, t in zip(ids, texts):
            if isinstance(t, str):
                by_text.setdefault(t, []).append(i)
        self.ids, self.symbols, self.words = [], [], []
        for t, own in by_text.items():
            symbols, at = fold(t)
            if not len(symbols):
                continue
            # white space separates words; one without letters or digits is none
            token = np.cumsum(np.array([c.isspace() for c in t]))[at]
            _, words = np.unique(token, return_inverse=True)
            self.ids.append(own)
            self.symbols.append(symbols)
            self.words.append(words)
        always, self.reach = [], []
        every = [grams(s, GRAM) for s in self.symbols]
        _, inverse, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True) if every else (0, np.zeros(0, int), np.zeros(0, int))
        rare, at = count[inverse] <= RARE, 0
        for s, words, g in zip(self.symbols, self.words, every):
            n = int(words[-1]) + 1
            bound = np.searchsorted(words, np.arange(n + 1))
            first, last = bound[: max(0, n - MIN_WORDS + 1)], bound[MIN_WORDS:]
            self.reach.append(int((last - first).max(initial=0)))
            few = np.concatenate([[0], np.cumsum(rare[at : at + len(g)])])
            last = np.minimum(last - GRAM + 1, len(g))
            mark = np.zeros(len(g) + 1, int)
            for a, z in zip(first.tolist(), last.tolist()):
                if z > a and few[z] - few[a] < ENOUGH:
                    mark[a] += 1
                    mark[z] -= 1
            always.append(np.cumsum(mark)[:-1] > 0)
            at += len(g)
        self.table = GramTable(self.symbols, GRAM, RARE, always)
        self.heads = [np.searchsorted(w, np.arange(int(w[-1]) + 1)) for w in self.words]  # first symbol of each word
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in self.symbols])]).astype(np.int64)
        self.reach = np.array(self.reach, np.int64)
        self.short = GramTable(self.symbols, SHORT)
        self.slots = np.concatenate([self.short.index(s) for s in self.symbols]).astype(np.int64) if self.symbols else np.zeros(0, np.int64)
        self.slots[self.slots < 0] = len(self.short.codes)  # the places at an item's end
        first_word = np.cumsum([0, *(len(h) for h in self.heads)])
        self.word_at = np.concatenate([w + b for w, b in zip(self.words, first_word)]) if self.words else np.zeros(0, int)  # words numbered through all items
        self.word_start = np.concatenate([*(h + o for h, o in zip(self.heads, self.offset)), self.offset[-1:]])
        # symbols that any MIN_WORDS words of the item have at least, the first and the last of which may be cut
        self.least = np.array([(h[MIN_WORDS - 1 :] - h[1 : len(h) - MIN_WORDS + 2]).min() if len(h) >= MIN_WORDS else 0 for h in self.heads], np.int64)


def candidates(at: np.ndarray, item: np.ndarray, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, block, item, first place, last place) where one SPAN of an item has MIN_HITS distinct hits."""
    z = np.zeros(0, np.int64)
    if not len(at):
        return z, z, z, z, z
    text = np.searchsorted(starts, at, side="right") - 1
    block = (at - starts[text]) // STEP
    first_block = np.concatenate([[0], np.cumsum(np.diff(starts) // STEP + 1)])
    shifts = range(BLOCK // STEP)
    key = np.concatenate([((first_block[text] + block - k) << 42) | (item << 20) | place for k in shifts])
    key = np.sort(key[np.concatenate([block >= k for k in shifts])])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    dense = np.flatnonzero(key[MIN_HITS - 1 :] - key[: max(0, len(key) - MIN_HITS + 1)] < SPAN)
    if not len(dense):
        return z, z, z, z, z
    pair = key[dense] >> 20
    lead = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    last = dense[np.append(lead[1:], len(pair)) - 1] + MIN_HITS - 1
    pair = pair[lead]
    b = pair >> 22
    t = np.searchsorted(first_block, b, side="right") - 1
    return t, b - first_block[t], pair & ((1 << 22) - 1), key[dense[lead]] & ((1 << 20) - 1), key[last] & ((1 << 20) - 1)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 and so on, n of them, for each."""
    head = np.cumsum(n) - n
    out = np.repeat(first - head, n)
    out += np.arange(len(out))
    return out


def in_words(items: Items, a: np.ndarray, z: np.ndarray, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part a to z of the items' symbols the first and last symbol in MIN_WORDS words in a row that are covered; last is -1 if there are none.

    ``sums`` are running sums of covered symbols, those of a part from ``at`` on.
    """
    lo, hi = np.full(len(a), np.iinfo(np.int64).max), np.full(len(a), -1, np.int64)
    if not len(a):
        return lo, hi
    first = items.word_at[a]
    n = items.word_at[z - 1] + 1 - first
    word, part = _ranges(first, n), np.repeat(np.arange(len(a)), n)
    begin, end = np.maximum(items.word_start[word], a[part]), np.minimum(items.word_start[word + 1], z[part])
    shift = (at - a)[part]
    hit, length = sums[end + shift] - sums[begin + shift], end - begin
    lost, total, size = (np.concatenate([[0], np.cumsum(x)]) for x in ((length >= LONG) & (hit < COVERED * length), hit, length))
    i = np.arange(max(0, len(word) - MIN_WORDS + 1))
    j = i + MIN_WORDS
    ok = (part[i] == part[j - 1]) & (lost[j] - lost[i] <= 1) & (total[j] - total[i] >= SHARE * (size[j] - size[i]))
    i, j = i[ok], j[ok]
    np.minimum.at(lo, part[i], begin[i])
    np.maximum.at(hi, part[i], end[j - 1] - 1)
    return lo, hi


def _covered_sums(windows: np.ndarray) -> np.ndarray:
    """Running sums of the symbols that the windows cover."""
    cover = windows.copy()
    for e in range(1, SHORT):
        cover[e:] |= windows[:-e]
    sums = np.zeros(len(cover) + 1, np.int32)
    np.cumsum(cover, out=sums[1:])
    return sums


def covered(items: Items, slots: np.ndarray, starts: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Per candidate the first and last place of the item in MIN_WORDS words in a row that short windows of the block cover; last is -1 if there are none."""
    t, block, k, lo, hi = found
    begin, finish = np.full(len(t), np.iinfo(np.int64).max), np.full(len(t), -1, np.int64)
    if not len(t):
        return begin, finish
    a = items.offset[k] + np.maximum(0, lo - items.reach[k])
    z = np.minimum(items.offset[k + 1], items.offset[k] + hi + GRAM + items.reach[k])
    most = len(items.short.codes)
    own, row = np.unique((t << 32) | block, return_inverse=True)
    order = np.argsort(row, kind="stable")
    size = np.cumsum((z - a)[order])
    at = 0
    while at < len(order):  # as many candidates as have about a million characters, and no more than BLOCKS blocks
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + 1_000_000, side="right"))
        end = max(at + 1, min(end, int(np.searchsorted(row[order], row[order[at]] + BLOCKS))))
        pick = order[at:end]
        at = end
        base = int(row[pick[0]])
        have = np.zeros((int(row[pick[-1]]) - base + 1, most + 1), bool)  # the last column takes the windows that no item has
        for i, o in enumerate(own[base : base + len(have)].tolist()):
            d = int(starts[o >> 32]) + (o & 0xFFFFFFFF) * STEP
            have[i, slots[d : min(int(starts[(o >> 32) + 1]), d + BLOCK)]] = True
        have[:, most] = False
        n = z[pick] - a[pick]
        head = np.cumsum(n) - n
        slot = items.slots[_ranges(a[pick], n)]
        slot += np.repeat((row[pick] - base) * (most + 1), n)
        present = have.ravel()[slot]
        for e in range(1, SHORT):
            present[head + n - e] = False  # such a window goes on beyond the part looked at
        sums = _covered_sums(present)
        some = np.flatnonzero(sums[head + n] - sums[head] >= SHARE * items.least[k[pick]])
        pick = pick[some]
        begin[pick], finish[pick] = in_words(items, a[pick], z[pick], sums, head[some])
    some = finish >= 0
    begin[some] -= items.offset[k[some]]
    finish[some] -= items.offset[k[some]]
    return begin, finish


def supported(items: Items, slots: np.ndarray, places: list[list[int]]) -> list[list[int]]:
    """The candidates of which MIN_WORDS words of the item in a row are covered by short windows that others support.

    Equal windows of the item and the document stand on a diagonal (document
    place less item place). A passage, or each piece of one that is broken by
    adverts or columns, has its windows on one diagonal, or next to it where
    letters were lost or added; a window that equals one of the item by chance
    stands alone. Windows with fewer than SUPPORT on their diagonals don't count.
    """
    out: list[list[int]] = []
    most = len(items.short.codes)
    together = max(1, min(PLACES, SEATS // max(1, most)))
    last, first = np.full(together * most, -1, np.int32), np.full(together * most, -1, np.int32)
    in_doc = np.flatnonzero(slots >= 0)
    known, before = slots[in_doc], np.concatenate([[0], np.cumsum(slots >= 0)])
    for at in range(0, len(places), together):
        t, k, lo, hi, d0, d1 = np.array(places[at : at + together], np.int64).T
        a, z = items.offset[k] + np.maximum(0, lo - MARGIN), np.minimum(items.offset[k + 1], items.offset[k] + hi + 1 + MARGIN)
        n = np.maximum(0, np.minimum(z, items.offset[k + 1] - SHORT + 1) - a)  # all these windows of the items are in the table
        here, key = _ranges(np.zeros(len(k), np.int64), n), items.slots[_ranges(a, n)]
        key += np.repeat(np.arange(len(k)) * most, n)
        last[key] = here
        first[key[::-1]] = here[::-1]
        n = before[d1] - before[d0]
        index, row = _ranges(before[d0], n), np.repeat(np.arange(len(k)), n)
        doc = known[index] + row * most
        p = last[doc]
        some = np.flatnonzero(p >= 0)
        p, row = p[some].astype(np.int64), row[some]
        j, q = in_doc[index[some]] - d0[row], first[doc[some]]
        again = np.flatnonzero(q != p)  # twice in this part of the item
        p, j, row = np.concatenate([p, q[again]]), np.concatenate([j, j[again]]), np.concatenate([row, row[again]])
        last[key] = -1
        first[key] = -1
        bands = (d1 - d0 + z - a) // BAND + 2  # the last of each place has none
        band = (j - p + (z - a)[row]) // BAND + (np.cumsum(bands) - bands)[row]
        n = np.bincount(band, minlength=int(bands.sum()))
        n[1:] += n[:-1].copy()
        kept = np.maximum(n[band], n[band + 1]) >= SUPPORT
        p, j, row = p[kept], j[kept], row[kept]
        size = z - a + SHORT  # no window covers the next place's
        head = np.cumsum(size) - size
        windows = np.zeros(int(size.sum()), bool)
        windows[head[row] + p] = True
        low, high = in_words(items, a, z, _covered_sums(windows), head)
        nearest, farthest = d1 - d0, np.zeros(len(k), np.int64)
        np.minimum.at(nearest, row, j)
        np.maximum.at(farthest, row, j)
        ok = np.flatnonzero((high >= 0) & (np.bincount(row, minlength=len(k)) >= SUPPORT))
        rows = np.stack([t, k, low - items.offset[k], high - items.offset[k], np.maximum(d0, d0 + nearest - NEAR), np.minimum(d1, d0 + farthest + SHORT + NEAR)], 1)
        out += rows[ok].tolist()
    return out


def _running(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Largest of each row's last ``width`` values, in doublings, in one of the two arrays; ``a`` has the values.

    The rows lie one after the other and are taken as one; what came from the row before is put right.
    """
    w = 1
    while w < width:
        by = min(w, width - w)
        x = a.ravel()
        np.maximum(x[by:], x[:-by], out=b.ravel()[by:])
        b[:, :by] = a[:, :by]
        a, b = b, a
        w += by
    return a


_kept: list[np.ndarray] = []


def _scores(size: int, kind: type) -> np.ndarray:
    """An array that isn't filled, of the memory kept for it: to take new pages each time costs more than to compute what they hold."""
    if size * np.dtype(kind).itemsize > 2 * CELLS:
        return np.empty(size, kind)
    if not _kept:
        _kept.append(np.empty(2 * CELLS, np.uint8))
    return _kept[0][: size * np.dtype(kind).itemsize].view(kind)


def align(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Best local alignment with jumps: pairs (item place, document place) of equal symbols, a row each."""
    return align_all([(item, doc)])[0]


def align_all(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``align`` for many (item, document), padded and computed together.

    A gap of more than JUMP / GAP characters in the document costs as much as a
    jump, so gaps are followed no further than that.
    """
    c = len(parts)
    rank = sorted(range(c), key=lambda k: -len(parts[k][0]))
    sizes = [len(parts[k][0]) for k in rank]
    n, m = sizes[0], max(len(d) for _, d in parts)
    kind = np.int16 if 2 * n - GAP * m < 30_000 else np.int32
    item, doc = np.zeros((n, c), np.uint8), np.full((c, m), 255, np.uint8)
    for r, k in enumerate(rank):
        item[: sizes[r], r], doc[r, : len(parts[k][1])] = parts[k][0], parts[k][1]
    best, where_i, where_j = np.zeros(c, kind), np.zeros(c, int), np.zeros(c, int)
    # scores are kept with what gaps from the document's first place on would cost: one that is followed from place to place keeps its value
    slopes = np.tile((np.arange(m + 1) * -GAP).astype(kind), (c, 1))
    landing = slopes + kind(JUMP - GAP)
    live = np.searchsorted(-np.array(sizes), -np.arange(n + 1), side="right")  # items of that many symbols or more come first
    base = np.cumsum(live) - live  # only those have rows
    score = _scores(int(live.sum()) * (m + 1), kind)
    rows = score.reshape(-1, m + 1)
    rows[:c] = slopes
    value = np.full((int(item.max()) + 1, c, m + 1), MISMATCH - GAP, kind)  # by symbol of the item; 0 is the padding and equals nothing
    for v in range(1, len(value)):
        value[v, :, 1:][doc == v] = MATCH - GAP
    value[:, :, 0] = -MATCH * (n + 1) + GAP * (m + 1)  # nothing comes from the end of the row before
    value, known = value.reshape(-1, m + 1), item.astype(np.int64) * c + np.arange(c)
    gap, span = kind(GAP), min(-(JUMP // -GAP) + 2, m + 1)
    space = [np.empty((c, m + 1), kind) for _ in range(3)]
    for i in range(1, n + 1):
        k = int(live[i])
        prev, row, slope = rows[base[i - 1] : base[i - 1] + k], rows[base[i] : base[i] + k], slopes[:k]
        one, two, found = (x[:k] for x in space)
        np.take(value, known[i - 1, :k], axis=0, out=found, mode="clip")
        np.add(prev, gap, out=one)
        flat = found.ravel()
        flat[1:] += prev.ravel()[:-1]
        np.maximum(one, found, out=one)
        np.maximum(one, slope, out=one)
        level = _running(one, two, span)
        np.subtract(level, slope, out=found)
        j = found.argmax(axis=1)  # where a jump lands the score is lower
        top = found[np.arange(k), j]
        unable = np.flatnonzero(best[:k] <= -JUMP)
        if len(unable) < k:
            ahead = _running(found, two if level is one else one, min(FAR, m + 1))
            ahead += landing[:k]
            ahead[unable] = 0
            np.maximum(level.ravel()[1:], ahead.ravel()[:-1], out=row.ravel()[1:])
            row[:, 0] = 0
        else:
            row[:] = level
        up = np.flatnonzero(top > best[:k])
        best[up], where_i[up], where_j[up] = top[up], i, j[up]
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(best > 0)
    i, j = where_i.copy(), where_j.copy()
    ahead = np.arange(STRIDE + 1)
    while len(live):
        # as many steps along the diagonal as there are, up to STRIDE
        a, b = i[live][:, None] - ahead, j[live][:, None] - ahead
        x, y, t = np.maximum(a, 0), np.maximum(b, 0), live[:, None]
        s = score[(base[x] + t) * (m + 1) + y] + GAP * y
        same = item[x[:, :-1] - 1, t] == doc[t, y[:, :-1] - 1]
        diagonal = (s[:, :-1] == s[:, 1:] + np.where(same, MATCH, MISMATCH)) & (s[:, :-1] > 0) & (a[:, :-1] > 0) & (b[:, :-1] > 0)
        steps = np.where(diagonal.all(axis=1), STRIDE, diagonal.argmin(axis=1))
        r, q = np.nonzero(same & (ahead[:-1] < steps[:, None]))
        pairs.append((live[r], a[r, q] - 1, b[r, q] - 1))
        i[live] -= steps
        j[live] -= steps
        s = s[np.arange(len(live)), steps]
        on = (s > 0) & (i[live] > 0) & (j[live] > 0)
        halt = np.flatnonzero(on & (steps < STRIDE))
        t, s = live[halt], s[halt]
        a, b = i[t], j[t]
        above = s == score[(base[a - 1] + t) * (m + 1) + b] + GAP * b + GAP
        i[t] -= above
        for k in np.flatnonzero(~above).tolist():
            x, y = int(a[k]), int(b[k])
            first = max(0, y - FAR)
            left = rows[base[x] + t[k], first:y] + GAP * np.arange(first, y)
            steps = np.flatnonzero(left + GAP * (y - np.arange(first, y)) == s[k])
            if not len(steps):
                steps = np.flatnonzero(left + JUMP == s[k])
            if not len(steps):
                on[halt[k]] = False
                continue
            j[t[k]] = first + int(steps[-1])
        live = live[on]
    out = [np.zeros((0, 2), np.int64) for _ in parts]
    if pairs:
        of, x, y = (np.concatenate(p)[::-1] for p in zip(*pairs))
        order = np.argsort(of, kind="stable")
        for r, part in enumerate(np.split(np.stack([x, y], 1)[order], np.cumsum(np.bincount(of, minlength=c))[:-1])):
            out[rank[r]] = part
    return out


def _together(places: list[list[int]]) -> Iterator[list[list[int]]]:
    """The places in parts that are aligned at once."""
    part, cells = [], 0
    for p in places:
        size = (p[3] - p[2] + 1 + 2 * MARGIN) * (p[5] - p[4] + 1)
        if part and (len(part) == TOGETHER or cells + size > CELLS):
            yield part
            part, cells = [], 0
        part.append(p)
        cells += size
    if part:
        yield part


GOOD, WEAK, LOST = 2, 1, 0


def graded_words(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Per word of the item: GOOD with few edits, WEAK with more, else LOST."""
    n_words = int(words[-1]) + 1 if len(words) else 0
    size = np.bincount(words, minlength=n_words)
    of = words[pairs[:, 0]]
    hit = np.bincount(of, minlength=n_words)
    missing, between = (np.diff(pairs, axis=0) - 1).T
    # more than that is a jump: the word was broken over columns. A stray letter may stand between words, but no more
    stray = np.flatnonzero((between > missing + (of[1:] != of[:-1])) & (between <= 6))
    extra = np.bincount(of[1:][stray], (between - missing)[stray], n_words).astype(int)
    edits = size - hit + extra
    limit = np.where(size <= 3, 0, np.where(size <= 8, 1, np.where(size <= 13, 2, 3)))
    weak = np.where(size <= 3, 1, np.floor(0.3 * size))
    grade = np.where(edits <= limit, GOOD, np.where(edits <= weak, WEAK, LOST))
    return np.where(hit > 0, grade, LOST)


def graded_together(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``graded_words`` of many (words, pairs), as of one text whose parts lie far apart."""
    if not parts:
        return []
    first, place = (np.cumsum([0, *x]) for x in zip(*((int(w[-1]) + 1, len(w)) for w, _ in parts)))
    words = np.concatenate([w + f for (w, _), f in zip(parts, first)])
    pairs = np.concatenate([p + [a, i << 40] for i, ((_, p), a) in enumerate(zip(parts, place.tolist()))])
    return np.split(graded_words(words, pairs), first[1:-1])


def longest_run(grades: np.ndarray) -> tuple[int, int]:
    """(length, first word) of the longest run that begins and ends with a good word and has no two weak ones together."""
    best, a, last_good = (0, 0), None, -1
    for k, g in enumerate(grades.tolist()):
        if g == GOOD:
            if a is None:
                a = k
            last_good = k
            best = max(best, (k - a + 1, -a))
        elif a is not None and (g == LOST or last_good != k - 1):
            a = None
    return best[0], -best[1]


def trimmed_run(n: int, w0: int, words: np.ndarray, pairs: np.ndarray) -> tuple[int, int]:
    """The run without end pieces beyond a jump of fewer than PIECE words that have an edit: a stock phrase elsewhere is no continuation."""
    of = words[pairs[:, 0]]
    inside = pairs[(of >= w0) & (of < w0 + n)]
    step = np.diff(inside, axis=0)
    cuts = words[inside[1:, 0][step[:, 1] - step[:, 0] > 12]].tolist()
    if not cuts:
        return n, w0
    whole = (np.bincount(words[inside[:, 0]], minlength=w0 + n) == np.bincount(words, minlength=w0 + n)[: w0 + n])[w0:]
    lo, hi = w0, w0 + n
    while cuts and cuts[0] - lo < PIECE and not whole[lo - w0 : cuts[0] - w0].all():
        lo = cuts.pop(0)
    while cuts and hi - cuts[-1] < PIECE and not whole[cuts[-1] - w0 : hi - w0].all():
        hi = cuts.pop()
    return hi - lo, lo


_SEPARATOR = re.compile(r"[ \t]+\|[ \t]+|[ \t]{3,}|\t")


def columns_apart(text: str) -> tuple[str, np.ndarray] | None:
    """The text with columns that were joined into lines set one after the other, and its characters' places; None if there are none."""
    if "|" not in text and "   " not in text and "\t" not in text:
        return None
    parts: list[tuple[int, int]] = []
    run: list[list[tuple[int, int]]] = []
    apart = False

    def close() -> None:
        nonlocal apart
        apart |= len(run) > 1
        rows = run if len(run) > 1 else [[(r[0][0], r[-1][1])] for r in run]
        for c in range(max(map(len, rows), default=0)):
            parts.extend(r[c] for r in rows if c < len(r))
        run.clear()

    begin = 0
    for line in text.split("\n"):
        cells, at = [], begin
        for m in _SEPARATOR.finditer(line):
            cells.append((at, begin + m.start()))
            at = begin + m.end()
        cells.append((at, begin + len(line)))
        if len(cells) < 2:
            close()
            parts.append(cells[0])
        else:
            run.append(cells)
        begin += len(line) + 1
    close()
    if not apart:
        return None
    places = np.concatenate([np.append(np.arange(a, z), z) for a, z in parts])
    return "\n".join(text[a:z] for a, z in parts), places


def leaks_of(items: Items, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """Per text: (item, words found in a row, first and last character) for every candidate, best per item.

    Texts with joined columns are read both as they stand and column by column.
    """
    apart = [(i, *c) for i, t in enumerate(texts) if (c := columns_apart(t)) is not None]
    out = scan(items, [*texts, *(c[1] for c in apart)])
    for (i, _, places), found in zip(apart, out[len(texts) :]):
        best = {x[0]: x for x in out[i]}
        for k, n, a, z in found:
            if k not in best or n > best[k][1]:
                best[k] = (k, n, int(places[a : z + 1].min()), int(places[a : z + 1].max()))
        out[i] = list(best.values())
    return out[: len(texts)]


def scan(items: Items, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """``leaks_of`` for texts as they stand."""
    symbols, at, _, starts = fold_all(texts)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    hit, item, place, _ = items.table.hits(symbols)
    found = candidates(hit, item, place, starts)
    slots = items.short.index(symbols)
    begin, finish = covered(items, slots, starts, found)
    text, block, k, *_ = found
    places: list[list[int]] = []
    last: tuple[int, int, int] | None = None
    keep = np.flatnonzero(finish >= 0)
    for c in keep[np.lexsort((block[keep], k[keep], text[keep]))].tolist():
        here, b, lo, hi = (int(text[c]), int(k[c])), int(block[c]), int(begin[c]), int(finish[c])
        z = min(int(starts[here[0] + 1]) - 1, int(starts[here[0]]) + b * STEP + BLOCK + MARGIN)
        if last == (*here, b - 1):  # two blocks that overlap are aligned together
            places[-1][2:] = [min(places[-1][2], lo), max(places[-1][3], hi), places[-1][4], z]
            last = None
        else:
            places.append([*here, lo, hi, max(int(starts[here[0]]), int(starts[here[0]]) + b * STEP - MARGIN), z])
            last = (*here, b)
    places = supported(items, slots, places)
    places.sort(key=lambda p: p[5] - p[4])  # of like size together
    for part in _together(places):
        cut = [(max(0, lo - MARGIN), min(len(items.symbols[k]), hi + 1 + MARGIN)) for _, k, lo, hi, _, _ in part]
        aligned = align_all([(items.symbols[p[1]][a:z], symbols[p[4] : p[5]]) for p, (a, z) in zip(part, cut)])
        some = [(p[0], p[1], items.words[p[1]], got + [a, p[4]]) for p, (a, _), got in zip(part, cut, aligned) if len(got)]
        for (t, k, words, pairs), grades in zip(some, graded_together([x[2:] for x in some])):
            n, w0 = trimmed_run(*longest_run(grades), words, pairs)
            if n > best.get((t, k), (0, 0, 0))[0]:
                of = words[pairs[:, 0]]
                inside = pairs[(of >= w0) & (of < w0 + n), 1]
                best[t, k] = (n, int(at[inside[0]]), int(at[inside[-1]]))
    for (t, k), v in best.items():
        out[t].append((k, *v))
    return out


def item_slices(items: DataFrame, key: str, text: str, limit: int = SLICE_CHARS) -> Iterator[Items]:
    """The items in tables of at most about ``limit`` characters, each small enough to be broadcast; one for a usual test set.

    They are fetched one after the other, so the driver holds one table at a time.
    """
    rows = items.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).orderBy(key)
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if size >= limit:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", boxes: str | None = "boxes", min_words: int = MIN_WORDS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_key, item_key, words, start_at, end_at) of every leaked item, places in the text in reading order. One pass over the documents for each table of items, no shuffle."""
    box = F.col(boxes) if boxes and boxes in documents.columns else F.lit(None).cast("array<struct<x0:int,y0:int>>")
    x, y = F.transform(box, lambda b: b["x0"].cast("double")), F.transform(box, lambda b: b["y0"].cast("double"))
    wide = F.array_max(x) - F.array_min(x) > COLUMN_GAP
    rows = spread(documents.select(doc_key, F.col(text).alias("_text"), F.when(wide, x).alias("_x0"), F.when(wide, y).alias("_y0")).where(F.col("_text").isNotNull()))
    kind = dict(documents.dtypes)[doc_key]
    schema = f"{doc_key} {kind}, {item_key} {dict(items.dtypes)[item_key]}, words int, start_at int, end_at int"
    out = None
    for table in item_slices(items, item_key, text, slice_chars):
        shared = documents.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = shared.value
            for pdf in batches:
                out, at = [], 0
                keys, texts = pdf[doc_key].tolist(), [reading_order(*r) for r in zip(pdf["_text"], pdf["_x0"], pdf["_y0"])]
                while at < len(texts):
                    n, size = 1, len(texts[at])
                    while at + n < len(texts) and size + len(texts[at + n]) <= BATCH_CHARS:
                        size += len(texts[at + n])
                        n += 1
                    for key, found in zip(keys[at : at + n], leaks_of(known, texts[at : at + n])):
                        out += [(key, i, words, a + 1, z + 1) for k, words, a, z in found if words >= min_words for i in known.ids[k]]
                    at += n
                yield pd.DataFrame(out, columns=[doc_key, item_key, "words", "start_at", "end_at"])

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def cut_leaks(documents: DataFrame, leaks: DataFrame, doc_key: str = "doc_id", text: str = "text", boxes: str | None = "boxes", mark: str = " ") -> DataFrame:
    """The documents with ``cut``: the text in reading order without the leaked passages, each of which leaves ``mark``. Other columns pass through."""
    kind = {doc_key: dict(documents.dtypes)[doc_key]}
    box = F.col(boxes) if boxes and boxes in documents.columns else F.lit(None).cast("array<struct<x0:int,y0:int>>")
    x, y = F.transform(box, lambda b: b["x0"].cast("double")), F.transform(box, lambda b: b["y0"].cast("double"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, xs: pd.Series, ys: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, cx, cy, a, z in zip(texts, xs, ys, starts, ends):
            if not isinstance(t, str) or a is None:
                out.append(t if isinstance(t, str) else None)
                continue
            read, at, parts = reading_order(t, cx, cy), 0, []
            for begin, end in sorted(zip(a, z)):
                if end > at:
                    parts += [read[at : max(at, begin - 1)], mark]
                    at = end
            out.append("".join([*parts, read[at:]]))
        return pd.Series(out, dtype=object)

    spans = leaks.groupBy(F.col(doc_key).cast(kind[doc_key]).alias(doc_key)).agg(F.collect_list(F.struct("start_at", "end_at")).alias("_spans"))  # one row per leaked document, as many spans as items
    joined = documents.join(spans, doc_key, "left")
    return joined.withColumn("cut", cut(F.col(text), x, y, F.col("_spans.start_at"), F.col("_spans.end_at"))).drop("_spans")


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents in which no item leaks."""
    return documents.join(leaks.select(doc_key).distinct(), doc_key, "left_anti")
