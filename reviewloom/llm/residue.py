"""Template residue and error-page text.

1. *Mine.* A message is what stands from the start of a line to the end of its
   sentence. Every task counts its messages; they go down a prefix tree of fixed
   depth (number of tokens, then the first of them), one leaf after the other in
   sorted partitions, and join the templates of their leaf.
2. *Classify once.* Each template, however often it occurs, is classified once
   (``verdicts``) into script notice, error message, navigation, filler or content.
3. *Propagate.* The messages of the residue templates, folded, are a table of
   n-grams. A line is residue if it begins with most of a message's windows,
   which holds for misread copies too; no document is classified by itself.
4. *Slots and filler* are detected inside any record: unresolved placeholders,
   lines of repeated words or signs, letters in the alphabet's order, and runs
   of words that the corpus does not know (words in at least KNOWN_SHARE of the
   different documents are known, so there are at most ``words per document /
   KNOWN_SHARE`` of them).

One pass over the texts yields messages, words and fingerprints; it is written
to the shared folder. A second pass scans the lines.

Defined cases: null, empty and blank texts are no residue; repeated documents
are reported each; editorial brackets such as [sic] or [Continued on page 2.]
are content; messages of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.folding import CONFUSED, GramTable, fold, fold_lines, grams
from reviewloom.llm.leakage import COLUMN_GAP, line_order
from reviewloom.llm.verdicts import letters_in_order, classify, leaf_of, verdicts_of_leaf
from reviewloom.session import fresh_path, spread

KNOWN_SHARE = 0.003
GRAM = 5
COVER = 0.65  # share of a template's windows that a line must hold
HEAD = 48  # symbols from a line's begin by which a message is looked up; the rest of a longer one is then compared
AHEAD, FEWEST = 24, 5  # windows at a line's begin, and how many of them must be in the table before the line is looked at
EARLY = 12  # first windows of a message, of which some must be there
MIN_GRAMS = 8  # windows of a template that can be propagated by windows
SHORT_MESSAGE = 12  # characters below which a message goes on to the end of its next sentence
SLICE_BYTES = 64 * 1024 * 1024  # of folded messages in one table that is broadcast; more messages make more tables, each scanned for
HELD = 400_000  # distinct messages or words that a task counts before it passes them on

#: Numbers stand for themselves in no template; a single digit inside a word is a misread letter.
_NUMBER = re.compile(r"\d{2,}|(?<!\w)\d(?!\w)")
_DIGIT = re.compile(r"\d")
_ENDS = re.compile(r"[.!?…:”\"]\s*$")
_SENTENCE = re.compile(r"[.!?…](?= |$)")
_LETTER_RUN = re.compile(r"[^\W\d_]{3,}")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_SAME_LETTER = str.maketrans({c: s for s, cs in CONFUSED.items() for c in cs})


def _masked(text: str) -> str:
    text = " ".join(text.split())
    return _NUMBER.sub("#", text) if _DIGIT.search(text) else text


def messages_of(lines: list[str]) -> Iterator[str]:
    """The messages of a text's lines (broken words whole): from the first line, or one after a line that ends a sentence or has no small letters, to the end of the sentence; before a line with a capital also to the end of the line."""
    fresh = True
    for i, line in enumerate(lines):
        starts, fresh = fresh, not line or line[-1] in ".!?…:”\" " and _ENDS.search(line) is not None or line.upper() == line
        if not starts or not line:
            continue
        text, at, k = line, 0, i + 1
        if k < len(lines) and lines[k][:1].isupper() and line[-1] not in ".!?…:" and len(line) >= SHORT_MESSAGE:  # it may end with its line
            yield _masked(line)
        while True:
            m = _SENTENCE.search(text, at)
            if m is not None:
                if m.end() >= SHORT_MESSAGE or (m.end() >= len(text.rstrip()) and (k >= len(lines) or not lines[k])):
                    text = text[: m.end()]
                    break
                at = m.end()
                if at < len(text):
                    continue
            if k >= len(lines) or not lines[k].strip():
                break
            at = max(at, len(text) - 1)
            text = f"{text} {lines[k]}"
            k += 1
        text = _masked(text)
        if len(text) >= 4:
            yield text


def _ordered(documents: DataFrame, key: str, text: str, boxes: str | None) -> DataFrame:
    """key, _text and the corners of the lines where they show more than one column."""
    box = F.col(boxes) if boxes and boxes in documents.columns else F.lit(None).cast("array<struct<x0:int,y0:int>>")
    x, y = F.transform(box, lambda b: b["x0"].cast("double")), F.transform(box, lambda b: b["y0"].cast("double"))
    wide = F.array_max(x) - F.array_min(x) > COLUMN_GAP
    return documents.select(key, F.col(text).alias("_text"), F.when(wide, x).alias("_x0"), F.when(wide, y).alias("_y0")).where(F.col("_text").isNotNull() & (F.length("_text") > 0))


def _read_lines(text: str, order: np.ndarray | None) -> list[str]:
    lines = text.split("\n")
    return whole_lines(lines if order is None else [lines[k] for k in order.tolist()])


#: Of a text in the code page of western languages: small letters with blanks between words, and those that scans take for one another as one.
_CODES = [bytes([i]).decode("cp1252", "replace").lower() for i in range(256)]
_WORDS = bytes(c.encode("cp1252", "replace")[0] if c.isalpha() else 32 for c in _CODES)
_SAME = bytes(ord(c.translate(_SAME_LETTER)) if c.isascii() else i for i, c in enumerate(_CODES))
_DROPPED = bytes(i for i in range(256) if not chr(_SAME[i]).isalpha() or (i >= 128 and not _CODES[i].isalpha()))


def _words_of(text: str) -> tuple[str, set[str]] | None:
    """(fingerprint of the letters as any scan may take them, distinct words of three letters or more); None for a text that mostly repeats a line."""
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    if 2 * len(set(lines)) <= len(lines) and 2 * len({s.lower() for s in lines}) <= len(lines):
        return None
    try:
        raw = text.encode("cp1252")
        words = {w for w in raw.translate(_WORDS).decode("cp1252", "replace").split() if len(w) > 2}
        letters = raw.translate(_SAME, _DROPPED)
    except UnicodeEncodeError:
        low = text.lower()
        words = set(_LETTER_RUN.findall(low))
        letters = _NO_LETTERS.sub("", low.translate(_SAME_LETTER)).encode("cp1252", "backslashreplace")
    return hashlib.blake2b(letters, digest_size=16).hexdigest(), words


def mined(documents: DataFrame, key: str = "doc_id", text: str = "text", boxes: str | None = "boxes") -> DataFrame:
    """One pass: the counts of every task by ``kind``, message (leaf, value, n), word (value, n) and text (value: fingerprint, n, smallest key)."""
    rows = spread(_ordered(documents, key, text, boxes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said: Counter[str] = Counter()
        words: Counter[str] = Counter()
        texts: dict[str, list] = {}

        def counted() -> Iterator[pd.DataFrame]:
            if said:
                yield pd.DataFrame({"kind": "message", "leaf": [leaf_of(m) for m in said], "value": list(said), "n": list(said.values()), key: None}).astype(object)
            if words:
                yield pd.DataFrame({"kind": "word", "leaf": None, "value": list(words), "n": list(words.values()), key: None}).astype(object)
            if texts:
                yield pd.DataFrame({"kind": "text", "leaf": None, "value": list(texts), "n": [t[0] for t in texts.values()], key: [t[1] for t in texts.values()]}).astype(object)
            said.clear(), words.clear(), texts.clear()

        for pdf in batches:
            for k, t, x, y in zip(pdf[key], pdf["_text"], pdf["_x0"], pdf["_y0"]):
                said.update(messages_of(_read_lines(t, None if x is None else line_order(t, x, y))))
                if (own := _words_of(t)) is not None:
                    old = texts.get(own[0])
                    texts[own[0]] = [1, k] if old is None else [old[0] + 1, min(old[1], k)]
                    words.update(own[1])
            if len(said) + len(words) + len(texts) > HELD:
                yield from counted()
        yield from counted()

    path = fresh_path(documents.sparkSession, "mined")
    rows.mapInPandas(run, f"kind string, leaf string, value string, n long, {key} {dict(documents.dtypes)[key]}").write.partitionBy("kind").parquet(path)
    return documents.sparkSession.read.schema(f"leaf string, value string, n long, {key} {dict(documents.dtypes)[key]}, kind string").parquet(path)


def residue_templates(mined_rows: DataFrame) -> Iterator[tuple[str, str]]:
    """(verdict, message) of the residue, the most frequent first.

    A partition holds whole leaves in sorted order and takes one after the other,
    so no task holds more than a leaf's messages.
    """
    counted = mined_rows.where("kind = 'message'").groupBy("leaf", "value").agg(F.sum("n").alias("n"))
    leaves = counted.repartition("leaf").sortWithinPartitions("leaf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, rows = None, []
        for pdf in batches:
            out = []
            for name, value, n in zip(pdf["leaf"], pdf["value"], pdf["n"]):
                if name != leaf:
                    out += verdicts_of_leaf(rows)
                    leaf, rows = name, []
                rows.append((value, n))
            yield pd.DataFrame(out, columns=["verdict", "message", "n"]).astype(object)
        yield pd.DataFrame(list(verdicts_of_leaf(rows)), columns=["verdict", "message", "n"]).astype(object)

    path = fresh_path(mined_rows.sparkSession, "residue")
    leaves.mapInPandas(run, "verdict string, message string, n long").write.parquet(path)
    found = mined_rows.sparkSession.read.schema("verdict string, message string, n long").parquet(path)
    for r in found.orderBy(F.desc("n"), "verdict", "message").toLocalIterator():
        yield r[0], r[1]


def tables(found: Iterator[tuple[str, str]], known: set[str]) -> Iterator[Detector]:
    """Detectors for the messages, each behind the bound of its table; usually one."""
    part: list[tuple[str, str]] = []
    size, any_yet = 0, False
    for verdict, message in found:
        part.append((verdict, message))
        size += 14 * len(message)
        if size > SLICE_BYTES:
            yield Detector(part, None if any_yet else known)
            part, size, any_yet = [], 0, True
    if part or not any_yet:
        yield Detector(part, None if any_yet else known)


def known_words(documents: DataFrame, mined_rows: DataFrame, key: str = "doc_id", text: str = "text", share: float = KNOWN_SHARE) -> set[str]:
    """Words in at least ``share`` of the different documents (at least 3); their number is bounded by words per document / share.

    Documents of the same letters, as scans may take them, count once, and those
    that mostly repeat a line don't count: a filler text isn't known because
    there are many copies of it. Words are counted by row first; what the copies
    of a text add is then taken off, for one of its documents.
    """
    texts = mined_rows.where("kind = 'text'").groupBy("value").agg(F.sum("n").alias("n"), F.min(key).alias(key))
    n = texts.count()
    copied = texts.where("n > 1").select(key, (1 - F.col("n")).alias("_more"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            less: Counter[str] = Counter()
            for t, more in zip(pdf["_text"], pdf["_more"]):
                for w in (_words_of(t) or ("", ()))[1]:
                    less[w] += more
            yield pd.DataFrame({"value": list(less), "n": list(less.values())}).astype(object)

    doubles = documents.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).join(copied, key).select("_text", "_more").mapInPandas(run, "value string, n long")
    counts = mined_rows.where("kind = 'word'").select("value", "n").unionByName(doubles).groupBy("value").agg(F.sum("n").alias("n"))
    return {r[0] for r in counts.where(F.col("n") >= max(3, int(share * n))).select("value").collect()}


def merged(found: list[tuple[str, str]]) -> tuple[list[str], list[np.ndarray]]:
    """Verdicts and symbols of the templates that no more frequent one stands for.

    A template is merged into one that covers it as a line would have to be
    covered, at places that differ by no more than a line's may, and a little
    more, so what it would find is found by the other.
    """
    verdicts: list[str] = []
    symbols: list[np.ndarray] = []
    owners: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    for verdict, message in found:
        s = fold(_NUMBER.sub(" ", message), numbers=False)[0]
        if len(s) < MIN_GRAMS + GRAM - 1:
            continue
        mine = list(enumerate(grams(s, GRAM).tolist()))
        covers: dict[int, set[int]] = {}
        for at, g in mine:
            for o, place in owners.get(g, ()):
                if abs(at - place) <= 3:
                    covers.setdefault(o, set()).add(place)
        shared = {o: len(places) for o, places in covers.items()}
        if any(n >= (COVER + 0.1) * sizes[o] for o, n in shared.items()):
            continue
        for at, g in mine:
            owners.setdefault(g, []).append((len(sizes), at))
        sizes.append(len(mine))
        verdicts.append(verdict)
        symbols.append(s)
    return verdicts, symbols


def short_templates(found: list[tuple[str, str]]) -> dict[bytes, bool]:
    """The templates too short for windows, folded whole, and whether only lines with a number match: 'forbidden' alone may be a word of an article."""
    out: dict[bytes, bool] = {}
    for _, message in found:
        s = fold(_NUMBER.sub(" ", message), numbers=False)[0]
        if 0 < len(s) < MIN_GRAMS + GRAM - 1:
            out[s.tobytes()] = out.get(s.tobytes(), True) and "#" in message
    return out


_NAME = r"[A-Za-z0-9À-ÿ][\w.\-]*(?: [\w.\-]+){0,3}"
#: Slots that were left unfilled (fixed forms of common template languages, and printers' notes).
_SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|<%=?\s*{_NAME}\s*%>|\{{%\s*{_NAME}\s*%\}}|\{{(?:\d|[A-Za-z]+[_.][\w.]+|[A-Z_]{{4,}})\}}"
    r"|#[A-Z]+(?:_[A-Z]+)*#|%[A-Za-z]+(?:[_.]\w+)*%|%[sd] of %[sd]|__[A-Za-z]+(?:[_. ]\w+)*__|<[A-Za-z]+(?:[_.]\w+)+>|<(?:FirstName|LastName|Name|headline|author|title|date|caption|byline|body|article|newspaper|page)>"
    r"|\[(?:your|insert|insérer|hier|einfügen|name of|date tbc|tbc|todo|placeholder)\b[^\]]{0,40}\]|\[[A-Za-z]+[_.]\w+\]|\[[A-Z]+(?:_[A-Z]+)+\]|\bXX [A-Z ]{3,40} XX\b|\bTK TK\b|\{(?!sic\b)[A-Za-zäöüéè]{4,}\}|\[(?:headline|author|title|titel|date|caption|byline|body|article|autor|auteur|schlagzeile)\]",
    re.I,
)
_BARE = re.compile(r"(?:By|Title:|On page|Published in)\s*'?\s*(?:\{[^{}]{1,30}\}|\[[^\[\]]{1,30}\]|<[^<>]{1,30}>)", re.I)
_EDITORIAL = re.compile(r"\[(?:sic|continued|from our|to be continued|advertisement|illegible|see|cont)\b|\{sic\}", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def slot_line(line: str) -> bool:
    """Whether the line holds an unfilled slot."""
    if not ("{" in line or "[" in line or "<" in line or "%" in line or "__" in line or "XX" in line or "TK" in line or "#" in line):
        return False
    bare = _EDITORIAL.sub("", line)
    return _SLOT.search(bare) is not None or _BARE.search(bare) is not None


def content_line(tokens: list[str], known: set[str]) -> bool:
    """Whether a line (its tokens in small letters) has too many different words to be repetition, and enough that the corpus knows."""
    own = set(tokens)
    return 2 * len(own) > len(tokens) + 2 and len(own & known) >= max(2, 0.25 * len(tokens))


def filler_line(line: str, known: set[str]) -> float:
    """2 for a line of signs or repeated words, 1 for one of unknown words, 0 for content, -1 if it is too short to say."""
    tokens = line.lower().split()
    if not tokens:
        return -1
    if content_line(tokens, known):
        return 0
    tokens = line.split()
    letters = sum(map(len, tokens))
    signs = sum(1 for t in tokens if len(t) >= 2 and (not any(c.isalnum() for c in t) or set(t.lower()) == {"x"}))
    if len(tokens) >= 2 and signs >= max(2, 0.7 * len(tokens)) and letters >= 8:
        return 2
    words = [w.lower() for w in _WORD.findall(line)]
    if letters_in_order(line):
        return 2
    if len(words) >= 4:
        again = sum(w == words[k - 1] or (k > 1 and w == words[k - 2]) for k, w in enumerate(words) if k)
        if again >= 0.5 * len(words):
            return 2
    if _DIGIT.search(line):  # numbers say nothing, but with many of them it is a list, or a bad scan
        if 4 * sum(any(c.isdigit() for c in t) for t in tokens) > len(tokens):
            return 0
        line = " ".join(t for t in tokens if not any(c.isdigit() for c in t))
    words = [w for w in _WORD.findall(line) if len(w) >= 3]
    if len(words) < 3:
        return -1
    small = sum(w[0].islower() for w in words)
    unknown = sum(w.lower() not in known for w in words)
    return 1 if unknown >= 0.8 * len(words) and small >= 0.6 * len(words) and len(words) >= 3 else 0


_BREAKS = "-¬=\xad"


def whole_lines(lines: list[str]) -> list[str]:
    """The lines with each broken word whole at the end of its first line."""
    out = list(lines)
    for k in range(len(out) - 1):
        line = out[k]
        if line[-1:] in _BREAKS or line[-2:-1] in _BREAKS and line[-1:] == " ":
            head = line.rstrip(" ")
            if len(line) - len(head) <= 1 and head[-1:] in _BREAKS and head and (head[-2:-1].isalnum() or head[-2:-1] == "_"):
                first, _, rest = out[k + 1].lstrip().partition(" ")
                out[k], out[k + 1] = head[:-1] + first, rest
    return out


def all_unknown(line: str, known: set[str]) -> bool:
    """Whether the line is of at least four words, all small and none known to the corpus."""
    words = _WORD.findall(line)
    return len(words) >= 4 and all(w.islower() and w not in known for w in words) and sum(len(w) >= 3 for w in words) >= 4


class Detector:
    """Residue templates and known words, ready to scan batches of texts."""

    def __init__(self, found: list[tuple[str, str]], known: set[str] | None):
        """Without ``known`` only templates are looked for."""
        self.known = known
        self.verdicts, self.symbols = merged(found)
        symbols = self.symbols
        self.short = short_templates(found)
        self.size = np.array([len(s) - GRAM + 1 for s in symbols], np.int64)
        self.table = GramTable(symbols, GRAM)
        bit = np.where(self.table.place < 64, np.uint64(1) << np.minimum(self.table.place, 63).astype(np.uint64), np.uint64(0))
        #: Per n-gram the places below 64 at which it stands in a template, as bits.
        self.places = np.bitwise_or.reduceat(bit, self.table.start) if len(self.table.codes) else np.zeros(0, np.uint64)

    def by_template(self, texts: list[str]) -> list[set[int]]:
        """Per text the lines that begin with a residue template."""
        out: list[set[int]] = [set() for _ in texts]
        if not texts or not (len(self.size) or self.short):
            return out
        symbols, _, line, base, starts = fold_lines(texts, numbers=False)
        begin = np.full(int(base[-1]) + 1, len(symbols), np.int64)
        lead = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        begin[line[lead]] = lead
        if self.short:
            length = np.bincount(line[symbols > 0], minlength=len(begin))
            for k in np.flatnonzero((length > 0) & (length < MIN_GRAMS + GRAM - 1)).tolist():
                numbered = self.short.get(symbols[begin[k] : begin[k] + length[k]].tobytes())
                if numbered is not None:
                    i = int(np.searchsorted(base, k, side="right")) - 1
                    n = int(k - base[i])
                    if not numbered or any(c.isdigit() for c in texts[i].split("\n")[n]):
                        out[i].add(n)
        if not len(self.size):
            return out
        known = self.table.index(symbols)
        lines = np.flatnonzero(begin < len(symbols))
        stop = starts[np.searchsorted(base, lines, side="right")] - 1  # where the line's text ends
        # windows near a line's begin that stand about there in a template; a message may go on over the next lines
        about = np.append(self.places[known], np.uint64(0))
        about[np.flatnonzero(known < 0)] = 0
        first, fits = begin[lines], np.zeros(len(lines), np.int8)
        for j in range(AHEAD):
            at = np.where(first + j < stop, first + j, len(symbols))
            fits += (about[at] >> np.uint64(max(j - 3, 0))) & np.uint64(127) > 0
        some = fits >= FEWEST
        lines, stop = lines[some], stop[some]
        ahead = begin[lines][:, None] + np.arange(HEAD)
        inside = (ahead < stop[:, None]) & (known[np.minimum(ahead, len(symbols) - 1)] >= 0)
        at, template, place = self.table.owners(ahead[inside], known)
        code = known[ahead[inside]]
        home = np.repeat(np.broadcast_to(lines[:, None], ahead.shape)[inside], self.table.end[code] - self.table.start[code])
        near = np.abs(at - begin[home] - place) <= 3
        key = np.sort((home[near].astype(np.int64) << 42) | (template[near] << 21) | place[near])
        if not len(key):
            return out
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        early = (key & ((1 << 21) - 1)) < EARLY
        key >>= 21
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair, n = key[lead], np.diff(np.append(lead, len(key)))
        size = self.size[pair & ((1 << 21) - 1)]
        good = (n >= np.maximum(MIN_GRAMS - 2, COVER * np.minimum(size, HEAD - 4))) & (np.add.reduceat(early.astype(np.int64), lead) >= FEWEST - 2)  # not only what follows the message
        for g, length in zip(pair[good].tolist(), size[good].tolist()):
            k, t = g >> 21, g & ((1 << 21) - 1)
            i = int(np.searchsorted(base, k, side="right")) - 1
            if length > HEAD - 4:  # the rest of a long message must be there too
                span = known[begin[k] : min(begin[k] + length + 8, int(starts[i + 1]))]
                whole = self.table.index(self.symbols[t])
                if len(np.intersect1d(span[span >= 0], whole)) < COVER * len(np.unique(whole[whole >= 0])):
                    continue
            out[i].add(int(k - base[i]))
        return out

    def scan(self, texts: list[str], orders: list[np.ndarray | None] | None = None) -> list[list[tuple[int, str]]]:
        """Per text the residue lines (number, kind). ``orders``: per text its lines in reading order, if that differs."""
        hits = self.by_template(texts)
        out = []
        for text, marked, order in zip(texts, hits, orders or [None] * len(texts)):
            found = {k: "template" for k in marked}
            if self.known is None:
                out.append(sorted(found.items()))
                continue
            lines = text.split("\n")
            if "{" in text or "[" in text or "<" in text or "%" in text or "__" in text or "XX" in text or "TK" in text or "#" in text:
                for k, line in enumerate(lines):
                    if slot_line(line):
                        found.setdefault(k, "slot")
            place = range(len(lines)) if order is None else order.tolist()
            read = whole_lines([lines[k] for k in place])
            known = self.known
            grade = [0 if content_line(low.split(), known) else filler_line(line, known) for line, low in zip(read, "\n".join(read).lower().split("\n"))]
            if max(grade) < 1:
                out.append(sorted(found.items()))
                continue
            again = Counter(" ".join(line.lower().split()) for line in read)
            for k, g in enumerate(grade):
                if g == 2:
                    found.setdefault(place[k], "filler")
                elif g == 1:
                    a, z = k, k
                    while a > 0 and grade[a - 1] != 0:
                        a -= 1
                    while z + 1 < len(grade) and grade[z + 1] != 0:
                        z += 1
                    others = [x for x in grade[:a] + grade[z + 1 :] if x == 0]
                    if sum(x > 0 for x in grade[a : z + 1]) > 1 or not others or again[" ".join(read[k].lower().split())] > 1 or all_unknown(read[k], self.known):
                        found.setdefault(place[k], "filler")
            out.append(sorted(found.items()))
        return out


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text", boxes: str | None = "boxes") -> DataFrame:
    """(key, line_no, kind) of every residue line."""
    counts = mined(documents, key, text, boxes)
    known = known_words(documents, counts, key, text)
    rows = spread(_ordered(documents, key, text, boxes))
    schema = f"{key} {dict(documents.dtypes)[key]}, line_no int, kind string"
    out = None
    for detector in tables(residue_templates(counts), known):
        shared = documents.sparkSession.sparkContext.broadcast(detector)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            d = shared.value
            for pdf in batches:
                keys, texts, found, at = pdf[key].tolist(), pdf["_text"].tolist(), [], 0
                orders = [None if x is None else line_order(t, x, y) for t, x, y in zip(texts, pdf["_x0"], pdf["_y0"])]
                while at < len(texts):
                    n, size = 1, len(texts[at])
                    while at + n < len(texts) and size + len(texts[at + n]) <= 500_000:
                        size += len(texts[at + n])
                        n += 1
                    for k, lines in zip(keys[at : at + n], d.scan(texts[at : at + n], orders[at : at + n])):
                        found += [(k, line + 1, kind) for line, kind in lines]
                    at += n
                yield pd.DataFrame(found, columns=[key, "line_no", "kind"]).astype(object)

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_residue(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without a residue line."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
