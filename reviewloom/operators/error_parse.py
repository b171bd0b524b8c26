"""Rows that fail to parse: minimum-cost error parse of CSV and JSON records.

A format is a finite automaton over character classes. Dynamic programming
finds the cheapest way to make a record a word of it by inserting or deleting
quotes and delimiters. A record with a zero-cost path whose values fit the
contract is loaded; any other is put out with its reason, which follows from
the edit operations, or from the first value that breaks the contract.

Edits of JSON are those of one object whose values may be whole nested values;
a broken nested value is mended as text of the object around it.

The zero-cost part of the programme is deterministic (at most one path is free
of edits), so it is run first as a compiled pattern, or for JSON as a strict
parser of the full grammar; the full programme runs, vectorised over a batch,
for the records that have no such path.

CSV (RFC 4180, nine cells): ``broken_quoting`` if every parse needs an edit of a
quote, else ``column_count`` if it needs an edit of a delimiter. JSON (one
RFC 8259 object and nothing else): ``not_json``. Then, for both,
``missing_field``, ``bad_rating``, ``bad_timestamp``, ``bad_version``.

Defined cases: a null or empty CSV record is one empty cell (``column_count``),
a null JSON record is ``not_json``; a record of unknown format is read as JSON
if its first character is a brace, else as CSV; unknown JSON keys are ignored,
of repeated keys the last counts; an absent schema_version is ``bad_version``;
records of any length are parsed whole.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.session import spread

FIELDS = ("review_id", "product_id", "rating", "review_text", "source", "created_at", "updated_at", "schema_version", "customer_id_hash")
REQUIRED = ("review_id", "product_id", "review_text", "source", "created_at")
QUOTE_COST = 1 << 32  # more than all delimiter edits of a record together
DELIM_COST = 1
TEXT_COST = 4
_INF = 1 << 60
#: Characters of one batch of the programme, and steps for which back pointers are held.
BATCH_CHARS = 400_000
SEGMENT = 16_384


class Automaton:
    """States, character classes, arcs with costs and edit names, turned into dense predecessor tables."""

    def __init__(self, classes: int, states: int):
        self.n_classes, self.n_states = classes, states
        self._eat: dict[tuple[int, int, int], tuple[int, str]] = {}
        self._free: dict[tuple[int, int], tuple[int, tuple[str, ...]]] = {(s, s): (0, ()) for s in range(states)}
        self.final = np.full(states, _INF, np.int64)
        self.final_ops: dict[int, tuple[str, ...]] = {}

    def eat(self, s: int, c: int, to: int, cost: int = 0, op: str = "") -> None:
        old = self._eat.get((c, s, to))
        if old is None or cost < old[0]:
            self._eat[c, s, to] = (cost, op)

    def insert(self, s: int, to: int, cost: int, op: str) -> None:
        self._free[s, to] = (cost, (op,))

    def finish(self, s: int, cost: int = 0, ops: tuple[str, ...] = ()) -> None:
        self.final[s], self.final_ops[s] = cost, ops

    def build(self) -> Automaton:
        n = range(self.n_states)
        for k in n:  # insertions in a row
            for i in n:
                if (i, k) in self._free:
                    for j in n:
                        if (k, j) in self._free:
                            cost = self._free[i, k][0] + self._free[k, j][0]
                            if cost < self._free.get((i, j), (_INF,))[0]:
                                self._free[i, j] = (cost, self._free[i, k][1] + self._free[k, j][1])
        ends = self.final.copy(), dict(self.final_ops)
        for (i, j), (cost, ops) in self._free.items():
            if ends[0][j] + cost < self.final[i]:
                self.final[i], self.final_ops[i] = ends[0][j] + cost, ops + ends[1].get(j, ())
        self.ops: dict[tuple[int, int, int], tuple[str, ...]] = {}
        best: dict[tuple[int, int, int], int] = {}
        for (c, mid, to), (cost, op) in self._eat.items():
            for s in n:
                if (s, mid) in self._free:
                    total = cost + self._free[s, mid][0]
                    if total < best.get((c, s, to), _INF):
                        best[c, s, to] = total
                        self.ops[c, s, to] = self._free[s, mid][1] + ((op,) if op else ())
        for s in n:  # the class of padding
            best[self.n_classes, s, s] = 0
        into: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (c, s, to), cost in best.items():
            into.setdefault((c, to), []).append((s, cost))
        width = max(map(len, into.values()))
        self.pred = np.zeros((self.n_classes + 1, self.n_states, width), np.int64)
        self.cost = np.full((self.n_classes + 1, self.n_states, width), _INF, np.int64)
        for (c, to), arcs in into.items():
            for k, (s, cost) in enumerate(arcs):
                self.pred[c, to, k], self.cost[c, to, k] = s, cost
        return self

    def parse(self, coded: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[str]]:
        """Cheapest cost of each record (classes, places, run lengths) and its edits as ``name@place`` joined by blanks.

        Back pointers are kept for SEGMENT steps at a time; for longer records
        the costs at the segments' begins are kept, and the segments are run
        again from the last to the first.
        """
        b, longest = len(coded), max((len(x[0]) for x in coded), default=0)
        grid = np.full((longest, b), self.n_classes, np.int64)
        runs = np.ones((longest, b), np.int64)
        for i, (x, _, n) in enumerate(coded):
            grid[: len(x), i], runs[: len(x), i] = x, n
        now = np.full((b, self.n_states), _INF, np.int64)
        now[:, 0] = 0
        marks = [now]
        for begin in range(0, longest, SEGMENT):
            now, back = self._run(grid, runs, begin, min(longest, begin + SEGMENT), now)
            marks.append(now)
        done = now + self.final
        last = done.argmin(axis=1)
        edits = [[f"{o}@{int(x[1][-1] + x[2][-1]) if len(x[0]) else 0}" for o in reversed(self.final_ops.get(int(last[i]), ()))] for i, x in enumerate(coded)]
        state = last.copy()
        for k in range(len(marks) - 2, -1, -1):
            begin, end = k * SEGMENT, min(longest, (k + 1) * SEGMENT)
            if k < len(marks) - 2:
                back = self._run(grid, runs, begin, end, marks[k])[1]
            for i, (x, at, n) in enumerate(coded):
                s = int(state[i])
                for t in range(min(len(x), end) - 1, begin - 1, -1):
                    p = int(back[t - begin, i, s])
                    for o in reversed(self.ops.get((int(x[t]), p, s), ())):
                        edits[i].append(f"{o}@{int(at[t])}" + (f"x{int(n[t])}" if n[t] > 1 else ""))
                    s = p
                state[i] = s
        return done.min(axis=1), [" ".join(reversed(e)) for e in edits]

    def _run(self, grid: np.ndarray, runs: np.ndarray, begin: int, end: int, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(costs after the steps, back pointers of the steps)."""
        b = grid.shape[1]
        back = np.zeros((end - begin, b, self.n_states), np.uint8)
        flat = np.arange(b)[:, None, None] * self.n_states
        for t in range(begin, end):
            pred = self.pred[grid[t]]
            price = self.cost[grid[t]]
            if (runs[t] > 1).any():  # of a run of equal characters each costs as much
                price = np.where(price < _INF, price * runs[t][:, None, None], _INF)
            reach = now.ravel()[flat + pred] + price
            pick = reach.argmin(axis=2)[:, :, None]
            now = np.minimum(np.take_along_axis(reach, pick, 2)[:, :, 0], _INF)
            back[t - begin] = np.take_along_axis(pred, pick, 2)[:, :, 0]
        return now, back


def csv_automaton(cells: int = len(FIELDS), delimiter_class: int = 1) -> Automaton:
    """Classes: 0 quote, 1 delimiter, 2 other. Four states per cell; the cell after the last is the surplus."""
    quote, delim, other = 0, delimiter_class, 2
    a = Automaton(3, 4 * (cells + 1))
    for c in range(cells + 1):
        start, bare, inside, closed = (4 * c + k for k in range(4))
        more = min(c + 1, cells)
        to_next, over = 4 * more, (DELIM_COST, "delete_delimiter") if more == cells else (0, "")
        a.eat(start, quote, inside)
        a.eat(start, quote, start, QUOTE_COST, "delete_quote")
        a.eat(start, other, bare)
        a.insert(start, inside, QUOTE_COST, "insert_quote")
        a.eat(bare, other, bare)
        a.eat(bare, quote, bare, QUOTE_COST, "delete_quote")
        a.eat(inside, quote, closed)
        a.eat(inside, quote, inside, QUOTE_COST, "insert_quote")
        for x in (delim, other):
            a.eat(inside, x, inside)
        a.insert(inside, closed, QUOTE_COST, "insert_quote")
        a.eat(closed, quote, inside)
        a.eat(closed, other, inside, QUOTE_COST, "insert_quote")
        for s in (start, bare, closed):
            a.eat(s, delim, to_next, *over)
            a.eat(s, delim, s, DELIM_COST, "delete_delimiter")
        if more < cells:
            a.eat(bare, other, to_next + 1, DELIM_COST, "insert_delimiter")
        lacking = max(0, cells - 1 - c)
        for s in (start, bare, closed):
            a.finish(s, lacking * DELIM_COST, ("insert_delimiter",) * lacking)
    return a.build()


def json_automaton() -> Automaton:
    """A flat object. Classes: 0 quote 1 backslash 2 comma 3 colon 4 { 5 } 6 [ ] 7 space 8 scalar 9 line break or tab 10 control 11 other."""
    before, first, key, key_esc, keyed, value, text, text_esc, scalar, end, valued, again = range(12)
    a = Automaton(12, 12)
    for s in (before, first, keyed, value, valued, again, end):
        for ws in (7, 9):
            a.eat(s, ws, s)
    a.eat(before, 4, first)
    a.insert(before, first, DELIM_COST, "insert_delimiter")
    a.eat(first, 5, end)
    for s in (first, again):
        a.eat(s, 0, key)
        a.insert(s, key, DELIM_COST, "insert_quote")
    for s, esc, out in ((key, key_esc, keyed), (text, text_esc, valued)):
        for c in (2, 3, 4, 5, 6, 7, 8, 11):
            a.eat(s, c, s)
        a.eat(s, 1, esc)
        a.eat(s, 0, out)
        a.insert(s, out, DELIM_COST, "insert_quote")
        for c in range(12):
            a.eat(esc, c, s)
    a.eat(keyed, 3, value)
    a.insert(keyed, value, DELIM_COST, "insert_delimiter")
    a.eat(value, 0, text)
    a.insert(value, text, DELIM_COST, "insert_quote")
    a.eat(value, 8, scalar)
    a.eat(scalar, 8, scalar)
    for ws in (7, 9):
        a.eat(scalar, ws, valued)
    for s in (scalar, valued):
        a.eat(s, 2, again)
        a.eat(s, 5, end)
        a.insert(s, again, DELIM_COST, "insert_delimiter")
        a.insert(s, end, DELIM_COST, "insert_delimiter")
    for s in range(12):
        for c in range(12):
            kind = "delete_quote" if c == 0 else "delete_delimiter" if c in (2, 3, 4, 5, 6) else "delete_text"
            a.eat(s, c, s, DELIM_COST if kind != "delete_text" else TEXT_COST, kind)
    a.finish(end)
    return a.build()


_JSON_CLASS = np.full(0x80, 11, np.int64)
_JSON_CLASS[:0x20] = 10
for _c, _k in {'"': 0, "\\": 1, ",": 2, ":": 3, "{": 4, "}": 5, "[": 6, "]": 6, " ": 7, "\t": 9, "\n": 9, "\r": 9}.items():
    _JSON_CLASS[ord(_c)] = _k
for _c in "0123456789+-.abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _JSON_CLASS[ord(_c)] = 8


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


Coded = tuple[np.ndarray, np.ndarray, np.ndarray]


def _shortened(classes: np.ndarray, runs_of: tuple[int, ...]) -> Coded:
    """(classes, places, run lengths): the middle of a run of equal characters that are text counts as one step.

    Its first two and last two stay apart, so whatever an edit can do within the
    run it can do there, at the same cost.
    """
    n = len(classes)
    if n < 6:
        return classes, np.arange(n), np.ones(n, np.int64)
    inner = np.zeros(n, bool)
    same = classes[1:] == classes[:-1]
    inner[3:-2] = same[:-4] & same[1:-3] & same[2:-2] & same[3:-1] & same[4:]  # as the two before it, the one before those, and the two after it
    inner &= np.isin(classes, runs_of)
    at = np.flatnonzero(~inner | np.concatenate([[True], ~inner[:-1]]))
    return classes[at], at, np.diff(np.append(at, n))


def code_json(text: str) -> Coded:
    p = _points(text)
    classes = _JSON_CLASS[np.where(p < 0x80, p, ord("'"))]
    for a, z in _whole_values(text):
        classes[a:z] = 8
    return _shortened(classes, (7, 8, 10, 11))


def code_csv(text: str) -> Coded:
    p = _points(text)
    return _shortened(np.where(p == ord('"'), 0, np.where(p == ord(","), 1, 2)).astype(np.int64), (2,))


_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _whole_values(text: str) -> list[tuple[int, int]]:
    """The outermost arrays and objects inside the record that are whole JSON values: for the record's own edits they are scalars."""
    if text.count("{") + text.count("[") < 2:
        return []
    stack: list[int] = []
    good: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text):
        c = m.group()
        if c in "{[":
            stack.append(m.start())
        elif c in "}]" and stack:
            a = stack.pop()
            if stack and text[stack[0]] == "{":  # inside an object
                inside = [g for g in good if g[0] > a]
                short, at = "", a
                for g in inside:  # values already known to be whole stand as a number
                    short += text[at : g[0]] + "0"
                    at = g[1]
                if json_value(short + text[at : m.end()]):
                    good = [g for g in good if g[0] < a] + [(a, m.end())]
    return [g for g in good if g[0] > 0]


#: The edit-free paths of the CSV automaton: one cell, and nine of them.
_CELL = r'(?:"(?:[^"]|"")*+"|[^",][^",]*+|)'
_FREE = re.compile(rf"{_CELL}(?:,{_CELL}){{{len(FIELDS) - 1}}}")
_EACH = re.compile(rf"({_CELL})(?:,|\Z)")


def csv_cells(text: str) -> list[str] | None:
    """The nine cells if the record has an edit-free path, else None."""
    if _FREE.fullmatch(text) is None:
        return None
    cells, at = [], 0
    for _ in FIELDS:
        m = _EACH.match(text, at)
        raw, at = m.group(1), m.end()
        cells.append(raw[1:-1].replace('""', '"') if raw[:1] == '"' else raw)
    return cells


def _no_constant(name: str):
    raise ValueError(name)


def _whole_number(digits: str) -> int | float:
    """An integer of any length; one that no rule could accept stands for all longer ones."""
    return int(digits) if len(digits) < 20 else float("inf")


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole_number)


def json_value(text: str) -> bool:
    """Whether the text is one JSON value."""
    try:
        _DECODER.decode(text)
    except RecursionError:
        return _flattened(text) is not None
    except ValueError:
        return False
    return True


def json_object(text: str) -> dict | None:
    """The object if the text is one RFC 8259 object and nothing else, else None; of any depth and with numbers of any length."""
    try:
        got = _DECODER.decode(text)
    except RecursionError:
        got = _flattened(text)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _flattened(text: str) -> object | None:
    """The value of a text nested too deep for recursion: what stands in brackets is checked from the inside out and then stands as a number."""
    parts: list[list[str]] = [[]]
    opens: list[str] = []
    at = 0
    for m in _BRACKET.finditer(text):
        c = m.group()
        if len(c) > 1:
            continue
        parts[-1].append(text[at : m.start()])
        at = m.end()
        if c in "{[":
            opens.append(c)
            parts.append([c])
        else:
            if not opens or {"{": "}", "[": "]"}[opens.pop()] != c:
                return None
            body = "".join(parts.pop()) + c
            try:
                value = _DECODER.decode(body)
            except (ValueError, RecursionError):
                return None
            if not opens:
                return value if not text[at:].strip(" \t\r\n") and not "".join(parts[0]).strip(" \t\r\n") else None
            parts[-1].append("0")
    return None


_TIME = re.compile(
    r"(\d{4})-?(\d{2})-?(\d{2})[Tt](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|z|[+-]\d{2}(?::?\d{2})?)", re.ASCII
)


def instant(value: object) -> dt.datetime | None:
    """The instant of an ISO 8601 date and time with zone, or None if it is none or doesn't exist."""
    m = _TIME.fullmatch(value) if isinstance(value, str) else None
    if m is None:
        return None
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups()[:6])
    zone = m.group(8)
    shift = dt.timedelta()
    if zone not in "Zz":
        zh, zm = int(zone[1:3]), int(zone[-2:]) if len(zone) > 3 else 0
        if zh > 23 or zm > 59:
            return None
        shift = dt.timedelta(hours=zh, minutes=zm) * (-1 if zone[0] == "-" else 1)
    midnight = h == 24 and mi == s == 0 and not int(m.group(7) or 0)
    try:
        base = dt.datetime(y, mo, d, 0 if midnight else h, mi, min(s, 59) if s == 60 else s, int((m.group(7) or "0")[:6].ljust(6, "0")))
        return base + dt.timedelta(days=int(midnight)) - shift
    except (ValueError, OverflowError):
        return None


def _absent(v: object) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


def contract_reason(rec: dict, from_csv: bool) -> str | None:
    """The first rule of the contract that the values break. Empty CSV cells are null."""
    if any(_absent(rec.get(f)) for f in REQUIRED):
        return "missing_field"
    rating = rec.get("rating")
    if from_csv:
        rating = int(rating) if isinstance(rating, str) and re.fullmatch(r"\s*[+-]?\d{1,18}\s*", rating, re.ASCII) else None
    if isinstance(rating, bool) or not isinstance(rating, int | float) or rating != rating or rating not in (1, 2, 3, 4, 5):
        return "bad_rating"
    made, changed = instant(rec["created_at"]), rec.get("updated_at")
    if made is None:
        return "bad_timestamp"
    if not (changed is None or (from_csv and changed == "")):
        if (changed := instant(changed)) is None or changed < made:
            return "bad_timestamp"
    version = rec.get("schema_version")
    if from_csv:
        version = int(version) if isinstance(version, str) and re.fullmatch(r"\s*[+-]?\d{1,18}\s*", version, re.ASCII) else None
    if isinstance(version, bool) or version != 1:
        return "bad_version"
    return None


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(kind: str) -> Automaton:
    if kind not in _AUTOMATA:
        _AUTOMATA[kind] = csv_automaton() if kind == "csv" else json_automaton()
    return _AUTOMATA[kind]


def error_scripts(texts: list[str], kind: str) -> tuple[np.ndarray, list[str]]:
    """Costs and edits of records, in batches of similar length so that padding stays small."""
    coded = [(code_csv if kind == "csv" else code_json)(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(coded[i][0]))
    costs, scripts = np.zeros(len(texts), np.int64), [""] * len(texts)
    while order:
        n = 1
        while n < len(order) and len(coded[order[n]][0]) * (n + 1) <= BATCH_CHARS:
            n += 1
        batch, order = order[:n], order[n:]
        cost, script = _automaton(kind).parse([coded[i] for i in batch])
        for k, i in enumerate(batch):
            costs[i], scripts[i] = cost[k], script[k]
    return costs, scripts


def parse_records(texts: list[str | None], formats: list[str | None]) -> list[tuple]:
    """(reason, edits, cost, then the nine values as text or None) of each record; reason None means valid."""
    out: list[tuple] = [()] * len(texts)
    failed: dict[str, list[int]] = {"csv": [], "json": []}
    for i, (text, fmt) in enumerate(zip(texts, formats)):
        text = text if isinstance(text, str) else ""
        kind = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json"}.get((fmt or "").lower() if isinstance(fmt, str) else "") or ("json" if text.lstrip()[:1] == "{" else "csv")
        if kind == "csv":
            cells = csv_cells(text)
            rec = None if cells is None else {f: (c if c != "" else None) for f, c in zip(FIELDS, cells)}
        else:
            rec = json_object(text)
        if rec is None:
            failed[kind].append(i)
            continue
        reason = contract_reason(rec, kind == "csv")
        values = tuple(None if reason or rec.get(f) is None else str(int(rec[f])) if isinstance(rec[f], float) else str(rec[f]) for f in FIELDS)
        out[i] = (reason, "", 0, *values)
    for kind, at in failed.items():
        costs, scripts = error_scripts([texts[i] if isinstance(texts[i], str) else "" for i in at], kind)
        for i, cost, script in zip(at, costs, scripts):
            reason = "not_json" if kind == "json" else "broken_quoting" if cost >= QUOTE_COST else "column_count"
            out[i] = (reason, script, int(cost % QUOTE_COST + cost // QUOTE_COST), *[None] * len(FIELDS))
    return out


_SCHEMA = "source_table string, record_key string, reason string, edits string, edit_cost long, " + ", ".join(f"{f} string" for f in FIELDS)


def error_parse(records: DataFrame) -> DataFrame:
    """Parse every record once. ``records``: source_table, record_key, record, format. No shuffle but to spread a small input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["reason", "edits", "edit_cost", *FIELDS]
        for pdf in batches:
            got = parse_records(pdf["record"].tolist(), pdf["format"].tolist())
            res = pd.DataFrame(got, columns=names)
            res.insert(0, "record_key", pdf["record_key"].to_numpy())
            res.insert(0, "source_table", pdf["source_table"].to_numpy())
            yield res

    return spread(records.select("source_table", "record_key", "record", "format")).mapInPandas(run, _SCHEMA)


def rejected(parsed: DataFrame) -> DataFrame:
    """The invalid records, each once."""
    return parsed.where(F.col("reason").isNotNull()).select("source_table", "record_key", "reason").distinct()


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid records, typed; an appended-twice record is one."""
    time: Column = F.col("created_at")
    return (
        parsed.where(F.col("reason").isNull())
        .dropDuplicates(["source_table", "record_key"])
        .select(
            "source_table", "record_key", "review_id", "product_id", F.col("rating").cast("int").alias("rating"), "review_text", "source",
            F.try_to_timestamp(time).alias("created_at"), F.try_to_timestamp(F.col("updated_at")).alias("updated_at"), F.col("schema_version").cast("int").alias("schema_version"), "customer_id_hash",
        )
    )
