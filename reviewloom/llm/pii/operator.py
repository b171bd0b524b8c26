"""Find and replace personal information in a text column.

Texts are tagged by the trained model in Arrow batches, with no shuffle; the
weights (about 100 KB, fixed) travel with the task. After decoding, a span is
tidied (surrounding punctuation, a leading ``mailto:``) and dropped if it can't
be of its type, such as a phone number with fewer than seven digits.

Defined cases: null and empty texts have no mentions and come out unchanged;
texts of any length are tagged whole, by overlapping windows; equal texts of a
batch are tagged once; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.llm.pii.model import Tagger, tag_texts
from reviewloom.session import spread

MEMORY = 100_000  # texts of up to 500 characters that a task remembers
WEIGHTS = str(Path(__file__).with_name("tagger.npz"))
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_EDGE = " \t\n.,;:!?\"'“”<>{}[]"
_AT = re.compile(r"@|\bat\b|[\[(]at[\])]", re.I)


def tidy(text: str, span: tuple[int, int, str]) -> tuple[int, int, str] | None:
    """The span without what can't belong to it; None if it can't be of its type."""
    a, z, kind = span
    if kind == "email" and text[a:z].lower().startswith("mailto:"):
        a += 7
    while a < z and text[a] in _EDGE + ("" if kind == "phone" else "()"):
        a += 1
    while z > a and text[z - 1] in _EDGE + ("" if kind in ("phone", "email") else "()") and not (kind == "name" and text[z - 1] == "." and text[z - 2 : z - 1].isupper()):
        z -= 1
    part = text[a:z]
    digits = sum(c.isdigit() for c in part)
    if kind == "phone":
        while a < z and not (text[a].isdigit() or text[a] in "+("):
            a += 1
        fits = digits >= 7
    elif kind == "email":
        fits = len(part) >= 5 and _AT.search(part) is not None
    elif kind == "id_number":
        fits = digits >= 6
    elif kind == "address":
        fits = digits >= 1 and any(c.isalpha() for c in part)
    else:
        fits = digits == 0 and len(part) >= 3 and len(part.split()) >= 2
    return (a, z, kind) if fits and a < z else None


def find_all(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Tidied spans of each text; equal texts are tagged once."""
    known = {t: i for i, t in enumerate(dict.fromkeys(t for t in texts if isinstance(t, str) and t))}
    tagged = tag_texts(tagger, list(known))
    clean = [[s for raw in spans if (s := tidy(t, raw))] for t, spans in zip(known, tagged)]
    return [clean[known[t]] if isinstance(t, str) and t else [] for t in texts]


def replaced(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, z, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = z
    return "".join([*out, text[at:]])


MENTION = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())]))


def _finder(weights: str):
    with np.load(weights) as f:
        w = {k: f[k] for k in f.files}
    state: dict[str, object] = {}

    def find(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Spans of each text; a bounded memory of the task's texts saves tagging repeated ones."""
        tagger, seen = state.setdefault("t", Tagger(w)), state.setdefault("seen", {})
        fresh = [t for t in dict.fromkeys(texts) if isinstance(t, str) and t not in seen]
        found = dict(zip(fresh, find_all(tagger, fresh)))
        result = [(found[t] if t in found else seen[t]) if isinstance(t, str) else [] for t in texts]
        if len(seen) + len(found) > MEMORY:
            seen.clear()
        seen.update((t, s) for t, s in found.items() if len(t) <= 500)
        return result

    return find


def mentions(df: DataFrame, text: str, keys: list[str], weights: str = WEIGHTS) -> DataFrame:
    """One row per mention: the key columns, pii_type, start_at and end_at (characters from 1, end included)."""
    find = _finder(weights)
    rows = spread(df.select(*keys, F.col(text).alias("_text")))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"] + list(MENTION.elementType.fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = find(pdf["_text"].tolist())
            at = np.repeat(np.arange(len(pdf)), [len(x) for x in found])
            flat = [s for x in found for s in x]
            out = pd.DataFrame({k: pdf[k].to_numpy(object)[at] for k in keys})
            out["pii_type"] = np.array([s[2] for s in flat], object)
            out["start_at"] = np.array([s[0] + 1 for s in flat], np.int32)
            out["end_at"] = np.array([s[1] for s in flat], np.int32)
            yield out

    return rows.mapInPandas(run, schema)


def redact(df: DataFrame, text: str, out: str = "redacted", weights: str = WEIGHTS) -> DataFrame:
    """The rows with a column in which every mention is replaced by a placeholder of its type."""
    find = _finder(weights)

    @F.pandas_udf(T.StringType())
    def swap(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else None for t in texts]
        return pd.Series([replaced(t, s) for t, s in zip(values, find(values))], dtype=object)

    return df.withColumn(out, swap(F.col(text)))
