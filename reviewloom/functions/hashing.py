"""The three identities of an event.

``raw_hash`` is over the bytes as they came, ``canonical_hash`` over the JSON
with sorted keys and no white space, ``contract_fingerprint`` over the event's
own fields without nulls. A null payload has a null hash.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.schemas import EVENT


def raw_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("string"), 256)


def canonical_json(text: str | None) -> str | None:
    """Sorted, compact, ASCII JSON; null if the text is no JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def canonical_hash(payload: Column) -> Column:
    """SHA-256 of the canonical JSON; Arrow batches, as the JVM has no ASCII-escaped sorted form."""

    @F.pandas_udf(T.StringType())
    def digest(texts: pd.Series) -> pd.Series:
        canon = [canonical_json(t) if isinstance(t, str) else None for t in texts]
        return pd.Series([hashlib.sha256(c.encode()).hexdigest() if c is not None else None for c in canon], dtype=object)

    return digest(payload)


def contract_fingerprint(event: Column) -> Column:
    """SHA-256 over the event's fields in name order, nulls left out."""
    names = sorted(f.name for f in EVENT.fields)
    return F.sha2(F.to_json(F.struct(*[event[n].alias(n) for n in names])), 256)
