"""References to records that do not exist: bitmaps per key range and period.

Keys of both sides are hashed into key ranges; only distinct references and
distinct parents move, one shuffle each. Inside a range

* keys are dictionary-encoded as dense integers;
* references get one compressed bitmap per period in which they were made, and
  parents one per period in which they appeared, or-ed in order of time;
* ``references AND NOT parents known by then`` leaves the candidates of each
  period, which alone are decoded and, within one period, compared exactly.

Reasons: ``later`` if the parent exists but every row of it appeared after the
reference was made; ``deleted`` if there is none and the key is known as
deleted; else ``missing``.

Defined cases: keys are compared in lower case without surrounding white space
of any kind; null and blank keys are no references; a reference without a time
can't be ``later``; a parent without a time has been there for ever; repeated
references are one; a hot key costs one row per distinct reference and map task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.bitmaps import Bitmap
from reviewloom.functions.text import key_form
from reviewloom.session import shuffle_width

DAY_US = 86_400_000_000
NEVER = np.iinfo(np.int64).max
ALWAYS = np.iinfo(np.int64).min
#: Key ranges per shuffle partition; keeps one range within a Python worker's memory.
RANGES_PER_PARTITION = 4
_OUT = "key string, part string, period date, rows long, reason string"


def _range(ranges: int):
    return F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("range")


def references(child: DataFrame, key: str, part: str | None, made: str | None, period: str) -> DataFrame:
    """Distinct references (key, part, period, earliest time made, rows), combined map-side."""
    time = F.unix_micros(made) if made else F.lit(None).cast("long")
    return (
        child.select(key_form(F.col(key)).alias("key"), (F.col(part) if part else F.lit("")).alias("part"), F.to_date(period).alias("period"), time.alias("made"))
        .where("key is not null")
        .groupBy("key", "part", "period")
        .agg(F.min("made").alias("made"), F.count(F.lit(1)).alias("rows"))
    )


def parents(parent: DataFrame, key: str, appeared: str | None) -> DataFrame:
    """Distinct parent keys with the time at which the first row appeared."""
    time = F.coalesce(F.unix_micros(appeared), F.lit(ALWAYS)) if appeared else F.lit(ALWAYS)
    return parent.select(key_form(F.col(key)).alias("key"), time.alias("first")).where("key is not null").groupBy("key").agg(F.min("first").alias("first"))


def orphans_in_range(refs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The orphans of one key range. ``known``: key, first (null for a deleted key without parent)."""
    n = len(refs)
    if not n:
        return pd.DataFrame([], columns=["key", "part", "period", "rows", "reason"])
    codes, dictionary = pd.factorize(np.concatenate([refs["key"].to_numpy(object), known["key"].to_numpy(object)]))
    child, parent = codes[:n], codes[n:]
    is_parent = known["first"].notna().to_numpy()
    first = np.full(len(dictionary), NEVER, np.int64)
    first[parent[is_parent]] = known["first"].to_numpy()[is_parent].astype(np.int64)
    deleted = Bitmap.of(parent[~is_parent])

    made = pd.to_numeric(refs["made"]).astype("float64").to_numpy()  # microseconds are exact below 2**53
    untimed = np.isnan(made)
    made = np.where(untimed, 0, made).astype(np.int64)
    made[untimed] = NEVER - 1  # without a time: after all parents
    made_day = np.floor_divide(made, DAY_US)
    first_day = np.floor_divide(first[parent[is_parent]], DAY_US)
    ids = parent[is_parent]
    order = np.argsort(first_day, kind="stable")
    ids, first_day = ids[order], first_day[order]

    left = np.zeros(n, bool)
    seen, at = Bitmap(), 0
    for day in np.unique(made_day):
        upto = int(np.searchsorted(first_day, day, side="left"))  # parents of earlier periods
        seen, at = seen | Bitmap.of(ids[at:upto]), upto
        rows = np.flatnonzero(made_day == day)
        survivors = Bitmap.of(child[rows]).and_not(seen).decode()
        left[rows[np.isin(child[rows], survivors)]] = True
    left &= first[child] > made  # exact, for parents of the same period
    at_rows = np.flatnonzero(left)
    none = first[child[at_rows]] == NEVER
    gone = np.isin(child[at_rows], deleted.decode())
    reason = np.where(~none, "later", np.where(gone, "deleted", "missing"))
    out = pd.DataFrame({c: refs[c].to_numpy(object)[at_rows] for c in ("key", "part", "period", "rows")})
    out["reason"] = reason
    return out


def find_orphans(refs: DataFrame, known: DataFrame, deleted: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Orphan references (key, part, period, rows, reason).

    ``refs`` from :func:`references`, ``known`` from :func:`parents`, ``deleted``
    a frame with ``key``.
    """
    ranges = ranges or RANGES_PER_PARTITION * shuffle_width(refs.sparkSession)
    if deleted is not None:
        known = known.unionByName(deleted.select("key", F.lit(None).cast("long").alias("first")))
    left = refs.select(_range(ranges), "key", "part", "period", "made", "rows").groupBy("range")
    right = known.select(_range(ranges), "key", "first").groupBy("range")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return orphans_in_range(a, b)

    return left.cogroup(right).applyInPandas(run, _OUT)


def per_table_and_period(found: dict[str, DataFrame]) -> DataFrame:
    """The report: references and their rows per child table, reason and day."""
    parts = [df.select(F.lit(name).alias("child_table"), "reason", "period", "rows") for name, df in found.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("child_table", "reason", "period").agg(F.count(F.lit(1)).alias("orphan_references"), F.sum("rows").alias("orphan_rows"))

