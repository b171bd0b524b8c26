"""Data-quality checks: each returns its verdict or the violating rows as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d"))
    return n.select((F.col("n") == F.col("d")).alias("ok"), (F.col("n") - F.col("d")).alias("surplus"))


def none_of(df: DataFrame, broken: Column) -> DataFrame:
    """Rows for which ``broken`` is true; null doesn't count."""
    return df.agg(F.count_if(broken).alias("violations")).select((F.col("violations") == 0).alias("ok"), "violations")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def checks(silver: DataFrame, aspects: DataFrame, bronze: DataFrame, processed: DataFrame) -> DataFrame:
    """The four invariants in one row."""
    verdicts = [
        uniqueness(silver, "review_id").select(F.col("ok").alias("unique_review_ids")),
        none_of(silver, ~F.col("rating").between(1, 5)).select(F.col("ok").alias("ratings_in_range")),
        orphans(aspects, silver, "review_id").agg((F.count(F.lit(1)) == 0).alias("no_orphan_aspects")),
        orphans(bronze, processed, "event_hash").agg((F.count(F.lit(1)) == 0).alias("all_bronze_processed")),
    ]
    joined = reduce(lambda a, b: a.join(b, "_one"), [v.withColumn("_one", F.lit(1)) for v in verdicts])  # one row each
    return joined.drop("_one")


def not_null(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Null counts per table and column; each table is scanned once."""
    parts = []
    for name, (df, columns) in tables.items():
        n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in columns]))
        parts.append(n.select(pairs.alias("p")).select(F.lit(name).alias("table_name"), "p.*"))
    return reduce(DataFrame.unionByName, parts)


def unique(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that occur more than once."""
    parts = [df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(t).alias("table_name"), "value", "n") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the list, with their counts; null is not judged."""
    return df.where(~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()])
