"""Staging view, facts and daily aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGED = ["review_id", "product_id", "rating", "review_text", "source", "event_date", "created_at", "updated_at", "schema_version", "customer_id_hash", "event_hash", "is_late", "processed_at"]


def staging(silver: DataFrame) -> DataFrame:
    """The columns of the current reviews and their UTC day."""
    return silver.withColumn("event_date", F.to_date("created_at")).select(STAGED)


def product_health(staged: DataFrame) -> DataFrame:
    """Per day, product and source: reviews, mean rating, share of bad ratings, late events."""
    return staged.groupBy("event_date", "product_id", "source").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
        F.round(F.lit(100.0) * F.sum(F.when(F.col("rating") <= 2, 1).otherwise(0)) / F.count(F.lit(1)), 2).alias("negative_review_pct"),
        F.sum(F.when(F.col("is_late"), 1).otherwise(0)).alias("late_event_count"),
    )


def aspect_health(aspects: DataFrame, silver: DataFrame) -> DataFrame:
    """Per day, product and aspect: mentions, mean score, negative mentions."""
    a, f = aspects.select("review_id", "aspect", "sentiment_score", "sentiment_label"), silver.select("review_id", "product_id", F.to_date("created_at").alias("event_date"))
    return (
        a.join(f, "review_id")
        .groupBy("event_date", "product_id", "aspect")
        .agg(F.count(F.lit(1)).alias("mention_count"), F.round(F.avg("sentiment_score"), 4).alias("average_sentiment"), F.sum(F.when(F.col("sentiment_label") == "negative", 1).otherwise(0)).alias("negative_mentions"))
    )


def fact_aspects(aspects: DataFrame, staged: DataFrame) -> DataFrame:
    """Aspect rows with product and day of their review."""
    a = aspects.select("review_id", "aspect", "sentiment_score", "sentiment_label", "evidence", "processed_at")
    return a.join(staged.select("review_id", "product_id", "event_date"), "review_id").select("review_id", "product_id", "event_date", "aspect", "sentiment_score", "sentiment_label", "evidence", "processed_at")
