"""The general data problems as queries over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import change_replay, error_parse, late_counters, message_store, orphan_bitmaps
from reviewloom.session import cut_lineage, table


def _late(spark: SparkSession, sf_dir: str) -> late_counters.LateCounters:
    return late_counters.late_counters(table(spark, sf_dir, "silver_feedback"), table(spark, sf_dir, "bronze_feedback_events"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).late_dots().select("review_id", "outcome").distinct()


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).totals()


def p1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _late(spark, sf_dir).history()
    return h.withColumn("first_ingested_us", F.unix_micros("first_ingested_at")).drop("first_ingested_at")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_feedback_records").select(F.lit("raw_feedback_records").alias("source_table"), F.col("record_id").cast("string").alias("record_key"), F.col("raw_record").alias("record"), F.col("record_format").alias("format"))
    held = table(spark, sf_dir, "quarantine_feedback_events").select(
        F.lit("quarantine_feedback_events").alias("source_table"), F.concat_ws(":", F.coalesce("kafka_partition", F.lit(-1)), F.coalesce("kafka_offset", F.lit(-1))).alias("record_key"), F.col("payload_json").alias("record"), F.col("payload_format").alias("format")
    )
    return raw.unionByName(held)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_parse.rejected(error_parse.error_parse(_records(spark, sf_dir)))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_parse.loaded(error_parse.error_parse(_records(spark, sf_dir)))


BATCHES = 3


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bronze = table(spark, sf_dir, "bronze_feedback_events")
    store = message_store.MessageStore(spark)
    for part in range(BATCHES):  # the batches of three groups of consumers; a message may be in several
        store.upsert(bronze.where(F.pmod(F.coalesce("kafka_partition", F.lit(0)), F.lit(BATCHES)) == part))
    return bronze, store.compact()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_store.surplus_deliveries(*_compacted(spark, sf_dir))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze, kept = _compacted(spark, sf_dir)
    return message_store.one_copy_each(bronze.select("delivery_id", "kafka_partition", "kafka_offset"), kept)


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table is the whole feed, so what lies behind a gap of its offsets is applied too.
    return change_replay.replay(table(spark, sf_dir, "feedback_changes"), table(spark, sf_dir, "silver_feedback"), feed_complete=True).state


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).where("in_feed and not deleted").select("review_id", "event_hash")


def p5_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_replay.watermarks(table(spark, sf_dir, "feedback_changes")).withColumnRenamed("part", "kafka_partition")


def _orphans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    stg, silver = table(spark, sf_dir, "stg_feedback"), table(spark, sf_dir, "silver_feedback")
    deleted = _current(spark, sf_dir).where("deleted").select(F.col("review_id").alias("key"))
    aspect = orphan_bitmaps.find_orphans(
        orphan_bitmaps.references(table(spark, sf_dir, "aspect_sentiment"), "review_id", "aspect", "processed_at", "created_at"), orphan_bitmaps.parents(stg, "review_id", "processed_at"), deleted
    )
    staged = orphan_bitmaps.find_orphans(orphan_bitmaps.references(stg, "review_id", None, None, "created_at"), orphan_bitmaps.parents(silver, "review_id", None))
    return {"aspect_sentiment": aspect, "stg_feedback": staged}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("child_table"), F.col("key").alias("review_id"), F.col("part").alias("aspect"), "reason") for name, df in _orphans(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_bitmaps.per_table_and_period(_orphans(spark, sf_dir)).withColumnRenamed("period", "created_day")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_totals, p1_history, p2_found, p2_loaded, p3_found, p3_kept, p5_found, p5_watermarks, p6_found, p6_report)
}

_DOTS = """
first_seen AS (SELECT sha256(payload_json) AS h, min(ingested_at) AS f FROM bronze_feedback_events WHERE payload_json IS NOT NULL GROUP BY 1),
once AS (SELECT DISTINCT review_id, product_id, source, rating, created_at, event_hash FROM silver_feedback),
dots AS (SELECT o.*, f.f, CAST(o.created_at AT TIME ZONE 'UTC' AS DATE) AS period,
  CASE WHEN f.f > o.created_at + INTERVAL 168 HOUR THEN 'too_late' WHEN f.f > o.created_at + INTERVAL 24 HOUR THEN 'corrects' ELSE 'on_time' END AS outcome
  FROM once o JOIN first_seen f ON f.h = o.event_hash)
"""
_NORM = r"nullif(lower(regexp_replace({0}, '^[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{3000}}\x{{feff}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{3000}}\x{{feff}}]+$', '', 'g')), '')"
_STATE = """
changes AS (SELECT event_hash, min(review_id) AS review_id, min(coalesce(updated_at, created_at)) AS t, min(kafka_offset) AS pos,
  max(CASE WHEN lower(op) IN ('d', 'delete', 'tombstone') THEN 1 ELSE 0 END) AS gone FROM feedback_changes GROUP BY 1),
versions AS (SELECT review_id, t, 1 AS feed, pos, event_hash, gone FROM changes
  UNION ALL SELECT review_id, coalesce(updated_at, created_at), 0, -1, event_hash, 0 FROM silver_feedback),
ranked AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY t DESC, feed DESC, pos DESC) AS n, max(feed) OVER (PARTITION BY review_id) AS in_feed FROM versions),
state AS (SELECT * FROM ranked WHERE n = 1)
"""
_ORPHANS = f"""
{_STATE},
stg AS (SELECT {_NORM.format("review_id")} AS k, min(processed_at) AS first FROM stg_feedback GROUP BY 1),
asp AS (SELECT {_NORM.format("review_id")} AS k, aspect, created_at, processed_at FROM aspect_sentiment),
silver_keys AS (SELECT DISTINCT {_NORM.format("review_id")} AS k FROM silver_feedback),
orphans AS (
  SELECT 'aspect_sentiment' AS child_table, a.k AS review_id, a.aspect, CAST(a.created_at AT TIME ZONE 'UTC' AS DATE) AS created_day,
    CASE WHEN s.k IS NOT NULL THEN 'later' WHEN d.gone = 1 THEN 'deleted' ELSE 'missing' END AS reason,
    min(a.processed_at) AS m
  FROM asp a LEFT JOIN stg s ON s.k = a.k LEFT JOIN state d ON d.review_id = a.k
  WHERE a.k IS NOT NULL AND (s.k IS NULL OR s.first > a.processed_at) GROUP BY ALL
  UNION ALL
  SELECT 'stg_feedback', g.k, '', g.day, 'missing', NULL FROM (SELECT DISTINCT {_NORM.format("review_id")} AS k, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day FROM stg_feedback) g
  LEFT JOIN silver_keys s ON s.k = g.k WHERE g.k IS NOT NULL AND s.k IS NULL)
"""
_KEPT = "SELECT *, row_number() OVER (PARTITION BY sha256(payload_json) ORDER BY ingested_at, delivery_id) AS n FROM bronze_feedback_events WHERE payload_json IS NOT NULL"

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_DOTS} SELECT DISTINCT review_id, outcome FROM dots WHERE outcome <> 'on_time'",
    "p1_totals": f"""WITH {_DOTS} SELECT period, product_id, source, count(*) AS reviews, count(rating) AS rated, CAST(coalesce(sum(rating), 0) AS BIGINT) AS rating_sum,
      CAST(count(CASE WHEN outcome = 'corrects' THEN 1 END) AS BIGINT) AS late_reviews, round(CAST(sum(rating) AS DOUBLE) / count(rating), 4) AS mean_rating
      FROM dots WHERE outcome <> 'too_late' GROUP BY 1, 2, 3""",
    "p1_history": f"""WITH {_DOTS}, run AS (SELECT *, count(*) OVER w AS reviews, count(rating) OVER w AS rated, CAST(coalesce(sum(rating) OVER w, 0) AS BIGINT) AS rating_sum
      FROM dots WHERE outcome <> 'too_late' WINDOW w AS (PARTITION BY period, product_id, source ORDER BY f, review_id, event_hash ROWS UNBOUNDED PRECEDING))
      SELECT period, product_id, source, review_id, reviews, rated, rating_sum, CASE WHEN rated > 0 THEN round(CAST(rating_sum AS DOUBLE) / rated, 4) END AS mean_rating,
      epoch_us(f) AS first_ingested_us FROM run WHERE outcome = 'corrects'""",
    "p3_found": f"SELECT delivery_id FROM ({_KEPT}) WHERE n > 1",
    "p3_kept": f"SELECT delivery_id, kafka_partition, kafka_offset FROM ({_KEPT}) WHERE n = 1",
    "p5_found": f"WITH {_STATE} SELECT review_id, event_hash FROM state WHERE in_feed = 1 AND gone = 0",
    "p5_watermarks": """WITH o AS (SELECT DISTINCT kafka_partition, kafka_offset FROM feedback_changes),
      r AS (SELECT *, kafka_offset - row_number() OVER (PARTITION BY kafka_partition ORDER BY kafka_offset) AS run, min(kafka_offset) OVER (PARTITION BY kafka_partition) AS lo FROM o)
      SELECT kafka_partition, max(CASE WHEN run = lo - 1 THEN kafka_offset END) AS committed, max(kafka_offset) AS last_seen FROM r GROUP BY 1""",
    "p6_found": f"WITH {_ORPHANS} SELECT DISTINCT child_table, review_id, aspect, reason FROM orphans",
    "p6_report": f"""WITH {_ORPHANS}, rows_of AS (
      SELECT 'aspect_sentiment' AS child_table, {_NORM.format("review_id")} AS review_id, aspect, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS created_day, count(*) AS n FROM aspect_sentiment GROUP BY ALL
      UNION ALL SELECT 'stg_feedback', {_NORM.format("review_id")}, '', CAST(created_at AT TIME ZONE 'UTC' AS DATE), count(*) FROM stg_feedback GROUP BY ALL)
      SELECT child_table, reason, created_day, count(*) AS orphan_references, CAST(sum(n) AS BIGINT) AS orphan_rows
      FROM orphans JOIN rows_of USING (child_table, review_id, aspect, created_day) GROUP BY 1, 2, 3""",
}
