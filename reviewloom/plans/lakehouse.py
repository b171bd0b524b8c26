"""The lakehouse's own operators as queries over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import quality
from reviewloom.functions import contract, sentiment
from reviewloom.functions.hashing import contract_fingerprint, raw_hash
from reviewloom.operators import marts, state
from reviewloom.session import table
from reviewloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- inputs ---------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str, rejected: bool = True) -> DataFrame:
    """Broker-shaped records: every delivery of bronze and, if wanted, the JSON payloads of quarantine."""
    bronze = table(spark, sf_dir, "bronze_feedback_events").select(F.col("payload_json").alias("value"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("ingested_at").alias("timestamp"))
    if not rejected:
        return bronze
    held = table(spark, sf_dir, "quarantine_feedback_events").where("payload_format = 'json'")
    return bronze.unionByName(held.select(F.col("payload_json").alias("value"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("quarantined_at").alias("timestamp")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct valid events of bronze in arrival order (arrived, seq), with their effective version."""
    bronze = table(spark, sf_dir, "bronze_feedback_events").where(F.col("payload_json").isNotNull()).select(raw_hash(F.col("payload_json")).alias("event_hash"), "ingested_at", "delivery_id", "payload_json")
    first = state.first_by(bronze, "event_hash", ["ingested_at", "delivery_id"], ["payload_json"])
    parsed = contract.parse_events(first.select(F.col("payload_json").alias("value"), F.lit(0).alias("partition"), F.col("delivery_id").alias("offset"), F.col("ingested_at").alias("timestamp")))
    valid, _ = contract.split(parsed)
    return valid.select("event_hash", F.col("timestamp").alias("arrived"), F.col("offset").alias("seq"), "event.*").withColumn("version", F.coalesce("updated_at", "created_at"))


_RECORDS = "SELECT payload_json AS value, kafka_partition AS p, kafka_offset AS o, ingested_at AS ts FROM bronze_feedback_events"
_EVENTS = """
first_copy AS (SELECT * FROM (SELECT *, sha256(payload_json) AS h, row_number() OVER (PARTITION BY sha256(payload_json) ORDER BY ingested_at, delivery_id) AS n
  FROM bronze_feedback_events WHERE payload_json IS NOT NULL) WHERE n = 1),
ev AS (SELECT h AS event_hash, ingested_at AS arrived, delivery_id AS seq, payload_json ->> '$.review_id' AS review_id, payload_json ->> '$.product_id' AS product_id,
  CAST(payload_json ->> '$.rating' AS INT) AS rating, payload_json ->> '$.review_text' AS review_text, payload_json ->> '$.source' AS source,
  CAST(payload_json ->> '$.created_at' AS TIMESTAMPTZ) AS created_at, CAST(payload_json ->> '$.updated_at' AS TIMESTAMPTZ) AS updated_at,
  coalesce(CAST(payload_json ->> '$.updated_at' AS TIMESTAMPTZ), CAST(payload_json ->> '$.created_at' AS TIMESTAMPTZ)) AS version,
  CAST(payload_json ->> '$.schema_version' AS INT) AS schema_version, payload_json ->> '$.customer_id_hash' AS customer_id_hash FROM first_copy)
"""

# -- parsing and validation -----------------------------------------------------------------------


@query(f"""SELECT sha256(value) AS event_hash, p AS "partition", o AS "offset", value ->> '$.review_id' AS review_id, value ->> '$.product_id' AS product_id, CAST(value ->> '$.rating' AS INT) AS rating,
  value ->> '$.source' AS source, epoch_us(CAST(value ->> '$.created_at' AS TIMESTAMPTZ)) AS created_us FROM ({_RECORDS})""")
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = contract.parse_events(records(spark, sf_dir, rejected=False))
    return p.select("event_hash", "partition", "offset", "event.review_id", "event.product_id", "event.rating", "event.source", F.unix_micros("event.created_at").alias("created_us"))


@query()
def validation_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = contract.parse_events(records(spark, sf_dir))
    return p.select("event_hash", "partition", "offset", contract.lenient_reason().alias("error_reason"))


@query(f"""SELECT 'invalid' AS stream, p AS "partition", count(*) AS n FROM ({_RECORDS}) WHERE value IS NULL GROUP BY 2
  UNION ALL SELECT 'valid', p, count(*) FROM ({_RECORDS}) WHERE value IS NOT NULL GROUP BY 2""")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, invalid = contract.split(contract.parse_events(records(spark, sf_dir, rejected=False)))
    both = valid.select(F.lit("valid").alias("stream"), "partition").unionByName(invalid.select(F.lit("invalid").alias("stream"), "partition"))
    return both.groupBy("stream", "partition").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS input, count(payload_json) AS valid, count(*) - count(payload_json) AS invalid, true AS reconciled FROM bronze_feedback_events")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = contract.parse_events(records(spark, sf_dir, rejected=False)).select(contract.lenient_reason().alias("r"))
    n = p.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("r").isNull()).alias("valid"), F.count_if(F.col("r").isNotNull()).alias("invalid"))
    return n.withColumn("reconciled", F.col("valid") + F.col("invalid") == F.col("input"))


@query()
def contract_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(raw_hash(F.col("value")).alias("event_hash"), "partition", "offset", contract.strict_reason(F.col("value")).alias("reason"))


@query()
def contract_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = contract.split(contract.parse_events(records(spark, sf_dir, rejected=False)))
    return valid.select("event_hash", contract_fingerprint(F.col("event")).alias("fingerprint")).distinct()


@query("""SELECT error_reason, payload_format, count(*) AS rows_held, count(DISTINCT kafka_partition || ':' || kafka_offset) AS payloads FROM quarantine_feedback_events GROUP BY 1, 2""")
def quarantine_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "quarantine_feedback_events")
    return held.groupBy("error_reason", "payload_format").agg(F.count(F.lit(1)).alias("rows_held"), F.count_distinct("kafka_partition", "kafka_offset").alias("payloads"))


# -- state ----------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT h AS event_hash, delivery_id, epoch_us(ingested_at) AS ingested_us FROM first_copy")
def bronze_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bronze_feedback_events").where(F.col("payload_json").isNotNull()).select(raw_hash(F.col("payload_json")).alias("event_hash"), "ingested_at", "delivery_id")
    return state.first_by(b, "event_hash", ["ingested_at", "delivery_id"], []).select("event_hash", "delivery_id", F.unix_micros("ingested_at").alias("ingested_us"))


@query("SELECT kafka_partition, count(*) AS deliveries, count(DISTINCT sha256(payload_json)) AS events FROM bronze_feedback_events WHERE payload_json IS NOT NULL GROUP BY 1")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bronze_feedback_events").where(F.col("payload_json").isNotNull()).select("kafka_partition", raw_hash(F.col("payload_json")).alias("event_hash"))
    unique = b.dropDuplicates(["kafka_partition", "event_hash"])  # the stream's operator, over a bounded table
    n = b.groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("deliveries"))
    return n.join(unique.groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("events")), "kafka_partition")


@query(f"""WITH {_EVENTS}, processed AS (SELECT event_hash FROM silver_feedback)
  SELECT event_hash, review_id, seq FROM ev WHERE event_hash NOT IN (SELECT event_hash FROM processed WHERE event_hash IS NOT NULL)""")
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending(events(spark, sf_dir), table(spark, sf_dir, "silver_feedback")).select("event_hash", "review_id", "seq")


_STALE = f"""{_EVENTS}, st AS (SELECT *, coalesce(max(version) OVER (PARTITION BY review_id ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > version, false) AS is_stale FROM ev)"""


@query(f"WITH {_STALE} SELECT event_hash, review_id, CASE WHEN is_stale THEN 'stale_update' ELSE 'accepted' END AS outcome FROM st")
def stale_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state.with_stale(events(spark, sf_dir), None, "review_id", "version", ["arrived", "seq"])
    return e.select("event_hash", "review_id", F.when(F.col("is_stale"), "stale_update").otherwise("accepted").alias("outcome"))


@query(f"WITH {_STALE} SELECT CASE WHEN is_stale THEN 'stale_update' ELSE 'accepted' END AS outcome, count(*) AS n FROM st GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_LATE = f"""{_STALE}, acc AS (SELECT * FROM st WHERE NOT is_stale),
lt AS (SELECT *, coalesce(created_at < max(created_at) OVER (ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 24 HOUR, false) AS is_late FROM acc)"""


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state.with_stale(events(spark, sf_dir), None, "review_id", "version", ["arrived", "seq"]).where(~F.col("is_stale")).drop("is_stale")
    return state.with_late_vs_running_max(e, "created_at", "arrived", ["arrived", "seq"])


@query(f"WITH {_LATE} SELECT event_hash, review_id, is_late FROM lt")
def late_vs_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).select("event_hash", "review_id", "is_late")


@query("""SELECT delivery_id, CAST(payload_json ->> '$.created_at' AS TIMESTAMPTZ) < ingested_at - INTERVAL 24 HOUR AS is_late FROM bronze_feedback_events WHERE payload_json IS NOT NULL""")
def late_vs_broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bronze_feedback_events").where(F.col("payload_json").isNotNull()).select(F.col("payload_json").alias("value"), F.col("kafka_partition").alias("partition"), F.col("delivery_id").alias("offset"), F.col("ingested_at").alias("timestamp"))
    valid, _ = contract.split(contract.parse_events(b))
    late = state.with_late_vs_broker(valid.select("offset", "timestamp", "event.created_at"))
    return late.select(F.col("offset").alias("delivery_id"), "is_late")


_LATEST = f"{_EVENTS}, top AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY version DESC, seq DESC) AS n FROM ev)"


@query(f"WITH {_LATEST} SELECT review_id, event_hash, product_id, rating, source, epoch_us(version) AS version_us FROM top WHERE n = 1")
def latest_per_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("review_id", "event_hash", "product_id", "rating", "source", "version", "seq")
    return state.latest_per_key(e, "review_id", ["version", "seq"]).select("review_id", "event_hash", "product_id", "rating", "source", F.unix_micros("version").alias("version_us"))


@query("""WITH u AS (SELECT review_id, updated_at AS v, 0 AS src, event_hash AS tie, event_hash, rating FROM stg_feedback UNION ALL SELECT review_id, updated_at, 1, event_hash, event_hash, rating FROM silver_feedback),
  t AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY v DESC, src DESC, tie DESC) AS n FROM u)
  SELECT review_id, event_hash, rating, epoch_us(v) AS updated_us FROM t WHERE n = 1""")
def silver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["review_id", "updated_at", "event_hash", "rating"]
    merged = state.merge_newest(table(spark, sf_dir, "stg_feedback").select(cols), table(spark, sf_dir, "silver_feedback").select(cols), "review_id", "updated_at", "event_hash")
    return merged.select("review_id", "event_hash", "rating", F.unix_micros("updated_at").alias("updated_us"))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_per_key(_accepted(spark, sf_dir), "review_id", ["version", "arrived", "seq"])


_SILVER = f"{_LATE}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY version DESC, arrived DESC, seq DESC) AS n FROM lt) WHERE n = 1)"


@query(f"WITH {_SILVER} SELECT review_id, product_id, rating, source, event_hash, is_late, epoch_us(version) AS version_us FROM s")
def silver_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).select("review_id", "product_id", "rating", "source", "event_hash", "is_late", F.unix_micros("version").alias("version_us"))


# -- sentiment ------------------------------------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ALIASES = " UNION ALL ".join(f"SELECT '{a}' AS aspect, {_list([w + e for w in ws for e in sentiment.ENDINGS])} AS forms" for a, ws in sentiment.ASPECTS.items())


def _scored(source: str) -> str:
    """SQL of the scorer over (k, review_text)."""
    return f"""
aliases AS ({_ALIASES}),
cl AS (SELECT k, i AS pos, regexp_replace(regexp_replace(c, '^\\s+', ''), '\\s+$', '') AS clause FROM (SELECT k, unnest(parts) AS c, unnest(range(len(parts))) AS i
  FROM (SELECT k, regexp_split_to_array(coalesce(review_text, ''), '(?i)[.!?;]|\\bbut\\b|\\bhowever\\b') AS parts FROM {source}))),
tk AS (SELECT k, pos, clause, regexp_extract_all(lower(clause), '[a-z'']+') AS tokens FROM cl WHERE clause <> ''),
cn AS (SELECT *, len(list_filter(tokens, lambda t: list_contains({_list(sentiment.POSITIVE)}, t))) AS p, len(list_filter(tokens, lambda t: list_contains({_list(sentiment.NEGATIVE)}, t))) AS m FROM tk),
sc AS (SELECT *, round_even(CAST(p - m AS DOUBLE) / greatest(p + m, 1), 4) AS score FROM cn),
mt AS (SELECT k, pos, clause, score, aspect FROM sc JOIN aliases ON list_has_any(tokens, forms)),
bs AS (SELECT k, aspect, score, clause FROM (SELECT *, row_number() OVER (PARTITION BY k, aspect ORDER BY abs(score) DESC, pos) AS n FROM mt) WHERE n = 1),
lb AS (SELECT k, aspect, score AS sentiment_score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label, clause AS evidence FROM bs)"""


_REVIEWS = "rv AS (SELECT DISTINCT review_id AS k, review_text FROM silver_feedback)"


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "silver_feedback").select("review_id", "review_text").dropDuplicates(["review_id", "review_text"])


@query(f"WITH {_REVIEWS}, {_scored('rv')} SELECT k AS review_id, pos, aspect, score AS sentiment_score, clause AS evidence FROM mt")
def sentiment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sentiment.mentions(_reviews(spark, sf_dir), "review_text", ["review_id"])
    return m.select("review_id", F.col("pos").cast("long").alias("pos"), "aspect", F.col("score").alias("sentiment_score"), F.col("clause").alias("evidence"))


@query(f"WITH {_REVIEWS}, {_scored('rv')} SELECT k AS review_id, aspect, sentiment_score, sentiment_label, evidence FROM lb")
def aspect_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.best_per_aspect(_reviews(spark, sf_dir), "review_text", ["review_id"])


@query(f"""WITH {_REVIEWS}, {_scored('rv')}, g AS (SELECT k, string_agg(aspect || '=' || sentiment_label, ',' ORDER BY aspect) AS aspects, count(*) AS n FROM lb GROUP BY k)
  SELECT rv.k AS review_id, coalesce(g.aspects, '') AS aspects, coalesce(g.n, 0) AS n FROM rv LEFT JOIN g USING (k)""")
def aspect_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _reviews(spark, sf_dir).select("review_id", sentiment.aspect_array(F.col("review_text")).alias("a"))
    return a.select("review_id", F.array_join(F.transform("a", lambda x: F.concat(x["aspect"], F.lit("="), x["sentiment_label"])), ",").alias("aspects"), F.size("a").cast("long").alias("n"))


@query(f"""WITH {_REVIEWS}, {_scored('rv')} SELECT k AS review_id, s.product_id, epoch_us(s.created_at) AS created_us, aspect, sentiment_score, sentiment_label FROM lb
  JOIN (SELECT DISTINCT review_id, product_id, created_at FROM silver_feedback) s ON s.review_id = lb.k""")
def aspect_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "silver_feedback").dropDuplicates(["review_id", "event_hash"])
    e = s.select("review_id", "product_id", "created_at", F.explode(sentiment.aspect_array(F.col("review_text"))).alias("x"))
    return e.select("review_id", "product_id", F.unix_micros("created_at").alias("created_us"), "x.aspect", "x.sentiment_score", "x.sentiment_label")


@query(f"""WITH {_SILVER}, rv AS (SELECT review_id AS k, review_text FROM s), {_scored('rv')},
  old AS (SELECT review_id, aspect, sentiment_score FROM aspect_sentiment WHERE review_id IS NOT NULL)
  SELECT review_id, aspect, sentiment_score FROM old WHERE review_id NOT IN (SELECT review_id FROM s) UNION ALL SELECT k, aspect, sentiment_score FROM lb""")
def aspect_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = _silver(spark, sf_dir)
    fresh = sentiment.best_per_aspect(silver, "review_text", ["review_id"]).select("review_id", "aspect", "sentiment_score")
    old = table(spark, sf_dir, "aspect_sentiment").where(F.col("review_id").isNotNull()).select("review_id", "aspect", "sentiment_score")
    return state.replace_children(old, silver, fresh, "review_id")


# -- marts ----------------------------------------------------------------------------------------


@query("""SELECT review_id, product_id, rating, source, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS event_date, schema_version, customer_id_hash, event_hash, is_late FROM silver_feedback""")
def stg_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.staging(table(spark, sf_dir, "silver_feedback")).select("review_id", "product_id", "rating", "source", "event_date", "schema_version", "customer_id_hash", "event_hash", "is_late")


_DAILY = """count(*) AS review_count, round(avg(rating), 2) AS average_rating,
  round(100.0::DOUBLE * CAST(sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS negative_review_pct, CAST(sum(CASE WHEN is_late THEN 1 ELSE 0 END) AS BIGINT) AS late_event_count"""


@query(f"SELECT CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS event_date, product_id, source, {_DAILY} FROM silver_feedback GROUP BY 1, 2, 3")
def product_health_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.product_health(marts.staging(table(spark, sf_dir, "silver_feedback")))


_ASPECTS_DAILY = """SELECT CAST(f.created_at AT TIME ZONE 'UTC' AS DATE) AS event_date, f.product_id, a.aspect, count(*) AS mention_count, round(avg(a.sentiment_score), 4) AS average_sentiment,
  CAST(sum(CASE WHEN a.sentiment_label = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative_mentions FROM aspect_sentiment a JOIN silver_feedback f USING (review_id) GROUP BY 1, 2, 3"""


@query(_ASPECTS_DAILY)
def aspect_health_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.aspect_health(table(spark, sf_dir, "aspect_sentiment"), table(spark, sf_dir, "silver_feedback"))


@query(f"SELECT aspect, round(avg(average_sentiment), 6) AS average_sentiment FROM ({_ASPECTS_DAILY}) GROUP BY 1")
def aspect_mean_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aspect_health_daily(spark, sf_dir).groupBy("aspect").agg(F.round(F.avg("average_sentiment"), 6).alias("average_sentiment"))


@query("""SELECT a.review_id, f.product_id, f.event_date, a.aspect, a.sentiment_score, a.sentiment_label, a.evidence FROM aspect_sentiment a JOIN stg_feedback f USING (review_id)""")
def fct_aspect_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.fact_aspects(table(spark, sf_dir, "aspect_sentiment"), table(spark, sf_dir, "stg_feedback")).drop("processed_at")


@query("""WITH w AS (SELECT coalesce(max(updated_at), TIMESTAMPTZ '1900-01-01 00:00:00+00') AS m FROM stg_feedback WHERE created_at < TIMESTAMPTZ '2026-05-01 00:00:00+00'),
  old AS (SELECT review_id, event_hash, rating FROM stg_feedback WHERE created_at < TIMESTAMPTZ '2026-05-01 00:00:00+00'),
  new AS (SELECT review_id, event_hash, rating FROM stg_feedback, w WHERE updated_at >= m)
  SELECT * FROM old WHERE review_id NOT IN (SELECT review_id FROM new) UNION ALL SELECT * FROM new""")
def fct_feedback_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load into a fact that so far holds the reviews created before May."""
    stg = table(spark, sf_dir, "stg_feedback").select("review_id", "event_hash", "rating", "created_at", "updated_at")
    loaded = stg.where(F.col("created_at") < F.expr("timestamp'2026-05-01 00:00:00'"))
    return state.incremental(loaded, stg, "review_id", "updated_at").select("review_id", "event_hash", "rating")


# -- quality and reports --------------------------------------------------------------------------


@query("SELECT count(*) = count(DISTINCT review_id) AS ok, count(*) - count(DISTINCT review_id) AS surplus FROM silver_feedback")
def unique_review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.uniqueness(table(spark, sf_dir, "silver_feedback"), "review_id")


@query("SELECT count(*) = 0 AS ok, count(*) AS violations FROM silver_feedback WHERE rating NOT BETWEEN 1 AND 5")
def ratings_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.none_of(table(spark, sf_dir, "silver_feedback"), ~F.col("rating").between(1, 5))


@query("SELECT a.review_id, a.aspect FROM aspect_sentiment a WHERE NOT EXISTS (SELECT 1 FROM silver_feedback f WHERE f.review_id = a.review_id)")
def orphan_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(table(spark, sf_dir, "aspect_sentiment"), table(spark, sf_dir, "silver_feedback"), "review_id").select("review_id", "aspect")


@query("""SELECT (SELECT count(*) = count(DISTINCT review_id) FROM silver_feedback) AS unique_review_ids, (SELECT count(*) = 0 FROM silver_feedback WHERE rating NOT BETWEEN 1 AND 5) AS ratings_in_range,
  (SELECT count(*) = 0 FROM aspect_sentiment a WHERE NOT EXISTS (SELECT 1 FROM silver_feedback f WHERE f.review_id = a.review_id)) AS no_orphan_aspects,
  (SELECT count(*) = 0 FROM bronze_feedback_events b WHERE payload_json IS NOT NULL AND NOT EXISTS (SELECT 1 FROM silver_feedback f WHERE f.event_hash = sha256(b.payload_json))) AS all_bronze_processed""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = table(spark, sf_dir, "bronze_feedback_events").where(F.col("payload_json").isNotNull()).select(raw_hash(F.col("payload_json")).alias("event_hash"))
    silver = table(spark, sf_dir, "silver_feedback")
    return quality.checks(silver, table(spark, sf_dir, "aspect_sentiment"), bronze, silver)


_NN = [("silver_feedback", "review_id"), ("silver_feedback", "product_id"), ("silver_feedback", "rating"), ("aspect_sentiment", "review_id"), ("aspect_sentiment", "aspect"), ("aspect_sentiment", "product_id"), ("stg_feedback", "review_id"), ("stg_feedback", "product_id"), ("stg_feedback", "event_date")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS violations FROM {t} WHERE {c} IS NULL" for t, c in _NN))
def dbt_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null({t: (table(spark, sf_dir, t), [c for u, c in _NN if u == t]) for t in dict.fromkeys(t for t, _ in _NN)})


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, review_id AS value, count(*) AS n FROM {t} WHERE review_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1" for t in ("silver_feedback", "stg_feedback")))
def dbt_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique({t: table(spark, sf_dir, t) for t in ("silver_feedback", "stg_feedback")}, "review_id")


@query("SELECT CAST(kafka_partition AS INT) AS value, count(*) AS n FROM feedback_changes WHERE kafka_partition NOT IN (0, 1, 2) GROUP BY 1")
def dbt_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted_values(table(spark, sf_dir, "feedback_changes"), "kafka_partition", [0, 1, 2])


_COUNTED = {"files": "(SELECT DISTINCT file_name FROM raw_feedback_records)", "bronze_events": "bronze_feedback_events", "silver_feedback": "silver_feedback", "aspect_rows": "aspect_sentiment", "quarantined_events": "quarantine_feedback_events", "late_events": "silver_feedback WHERE is_late"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in _COUNTED.items()))
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {
        "files": table(spark, sf_dir, "raw_feedback_records").select("file_name").distinct(), "bronze_events": table(spark, sf_dir, "bronze_feedback_events"), "silver_feedback": table(spark, sf_dir, "silver_feedback"),
        "aspect_rows": table(spark, sf_dir, "aspect_sentiment"), "quarantined_events": table(spark, sf_dir, "quarantine_feedback_events"), "late_events": table(spark, sf_dir, "silver_feedback").where("is_late"),
    }
    return quality.counts(frames)


@query("""SELECT (SELECT count(*) FROM bronze_feedback_events) AS bronze, (SELECT count(*) FROM silver_feedback) AS silver, (SELECT count(*) FROM quarantine_feedback_events) AS quarantined,
  (SELECT count(*) FROM silver_feedback WHERE is_late) AS late""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("bronze_feedback_events", "silver_feedback", "quarantine_feedback_events"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"_{t}")
    return spark.sql("""SELECT (SELECT count(*) FROM _bronze_feedback_events) AS bronze, (SELECT count(*) FROM _silver_feedback) AS silver,
      (SELECT count(*) FROM _quarantine_feedback_events) AS quarantined, (SELECT count(*) FROM _silver_feedback WHERE is_late) AS late""")


# -- sources --------------------------------------------------------------------------------------


@query("SELECT record_id, sha256(raw_record) AS line_hash FROM raw_feedback_records WHERE record_format = 'jsonl' AND NOT contains(raw_record, chr(10)) AND NOT contains(raw_record, chr(13))")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rescan_jsonl(table(spark, sf_dir, "raw_feedback_records"))


_CELL = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'
_AT = "regexp_extract(raw_record, '^" + "(" + _CELL + ")" + f"(?:,({_CELL}))" * 4 + ".*$', {n}, 's')"


def _cell(n: int, name: str) -> str:
    raw = _AT.format(n=n)
    return f"nullif(CASE WHEN starts_with({raw}, '\"') THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END, '') AS {name}"


@query(f"""SELECT record_id, {_cell(1, "review_id")}, {_cell(2, "product_id")}, {_cell(4, "review_text")}, {_cell(5, "source")} FROM raw_feedback_records
  WHERE record_format = 'csv' AND regexp_full_match(raw_record, '{_CELL}(?:,{_CELL}){{8}}')""")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rescan_csv(table(spark, sf_dir, "raw_feedback_records"))


@query("SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = files.rescan_json(table(spark, sf_dir, "part"), "p_brand", ["p_partkey", "p_size"])
    return back.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size").cast("long")).alias("total"))


@query("""WITH lines AS (SELECT file_name, record_format, line_number, regexp_replace(raw_record, '[\\r\\n]+', ' ', 'g') AS v FROM raw_feedback_records),
  f AS (SELECT file_name, sha256(string_agg(v || chr(10), '' ORDER BY line_number)) AS file_hash, max(CASE WHEN record_format = 'jsonl' THEN 1 ELSE 0 END) AS seen FROM lines GROUP BY 1)
  SELECT file_name, file_hash FROM f WHERE seen = 0 AND file_hash NOT IN (SELECT file_hash FROM f WHERE seen = 1)""")
def file_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fresh = files.rescan_files(table(spark, sf_dir, "raw_feedback_records"))
    return fresh.select("file_name", "file_hash")
