"""The event contract in two depths, as expressions that name the first failed rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.hashing import raw_hash
from reviewloom.functions.text import strip_unicode
from reviewloom.schemas import CORRUPT, CUSTOMER_MAX, EVENT, PARSED, RATING, TEXT_BOUNDS, VERSION


def parse_events(records: DataFrame) -> DataFrame:
    """Broker records (value, partition, offset, timestamp) with payload, hash and parsed event."""
    payload = F.col("value").cast("string")
    event = F.from_json(payload, PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (
        records.select(payload.alias("payload_json"), "partition", "offset", "timestamp", raw_hash(payload).alias("event_hash"), event.alias("event"))
        .withColumn("parse_error", F.col(f"event.{CORRUPT}"))
        .withColumn("event", F.col("event").dropFields(CORRUPT))
    )


def lenient_reason() -> Column:
    """Null for a valid parsed row, else the first failed rule; no rule is null-blind."""
    e = F.col("event")
    reason = F.when(e.isNull() | F.col("parse_error").isNotNull(), "payload is not valid JSON")
    for field in ("review_id", "product_id", "review_text", "source", "created_at"):
        reason = reason.when(e[field].isNull(), f"{field} is required")
    reason = reason.when(~F.coalesce(e["rating"].between(*RATING), F.lit(False)), "rating must be between 1 and 5")
    return reason.when(~F.coalesce(e["schema_version"] == VERSION, F.lit(False)), "unsupported schema_version")


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): every row is in exactly one of them."""
    checked = parsed.withColumn("error_reason", lenient_reason())
    return checked.where(F.col("error_reason").isNull()).drop("error_reason"), checked.where(F.col("error_reason").isNotNull())


_WHOLE = r"^\s*[+-]?\d+(?:\.0*)?\s*$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}:?\d{2})$"


def whole(text: Column) -> Column:
    """Lax whole number of a JSON scalar's text: 4, 4.0, "4", true; null if it is none."""
    return F.when(F.lower(text) == "true", 1).when(text.rlike(_WHOLE), text.try_cast("double").cast("long")).otherwise(F.when(text.rlike(r"^\d+e0$"), F.regexp_extract(text, r"^\d+", 0).try_cast("long")))


def instant(text: Column) -> Column:
    """An instant with zone: ISO text, or seconds since 1970; null if it is none."""
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(text)).when(text.rlike(r"^\d{1,11}(?:\.\d+)?$"), F.timestamp_seconds(text.try_cast("double")))


def stripped(text: Column) -> Column:
    return strip_unicode(text)


def strict_reason(payload: Column) -> Column:
    """The full contract over a JSON text: lengths after stripping, closed field list, zone, order of times.

    The text is parsed once; ``transform`` over an array of one binds the fields,
    so that no rule parses it again.
    """
    fields = F.from_json(payload, "map<string,string>")
    return F.transform(F.array(fields), _strict_reason_of).getItem(0)


def _strict_reason_of(fields: Column) -> Column:
    """The same over the fields (null if the text is no object), whose texts are bound once more after stripping."""
    text = F.transform(F.array(F.struct(*[strip_unicode(F.try_element_at(fields, F.lit(f))).alias(f) for f in EVENT.names])), lambda t: _strict_rules(fields, t))
    return text.getItem(0)


def _strict_rules(fields: Column, text: Column) -> Column:
    reason = F.when(fields.isNull(), "not_an_object")
    reason = reason.when(F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in EVENT.names]))) > 0, "unknown_field")
    for f, (low, high) in TEXT_BOUNDS.items():
        reason = reason.when(~F.coalesce(F.length(text[f]).between(low, high), F.lit(False)), f)
    reason = reason.when(~F.coalesce(whole(text["rating"]).between(*RATING), F.lit(False)), "rating")
    made, changed = instant(text["created_at"]), instant(text["updated_at"])
    reason = reason.when(made.isNull(), "created_at")
    reason = reason.when(text["updated_at"].isNotNull() & (changed.isNull() | (changed < made)), "updated_at")
    reason = reason.when(text["schema_version"].isNotNull() & ~F.coalesce(whole(text["schema_version"]) == VERSION, F.lit(False)), "schema_version")
    return reason.when(F.length(text["customer_id_hash"]) > CUSTOMER_MAX, "customer_id_hash")
