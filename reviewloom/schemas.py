"""Schemas of the feedback event and of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

EVENT = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("customer_id_hash", T.StringType()),
    ]
)
#: What is parsed: the event and, for a payload that isn't one, the payload.
PARSED = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
#: A record as it comes from a broker.
RECORD = T.StructType([T.StructField("value", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType())])

#: Bounds of the contract (fixed values).
TEXT_BOUNDS = {"review_id": (1, 100), "product_id": (1, 100), "review_text": (3, 20_000), "source": (1, 50)}
RATING = (1, 5)
CUSTOMER_MAX = 128
VERSION = 1


def contract_schema() -> dict:
    """The contract as a JSON Schema document."""
    text = {f: {"type": "string", "minLength": a, "maxLength": z} for f, (a, z) in TEXT_BOUNDS.items()}
    instant = {"type": "string", "format": "date-time"}
    return {
        "title": "FeedbackEvent",
        "type": "object",
        "additionalProperties": False,
        "required": [*TEXT_BOUNDS, "rating", "created_at"],
        "properties": text
        | {"rating": {"type": "integer", "minimum": RATING[0], "maximum": RATING[1]}, "created_at": instant, "updated_at": {"anyOf": [instant, {"type": "null"}]}, "schema_version": {"type": "integer", "const": VERSION, "default": VERSION}, "customer_id_hash": {"anyOf": [{"type": "string", "maxLength": CUSTOMER_MAX}, {"type": "null"}]}},
    }
