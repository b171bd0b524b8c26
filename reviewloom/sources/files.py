"""File sources: JSON lines, CSV with a header, JSON documents; file identity and the skip ledger."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.schemas import CORRUPT, EVENT
from reviewloom.session import fresh_path

DOCUMENT_END = "\x1e"  # the record separator of JSON text sequences
DOCUMENT_PARTS = 16  # documents for one key, so that none grows with a hot key alone
KINDS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".json": "json"}


def kind_of(path: str) -> str:
    """Reader of a path by its ending; ValueError for any other."""
    kind = KINDS.get(PurePosixPath(path).suffix.lower())
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    return kind


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """payload_json and line_number (physical, from 1) of every non-blank line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "payload_json"))
    return whole.where(F.trim("payload_json") != "").select("file_path", (F.col("pos") + 1).alias("line_number"), "payload_json")


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """All cells as text by the file's header; ragged records are marked in ``_corrupt_record``."""
    schema = ", ".join(f"{c} string" for c in [*columns, CORRUPT])
    return spark.read.csv(path, header=header, multiLine=True, escape='"', schema=schema, columnNameOfCorruptRecord=CORRUPT, mode="PERMISSIVE", enforceSchema=not header)


def read_json(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """payload_json of each element of an array document, or of the one object. A file is one document, or several that ``end`` separates."""
    text = (spark.read.text(path, lineSep=end) if end else spark.read.text(path, wholetext=True)).select(F.trim("value").alias("v"))
    array = F.from_json("v", "array<variant>")
    many = text.select(F.posexplode(F.when(F.col("v").startswith("["), array).otherwise(F.array(F.try_parse_json("v")))).alias("pos", "e"))
    return many.select((F.col("pos") + 1).alias("line_number"), F.to_json("e").alias("payload_json"))


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Records of one file as payload_json, by its ending."""
    kind = kind_of(path)
    if kind == "jsonl":
        return read_jsonl(spark, path).select("line_number", "payload_json")
    if kind == "json":
        return read_json(spark, path)
    rows = read_csv(spark, path, columns).withColumn("line_number", F.monotonically_increasing_id() + 2)
    return rows.select("line_number", F.coalesce(CORRUPT, F.to_json(F.struct(*columns))).alias("payload_json"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file_path, file_hash (SHA-256 of the bytes) and file_size."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"))


def unseen(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose content isn't in the ledger yet."""
    return found.join(ledger.select("file_hash").distinct(), "file_hash", "left_anti")


# -- the same sources over files derived from a table ---------------------------------------------


def rescan_jsonl(raw: DataFrame) -> DataFrame:
    """The one-line JSON records written as files and read back."""
    spark, path = raw.sparkSession, fresh_path(raw.sparkSession, "jsonl")
    lines = raw.where("record_format = 'jsonl'").where(~F.col("raw_record").rlike(r"[\r\n]"))
    lines.select(F.concat(F.col("record_id"), F.lit("\t"), F.col("raw_record")).alias("value")).write.text(path)
    read_back = read_jsonl(spark, path).select(F.split("payload_json", "\t", 2).alias("p"))
    return read_back.select(F.get("p", F.lit(0)).try_cast("long").alias("record_id"), F.sha2(F.get("p", F.lit(1)), 256).alias("line_hash"))


def rescan_csv(raw: DataFrame) -> DataFrame:
    """The CSV records with nine whole cells and no line break outside quotes, written as CSV files with a header and read back cell by cell."""
    spark, path = raw.sparkSession, fresh_path(raw.sparkSession, "csv")
    cell = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'
    good = raw.where("record_format = 'csv'").where(F.col("raw_record").rlike(f"^{cell}(?:,{cell}){{{len(EVENT.names) - 1}}}$"))
    good.select(F.concat_ws(",", F.col("record_id").cast("string"), "raw_record").alias("value")).repartitionByRange("record_id").write.text(path)
    read_back = read_csv(spark, path, ["record_id", *EVENT.names], header=False)
    return read_back.select(F.col("record_id").cast("long").alias("record_id"), "review_id", "product_id", "review_text", "source")


def rescan_json(df: DataFrame, key: str, numbers: list[str]) -> DataFrame:
    """Rows written as array documents, one per value of ``key``, and read back element by element."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "json")
    rows = df.select(key, F.to_json(F.struct(key, *numbers)).alias("j"))
    part = F.pmod(F.xxhash64("j"), F.lit(DOCUMENT_PARTS))
    documents = rows.groupBy(key, part.alias("_p")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    documents.select("value").write.text(path, lineSep=DOCUMENT_END)
    back = read_json(spark, path, DOCUMENT_END)
    return back.select(*[F.get_json_object("payload_json", f"$.{c}").alias(c) for c in (key, *numbers)])


def rescan_files(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of the drop's files, those of them that a ledger of the JSON lines' contents has not): the records of each file name written as files of their own."""
    spark, path = raw.sparkSession, fresh_path(raw.sparkSession, "drop")
    lines = raw.select("file_name", F.regexp_replace("raw_record", r"[\r\n]+", " ").alias("value"), "line_number")
    lines.repartition("file_name").sortWithinPartitions("file_name", "line_number").select("file_name", "value").write.partitionBy("file_name").text(path)
    found = fingerprints(spark, f"{path}/*/*.txt").withColumn("file_name", F.regexp_extract("file_path", "file_name=([^/]+)/", 1))
    seen = raw.where("record_format = 'jsonl'").select("file_name").distinct()
    return found, unseen(found, found.join(seen, "file_name", "left_semi"))
