"""Readers of the formats extraction jobs leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_uploads(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "tiff", "tif"), most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Files of the allowed kinds within the size limit: (path, length, modificationTime, content)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(ext.isin(*extensions) & (F.col("length") <= most_bytes))


def read_json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine) of a JSONL file: a row is valid if it parses under the schema and no required field is missing."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    rows = raw.select("value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    ok = F.col("r._bad").isNull() & F.col("r").isNotNull()
    for c in required:
        ok = ok & F.col(f"r.{c}").isNotNull()
    return rows.filter(ok).select("r.*").drop("_bad"), rows.filter(~ok).select("value")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(path, result): result files that hold either the bare result or an envelope with it under ``result``."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return raw.select("path", F.coalesce(F.get_json_object("value", "$.result"), "value").alias("result"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(set, file, options) out of a batch manifest with sets of files that share options."""
    sets = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json(F.get_json_object("value", "$.sets"), "array<struct<name:string,document_type:string,options:map<string,string>,files:array<string>>>")).alias("s")
    )
    kind = F.when(F.col("s.document_type").isNotNull(), F.create_map(F.lit("document_type"), F.col("s.document_type"))).otherwise(F.create_map().cast("map<string,string>"))
    options = F.map_concat(F.map_filter(F.coalesce("s.options", F.create_map().cast("map<string,string>")), lambda k, v: k != "document_type"), kind)
    return sets.select(F.col("s.name").alias("set"), F.explode("s.files").alias("file"), options.alias("options"))
