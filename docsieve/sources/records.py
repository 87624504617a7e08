"""Strict readers, pasted tables and create-only writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, *, strict: bool = True) -> DataFrame:
    """JSON lines under a fixed schema; a bad line fails the read, or is kept in ``_corrupt`` if not ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = StructType([*schema.fields, StructField("_corrupt", StringType())])
    return spark.read.schema(kept).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_new(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet that never replaces anything."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def pasted_cells(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, row, col, text) of tables pasted as Markdown with pipes or as tab-separated lines.

    Markdown's rule line is passed over. Ragged tables give no cells; their keys
    are those of ``rows`` that are missing here.
    """
    text = F.rtrim(F.regexp_replace(F.regexp_replace(F.col(raw), "^﻿", ""), r"\r\n?", "\n"))
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\|?(\s*:?-+:?\s*\|)+\s*:?-*:?\s*$"))
    piped = F.regexp_replace(F.regexp_replace(F.col("x"), r"^\s*\|", ""), r"\|\s*$", "")
    parts = F.when(F.col("x").rlike(r"^\s*\|"), F.split(piped, r"(?<!\\)\|")).otherwise(F.split(F.col("x"), "\t"))
    cut = rows.select(key, F.posexplode(lines).alias("row", "x")).select(key, "row", parts.alias("parts"))
    width = cut.groupBy(key).agg(F.min(F.size("parts")).alias("least"), F.max(F.size("parts")).alias("most")).filter("least = most").select(key)
    cells = cut.join(width, key, "left_semi").select(key, "row", F.posexplode("parts").alias("col", "text"))
    return cells.select(key, "row", "col", F.trim(F.regexp_replace("text", r"\\\|", "|")).alias("text"))
