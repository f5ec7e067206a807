"""Hashes of files and texts as proof of where results come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import content_hash


def file_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of every file; hashed in the tasks that read it."""
    return spark.read.format("binaryFile").load([*paths]).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def job_manifest(files: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, bytes, sha256, rows): a file manifest beside how many rows each named result has."""
    out = files.select(F.lit("file").alias("kind"), F.col("path").alias("name"), "bytes", "sha256", F.lit(None).cast("bigint").alias("rows"))
    for name, rows in counts.items():
        n = rows.agg(F.count(F.lit(1)).alias("rows"))
        out = out.unionByName(n.select(F.lit("result").alias("kind"), F.lit(name).alias("name"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"), "rows"))
    return out


def changed_files(spark: SparkSession, manifest: DataFrame, *paths: str) -> DataFrame:
    """(path, recorded, found): files whose content is no longer the recorded one, or that are gone or new; none opens the gate."""
    now = file_manifest(spark, *paths).select("path", F.col("sha256").alias("found"))
    then = manifest.select("path", F.col("sha256").alias("recorded"))
    return then.join(now, "path", "full").where(~F.col("recorded").eqNullSafe(F.col("found"))).select("path", "recorded", "found")


def changed_texts(rows: DataFrame, key: str, text: str, recorded: str) -> DataFrame:
    """(key, recorded, found): rows whose text no longer has its recorded hash; a null text has none."""
    found = content_hash(F.col(text))
    return rows.select(key, F.col(recorded).alias("recorded"), found.alias("found")).where(~F.col("recorded").eqNullSafe(F.col("found")))
