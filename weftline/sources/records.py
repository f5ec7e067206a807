"""JSON records in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ordered import numbered


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line, line): lines numbered from 1 in their file; a file may be read by many tasks, whose blocks are numbered apart."""
    where = F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")
    rows = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    out = numbered(rows, ["source_file"], F.col("_block"), ["_id"], "_n")
    return out.select("source_file", (F.col("_n") + 1).alias("source_line"), "line")


def malformed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(source_file, source_line, line): the lines that aren't blank and no record of the schema."""
    read = F.from_json("line", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = numbered_lines(spark, path).where("trim(line) != ''").withColumn("_r", read)
    return rows.where(F.col("_r").isNull() | F.col("_r._bad").isNotNull()).select("source_file", "source_line", "line")


def read_jsonl(spark: SparkSession, path: str, schema: str, empty_ok: bool = False) -> DataFrame:
    """JSON Lines by a declared schema; blank lines are skipped, a malformed one is an error that names its number, and so is an empty file
    unless allowed."""
    if bad := malformed(spark, path, schema).orderBy("source_file", "source_line").first():
        raise ValueError(f"{bad.source_file}, line {bad.source_line}: no such record")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not empty_ok and rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document, over several lines, as a row."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def required(rows: DataFrame, unique: str, *fields: str, positive: tuple[str, ...] = ()) -> DataFrame:
    """(key, problem): records without a required field, with a blank one, with a number that must be positive and isn't, or whose key isn't unique."""
    problems = [F.when(F.col(f).isNull(), F.lit(f"{f} is missing")).when(F.trim(F.col(f).cast("string")) == "", F.lit(f"{f} is blank")) for f in fields]
    problems += [F.when(F.coalesce(F.col(f) > 0, F.lit(False)), None).otherwise(F.lit(f"{f} isn't positive")) for f in positive]
    bad = rows.select(F.col(unique).alias("key"), F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    again = rows.groupBy(F.col(unique).alias("key")).count().where("count > 1").select("key", F.lit(f"{unique} isn't unique").alias("problem"))
    return bad.unionByName(again)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Compact JSON Lines, characters as they are, nulls kept; the commit protocol makes a file whole or absent."""
    rows.write.option("ignoreNullFields", False).json(path)
