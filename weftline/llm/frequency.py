"""How often every distinct term occurs and in how many records, by recursive radix spilling.

Each task counts its own records' terms, so that even a term of every record leaves a task as few rows. The partial counts are
partitioned by leading bits of the terms' hash and written to the shared folder. Partitions with more rows than the limit are
split by further bits, again and again. Each leaf then is aggregated by DuckDB within a task, which reads the leaf's files and
may itself spill.
"""

from __future__ import annotations

import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, new_path

from .common import once

PARTIAL = "term string, occurrences bigint, records bigint"


def partial_counts(docs: DataFrame, text: str, held: int = 500_000) -> DataFrame:
    """Counts of terms within each task, given out whenever more than held terms are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        token = regex.compile(r"[\p{L}\p{N}]+")
        times, records = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(times, pa.string()), pa.array(times.values(), pa.int64()), pa.array([records[t] for t in times], pa.int64())], ["term", "occurrences", "records"])
            times.clear()
            records.clear()
            return out

        for b in batches:
            for value in b.column(0).to_pylist():
                if value:
                    own = Counter(token.findall(unicodedata.normalize("NFC", value).lower()))
                    times.update(own)
                    records.update(own.keys())
                    if len(times) > held:
                        yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, PARTIAL)


def spill(partial: DataFrame, bits: int, limit: int) -> DataFrame:
    """Write partial counts into hash partitions of at most limit rows each, as far as terms' hashes differ.

    Returns (path, rows) of the partitions' folders. Rebalancing lets a partition have as many writers as its size asks for.
    """
    spark, level, leaves = partial.sparkSession, 0, None
    todo = partial.withColumn("_hash", F.xxhash64("term"))
    while True:
        root = new_path(spark, f"radix{level}")
        part = F.shiftrightunsigned("_hash", 64 - level - bits)
        part = part if level == 0 else F.concat_ws("-", "_part", part.bitwiseAND(2**bits - 1).cast("string"))
        todo.withColumn("_part", part.cast("string")).hint("rebalance", "_part").write.partitionBy("_part").parquet(root)
        written = spark.read.schema(f"{PARTIAL}, _hash bigint, _part string").parquet(root)
        sizes = cut(written.groupBy("_part").agg(F.count(F.lit(1)).alias("rows")))
        level += bits
        small = F.lit(True) if level + bits > 64 else F.col("rows") <= limit
        own = sizes.where(small).select(F.concat(F.lit(f"{root}/_part="), "_part").alias("path"), "rows")
        leaves = own if leaves is None else leaves.unionByName(own)
        large = sizes.where(~small).select("_part")
        if large.isEmpty():
            return leaves
        todo = written.join(large, "_part")


def aggregate(leaves: DataFrame, limit: int, memory: str = "256MB") -> DataFrame:
    """Sum leaf by leaf, out of core in DuckDB. A task takes one leaf, or more where they are small."""
    n, rows = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    tasks = max(1, min(n, max(leaves.sparkSession.sparkContext.defaultParallelism, 2 * rows // limit)))
    paths = leaves.select("path").repartitionByRange(tasks, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # beside Spark's own spill files of this executor
        with tempfile.TemporaryDirectory(prefix="radix-", dir=os.environ["SPARK_LOCAL_DIRS"].split(",")[0]) as scratch:
            for b in batches:
                for path in b.column(0).to_pylist():
                    files, place = pyarrow.fs.FileSystem.from_uri(path)
                    partial = pyarrow.dataset.dataset(place, filesystem=files, format="parquet")
                    with duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": scratch}) as c:
                        c.register("partial", partial)
                        yield from c.sql("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM partial GROUP BY term").to_arrow_reader(100_000)

    return paths.mapInArrow(run, PARTIAL)


def term_frequencies(docs: DataFrame, text: str, bits: int = 5, limit: int = 1_000_000) -> DataFrame:
    """(term, occurrences, records) over all rows of docs. Null texts have no terms; no terms give no rows."""
    return aggregate(spill(partial_counts(docs, text), bits, limit), limit)


def marked_terms(chunks: DataFrame, rare: int = 2, common: float = 0.25, **how: int) -> DataFrame:
    """(term, occurrences, records, mark) of the distinct chunks: 'rare' in at most rare of them, 'common' in more than the
    given share of all (with those of null text), else null; where both hold, as in tiny collections, it is 'rare'."""
    docs = once(chunks.select("chunk_id", "text"), "chunk_id")
    total = chunks.agg(F.count_distinct("chunk_id")).first()[0] + docs.where(F.col("chunk_id").isNull()).count()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common")
    return term_frequencies(docs, "text", **how).withColumn("mark", mark)
