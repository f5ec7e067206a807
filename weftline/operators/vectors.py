"""Dense vectors: norms, checks, normalisation, an encoder protocol and exact cosine search."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import lexical_tokens


def norm(vector: Column) -> Column:
    """The Euclidean length, in double precision."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """The vector over its length, as doubles; null where the length is 0 or not finite."""
    n = norm(vector)
    return F.when((n > 0) & (n < float("inf")), F.transform(vector, lambda x: x.cast("double") / n))


def bad_numbers(vector: Column) -> tuple[Column, Column]:
    """How many NaN and how many infinite numbers a vector holds."""
    nan = F.size(F.filter(vector, lambda x: F.isnan(x)))
    inf = F.size(F.filter(vector, lambda x: ~F.isnan(x) & (F.abs(x) == float("inf"))))
    return F.coalesce(nan, F.lit(0)), F.coalesce(inf, F.lit(0))


def norm_summary(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: vectors, and the min, mean, max of the lengths of finite ones and the largest deviation from 1."""
    nan, inf = bad_numbers(F.col(vector))
    fine = vectors.where((nan == 0) & (inf == 0) & F.col(vector).isNotNull()).select(norm(F.col(vector)).alias("n"))
    return fine.agg(F.count("n").alias("vectors"), F.min("n").alias("min_norm"), F.avg("n").alias("mean_norm"), F.max("n").alias("max_norm"), F.max(F.abs(F.col("n") - 1)).alias("max_deviation"))


class Encoder(Protocol):
    """What turns texts into vectors; an instance is made once per task from what the factory returns."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic encoder without a model: a token adds 1 or -1 to one number, both by its MD5; unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for i, text in enumerate(texts):
            for token, n in Counter(text.split(" ")).items():
                if token:
                    h = hashlib.md5(token.encode()).hexdigest()
                    out[i, int(h[:6], 16) % self.dim] += n if int(h[6], 16) % 2 else -n
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).astype(np.float32)


def encode(docs: DataFrame, id_col: str, text_col: str, make: type[Encoder] | object = HashingEncoder, batch: int = 256, longest: int | None = None) -> DataFrame:
    """(id, embedding): texts encoded in batches by an encoder that each task makes once. Texts without tokens give zero vectors.

    longest: a text of more tokens is an error; nothing is ever cut.
    """
    words = lexical_tokens(F.col(text_col))
    if longest is not None:
        too_long = F.raise_error(F.concat(F.lit("too long: "), F.col(id_col).cast("string"))).cast("array<string>")
        words = F.when(F.size(words) > longest, too_long).otherwise(words)
    tokens = docs.select(F.col(id_col).alias("id"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("text"))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in batches:
            texts = s.tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in encoder.encode(texts[i : i + batch])])

    return tokens.select("id", run("text").alias("embedding"))


HITS = "query_id bigint, id bigint, cosine double"


def cosine_top_k(vectors: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int, skip_self: bool = False, most_queries: int = 4096, held: int = 50_000) -> DataFrame:
    """(query_id, rank, id, cosine): the k nearest of every query by exact cosine, ties (equal to 10 digits) by ascending id.

    queries: (query_id, embedding). As many as most_queries go to all tasks, each of which keeps only its own k best of a
    query, so that no vector is shuffled. More are cut into blocks of that size, vectors into blocks of about held, and
    every two blocks meet in a task, of which the same holds. Vectors that are null, zero or not finite take no part on
    either side. skip_self leaves out the vector with the query's own id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    asked = queries.select("query_id", "embedding")
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("embedding"))
    count = asked.count()
    if count <= most_queries:
        sent = spark.sparkContext.broadcast(_clean(*([*c] for c in zip(*asked.collect()))) if count else _clean([], []))  # a checked number

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _nearest(*sent.value, (_clean(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches), k, skip_self)

        found = own.mapInArrow(run, HITS)
    else:
        rows = -(-count // most_queries)
        columns = max(1, -(-own.count() // held))
        left = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(rows))).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        right = own.withColumn("_v", F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            parts = (_clean(p.column("id").to_pylist(), p.column("embedding").to_pylist()) for p in v.to_batches(max_chunksize=4096))
            return pa.Table.from_batches([_nearest(*_clean(q.column("query_id").to_pylist(), q.column("embedding").to_pylist()), parts, k, skip_self)])

        found = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(meet, HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 10)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def _nearest(asks: np.ndarray, q: np.ndarray, parts: Iterable[tuple[np.ndarray, np.ndarray]], k: int, skip_self: bool) -> pa.RecordBatch:
    """The k best of every query among all parts."""
    best, names = np.full((len(asks), 0), -2.0), np.zeros((len(asks), 0), np.int64)
    for own, x in parts:
        if not len(own) or not len(asks):
            continue
        near = q @ x.T
        if skip_self:
            near[asks[:, None] == own[None, :]] = -9.0
        best = np.concatenate([best, near], 1)
        names = np.concatenate([names, np.broadcast_to(own, near.shape)], 1)
        # rounded like the final ranking, so that a tie is cut by id here too
        order = np.lexsort((names, -np.round(best, 10)), axis=1)[:, :k]
        best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
    good = best > -5
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asks[:, None], best.shape)[good]), pa.array(names[good]), pa.array(best[good])], ["query_id", "id", "cosine"])


def _clean(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of the usable vectors."""
    good = [(i, v) for i, v in zip(ids, vectors) if i is not None and v is not None and len(v) and None not in v]
    if not good:
        return np.array([], np.int64), np.zeros((0, 1))
    x = np.array([v for _, v in good], np.float64)
    n = np.linalg.norm(x, axis=1)
    keep = np.isfinite(n) & (n > 0)
    return np.array([i for i, _ in good], np.int64)[keep], x[keep] / n[keep, None]
