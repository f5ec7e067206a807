"""Overlapping chunks of whole utterances, as near to a target size as can be.

A chunk starts with the rows carried over from the one before and takes at least one new row. When a row would cross the target, the
nearer side wins and a tie takes the row. The next chunk carries over the smallest suffix that reaches the overlap. Sizes are
additive counts per row. The fold is sequential within a talk, so talks are spread over tasks and each is streamed: a task holds
the rows of one chunk, never a talk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import content_hash
from weftline.schemas import CHUNK


def crossing(before: int, after: int, target: int, has_new: bool) -> tuple[bool, str]:
    """Whether a row that takes a chunk from before to after a target belongs to it, and the reason."""
    if not has_new:
        return True, "forced_progress_over_target"
    under, over = abs(target - before), abs(after - target)
    if over == under:
        return True, "tie_include"
    return (True, "closest_after") if over < under else (False, "closest_before")


class Fold:
    """The state within a talk: the rows of the chunk at hand as (sequence index, tokens), overlap first."""

    def __init__(self, target: int, overlap: int) -> None:
        self.target, self.overlap = target, overlap
        self.rows: list[tuple[int, int]] = []
        self.carried = self.total = self.count = 0

    def close(self, reason: str, before: int | None, after: int | None) -> tuple:
        rows, target = self.rows, self.target
        carried = sum(n for _, n in rows[: self.carried])
        gap = (None, None) if before is None else (abs(target - before), abs(after - target))
        out = (self.count, rows[0][0], rows[-1][0], rows[self.carried][0], rows[-1][0], len(rows), len(rows) - self.carried, self.total, self.total - carried, carried, reason, before, after, *gap)
        size, k = 0, len(rows)
        while k and size < self.overlap:
            k -= 1
            size += rows[k][1]
        self.rows, self.carried, self.total, self.count = rows[k:], len(rows) - k, size, self.count + 1
        return out

    def add(self, index: int, n: int) -> Iterator[tuple]:
        while True:
            before, after, fresh = self.total, self.total + n, len(self.rows) == self.carried
            taken, reason = True, None
            if after == self.target:
                reason = "exact_target"
            elif after > self.target:
                taken, reason = crossing(before, after, self.target, not fresh)
            if taken:
                self.rows.append((index, n))
                self.total = after
            if reason:
                yield self.close(reason, before, after)
            if taken:
                return

    def end(self) -> Iterator[tuple]:
        if len(self.rows) > self.carried:
            yield self.close("end_of_talk", None, None)


def chunks(rows: DataFrame, target: int, overlap: int) -> DataFrame:
    """Chunks of rows (talk_id, sequence_index, tokens), in the shape of schemas.CHUNK. Null tokens count 0; no rows give no chunks."""
    if not 0 <= overlap < target:
        raise ValueError("0 <= overlap < target")
    narrow = rows.select("talk_id", "sequence_index", F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens"))
    ordered = narrow.repartition("talk_id").sortWithinPartitions("talk_id", "sequence_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, fold, out = None, None, []

        def put(found: Iterator[tuple]) -> None:
            out.extend((talk, f"{talk}_c{x[0]:04d}", *x) for x in found)

        names = [x.split()[0] for x in CHUNK.split(",")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 10, pa.string(), *[pa.int32()] * 4]

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for t, index, n in zip(*(c.to_pylist() for c in b.columns)):
                if fold is None or t != talk:
                    if fold:
                        put(fold.end())
                    talk, fold = t, Fold(target, overlap)
                put(fold.add(index, n))
            yield batch()
        if fold:
            put(fold.end())
        yield batch()

    return ordered.mapInArrow(run, CHUNK)


def members(made: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per chunk and row in it, with the chunk's columns, the row's own and is_overlap: whether the chunk before holds it too.

    rows: unique (talk_id, sequence_index, ..). The join is on the single row, so no talk is hot.
    """
    own = made.withColumn("sequence_index", F.explode(F.sequence("start_sequence_index", "end_sequence_index")))
    own = own.withColumn("is_overlap", F.col("sequence_index") < F.col("new_start_sequence_index"))
    return own.join(rows.select("talk_id", "sequence_index", *[c for c in rows.columns if c not in made.columns and c != "sequence_index"]), ["talk_id", "sequence_index"])


def records(made: DataFrame, rows: DataFrame, talks: DataFrame) -> DataFrame:
    """Whole chunk records in the shape of schemas.CHUNK_RECORD: bounds in sequence, lines and clock, text joined by line feeds and its
    hash, the rows themselves, what is carried over from the chunk before, and how the chunk came to be closed.

    rows: (talk_id, sequence_index, source_line, start_time, start_seconds, source_label, text); talks: (talk_id, event_id, title,
    primary_speaker), unique; a talk that isn't there leaves them null. A chunk has as many rows as its target lets it have.
    """
    item = F.struct("sequence_index", "source_line", "start_time", "start_seconds", "source_label", "text", "is_overlap")
    listed = members(made, rows).groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("utterances"))
    out = made.join(listed, "chunk_id").join(talks.select("talk_id", "event_id", "title", "primary_speaker"), "talk_id", "left")
    u = F.col("utterances")
    first, last = F.get(u, F.lit(0)), F.get(u, F.size(u) - 1)
    before = F.format_string("%s_c%04d", F.col("talk_id"), F.col("chunk_index") - 1)
    carried = F.col("new_start_sequence_index") - F.col("start_sequence_index")
    overlap = F.struct(before.alias("previous_chunk_id"), carried.alias("utterance_count"), F.col("overlap_token_count").alias("token_count"), "start_sequence_index", (F.col("new_start_sequence_index") - 1).alias("end_sequence_index"))
    reason = F.col("reason")
    candidate = F.when(reason == "closest_before", F.col("end_sequence_index") + 1).when(reason != "end_of_talk", F.col("end_sequence_index"))
    closure = F.struct("reason", candidate.alias("candidate_sequence_index"), "tokens_before", "tokens_after", "distance_before", "distance_after")
    text = F.array_join(F.transform(u, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    out = out.withColumn("text", text)
    return out.select(
        "chunk_id", "event_id", "talk_id", "title", "primary_speaker", "chunk_index", "start_sequence_index", "end_sequence_index", "new_start_sequence_index", "new_end_sequence_index",
        first["source_line"].alias("start_source_line"), last["source_line"].alias("end_source_line"), first["start_time"].alias("start_time"), last["start_time"].alias("end_time"),
        "utterance_count", "new_utterance_count", "token_count", F.col("new_token_count").alias("new_content_token_count"),
        F.when(carried > 0, overlap).alias("overlap_with_previous"), closure.alias("closure"), content_hash(F.col("text")).alias("content_sha256"), "text", "utterances",
    )


def coverage(made: DataFrame, rows: DataFrame) -> DataFrame:
    """(talk_id, rows, new_rows, chunks, once): whether the new rows of a talk's chunks cover its rows exactly once, in order."""
    w = W.partitionBy("talk_id").orderBy("chunk_index")
    joined = made.withColumn("_next", F.coalesce(F.lag("new_end_sequence_index").over(w) + 1, F.lit(0)) == F.col("new_start_sequence_index"))
    covered = joined.groupBy("talk_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("new_utterance_count").alias("new_rows"), F.bool_and("_next").alias("_gapless"))
    have = rows.groupBy("talk_id").agg(F.count(F.lit(1)).alias("rows"))
    out = have.join(covered, "talk_id", "left")
    return out.select("talk_id", "rows", F.coalesce("new_rows", F.lit(0)).alias("new_rows"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce(F.col("_gapless") & (F.col("rows") == F.col("new_rows")), F.lit(False)).alias("once"))


def non_final(made: DataFrame) -> DataFrame:
    """The chunks without each talk's last."""
    last = W.partitionBy("talk_id").orderBy(F.desc("chunk_index"))
    return made.withColumn("_r", F.row_number().over(last)).where("_r > 1").drop("_r")


def last_chunks(made: DataFrame) -> DataFrame:
    """(talk_id, chunk_id, token_count, reason) of each talk's last chunk."""
    best = F.max_by(F.struct("chunk_id", "token_count", "reason"), "chunk_index")
    return made.groupBy("talk_id").agg(best.alias("_c")).select("talk_id", "_c.chunk_id", "_c.token_count", "_c.reason")


def closure_counts(made: DataFrame) -> DataFrame:
    """(talk_id or null for all, reason, chunks)."""
    out = made.groupingSets([[F.col("reason")], [F.col("talk_id"), F.col("reason")]], F.col("talk_id"), F.col("reason")).agg(F.count(F.lit(1)).alias("chunks"), F.grouping("talk_id").alias("_all"))
    return out.select(F.when(F.col("_all") == 0, F.col("talk_id")).alias("talk_id"), "reason", "chunks")


def payload(made: DataFrame) -> DataFrame:
    """(talk_id or null for all, total, new, overlap, ratio): tokens in chunks, those new in them and those carried over."""
    out = made.groupingSets([[], [F.col("talk_id")]], F.col("talk_id")).agg(F.sum("token_count").alias("total"), F.sum("new_token_count").alias("new"), F.sum("overlap_token_count").alias("overlap"), F.grouping("talk_id").alias("_all"))
    return out.select(F.when(F.col("_all") == 0, F.col("talk_id")).alias("talk_id"), "total", "new", "overlap", F.when(F.col("new") != 0, F.col("total") / F.col("new")).alias("ratio"))
