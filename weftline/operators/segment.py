"""Lines into talks: inversions, intervals, dense sequences and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import content_hash
from weftline.schemas import UTTERANCE

from .ordered import numbered, previous


def inversions(lines: DataFrame, group: list[str], line: str, second: str, held: int = 10_000) -> DataFrame:
    """(group, line, previous_line, second, previous_second, delta): lines whose clock runs behind the one of the line before.

    Nothing is reordered or dropped. Lines without a clock are passed over. A task scans held numbers of lines of a group.
    """
    known = lines.where(F.col(second).isNotNull()).select(*group, line, second)
    out = previous(known, group, F.floor(F.col(line) / held), [line], previous_line=line, previous_second=second)
    return out.where(F.col("previous_second") > F.col(second)).withColumn("delta", F.col(second) - F.col("previous_second"))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Every point with every interval whose inclusive bounds hold it (and with equal keys in on).

    Both sides meet on bins of the given width, which makes a range join an equi join: an interval stands in each bin that it
    touches, a point in one. Choose a width near the usual interval. Intervals that end before they start hold nothing.
    """
    keys = on or []
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(first, last)))
    return p.join(i, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def overlapping(definitions: DataFrame, group: str, block: Column, order: list[str], start: str, end: str) -> DataFrame:
    """The definitions that start no later than the one before them in their group ends, with that end; block agrees with the order."""
    return previous(definitions, [group], block, order, previous_end=end).where(F.col(start) <= F.col("previous_end"))


def dense_sequence(rows: DataFrame, group: str, order: str, out: str = "sequence", held: int = 5000) -> DataFrame:
    """Numbers from 0 in the group's order, a whole number of which a task scans held at a time."""
    return numbered(rows, [group], F.floor(F.col(order) / held), [order], out).withColumn(out, F.col(out).cast("int"))


def sequence_check(rows: DataFrame, group: str, order: str, index: str) -> DataFrame:
    """(group, rows, dense, rising): whether an index runs 0, 1, 2 .. in the group's order, and whether the order column only rises."""
    w = W.partitionBy(group).orderBy(index, order)
    marked = rows.withColumn("_at", F.row_number().over(w) - 1).withColumn("_before", F.lag(order).over(w))
    return marked.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_and(F.col(index).eqNullSafe(F.col("_at"))).alias("dense"),
        F.bool_and(F.coalesce(F.col(order) > F.col("_before"), F.lit(True))).alias("rising"),
    )


def documents(rows: DataFrame, group: str, order: str, text: str, *nested: str) -> DataFrame:
    """(group, utterance_count, text, utterances): texts joined by line feeds and rows nested, both in order. A talk must fit a row."""
    listed = F.array_sort(F.collect_list(F.struct(order, *nested, text)))
    out = rows.groupBy(group).agg(listed.alias("utterances"))
    return out.select(group, F.size("utterances").alias("utterance_count"), F.array_join(F.col(f"utterances.{text}"), "\n").alias("text"), "utterances")


def talk_records(definitions: DataFrame, rows: DataFrame, version: str = "1.0") -> DataFrame:
    """Whole talk records in the shape of schemas.TALK.

    definitions: (event_id, event_title, event_date, talk_id, title, primary_speaker, speakers, languages, source_file) and a column ordinal,
    by which the talks of an event are numbered from 1. rows: the talks' lines (talk_id, sequence_index, start_time, start_seconds,
    text, source_line, source_label). Times are those of the first and the last row; a talk without rows has none. A talk must fit a row.
    """
    order = ["ordinal", "talk_id"]
    placed = numbered(definitions, ["event_id"], F.floor(F.col("ordinal") / 1000), order, "_n")
    item = F.struct(*[c.split()[0] for c in UTTERANCE.split(", ")])
    listed = rows.groupBy("talk_id").agg(F.array_sort(F.collect_list(item)).alias("utterances"))
    u = F.coalesce("utterances", F.array().cast(f"array<struct<{UTTERANCE}>>"))
    out = placed.join(listed, "talk_id", "left").withColumn("utterances", u)
    first, last = F.get("utterances", F.lit(0)), F.get("utterances", F.size("utterances") - 1)
    out = out.withColumn("text", F.array_join(F.transform("utterances", lambda x: x["text"]), "\n"))
    return out.select(
        F.lit(version).alias("schema_version"), "event_id", "event_title", "event_date", "talk_id", (F.col("_n") + 1).cast("int").alias("talk_index"), "title", "primary_speaker", "speakers", "languages",
        first["start_time"].alias("start_time"), last["start_time"].alias("end_time"), first["start_seconds"].alias("start_seconds"), last["start_seconds"].alias("end_seconds"),
        F.size("utterances").alias("utterance_count"), "text", content_hash(F.col("text")).alias("content_sha256"), "source_file", "utterances",
    )


def selection_counts(rows: DataFrame, group: str, line: str, selected: str) -> DataFrame:
    """(group, selected, excluded): distinct lines that a flag selects, and the others."""
    chosen = F.count_distinct(F.when(F.col(selected), F.col(line)))
    return rows.groupBy(group).agg(chosen.alias("selected"), (F.count_distinct(line) - chosen).alias("excluded"))
