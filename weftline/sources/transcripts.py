"""Timestamped transcripts: parsing lines, diagnostics, and rendering talks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import clean_label, clean_text, clock_seconds

#: What ends a line: more than Spark's line reader knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: HH:MM:SS [label] and then text, which may be missing. Fixed format.
GRAMMAR = r"^([0-9]{2}:[0-9]{2}:[0-9]{2}) \[([^\]]+)\](?:\s(.*))?$"


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_file, source_line, line) of whole files in UTF-8, a byte order mark stripped, blank lines numbered too."""
    whole = spark.read.text([*paths], wholetext=True).select(F.input_file_name().alias("source_file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    # a final line end closes the last line and opens no other
    bare = F.regexp_replace("value", f"(?:{LINE_END})\\z", "")
    split = whole.where(F.length("value") > 0).select("source_file", F.posexplode(F.split(bare, LINE_END)).alias("pos", "line"))
    return split.select("source_file", (F.col("pos") + 1).alias("source_line"), F.regexp_replace("line", r"[\s\p{Z}\x1c-\x1f\x85]+$", "").alias("line"))


def parsed(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with matched, start_time, start_seconds, source_label and text by the line grammar; nulls where a line doesn't match."""
    value: Column = F.col(line)
    matched = F.coalesce(value.rlike(GRAMMAR), F.lit(False))
    part = [F.when(matched, F.regexp_extract(value, GRAMMAR, i)) for i in (1, 2, 3)]
    return rows.select("*", matched.alias("matched"), part[0].alias("start_time"), clock_seconds(part[0]).alias("start_seconds"), clean_label(part[1]).alias("source_label"), clean_text(part[2]).alias("text"))


def utterances(rows: DataFrame, line: str = "line") -> DataFrame:
    """The parsed lines that say something. A clock with minutes or seconds above 59 is an error."""
    found = parsed(rows, line).where("matched AND text != ''").drop("matched")
    wrong = F.raise_error(F.concat(F.lit("no such time: "), F.col("start_time"))).cast("int")
    return found.withColumn("start_seconds", F.coalesce("start_seconds", wrong))


def rejects(rows: DataFrame, line: str = "line") -> DataFrame:
    """The lines that aren't blank and don't match, cleaned."""
    found = parsed(rows, line).where("NOT matched")
    return found.select(*[c for c in rows.columns if c != line], clean_text(F.col(line)).alias("line")).where("line != ''")


#: The names of the header's lines, and what parts it from the body. Fixed format.
HEADER, RULE = ("Evento", "Ponencia", "Ponente(s)", "Rango", "ID"), "\n---\n"


def rendered(talks: DataFrame, spoken: DataFrame) -> DataFrame:
    """(talk_id, rendering): a header of the talk's event, title, speakers, bounds and id, and '[time] text' lines in source order.

    talks: (talk_id, event_title, title, speakers, start_time, end_time); spoken: (talk_id, source_line, start_time, text). What is
    null is left empty; a talk without lines has an empty body.
    """
    some = lambda c: F.coalesce(c, F.lit(""))
    body = F.array_sort(F.collect_list(F.struct("source_line", F.concat(F.lit("["), some(F.col("start_time")), F.lit("] "), "text").alias("t"))))
    bodies = spoken.groupBy("talk_id").agg(F.array_join(body["t"], "\n").alias("body"))
    held = F.col("event_title"), F.col("title"), F.array_join("speakers", ", "), F.concat(some(F.col("start_time")), F.lit(" - "), some(F.col("end_time"))), F.col("talk_id")
    head = [F.concat(F.lit(f"{name}: "), some(value)) for name, value in zip(HEADER, held)]
    return talks.join(bodies, "talk_id", "left").select("talk_id", F.concat(F.concat_ws("\n", *head, F.lit(RULE), some(F.col("body"))), F.lit("\n")).alias("rendering"))
