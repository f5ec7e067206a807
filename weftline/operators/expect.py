"""Expectations: suites of checks as rows (check_name, passed, violations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import clean_text, content_hash, token_count
from weftline.session import cut

from .bm25 import Index
from .ordered import previous
from .vectors import bad_numbers, norm

NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"


def suite(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count the rows that break each rule, in one pass; a rule that is null for a row is broken. No rows break nothing."""
    counts = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in checks.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations")) for name in checks]))
    return counts.select(each.alias("_c")).select("_c.check_name", (F.col("_c.violations") == 0).alias("passed"), "_c.violations")


def status(checks: DataFrame) -> DataFrame:
    """One row: whether all checks passed, and the failed ones' names."""
    return checks.agg(F.bool_and("passed").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_name")))).alias("failed"))


def utterance_checks(rows: DataFrame) -> DataFrame:
    """Build checks of parsed lines: clocks, order, text without byte order marks, keys."""
    marked = previous(rows, ["talk_id"], F.floor(F.col("source_line") / 5000), ["source_line", "ingested_at"], _before="start_seconds")
    marked = marked.withColumn("_copies", F.count(F.lit(1)).over(W.partitionBy("talk_id", "source_line")))
    return suite(
        marked,
        {
            "has_key": F.col("talk_id").isNotNull() & F.col("source_line").isNotNull(),
            "unique_line": F.col("_copies") == 1,
            "has_clock": F.col("start_seconds").isNotNull(),
            "clock_not_behind": F.col("_before").isNull() | F.col("start_seconds").isNull() | (F.col("start_seconds") >= F.col("_before")),
            "has_text": F.coalesce(F.col("text").rlike(NOT_BLANK), F.lit(False)),
            "no_byte_order_mark": ~F.coalesce(F.contains("text", F.lit("\ufeff")), F.lit(False)),
        },
    )


def chunk_checks(chunks: DataFrame) -> DataFrame:
    """Checks of recorded chunks (unique rows): counts and hashes reproduce, indices are consecutive, overlaps are the suffix of the
    chunk before, closures add up. A chunk may carry the whole of the one before if that is smaller than the overlap."""
    w = W.partitionBy("talk_id").orderBy("chunk_index")
    o, c = F.col("overlap_with_previous"), F.col("closure")
    rows = chunks.select(
        "*",
        F.row_number().over(w).alias("_at"),
        F.lag("chunk_id").over(w).alias("_prev"),
        F.lag("end_sequence_index").over(w).alias("_prev_end"),
        F.lag("start_sequence_index").over(w).alias("_prev_start"),
    ).withColumn("_tokens", token_count(F.col("text")))
    first = F.col("_at") == 1
    crossed = c["reason"].isin("closest_after", "closest_before", "tie_include")
    return suite(
        rows,
        {
            "index_consecutive": F.col("chunk_index") == F.col("_at") - 1,
            "id_fits_index": F.col("chunk_id") == F.format_string("%s_c%04d", "talk_id", "chunk_index"),
            "has_text": F.coalesce(F.col("text").rlike(NOT_BLANK), F.lit(False)),
            "token_count_reproduces": F.col("token_count") == F.col("_tokens"),
            "hash_reproduces": F.col("content_sha256") == content_hash(F.col("text")),
            "new_row": F.col("new_utterance_count") >= 1,
            "bounds": (F.col("start_sequence_index") <= F.col("new_start_sequence_index")) & (F.col("new_start_sequence_index") <= F.col("new_end_sequence_index")) & (F.col("new_end_sequence_index") == F.col("end_sequence_index")),
            "first_has_no_overlap": ~first | o.isNull(),
            "overlap_of_predecessor": first | ((o["previous_chunk_id"] == F.col("_prev")) & (o["end_sequence_index"] == F.col("_prev_end")) & (o["start_sequence_index"] >= F.col("_prev_start")) & (o["start_sequence_index"] == F.col("start_sequence_index"))),
            "new_follows_predecessor": first | (F.col("new_start_sequence_index") == F.col("_prev_end") + 1),
            "closure_adds_up": ~crossed | ((c["distance_after"] >= 0) & F.when(c["reason"] == "closest_after", c["distance_after"] < c["distance_before"]).when(c["reason"] == "closest_before", c["distance_before"] < c["distance_after"]).otherwise(c["distance_before"] == c["distance_after"])),
        },
    )


#: The reasons for which a chunk may be closed. Fixed values.
REASONS = ("exact_target", "closest_after", "closest_before", "tie_include", "forced_progress_over_target", "end_of_talk")


def record_checks(made: DataFrame, rows: DataFrame, target: int, overlap: int) -> DataFrame:
    """The chunk suite: checks of whole records (chunk.records) against the rows they were made of and the settings, each with the
    number of chunks that break it, of talks for talks_covered and covered_once, and of ids for ids_unique.

    rows: (talk_id, sequence_index, source_line, text, tokens), read three times, so a table rather than a costly plan. A chunk may carry over the whole of the one before if that is less
    than the overlap.
    """
    made, rows = cut(made.drop("utterances")), rows.select("talk_id", "sequence_index", "source_line", "text", "tokens")  # read several times
    w = W.partitionBy("talk_id").orderBy("chunk_index")
    # what a record should hold, from the rows themselves
    placed = made.select("chunk_id", "talk_id", "new_start_sequence_index", F.explode(F.sequence("start_sequence_index", "end_sequence_index")).alias("sequence_index"))
    n, carried = F.col("tokens"), F.col("sequence_index") < F.col("new_start_sequence_index")
    own = placed.join(rows, ["talk_id", "sequence_index"])
    told = own.groupBy("chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("_text"),
        F.sum(n).alias("_tokens"),
        F.coalesce(F.sum(F.when(carried, n)), F.lit(0)).alias("_carried"),
        F.min_by("tokens", "sequence_index").alias("_first_tokens"),
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("source_line", "sequence_index").alias("_from"),
        F.max_by("source_line", "sequence_index").alias("_to"),
    )
    last = F.lead("chunk_id").over(w).isNull()
    before = F.lag(F.struct("chunk_id", "start_sequence_index", "end_sequence_index")).over(w)
    both = made.join(told, "chunk_id", "left").withColumn("_last", last).withColumn("_b", before).withColumn("_at", F.row_number().over(w))
    o, c, b, size = F.col("overlap_with_previous"), F.col("closure"), F.col("_b"), F.col("token_count")
    opens, whole = b.isNull(), F.col("start_sequence_index") == b["start_sequence_index"]
    reason, under, over = c["reason"], c["distance_before"], c["distance_after"]
    closed = (
        F.when(reason == "exact_target", (size == target) & (c["tokens_after"] == target))
        .when(reason == "closest_after", (over < under) & (size == c["tokens_after"]) & (c["candidate_sequence_index"] == F.col("end_sequence_index")))
        .when(reason == "closest_before", (under < over) & (size == c["tokens_before"]) & (c["candidate_sequence_index"] == F.col("end_sequence_index") + 1))
        .when(reason == "tie_include", (over == under) & (size == c["tokens_after"]) & (c["candidate_sequence_index"] == F.col("end_sequence_index")))
        .when(reason == "forced_progress_over_target", (size > target) & (F.col("new_utterance_count") == 1))
        .when(reason == "end_of_talk", F.col("_last"))
    )
    measured = (under.isNull() & over.isNull()) | ((under == F.abs(c["tokens_before"] - target)) & (over == F.abs(c["tokens_after"] - target)))
    out = suite(
        both,
        {
            "index_consecutive": F.col("chunk_index") == F.col("_at") - 1,
            "id_fits_index": F.col("chunk_id") == F.format_string("%s_c%04d", "talk_id", "chunk_index"),
            "rows_consecutive": F.col("_rows") == F.col("utterance_count"),
            "text_reproduces": F.col("text") == F.col("_text"),
            "token_count_reproduces": size == F.col("_tokens"),
            "hash_reproduces": F.col("content_sha256") == content_hash(F.col("text")),
            "lines_match_rows": (F.col("start_source_line") == F.col("_from")) & (F.col("end_source_line") == F.col("_to")),
            "new_row": (F.col("new_utterance_count") >= 1) & (F.col("new_end_sequence_index") - F.col("new_start_sequence_index") + 1 == F.col("new_utterance_count")),
            "bounds": (F.col("start_sequence_index") <= F.col("new_start_sequence_index")) & (F.col("new_end_sequence_index") == F.col("end_sequence_index")),
            "first_has_no_overlap": ~opens | o.isNull(),
            "overlap_is_suffix": opens | (overlap == 0) | ((o["previous_chunk_id"] == b["chunk_id"]) & (o["end_sequence_index"] == b["end_sequence_index"]) & (o["start_sequence_index"] == F.col("start_sequence_index")) & (o["start_sequence_index"] >= b["start_sequence_index"])),
            "overlap_reaches": opens | whole | (F.col("_carried") >= overlap),
            "overlap_is_minimal": opens | (F.col("_carried") - F.when(F.col("_carried") > 0, F.col("_first_tokens")).otherwise(0) < overlap) | (F.col("_carried") == 0),
            "closure_known": reason.isin(*REASONS),
            "closure_adds_up": closed & measured,
        },
    )
    # over talks and ids; a talk's new rows are counted, and their numbers summed, so that none stands for another
    new = made.groupBy("talk_id").agg(F.sum("new_utterance_count").alias("_n"), F.sum((F.col("new_start_sequence_index") + F.col("new_end_sequence_index")) * F.col("new_utterance_count") / 2).alias("_s"))
    have = rows.groupBy("talk_id").agg(F.count(F.lit(1)).alias("_m"), F.sum("sequence_index").alias("_t"))
    talks = suite(have.join(new, "talk_id", "full"), {"talks_covered": F.col("_n").isNotNull() & F.col("_m").isNotNull(), "covered_once": (F.col("_n") == F.col("_m")) & (F.col("_s") == F.col("_t"))})
    ids = suite(made.groupBy("chunk_id").count(), {"ids_unique": F.col("count") == 1})
    return out.unionByName(talks).unionByName(ids)


def index_checks(index: Index, expected: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The suite of a lexical index against the collection that it should hold: equal numbers of documents, ids unique, none missing and none
    unexpected, no document without tokens, lengths known and the sum of sound postings, every term weighed and no other."""
    ids = expected.select(F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("_counted"))
    want = ids.groupBy("id").agg(F.max("_counted").alias("_counted"), F.count(F.lit(1)).alias("_expected"))
    have = index.docs.groupBy("id").agg(F.max("dl").alias("dl"), F.count(F.lit(1)).alias("_indexed"))
    posted = index.postings.groupBy("id").agg(F.sum("tf").alias("_sum"), F.count_if((F.col("tf") < 1) | F.col("tf").isNull()).alias("_low"), (F.count(F.lit(1)) - F.count_distinct("term")).alias("_again"))
    rows = want.join(have, "id", "full").join(posted, "id", "full")
    there = F.col("_indexed").isNotNull()
    out = suite(
        rows,
        {
            "ids_unique": ~there | (F.col("_indexed") == 1),
            "none_missing": F.col("_expected").isNull() | there,
            "none_unexpected": ~there | F.col("_expected").isNotNull(),
            "no_empty_document": ~there | (F.col("dl") > 0),
            "length_complete": ~there | F.col("dl").isNotNull(),
            "postings_of_known_documents": F.col("_sum").isNull() | there,
            "postings_well_formed": F.col("_sum").isNull() | ((F.col("_low") == 0) & (F.col("_again") == 0)),
            "postings_give_length": ~there | (F.coalesce("_sum", F.lit(0)) == F.col("dl")),
            "length_reproduces": ~there | F.col("_expected").isNull() | (F.col("dl") == F.col("_counted")),
        },
    )
    count = suite(expected.agg(F.count(F.lit(1)).alias("n")).crossJoin(index.docs.agg(F.count(F.lit(1)).alias("m"))), {"document_count": F.col("n") == F.col("m")})
    terms = index.terms.select("term", F.lit(True).alias("_t")).join(index.postings.select("term").distinct().withColumn("_p", F.lit(True)), "term", "full")
    return out.unionByName(count).unionByName(suite(terms, {"terms_match": F.col("_t").isNotNull() & F.col("_p").isNotNull()}))


def talk_guards(definitions: DataFrame, rows: DataFrame) -> DataFrame:
    """(talk_id, problem): what keeps talks from being built from a source's lines; none lets the build go on.

    definitions: (talk_id, event_id, talk_index, start_seconds, end_seconds, start_time, end_time, start_marker, end_marker), bounds inclusive,
    markers the texts of the first and the last line; a null marker or time isn't checked. rows: the talks' selected lines (talk_id, source_line,
    start_time, text). Problems: duplicate id, inverted range, overlap with the talk before, empty, first or last time, first or last text.
    """
    d = definitions
    again = d.groupBy("talk_id").count().where("count > 1").select("talk_id", F.lit("duplicate id").alias("problem"))
    inverted = d.where("end_seconds < start_seconds").select("talk_id", F.lit("inverted range").alias("problem"))
    blocks = previous(d.where("start_seconds IS NOT NULL"), ["event_id"], F.floor(F.col("talk_index") / 1000), ["talk_index", "start_seconds", "talk_id"], _end="end_seconds")
    overlap = blocks.where(F.col("start_seconds") <= F.col("_end")).select("talk_id", F.lit("overlap").alias("problem"))
    line = F.struct("start_time", clean_text(F.col("text")).alias("text"))
    ends = rows.groupBy("talk_id").agg(F.min_by(line, "source_line").alias("_first"), F.max_by(line, "source_line").alias("_last"))
    both = d.join(ends, "talk_id", "left")
    problems = [
        F.when(F.col("_first").isNull(), "empty"),
        F.when(F.col("_first.start_time") != F.col("start_time"), "first time"),
        F.when(F.col("_last.start_time") != F.col("end_time"), "last time"),
        F.when(F.col("_first.text") != clean_text(F.col("start_marker")), "first text"),
        F.when(F.col("_last.text") != clean_text(F.col("end_marker")), "last text"),
    ]
    each = both.select("talk_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    return each.unionByName(again).unionByName(inverted).unionByName(overlap)


def talk_checks(talks: DataFrame, phrase: str | None = None) -> DataFrame:
    """The suite of built talks (segment.talk_records): ids unique, none empty, text without byte order marks and rebuilt from its rows,
    its hash, rows in the order of their lines and numbered from 0; phrase: something that a text must have kept."""
    talks = cut(talks)
    u = F.col("utterances")
    lines, numbers = F.transform(u, lambda x: x["source_line"]), F.transform(u, lambda x: x["sequence_index"])
    out = suite(
        talks,
        {
            "nonempty": F.col("utterance_count") >= 1,
            "count_fits": F.size(u) == F.col("utterance_count"),
            "no_byte_order_mark": ~F.contains(F.col("text"), F.lit("\ufeff")),
            "text_rebuilt": F.col("text") == F.array_join(F.transform(u, lambda x: x["text"]), "\n"),
            "hash_reproduces": F.col("content_sha256") == content_hash(F.col("text")),
            "source_order": lines == F.array_sort(lines),
            "sequence_consecutive": numbers == F.sequence(F.lit(0), F.size(u) - 1),
            "clock_of_rows": (F.col("start_time").eqNullSafe(F.get(u, F.lit(0))["start_time"])) & F.col("end_time").eqNullSafe(F.get(u, F.size(u) - 1)["start_time"]),
        },
    )
    out = out.unionByName(suite(talks.groupBy("talk_id").count(), {"ids_unique": F.col("count") == 1}))
    if phrase is not None:
        out = out.unionByName(suite(talks.agg(F.count_if(F.contains("text", F.lit(phrase))).alias("n")), {"phrase_kept": F.col("n") > 0}))
    return out


def vector_checks(vectors: DataFrame, manifest: DataFrame, dim: int, tolerance: float = 1e-5) -> DataFrame:
    """Checks of vectors (row_index, embedding) against a manifest (row_index, chunk_id), each of unique rows."""
    v = F.col("embedding")
    nan, inf = bad_numbers(v)
    both = vectors.select("row_index", "embedding", F.lit(True).alias("_v")).join(manifest.select("row_index", "chunk_id").withColumn("_m", F.lit(True)), "row_index", "full")
    ids = both.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_ids"))
    both = both.join(ids, "chunk_id", "left")
    there = F.col("_v").isNull()
    return suite(
        both,
        {
            "vector_has_id": there | F.col("_m").isNotNull(),
            "id_has_vector": F.col("_m").isNull() | F.col("_v").isNotNull(),
            "id_unique": F.col("_ids").isNull() | (F.col("_ids") == 1),
            "not_null": there | v.isNotNull(),
            "dimension": there | v.isNull() | (F.size(v) == dim),
            "no_nan": there | (nan == 0),
            "no_inf": there | (inf == 0),
            "unit_norm": there | v.isNull() | (nan > 0) | (inf > 0) | (F.abs(norm(v) - 1) <= tolerance),
        },
    )


def collection_checks(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Checks of one ordered list of ids against another, each (position, key): equal numbers, equal ids, equal order."""
    counts = found.agg(F.count(F.lit(1)).alias("n")).crossJoin(expected.agg(F.count(F.lit(1)).alias("m")))
    out = suite(counts, {"count_expected": F.col("n") == F.col("m")})
    ids = found.select(key).distinct().withColumn("_f", F.lit(True)).join(expected.select(key).distinct().withColumn("_e", F.lit(True)), key, "full")
    out = out.unionByName(suite(ids, {"same_ids": F.col("_f").isNotNull() & F.col("_e").isNotNull()}))
    places = expected.select("position", F.col(key).alias("_e")).join(found.select("position", F.col(key).alias("_f")), "position", "full")
    return out.unionByName(suite(places, {"same_order": F.col("_e") == F.col("_f")}))


#: What a chunker's settings must hold. Fixed rules.
CHUNK_RULES = {
    "crossing_rule": "closest_to_target",
    "tie_breaker": "include",
    "minimum_new_utterances": 1,
    "target_tokens": lambda n: isinstance(n, int) and n > 0,
    "overlap_tokens": lambda n: isinstance(n, int) and n >= 0,
}


def chunk_config_checks(config: dict) -> list[str]:
    """Names of the chunker's settings that can't be worked with; the overlap must be less than the target."""
    bad = config_checks(config, CHUNK_RULES)
    if not bad and config["overlap_tokens"] >= config["target_tokens"]:
        bad = ["overlap_tokens"]
    return bad


def config_checks(config: dict, rules: dict) -> list[str]:
    """Names of the settings that break their rule, a value to equal or a function to hold; for a job to refuse before it reads."""
    return sorted(k for k, rule in rules.items() if not (rule(config.get(k)) if callable(rule) else config.get(k) == rule))
