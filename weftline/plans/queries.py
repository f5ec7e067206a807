"""Registered queries of the core over the given tables, each beside the SQL that says the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import tokenizers
from weftline.operators import bm25, chunk, expect, ordered, provenance, segment, stats, vectors, windows
from weftline.session import cut, table
from weftline.sources import records, transcripts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
MANIFEST = "gte_multilingual_base_child_v1_manifest"
THRESHOLDS = [60, 120, 250]
TARGET, OVERLAP = 120, 30

# --- shared inputs: every record once, tokens counted anew --------------------------------------------------------------

_SPACE = "'[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+'"


def _count_sql(x: str) -> str:
    return f"len(regexp_extract_all(lower(nfc_normalize(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+'))::INT"


def _clean_sql(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(replace({x}, chr(65279), '')), {_SPACE}, ' ', 'g'))"


def _norm_sql(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}::DOUBLE[], lambda x: x * x)))"


#: Common table expressions of the oracles.
_U = "u AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM utterances)"
_S = f"{_U}, s AS (SELECT talk_id, source_line, text, start_time, start_seconds, {_count_sql('text')} AS tokens, (row_number() OVER (PARTITION BY talk_id ORDER BY source_line) - 1)::INT AS sequence_index FROM u WHERE trim({_clean_sql('text')}) != '')"
_C = f"c AS (SELECT DISTINCT * EXCLUDE (ingested_at), {_count_sql('text')} AS tokens FROM chunks)"
_T = "t AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM talks)"
_M = f"m AS (SELECT DISTINCT row_index, chunk_id FROM {MANIFEST})"


def _utterances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "utterances").drop("ingested_at").dropDuplicates(["talk_id", "source_line"])


def _with_text(spark: SparkSession, sf: str) -> DataFrame:
    """The utterances with text, and their tokens."""
    return _utterances(spark, sf).where(T.clean_text(F.col("text")) != "").select("talk_id", "source_line", "text", "start_time", "start_seconds", "source_label", T.token_count(F.col("text")).alias("tokens"))


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    """The utterances with text, their tokens, and a dense sequence in source order."""
    return segment.dense_sequence(cut(_with_text(spark, sf)), "talk_id", "source_line", "sequence_index")


def _chunks(spark: SparkSession, sf: str, among: DataFrame | None = None) -> DataFrame:
    """Every chunk once; among: only those whose chunk_id it has, chosen before rows are shuffled."""
    rows = table(spark, sf, "chunks").drop("ingested_at")
    if among is not None:
        rows = rows.join(among.select("chunk_id"), "chunk_id", "left_semi")
    return rows.dropDuplicates(["chunk_id"])


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).withColumn("tokens", T.token_count(F.col("text")))


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "talks").drop("ingested_at").dropDuplicates(["talk_id"])


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MANIFEST).select("row_index", "chunk_id").distinct()


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- text functions -------------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, generate_subscripts(w, 1)::INT - 1 AS position, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)")
def lex_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(T.lexical_tokens(F.col("text"))).alias("position", "token"))


@_query(f"WITH {_U} SELECT talk_id, source_line, {_clean_sql('text')} AS clean FROM u")
def clean_text(spark, sf):
    return _utterances(spark, sf).select("talk_id", "source_line", T.clean_text(F.col("text")).alias("clean"))


@_query(f"WITH {_U} SELECT talk_id, source_line, trim(split_part(trim(regexp_replace({_clean_sql('source_label')}, '^>>\\s*', '')), ' - ', 1)) AS label FROM u")
def clean_label(spark, sf):
    return _utterances(spark, sf).select("talk_id", "source_line", T.clean_label(F.col("source_label")).alias("label"))


@_query(f"SELECT doc_id, CASE WHEN length(f) <= 140 THEN f ELSE rtrim(substr(f, 1, 139)) || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, {_SPACE}, ' ', 'g')) AS f FROM documents)")
def preview_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text"), 140).alias("preview"))


@_query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@_query(f"""WITH {_U} SELECT talk_id, source_line, CASE WHEN regexp_full_match(start_time, '[0-9]{{2}}:[0-5][0-9]:[0-5][0-9]')
    THEN split_part(start_time, ':', 1)::INT * 3600 + split_part(start_time, ':', 2)::INT * 60 + split_part(start_time, ':', 3)::INT END AS seconds FROM u""")
def clock_seconds(spark, sf):
    return _utterances(spark, sf).select("talk_id", "source_line", T.clock_seconds(F.col("start_time")).alias("seconds"))


@_query(f"WITH {_C} SELECT chunk_id AS key, content_sha256 AS recorded, sha256(text) AS found FROM c WHERE content_sha256 IS DISTINCT FROM sha256(text)")
def hash_gate(spark, sf):
    out = provenance.changed_texts(_chunks(spark, sf), "chunk_id", "text", "content_sha256")
    return out.withColumnRenamed("chunk_id", "key")


# --- lines -----------------------------------------------------------------------------------------------------------------

_LINE = "coalesce(start_time, '') || ' [' || coalesce(source_label, '') || '] ' || coalesce(text, '')"
_GRAMMAR = "'^([0-9]{2}:[0-9]{2}:[0-9]{2}) \\[([^\\]]+)\\](?:\\s(.*))?$'"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript lines as they would stand in the talks' files."""
    some = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(some("start_time"), F.lit(" ["), some("source_label"), F.lit("] "), some("text"))
    return _utterances(spark, sf).select("source_file", "source_line", line.alias("line"))


@_query(f"""WITH {_U}, l AS (SELECT source_file, source_line, {_LINE} AS line FROM u),
    p AS (SELECT *, regexp_extract(line, {_GRAMMAR}, 1) AS start_time, regexp_extract(line, {_GRAMMAR}, 2) AS lab, regexp_extract(line, {_GRAMMAR}, 3) AS txt FROM l WHERE regexp_matches(line, {_GRAMMAR}))
    SELECT source_file, source_line, start_time, split_part(start_time, ':', 1)::INT * 3600 + split_part(start_time, ':', 2)::INT * 60 + split_part(start_time, ':', 3)::INT AS start_seconds,
    trim(split_part(trim(regexp_replace({_clean_sql('lab')}, '^>>\\s*', '')), ' - ', 1)) AS source_label, {_clean_sql('txt')} AS text FROM p WHERE {_clean_sql('txt')} != ''""")
def parse_lines(spark, sf):
    return transcripts.utterances(_lines(spark, sf)).drop("line")


@_query(f"""WITH {_U}, l AS (SELECT source_file, source_line, {_LINE} AS line FROM u)
    SELECT source_file, source_line, {_clean_sql('line')} AS line FROM l WHERE NOT regexp_matches(line, {_GRAMMAR}) AND {_clean_sql('line')} != ''""")
def rejects(spark, sf):
    return transcripts.rejects(_lines(spark, sf))


@_query(f"""WITH {_U}, {_T}, b AS (SELECT talk_id, string_agg('[' || coalesce(start_time, '') || '] ' || text, chr(10) ORDER BY source_line) AS body FROM u WHERE text IS NOT NULL GROUP BY talk_id)
    SELECT t.talk_id, 'Evento: ' || coalesce(event_title, '') || chr(10) || 'Ponencia: ' || coalesce(title, '') || chr(10) || 'Ponente(s): ' || coalesce(array_to_string(speakers, ', '), '') || chr(10) || 'Rango: ' || coalesce(start_time, '') || ' - ' || coalesce(end_time, '')
    || chr(10) || 'ID: ' || t.talk_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') || chr(10) AS rendering FROM t LEFT JOIN b USING (talk_id)""")
def rendered_talks(spark, sf):
    return transcripts.rendered(_talks(spark, sf), _utterances(spark, sf).where("text IS NOT NULL"))


@_query(f"""WITH {_U}, w AS (SELECT source_file, source_line, start_seconds, lag(source_line) OVER x AS previous_line, lag(start_seconds) OVER x AS previous_second FROM u WHERE start_seconds IS NOT NULL WINDOW x AS (PARTITION BY source_file ORDER BY source_line))
    SELECT *, start_seconds - previous_second AS delta FROM w WHERE previous_second > start_seconds""")
def inversions(spark, sf):
    return segment.inversions(_utterances(spark, sf), ["source_file"], "source_line", "start_seconds")


@_query("""WITH w AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS second FROM orders), x AS (SELECT o_orderkey, second, lag(o_orderkey) OVER y AS previous_line, lag(second) OVER y AS previous_second FROM w WINDOW y AS (ORDER BY o_orderkey))
    SELECT *, second - previous_second AS delta FROM x WHERE previous_second > second""")
def order_inversions(spark, sf):
    """One order over the whole table, scanned in blocks of keys."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("second"))
    return segment.inversions(rows, [], "o_orderkey", "second")


# --- talks -------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {_U}, {_T} SELECT u.talk_id, source_line, u.start_seconds FROM u JOIN t ON u.talk_id = t.talk_id AND u.start_seconds BETWEEN t.start_seconds AND t.end_seconds")
def interval_select(spark, sf):
    spans = _talks(spark, sf).select("talk_id", F.col("start_seconds").alias("_from"), F.col("end_seconds").alias("_to"))
    points = _utterances(spark, sf).select("talk_id", "source_line", "start_seconds")
    return segment.interval_join(points, "start_seconds", spans, "_from", "_to", 600, ["talk_id"]).select("talk_id", "source_line", "start_seconds")


@_query(f"""WITH {_U}, {_T} SELECT u.talk_id, count(DISTINCT source_line) FILTER (u.start_seconds BETWEEN t.start_seconds AND t.end_seconds) AS selected,
    count(DISTINCT source_line) - count(DISTINCT source_line) FILTER (u.start_seconds BETWEEN t.start_seconds AND t.end_seconds) AS excluded FROM u JOIN t USING (talk_id) GROUP BY 1""")
def interval_excluded(spark, sf):
    spans = _talks(spark, sf).select("talk_id", F.col("start_seconds").alias("_from"), F.col("end_seconds").alias("_to"))
    rows = _utterances(spark, sf).join(spans, "talk_id").withColumn("inside", F.coalesce(F.col("start_seconds").between(F.col("_from"), F.col("_to")), F.lit(False)))
    return segment.selection_counts(rows, "talk_id", "source_line", "inside")


@_query("""WITH i AS (SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND hour(e.ts) * 3600 + minute(e.ts) * 60 + second(e.ts) BETWEEN (o.o_orderkey % 1440) * 60 AND (o.o_orderkey % 1440) * 60 + 3600)
    SELECT event_id, o_orderkey FROM i""")
def interval_bins(spark, sf):
    """Range join on two growing tables: events in the hour that each order of the same customer opens."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    points = table(spark, sf, "events").select("event_id", F.col("user_id").alias("who"), second.alias("at"))
    start = (F.col("o_orderkey") % 1440) * 60
    spans = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("who"), start.alias("_from"), (start + 3600).alias("_to"))
    return segment.interval_join(points, "at", spans, "_from", "_to", 3600, ["who"]).select("event_id", "o_orderkey")


@_query(f"""WITH {_T}, w AS (SELECT event_id, talk_id, talk_index, start_seconds, end_seconds, lag(end_seconds) OVER (PARTITION BY event_id ORDER BY talk_index NULLS FIRST, start_seconds NULLS FIRST, talk_id) AS previous_end FROM t)
    SELECT * FROM w WHERE start_seconds <= previous_end""")
def definition_overlap(spark, sf):
    rows = _talks(spark, sf).select("event_id", "talk_id", "talk_index", "start_seconds", "end_seconds")
    return segment.overlapping(rows, "event_id", F.floor(F.col("talk_index") / 1000), ["talk_index", "start_seconds", "talk_id"], "start_seconds", "end_seconds")


@_query(f"WITH {_S} SELECT talk_id, source_line, sequence_index FROM s")
def sequence_index(spark, sf):
    return _spoken(spark, sf).select("talk_id", "source_line", "sequence_index")


@_query(f"""WITH {_U}, w AS (SELECT talk_id, sequence_index AS i, source_line, row_number() OVER x - 1 AS a, lag(source_line) OVER x AS b FROM u WINDOW x AS (PARTITION BY talk_id ORDER BY sequence_index NULLS FIRST, source_line))
    SELECT talk_id, count(*)::BIGINT AS rows, bool_and(i IS NOT DISTINCT FROM a) AS dense, bool_and(coalesce(source_line > b, TRUE)) AS rising FROM w GROUP BY 1""")
def sequence_check(spark, sf):
    return segment.sequence_check(_utterances(spark, sf), "talk_id", "source_line", "sequence_index")


@_query(f"WITH {_S} SELECT talk_id, count(*)::INT AS utterance_count, string_agg(text, chr(10) ORDER BY source_line) AS text FROM s GROUP BY 1")
def talk_docs(spark, sf):
    return segment.documents(_with_text(spark, sf), "talk_id", "source_line", "text").select("talk_id", "utterance_count", "text")


@_query(f"WITH {_T} SELECT talk_id, content_sha256 AS recorded, sha256(text) AS found FROM t WHERE content_sha256 IS DISTINCT FROM sha256(text)")
def talk_hash_check(spark, sf):
    """Talks whose text no longer has the recorded hash."""
    return provenance.changed_texts(_talks(spark, sf), "talk_id", "text", "content_sha256")


def _definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The talks' definitions, in the order of their clocks in an event."""
    return _talks(spark, sf).withColumn("ordinal", F.coalesce("talk_index", F.lit(0)))


def _talk_records(spark: SparkSession, sf: str) -> DataFrame:
    return segment.talk_records(_definitions(spark, sf).drop("start_time", "end_time", "start_seconds", "end_seconds", "text", "utterance_count", "content_sha256", "talk_index", "schema_version"), _spoken(spark, sf))


_BUILT = f"""{_S}, {_T}, b AS (SELECT talk_id, count(*)::INT AS n, string_agg(text, chr(10) ORDER BY source_line) AS body, list(start_time ORDER BY source_line) AS clocks, list(start_seconds ORDER BY source_line) AS seconds,
    string_agg(sequence_index || ':' || source_line, ' ' ORDER BY source_line) AS lines FROM s GROUP BY 1),
    r AS (SELECT t.*, (row_number() OVER (PARTITION BY event_id ORDER BY coalesce(talk_index, 0), t.talk_id))::INT AS nth, n, body, clocks, seconds, lines FROM t LEFT JOIN b ON t.talk_id = b.talk_id)"""


@_query(f"""WITH {_BUILT} SELECT '1.0' AS schema_version, event_id, event_title, event_date, talk_id, nth AS talk_index, title, primary_speaker, array_to_string(speakers, '|') AS speakers, clocks[1] AS start_time, clocks[-1] AS end_time, seconds[1] AS start_seconds, seconds[-1] AS end_seconds,
    coalesce(n, 0) AS utterance_count, coalesce(body, '') AS text, sha256(coalesce(body, '')) AS content_sha256, source_file, coalesce(lines, '') AS lines FROM r""")
def talk_records(spark, sf):
    """Whole talk records made of definitions and lines; the rows as their numbers and lines."""
    lines = F.array_join(F.transform("utterances", lambda u: F.concat_ws(":", u["sequence_index"], u["source_line"])), " ")
    return _talk_records(spark, sf).withColumn("lines", lines).withColumn("speakers", F.array_join("speakers", "|")).drop("utterances", "languages")


_TALK_CHECKS = ["nonempty", "count_fits", "no_byte_order_mark", "text_rebuilt", "hash_reproduces", "source_order", "sequence_consecutive", "clock_of_rows", "ids_unique"]


@_query(f"""WITH {_BUILT}, v AS (SELECT * FROM (VALUES {', '.join(f"('{c}')" for c in _TALK_CHECKS)}) AS x(check_name)),
    bad AS (SELECT 'nonempty' AS check_name FROM r WHERE n IS NULL UNION ALL SELECT 'sequence_consecutive' FROM r WHERE n IS NULL UNION ALL SELECT 'no_byte_order_mark' FROM r WHERE contains(body, chr(65279)))
    SELECT check_name, count(bad.check_name) = 0 AS passed, count(bad.check_name)::BIGINT AS violations FROM v LEFT JOIN bad USING (check_name) GROUP BY 1""")
def talk_checks(spark, sf):
    return expect.talk_checks(_talk_records(spark, sf))


@_query(f"""WITH {_U}, {_T}, e AS (SELECT talk_id, arg_min(start_time, source_line) AS f, arg_max(start_time, source_line) AS l, arg_min({_clean_sql('text')}, source_line) AS ft, arg_max({_clean_sql('text')}, source_line) AS lt FROM (SELECT talk_id, source_line, coalesce(start_time, '') AS start_time, coalesce(text, '') AS text FROM u) GROUP BY 1),
    b AS (SELECT talk_id, start_seconds, lag(end_seconds) OVER (PARTITION BY event_id ORDER BY talk_index NULLS FIRST, start_seconds, talk_id) AS pe FROM t WHERE start_seconds IS NOT NULL),
    m AS (SELECT t.talk_id, t.start_time, t.end_time, {_clean_sql("split_part(t.text, chr(10), 1)")} AS sm, {_clean_sql("split_part(t.text, chr(10), -1)")} AS em, f, l, ft, lt, e.talk_id IS NULL AS none FROM t LEFT JOIN e ON t.talk_id = e.talk_id)
    SELECT talk_id, 'inverted range' AS problem FROM t WHERE end_seconds < start_seconds UNION ALL SELECT talk_id, 'overlap' FROM b WHERE start_seconds <= pe UNION ALL SELECT talk_id, 'empty' FROM m WHERE none
    UNION ALL SELECT talk_id, 'first time' FROM m WHERE f != start_time UNION ALL SELECT talk_id, 'last time' FROM m WHERE l != end_time UNION ALL SELECT talk_id, 'first text' FROM m WHERE ft != sm UNION ALL SELECT talk_id, 'last text' FROM m WHERE lt != em""")
def talk_guards(spark, sf):
    """What keeps the recorded talks from being built anew: their bounds and, as markers, the first and last line of their text."""
    lines = F.split("text", "\n")
    definitions = _talks(spark, sf).withColumn("start_marker", F.get(lines, F.lit(0))).withColumn("end_marker", F.element_at(lines, -1))
    rows = _utterances(spark, sf).select("talk_id", "source_line", F.coalesce("start_time", F.lit("")).alias("start_time"), F.coalesce("text", F.lit("")).alias("text"))
    return expect.talk_guards(definitions, rows)


@_query(f"WITH {_C}, {_T} SELECT t.talk_id, (SELECT count(*) FROM c WHERE c.talk_id = t.talk_id)::BIGINT AS chunks FROM t")
def talk_chunks(spark, sf):
    """Every talk with its number of chunks, 0 for one that has none."""
    counts = _chunks(spark, sf).groupBy("talk_id").agg(F.count(F.lit(1)).alias("n"))
    return _talks(spark, sf).select("talk_id").join(counts, "talk_id", "left").select("talk_id", F.coalesce("n", F.lit(0)).alias("chunks"))


@_query(f"""WITH {_T}, l AS (SELECT DISTINCT event_id, unnest(speakers) AS speaker FROM t) SELECT event_id, speaker, row_number() OVER (PARTITION BY event_id ORDER BY speaker) - 1 AS position FROM l WHERE speaker IS NOT NULL""")
def event_speakers(spark, sf):
    """The distinct speakers of every event in their order, a row each."""
    names = _talks(spark, sf).select("event_id", F.explode("speakers").alias("speaker")).where("speaker IS NOT NULL").distinct()
    return ordered.numbered(names, ["event_id"], F.substring("speaker", 1, 2), ["speaker"], "position")


# --- statistics ----------------------------------------------------------------------------------------------------------------


def _percentiles(v: str) -> str:
    return ", ".join(f"round(quantile_cont({v}, {p / 100}), 6) AS p{p}" for p in stats.PERCENTS)


@_query(f"WITH {_S} SELECT talk_id AS scope, count(*)::BIGINT AS count, sum(tokens)::BIGINT AS total, min(tokens) AS min, max(tokens) AS max, round(avg(tokens), 6) AS mean, {_percentiles('tokens')} FROM s GROUP BY GROUPING SETS ((), (talk_id))")
def token_stats_scoped(spark, sf):
    out = stats.describe(_with_text(spark, sf), "tokens", "talk_id")
    return _rounded(out, "mean", *[f"p{p}" for p in stats.PERCENTS])


def _bins(bins: tuple) -> str:
    return ", ".join(f"({i}, {a}, {b if b is not None else 'NULL'})" for i, (a, b) in enumerate(bins))


@_query(f"""WITH {_S}, b(bin, low, high) AS (VALUES {_bins(stats.TOKEN_BINS)}), g AS (SELECT NULL AS scope, tokens FROM s UNION ALL SELECT talk_id, tokens FROM s), n AS (SELECT scope, count(*) AS n FROM g GROUP BY 1)
    SELECT n.scope, b.bin, b.low, b.high::INT AS high, count(g.tokens)::BIGINT AS count, round(count(g.tokens) / max(n.n), 6) AS share FROM n CROSS JOIN b LEFT JOIN g ON g.scope IS NOT DISTINCT FROM n.scope AND g.tokens >= low AND (high IS NULL OR g.tokens <= high) GROUP BY 1, 2, 3, 4""")
def token_histogram(spark, sf):
    return _rounded(stats.histogram(_with_text(spark, sf), "tokens", "talk_id"), "share")


@_query(f"""WITH {_C}, b(bin, low, high) AS (VALUES {_bins(stats.CHUNK_BINS)}), n AS (SELECT count(*) AS n FROM c)
    SELECT NULL::VARCHAR AS scope, b.bin, b.low, b.high::INT AS high, count(c.tokens)::BIGINT AS count, round(count(c.tokens) / max(n.n), 6) AS share FROM n CROSS JOIN b LEFT JOIN c ON c.tokens >= low AND (high IS NULL OR c.tokens <= high) GROUP BY 1, 2, 3, 4""")
def chunk_histogram(spark, sf):
    return _rounded(stats.histogram(_counted(spark, sf), "tokens", bins=stats.CHUNK_BINS), "share")


@_query(f"""WITH d AS (SELECT doc_id, lang, {_count_sql('text')} AS tokens FROM documents), f AS (SELECT quantile_cont(tokens, 0.75) * 4 - quantile_cont(tokens, 0.25) * 3 AS fence FROM d)
    SELECT doc_id, lang, tokens, round(fence, 6) AS fence, row_number() OVER (ORDER BY tokens DESC, lang NULLS FIRST, doc_id) AS rank FROM d, f WHERE tokens > fence""")
def token_outliers(spark, sf):
    """Documents far longer than most, the longest first."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", T.token_count(F.col("text")).alias("tokens"))
    return _rounded(stats.outliers(docs, "tokens", "lang", "doc_id"), "fence")


_COMPARED = f"x AS (SELECT chunk_id, talk_id, chunk_index, token_count, tokens, tokens - token_count AS difference, CASE WHEN token_count != 0 THEN round(tokens / token_count, 6) END AS ratio, tokens > 150 AS exceeds FROM c)"


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = _counted(spark, sf).select("chunk_id", "talk_id", "chunk_index", "token_count", "tokens")
    return stats.compare(rows, "token_count", "tokens", 150)


@_query(f"WITH {_C}, {_COMPARED} SELECT chunk_id, difference, ratio, exceeds FROM x")
def count_comparison(spark, sf):
    return _compared(spark, sf).select("chunk_id", "difference", "ratio", "exceeds")


def _spread(c: str) -> str:
    inner = ", ".join(f"round(quantile_cont({c}, {p / 100}), 5) AS {n}_{c}" for n, p in stats.SPREAD)
    return f"min({c}) AS min_{c}, round(avg({c}), 5) AS mean_{c}, {inner}, max({c}) AS max_{c}"


@_query(f"""WITH {_C}, {_COMPARED} SELECT talk_id AS scope, count(*)::BIGINT AS rows, sum(token_count)::BIGINT AS total_a, sum(tokens)::BIGINT AS total_b, round(sum(tokens) / nullif(sum(token_count), 0), 6) AS overall_ratio,
    count(*) FILTER (difference < 0) AS less, count(*) FILTER (difference = 0) AS equal, count(*) FILTER (difference > 0) AS more, count(*) FILTER (exceeds) AS exceeding, {_spread('ratio')}, {_spread('difference')} FROM x GROUP BY GROUPING SETS ((), (talk_id))""")
def ratio_stats(spark, sf):
    return _summary(stats.compare_summary(_compared(spark, sf), "token_count", "tokens", "talk_id"))


def _summary(out: DataFrame) -> DataFrame:
    for c in ("ratio", "difference"):
        for n in ("mean", *[n for n, _ in stats.SPREAD]):
            out = out.withColumn(f"{n}_{c}", F.round(f"{n}_{c}", 5))
    return _rounded(out, "overall_ratio")


@_query(f"WITH {_C} SELECT talk_id, chunk_id, tokens FROM c QUALIFY row_number() OVER (PARTITION BY talk_id ORDER BY tokens DESC NULLS LAST, chunk_index) = 1")
def longest_chunk(spark, sf):
    return stats.first_largest(_counted(spark, sf).select("talk_id", "chunk_id", "chunk_index", "tokens"), "tokens", "chunk_index", "talk_id").select("talk_id", "chunk_id", "tokens")


@_query(f"WITH {_C} SELECT chunk_id, tokens FROM c ORDER BY tokens DESC NULLS LAST, talk_id, chunk_index, chunk_id LIMIT 1")
def longest_of_all(spark, sf):
    return stats.largest(_counted(spark, sf), "tokens", "talk_id", "chunk_index", "chunk_id").select("chunk_id", "tokens")


@_query(f"""WITH {_C} SELECT talk_id AS scope, count(*)::BIGINT AS rows, count(*) FILTER (tokens < {TARGET}) AS below, count(*) FILTER (tokens = {TARGET}) AS equal, count(*) FILTER (tokens > {TARGET}) AS above,
    round(100.0 * count(*) FILTER (tokens < {TARGET}) / count(*), 6) AS below_percent, round(100.0 * count(*) FILTER (tokens = {TARGET}) / count(*), 6) AS equal_percent, round(100.0 * count(*) FILTER (tokens > {TARGET}) / count(*), 6) AS above_percent,
    max(greatest(tokens - {TARGET}, 0)) AS most_over, max(greatest({TARGET} - tokens, 0)) AS most_under, round(avg(abs(tokens - {TARGET})), 6) AS mean_deviation, round(quantile_cont(abs(tokens - {TARGET}), 0.5), 6) AS median_deviation,
    round(quantile_cont(abs(tokens - {TARGET}), 0.95), 6) AS p95_deviation, max(abs(tokens - {TARGET})) AS max_deviation FROM c GROUP BY GROUPING SETS ((), (talk_id))""")
def target_position(spark, sf):
    return _rounded(stats.target_position(_counted(spark, sf), "tokens", TARGET, "talk_id"), "below_percent", "equal_percent", "above_percent", "mean_deviation", "median_deviation", "p95_deviation")


# --- windows and chunks ----------------------------------------------------------------------------------------------------------

_WINDOWS = f"""th(threshold) AS (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}),
    p AS (SELECT *, sum(tokens) OVER (PARTITION BY talk_id ORDER BY source_line) AS cum FROM s),
    h AS (SELECT a.talk_id, a.source_line, threshold, min(b.sequence_index) AS e FROM p a, th, p b WHERE a.talk_id = b.talk_id AND b.sequence_index >= a.sequence_index AND b.cum - a.cum + a.tokens >= threshold GROUP BY 1, 2, 3),
    w AS (SELECT a.talk_id, a.source_line, th.threshold, (e - a.sequence_index + 1)::BIGINT AS rows, (b.cum - a.cum + a.tokens)::BIGINT AS reached FROM p a CROSS JOIN th LEFT JOIN h ON h.talk_id = a.talk_id AND h.source_line = a.source_line AND h.threshold = th.threshold LEFT JOIN p b ON b.talk_id = a.talk_id AND b.sequence_index = e)"""


@_query(f"WITH {_S}, {_WINDOWS} SELECT talk_id, source_line, threshold, rows, reached FROM w")
def windows_to_threshold(spark, sf):
    out = windows.to_threshold(cut(_with_text(spark, sf).select("talk_id", "source_line", "tokens")), "talk_id", "source_line", "tokens", THRESHOLDS)
    return out.withColumn("rows", F.col("rows").cast("bigint"))


@_query(f"""WITH {_S}, {_WINDOWS} SELECT talk_id AS scope, threshold, count(*)::BIGINT AS starts, count(rows)::BIGINT AS reaching, count(*) - count(rows) AS tails, min(rows) AS min_rows,
    round(quantile_cont(rows, 0.5), 6) AS median_rows, round(quantile_cont(rows, 0.95), 6) AS p95_rows, max(rows) AS max_rows, round(avg(reached), 6) AS mean_reached FROM w GROUP BY GROUPING SETS ((threshold), (talk_id, threshold))""")
def windows_stats(spark, sf):
    out = windows.threshold_stats(windows_to_threshold(spark, sf), "talk_id")
    return _rounded(out, "median_rows", "p95_rows", "mean_reached")


#: The chunker as a recursion over running sums: from (s, m), the first row with overlap and the first new one.
_CHUNKS = f"""{_S}, l AS (SELECT talk_id, count(*)::INT AS n, list_prepend(0::BIGINT, list(c ORDER BY sequence_index)) AS q FROM (SELECT talk_id, sequence_index, sum(tokens) OVER (PARTITION BY talk_id ORDER BY sequence_index)::BIGINT AS c FROM s) GROUP BY 1),
    k AS (WITH RECURSIVE r AS (
        SELECT talk_id, n, q, 0 AS k, 0 AS st, 0 AS m, -1 AS e, '' AS reason, NULL::INT AS tb, NULL::INT AS ta FROM l
        UNION ALL
        SELECT talk_id, n, q, k + 1, CASE WHEN e < 0 THEN 0 ELSE ns END, CASE WHEN e < 0 THEN 0 ELSE e + 1 END, ne, nreason, CASE WHEN p < n THEN q[p + 1] - q[ss + 1] END, CASE WHEN p < n THEN q[p + 2] - q[ss + 1] END
        FROM (SELECT *, CASE WHEN p >= n THEN n - 1 WHEN p = mm OR q[p + 2] - q[ss + 1] = {TARGET} OR q[p + 2] - q[ss + 1] - {TARGET} <= {TARGET} - (q[p + 1] - q[ss + 1]) THEN p ELSE p - 1 END AS ne,
                CASE WHEN p >= n THEN 'end_of_talk' WHEN q[p + 2] - q[ss + 1] = {TARGET} THEN 'exact_target' WHEN p = mm THEN 'forced_progress_over_target'
                     WHEN q[p + 2] - q[ss + 1] - {TARGET} < {TARGET} - (q[p + 1] - q[ss + 1]) THEN 'closest_after' WHEN q[p + 2] - q[ss + 1] - {TARGET} = {TARGET} - (q[p + 1] - q[ss + 1]) THEN 'tie_include' ELSE 'closest_before' END AS nreason
              FROM (SELECT *, mm + len(list_filter(q[mm + 2:], lambda x: x - q[ss + 1] < {TARGET})) AS p
                    FROM (SELECT *, e + 1 AS mm, ns AS ss FROM (SELECT *, CASE WHEN e < 0 THEN 0 ELSE greatest(st, st + len(list_filter(q[st + 1:e + 2], lambda x: q[e + 2] - x >= {OVERLAP})) - 1) END AS ns FROM r WHERE e < n - 1))))
    ) SELECT * FROM r WHERE k > 0),
    ch AS (SELECT talk_id, talk_id || '_c' || lpad((k - 1)::VARCHAR, 4, '0') AS chunk_id, k - 1 AS chunk_index, st AS start_sequence_index, e AS end_sequence_index, m AS new_start_sequence_index, e AS new_end_sequence_index,
        e - st + 1 AS utterance_count, e - m + 1 AS new_utterance_count, (q[e + 2] - q[st + 1])::INT AS token_count, (q[e + 2] - q[m + 1])::INT AS new_token_count, (q[m + 1] - q[st + 1])::INT AS overlap_token_count,
        reason, tb AS tokens_before, ta AS tokens_after, abs({TARGET} - tb) AS distance_before, abs(ta - {TARGET}) AS distance_after FROM k)"""


def _made(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return chunk.chunks(_spoken(spark, sf) if rows is None else rows, TARGET, OVERLAP)


@_query(f"WITH {_CHUNKS} SELECT * FROM ch")
def chunks(spark, sf):
    return _made(spark, sf)


@_query(f"WITH {_CHUNKS}, h AS (SELECT talk_id, count(*)::BIGINT AS rows FROM s GROUP BY 1) SELECT h.talk_id, h.rows, coalesce(sum(new_utterance_count), 0)::BIGINT AS new_rows, count(ch.chunk_id)::BIGINT AS chunks, coalesce(sum(new_utterance_count) = h.rows, FALSE) AS once FROM h LEFT JOIN ch USING (talk_id) GROUP BY h.talk_id, h.rows")
def chunk_coverage(spark, sf):
    rows = cut(_spoken(spark, sf))
    return chunk.coverage(_made(spark, sf, rows), rows)


@_query(f"WITH {_CHUNKS}, nf AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY talk_id ORDER BY chunk_index DESC) > 1) SELECT talk_id AS scope, count(*)::BIGINT AS count, sum(token_count)::BIGINT AS total, min(token_count) AS min, max(token_count) AS max, round(avg(token_count), 6) AS mean, {_percentiles('token_count')} FROM nf GROUP BY GROUPING SETS ((), (talk_id))")
def chunk_stats(spark, sf):
    out = stats.describe(chunk.non_final(_made(spark, sf)), "token_count", "talk_id")
    return _rounded(out, "mean", *[f"p{p}" for p in stats.PERCENTS])


@_query(f"WITH {_CHUNKS} SELECT talk_id, reason, count(*)::BIGINT AS chunks FROM ch GROUP BY GROUPING SETS ((reason), (talk_id, reason))")
def closure_counts(spark, sf):
    return chunk.closure_counts(_made(spark, sf))


@_query(f"WITH {_CHUNKS} SELECT talk_id, chunk_id, token_count, reason FROM ch QUALIFY row_number() OVER (PARTITION BY talk_id ORDER BY chunk_index DESC) = 1")
def last_chunk(spark, sf):
    return chunk.last_chunks(_made(spark, sf))


@_query(f"WITH {_CHUNKS} SELECT talk_id, sum(token_count)::BIGINT AS total, sum(new_token_count)::BIGINT AS new, sum(overlap_token_count)::BIGINT AS overlap, round(sum(token_count) / nullif(sum(new_token_count), 0), 6) AS ratio FROM ch GROUP BY GROUPING SETS ((), (talk_id))")
def payload_totals(spark, sf):
    return _rounded(chunk.payload(_made(spark, sf)), "ratio")


#: Whole records: texts of the chunks' rows, their lines and clocks, the chunk before, and the candidate of the closure.
_RECORDS = f"""{_CHUNKS}, mm AS (SELECT ch.chunk_id, s.*, s.sequence_index < ch.new_start_sequence_index AS is_overlap FROM ch JOIN s ON s.talk_id = ch.talk_id AND s.sequence_index BETWEEN ch.start_sequence_index AND ch.end_sequence_index),
    tx AS (SELECT chunk_id, string_agg(text, chr(10) ORDER BY sequence_index) AS text, arg_min(source_line, sequence_index) AS start_source_line, arg_max(source_line, sequence_index) AS end_source_line,
        string_agg(source_line || CASE WHEN is_overlap THEN '*' ELSE '' END, ' ' ORDER BY sequence_index) AS lines, list(start_time ORDER BY sequence_index) AS clocks FROM mm GROUP BY 1)"""


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Whole chunk records, and the rows that they were made of."""
    rows = cut(_spoken(spark, sf))
    return chunk.records(_made(spark, sf, rows), rows, _talks(spark, sf)), rows


@_query(f"""WITH {_RECORDS}, {_T} SELECT ch.chunk_id, event_id, ch.talk_id, title, primary_speaker, chunk_index, start_source_line, end_source_line, clocks[1] AS start_time, clocks[-1] AS end_time, token_count, new_token_count AS new_content_token_count,
    CASE WHEN st_ THEN lag(ch.chunk_id) OVER (PARTITION BY ch.talk_id ORDER BY chunk_index) END AS previous_chunk_id, CASE WHEN st_ THEN overlap_token_count END AS overlap_tokens,
    CASE reason WHEN 'closest_before' THEN end_sequence_index + 1 WHEN 'end_of_talk' THEN NULL ELSE end_sequence_index END AS candidate_sequence_index, sha256(tx.text) AS content_sha256, tx.text, lines
    FROM (SELECT *, new_start_sequence_index > start_sequence_index AS st_ FROM ch) ch JOIN tx USING (chunk_id) LEFT JOIN t ON t.talk_id = ch.talk_id""")
def chunk_records(spark, sf):
    """Whole chunk records; the rows as their lines, those carried over marked."""
    o = F.col("overlap_with_previous")
    lines = F.array_join(F.transform("utterances", lambda u: F.concat(u["source_line"].cast("string"), F.when(u["is_overlap"], "*").otherwise(""))), " ")
    plain = ["chunk_id", "event_id", "talk_id", "title", "primary_speaker", "chunk_index", "start_source_line", "end_source_line", "start_time", "end_time", "token_count", "new_content_token_count", "content_sha256", "text"]
    made, _ = _records(spark, sf)
    return made.select(*plain, o["previous_chunk_id"].alias("previous_chunk_id"), o["token_count"].alias("overlap_tokens"), F.col("closure.candidate_sequence_index").alias("candidate_sequence_index"), lines.alias("lines"))


@_query(f"""WITH {_RECORDS} SELECT chunk_id, count(*) FILTER (is_overlap) AS carried, count(*) FILTER (NOT is_overlap) AS new FROM mm GROUP BY 1""")
def chunk_members(spark, sf):
    """How many rows of each chunk are carried over and how many new, counted by their flags."""
    rows = cut(_spoken(spark, sf))
    placed = chunk.members(_made(spark, sf, rows), rows)
    return placed.groupBy("chunk_id").agg(F.count_if("is_overlap").alias("carried"), F.count_if(~F.col("is_overlap")).alias("new"))


_RECORD_CHECKS = ["index_consecutive", "id_fits_index", "rows_consecutive", "text_reproduces", "token_count_reproduces", "hash_reproduces", "lines_match_rows", "new_row", "bounds", "first_has_no_overlap", "overlap_is_suffix", "overlap_reaches", "overlap_is_minimal", "closure_known", "closure_adds_up", "talks_covered", "covered_once", "ids_unique"]


@_query(f"""WITH {_RECORDS}, q AS (SELECT *, lag(end_sequence_index) OVER w AS pe, lag(start_sequence_index) OVER w AS ps, row_number() OVER w AS nth FROM ch JOIN tx USING (chunk_id) WINDOW w AS (PARTITION BY talk_id ORDER BY chunk_index)),
    sums AS (SELECT chunk_id, sum(tokens) AS n, count(*) AS k FROM mm GROUP BY 1),
    v AS (SELECT * FROM (VALUES {', '.join(f"('{c}')" for c in _RECORD_CHECKS)}) AS x(check_name)),
    bad AS (SELECT 'token_count_reproduces' AS check_name FROM q JOIN sums USING (chunk_id) WHERE n != token_count UNION ALL SELECT 'rows_consecutive' FROM q JOIN sums USING (chunk_id) WHERE k != utterance_count
        UNION ALL SELECT 'index_consecutive' FROM q WHERE chunk_index != nth - 1 UNION ALL SELECT 'overlap_reaches' FROM q WHERE nth > 1 AND start_sequence_index != ps AND overlap_token_count < {OVERLAP}
        UNION ALL SELECT 'closure_adds_up' FROM q WHERE reason = 'exact_target' AND token_count != {TARGET} UNION ALL SELECT 'closure_adds_up' FROM q WHERE reason = 'forced_progress_over_target' AND token_count <= {TARGET})
    SELECT check_name, count(bad.check_name) = 0 AS passed, count(bad.check_name)::BIGINT AS violations FROM v LEFT JOIN bad USING (check_name) GROUP BY 1""")
def record_checks(spark, sf):
    """The whole chunk suite over the records made here."""
    return expect.record_checks(*_records(spark, sf), TARGET, OVERLAP)


@_query(f"""WITH {_C}, w AS (SELECT *, overlap_with_previous AS o, closure AS cl, row_number() OVER x AS nth, lag(chunk_id) OVER x AS pid, lag(end_sequence_index) OVER x AS pe, lag(start_sequence_index) OVER x AS ps FROM c WINDOW x AS (PARTITION BY talk_id ORDER BY chunk_index)),
    k AS (SELECT unnest([
        {{'n': 'index_consecutive', 'ok': chunk_index = nth - 1}}, {{'n': 'id_fits_index', 'ok': chunk_id = talk_id || '_c' || lpad(chunk_index::VARCHAR, 4, '0')}}, {{'n': 'has_text', 'ok': regexp_matches(text, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]')}},
        {{'n': 'token_count_reproduces', 'ok': token_count = tokens}}, {{'n': 'hash_reproduces', 'ok': content_sha256 = sha256(text)}}, {{'n': 'new_row', 'ok': new_utterance_count >= 1}},
        {{'n': 'bounds', 'ok': start_sequence_index <= new_start_sequence_index AND new_start_sequence_index <= new_end_sequence_index AND new_end_sequence_index = end_sequence_index}},
        {{'n': 'first_has_no_overlap', 'ok': nth != 1 OR o IS NULL}},
        {{'n': 'overlap_of_predecessor', 'ok': nth = 1 OR (o.previous_chunk_id = pid AND o.end_sequence_index = pe AND o.start_sequence_index >= ps AND o.start_sequence_index = start_sequence_index)}},
        {{'n': 'new_follows_predecessor', 'ok': nth = 1 OR new_start_sequence_index = pe + 1}},
        {{'n': 'closure_adds_up', 'ok': cl.reason NOT IN ('closest_after', 'closest_before', 'tie_include') OR (cl.distance_after >= 0 AND CASE cl.reason WHEN 'closest_after' THEN cl.distance_after < cl.distance_before WHEN 'closest_before' THEN cl.distance_before < cl.distance_after ELSE cl.distance_before = cl.distance_after END)}}]) AS x FROM w)
    SELECT x.n AS check_name, count(*) FILTER (NOT coalesce(x.ok, FALSE)) = 0 AS passed, count(*) FILTER (NOT coalesce(x.ok, FALSE)) AS violations FROM k GROUP BY 1""")
def chunk_checks(spark, sf):
    return expect.chunk_checks(_chunks(spark, sf))


@_query("""WITH w AS (SELECT *, lag(start_seconds) OVER (PARTITION BY talk_id ORDER BY source_line, ingested_at) AS b, count(*) OVER (PARTITION BY talk_id, source_line) AS n FROM utterances),
    k AS (SELECT unnest([{'n': 'has_key', 'ok': talk_id IS NOT NULL AND source_line IS NOT NULL}, {'n': 'unique_line', 'ok': n = 1}, {'n': 'has_clock', 'ok': start_seconds IS NOT NULL},
        {'n': 'clock_not_behind', 'ok': b IS NULL OR start_seconds IS NULL OR start_seconds >= b}, {'n': 'has_text', 'ok': coalesce(regexp_matches(text, '[^\\s\\p{Z}\\x1c-\\x1f\\x{85}]'), FALSE)}, {'n': 'no_byte_order_mark', 'ok': NOT coalesce(contains(text, chr(65279)), FALSE)}]) AS x FROM w)
    SELECT x.n AS check_name, count(*) FILTER (NOT x.ok) = 0 AS passed, count(*) FILTER (NOT x.ok) AS violations FROM k GROUP BY 1""")
def utterance_checks(spark, sf):
    return expect.utterance_checks(table(spark, sf, "utterances"))


# --- lexical search -------------------------------------------------------------------------------------------------------------------

_TF = f"{_C}, tf AS (SELECT chunk_id AS id, term, count(*)::BIGINT AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM c WHERE text IS NOT NULL) GROUP BY 1, 2)"
_IDX = f"{_TF}, dl AS (SELECT chunk_id AS id, tokens::BIGINT AS dl FROM c), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1), idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st)"
_ASK = f"""{_T}, qt AS (SELECT talk_id AS query_id, term, count(*) AS qtf FROM (SELECT talk_id, unnest(regexp_extract_all(lower(nfc_normalize(title)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM t WHERE right(talk_id, 7)::INT % 50 = 0) GROUP BY 1, 2),
    sc AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (id), st GROUP BY 1, 2)"""


def _index(spark: SparkSession, sf: str) -> bm25.Index:
    return bm25.build(_chunks(spark, sf), "chunk_id", "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The titles of the talks whose number 50 divides, searched for in all chunks."""
    talks = _talks(spark, sf).where(F.right("talk_id", F.lit(7)).cast("int") % 50 == 0)
    return talks.select(F.col("talk_id").alias("query_id"), F.col("title").alias("query_text"))


@_query(f"WITH {_TF} SELECT id, term, tf FROM tf")
def bm25_tf(spark, sf):
    return bm25.term_counts(_chunks(spark, sf), "chunk_id", "text")


@_query(f"WITH {_IDX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_df_idf(spark, sf):
    return _rounded(_index(spark, sf).terms, "idf")


@_query(f"WITH {_IDX} SELECT id, dl FROM dl")
def bm25_doc_len(spark, sf):
    return _index(spark, sf).docs


@_query(f"WITH {_IDX} SELECT count(*)::BIGINT AS documents, sum(dl)::BIGINT AS tokens, min(dl) AS min_length, round(avg(dl), 6) AS mean_length, quantile_cont(dl, 0.5) AS median_length, max(dl) AS max_length, (SELECT count(*) FROM df) AS vocabulary FROM dl")
def bm25_summary(spark, sf):
    return _rounded(bm25.summary(_index(spark, sf)), "mean_length")


@_query(f"""WITH {_IDX}, pl AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS block FROM dl) SELECT term, block, array_to_string(list(id ORDER BY id), ' ') AS ids, array_to_string(list(tf ORDER BY id), ' ') AS tfs FROM tf JOIN pl USING (id) GROUP BY 1, 2""")
def bm25_postings(spark, sf):
    out = bm25.postings_lists(_index(spark, sf), held=100)
    return out.select("term", "block", F.array_join("ids", " ").alias("ids"), F.array_join(F.col("tfs").cast("array<string>"), " ").alias("tfs"))


@_query(f"WITH {_IDX} SELECT term, row_number() OVER (ORDER BY term) - 1 AS position FROM df")
def bm25_vocab(spark, sf):
    return bm25.vocabulary(_index(spark, sf))


@_query(f"WITH {_IDX}, {_ASK} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id))::INT AS rank, id, round(score, 6) AS score FROM sc QUALIFY rank <= 10")
def bm25_topk(spark, sf):
    return _rounded(bm25.top_k(_index(spark, sf), _asked(spark, sf), 10), "score")


@_query(f"""WITH {_IDX}, {_ASK}, al AS (SELECT query_id, dl.id, coalesce(score, 0) AS score FROM (SELECT talk_id AS query_id FROM t WHERE right(talk_id, 7)::INT % 50 = 0) CROSS JOIN dl LEFT JOIN sc USING (query_id, id))
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id))::INT AS rank, id, round(score, 6) AS score FROM al QUALIFY rank <= 10""")
def bm25_topk_padded(spark, sf):
    return _rounded(bm25.top_k(_index(spark, sf), _asked(spark, sf), 10, pad=True), "score")


@_query(f"""WITH {_IDX}, {_ASK}, h AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id))::INT AS rank, id, round(score, 6) AS score FROM sc QUALIFY rank <= 5)
    SELECT query_id, rank, id, score, talk_id, title, start_sequence_index, end_sequence_index, text, CASE WHEN length(f) <= 220 THEN f ELSE rtrim(substr(f, 1, 219)) || '…' END AS preview
    FROM (SELECT h.*, c.talk_id, c.title, c.start_sequence_index, c.end_sequence_index, c.text, trim(regexp_replace(text, {_SPACE}, ' ', 'g')) AS f FROM h JOIN c ON h.id = c.chunk_id)""")
def search_hits(spark, sf):
    """The best hits with what a reader wants to see of them, and their whole text; a hit that no chunk is known of is an error."""
    hits = cut(_rounded(bm25.top_k(_index(spark, sf), _asked(spark, sf), 5), "score"))
    about = _chunks(spark, sf, hits.select(F.col("id").alias("chunk_id"))).select(F.col("chunk_id").alias("id"), "talk_id", "title", "start_sequence_index", "end_sequence_index", T.preview(F.col("text"), 220).alias("preview"), "text")
    return bm25.described(hits, about)


@_query(f"WITH {_C}, {_M} SELECT chunk_id AS id, 'missing' AS side FROM (SELECT chunk_id FROM c EXCEPT SELECT chunk_id FROM m) UNION ALL SELECT chunk_id, 'unexpected' FROM (SELECT chunk_id FROM m EXCEPT SELECT chunk_id FROM c)")
def index_id_diff(spark, sf):
    return bm25.id_difference(_chunks(spark, sf), _manifest(spark, sf), "chunk_id")


@_query(f"WITH {_IDX}, x AS (SELECT id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1) SELECT chunk_id AS id, token_count AS recorded, coalesce(n, 0) AS indexed FROM c LEFT JOIN x ON chunk_id = id WHERE token_count IS DISTINCT FROM coalesce(n, 0)")
def index_length_check(spark, sf):
    """Chunks whose recorded length isn't the sum of their postings."""
    return bm25.length_check(_index(spark, sf), _chunks(spark, sf), "chunk_id", "token_count")


@_query(f"""WITH {_IDX}, x AS (SELECT id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1), k AS (SELECT unnest([{{'n': 'ids_unique', 'ok': TRUE}}, {{'n': 'none_missing', 'ok': TRUE}}, {{'n': 'none_unexpected', 'ok': TRUE}}, {{'n': 'no_empty_document', 'ok': dl > 0}}, {{'n': 'length_complete', 'ok': dl IS NOT NULL}},
        {{'n': 'postings_of_known_documents', 'ok': TRUE}}, {{'n': 'postings_well_formed', 'ok': TRUE}}, {{'n': 'postings_give_length', 'ok': coalesce(n, 0) = dl}}, {{'n': 'length_reproduces', 'ok': TRUE}}]) AS x FROM dl LEFT JOIN x USING (id)),
    u AS (SELECT x FROM k UNION ALL SELECT {{'n': 'document_count', 'ok': TRUE}} UNION ALL SELECT {{'n': 'terms_match', 'ok': TRUE}} FROM df)
    SELECT x.n AS check_name, count(*) FILTER (NOT x.ok) = 0 AS passed, count(*) FILTER (NOT x.ok) AS violations FROM u GROUP BY 1""")
def index_checks(spark, sf):
    return expect.index_checks(_index(spark, sf), _chunks(spark, sf), "chunk_id", "text")


@_query(f"""WITH {_C}, {_M}, a AS (SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS position, chunk_id AS expected FROM c), b AS (SELECT row_number() OVER (ORDER BY row_index, chunk_id) - 1 AS position, chunk_id AS found FROM m)
    SELECT coalesce(a.position, b.position) AS position, expected, found FROM a FULL JOIN b ON a.position = b.position WHERE expected IS DISTINCT FROM found""")
def index_order_check(spark, sf):
    """Where the manifest's order of chunks isn't the chunks' own."""
    chunks_ = ordered.numbered(_chunks(spark, sf).select("chunk_id"), [], F.substring("chunk_id", 1, 12), ["chunk_id"], "position")
    listed = ordered.numbered(_manifest(spark, sf), [], F.floor(F.col("row_index") / 10_000), ["row_index", "chunk_id"], "position")
    return bm25.order_difference(chunks_, listed, "chunk_id")


# --- dense search ---------------------------------------------------------------------------------------------------------------------

@_query(f"SELECT vec_id, round({_norm_sql('embedding')}, 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@_query(f"""WITH n AS (SELECT {_norm_sql('embedding')} AS n FROM (SELECT DISTINCT row_index, embedding FROM chunk_vectors) WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)
    SELECT count(*)::BIGINT AS vectors, round(min(n), 6) AS min_norm, round(avg(n), 6) AS mean_norm, round(max(n), 6) AS max_norm, round(max(abs(n - 1)), 6) AS max_deviation FROM n""")
def norm_summary(spark, sf):
    rows = table(spark, sf, "chunk_vectors").dropDuplicates(["row_index"])
    return _rounded(vectors.norm_summary(rows, "embedding"), "min_norm", "mean_norm", "max_norm", "max_deviation")


@_query(f"""WITH {_M}, v AS (SELECT DISTINCT row_index, embedding, TRUE AS v FROM chunk_vectors), j AS (SELECT coalesce(v.row_index, m.row_index) AS row_index, embedding AS e, v, m.row_index IS NOT NULL AS m, chunk_id, CASE WHEN chunk_id IS NOT NULL THEN count(*) OVER (PARTITION BY chunk_id) END AS n FROM v FULL JOIN m ON v.row_index = m.row_index),
    k AS (SELECT *, coalesce(len(list_filter(e, lambda x: isnan(x))), 0) AS nan, coalesce(len(list_filter(e, lambda x: isinf(x))), 0) AS inf FROM j),
    w AS (SELECT unnest([{{'n': 'vector_has_id', 'ok': v IS NULL OR m}}, {{'n': 'id_has_vector', 'ok': NOT m OR v IS NOT NULL}}, {{'n': 'id_unique', 'ok': n IS NULL OR n = 1}}, {{'n': 'not_null', 'ok': v IS NULL OR e IS NOT NULL}},
        {{'n': 'dimension', 'ok': v IS NULL OR e IS NULL OR len(e) = 64}}, {{'n': 'no_nan', 'ok': v IS NULL OR nan = 0}}, {{'n': 'no_inf', 'ok': v IS NULL OR inf = 0}},
        {{'n': 'unit_norm', 'ok': v IS NULL OR e IS NULL OR nan > 0 OR inf > 0 OR abs({_norm_sql('e')} - 1) <= 1e-5}}]) AS x FROM k)
    SELECT x.n AS check_name, count(*) FILTER (NOT coalesce(x.ok, FALSE)) = 0 AS passed, count(*) FILTER (NOT coalesce(x.ok, FALSE)) AS violations FROM w GROUP BY 1""")
def vector_checks(spark, sf):
    return expect.vector_checks(table(spark, sf, "chunk_vectors").dropDuplicates(["row_index"]), _manifest(spark, sf), 64)


@_query(f"SELECT vec_id, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1)::INT AS pos, unnest(list_transform(embedding::DOUBLE[], lambda x: x / {_norm_sql('embedding')})) AS x FROM embeddings)")
def normalize_vectors(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.normalized(F.col("embedding"))).alias("pos", "x"))
    return _rounded(unit, "x")


_COS = "SELECT a.vec_id AS query_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) DESC, b.vec_id))::INT AS rank, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"


@_query(f"{_COS} QUALIFY rank <= 5")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(vectors.cosine_top_k(rows, "vec_id", "embedding", asked, 5), "cosine")


@_query(f"{_COS} AND a.vec_id != b.vec_id QUALIFY rank <= 10")
def cosine_topk_batch(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(vectors.cosine_top_k(rows, "vec_id", "embedding", asked, 10, skip_self=True), "cosine")


@_query(f"""WITH {_C}, w AS (SELECT chunk_id AS id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}]+')) AS token FROM c WHERE text IS NOT NULL),
    h AS (SELECT id, ('0x' || substr(md5(token), 1, 6))::BIGINT % 64 AS pos, sum(CASE WHEN ('0x' || substr(md5(token), 7, 1))::INT % 2 = 1 THEN 1 ELSE -1 END) AS x FROM w GROUP BY 1, 2)
    SELECT id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 4) AS x FROM h WHERE x != 0""")
def encode_chunks(spark, sf):
    """All chunks' texts encoded by the built-in encoder, their numbers that aren't 0."""
    out = vectors.encode(_chunks(spark, sf), "chunk_id", "text", longest=8192)
    return out.select("id", F.posexplode("embedding").alias("pos", "x")).where("x != 0").withColumn("x", F.round(F.col("x").cast("double"), 4))


@_query(f"WITH {_C} SELECT chunk_id, tokens FROM c WHERE tokens > 125")
def overlong_inputs(spark, sf):
    """Chunks that an encoder for at most 125 tokens would refuse."""
    return _counted(spark, sf).where("tokens > 125").select("chunk_id", "tokens")


def _vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunk_vectors").dropDuplicates(["row_index"]).join(_manifest(spark, sf), "row_index")
    fine = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(fine)


@_query(f"""WITH {_C}, {_M}, v AS (SELECT DISTINCT row_index, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0 AND row_index IN (SELECT row_index FROM m)),
    h AS (SELECT a.row_index AS query_id, b.row_index AS id, list_cosine_similarity(a.e, b.e) AS cosine, (row_number() OVER (PARTITION BY a.row_index ORDER BY round(list_cosine_similarity(a.e, b.e), 10) DESC, b.row_index))::INT AS rank FROM v a, v b WHERE a.row_index % 50 = 0 QUALIFY rank <= 3)
    SELECT query_id, rank, m.chunk_id AS id, round(cosine, 6) AS score, c.talk_id, c.title, c.chunk_index FROM h JOIN m ON h.id = m.row_index JOIN c ON m.chunk_id = c.chunk_id""")
def vector_hits(spark, sf):
    """The chunks nearest to the asked chunks' vectors, with what is known of them."""
    rows = _vector_rows(spark, sf)
    asked = rows.where("row_index % 50 = 0").select(F.col("row_index").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    near = vectors.cosine_top_k(rows.dropDuplicates(["row_index"]), "row_index", "embedding", asked, 3)
    named = near.join(_manifest(spark, sf), F.col("id") == F.col("row_index")).select("query_id", "rank", F.col("chunk_id").alias("id"), F.round("cosine", 6).alias("score"))
    about = _chunks(spark, sf).select(F.col("chunk_id").alias("id"), "talk_id", "title", "chunk_index")
    return bm25.described(named, about)


@_query(f"""WITH {_C}, {_M}, a AS (SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS position, chunk_id AS e FROM c), b AS (SELECT row_number() OVER (ORDER BY row_index, chunk_id) - 1 AS position, chunk_id AS f FROM m),
    k AS (SELECT 'count_expected' AS check_name, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS ok UNION ALL SELECT 'same_ids', e IS NOT NULL AND f IS NOT NULL FROM (SELECT DISTINCT e FROM a) x FULL JOIN (SELECT DISTINCT f FROM b) y ON e = f
        UNION ALL SELECT 'same_order', coalesce(e = f, FALSE) FROM a FULL JOIN b ON a.position = b.position)
    SELECT check_name, bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS violations FROM k GROUP BY 1""")
def manifest_checks(spark, sf):
    """The vectors' manifest against the chunks: number, ids and order."""
    want = ordered.numbered(_chunks(spark, sf).select("chunk_id"), [], F.substring("chunk_id", 1, 12), ["chunk_id"], "position")
    have = ordered.numbered(_manifest(spark, sf), [], F.floor(F.col("row_index") / 10_000), ["row_index", "chunk_id"], "position")
    return expect.collection_checks(have, want, "chunk_id")


@_query("""WITH k AS (SELECT chunk_id AS key, unnest([CASE WHEN text IS NULL THEN 'text is missing' WHEN trim(text) = '' THEN 'text is blank' END, CASE WHEN talk_id IS NULL THEN 'talk_id is missing' END, CASE WHEN NOT coalesce(token_count > 0, FALSE) THEN 'token_count isn''t positive' END]) AS problem FROM chunks)
    SELECT key, problem FROM k WHERE problem IS NOT NULL UNION ALL SELECT chunk_id, 'chunk_id isn''t unique' FROM chunks GROUP BY chunk_id HAVING count(*) > 1""")
def record_problems(spark, sf):
    """What keeps recorded chunks from being read as records: missing or blank fields, counts that aren't positive, repeated ids."""
    return records.required(table(spark, sf, "chunks"), "chunk_id", "text", "talk_id", positive=("token_count",))


def _subword(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks' tokens by two public tokenizers, the second with the tokens that it puts around a text, and without."""
    a, b, bare = (tokenizers.counter(spark, f"{TOKENIZERS}/{name}", special) for name, special in (("byte_bpe_50k.tiktoken", False), ("piece_bpe_32k.model", True), ("piece_bpe_32k.model", False)))
    text = F.col("text")
    return _chunks(spark, sf).select("chunk_id", "talk_id", a(text).alias("a_tokens"), b(text).alias("b_tokens"), bare(text).alias("b_bare"))


@_query()
def tokenizer_comparison(spark, sf):
    """Every chunk by two subword tokenizers: difference, ratio, the special tokens, and whether the second exceeds a limit."""
    return stats.compare(_subword(spark, sf), "a_tokens", "b_tokens", 512).withColumn("special_tokens", F.col("b_tokens") - F.col("b_bare")).drop("b_bare")


@_query()
def tokenizer_summary(spark, sf):
    """Totals, ratios and signed differences of the two tokenizers over everything and per talk."""
    return _summary(stats.compare_summary(stats.compare(_subword(spark, sf), "a_tokens", "b_tokens", 512), "a_tokens", "b_tokens", "talk_id"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
