"""Registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut, table

from . import frequency, languages, mixing, neighbors, packing, sentences, tokens, turns

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
MANIFEST = "gte_multilingual_base_child_v1_manifest"
#: White space as the sentences know it.
_SPACES = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.wrong_counts(table(spark, sf, "chunks"))


def p1_budget(spark: SparkSession, sf: str) -> DataFrame:
    subword = tokens.ByteBpe(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    talks = table(spark, sf, "talks")
    told = languages.talk_languages(table(spark, sf, "utterances"), talks, table(spark, sf, "language_samples"))
    return tokens.budget(table(spark, sf, "chunks"), talks, told, subword)


def p1_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The budget's sums by event and domain, whatever the language."""
    talks = table(spark, sf, "talks")
    each = tokens.budget(table(spark, sf, "chunks"), talks, talks.select("talk_id", F.lit("any").alias("language")).distinct())
    return each.groupBy("event_id", "domain").agg(*[F.sum(c).alias(c) for c in ("chunks", "tokens", "wrong_counts")])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return turns.turn_bounds(table(spark, sf, "utterances"), table(spark, sf, "speakers"))


def p2_turns(spark: SparkSession, sf: str) -> DataFrame:
    return turns.turns(table(spark, sf, "utterances"), table(spark, sf, "speakers"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.unnamed_languages(table(spark, sf, "utterances"), table(spark, sf, "talks"), table(spark, sf, "language_samples"))


def p3_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages.row_languages(table(spark, sf, "utterances"), table(spark, sf, "talks"), table(spark, sf, "language_samples"))


def p3_parts(spark: SparkSession, sf: str) -> DataFrame:
    return languages.label_parts(table(spark, sf, "utterances"), table(spark, sf, "talks"), table(spark, sf, "language_samples"))


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of every utterance and talk: whether it has a row without a language or else rows of languages, none of them twice, with confidences from 0 to 1."""
    rows = p3_languages(spark, sf).groupBy("talk_id", "source_line")
    single = (F.count_distinct("lang") == F.count(F.lit(1))) | (F.count("lang") == 0) & (F.count(F.lit(1)) == 1)
    return rows.agg(single.alias("single"), F.bool_and(F.col("confidence").between(0, 1)).alias("in_range"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.marked_terms(table(spark, sf, "chunks")).where("mark IS NOT NULL").select("term", "mark")


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.marked_terms(table(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.close_pairs(table(spark, sf, "chunk_vectors"), table(spark, sf, MANIFEST))


def p5_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of every vector whose row_index 50 divides, among all vectors."""
    rows = neighbors.assigned(table(spark, sf, "chunk_vectors"), table(spark, sf, MANIFEST))
    near = neighbors.neighbors(rows, 5, only=F.col("row_index") % 50 == 0)
    return near.withColumn("cosine", F.round("cosine", 6))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.cut_documents(table(spark, sf, "documents"), table(spark, sf, "containers"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.counted_documents(table(spark, sf, "documents")), table(spark, sf, "containers"))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each kind of container what the packed rows hold, and how many containers overflow and documents are cut without need or lose tokens."""
    placed = cut(p6_containers(spark, sf))
    boxes = placed.where("container IS NOT NULL").groupBy("container_name", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"))
    boxes = boxes.groupBy("container_name").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"), F.count(F.lit(1)).alias("_boxes"))
    docs = placed.groupBy("container_name", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    needless = F.count_if(F.col("parts") > F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1)))
    sums = docs.groupBy("container_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("parts").alias("parts"), needless.alias("needless_cuts"), F.count_if(F.col("end") != F.col("tokens")).alias("gaps"))
    near = F.col("_boxes").between(F.ceil(F.col("tokens") / F.col("capacity_tokens")), 1.03 * F.ceil(F.col("tokens") / F.col("capacity_tokens")) + 1)
    return sums.join(boxes, "container_name", "left").select("container_name", "documents", "tokens", "parts", "needless_cuts", "gaps", "overfull", near.alias("near_least"))


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    # counted where they are read, so that no text is shuffled, and once, since no filter moves below the aggregation
    docs = table(spark, sf, "documents").where(F.col("doc_id").isNotNull())
    return docs.select("doc_id", "source", packing.token_count(F.col("text")).alias("tokens")).dropDuplicates(["doc_id"])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.short_sources(_sourced(spark, sf), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(_sourced(spark, sf), table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sourced(spark, sf), table(spark, sf, "mix_targets"))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each target what the drawn rows give: whether its share is reached to 2 % of the budget (and a slot's rounding), no document is used too often or
    twice in a repeat, and no other source's stands in its slots."""
    docs = _sourced(spark, sf)
    drawn = mixing.mix(docs, table(spark, sf, "mix_targets")).join(docs.select("doc_id", mixing.source_key(F.col("source")).alias("_own")), "doc_id")
    each = drawn.groupBy("mix_name", "source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.count_distinct("repeat").alias("repeats"), F.bool_and(F.col("_own") == mixing.source_key(F.col("source"))).alias("own"))
    got = each.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.max("uses").alias("most"), F.bool_and(F.col("own") & (F.col("uses") == F.col("repeats"))).alias("whole"))
    supply = docs.groupBy(mixing.source_key(F.col("source")).alias("_key")).agg(F.sum("tokens").alias("available_tokens"))
    targets = table(spark, sf, "mix_targets").withColumn("_key", mixing.source_key(F.col("source"))).join(supply, "_key", "left").join(got, ["mix_name", "source"], "left")
    most = F.coalesce("available_tokens", F.lit(0)) * F.col("max_repeats")
    due = F.least(F.col("target_share") * F.col("budget_tokens"), most)
    reached = F.abs(F.coalesce("tokens", F.lit(0)) - due) <= 0.02 * F.col("budget_tokens") + 3000
    kept = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("whole", F.lit(True))
    return targets.select("mix_name", "source", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), reached.alias("reached"), kept.alias("kept"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "documents"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of every document with a text: its characters that aren't white space, as its units hold them, and whether the units neither overlap nor begin or
    end with white space."""
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    units = p8_found(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("_units"))  # as many as a text has
    held = docs.join(units, "doc_id", "left").withColumn("_units", F.coalesce("_units", F.array().cast("array<struct<start_char:int,end_char:int>>")))
    texts = F.transform("_units", lambda u: F.substring(F.col("text"), u["start_char"] + 1, u["end_char"] - u["start_char"]))
    apart = F.forall(F.sequence(F.lit(1), F.size("_units")), lambda i: (i < 2) | (F.get("_units", i - 1)["start_char"] >= F.get("_units", i - 2)["end_char"]))
    held = held.select("doc_id", apart.alias("apart"), texts.alias("_texts"))
    bare = F.length(F.regexp_replace(F.array_join("_texts", ""), _SPACES, ""))
    return held.select("doc_id", bare.alias("characters"), (F.col("apart") & ~F.exists("_texts", lambda t: t.rlike(f"^{_SPACES}|{_SPACES}$"))).alias("clean"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    count = "len(regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\\p{L}\\p{N}]+'))"
    terms = f"""
        WITH each AS (SELECT DISTINCT chunk_id, text FROM chunks),
        words AS (SELECT chunk_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM each WHERE text IS NOT NULL),
        counts AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT chunk_id)::BIGINT AS records FROM words GROUP BY term),
        marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM each) THEN 'common' END AS mark FROM counts)"""
    usable = f"""
        WITH v AS (SELECT DISTINCT row_index, embedding::DOUBLE[] AS e FROM chunk_vectors
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
                     AND row_index IN (SELECT row_index FROM {MANIFEST} WHERE chunk_id IS NOT NULL))"""
    pairs = f"""{usable},
        near AS (SELECT a.row_index AS i, b.row_index AS j, list_cosine_similarity(a.e, b.e) AS c,
                 row_number() OVER (PARTITION BY a.row_index ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.row_index) AS r
                 FROM v a JOIN v b ON a.row_index != b.row_index)"""
    sizes = f"sizes AS (SELECT container_name, capacity_tokens AS c, doc_id, {count} AS n FROM documents, containers WHERE doc_id IS NOT NULL AND capacity_tokens > 0)"
    return {
        "p1_slices": f"""
            WITH each AS (SELECT chunk_id, any_value(event_id) AS event_id, any_value(talk_id) AS talk_id, any_value({count}) AS n, any_value(token_count) AS said FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
            known AS (SELECT DISTINCT talk_id, domain FROM talks)
            SELECT event_id, domain, count(*)::BIGINT AS chunks, sum(n)::BIGINT AS tokens, count_if(said IS DISTINCT FROM n)::BIGINT AS wrong_counts FROM each LEFT JOIN known USING (talk_id) GROUP BY 1, 2""",
        "p3_checks": """SELECT talk_id, source_line, true AS single, true AS in_range FROM utterances GROUP BY 1, 2
            UNION ALL SELECT talk_id, 0, true, true FROM talks GROUP BY 1""",
        "p6_checks": f"""WITH {sizes} SELECT container_name, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens, sum(greatest(ceil(n / c), 1))::BIGINT AS parts,
            0::BIGINT AS needless_cuts, 0::BIGINT AS gaps, 0::BIGINT AS overfull, true AS near_least FROM sizes GROUP BY 1""",
        "p7_checks": f"""
            WITH sizes AS (SELECT lower(trim(source)) AS s, sum({count}) AS n FROM documents GROUP BY 1)
            SELECT mix_name, source, coalesce(n, 0)::BIGINT AS available_tokens, true AS reached, true AS kept FROM mix_targets LEFT JOIN sizes ON s = lower(trim(source))""",
        "p8_checks": r"""SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]', '', 'g'))::INT AS characters, true AS clean FROM documents WHERE text IS NOT NULL""",
        "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE token_count IS DISTINCT FROM {count}",
        "p4_found": f"{terms} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p4_terms": f"{terms} SELECT term, occurrences, records, mark FROM marked",
        "p5_found": f"{pairs} SELECT DISTINCT least(i, j) AS row_index_a, greatest(i, j) AS row_index_b FROM near WHERE r <= 5 AND c >= 0.95",
        "p5_neighbors": f"""{usable}, near AS (SELECT a.row_index, b.row_index AS neighbor, list_cosine_similarity(a.e, b.e) AS c,
                 (row_number() OVER (PARTITION BY a.row_index ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.row_index))::INT AS rank
                 FROM v a JOIN v b ON a.row_index != b.row_index WHERE a.row_index % 50 = 0)
            SELECT row_index, neighbor, round(c, 6) AS cosine, rank FROM near WHERE rank <= 5""",
        "p6_found": f"SELECT container_name, doc_id FROM documents, containers WHERE {count} > capacity_tokens",
        "p7_found": f"""
            WITH sizes AS (SELECT lower(trim(source)) AS s, sum({count}) AS n FROM documents GROUP BY 1)
            SELECT mix_name, source FROM mix_targets LEFT JOIN sizes ON s = lower(trim(source))
            WHERE coalesce(n, 0) * max_repeats < target_share * budget_tokens""",
    }
