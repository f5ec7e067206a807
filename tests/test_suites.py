"""Suites on planted failures, scans of groups that hold most rows, and the smaller operators of the core."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import bm25, chunk, expect, ordered, segment, stats, vectors, windows
from weftline.sources import records


def failed(checks) -> set:
    return {r.check_name for r in checks.collect() if not r.passed}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(t, i, 10 + 2 * i, f"00:00:{i % 60:02d}", i, "room", " ".join(["word"] * n), n) for t, k in (("a", 30), ("b", 1), ("c", 12)) for i, n in enumerate(rng.choices([1, 3, 8, 14, 25], k=k))]
    return spark.createDataFrame(rows, "talk_id string, sequence_index int, source_line int, start_time string, start_seconds int, source_label string, text string, tokens int").cache()


@pytest.fixture(scope="module")
def made(spark, spoken):
    talks = spark.createDataFrame([("a", "e", "A", "Ann"), ("b", "e", "B", None)], "talk_id string, event_id string, title string, primary_speaker string")
    return chunk.records(chunk.chunks(spoken, 40, 10), spoken, talks).cache()


def test_records_hold_their_rows(spark, spoken, made):
    assert failed(expect.record_checks(made, spoken, 40, 10)) == set()
    text = {(r.talk_id, r.sequence_index): r.text for r in spoken.collect()}
    for r in made.collect():
        assert r.text == "\n".join(text[r.talk_id, i] for i in range(r.start_sequence_index, r.end_sequence_index + 1))
        assert [u.is_overlap for u in r.utterances] == [i < r.new_start_sequence_index for i in range(r.start_sequence_index, r.end_sequence_index + 1)]
        assert (r.event_id, r.title) == {"a": ("e", "A"), "b": ("e", "B"), "c": (None, None)}[r.talk_id]
    assert made.where("talk_id = 'a'").count() > 3


@pytest.mark.parametrize(
    "column, value, broken",
    [
        ("text", lambda: F.concat("text", F.lit("x")), {"text_reproduces", "hash_reproduces"}),
        ("content_sha256", lambda: F.lit("0"), {"hash_reproduces"}),
        ("token_count", lambda: F.col("token_count") + 1, {"token_count_reproduces", "closure_adds_up"}),
        ("chunk_index", lambda: F.col("chunk_index") + 1, {"index_consecutive", "id_fits_index"}),
        ("start_source_line", lambda: F.lit(0), {"lines_match_rows"}),
        ("utterance_count", lambda: F.lit(0), {"rows_consecutive"}),
        ("overlap_with_previous", lambda: F.col("overlap_with_previous").withField("previous_chunk_id", F.lit("z")), {"overlap_is_suffix"}),
        ("closure", lambda: F.col("closure").withField("reason", F.lit("tired")), {"closure_known", "closure_adds_up"}),
        ("closure", lambda: F.col("closure").withField("candidate_sequence_index", F.lit(-1)), {"closure_adds_up"}),
        ("new_utterance_count", lambda: F.lit(0), {"new_row", "covered_once", "closure_adds_up"}),
    ],
)
def test_each_fault_of_a_record_is_found(spoken, made, column, value, broken):
    got = failed(expect.record_checks(made.withColumn(column, value()), spoken, 40, 10))
    assert got and got <= broken and broken - got <= {"closure_adds_up"}


def test_faults_between_records_are_found(spark, spoken, made):
    assert {"talks_covered", "covered_once"} <= failed(expect.record_checks(made.where("talk_id != 'b'"), spoken, 40, 10))
    assert {"ids_unique", "index_consecutive"} <= failed(expect.record_checks(made.unionByName(made.where("talk_id = 'b'")), spoken, 40, 10))
    assert "covered_once" in failed(expect.record_checks(made.where("chunk_id != 'a_c0001'"), spoken, 40, 10))
    # the same chunks under other settings: the overlap is too small, or more than is needed
    assert "overlap_reaches" in failed(expect.record_checks(made, spoken, 40, 39)) and "overlap_is_minimal" in failed(expect.record_checks(made, spoken, 40, 1))
    assert failed(expect.record_checks(made.limit(0), spoken.limit(0), 40, 10)) == set()


def test_settings_of_the_chunker():
    good = {"crossing_rule": "closest_to_target", "tie_breaker": "include", "minimum_new_utterances": 1, "target_tokens": 500, "overlap_tokens": 100}
    assert expect.chunk_config_checks(good) == []
    assert expect.chunk_config_checks(good | {"overlap_tokens": 500}) == ["overlap_tokens"]
    assert expect.chunk_config_checks(good | {"target_tokens": 0, "tie_breaker": "leave"}) == ["target_tokens", "tie_breaker"]


def test_talks_are_guarded_built_and_checked(spark):
    d = [("e", "E", "day", "t1", 0, 10, "00:00:00", "00:00:10", "  one\ufeff", "three"), ("e", "E", "day", "t2", 10, 5, "00:00:10", None, None, "other"), ("e", "E", "day", "t3", 4, 9, None, None, None, None), ("e", "E", "day", "t3", 20, 30, None, None, None, None)]
    definitions = spark.createDataFrame(d, "event_id string, event_title string, event_date string, talk_id string, start_seconds int, end_seconds int, start_time string, end_time string, start_marker string, end_marker string")
    definitions = definitions.withColumn("talk_index", F.substring("talk_id", 2, 1).cast("int"))
    rows = spark.createDataFrame([("t1", 3, "00:00:10", "three"), ("t1", 1, "00:00:00", "one"), ("t2", 5, "00:00:11", "five")], "talk_id string, source_line int, start_time string, text string")
    got = {tuple(r) for r in expect.talk_guards(definitions, rows).collect()}
    assert got == {("t2", "inverted range"), ("t2", "overlap"), ("t2", "first time"), ("t2", "last text"), ("t3", "overlap"), ("t3", "duplicate id"), ("t3", "empty")}
    lines = segment.dense_sequence(rows.withColumn("start_seconds", F.lit(1)).withColumn("source_label", F.lit("x")), "talk_id", "source_line", "sequence_index")
    named = definitions.where("talk_id IN ('t1', 't2')").withColumn("ordinal", -F.col("talk_index")).select("event_id", "event_title", "event_date", "talk_id", "ordinal", F.lit("T").alias("title"), F.lit("S").alias("primary_speaker"), F.array(F.lit("S")).alias("speakers"), F.array(F.lit("en")).alias("languages"), F.lit("f").alias("source_file"))
    talks = segment.talk_records(named, lines)
    assert {(r.talk_id, r.talk_index, r.text, r.start_time, r.end_time, r.utterance_count) for r in talks.collect()} == {("t2", 1, "five", "00:00:11", "00:00:11", 1), ("t1", 2, "one\nthree", "00:00:00", "00:00:10", 2)}
    assert failed(expect.talk_checks(talks, "three")) == set() and failed(expect.talk_checks(talks, "BAZ")) == {"phrase_kept"}
    assert failed(expect.talk_checks(talks.withColumn("text", F.concat("text", F.lit("\ufeff"))))) == {"no_byte_order_mark", "text_rebuilt", "hash_reproduces"}
    assert failed(expect.talk_checks(talks.withColumn("utterances", F.reverse("utterances")))) >= {"source_order", "sequence_consecutive", "text_rebuilt"}


def test_index_suite_vocabulary_and_copies_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "a b a"), ("d2", "b c"), ("d3", "é Z"), ("d4", None)], "id string, text string")
    index = bm25.build(docs, "id", "text")
    assert failed(expect.index_checks(index, docs, "id", "text")) == {"no_empty_document"}
    assert failed(expect.index_checks(index, docs.where("id != 'd1'").unionByName(docs.limit(1).withColumn("id", F.lit("d9"))), "id", "text")) == {"no_empty_document", "none_missing", "none_unexpected"}
    index.postings = index.postings.withColumn("tf", F.when(F.col("term") == "c", 0).otherwise(F.col("tf")))
    assert failed(expect.index_checks(index, docs, "id", "text")) == {"no_empty_document", "postings_well_formed", "postings_give_length"}
    index.terms = index.terms.where("term != 'b'")
    assert "terms_match" in failed(expect.index_checks(index, docs, "id", "text"))
    index = bm25.build(docs, "id", "text")
    assert [r.term for r in bm25.vocabulary(index).orderBy("position").collect()] == ["a", "b", "c", "z", "é"]
    bm25.save(index, f"{tmp_path}/index")
    ask = spark.createDataFrame([(1, "a b"), (2, "?!")], "query_id int, query_text string")
    found = [sorted(map(tuple, bm25.top_k(i, ask, 3).collect())) for i in (index, bm25.load(spark, f"{tmp_path}/index"))]
    assert found[0] == found[1] and len(found[0]) == 2
    with pytest.raises(ValueError):
        bm25.scores(index, ask, strict=True)
    about = docs.select("id", "text").where("id = 'd1'")
    with pytest.raises(Exception, match="nothing is known of d2"):
        bm25.described(bm25.top_k(index, ask, 3), about).collect()
    lists = bm25.postings_lists(index, held=1).where("term = 'b'").orderBy("block").collect()
    assert [(r.block, r.ids, r.tfs) for r in lists] == [(0, ["d1"], [1]), (1, ["d2"], [1])]
    ids = docs.select("id").withColumn("position", F.substring("id", 2, 1).cast("bigint"))
    assert bm25.order_difference(ids, ids, "id").count() == 0 and bm25.order_difference(ids, ids.where("position < 4").withColumn("position", 4 - F.col("position")), "id").count() == 3
    assert failed(expect.collection_checks(ids.withColumn("position", 5 - F.col("position")), ids, "id")) == {"same_order"}


def test_a_group_with_most_rows_is_scanned_in_blocks(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 10 else f"g{i % 7}", i, rng.randrange(50)) for i in range(3000)] + [(None, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    want, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, total, last = seen.get(g, (0, 0, None))
        want[g, i] = (n, total, last)
        seen[g] = n + 1, total + v, v
    block = F.floor(F.col("i") / 100)
    summed = ordered.prefix_sums(df.withColumn("b", block), ["g"], "b", ["i"], n=F.lit(1), total=F.col("v"))
    out = ordered.previous(summed, ["g"], block, ["i"], last="v").collect()
    assert {(r.g, r.i): (r.n, r.total, r.last) for r in out} == want and len(out) == len(rows)
    behind = segment.inversions(df.where("g IS NOT NULL"), ["g"], "i", "v", held=50)
    assert behind.count() == sum(last is not None and last > v for (g, i), (n, t, last) in want.items() if g for v in [dict(((a, b), c) for a, b, c in rows)[g, i]])


def test_windows_cross_blocks_and_stretches(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 9) for _ in range(400)]
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(sizes)], "talk_id string, source_line int, tokens int")
    got = {(r.source_line, r.threshold): (r.rows, r.reached) for r in windows.to_threshold(df, "talk_id", "source_line", "tokens", [5, 60, 900], held=30, span=40).collect()}
    for i in range(len(sizes)):
        for t in (5, 60, 900):
            total, want = 0, (None, None)
            for j in range(i, len(sizes)):
                total += sizes[j]
                if total >= t:
                    want = (j - i + 1, total)
                    break
            assert got[i, t] == want, (i, t)


def test_outliers_are_ranked(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1] * 40 + [2] * 40 + [90, 70, 90])], "id int, v int")
    assert [(r.rank, r.id) for r in stats.outliers(df, "v", "id").orderBy("rank").collect()] == [(1, 80), (2, 82), (3, 81)]
    assert stats.largest(df, "v", "id").first().id == 80


def test_many_queries_meet_vectors_in_blocks(spark):
    x = np.random.default_rng(0).standard_normal((120, 6)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None)], "id bigint, e array<float>")
    asked = df.select(F.col("id").alias("query_id"), F.col("e").alias("embedding"))
    few, many = ({(r.query_id, r.rank): r.id for r in vectors.cosine_top_k(df, "id", "e", asked, 4, skip_self=True, most_queries=m, held=50).collect()} for m in (4096, 16))
    assert few == many and len(few) == 480


def test_encoder_refuses_what_is_too_long(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, text string")
    assert {r.id: sum(v * v for v in r.embedding) for r in vectors.encode(df, "id", "text", longest=3).collect()} == {1: pytest.approx(1), 2: 0}
    with pytest.raises(Exception, match="too long: 1"):
        vectors.encode(df, "id", "text", longest=2).collect()


def test_malformed_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y", "n": 0}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "x", "n": 1}\n{"id": \n{"id": "z", "n": "many"}\n')
    (tmp_path / "c.jsonl").write_text("")
    schema = "id STRING, n INT"
    rows = records.read_jsonl(spark, f"{tmp_path}/a.jsonl", schema)
    assert {(r.key, r.problem) for r in records.required(rows, "id", "id", positive=("n",)).collect()} == {("y", "n isn't positive")}
    with pytest.raises(ValueError, match="b.jsonl, line 2"):
        records.read_jsonl(spark, f"{tmp_path}/b.jsonl", schema)
    assert [r.source_line for r in records.malformed(spark, f"{tmp_path}/b.jsonl", schema).orderBy("source_line").collect()] == [2, 3]
    with pytest.raises(ValueError):
        records.read_jsonl(spark, f"{tmp_path}/c.jsonl", schema)
    assert records.read_jsonl(spark, f"{tmp_path}/c.jsonl", schema, empty_ok=True).count() == 0
    (tmp_path / "d.json").write_text('{"id":\n "x",\n "n": 3}')
    assert [tuple(r) for r in records.read_json(spark, f"{tmp_path}/d.json", schema).collect()] == [("x", 3)]


def test_counters_of_public_tokenizers(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    from weftline.functions import tokenizers as T
    from weftline.plans.queries import TOKENIZERS

    texts = ["Hello, world! It's 12:30.", "", "日本語のテキスト", "naïve café — résumé", "  spaced   out\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    model = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    words = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    same = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    cases = {
        "byte_bpe_50k.tiktoken": lambda t: len(same.encode(t, add_special_tokens=False).ids),
        "word_bpe_49k.json": lambda t: len(words.encode(t, add_special_tokens=False).ids),
        "piece_bpe_32k.model": lambda t: len(model.encode(t)),
    }
    for name, want in cases.items():
        got = {r.i: r.n for r in df.select("i", T.counter(spark, f"{TOKENIZERS}/{name}")(F.col("t")).alias("n")).collect()}
        assert got == {i: want(t) for i, t in enumerate(texts)} | {9: 0}, name
    assert [r.n for r in df.where("i = 0").select(T.counter(spark, f"{TOKENIZERS}/piece_bpe_32k.model", special=True)(F.col("t")).alias("n")).collect()] == [len(model.encode(texts[0])) + 2]
