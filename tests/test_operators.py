import math
import random

import numpy as np
import pytest
from conftest import shuffled
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import bm25, chunk, expect, ordered, provenance, segment, stats, vectors, windows
from weftline.sources import records, transcripts


def test_prefix_sum_over_blocks(spark):
    random.seed(1)
    rows = [(g, i // 7, i, random.randint(0, 9)) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, b int, i int, v int")
    got = {(r.g, r.i): r.s for r in ordered.prefix_sum(df, ["g"], "b", ["i"], F.col("v"), "s").collect()}
    for g in ("a", "b", None):
        total = 0
        for r in rows:
            if r[0] == g:
                assert got[g, r[2]] == total
                total += r[3]


def literal_chunks(sizes, target, overlap):
    """The fold as the rules read, over one talk."""
    out, carried, at = [], [], 0
    while at < len(sizes):
        current, new, reason = list(carried), [], None
        while at < len(sizes):
            before = sum(n for _, n in current)
            after = before + sizes[at]
            if not new:
                take, reason = True, "exact_target" if after == target else "forced_progress_over_target" if after > target else None
            elif after < target:
                take, reason = True, None
            elif after == target:
                take, reason = True, "exact_target"
            else:
                a, b = after - target, target - before
                take, reason = (True, "tie_include" if a == b else "closest_after") if a <= b else (False, "closest_before")
            if take:
                current.append((at, sizes[at]))
                new.append(at)
                at += 1
            if reason:
                break
        out.append((current[0][0], new[0], current[-1][0], sum(n for _, n in current), reason or "end_of_talk"))
        carried, total = [], 0
        for row in reversed(current):
            if total >= overlap:
                break
            carried.insert(0, row)
            total += row[1]
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(2, 80), st.integers(0, 40))
def test_chunks_are_the_literal_fold(spark, talks, target, overlap):
    overlap = min(overlap, target - 1)
    rows = [(f"t{t}", i, n) for t, sizes in enumerate(talks) for i, n in enumerate(sizes)]
    made = chunk.chunks(spark.createDataFrame(rows, "talk_id string, sequence_index int, tokens int"), target, overlap)
    got = {}
    for r in made.orderBy("talk_id", "chunk_index").collect():
        got.setdefault(r.talk_id, []).append((r.start_sequence_index, r.new_start_sequence_index, r.end_sequence_index, r.token_count, r.reason))
    assert got == {f"t{t}": literal_chunks(sizes, target, overlap) for t, sizes in enumerate(talks)}
    assert chunk.coverage(made, spark.createDataFrame(rows, "talk_id string, sequence_index int, tokens int")).where("NOT once").count() == 0


def test_crossing_rule():
    assert chunk.crossing(480, 580, 500, True) == (False, "closest_before")
    assert chunk.crossing(471, 505, 500, True) == (True, "closest_after")
    assert chunk.crossing(350, 650, 500, True) == (True, "tie_include")
    assert chunk.crossing(600, 700, 500, False)[0]


def test_chunks_of_nothing(spark):
    assert chunk.chunks(spark.createDataFrame([], "talk_id string, sequence_index int, tokens int"), 10, 2).count() == 0
    with pytest.raises(ValueError):
        chunk.chunks(spark.createDataFrame([], "talk_id string, sequence_index int, tokens int"), 10, 10)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 120))
def test_windows_against_brute_force(spark, sizes, threshold):
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(sizes)], "g string, i int, n int")
    got = {r.i: (r.rows, r.reached) for r in windows.to_threshold(df, "g", "i", "n", [threshold]).collect()}
    for i in range(len(sizes)):
        want = next(((j - i + 1, sum(sizes[i : j + 1])) for j in range(i, len(sizes)) if sum(sizes[i : j + 1]) >= threshold), (None, None))
        assert got[i] == want


def test_window_fixture(spark):
    df = spark.createDataFrame([("t", i, 100) for i in range(4)], "g string, i int, n int")
    r = windows.threshold_stats(windows.to_threshold(df, "g", "i", "n", [250]), "g").where("scope IS NULL").first()
    assert (r.reaching, r.tails, r.median_rows) == (2, 2, 3.0)


def test_percentiles_histogram_and_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "v int, s string")
    r = stats.describe(df, "v").first()
    assert (r.p25, r.p75) == (1.75, 3.25)
    empty = stats.describe(df.where("v > 9"), "v").first()
    assert empty["count"] == 0 and empty.p50 is None
    h = stats.histogram(df, "v").collect()
    assert len(h) == len(stats.TOKEN_BINS) and sum(x["count"] for x in h) == 4
    tie = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, None)], "s string, o int, v int")
    assert {(r.s, r.o) for r in stats.first_largest(tie, "v", "o", "s").collect()} == {("a", 1), ("b", 1)}


def test_interval_join_is_the_range_join(spark):
    random.seed(2)
    p = [(i, random.randint(0, 500)) for i in range(120)]
    s = [(j, a := random.randint(0, 500), a + random.randint(-5, 90)) for j in range(40)]
    got = segment.interval_join(spark.createDataFrame(p, "i int, at int"), "at", spark.createDataFrame(s, "j int, a int, b int"), "a", "b", 50)
    assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i, at in p for j, a, b in s if a <= at <= b}


def test_bm25_against_a_loop(spark):
    docs = [("d1", "red fish blue fish"), ("d2", "red car"), ("d3", ""), ("d4", None), ("d5", "Blue BLUE fish"), ("d6", "red fish blue fish")]
    queries = [("q1", "blue fish fish"), ("q2", "nothing here"), ("q3", None)]
    index = bm25.build(spark.createDataFrame(docs, "id string, text string"), "id", "text")
    got = bm25.top_k(index, spark.createDataFrame(queries, "query_id string, query_text string"), 4, pad=True).orderBy("query_id", "rank").collect()
    words = {d: (t or "").lower().split() for d, t in docs}
    avg = sum(map(len, words.values())) / len(docs)

    def score(q, d):
        s = 0.0
        for w in (q or "").lower().split():
            df, tf = sum(w in x for x in words.values()), words[d].count(w)
            if df:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[d]) / avg))
        return s

    for q, text in queries:
        want = sorted(words, key=lambda d: (-round(score(text, d), 10), d))[:4]
        mine = [r for r in got if r.query_id == q]
        assert [r.id for r in mine] == want
        assert all(abs(r.score - score(text, r.id)) < 1e-9 for r in mine)
    assert {r.id for r in bm25.length_check(index, index.docs.select("id", F.when(F.col("id") == docs[0][0], F.col("dl") + 1).otherwise(F.col("dl")).alias("n")), "id", "n").collect()} == {docs[0][0]}
    with pytest.raises(ValueError):
        bm25.top_k(index, spark.createDataFrame(queries, "query_id string, query_text string"), 0)
    assert bm25.summary(bm25.build(spark.createDataFrame([], "id string, text string"), "id", "text")).first().documents == 0


def test_bm25_shuffles_many_asked_terms_with_equal_results(spark, monkeypatch):
    # one term in nine of ten documents
    docs = [(f"d{i:03}", "hot " * (1 + i % 3) + (f"w{i % 7}" if i % 10 else "cold")) for i in range(300)]
    index = bm25.build(spark.createDataFrame(docs, "id string, text string"), "id", "text")
    ask = spark.createDataFrame([("q1", "hot cold"), ("q2", "w3 w3 hot"), ("q3", None), ("q4", "nowhere")], "query_id string, query_text string")
    few = sorted(map(tuple, bm25.top_k(index, ask, 20).collect()))
    monkeypatch.setattr(bm25, "MOST_SENT", 0)
    assert sorted(map(tuple, bm25.top_k(index, ask, 20).collect())) == few and {r[0] for r in few} == {"q1", "q2"}


def test_bm25_search_shuffles_the_best_pairs_only(spark):
    # every query shares a term with every document: 2000 x 60 pairs, of which a task keeps 2 a query
    docs = spark.createDataFrame([(f"d{i:04}", "hot " * (1 + i % 3) + f"w{i % 11}") for i in range(2000)], "id string, text string")
    index = bm25.build(docs, "id", "text")
    ask = spark.createDataFrame([(f"q{i:02}", f"hot w{i % 11}" if i else "nowhere") for i in range(61)], "query_id string, query_text string")
    found = bm25.top_k(index, ask, 2)
    assert shuffled(found)[0] < 2000 * 60 / 10
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "id")
    want = bm25.scores(index, ask).withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    near = [sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in x.collect()) for x in (found, want)]
    assert near[0] == near[1] and len(near[0]) == 120
    assert bm25.top_k(index, ask.where("query_id = 'q00'"), 2).count() == 0


def test_bm25_padded_search_shuffles_the_best_pairs_only(spark):
    docs = spark.createDataFrame([(f"d{i:04}", "hot " * (1 + i % 3) + f"w{i % 11}") for i in range(2000)], "id string, text string")
    index = bm25.build(docs, "id", "text")
    ask = spark.createDataFrame([(f"q{i:02}", f"hot w{i % 11}" if i else "nowhere") for i in range(61)], "query_id string, query_text string")
    found = bm25.top_k(index, ask, 2, pad=True)
    assert shuffled(found)[0] < 2000 * 60 / 10
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # the search isn't run again by each use of its hits
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()}
    assert len(got) == 122 and (got["q00", 1], got["q00", 2]) == (("d0000", 0.0), ("d0001", 0.0))
    assert {(q, n): d for (q, n), (d, _) in got.items() if q != "q00"} == {(r.query_id, r["rank"]): r.id for r in bm25.top_k(index, ask, 2).collect()}


def test_cosine_search_and_bad_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (6, [2.0, 0.0])]
    df = spark.createDataFrame(v, "id bigint, e array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    got = vectors.cosine_top_k(df, "id", "e", asked, 10).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(9, 0), (9, 6), (9, 1), (9, 2)]
    assert np.allclose([r.cosine for r in got], [1, 1, 0.8, -1], atol=1e-6)
    assert [r[0] for r in df.orderBy("id").select(vectors.normalized(F.col("e"))).collect()][3] is None


def test_vector_and_chunk_expectations(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 0.0]), (3, [0.5, 0.5])], "row_index bigint, embedding array<float>")
    m = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (7, "c")], "row_index bigint, chunk_id string")
    got = {r.check_name: r.violations for r in expect.vector_checks(v, m, 2).collect()}
    assert got == {"vector_has_id": 1, "id_has_vector": 1, "id_unique": 2, "not_null": 0, "dimension": 0, "no_nan": 1, "no_inf": 1, "unit_norm": 1}
    s = expect.status(expect.vector_checks(v, m, 2)).first()
    assert not s.passed and "no_nan" in s.failed
    assert expect.config_checks({"target": 0, "kind": "x"}, {"target": lambda t: t > 0, "kind": "x"}) == ["target"]


def test_lines_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿00:00:01 [>> Ana - Host] Hi\r\n\r\nnoise  00:00:09 [x]\n00:00:02 [Bo]\n00:00:03 [Bo] café\n".encode())
    rows = transcripts.lines(spark, str(tmp_path))
    assert [r.source_line for r in rows.orderBy("source_line").collect()] == [1, 2, 3, 4, 5, 6]
    said = transcripts.utterances(rows).orderBy("source_line").collect()
    assert [(r.source_line, r.start_seconds, r.source_label, r.text) for r in said] == [(1, 1, "Ana", "Hi"), (6, 3, "Bo", "café")]
    assert [r.line for r in transcripts.rejects(rows).orderBy("source_line").collect()] == ["noise", "00:00:09 [x]"]
    bad = spark.createDataFrame([("f", 1, "00:61:00 [A] x")], "source_file string, source_line int, line string")
    with pytest.raises(Exception):
        transcripts.utterances(bad).collect()


def test_records_and_provenance(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", " "), ("b", None)], "id string, text string")
    records.write_jsonl(rows, str(tmp_path / "r"))
    back = records.read_jsonl(spark, str(tmp_path / "r"), "id STRING, text STRING")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert {(r.key, r.problem) for r in records.required(back, "id", "text").collect()} == {("b", "text is blank"), ("b", "text is missing"), ("b", "id isn't unique")}
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError):
        records.read_jsonl(spark, str(tmp_path / "e.json"), "id STRING")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("one")
    seen = provenance.file_manifest(spark, str(tmp_path / "d")).collect()
    seen = spark.createDataFrame([tuple(r) for r in seen], "path string, bytes bigint, sha256 string")
    assert provenance.changed_files(spark, seen, str(tmp_path / "d")).count() == 0
    (tmp_path / "d" / "x.txt").write_text("two")
    assert provenance.changed_files(spark, seen, str(tmp_path / "d")).count() == 1


def test_stream_of_lines(spark, tmp_path):
    from weftline.streaming import ingest

    src = tmp_path / "in"
    rows = [("f", 1, "00:00:01 [A] hi"), ("f", 1, "00:00:01 [A] hi"), ("f", 2, "noise")]
    spark.createDataFrame(rows, "source_file string, source_line int, line string").withColumn("arrived", F.lit("2026-01-01 00:00:00").cast("timestamp")).write.parquet(str(src))
    q = ingest.first_copies(ingest.line_stream(spark, str(src))).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lines").count() == 2 and spark.table("lines").where("matched").count() == 1
