"""The training-data queries: against SQL where there is some, against labels, brute force and bounds otherwise."""

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from weftline.llm import queries as llm
from weftline.session import table

Q, SQL = llm.queries(), llm.oracle_sql()
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = same(Q[name](spark, str(DATA)), duck.sql(SQL[name]))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_others_run(spark, name):
    assert Q[name](spark, str(DATA)).count() >= 0


def test_turns_agree_with_labels(spark):
    from weftline.llm import turns

    u, s = table(spark, LARGER, "utterances"), table(spark, LARGER, "speakers")
    labels = table(spark, LARGER, "utterance_labels").distinct()
    mine = turns.merged(turns.spoken_rows(u, s)).select("talk_id", "source_line", F.col("speaker_id").alias("mine"))
    both = labels.join(mine, ["talk_id", "source_line"], "left")
    wrong = both.where((F.col("is_spoken") != F.col("mine").isNotNull()) | ~F.col("speaker_id").eqNullSafe(F.col("mine")))
    assert wrong.count() <= 0.01 * labels.count()


def test_sentences_agree_with_labels(spark):
    labels = table(spark, LARGER, "sentence_labels").select("doc_id", "start_char", "end_char")
    mine = Q["p8_found"](spark, LARGER).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    hit = mine.intersect(labels.select(*mine.columns)).count()
    assert hit >= 0.97 * labels.count() and hit >= 0.97 * mine.count()


def test_neighbours_recall(spark):
    import numpy as np

    from weftline.llm import neighbors

    rows = neighbors.assigned(table(spark, LARGER, "chunk_vectors"), table(spark, LARGER, llm.MANIFEST))
    data = rows.orderBy("row_index").collect()
    x = np.array([r.embedding for r in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.row_index for r in data])
    near = x @ x.T
    np.fill_diagonal(near, -2)
    mine: dict = {}
    for r in Q["p5_neighbors"](spark, LARGER).collect():
        mine.setdefault(r.row_index, set()).add(r.neighbor)
    asked = [i for i, v in enumerate(ids) if v % 50 == 0]
    share = np.mean([len(mine.get(int(ids[i]), set()) & {int(ids[j]) for j in np.argsort(-near[i])[:5]}) / 5 for i in asked])
    assert share >= 0.9


def test_packing_keeps_every_token_and_no_container_overflows(spark):
    placed = Q["p6_containers"](spark, LARGER).persist()
    full = placed.where("container IS NOT NULL")
    assert full.groupBy("container_name", "container").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c")).where("t > c").count() == 0
    from weftline.llm import packing

    docs = packing.counted_documents(table(spark, LARGER, "documents"))
    sums = placed.groupBy("container_name", "doc_id").agg(F.sum("tokens").alias("s"))
    assert sums.join(docs, "doc_id").where("s = tokens").count() == 3 * docs.count()
    assert all(r.containers <= 1.03 * r.least_containers + 1 for r in packing.fill_report(placed).collect())


def test_mix_reaches_its_shares(spark):
    rows = Q["p7_shares"](spark, LARGER).collect()
    assert rows and all(r.most_uses <= 8 for r in rows)
    for r in rows:
        if not r.short:
            assert abs(r.tokens - r.wanted_tokens) <= 0.02 * sum(x.wanted_tokens for x in rows if x.mix_name == r.mix_name) + 3000
    caps = {(r.mix_name, r.source): r.max_repeats for r in table(spark, LARGER, "mix_targets").collect()}
    assert all(r.most_uses <= caps[r.mix_name, r.source] for r in rows)
