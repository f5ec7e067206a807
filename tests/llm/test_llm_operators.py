"""Small cases of the training-data operators: nulls, blanks, ties, repeats, empty tables, clashing names, very long texts."""

import base64
import datetime as dt
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from weftline.llm import frequency, langnames, languages, mixing, neighbors, packing, sentences, tokens, turns

NOW = dt.datetime(2026, 1, 1)
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LANGS = ["ar", "de", "en", "es", "fr", "hi", "ja", "pt", "ru", "th", "zh"]
TEXTS = ["", " ", None, "naïve café", "naïve café", "a_b-c 1½ x²", "日本語のテキスト。です", "ไม่มีช่องว่าง", "word " * 30_000, "x" * 50_000, "İstanbul ΟΔΟΣ", "🎉 ok"]


def count(text):
    return len(regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", text or "").lower()))


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, event_id string, talk_id string, text string, token_count int, ingested_at timestamp, _piece string, tokens int")


def test_counts_by_tries(spark):
    rows = [(f"c{i}", "e", "t", t, count(t) if i % 2 else None, NOW, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [("c1", "e", "t", TEXTS[1], count(TEXTS[1]), NOW + dt.timedelta(days=1), "x", 1), (None, "e", "t", "lost", 9, NOW, "x", 1)]
    got = {r.chunk_id for r in tokens.wrong_counts(chunks(spark, rows)).collect()}
    assert got == {f"c{i}" for i in range(0, len(TEXTS), 2)}
    assert tokens.wrong_counts(chunks(spark, [])).count() == 0


def test_subword_states_are_exact(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tokens.ByteBpe.PIECE.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in TEXTS if t is None or len(t) < 40_000] + ["x" * 3_000, "aaaa bbbb aaaab", "  two  spaces\n\nand\tlines "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.tokens for r in tokens.count_tokens(df, "i", F.col("t"), tokens.ByteBpe(RANKS)).collect()}
    assert got == {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_budget_slices(spark):
    talks = spark.createDataFrame([("t", ["es-MX", "English"], "d", NOW), ("t", ["es-MX", "English"], "d", NOW + dt.timedelta(days=2)), ("u", None, None, NOW)], "talk_id string, languages array<string>, domain string, ingested_at timestamp")
    told = spark.createDataFrame([("t", "en+es")], "talk_id string, language string")
    rows = [("c1", "e", "t", "uno dos", 2, NOW, "", 0), ("c2", "e", "u", None, 5, NOW, "", 0), ("c3", "e", None, "x", None, NOW, "", 0)]
    got = {(r.language, r.domain): (r.chunks, r.tokens, r.wrong_counts) for r in tokens.budget(chunks(spark, rows), talks, told).collect()}
    assert got == {("en+es", "d"): (1, 2, 0), ("und", None): (2, 1, 2)}


def test_language_names(spark):
    table = langnames.names(spark, LANGS)
    assert langnames.parse("es+fr", table) == ["es", "fr"] and langnames.parse("pt_BR", table) == ["pt"]
    for name, code in {"Deutsch": "de", "inglés": "en", "日本語": "ja", "العربية": "ar", "ENG": "en", "zho": "zh", "русский": "ru", "हिन्दी": "hi", "alemão": "de", "ไทย": "th", "chinois": "zh"}.items():
        assert langnames.parse(name, table) == [code], name
    assert langnames.parse("und", table) == langnames.parse(None, table) == langnames.parse("mul", table) == []


def test_turn_rules(spark):
    u = "event_id string, talk_id string, source_line int, start_time string, start_seconds int, source_label string, text string, ingested_at timestamp, turn int"
    rows = [
        ("e", "t", 1, "00:00:05", None, "Ana Paz", "Hello there.", NOW, 0),
        ("e", "t", 1, "00:00:05", None, "Ana Paz", "Hello there.", NOW + dt.timedelta(days=3), 0),
        ("e", "t", 2, "--:--:--", 7, "Sala", "[Aplausos] eh, mmm...", NOW, 0),
        ("e", "t", 3, "00:00:08.900", 8, "???", "still me me", NOW, 0),
        ("e", "t", 4, "0:00:06", 6, "B. Ríos", "earlier", NOW, 0),
        ("e", "t", 5, None, 20, None, "ANA PAZ: by name", NOW, 0),
        ("e", "t", 6, "[00:00:21]", 21, "Speaker 2", "by number", NOW, 0),
        ("e", "t", 7, "00:00:22", 22, ">> Bo Rios - Guest", None, NOW, 0),
        ("e", None, 8, "00:00:22", 22, "Bo", "lost", NOW, 0),
        ("e", "v", 1, "00:00:01", 1, "Unknown", "nobody", NOW, 0),
    ]
    s = spark.createDataFrame([("t", "s1", 1, "Ana Paz"), ("t", "s2", 2, "Bo Ríos")], "talk_id string, speaker_id string, speaker_no int, display_name string")
    got = {tuple(r) for r in turns.turn_bounds(spark.createDataFrame(rows, u), s).collect()}
    assert got == {("t", 1, 1, "s1"), ("t", 4, 3, "s2"), ("t", 5, 5, "s1"), ("t", 6, 6, "s2"), ("v", 1, 1, None)}
    said = {r.first_source_line: r.text for r in turns.turns(spark.createDataFrame(rows, u), s).where("talk_id = 't'").collect()}
    assert said[4] == "earlier still me" and said[5] == "by name"
    assert turns.turns(spark.createDataFrame([], u), s).count() == 0


def test_speaker_spellings():
    people = [("s1", "plalum junzinnadre"), ("s2", "galruk tamulmcul"), ("s3", "pedro tamulmcul")]
    for label, want in {"plalum junzinnadre": "s1", "junzinnadre plalum": "s1", "p junzinnadre": "s1", "junzinnadre": "s1", "plalum junzinndare": "s1", "tamulmcul": None, "g tamulmcul": "s2", "prof galruk tamulmcul": "s2", "sala": None, "": None}.items():
        assert turns.who(label, people) == want, label


def test_languages_of_rows(spark):
    from weftline.session import table

    samples = table(spark, "/root/testdata/sf0.001", "language_samples")
    u = [("t", 1, "La planta explicó los datos. Vielen Dank an alle für das Kommen.", "es", NOW), ("t", 1, "La planta explicó los datos. Vielen Dank an alle für das Kommen.", "es", NOW), ("t", 2, "eh, mmm [Music]", None, NOW), ("t", 3, None, "es", NOW), ("t", 4, "Thank you all for coming.", "English", NOW)]
    spoken = spark.createDataFrame(u, "talk_id string, source_line int, text string, lang string, confidence timestamp")
    talks = spark.createDataFrame([("t", "\n".join(["Thank you all for coming."] * 19 + ["mmm"]), ["es"]), ("v", None, None)], "talk_id string, text string, languages array<string>")
    got = {tuple(r) for r in languages.unnamed_languages(spoken, talks, samples).collect()}
    assert got == {("t", 1, "de"), ("t", 0, "en")}
    assert languages.unnamed_languages(spoken.limit(0), talks.limit(0), samples).count() == 0


def test_talks_have_their_parts_and_all_their_languages(spark, tmp_path):
    from weftline.llm import queries as llm
    from weftline.session import table

    lines = ["Thank you all for coming. \U0001f600 We begin now with the first talk."] * 29 + ["", "  Vielen Dank an alle für das Kommen.", "mmm"]
    text = "\n".join(lines)
    u = [("t", 5, "Thank you all for coming.", "en")]
    spark.createDataFrame(u, "talk_id string, source_line int, text string, lang string").write.parquet(f"{tmp_path}/utterances.parquet")
    talks = [("t", text, ["en"]), ("t", text, ["en"]), ("v", None, None), ("w", "Thank you all for coming.", None)]
    spark.createDataFrame(talks, "talk_id string, text string, languages array<string>").write.parquet(f"{tmp_path}/talks.parquet")
    table(spark, "/root/testdata/sf0.001", "language_samples").write.parquet(f"{tmp_path}/language_samples.parquet")
    got = llm.p3_parts(spark, str(tmp_path)).collect()
    mine = {(text[r.start_char : r.end_char].strip(), r.lang) for r in got if r.talk_id == "t" and not r.source_line}
    assert ("Vielen Dank an alle für das Kommen.", "de") in mine and {("Thank you all for coming.", "en")} < mine and len(mine) == 3
    assert sum(r.talk_id == "t" and not r.source_line for r in got) == 59
    assert [(r.start_char, r.end_char, r.lang) for r in got if r.talk_id == "w" or r.source_line] == [(0, 25, "en")] * 2
    rows = {(r.talk_id, r.source_line, r.lang) for r in llm.p3_languages(spark, str(tmp_path)).collect()}
    assert rows == {("t", 5, "en"), ("t", 0, "en"), ("t", 0, "de"), ("w", 0, "en"), ("v", 0, None)}
    assert llm.p3_found(spark, str(tmp_path)).where("lang = 'de'").count() == 0  # a 32nd of the lines


def test_held_out_samples_are_recognised(spark):
    from weftline.session import table

    rows = [(r.lang, r.text) for r in table(spark, "/root/testdata/sf0.001", "language_samples").collect()]
    random.Random(4).shuffle(rows)
    p = languages.Profiles(rows[:110])
    hit = total = 0
    for lang, text in rows[110:]:
        best, *_ = p.judge([x for *_, x in languages.parts(text)])
        votes = Counter(p.codes[b] for b in best)
        hit, total = hit + (votes.most_common(1)[0][0] == lang), total + 1
    assert hit >= 0.9 * total


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_terms_and_deep_spills(spark, limit):
    rows = [(f"c{i % 40}", t) for i, t in enumerate(TEXTS + ["the a", "the b", "the c d"] * 9)] + [(None, "lost")]
    df = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("term", F.lit("clash"))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequency.marked_terms(df, bits=2, limit=limit).collect()}
    times, records = Counter(), Counter()
    for _, t in rows:
        w = regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", t or "").lower())
        times.update(w)
        records.update({*w})
    assert got == {w: (times[w], records[w], "rare" if records[w] <= 2 else "common" if records[w] > len(rows) / 4 else None) for w in times}


def test_terms_of_nothing(spark):
    assert frequency.marked_terms(spark.createDataFrame([], "chunk_id string, text string")).count() == 0
    assert frequency.marked_terms(spark.createDataFrame([("a", None)], "chunk_id string, text string")).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).round(3)
    x[200:260] = x[:60] + rng.standard_normal((60, 8)) * 0.02
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400 + i, rows[0][1]) for i in range(9)]  # a group of copies larger than k
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:3], "row_index bigint, embedding array<float>").withColumn("id", F.lit(1))
    m = spark.createDataFrame([(i, f"c{i}") for i, _ in rows + bad[:4]] + [(0, "c0"), (5000, "none")], "row_index bigint, chunk_id string")
    ids = np.array([i for i, _ in rows])
    y = np.array([r for _, r in rows], np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = np.minimum(y @ y.T, 1.0)
    for i in range(len(ids)):  # copies are equally near however the sums round
        near[i, [j for j in range(len(ids)) if rows[i][1] == rows[j][1]]] = 1.0
    np.fill_diagonal(near, -2)
    want = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-near[i, j], ids[j]))[:5]:
            if near[i, j] >= 0.95:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    for block in (2048, 16):
        got = {tuple(r) for r in neighbors.close_pairs(df, m, leaf=32, visits=24, block=block).collect()}
        assert got == want
    assert neighbors.close_pairs(df.limit(0), m).count() == 0 and neighbors.close_pairs(df.where("row_index = 0"), m).count() == 0


def test_placement_by_sum_of_squares():
    rng = random.Random(5)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    boxes = packing.place(np.array(sizes), 50)
    level, count = {}, Counter()
    for size, box in zip(sizes, boxes):
        # the box taken must be one that leaves the least sum of squares
        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + size < 50:
                c[h + size] += 1
            return sum(v * v for v in c.values())

        least = min(after(h) for h in {0, *(v for v in level.values() if v + size <= 50)})
        old = level.get(box, 0)
        assert after(old) == least
        if old:
            count[old] -= 1
        level[box] = old + size
        assert level[box] <= 50
        if level[box] < 50:
            count[level[box]] += 1
        else:
            level[box] = 50
    assert packing.place(np.array([], np.int64), 5).size == 0 and list(packing.place(np.array([1, 1]), 1)) == [0, 1]


def test_packing_rounds_and_cuts(spark):
    rng = random.Random(6)
    docs = [(i, rng.randint(0, 25)) for i in range(600)] + [(1000, 95), (1001, 40)]
    kinds = spark.createDataFrame([("s", 10), ("m", 40), ("bad", 0), (None, 7)], "container_name string, capacity_tokens int")
    placed = packing.pack(spark.createDataFrame(docs, "doc_id bigint, tokens int"), kinds.where("container_name IS NOT NULL"), held=50).collect()
    for name, cap in (("s", 10), ("m", 40)):
        own = [r for r in placed if r.container_name == name]
        held = Counter()
        for r in own:
            if r.container:
                held[r.container] += r.tokens
        assert max(held.values()) <= cap
        for d, n in docs:
            parts = sorted((r.first_token, r.tokens) for r in own if r.doc_id == d)
            assert sum(t for _, t in parts) == n and len(parts) == max(1, -(-n // cap))
        assert len(held) <= 1.1 * -(-sum(n for _, n in docs) // cap) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), kinds).count() == 0


def test_mix_order_and_caps(spark):
    docs = [(i, " A " if i % 2 else "a", 10) for i in range(50)] + [(100 + i, "b", 7) for i in range(5)] + [(200, None, 5), (201, "c", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens int").withColumn("rank", F.lit(0))
    t = spark.createDataFrame([("m", "A", 0.5, 1, 200), ("m", "b", 0.25, 2, 200), ("m", "c", 0.25, 3, 200), ("n", None, 1.0, 1, 9)], "mix_name string, source string, target_share double, max_repeats int, budget_tokens bigint")
    rows = {r.source: r for r in mixing.shares(df, t, block=10).collect()}
    assert set(rows) == {"A", "b", "c"}
    assert rows["A"].tokens >= 90 and rows["A"].most_uses == 1 and not rows["A"].short
    assert rows["b"].available_tokens == 35 and rows["b"].most_uses <= 2 and not rows["b"].short
    assert rows["c"].short and rows["c"].tokens == 0 and rows["c"].empty_slots > 0
    order = mixing.mix(df, t, block=10).orderBy("slot", "place").collect()
    first = [r.source for r in order if r.slot < 8]
    assert 2 <= first.count("A") <= 6  # the shares hold in every stretch
    assert mixing.shares(df.limit(0), t, block=10).where("tokens > 0").count() == 0 and mixing.shares(df, t.limit(0)).count() == 0


def test_short_sources_come_from_the_draw(spark):
    rng = random.Random(7)
    docs = [(i, "abcdef"[rng.randrange(6)], rng.randrange(1, 30)) for i in range(300)]
    has = Counter()
    for _, s, n in docs:
        has[s] += n
    targets = []
    for m in range(30):
        budget, repeats = rng.choice([5, 400, 3000, 20_000]), rng.randrange(0, 5)
        targets += [(f"m{m}", s, rng.choice([0.0, 0.05, 0.1, 0.3, 0.6]), repeats, budget) for s in "abcdefg"] + [(f"m{m}", "h", 0.1, 3, budget)]
        # one at the edge: all its tokens are just its share, or one too few
        targets += [(f"e{m}", "a", (has["a"] * 2 + m % 2) / 4096, 2, 4096), (f"e{m}", "b", 0.5, 9, 4096)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens int")
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int, budget_tokens bigint")
    found = mixing.short_sources(df, t)
    want = {(m, s) for m, s, share, k, budget in targets if has[s] * k < share * budget}
    assert {tuple(r) for r in found.collect()} == want and 0 < len(want) < len(targets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert str(mixing.GOLDEN) in plan and "xxhash64" in plan  # the schedule and the shuffled repeats


def test_sentence_units(spark):
    known = ["Thank you all.", "We met Dr. Paz. She left.", "The price rose.", "So it goes.", "We met again."] * 20
    cases = {
        1: ("A title\n\nWe met Dr. Paz at 4.30. So it goes.", ["A title", "We met Dr. Paz at 4.30.", "So it goes."]),
        2: ("  \n \n", []),
        3: (None, []),
        4: ("“One. Two.” she rose. We met again!", ["“One. Two.” she rose.", "We met again!"]),
        5: ("谢谢大家。没有人知道。", ["谢谢大家。", "没有人知道。"]),
        6: ("1. The price\nrose.\r\n\r\n• So it goes.", ["1. The price\nrose.", "• So it goes."]),
    }
    rows = [(100 + i, t) for i, t in enumerate(known)] + [(k, v[0]) for k, v in cases.items()] + [(1, cases[1][0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start_char", F.lit(1))
    got = sentences.sentences(df).collect()
    for k, (text, units) in cases.items():
        mine = dict.fromkeys(sorted((r.start_char, r.end_char) for r in got if r.doc_id == k))
        found = [(text or "")[a:b] for a, b in mine]
        assert found == units
    long = df.unionByName(spark.createDataFrame([(7, "So it goes. " * 20_000, 1)], df.schema))
    assert sentences.sentences(long).where("doc_id = 7").count() == 20_000
    assert sentences.sentences(df.limit(0)).count() == 0


def test_rare_words_count_too(spark, monkeypatch):
    # among so many words of others the abbreviation is far below one in KEPT of all
    texts = ["Thank you all.", "So it goes.", "We rose."] * 400 + [f"We met Xzqv. Paz {n} today." for n in "ABCDEFGH"] + ["He met Xzqv. Paz. So it goes."]
    df = spark.createDataFrame([*enumerate(texts), (1208, texts[1208]), (None, texts[1200])], "doc_id bigint, text string")

    def units():
        return sorted((r.doc_id or -1, r.start_char, r.end_char) for r in sentences.sentences(df).collect())

    want = units()
    monkeypatch.setattr(sentences, "KEPT", 20)
    assert units() == want
    monkeypatch.setattr(sentences, "KEPT", 1)
    assert units() == want
    assert [texts[1208][a:b] for d, a, b in dict.fromkeys(want) if d == 1208] == ["He met Xzqv. Paz.", "So it goes."]


def test_units_span_any_number_of_possible_boundaries():
    m = sentences.Model({"c": {"Xz.": (0, 200, 0)}})
    for n in (10, 60, 500):
        text = "We met " + "Xz. Paz " * n + "today. So it goes."
        assert [text[a:b] for a, b in m.divide([p.kept() for p in sentences.pieces(text)], {})] == [text[: text.index(" So it")], "So it goes."], n
    # the best division by trying all
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["So it goes. ", "Xz. ", "“", "” ", "(", ") ", "He asked. ", "one! ", "A long way to go " * rng.choice([1, 40, 130]) + ". "]) for _ in range(rng.randrange(2, 14))) + "We rose."
        for p in sentences.pieces(text):
            if p.spots:
                assert score(m, text, p, m._best(*p.kept())) == pytest.approx(best_score(m, text, p))


def possible(m, p):
    gains = {}
    for i, (a, b) in enumerate(p.spots):
        shape = p.open[i][1]
        gains[a, b] = sentences.PLAIN.get(p.kind[i], 1.6) + (sentences.LOWER if shape.startswith("lower") else m.word("o", p.open[i])) + m.word("c", p.close[i]) + (sentences.GLUED if p.glued[i] else 0)
    return gains


def span(m, text, p, a, b):
    s, k = 0.0, b - a
    s += m.lengths[p.dense][k] if k < len(m.lengths[p.dense]) else -3.0
    signs = sentences._SIGNS.findall(text, a, b)
    s += sentences.OPEN_PAIR * (sum(c in sentences._QUOTE for c in signs) % 2)
    s += sentences.OPEN_PAIR * (sum((c in sentences._OPEN) - (c in sentences._SHUT) for c in signs) != 0)
    return s + (sentences.HOLLOW if k < 8 and not sentences._WORD.search(text, a, b) else 0)


def score(m, text, p, units):
    gains = possible(m, p)
    return sum(span(m, text, p, a, b) for a, b in units) + sum(gains[x[1], y[0]] for x, y in zip(units, units[1:]))


def best_score(m, text, p):
    gains = possible(m, p)
    spots = [*gains]
    starts, ends = [p.begin, *(b for _, b in spots)], [*(a for a, _ in spots), p.end]
    top = [0.0]
    for j, end in enumerate(ends):
        top.append(max((top[i] + (gains[spots[i - 1]] if i else 0) + span(m, text, p, starts[i], end)) for i in range(j + 1)))
    return top[-1]


def test_the_labelled_sample_is_drawn_in_parts(spark, monkeypatch):
    rows = [("t", i, "EN" if i % 3 else "de", f"We met {i} times in a row.") for i in range(3000)]
    df = spark.createDataFrame(rows, "talk_id string, source_line int, lang string, text string")
    samples = spark.createDataFrame([("en", "We met."), ("de", "Wir trafen uns.")], "lang string, text string")
    drawn, windows, by = {}, [], languages.W.partitionBy
    monkeypatch.setattr(languages.W, "partitionBy", lambda *c: windows.append(c) or by(*c))
    monkeypatch.setattr(languages, "parts", lambda text: [(0, len(text), text)])
    monkeypatch.setattr(languages, "Profiles", lambda own, more: drawn.update(more))
    languages.profiles(samples, df, most=70)
    keyed = df.withColumn("h", F.xxhash64("talk_id", "source_line")).orderBy("h").collect()
    assert {k: sorted(v) for k, v in drawn.items()} == {k: sorted([r.text for r in keyed if r.lang.lower() == k][:70]) for k in ("en", "de")}
    assert windows[0] == ("lang", "_part")


def _nearest(x: np.ndarray, k: int) -> list[set]:
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    return [{int(j) for j in np.argsort(-row, kind="stable")[:k]} for row in near]


def test_large_leaves_are_split_by_trees_of_their_own(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((150, 16))[rng.integers(0, 150, 3000)] + 0.25 * rng.standard_normal((3000, 16))).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_index bigint, embedding array<float>")
    # 8 leaves of 375 vectors fit the first sample; only a few of the leaves below are visited
    got: dict = {}
    for r in neighbors.neighbors(df, 5, trees=6, visits=24, leaf=16, sample=64, block=40).collect():
        got.setdefault(r.row_index, set()).add(r.neighbor)
    want = _nearest(x, 5)
    assert np.mean([len(got.get(i, set()) & w) / 5 for i, w in enumerate(want)]) > 0.9
    some = neighbors.neighbors(df, 5, only=F.col("row_index") % 50 == 0, trees=6, visits=40, leaf=16, sample=64, block=40).collect()
    assert {r.row_index for r in some} == {*range(0, 3000, 50)}
    assert np.mean([r.neighbor in want[r.row_index] for r in some]) > 0.9


def test_leaves_that_no_plane_splits_are_searched_whole(spark):
    # one direction but for the least bit of a number: no median parts them
    x = np.ones((300, 4), np.float32)
    x[:, 3] = 1 + np.arange(300) * 2e-7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_index bigint, embedding array<float>")
    got = neighbors.neighbors(df, 3, trees=2, visits=4, leaf=4, sample=40, block=16).groupBy("row_index").count().collect()
    assert len(got) == 300 and all(r["count"] == 3 for r in got)


def test_words_count_whole():
    long = "Q" * 300
    counts = sentences.Counts()
    counts.add(f"{long}. Then we met. {long}a said so.")
    kind, key, *_ = counts.rows()
    assert {("c", f"{long}."), ("o", "Then"), ("o", f"{long}a")} <= {*zip(kind, key)}


def test_cut_documents_come_from_the_packing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a " * 25), (2, "b " * 10), (3, "c " * 7), (4, None)], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("box", 10)], "container_name string, capacity_tokens int")
    assert {tuple(r) for r in packing.cut_documents(docs, kinds).collect()} == {("box", 1)}
    # a packer that loses what it is given loses the document that stands in two of its containers
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *x: whole(*x).where("part = 1"))
    assert packing.cut_documents(docs, kinds).count() == 0


def test_short_sources_follow_a_broken_schedule(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "s" if i < 4 else "t", 10) for i in range(40)], "doc_id bigint, source string, tokens int")
    targets = spark.createDataFrame([("m", "s", 0.5, 1, 200), ("m", "t", 0.5, 1, 200)], "mix_name string, source string, target_share double, max_repeats int, budget_tokens bigint")
    assert {tuple(r) for r in mixing.short_sources(docs, targets).collect()} == {("m", "s")}
    # if the draw loses a source's documents, the source is short, whatever the table holds of it
    plan = mixing._plan
    monkeypatch.setattr(mixing, "_plan", lambda *x: (*plan(*x)[:2], plan(*x)[2].where("source != 't'")))
    assert {tuple(r) for r in mixing.short_sources(docs, targets).collect()} == {("m", "s"), ("m", "t")}


def test_ngrams_that_share_a_slot_are_all_kept(monkeypatch):
    rows = [("en", "the quick brown fox jumps over the lazy dog"), ("de", "der schnelle braune Fuchs springt über den faulen Hund")]
    letters = [x for _, text in rows for *_, x in languages.parts(text)] + ["the the the " * 3000]
    wide = languages.Profiles(rows)
    want = wide.judge(letters)
    monkeypatch.setattr(languages.Profiles, "BITS", 2)
    for a, b in zip(want, languages.Profiles(rows).judge(letters)):
        assert np.array_equal(a, b)
    assert [wide.codes[i] for i in want[0]] == ["en", "de", "en"]


def test_confidence_is_that_of_the_language_given(spark):
    p = languages.Profiles([("en", "the house is on the hill and the sun shines"), ("de", "das Haus steht auf dem Berg und die Sonne scheint"), ("nl", "het huis staat op de berg en de zon schijnt")])
    text = "die Sonne scheint auf dem Berg."
    (_, _, _, lang, sure), = languages._judged(p, [text], [[]])
    assert lang == "de" and sure > 0.5
    best, mean = p.judge([x for *_, x in languages.parts(text)])
    mean[0, p.codes.index("nl")] = mean[0, best[0]] * 1.1
    p.judge = lambda letters: (best, mean)
    (_, _, _, lang, claimed), = languages._judged(p, [text], [["nl"]])
    assert lang == "nl" and claimed < 0.5
    p = languages.Profiles([("en", "the house")])
    assert [x[3:] for x in languages._judged(p, ["犬が好き。"], [[]])] == [(None, 0.0)]


def test_every_text_has_a_language_row(spark):
    from weftline.session import table

    samples = table(spark, "/root/testdata/sf0.001", "language_samples")
    spoken = spark.createDataFrame([("t", 1, "Thank you all for coming.", "en"), ("t", 2, None, "en"), ("t", 3, "[Music]", None), ("t", 3, "[Music]", None)], "talk_id string, source_line int, text string, lang string")
    talks = spark.createDataFrame([("t", "mmm\nThank you all for coming.", ["en"]), ("v", None, None), ("w", "...", None)], "talk_id string, text string, languages array<string>")
    rows = sorted((r.talk_id, r.source_line, r.lang or "", r.confidence > 0) for r in languages.row_languages(spoken, talks, samples).collect())
    assert rows == [("t", 0, "en", True), ("t", 1, "en", True), ("t", 2, "", False), ("t", 3, "", False), ("v", 0, "", False), ("w", 0, "", False)]


def test_annotations_may_be_long(spark):
    long = "the audience in the back rows laughs and claps for a long while"
    texts = [f"*{long}*", f"({long})", f"[{long}]", f"*{long}* yes"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.s for r in df.orderBy("i").select(turns.is_spoken(F.col("text")).alias("s")).collect()] == [False, False, False, True]
    assert [len(languages.parts(t)) for t in texts] == [0, 0, 0, 1]
