import unicodedata

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T

ODD = ["", " ", "Café 12 ½ ²", "café", "a_b‿c", "﻿x  y\x1cz", "ΟΔΟΣ", "İstanbul", "ẛ̣", "가", "각", None, "ไม่มี", "हिन्दी", "Å", "…", "क़"]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_nfc_and_tokens(spark):
    got = frame(spark, ODD).select("i", T.nfc(F.col("t")).alias("n"), T.lexical_tokens(F.col("t")).alias("w"), T.token_count(F.col("t")).alias("c")).orderBy("i").collect()
    for r, t in zip(got, ODD):
        assert r.n == (None if t is None else unicodedata.normalize("NFC", t))
        want = None if t is None else regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", t).lower())
        assert r.w == want and r.c == len(want or [])


def test_every_unstable_character_is_caught(spark):
    bad = []
    for cp in range(0x80, 0x30000):
        c, d = chr(cp), unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<"):
            if unicodedata.normalize("NFC", c) != c:
                bad.append(c)
            elif len(d.split()) == 2:
                bad.append(chr(int(d.split()[1], 16)))
    assert frame(spark, sorted(set(bad))).where(~F.col("t").rlike(T.UNSTABLE)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_nfc_property(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    got = frame(spark, values).select("i", T.nfc(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [unicodedata.normalize("NFC", v) for v in values]


def test_cleaning_clocks_and_previews(spark):
    df = frame(spark, ["﻿ a  b\x1f", ">> Ana Paz - Guest", "25:00:01", "10:60:00", "1:00:00", "x" * 12, None])
    clean = [r[0] for r in df.orderBy("i").select(T.clean_text(F.col("t"))).collect()]
    assert clean[0] == "a b" and clean[-1] is None
    assert [r[0] for r in df.orderBy("i").select(T.clean_label(F.col("t"))).collect()][1] == "Ana Paz"
    assert [r[0] for r in df.orderBy("i").select(T.clock_seconds(F.col("t"))).collect()] == [None, None, 90001, None, None, None, None]
    assert [r[0] for r in df.orderBy("i").select(T.preview(F.col("t"), 10)).collect()][5] == "x" * 9 + "…"
