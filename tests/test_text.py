import unicodedata

import pytest
from pyspark.sql import functions as F

from inkgrain.functions import align, geometry, glyphs, text
from inkgrain.plans.common import VOCAB


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "s string").select(col(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("ch,base,mod,tone", [("á", "a", "none", "sac"), ("à", "a", "none", "huyen"), ("ả", "a", "none", "hoi"), ("ã", "a", "none", "nga"), ("ạ", "a", "none", "nang"), ("ă", "a", "breve", "ngang"), ("ệ", "e", "circumflex", "nang"), ("ữ", "u", "horn", "nga"), ("đ", "d", "stroke", "ngang"), ("Đ", "D", "stroke", "ngang"), ("5", "5", "none", "ngang"), ("ñ", "n", "none", "nga"), ("ü", "u", "none", "ngang")])
def test_glyphs(ch, base, mod, tone):
    assert glyphs.decompose(ch) == (base, mod, tone)


def test_nfc_and_clean(spark):
    assert one(spark, "tiếng", text.nfc) == "tiếng"
    assert one(spark, "a​b", text.nfc) == "ab"
    assert one(spark, "Å", text.nfc) == unicodedata.normalize("NFC", "Å")
    assert one(spark, None, text.nfc) is None
    assert one(spark, "", text.nfc) == ""


def test_normal_states(spark):
    got = [one(spark, s, text.normal_state) for s in ("abc", "tiếng", "tiếng", "é é")]
    assert got == ["ascii-only (NFC==NFD)", "NFC", "NFD", "MIXED/neither"]


def test_tokens(spark):
    f = lambda c: text.clean_token(c, VOCAB)
    assert [one(spark, s, f) for s in ("«phở»,", "...", "a+b", "茶", "", None)] == ["phở", None, "a+b", None, None, None]
    assert one(spark, "a b  c", text.word_list) == ["a", "b", "c"]
    assert one(spark, "3a bC-d", text.title) == "3A Bc-D" == "3a bC-d".title()


def test_hygiene(spark):
    h = one(spark, " a​é茶 ", lambda c: text.hygiene(c, VOCAB))
    assert h["text"] == "aé茶"
    assert h["warnings"] == ["stripped invisible", "composed", "stripped ends", "out of vocabulary: 茶"]
    assert one(spark, "abc", lambda c: text.hygiene(c, VOCAB))["warnings"] == []


def test_kinds(spark):
    assert [one(spark, s, text.transcript_kind) for s in (" ### ", "", None, "x")] == ["hash", "empty", "empty", "kept"]


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_align_matches_distance(spark):
    import random

    r = random.Random(4)
    pairs = [("".join(r.choices("abcế", k=r.randint(0, 7))), "".join(r.choices("abcê", k=r.randint(0, 7)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", align.align_ops(F.col("a"), F.col("b")).alias("o"), align.word_distance(F.col("a"), F.col("b")).alias("w")).collect():
        ops = [tuple(o) for o in row["o"]]
        assert ops == align.trace(row["a"], row["b"])
        assert sum(o[0] != "eq" for o in ops) == brute(row["a"], row["b"])
        assert row["w"] == brute(row["a"].split(), row["b"].split())


def test_long_pair(spark):
    a = "phở " * 500
    df = spark.createDataFrame([(a, a[1:])], "a string, b string")
    assert len(df.select(align.align_ops(F.col("a"), F.col("b"))).first()[0]) == len(a)


def test_quads(spark):
    df = spark.createDataFrame([([10, 0, 10, 5, 0, 5, 0, 0],), ([0, 0, 100, 100, 90, 110, -10, 10],), (None,), ([1, 2],)], "p array<int>")
    rows = df.select(geometry.order_quad("p").alias("q"), "p").select("q", geometry.quad_size(F.col("q")).alias("s"), geometry.tilt(F.col("q")).alias("t"), geometry.is_degenerate(F.col("q")).alias("d")).collect()
    assert [(c["x"], c["y"]) for c in rows[0]["q"]] == [(0, 0), (10, 0), (10, 5), (0, 5)]
    assert tuple(rows[0]["s"]) == (10, 5) and rows[0]["t"] == 0 and not rows[0]["d"]
    assert rows[2]["q"] is None and rows[3]["q"] is None


def test_overlap():
    sq = [0, 0, 10, 0, 10, 10, 0, 10]
    assert geometry.overlap(sq, sq) == (100, 100, 100)
    assert geometry.overlap(sq, [5, 5, 15, 5, 15, 15, 5, 15])[2] == 25
    assert geometry.overlap(sq, [0, 0, 0, 0, 0, 0, 0, 0])[2] == 0
