import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrain.functions.geometry import overlap
from inkgrain.operators import audit, detection, greedy, review, sampling, score, seedstats


def scored(spark, pairs):
    return score.score(spark.createDataFrame([("g", r, h) for r, h in pairs], "g string, ref string, hyp string"), ["g"]).first()


def test_headline(spark):
    s = scored(spark, [("tiếng Việt có dấu", "tiêng Viêt co dâu")])
    assert (s["cer"], s["tone_acc"], s["base_acc"], s["mod_acc"]) == (pytest.approx(4 / 17), pytest.approx(3 / 7), 1, 1)


def test_sums_not_means(spark):
    assert scored(spark, [("a", "b"), ("abcd", "abcd")])["cer"] == pytest.approx(0.2)
    assert scored(spark, [("a b c", "a b")])["wer"] == pytest.approx(1 / 3)


def test_deletion_and_insertion(spark):
    s = scored(spark, [("ệ", "")])
    assert (s["n_del"], s["base_n"], s["base_ok"], s["mod_n"], s["tone_n"], s["tone_ok"]) == (1, 1, 0, 1, 1, 0)
    s = scored(spark, [("a", "aX")])
    assert (s["n_ins"], s["base_n"], s["cer"]) == (1, 1, 1.0)


def test_undefined_ratio_and_missing(spark):
    assert scored(spark, [("in", "in")])["mod_acc"] is None
    s = scored(spark, [("ab", None), ("", "")])
    assert s["n_del"] == 2 and s["n_exact"] == 1
    s = scored(spark, [("", "")])
    assert s["g"] == "g" and s["cer"] is None and s["char_ref"] == 0


def test_nfd_equals_nfc(spark):
    assert scored(spark, [("tiếng", "tiến​g")])["cer"] == 0


def test_case(spark):
    s = scored(spark, [("Anh", "anh")])
    assert s["base_acc"] < 1 and s["base_acc_ci"] == 1


def test_confusion_and_classes(spark):
    ops = score.op_rows(spark.createDataFrame([(1, "ệá", "á"), (1, "ñ", "n"), (1, "ü", "u")], "g int, ref string, hyp string"), ["g"])
    cells = {(r["axis"], r["ref"], r["hyp"]) for r in score.confusion(ops, ["g"]).collect()}
    assert ("tone", "nang", "<del>") in cells
    kinds = {r["kind"]: r["n"] for r in score.error_mix(ops, ["g"]).collect()}
    assert kinds == {"del": 1, "pure_tone": 1, "pure_case": 1}  # ü to u changes nothing that is classed


def test_empty(spark):
    e = spark.createDataFrame([], "g string, ref string, hyp string")
    assert score.score(e, ["g"]).count() == 0
    assert score.error_mix(score.op_rows(e, ["g"]), ["g"]).count() == 0


def test_seed_stats(spark):
    v = [9.394964299135664, 9.225854941751221, 9.521125248295485]
    df = spark.createDataFrame([("A", "cer", i, x) for i, x in enumerate(v)] + [("B", "cer", 0, 1.0)] + [("C", "cer", 0, 1.0), ("C", "cer", 1, None)], "run string, metric string, seed int, value double")
    got = {r["run"]: r for r in seedstats.seed_stats(df, ["run", "metric"]).collect()}
    assert got["A"]["mean"] == pytest.approx(9.38064816306079) and got["A"]["ci95_half"] == pytest.approx(0.36803698902198473)
    assert got["B"]["ci95_half"] is None and got["C"]["mean"] is None


def test_touching_is_overlap(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0, 1.0), (1.0, 0.9, 3.0, 1.0), (1.0, None, 3.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(seedstats.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False, True]


def test_curve(spark):
    c = spark.createDataFrame([("cer", 10, 16.509, 0.933), ("cer", 25, 12.373, 0.337), ("cer", 50, 10.43, 0.2), ("cer", 100, 9.381, 0.368)], "metric string, r int, y double, half double")
    a = spark.createDataFrame([("cer", 10, 13.726, 0.096)], "metric string, r int, y double, half double")
    w = seedstats.worth(c, a, ["metric"]).first()
    assert w["worth"] == pytest.approx(2195, abs=5) and w["worth_lo"] == pytest.approx(1678, abs=15) and w["worth_hi"] == pytest.approx(2553, abs=15) and not w["truncated"]
    out = spark.createDataFrame([("cer", 99.0), ("cer", 1.0)], "metric string, target double")
    assert [r["r_at"] for r in seedstats.invert_curve(c, out, ["metric"]).collect()] == [None, None]


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.99,), (2.0,), (91.0,), (math.nan,), (None,)], "tilt double")
    assert [r[0] for r in df.select(audit.bin_of(F.col("tilt"), audit.BINS["tilt"])).collect()] == [0, 0, 1, None, None, None]


def test_sampling_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("s"))
    draw = lambda d: {r["k"] for r in sampling.stratified_sample(d, "s", "k", F.lit(0.1), "x").collect()}
    a = draw(df)
    assert a == draw(df.repartition(7)) and a == draw(df.repartition(1, "s"))
    sizes = {r["s"]: (r["n"], r["m"]) for r in df.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("k").isin(*a).cast("int")).alias("m")).collect()}
    assert all(m == round(n * 0.1) for n, m in sizes.values())
    assert sampling.stratified_sample(df.limit(0), "s", "k", F.lit(0.1), "x").count() == 0


def test_nested(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    got = sampling.nested_subsets(df, "k", "z", [10, 25, 50, 100]).groupBy("r").agg(F.collect_set("k").alias("ks")).collect()
    sets = {r["r"]: set(r["ks"]) for r in got}
    assert {r: len(s) for r, s in sets.items()} == {10: 40, 25: 100, 50: 200, 100: 400} and sets[10] < sets[25] < sets[50] < sets[100]


def test_budget_keeps_the_row_that_reaches_it(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "o int, n int")
    assert sampling.budgeted_prefix(df, "o", "n", 25).count() == 3
    assert sampling.budgeted_prefix(df.limit(0), "o", "n", 25).count() == 0


def test_synthetic_draws(spark):
    bank = spark.createDataFrame([("phở bò",), ("xe máy",)], "text string")
    words = spark.createDataFrame([("a", 3), ("bê", 1)], "token string, cnt long")
    got = sampling.synthetic_draws(2000, bank, words, "s", spark).collect()
    assert len(got) == 2000 and {r["kind"] for r in got} == {"single", "scene", "word"} and all(8 <= r["height"] < 175 for r in got)
    assert len(sampling.synthetic_draws(50, bank.limit(0), words.limit(0), "s", spark).collect()) == 50


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    got = review.upsert(old, spark.createDataFrame([("b", 3.0), ("c", 4.0)], "k string, v double"), "k", ["v"])
    assert {tuple(r) for r in got.collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}
    with pytest.raises(Exception, match="not a number"):
        review.upsert(old, spark.createDataFrame([("c", math.nan)], "k string, v double"), "k", ["v"]).collect()


def test_detection_against_the_rule(spark):
    r = random.Random(7)
    rows = []
    for img in range(6):
        for pos in range(40):
            x, y, w, h = r.randint(0, 500), r.randint(0, 300), r.randint(8, 120), r.randint(8, 60)
            rows.append((img, pos, [x, y, x + w, y, x + w, y + h, x, y + h], "gt" if r.random() < 0.8 else "dontcare"))
            for _ in range(r.randint(0, 2)):
                dx, dy = r.randint(-12, 12), r.randint(-6, 6)
                rows.append((img, len(rows) + 100, [x + dx, y + dy, x + w + dx, y + dy, x + w + dx, y + h + dy, x + dx, y + h + dy], "pred"))
    df = spark.createDataFrame(rows, "img_id int, pos int, poly array<int>, kind string")
    got = {r["thr"]: (r["tp"], r["fp"], r["fn"]) for r in detection.match(df).collect()}
    assert got == {r["thr"]: (r["tp"], r["fp"], r["fn"]) for r in detection.match(df, gather=3).collect()}
    for thr in detection.THRESHOLDS:
        each = [detection.match_one_image([(p, [float(v) for v in q], k) for i, p, q, k in rows if i == img], thr) for img in range(6)]
        assert got[thr] == tuple(map(sum, zip(*each)))
    assert detection.match(df.limit(0)).count() == 0


def test_overlaps_of_a_dense_image_are_not_written(spark, monkeypatch):
    """The rule as it reads, where an image has many more overlaps than boxes."""
    r = random.Random(8)
    rows = []
    for pos in range(300):
        x, y, w, h, d = r.randint(0, 30), r.randint(0, 12), r.randint(30, 60), r.randint(12, 24), r.choice([0, 0, 3, -3])
        rows.append((1, pos, [x, y, x + w, y + d, x + w, y + h + d, x, y + h], ["gt", "pred", "gt", "pred", "pred", "dontcare"][pos % 6]))
    written = []
    monkeypatch.setattr(detection, "settle", lambda df: written.append(df.count()) or df)
    df = spark.createDataFrame(rows, "img_id int, pos int, poly array<int>, kind string")
    got = {x["thr"]: (x["tp"], x["fp"], x["fn"]) for x in detection.match(df).collect()}
    one = [(p, [float(v) for v in q], k) for _, p, q, k in rows]
    assert got == {t: detection.match_one_image(one, t) for t in detection.THRESHOLDS}
    assert max(written) <= len(rows)


def test_overlaps_in_arrays_are_those_of_single_quads():
    r = random.Random(9)
    quad = lambda: [float(r.randint(0, 9)) if r.random() < 0.5 else r.random() * 9 for _ in range(8)]
    box = lambda x, y, w, h, d: [x, y, x + w, y + d, x + w, y + h + d, x, y + h]
    near = lambda: [float(v) for v in box(r.randint(0, 9), r.randint(0, 9), r.randint(0, 40), r.randint(0, 20), r.randint(-4, 4))]
    pairs = [(quad(), quad()) for _ in range(300)] + [(near(), near()) for _ in range(1500)]
    iou, cover = greedy.overlaps(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), i, c in zip(pairs, iou.tolist(), cover.tolist()):
        s, t, both = overlap(a, b)
        assert i == (both / (s + t - both) if s + t - both > 0 else 0.0) and c == (both / s if s > 0 else 0.0)


def test_coverage_rules(spark):
    cols = "stat string, p5 double, p25 double, p50 double, p75 double, p95 double"
    real = spark.createDataFrame([("contrast", 1.0, 2.0, 3.0, 4.0, 5.0), ("edge", 1.0, 2.0, 3.0, 4.0, 10.0)], cols)
    made = spark.createDataFrame([("contrast", 1.2, 2.0, 3.0, 4.0, 5.0), ("edge", 1.0, 2.0, 2.0, 4.0, 9.0)], cols)
    got = {r["stat"]: tuple(r)[1:] for r in audit.coverage_audit(real, made, ["contrast"], ["edge"], []).collect()}
    assert got == {"contrast": (True, True, False, True), "edge": (True, True, True, False)}


def test_charsets_and_fonts(spark):
    from inkgrain.operators import fonts

    rows = fonts.stacked(spark).collect()
    assert len(rows) == 60 and ("ế", "ê", "é") in {tuple(r) for r in rows}
    v = fonts.gate(spark.createDataFrame([("a", [ord("x")], 0)], "family string, cmap array<int>, dropped int"), spark.createDataFrame([("x",)], "ch string"))
    assert v.first()["verdict"] == "PASS"
    sel = spark.createDataFrame([("a",)], "family string")
    assert fonts.checked_selection(sel, v).count() == 1
    with pytest.raises(Exception, match="not passed: z"):
        fonts.checked_selection(spark.createDataFrame([("z",)], "family string"), v).collect()
    assert fonts.patch_weights(spark.createDataFrame([(0.5,)], "edge_density double")).first()["weight"] == pytest.approx(0.65)
