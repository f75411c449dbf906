"""Files in parts, plug-ins, the command line, merged artifacts, names in SQL."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrain import cli
from inkgrain.functions import geometry, registry
from inkgrain.operators import fonts, review, sampling, systems
from inkgrain.operators.quantiles import quantiles
from inkgrain.session import drop_settled, settle
from inkgrain.sources import readers, writers


def test_lines_of_a_split_file_are_numbered(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_bytes("".join(f"row {i}\r\n" if i % 3 else "\n" for i in range(5000)).encode())
    (tmp_path / "b.txt").write_text("x\n\ny")
    (tmp_path / "empty.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
        short = {r["line"]: r["value"] for r in readers.lines(spark, str(p), F.col("value") != "").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = {r["line"]: r["value"] for r in got if r["file"].endswith("a.txt")}
    assert a == {i: f"row {i}" if i % 3 else "" for i in range(5000)}
    assert sorted((r["line"], r["value"]) for r in got if r["file"].endswith("b.txt")) == [(0, "x"), (1, ""), (2, "y")]
    assert short == dict(enumerate(f"row {i}" for i in range(5000) if i % 3))


def test_systems(spark):
    class Reader:
        name = "upper"

        def read(self, picture):
            return picture.upper()

    class Batched(Reader):
        def __init__(self, lose=0):
            self.lose = lose

        def batch(self, pictures):
            return [p.upper() for p in pictures][self.lose :]

    df = spark.createDataFrame([(1, "a", "a"), (2, "b", None), (3, None, "c")], "pos int, ref string, picture string")
    want = {(1, "a", "A", "upper"), (2, "b", "", "upper"), (3, None, "C", "upper")}
    assert {tuple(r) for r in systems.run_system(df, Reader, "pos", "picture", "ref").collect()} == want
    assert {tuple(r) for r in systems.run_system(df, Batched, "pos", "picture", "ref").collect()} == want
    with pytest.raises(Exception, match="texts for"):
        systems.run_system(df, lambda: Batched(1), "pos", "picture", "ref").collect()
    assert systems.run_system(df.limit(0), Reader, "pos", "picture", "ref").count() == 0


def test_command_line(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("phở bò\tpho bò\n\ncơm\tcơm\nx\n", encoding="utf-8")
    said = []
    assert cli.main([str(p), "--confusion"], said.append) == 0
    assert said[0] == "pairs 3, characters 10" and any("hoi -> ngang  1" in s for s in said) and any("x -> <del>  1" in s for s in said)
    (tmp_path / "none.tsv").write_text("")
    assert cli.main([str(tmp_path / "none.tsv")], said.append) == 1


def test_merged_artifact_keeps_its_order(spark):
    old = spark.createDataFrame([("b", 1.0), ("gone", 9.0), ("sum", 0.0), ("z", 5.0)], "key string, value double")
    new = spark.createDataFrame([("b", 2.0), ("a", 3.0)], "key string, value double")
    total = lambda rows: rows.agg(F.lit("sum").alias("key"), F.sum("value").alias("value"))
    got = [tuple(r) for r in review.merge_artifact(old, new, "key", ["value"], ["gone"], {"sum": total}, ["z"]).collect()]
    assert got == [("z", 5.0), ("sum", 10.0), ("a", 3.0), ("b", 2.0)]


def test_blind_rows_are_dealt_once(spark):
    df = spark.createDataFrame([(i, "s" if i < 50 else "t") for i in range(60)], "idx int, stratum string")
    first = {r["idx"] for r in sampling.blind_subset(df, "stratum", "idx", 0.1, "1").collect()}
    assert len([i for i in first if i < 50]) == 5 and len([i for i in first if i >= 50]) == 1
    marked = df.withColumn("blind", F.col("idx").isin([3, 4]))
    assert {r["idx"] for r in sampling.blind_subset(marked, "stratum", "idx", 0.1, "1", F.col("blind")).collect()} == {3, 4}
    assert {r["idx"] for r in sampling.blind_subset(marked.withColumn("blind", F.lit(False)), "stratum", "idx", 0.1, "1", F.col("blind")).collect()} == first


def test_draws_of_every_kind(spark):
    bank = spark.createDataFrame([("bún chả",), ("phở",)], "text string")
    words = spark.createDataFrame([("một", 3), ("hai", 1)], "token string, cnt long")
    got = sampling.synthetic_draws(4000, bank, words, "9", spark, short_rate=0.2, strata=True).collect()
    assert len(got) == 4000 and {r["kind"] for r in got} == {"single", "short", "scene", "word"}
    assert {len(r["text"]) for r in got if r["kind"] == "short"} == {1, 2} and {len(r["text"]) for r in got if r["kind"] == "single"} == {1}
    assert any(" " in r["text"] for r in got if r["kind"] == "word") and all(0.05 <= r["severity"] <= 0.30 for r in got)


def test_places_for_patches(spark):
    boxes = spark.createDataFrame([(1, [0, 0, 100, 0, 100, 100, 0, 100])], "img_id int, poly array<int>")
    sizes = spark.createDataFrame([(1, 100), (2, 100), (3, 10)], "img_id int, side int")
    got = {r["img_id"]: r for r in sampling.background_patches(sizes, boxes, 64, 32, "7").collect()}
    assert set(got) == {2, 3} and 0 <= got[2]["x0"] <= 36 and got[3]["x0"] == 0 and got[2]["try"] == 0
    assert sampling.background_patches(sizes, boxes, 64, 32, "7", most=1).count() == 1


def test_small_rules(spark):
    p = spark.createDataFrame([(6.0, 0.5), (1.0, 0.05), (1.0, 0.5), (None, 0.5)], "gap double, cer double")
    assert [r[0] for r in p.select(fonts.probe_reading(F.col("gap"), F.col("cer"))).collect()] == ["train seen: escalate", "all seen: escalate", "no sign of exposure", None]
    assert spark.range(1).select(geometry.michelson(F.lit(10.0), F.lit(30.0))).first()[0] == pytest.approx(0.5)
    q = spark.createDataFrame([(1, 2, [3, 4]), (2, 1, [9, 9]), (3, 1, [9, 1]), (4, 1, None)], "pos int, img_id int, poly array<int>")
    assert [r["pos"] for r in sampling.reading_order(q).collect()] == [4, 3, 2, 1]
    registry.register(spark)
    r = spark.sql("select ink_decompose('ệ') d, ink_decompose('x') x, ink_trace('ab', 'b') t, ink_nfc('é') n, ink_edit_distance('ab', 'b') e, ink_words(' a  b ') w").first()
    assert tuple(r["d"]) == ("e", "circumflex", "nang") and tuple(r["x"]) == ("x", "none", "ngang") and r["t"] == ["da\0", "=bb"] and r["n"] == "é" and r["e"] == 1 and r["w"] == ["a", "b"]


def test_counts_of_results_must_agree(spark, tmp_path):
    for n in (3, 4):
        writers.write_json(spark.createDataFrame([("r", n, 5)], "run string, n_instances int, n_chars int"), str(tmp_path / f"s{n}"))
    with pytest.raises(Exception, match="n_instances differs"):
        readers.results(spark, str(tmp_path / "s*"), {"n_instances": None}).collect()
    assert readers.results(spark, str(tmp_path / "s*"), {"n_chars": 5}).count() == 2


def test_quantiles_against_numpy(spark):
    r = random.Random(4)
    data = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1), float(r.randrange(4)), -r.expovariate(1e-5), math.nan, None])) for _ in range(3000)] + [("one", 2.5), ("inf", math.inf), ("inf", -math.inf), ("inf", 0.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("i", F.lit(1)).withColumn("_c", F.lit(1))
    ps = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {x["g"]: x["qs"] for x in quantiles(df, ["g"], F.col("v"), ps).collect()}
    assert set(got) == {"a", "b", None, "one", "inf"} and got["inf"][0] == -math.inf and got["inf"][-1] == math.inf and got["inf"][3] == 0
    for g in ("a", "b", None, "one"):
        v = [x for k, x in data if k == g and x is not None and not math.isnan(x)]
        assert got[g] == [pytest.approx(float(np.percentile(v, 100 * p)), rel=1e-12, abs=1e-12) for p in ps]
    assert quantiles(df.limit(0), [], F.col("v"), ps).count() == 0 and quantiles(df.where("g = 'one'"), [], F.col("v"), [0.5]).first()["qs"] == [2.5]


def test_settled_tables_can_be_dropped(spark):
    t = settle(spark.range(3))
    path = t.inputFiles()[0].replace("file://", "")
    assert os.path.exists(path) and drop_settled(spark) >= 1 and not os.path.exists(path)
