import json

import pytest
from pyspark.sql import functions as F

from inkgrain.sources import readers, writers
from inkgrain.streaming import events


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_annotations(spark, tmp_path):
    p = put(tmp_path / "gt_12.txt", "1,2,3,4,5,6,7,8,a, b,c\r\n\r\n1,2,3,4,5,6,7,8,###\n1,2,3,4,5,6,7,8, x \n-1,2,3,4,5,6,7,8,\nbad\n")
    rows = readers.annotations(spark, p, False).orderBy("line").collect()
    assert [(r["raw_text"], r["text"], r["scorable"]) for r in rows] == [("a, b,c", "a, b,c", True), ("###", "###", False), (" x ", "x", True), ("", "", False), ("", "", False)]
    assert rows[0]["img_id"] == 12 and rows[3]["poly"][0] == -1 and rows[4]["poly"] is None
    assert readers.annotations(spark, p).count() == 2


def test_prediction_modes(spark, tmp_path):
    p = put(tmp_path / "p.tsv", "a\tb\tc\n\nx\n")
    assert [(r["pos"], r["ref"], r["hyp"]) for r in readers.predictions(spark, p).orderBy("pos").collect()] == [(0, "a", "b\tc"), (1, "", ""), (2, "x", "")]
    assert [(r["pos"], r["ref"], r["hyp"]) for r in readers.predictions(spark, p, "S").orderBy("pos").collect()] == [(0, "a", "b"), (1, "x", "")]
    with pytest.raises(ValueError):
        readers.predictions(spark, p, "Q")


def test_sheet_keeps_quotes(spark, tmp_path):
    p = put(tmp_path / "s.tsv", 'idx\tpublic_label\tblind\n1\t"half\t1\n2\tb\n')
    rows = readers.sheet(spark, p).orderBy("idx").collect()
    assert [(r["idx"], r["public_label"], r["blind"], r["action1"]) for r in rows] == [("1", '"half', "1", ""), ("2", "b", "", "")]


def test_results_and_bank(spark, tmp_path):
    for seed in (1, 99):
        put(tmp_path / f"r_seed{seed}.json", json.dumps({"run": "a", "seed": seed, "cer": 0.1, "hp": {"lr": "1"}}, indent=2))
    assert [r["seed"] for r in readers.results(spark, str(tmp_path / "r_seed[0-9]*.json")).collect()] == [1]
    p = put(tmp_path / "b.tsv", 'a"\t3\nb\t1\n')
    assert {tuple(r) for r in readers.bank(spark, p).collect()} == {('a"', 3), ("b", 1)}


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 'q"\nz'), (None, "")], "x string, y string")
    writers.write_tsv(df, ["x", "y"], str(tmp_path / "t"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()} == {'a b\tq" z', "\t"}
    for v in ("1", "2"):
        writers.replace_sheet(spark.createDataFrame([(v,)], "idx string"), ["idx"], str(tmp_path / "sheet"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sheet")).collect()] == ["idx", "2"]
    assert json.loads(writers.as_json(spark.range(1)).first()[0]) == {"id": 0}
    line = writers.report_lines(spark.createDataFrame([("r", 0.5, None)], "k string, a double, b double"), ["k"], ["a", "b"]).first()[0]
    assert line.split() == ["r", "50.000", "nan"]


def test_fonts_and_runs(spark):
    f = spark.createDataFrame([("A", "A[wght].ttf"), ("A", "A-Regular.ttf"), ("B", "B[ital].ttf"), ("B", "B-Bold.ttf")], "family string, name string")
    assert {tuple(r) for r in readers.pick_font(f).collect()} == {("A", "A-Regular.ttf"), ("B", "B[ital].ttf")}
    d = spark.createDataFrame([(10, "strict"), (50, "strict"), (100, "real")], "r int, arm string")
    assert [x[0] for x in d.select(readers.run_directory(F.col("r"), F.col("arm"))).collect()] == ["r10_strict", None, "full_real"]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 9} 0{i % 10}:00:00", f"2024-01-10 00:00:0{i % 10}", 1, i % 5, "accept" if i % 3 else "edit", str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, received_at string, pass_ int, idx int, action string, value string").withColumns({"ts": F.to_timestamp("ts"), "received_at": F.to_timestamp("received_at"), "blind": F.lit("0"), "public_label": F.lit("x"), "pass1": F.lit(None).cast("string"), "warnings": F.array().cast("array<string>")})
    log, state, ck = (str(tmp_path / n) for n in ("log", "state", "ck"))
    want = {tuple(r) for r in events.latest_state(df).collect()}
    for part in (df.where("value < '3'"), df.where("value >= '3'"), df.where("value = '7'")):  # the last again
        writers.append_log(part, log)
        q = events.keep_state(events.read_events(spark, log), state, ck)
        q.awaitTermination()
    got = {(r["idx"], r["ts"], r["pass_"], r["action"], r["value"]) for r in events.read_state(spark, state).collect()}
    assert got == want
    q = events.hourly_actions(events.read_events(spark, log)).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination()
