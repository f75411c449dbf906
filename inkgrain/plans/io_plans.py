"""Queries that write a table in one of the text formats and read it back.

Every query writes its whole table to a new folder of the shared scratch space, so that what comes back is
what the reader made of the file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.operators import review, sampling, score
from inkgrain.plans.common import INSTANCES, instances, table
from inkgrain.plans.score_plans import _OPS, _R, _W, _score_sql
from inkgrain.session import scratch_dir
from inkgrain.sources import readers, writers


def _place(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/inkgrain-{what}-{uuid.uuid4().hex}"


def _flat(c: str) -> Column:
    """Without line ends and tabs, which the formats do not carry."""
    return F.translate(F.coalesce(c, F.lit("")), "\t\n\r", "   ")


def io_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Regions as lines of coordinates and transcript; kept and left-out ones by split."""
    path = _place(spark, "annotations")
    rows = table(spark, d, "instances").select("split", F.concat_ws(",", F.when(F.size("poly") == 8, F.concat_ws(",", "poly")), _flat("raw_text")).alias("value"))
    rows.write.partitionBy("split").text(path)
    out = None
    for split in ("train", "val", "test"):
        got = readers.annotations(spark, f"{path}/split={split}", scorable_only=False)
        part = got.groupBy("scorable").agg(F.count("*").alias("n"), F.count("poly").alias("n_polys"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.coalesce(F.get("poly", F.lit(0)), F.lit(0)).cast("long")).alias("x")).select(F.lit(split).alias("split"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def io_split_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Records whose image number lies in the range of each split."""
    c = F.broadcast(readers.split_catalog(spark))
    i = instances(spark, d, "img_id")
    got = i.join(c.withColumnRenamed("split", "role"), F.col("img_id").between(F.col("first"), F.col("last")))
    return got.groupBy("role", "folder").agg(F.count("*").alias("n"), F.count_distinct("img_id").alias("n_images"))


def io_labels(spark: SparkSession, d: str) -> DataFrame:
    """Path and label of every delivered record."""
    path = _place(spark, "labels")
    rows = table(spark, d, "instances").where("img_path is not null and text is not null and trim(img_path) <> ''")
    writers.write_tsv(rows.select(_flat("img_path").alias("p"), _flat("text").alias("t")), ["p", "t"], path)
    return readers.label_file(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"))


def _predictions(spark: SparkSession, d: str, mode: str) -> DataFrame:
    path = _place(spark, "predictions")
    rows = table(spark, d, "predictions").select(_flat("ref").alias("ref"), _flat("hyp").alias("hyp"))
    writers.write_tsv(rows, ["ref", "hyp"], path)
    got = readers.predictions(spark, path, mode)
    return got.groupBy("ref", "hyp").agg(F.count("*").alias("n"))


def io_predictions_p(spark: SparkSession, d: str) -> DataFrame:
    """Pairs read with blank lines and all after the first tab."""
    return _predictions(spark, d, "P")


def io_predictions_s(spark: SparkSession, d: str) -> DataFrame:
    """Pairs read without blank lines."""
    return _predictions(spark, d, "S")


def io_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The review sheet, replaced as a whole and read again."""
    path = _place(spark, "sheet")
    sheet = table(spark, d, "gold_sheet").select(*[_flat(c).alias(c) for c in readers.SHEET])
    writers.replace_sheet(sheet.limit(0), readers.SHEET, path)
    writers.replace_sheet(sheet, readers.SHEET, path)
    return readers.sheet(spark, path).drop("line")


def io_results(spark: SparkSession, d: str) -> DataFrame:
    """Result records of the seeds as JSON, with the same references in each."""
    path = _place(spark, "results")
    s = score.score(table(spark, d, "predictions"), ["run", "seed"])
    rows = s.select("run", "seed", F.lit(0).alias("iters"), F.col("n").cast("int").alias("n_instances"), F.col("char_ref").cast("int").alias("n_chars"), *[F.round(c, 6).alias(c) for c in ("cer", "exact")])
    writers.write_json(rows, f"{path}/seeds")
    writers.write_json(rows.withColumn("seed", F.lit(99)), f"{path}/seed99")
    got = readers.results(spark, f"{path}/seed*", counts={"n_instances": None, "n_chars": None})
    return got.select("run", "seed", "n_instances", "n_chars", "cer", "exact")


def io_run_directories(spark: SparkSession, d: str) -> DataFrame:
    """The run folders of all budgets and arms."""
    r = spark.createDataFrame([(x,) for x in (10, 25, 50, 100)], "r int")
    a = spark.createDataFrame([(x,) for x in ("real", "synth", "strict")], "arm string")
    return r.join(a, F.lit(True)).select("r", "arm", readers.run_directory(F.col("r"), F.col("arm")).alias("run"))


def io_bank(spark: SparkSession, d: str) -> DataFrame:
    """The token bank by falling count, the token met first before others of its count, numbered as it is read."""
    path = _place(spark, "bank")
    words = table(spark, d, "documents").where("text is not null").select(F.col("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    tokens = words.groupBy("token").agg(F.count("*").alias("cnt"), F.min("doc_id").alias("first"))
    writers.write_frequencies(tokens, path, "first")
    return readers.bank(spark, path)


def io_bank_order(spark: SparkSession, d: str) -> DataFrame:
    """K2: the lines of the bank file in order."""
    path = _place(spark, "bank")
    t = table(spark, d, "instances").groupBy(F.col("source").alias("token")).agg(F.count("*").alias("cnt"), F.min("pos").alias("first")).where("token is not null")
    t = t.withColumn("cnt", (F.col("cnt") / 1000).cast("long"))
    writers.write_frequencies(t, path, "first")
    return readers.lines(spark, path).select("line", F.get(F.split("value", "\t"), F.lit(0)).alias("token"))


def io_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The record of a sample's making, written as one JSON document."""
    path = _place(spark, "manifest")
    rows = instances(spark, d, "source", "scorable").where("scorable")
    whole = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"))
    writers.write_json(writers.manifest(whole, seed="20260711", config={"share": "0.3"}), path)
    return readers.manifest(spark, path, "seed string, config map<string,string>, n_rows long, n_sources long").select("seed", F.col("config")["share"].alias("share"), "n_rows", "n_sources")


def io_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder with the truth of the same name."""
    path = _place(spark, "pictures")
    spark.createDataFrame([(s,) for s in ("val", "test", "train")], "s string").select("s", F.col("s").alias("value")).repartition(1).write.partitionBy("s").text(path)
    truth = table(spark, d, "split_catalog").select(F.concat(F.lit("a/b\\"), F.col("folder")).alias("path"), F.col("split").alias("label"))
    files = readers.pictures(spark, f"{path}/*/*.txt", truth)
    return files.groupBy("bytes").agg(F.count("*").alias("n"), F.count("ref").alias("n_with_truth"))


def io_fonts(spark: SparkSession, d: str) -> DataFrame:
    """One file of each family."""
    f = spark.createDataFrame([("A", "A[wght].ttf"), ("A", "A-Regular.ttf"), ("B", "B[ital].ttf"), ("B", "B-Bold.ttf"), ("C", "C[opsz,wght].ttf"), ("C", "C[wght].ttf"), ("D", "D-Bold.ttf"), ("D", "D-Black.ttf")], "family string, name string")
    return readers.pick_font(f)


def io_event_log(spark: SparkSession, d: str) -> DataFrame:
    """K5: review events appended in two parts."""
    path = _place(spark, "log")
    log = table(spark, d, "review_log").select("ts", "pass_", "idx", "action", "value", "warnings")
    for part in (log.where("pass_ = 1"), log.where("pass_ <> 1")):
        writers.append_log(part, path)
    got = spark.read.schema("ts timestamp, pass_ int, idx int, action string, value string, warnings array<string>").json(path)
    return got.groupBy("pass_", "action").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("n_rows"), F.sum(F.coalesce(F.size(F.coalesce("warnings", F.array().cast("array<string>"))), F.lit(0)).cast("long")).alias("n_warnings"))


def io_report(spark: SparkSession, d: str) -> DataFrame:
    """K8: the lines of a report, as words."""
    path = _place(spark, "report")
    got = table(spark, d, "predictions").groupBy("run", "seed").agg((F.avg((F.col("ref") == F.coalesce("hyp", F.lit(""))).cast("int"))).alias("exact"), F.lit(None).cast("double").alias("none"))
    writers.report_lines(got, ["run", "seed"], ["exact", "none"]).write.text(path)
    return readers.lines(spark, path).select(F.concat_ws(" ", F.filter(F.split("value", " +"), lambda x: x != "")).alias("value"))


def artifact_merge(spark: SparkSession, d: str) -> DataFrame:
    """K6: new rows over old ones, one key dropped, the sum row made anew, in a fixed order."""
    old = table(spark, d, "gold_sheet").groupBy(F.col("stratum").alias("key")).agg(F.count("*").cast("double").alias("value"))
    old = old.union(spark.createDataFrame([("obsolete", 1.0), ("all", -1.0)], "key string, value double"))
    new = table(spark, d, "gold_sheet").where("gold_pass1 <> ''").groupBy(F.col("stratum").alias("key")).agg(F.count("*").cast("double").alias("value"))
    total = lambda rows: rows.agg(F.lit("all").alias("key"), F.sum("value").alias("value"))
    return review.merge_artifact(old, new, "key", ["value"], drop=["obsolete"], derived={"all": total}, first=["small", "dense"])


def background_patches(spark: SparkSession, d: str) -> DataFrame:
    """A free place of 64 by 32 pixels beside the regions of each image, within twelve tries."""
    i = instances(spark, d, "img_id", "poly").where("poly is not null and size(poly) = 8")
    sizes = i.groupBy("img_id").agg(F.max(F.array_max("poly")).alias("side"))
    return sampling.background_patches(sizes, i, 64, 32, "7")


def blind_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The blind rows of a sheet that has been dealt already stay as they are."""
    sheet = table(spark, d, "gold_sheet").select("idx", "stratum", "blind").distinct()
    return sampling.blind_subset(sheet, "stratum", "idx", 0.12, "20260712", F.col("blind") == "1").select("idx", "stratum")


QUERIES = {f.__name__: f for f in (io_annotations, io_split_ranges, io_labels, io_predictions_p, io_predictions_s, io_sheet, io_results, io_run_directories, io_bank, io_bank_order, io_manifest, io_pictures, io_fonts, io_event_log, io_report, artifact_merge, background_patches, blind_assigned)}

_FLAT = lambda c: f"translate(coalesce({c}, ''), chr(9) || chr(10) || chr(13), '   ')"
_PAIRS = f"select {_FLAT('ref')} as ref, {_FLAT('hyp')} as hyp from predictions"
_U = lambda k: f"(('0x' || substr(md5('7/{k}:' || img_id || ':' || try), 1, 13))::bigint / 4503599627370496.0)"
SQL = {
    "io_results": f"{_R} {_OPS}, {_W}, {_score_sql('run, seed')} select run, seed, n::int as n_instances, char_ref::int as n_chars, round(cer, 6) as cer, round(exact, 6) as exact from sc",
    "io_annotations": f"with a as (select split, trim({_FLAT('raw_text')}, ' ') as t, case when len(poly) = 8 then poly end as p from instances) select split, t <> '' and t <> '###' as scorable, count(*) as n, count(p) as n_polys, sum(length(t))::bigint as n_chars, sum(coalesce(p[1], 0))::bigint as x from (select split, case when p is null then '' else t end as t, p from a) group by 1, 2",
    "io_split_ranges": f"with {INSTANCES}, c(role, folder, a, b) as (values ('train', 'train_images', 1, 1200), ('val', 'test_image', 1201, 1500), ('test', 'unseen_test_images', 1501, 2000)) select role, folder, count(*) as n, count(distinct img_id) as n_images from inst join c on img_id between a and b group by 1, 2",
    "io_labels": f"select {_FLAT('text')} as label, count(*) as n, count(distinct {_FLAT('img_path')}) as n_paths from instances where img_path is not null and text is not null and trim(img_path) <> '' group by 1",
    "io_predictions_p": f"select ref, hyp, count(*) as n from ({_PAIRS}) group by 1, 2",
    "io_predictions_s": f"select ref, hyp, count(*) as n from ({_PAIRS}) where trim(ref || hyp, ' ') <> '' group by 1, 2",
    "io_sheet": "select " + ", ".join(f"{_FLAT(c)} as {c}" for c in readers.SHEET) + " from gold_sheet",
    "io_run_directories": "select r, arm, case when arm = 'strict' and r not in (10, 25) then null when r = 100 then 'full_' || arm else 'r' || r || '_' || arm end as run from (values (10), (25), (50), (100)) a(r), (values ('real'), ('synth'), ('strict')) b(arm)",
    "io_bank": "select token, count(*) as cnt from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents where text is not null) group by 1",
    "io_bank_order": "select (row_number() over (order by cnt desc, first, token) - 1)::int as line, token from (select source as token, (count(*) // 1000) as cnt, min(pos) as first from instances where source is not null group by 1)",
    "io_manifest": f"with {INSTANCES} select '20260711' as seed, '0.3' as share, count(*) as n_rows, count(distinct source) as n_sources from inst where scorable",
    "io_pictures": "select length(s) + 1 as bytes, count(*) as n, 0::bigint as n_with_truth from (values ('val'), ('test'), ('train')) t(s) group by 1",
    "io_fonts": "select * from (values ('A', 'A-Regular.ttf'), ('B', 'B[ital].ttf'), ('C', 'C[wght].ttf'), ('D', 'D-Black.ttf')) t(family, name)",
    "io_event_log": "select pass_, action, count(*) as n, count(distinct idx) as n_rows, sum(len(coalesce(warnings, [])))::bigint as n_warnings from review_log group by 1, 2",
    "io_report": "select run || '/' || seed || ' ' || printf('%.3f', avg((ref = coalesce(hyp, ''))::int) * 100) || ' nan' as value from predictions group by run, seed",
    "artifact_merge": "with o as (select stratum as key, count(*)::double as value from gold_sheet group by 1), w as (select stratum as key, count(*)::double as value from gold_sheet where gold_pass1 <> '' group by 1), m as (select * from w union all select * from o where key not in (select key from w)) select * from m union all select 'all', sum(value) from m",
    "background_patches": f"with {INSTANCES}, b as (select img_id, list_min(poly[1:8:2]) as bx0, list_max(poly[1:8:2]) as bx1, list_min(poly[2:8:2]) as by0, list_max(poly[2:8:2]) as by1, list_max(poly) as top from inst where poly is not null and len(poly) = 8), s as (select img_id, max(top) as side from b group by 1), c as (select img_id, try, floor({_U('x')} * greatest(side - 64 + 1, 1))::bigint as x0, floor({_U('y')} * greatest(side - 32 + 1, 1))::bigint as y0 from s, unnest(range(0, 12)) as t(try)), f as (select * from c where not exists (select 1 from b where b.img_id = c.img_id and c.x0 < b.bx1 and b.bx0 < c.x0 + 64 and c.y0 < b.by1 and b.by0 < c.y0 + 32)), k as (select img_id, min(try)::int as try, arg_min(x0, try) as x0, arg_min(y0, try) as y0 from f group by 1) select * from k qualify row_number() over (order by md5('7:' || img_id), img_id) <= 5000",
    "blind_assigned": "select distinct idx, stratum from gold_sheet where blind = '1'",
}
