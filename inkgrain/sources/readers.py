"""Readers (S1-S13, S16): text formats with explicit rules, never with inferred types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrain.functions.text import transcript_kind

# Role of a split, its folder and its image numbers.
SPLITS = [("train", "train_images", 1, 1200), ("val", "test_image", 1201, 1500), ("test", "unseen_test_images", 1501, 2000)]
RESULT = "run string, seed int, iters int, n_instances int, n_chars int, cer double, wer double, exact double, axis1_base double, axis2_modifier double, axis3_tone double, hp map<string,string>"
SHEET = ["idx", "crop_file", "img_id", "stratum", "public_label", "gold_pass1", "gold_pass2", "blind", "action1", "action2", "resolved"]


def split_catalog(spark: SparkSession) -> DataFrame:
    """``(split, folder, first, last)``."""
    return spark.createDataFrame(SPLITS, "split string, folder string, first int, last int")


def lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """``(file, line, value)`` with the line's number in its file, counted from 0, among the lines that *keep* (on
    ``value``) holds for (S3, H13).

    Files are split as Spark likes: lines are counted in each part of a file, and the parts' counts summed up
    to where each begins.  No file is read by one task.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.regexp_replace("value", r"\r$", "").alias("value"))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    parts = rows.groupBy("file", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    upto = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = parts.select(F.col("file").alias("_f"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    got = rows.join(begin, (F.col("file") == F.col("_f")) & (F.col("_part") == F.col("_p")))
    return got.select("file", (F.col("_before") + F.col("_id") - F.col("_first")).cast("int").alias("line"), "value")


def annotations(spark: SparkSession, path: str, scorable_only: bool = True) -> DataFrame:
    """``(img_id, line, poly, text, raw_text, scorable)`` of ``x1,...,y4,TRANSCRIPT`` lines.

    The transcript is all after the eighth comma, commas included; a line with fewer fields or with
    a coordinate that is no whole number gives a null polygon and an empty transcript.
    """
    parts = F.split("value", ",", 9)
    coords = F.transform(F.slice(parts, 1, 8), lambda x: F.try_to_number(F.trim(x), F.lit("S99999999")).cast("int"))
    ok = (F.size(parts) >= 8) & F.forall(coords, lambda x: x.isNotNull())
    raw = F.coalesce(F.get(parts, F.lit(8)), F.lit(""))
    number = F.regexp_extract("file", r"(\d+)[^/\d]*$", 1)
    rows = lines(spark, path).where(F.trim("value") != "").select(F.when(number != "", number.cast("int")).alias("img_id"), "line", F.when(ok, coords).alias("poly"), F.trim(raw).alias("text"), raw.alias("raw_text"))
    rows = rows.withColumn("scorable", transcript_kind(F.col("text")) == "kept")
    return rows.where("scorable") if scorable_only else rows


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """``(line, path, label)``; the label is all after the first tab."""
    p = F.split("value", "\t", 2)
    return lines(spark, path).where(F.trim("value") != "").select("line", F.get(p, F.lit(0)).alias("path"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("label"))


def predictions(spark: SparkSession, path: str, mode: str = "P") -> DataFrame:
    """``(pos, ref, hyp)``.  Mode P keeps blank lines and all after the first tab (S5); mode S drops
    blank lines and takes the second field only (S6)."""
    if mode == "P":
        rows, p = lines(spark, path), F.split("value", "\t", 2)
    elif mode == "S":
        rows, p = lines(spark, path, F.trim("value") != ""), F.split("value", "\t")
    else:
        raise ValueError("mode is P or S")
    return rows.select(F.col("line").alias("pos"), F.get(p, F.lit(0)).alias("ref"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("hyp"))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """The review sheet: a header and tab-separated cells without any quoting; short rows and
    missing columns are filled with '' (S7)."""
    rows = lines(spark, path)
    head = rows.where("line = 0").select("file", F.split("value", "\t").alias("names"))
    cells = rows.where("line > 0 and value <> ''").withColumn("cells", F.split("value", "\t")).join(F.broadcast(head), "file")
    at = lambda c: F.coalesce(F.get("cells", (F.array_position("names", c) - 1).cast("int")), F.lit(""))
    have: Column = F.col("names")
    return cells.select("line", *[F.when(F.array_contains(have, c), at(c)).otherwise("").alias(c) for c in SHEET])


def results(spark: SparkSession, glob: str, counts: dict[str, int | None] | None = None) -> DataFrame:
    """Result records of a glob of JSON files, dry runs (``seed99``) left out.

    ``counts`` names the counts that must be the same in every record, and what they must be (None: as in
    the others); a record that differs raises.
    """
    df = spark.read.schema(RESULT).option("multiLine", False).json(glob) if counts is not None else spark.read.schema(RESULT).option("multiLine", True).json(glob)
    df = df.withColumn("file", F.input_file_name()).where(~F.col("file").contains("seed99"))
    for c, n in (counts or {}).items():
        want = df.agg(F.min(c).alias("_w")) if n is None else spark.range(1).select(F.lit(n).alias("_w"))
        df = df.join(F.broadcast(want), F.lit(True)).withColumn(c, F.when(F.col(c) == F.col("_w"), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs between records")))).drop("_w")
    return df


def run_directory(r: Column, arm: Column) -> Column:
    """Name of the runs of a budget and arm; the strict arm exists at 10 and 25 percent only, and the
    full budget stands for itself (S9)."""
    return F.when((arm == "strict") & ~r.isin(10, 25), None).when(r == 100, F.concat(F.lit("full_"), arm)).otherwise(F.concat(F.lit("r"), r.cast("string"), F.lit("_"), arm))


def bank(spark: SparkSession, path: str) -> DataFrame:
    """``(token, cnt)`` of a tab-separated frequency file."""
    return spark.read.schema("token string, cnt long").option("sep", "\t").option("quote", "").csv(path)


def vocabulary(spark: SparkSession, text: str) -> DataFrame:
    """``(ch)``: the distinct characters of a vocabulary string."""
    return spark.createDataFrame([(c,) for c in sorted(set(text))], "ch string")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def pictures(spark: SparkSession, folder: str, truth: DataFrame | None = None) -> DataFrame:
    """``(path, name, bytes, ref)`` of the files of a folder, with the truth of the same base name
    where there is one (S16, J13).  ``truth(path, label)``."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))
    if truth is None:
        return files.withColumn("ref", F.lit(None).cast("string"))
    t = truth.select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("_n"), F.col("label").alias("ref"))
    return files.join(t, F.col("name") == F.col("_n"), "left").drop("_n")


def pick_font(files: DataFrame, family: str = "family", name: str = "name") -> DataFrame:
    """One font file of each family: static Regular, then ``[wght]``, then any variable, then the
    first by name (S17)."""
    n = F.col(name)
    rank = F.when(n.endswith("-Regular.ttf"), 0).when(n.contains("[wght]"), 1).when(n.contains("["), 2).otherwise(3)
    return files.groupBy(family).agg(F.min_by(name, F.struct(rank, n)).alias(name))
