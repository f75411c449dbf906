"""Small selections around pictures and fonts.

Reading pixels and font files is left to callers; what is decided from their tables is here.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.functions import glyphs
from inkgrain.functions.text import chars

_VOWELS = "aăâeêioôơuưy"


def accented(spark: SparkSession) -> DataFrame:
    """``(ch, base, modifier, tone)``: every marked Vietnamese vowel in both cases, and đ."""
    made = {c for v in _VOWELS for t in ["", *glyphs.TONES] for x in [unicodedata.normalize("NFC", v + t)] for c in (x, x.upper()) if not c.isascii()} | set(glyphs.STROKED)
    return spark.createDataFrame([(c, *glyphs.decompose(c)) for c in sorted(made)], "ch string, base string, modifier string, tone string")


def stacked(spark: SparkSession) -> DataFrame:
    """``(ch, no_tone, no_mod)``: the sixty letters with a shape and a tone, and each without one of
    them (T19)."""
    out = []
    for ch, base, modifier, tone in [(c, *glyphs.decompose(c)) for v in "ăâêôơư" for t in glyphs.TONES for x in [unicodedata.normalize("NFC", v + t)] for c in (x, x.upper())]:
        shape = next(m for m, k in glyphs.MODIFIERS.items() if k == modifier)
        mark = next(m for m, k in glyphs.TONES.items() if k == tone)
        out.append((ch, unicodedata.normalize("NFC", base + shape), unicodedata.normalize("NFC", base + mark)))
    return spark.createDataFrame(out, "ch string, no_tone string, no_mod string")


def covers(text: Column, cmap: Column) -> Column:
    """Whether a font's code points have every character of a text; spaces need no glyph."""
    return F.size(F.array_except(F.transform(chars(F.regexp_replace(text, " ", "")), lambda c: F.ascii(c)), cmap)) == 0


def gate(fonts: DataFrame, needed: DataFrame) -> DataFrame:
    """``fonts(family, cmap, dropped)`` against ``needed(ch)`` -> ``(family, missing, verdict)``: PASS
    where no character lacks a glyph and no mark is dropped, FAIL too where the font could not be
    read (F12, U2)."""
    need = needed.agg(F.sort_array(F.collect_set("ch")).alias("need"))
    lack = F.filter("need", lambda c: ~F.array_contains(F.col("cmap"), F.ascii(c)))
    got = fonts.crossJoin(F.broadcast(need)).withColumn("missing", lack)
    ok = (F.size("missing") == 0) & (F.coalesce("dropped", F.lit(1)) == 0) & F.col("cmap").isNotNull()
    return got.select("family", "missing", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("verdict"))


def checked_selection(selected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The selected families; one that did not pass, or was not judged, raises."""
    v = verdicts.select(F.col("family").alias("_f"), "verdict")
    j = selected.join(v, F.col("family") == F.col("_f"), "left").drop("_f")
    bad = F.coalesce(F.col("verdict"), F.lit("none")) != "PASS"
    return j.withColumn("family", F.when(bad, F.raise_error(F.concat(F.lit("not passed: "), F.col("family")))).otherwise(F.col("family"))).select(*selected.columns)


def easy_samples(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first *n* rows by ``pos`` that any reader should get right: four characters, 32 pixels,
    a wide range of grey and, where there is a column ``std``, a wide spread (F10, W9)."""
    if "std" in rows.columns:
        rows = rows.where(F.col("std") > 0.22)
    return rows.where((F.col("length") >= 4) & (F.col("height") >= 32) & (F.col("contrast") > 0.75) & ~F.isnan("contrast")).orderBy("pos").limit(n)


def patch_weights(patches: DataFrame) -> DataFrame:
    """Weights of background patches by their edge density."""
    return patches.withColumn("weight", 0.15 + F.col("edge_density"))


# What a gap between test and train error, and the test error itself, speak for.
LARGE_GAP, LOW_CER = 5.0, 0.10


def probe_reading(gap_pp: Column, test: Column) -> Column:
    """How to read a probe (C14): a large gap speaks of seen training texts, a small one with a low error of all
    texts seen, a small one with a high error of none.  Null where either is."""
    known = gap_pp.isNotNull() & test.isNotNull()
    return F.when(known, F.when(gap_pp >= LARGE_GAP, "train seen: escalate").when(test <= LOW_CER, "all seen: escalate").otherwise("no sign of exposure"))


def probe_gap(scores: DataFrame, by: list[str], split: str = "split", metric: str = "cer") -> DataFrame:
    """Test minus train error in percentage points; a large gap speaks of seen texts."""
    part = lambda s: F.max(F.when(F.col(split) == s, F.col(metric)))
    g = scores.groupBy(*by).agg(part("train").alias("train"), part("test").alias("test"))
    return g.withColumn("gap_pp", (F.col("test") - F.col("train")) * 100)
