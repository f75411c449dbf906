"""Audits of annotated text and of measured distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrain.functions.text import chars, nfc, transcript_kind, vocab_pattern, word_list
from inkgrain.operators.quantiles import quantiles
from inkgrain.session import settle

# Bin edges of the measured strata.
BINS = {
    "height": [0, 12, 16, 20, 24, 32, 48, 1e9],
    "contrast": [0, 0.2, 0.3, 0.4, 0.5, 0.65, 1.01],
    "length": [0, 2, 4, 6, 9, 13, 1e9],
    "tilt": [0, 2, 5, 10, 20, 91],
}
TILT_COARSE = [0, 5, 10, 20, 91]


def split_audit(records: DataFrame, split: str, text: str) -> DataFrame:
    """Rows, kept, hash, empty, characters and words of each split and of ``ALL``."""
    kind, t = transcript_kind(F.col(text)), nfc(F.trim(text))
    rows = records.select(F.col(split).alias("split"), kind.alias("kind"), F.when(kind == "kept", F.length(t)).alias("c"), F.when(kind == "kept", F.size(word_list(t))).alias("w"))
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    g = rows.rollup("split").agg(F.grouping("split").alias("top"), F.count("*").alias("total"), n("kept").alias("kept"), n("hash").alias("hash"), n("empty").alias("empty"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"))
    return g.withColumn("split", F.when(F.col("top") == 1, "ALL").otherwise(F.col("split"))).drop("top")


def charset(records: DataFrame, text: str) -> DataFrame:
    """``(ch, n, is_ascii, is_mark)`` of every character."""
    rows = records.select(F.explode(chars(F.col(text))).alias("ch"))
    return rows.groupBy("ch").agg(F.count("*").alias("n")).select("ch", "n", F.col("ch").rlike(r"^[\x00-\x7F]$").alias("is_ascii"), F.col("ch").rlike(r"^\p{M}$").alias("is_mark"))


def vocab_coverage(records: DataFrame, split: str, text: str, vocab: str) -> DataFrame:
    """Per split: records, characters, out-of-vocabulary characters, their percentage and the
    records with any (A13).  Counted in place, nothing is exploded."""
    t = nfc(F.col(text))
    stray = F.size(F.filter(chars(t), lambda x: ~x.rlike(vocab_pattern(vocab))))
    g = records.where(F.col(text).isNotNull()).groupBy(split).agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.sum(stray).alias("oov"), F.sum((stray > 0).cast("long")).alias("n_with_oov"))
    return g.withColumn("oov_pct", F.round(F.try_divide(F.col("oov") * 100.0, F.col("chars")), 4))


def oov_inventory(records: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """``(ch, n)`` of the characters that *vocab(ch)* lacks, most frequent first."""
    rows = records.select(F.explode(chars(nfc(F.col(text)))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return rows.join(vocab, "ch", "left_anti").orderBy(F.col("n").desc(), "ch")


def label_integrity(records: DataFrame, text: str, vocab: str) -> DataFrame:
    """Counts of labels that are not composed, or not within the vocabulary (F16)."""
    t = F.col(text)
    return records.where(t.isNotNull()).agg(F.count("*").alias("n"), F.sum((nfc(t) != t).cast("long")).alias("not_composed"), F.sum((~t.rlike(vocab_pattern(vocab))).cast("long")).alias("out_of_vocab"))


def bin_of(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin ``[edge, next)`` that holds *x*, null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((x >= a) & (x < b), F.lit(i)).otherwise(out)
    return F.when(F.isnan(x.cast("double")), F.lit(None)).otherwise(out)


def binned(features: DataFrame, bins: dict[str, list[float]] | None = None) -> DataFrame:
    """One row for each feature and stratum: the columns of *features*, ``stratum``, ``bin`` and its
    ``lo``; values outside all bins give no row."""
    bins = bins or BINS
    cells = [F.struct(F.lit(s).alias("stratum"), bin_of(F.col(s), e).alias("bin"), F.get(F.array(*[F.lit(float(x)) for x in e]), bin_of(F.col(s), e)).alias("lo")) for s, e in bins.items()]
    return features.select("*", F.inline(F.array(*cells))).where("bin is not null")


def stratified(counts: DataFrame, features: DataFrame, bins: dict[str, list[float]] | None = None) -> DataFrame:
    """Per run, stratum and bin: records, characters of the first seed, and the median over seeds
    of CER, base (case-insensitive), modifier and tone accuracy (A14, J1).

    ``counts(run, seed, pos, char_edits, char_ref, base_ok_ci, base_n, ...)`` has one row a pair.
    """
    f = binned(features, bins).select("pos", "stratum", "bin", "lo")
    sums = ["char_edits", "char_ref", "base_ok_ci", "base_n", "mod_ok", "mod_n", "tone_ok", "tone_n"]
    s = counts.join(f, "pos").groupBy("run", "stratum", "bin", "lo", "seed").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    whole = lambda c: F.round(F.when(F.count(c) == F.count("*"), F.median(c)), 9)
    r = s.withColumns({"cer": rate("char_edits", "char_ref"), "base": rate("base_ok_ci", "base_n"), "mod": rate("mod_ok", "mod_n"), "tone": rate("tone_ok", "tone_n")})
    return r.groupBy("run", "stratum", "bin", "lo").agg(F.min_by("n", "seed").alias("n"), F.min_by("char_ref", "seed").alias("chars"), F.count("*").alias("k"), whole(F.col("cer")).alias("cer"), whole(F.col("base")).alias("base_ci"), whole(F.col("mod")).alias("mod"), whole(F.col("tone")).alias("tone"))


def percentile_summary(values: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``p5, p25, p50, p75, p95, min, max, mean`` of each column in long form (A17); exact, with
    linear interpolation.  Nulls and NaN are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = values.select(*by, F.inline(cells)).where("v is not null and not isnan(v)")
    rows = settle(rows)
    q = quantiles(rows, [*by, "stat"], F.col("v"), [0.05, 0.25, 0.5, 0.75, 0.95]).withColumnsRenamed({k: f"_{k}" for k in [*by, "stat"]})
    g = rows.groupBy(*by, "stat").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count("*").alias("n"))
    same = F.lit(True)
    for k in [*by, "stat"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    g = g.join(q, same).withColumnRenamed("qs", "q")
    return g.select(*by, "stat", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], "min", "max", "mean", "n")


def coverage_audit(real: DataFrame, synth: DataFrame, low: list[str], high: list[str], log: list[str]) -> DataFrame:
    """Whether a made set reaches into the hard tail of the real one (C12): ``stat, reach, centre,
    cleaner, passes``.  Statistics in neither list are judged by their centre only."""
    r = real.select("stat", *[F.col(c).alias(f"{c}_r") for c in ("p5", "p25", "p50", "p75", "p95")])
    s = synth.select("stat", *[F.col(c).alias(f"{c}_s") for c in ("p5", "p50", "p95")])
    is_low, is_high, is_log = (F.col("stat").isin(*x) if x else F.lit(False) for x in (low, high, log))
    scale = lambda c: F.when(is_log, F.log10(F.greatest(F.col(c), F.lit(1e-3)))).otherwise(F.col(c))
    shift = scale("p50_s") - scale("p50_r")
    reach = F.when(is_low, F.col("p5_s") <= 1.20 * F.col("p5_r")).when(is_high, F.col("p95_s") >= 0.90 * F.col("p95_r")).otherwise(True)
    centre = F.abs(shift) <= 1.25 * F.greatest(scale("p75_r") - scale("p25_r"), F.lit(1e-6))
    cleaner = F.when(is_low, (shift > F.when(is_log, 0.15).otherwise(0.0)) & (F.col("p50_s") > 1.20 * F.col("p50_r"))).when(is_high, F.col("p50_s") < 0.70 * F.col("p50_r")).otherwise(False)
    return r.join(s, "stat").select("stat", reach.alias("reach"), centre.alias("centre"), cleaner.alias("cleaner"), (reach & centre & ~cleaner).alias("passes"))


def ratio_histogram(rows: DataFrame, by: list[str], ratio: Column) -> DataFrame:
    """Percent of rows in each of 15 bins of 0.1 after clipping to [0, 1.499]."""
    x = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.499))
    g = rows.where(ratio.isNotNull()).groupBy(*by, F.floor(x * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*by)), 6))


def length_curve(pairs: DataFrame, by: list[str], least: int = 15) -> DataFrame:
    """Mean predicted length by reference length, where at least *least* pairs have it."""
    p = pairs.select(*by, F.length("ref").alias("ref_len"), F.length("hyp").alias("hyp_len"))
    return p.groupBy(*by, "ref_len").agg(F.count("*").alias("n"), F.round(F.avg("hyp_len"), 6).alias("mean_hyp_len")).where(F.col("n") >= least)


def truncation(pairs: DataFrame, by: list[str], long: int = 9, severe: float = 0.6) -> DataFrame:
    """Mean lengths of long pairs and the percentage severely cut short."""
    p = pairs.where(F.length("ref") >= long)
    cut = (F.length("hyp") < severe * F.length("ref")).cast("int")
    return p.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.length("ref")), 6).alias("mean_ref_len"), F.round(F.avg(F.length("hyp")), 6).alias("mean_hyp_len"), F.round(F.avg(cut) * 100, 6).alias("severe_pct"))


def text_profile(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """Token counts, length quantiles and shares of letter case, digits and single characters."""
    t = F.col(text)
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    q = F.percentile(F.length(t), F.array(F.lit(0.5), F.lit(0.9)))
    g = rows.where(t.isNotNull() & (t != "")).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.size(word_list(t))), 9).alias("mean_tokens"), q.alias("q"), share((F.upper(t) == t) & (F.lower(t) != t)).alias("upper"), share(t.rlike(r"\p{Lu}") & ~t.rlike(r"(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")).alias("title"), share(F.lower(t) != F.upper(t)).alias("has_letter"), share(t.rlike(r"\p{Ll}")).alias("has_lower"), share(t.rlike("[0-9]")).alias("has_digit"), share(F.length(t) == 1).alias("one_char"))
    return g.withColumns({"median_len": F.get("q", F.lit(0)), "p90_len": F.get("q", F.lit(1))}).drop("q")


def end_slope(points: DataFrame, by: list[str], x: str, y: str, lo: float, hi: float) -> DataFrame:
    """Least-squares slope of *y* over *x* within [lo, hi]."""
    return points.where(F.col(x).between(lo, hi)).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("n"))


def first_match_stratum(f: DataFrame) -> DataFrame:
    """``stratum`` by the first rule that holds: dense, small, low contrast, plain.
    Thresholds are the lower quartiles of height (truncated, of positive heights) and contrast."""
    small = quantiles(f.where("height > 0"), [], F.col("height"), [0.25]).select(F.floor(F.get("qs", F.lit(0))).alias("small_px"))
    low = quantiles(f, [], F.col("contrast"), [0.25]).select(F.get("qs", F.lit(0)).alias("low_contrast"))
    q = f.sparkSession.range(1).join(small, F.lit(True), "left").join(low, F.lit(True), "left").drop("id")
    rule = F.when(F.col("n_diacritic") >= 4, "dense").when((F.col("height") > 0) & (F.col("height") <= F.col("small_px")), "small").when(F.round("contrast", 4) <= F.col("low_contrast"), "low_contrast").otherwise("plain")
    return f.crossJoin(F.broadcast(q)).withColumn("stratum", rule)
