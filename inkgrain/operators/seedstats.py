"""Statistics over training seeds and the verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Student's t at 95 % two-sided by degrees of freedom 1 to 9.
T95 = [12.706204736432095, 4.302652729911275, 3.182446305284263, 2.776445105198166, 2.570581835636197, 2.446911850791612, 2.364624251592785, 2.306004135204166, 2.262157162798205]
Z95 = 1.96
LOWER_IS_BETTER = ["cer", "wer", "sub", "del", "ins"]
FULL_BUDGET = 25_742


def t_value(dof: Column) -> Column:
    """t for 1 to 9 degrees of freedom, null outside."""
    return F.when((dof >= 1) & (dof <= len(T95)), F.get(F.array(*[F.lit(t) for t in T95]), (dof - 1).cast("int")))


def seed_stats(values: DataFrame, by: list[str], value: str = "value", seed: str = "seed", method: str = "t") -> DataFrame:
    """``k, seeds, median, mean, std, ci95_half, range`` of each group.

    One undefined value makes every statistic of its group null.  ``method='t'`` needs two to ten
    seeds, ``'z'`` more than two; else the half-width is null.
    """
    v = F.col(value)
    whole = F.count(v) == F.count("*")
    g = values.groupBy(*by).agg(
        F.count("*").alias("k"), F.transform(F.sort_array(F.collect_list(F.struct(F.col(seed).alias("s"), F.round(v, 6).alias("v")))), lambda x: x["v"]).alias("seeds"), F.when(whole, F.median(v)).alias("median"), F.when(whole, F.avg(v)).alias("mean"),
        F.when(whole, F.stddev_samp(v)).alias("std"), F.when(whole, F.max(v) - F.min(v)).alias("range"),
    )
    half = t_value(F.col("k") - 1) * F.col("std") / F.sqrt("k") if method == "t" else F.when(F.col("k") > 2, Z95 * F.col("std") / F.sqrt("k"))
    return g.withColumn("ci95_half", half)


def unpivot_rates(scores: DataFrame, keys: list[str], metrics: list[str], scale: float = 100.0) -> DataFrame:
    """One row a metric, in percent."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) * scale).alias("value")) for m in metrics])
    return scores.select(*keys, F.inline(cells))


def overlaps(am: Column, ah: Column, bm: Column, bh: Column) -> Column:
    """Whether two intervals touch; unknown bounds count as touching."""
    apart = (am + ah < bm - bh) | (bm + bh < am - ah)
    return F.coalesce(~apart, F.lit(True))


def compare(stats: DataFrame, base: str, arm: str, run: str = "run", keep: list[str] = ()) -> DataFrame:
    """Each metric of *arm* against *base*: difference, overlap, improved, difference interval
    (C1, C2, C5, J10)."""
    a = stats.where(F.col(run) == base).select(*keep, "metric", F.col("mean").alias("base_mean"), F.col("ci95_half").alias("base_half"), F.col("k").alias("base_k"))
    b = stats.where(F.col(run) == arm).select(*keep, "metric", F.col("mean").alias("arm_mean"), F.col("ci95_half").alias("arm_half"), F.col("k").alias("arm_k"))
    j = a.join(b, [*keep, "metric"])
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    gain = F.when(lower, F.col("base_mean") - F.col("arm_mean")).otherwise(F.col("arm_mean") - F.col("base_mean"))
    t = t_value(F.least("base_k", "arm_k") - 1)
    half = t * F.sqrt(F.pow(F.col("base_half") / t_value(F.col("base_k") - 1), 2) + F.pow(F.col("arm_half") / t_value(F.col("arm_k") - 1), 2))
    return j.withColumn("overlap", overlaps(F.col("base_mean"), F.col("base_half"), F.col("arm_mean"), F.col("arm_half"))).withColumn("gain", gain).withColumn("improved", gain > 0).withColumn("gain_half", half).withColumn("clears", F.coalesce(F.abs(F.col("gain")) > F.col("gain_half"), F.lit(False)))


def gate(compared: DataFrame, metrics: list[str], keep: list[str] = ()) -> DataFrame:
    """GREEN where every one of *metrics* is separated and improved, else RED."""
    ok = ~F.col("overlap") & F.col("improved")
    rows = compared.where(F.col("metric").isin(*metrics))
    return rows.groupBy(*keep).agg(F.when(F.every(ok) & (F.count("*") == len(metrics)), "GREEN").otherwise("RED").alias("verdict"))


def strongest(stats: DataFrame, arms: list[str], run: str = "run") -> DataFrame:
    """The better arm for each metric, the first named on a tie (C4)."""
    rank = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col(run))
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("mean")).otherwise(-F.col("mean"))
    rows = stats.where(F.col(run).isin(*arms) & F.col("mean").isNotNull())
    return rows.groupBy("metric").agg(F.min_by(F.struct(F.col(run).alias("arm"), "mean"), F.struct(good, rank)).alias("x")).select("metric", "x.*")


def gain_share(before: DataFrame, after: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Characters fixed in each bin and their share of all fixed."""
    j = before.select(*by, F.col("edits").alias("edits_before")).join(after.select(*by, F.col("edits").alias("edits_after")), by)
    fixed = F.col("edits_before") - F.col("edits_after")
    return j.withColumn("fixed", fixed).withColumn("share", F.try_divide(F.col("fixed"), F.sum("fixed").over(Window.partitionBy(*within))))


def insertion_attribution(mix: DataFrame) -> DataFrame:
    """``mix(pair, cer_a, cer_b, sub_a, sub_b, del_a, del_b, ins_a, ins_b)`` -> parts of the CER
    change by kind, and whether insertions lead (C7)."""
    d = {k: F.col(f"{k}_b") - F.col(f"{k}_a") for k in ("cer", "sub", "del", "ins")}
    return mix.select("*", *[F.try_divide(d[k], d["cer"]).alias(f"{k}_part") for k in ("sub", "del", "ins")], (d["ins"] > F.greatest(d["sub"], d["del"])).alias("insertions_lead"))


def recovery(gain_control: Column, gain_full: Column) -> Column:
    """How much of the gain a control keeps: ``recovered`` from 80 %, ``lost`` under 50 %, else
    ``between`` (C8)."""
    part = F.try_divide(gain_control, gain_full) * 100
    return F.when(part >= 80, "recovered").when(part < 50, "lost").when(part.isNotNull(), "between")


def paired_t(values: DataFrame, a: str, b: str, run: str = "run") -> DataFrame:
    """``(metric, k, mean_d, t, exceeds)`` over the seeds both runs have."""
    x = values.where(F.col(run) == a).select("metric", "seed", F.col("value").alias("va"))
    y = values.where(F.col(run) == b).select("metric", "seed", F.col("value").alias("vb"))
    d = x.join(y, ["metric", "seed"]).withColumn("d", F.col("vb") - F.col("va"))
    g = d.groupBy("metric").agg(F.count("d").alias("k"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd"))
    return g.withColumn("t", F.try_divide(F.col("mean_d"), F.col("sd") / F.sqrt("k"))).withColumn("exceeds", F.abs("t") > t_value(F.col("k") - 1)).drop("sd")


def invert_curve(curve: DataFrame, asks: DataFrame, by: list[str]) -> DataFrame:
    """The budget r at which a curve ``(*by, r, y)`` reaches each asked value ``(*by, *, target)``:
    linear in log r on the first segment that brackets it; null outside the values at the first
    and last r (C9)."""
    w = Window.partitionBy(*by).orderBy("r")
    seg = curve.withColumn("r1", F.lead("r").over(w)).withColumn("y1", F.lead("y").over(w)).withColumnsRenamed({"r": "r0", "y": "y0"})
    ends = curve.groupBy(*by).agg(F.min_by("y", "r").alias("first"), F.max_by("y", "r").alias("last"))
    inside = F.col("target").between(F.least("first", "last"), F.greatest("first", "last"))
    ok = F.col("target").between(F.least("y0", "y1"), F.greatest("y0", "y1")) & (F.col("y0") != F.col("y1"))
    at = F.exp(F.log("r0") + (F.col("target") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.log("r1") - F.log("r0")))
    id_ = [c for c in asks.columns if c not in by]
    got = asks.join(ends, by).where(inside).join(seg.where("r1 is not null"), by).where(ok).groupBy(*by, *id_).agg(F.min_by(at, "r0").alias("r_at"))
    return asks.join(got, [*by, *id_], "left")


def worth(curve: DataFrame, arm: DataFrame, by: list[str], full: int = FULL_BUDGET) -> DataFrame:
    """Real records an arm is worth, with its range over the corners of both intervals.

    ``curve(*by, r, y, half)`` is real data only; ``arm(*by, r, y, half)`` are the points asked.
    The curve's point at the arm's r and the arm's y each move by -1, 0 and 1 half-width.
    """
    steps = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = arm.select(*by, F.col("r").alias("r_arm"), F.col("y").alias("y_arm"), F.col("half").alias("h_arm")).withColumn("sy", steps).withColumn("sa", steps)
    moved = a.join(curve, by).select(*by, "r_arm", "sy", "sa", "r", (F.col("y") + F.when(F.col("r") == F.col("r_arm"), F.col("sa") * F.col("half")).otherwise(0.0)).alias("y"))
    asks = a.select(*by, "r_arm", "sy", "sa", (F.col("y_arm") + F.col("sy") * F.col("h_arm")).alias("target"))
    got = invert_curve(moved, asks, [*by, "r_arm", "sy", "sa"]).withColumn("n", (F.col("r_at") - F.col("r_arm")) / 100 * full)
    mid = F.max(F.when((F.col("sy") == 0) & (F.col("sa") == 0), F.col("n")))
    return got.groupBy(*by, "r_arm").agg(mid.alias("worth"), F.min("n").alias("worth_lo"), F.max("n").alias("worth_hi"), (F.count("n") < F.count("*")).alias("truncated"))


def retention(gaps: DataFrame) -> DataFrame:
    """The part of the full bank's gain that the strict bank keeps (C11): ``gaps(*, real, full,
    strict)`` with lower better."""
    return gaps.withColumn("kept", F.try_divide(F.col("real") - F.col("strict"), F.col("real") - F.col("full")))
