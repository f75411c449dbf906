"""Exact percentiles whose groups need not fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrain.session import settle


def _cell(v: Column) -> Column:
    """A whole number that never falls as the value grows: 64 for each power of two."""
    size = F.floor(F.log2(F.abs(v)) * 64) + 100_000
    return F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.lit(10**6)).otherwise(size).cast("long") * F.signum(v).cast("long")


def quantiles(rows: DataFrame, by: list[str], value: Column, ps: list[float]) -> DataFrame:
    """``(*by, qs)``: the percentiles of *value* in the order of *ps*, with linear interpolation.

    Values are counted first (map-side), the counts summed in cells of near values, and only the cells that
    hold a wanted rank are summed value by value, each on its own.  Nulls and NaN are left out; a group
    without any value gives no row; a null group is a group of its own.
    """
    v = value.cast("double")
    each = rows.select(*by, v.alias("_v")).where("_v is not null and not isnan(_v)").groupBy(*by, "_v").agg(F.count("*").alias("_w"))
    each = settle(each.withColumn("_c", _cell(F.col("_v"))))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cells = each.groupBy(*by, "_c").agg(F.sum("_w").alias("_w"))
    cells = cells.withColumn("_upto", F.sum("_w").over(group.orderBy("_c"))).withColumn("_n", F.sum("_w").over(group))
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.lit(float(p)) * (F.col("_n") - 1), 9).alias("at")) for i, p in enumerate(ps)])
    want = F.transform(want, lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at"), F.floor(x["at"]).alias("r"), F.least(F.floor(x["at"]) + 1, F.col("_n") - 1).alias("r1")))
    low = F.col("_upto") - F.col("_w")
    holds = lambda x, a, b: ((a <= x["r"]) & (x["r"] < b)) | ((a <= x["r1"]) & (x["r1"] < b))
    hit = cells.select(*[F.col(k).alias(f"_{k}_") for k in by], F.col("_c").alias("_k"), low.alias("_below"), F.filter(want, lambda x: holds(x, low, F.col("_upto"))).alias("_want")).where(F.size("_want") > 0)
    same = F.col("_c") == F.col("_k")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    near = each.join(hit, same).select(*by, "_c", "_v", "_w", "_below", "_want")
    hi = F.sum("_w").over(Window.partitionBy(*by, "_c").orderBy("_v")) + F.col("_below")
    near = near.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_w")).select(*by, "_v", "_lo", "_hi", F.inline("_want"))
    at = lambda r: F.max(F.when((F.col("_lo") <= F.col(r)) & (F.col(r) < F.col("_hi")), F.col("_v")))
    got = near.groupBy(*by, "i").agg(F.max("at").alias("at"), F.max("r").alias("r"), at("r").alias("v0"), at("r1").alias("v1"))
    part = F.col("at") - F.col("r")
    q = F.when((F.col("v0") == F.col("v1")) | (part == 0), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part)
    return got.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("qs")).where(F.size("qs") > 0)
