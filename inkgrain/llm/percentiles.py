"""Problem 4: percentiles of very large numeric columns.

Method: exact bisection.  A value interval is kept for every group and wanted rank; each pass
counts the rows below the midpoints of all intervals at once and keeps the part that holds the
rank.  A pass sets many midpoints in each interval rather than one, so doubles need few passes: the
first 256 for each power of two, so that wide ranges and heavy tails take no more passes than narrow
ones, later ones ``2**bits - 1`` evenly.  Intervals shrink to the values met, so ties end at once.

Values are read where they lie: a pass counts map-side and moves counts only, never a value, until at
most ``few`` rows are left in an interval.

Counts at the same midpoints from separate days or loads add up: ``cell_counts`` is the summary to keep,
``merge_counts`` combines summaries, and ``from_counts`` reads percentiles from them within a factor of
``2**-bits``.  Its midpoints live in an order-preserving integer key of the double (exponent, mantissa).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrain.session import settle

MANTISSA = 1 << 52
BROADCAST_ROWS = 50_000  #: intervals are broadcast up to this many rows, else joined by shuffle


def order_key(v: Column) -> Column:
    """An integer that orders as the double does: biased exponent and 52 mantissa bits, negated for
    negatives.  Null for null and NaN.  Magnitudes under 2**-1022 count as zero, infinities as the
    largest exponent."""
    a = F.abs(v.cast("double"))
    e0 = F.floor(F.log2(a))
    e1 = F.when(F.pow(F.lit(2.0), e0) > a, e0 - 1).when(F.pow(F.lit(2.0), e0 + 1) <= a, e0 + 1).otherwise(e0)
    mant = F.floor((a / F.pow(F.lit(2.0), e1) - 1) * F.lit(float(MANTISSA))).cast("long")
    key = (e1.cast("long") + 1023) * F.lit(MANTISSA) + mant
    big = F.lit(2047 * MANTISSA)
    mag = F.when(a == float("inf"), big).when(a < 2.0**-1022, F.lit(0)).otherwise(key)
    return F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None)).otherwise(F.when(v < 0, -mag).otherwise(mag)).cast("long")


def key_value(key: Column) -> Column:
    """The double whose ``order_key`` is *key*."""
    a = F.abs(key)
    e = F.floor(a / F.lit(float(MANTISSA)))
    e = F.when(e * MANTISSA > a, e - 1).otherwise(e).cast("long")
    v = (F.lit(1.0) + (a - e * MANTISSA).cast("double") / MANTISSA) * F.pow(F.lit(2.0), (e - 1023).cast("double"))
    mag = F.when(a == 0, F.lit(0.0)).when(e >= 2047, F.lit(float("inf"))).otherwise(v)
    return F.when(key < 0, -mag).otherwise(mag)


BY = ["dim", "grp", "metric"]


def _first_cell(v: Column) -> Column:
    """The cell of the first pass; it never falls as the value grows."""
    size = F.floor(F.log2(F.abs(v)) * 256) + 300_000
    return F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.lit(10**6)).otherwise(size).cast("long") * F.signum(v).cast("long")


def _same(side: str = "_") -> Column:
    return (F.col("dim") == F.col(f"{side}dim")) & F.col("grp").eqNullSafe(F.col(f"{side}grp")) & (F.col("metric") == F.col(f"{side}metric"))


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in BY})


def _long(keyed: DataFrame, only: list[tuple[int, str, int, str]], more: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """``(dim, grp, metric, v, *more)``: one row a value, for each (place, dimension, place, column)."""
    rows = [F.struct(F.lit(d).alias("dim"), F.col(f"_d{i}").alias("grp"), F.lit(c).alias("metric"), F.col(f"_v{j}").alias("v"), *[F.col(f"{k}{j}").alias(n) for k, n in more.items()]) for i, d, j, c in only]
    return keyed.select(F.inline(F.array(*rows))).where("v is not null")


def exact_percentiles(df: DataFrame, dims: dict[str, Column], columns: list[str], ps: list[float], bits: int = 12, few: int = 256) -> DataFrame:
    """``(dim, grp, metric, p, n, value)``: the exact percentile with linear interpolation between
    neighbouring ranks, for each value of each dimension.  The error is that of one double sum.

    Nulls and NaN are left out and not counted; a group without any value gives no row; a null
    group value is a group of its own.  An empty table gives no rows.  No group is ever gathered:
    a pass moves at most the counts of its cells for each map task, and the values of an interval are
    read only once at most ``few`` rows lie in it.
    """
    all_of = [(i, d, j, c) for i, d in enumerate(dims) for j, c in enumerate(columns)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    keyed = settle(df.select(*[c.cast("string").alias(f"_d{i}") for i, c in enumerate(dims.values())], *[value(c).alias(f"_v{i}") for i, c in enumerate(columns)]))
    celled = keyed.withColumns({f"_c{i}": _first_cell(F.col(f"_v{i}")) for i in range(len(columns))})
    cells = _long(celled, all_of, {"_c": "cell"}).groupBy(*BY, "cell").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = settle(cells)
    upto = Window.partitionBy(*BY).orderBy("cell")
    cells = cells.withColumn("below", F.sum("inside").over(upto) - F.col("inside"))
    sums = cells.groupBy(*BY).agg(F.sum("inside").alias("n"))
    share = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    want = sums.select(*BY, "n", share).withColumn("at", F.round(F.col("p") * (F.col("n") - 1), 9)).withColumn("r", F.floor("at"))
    want = settle(want.withColumn("r1", F.least(F.col("r") + 1, F.col("n") - 1)))
    ranks = settle(want.select(*BY, F.explode(F.array_distinct(F.array("r", "r1"))).alias("rank")).distinct())
    small = ranks.count() <= BROADCAST_ROWS
    near_by = F.broadcast if small else (lambda t: t)

    def hold(cells: DataFrame, ranks: DataFrame) -> DataFrame:
        """The cell that holds each rank, as the next interval."""
        on = _same() & (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))
        return settle(cells.join(near_by(_marked(ranks)), on).select(*BY, "lo", "hi", "rank", "inside", "below"))

    def near(spans: DataFrame) -> DataFrame:
        """The values that lie in the intervals *spans*; only columns that are still open are read."""
        open_ = {(r["dim"], r["metric"]) for r in spans.select("dim", "metric").distinct().collect()}
        rows = _long(keyed, [x for x in all_of if (x[1], x[3]) in open_])
        return rows.join(near_by(_marked(spans)), _same() & F.col("v").between(F.col("lo"), F.col("hi")))

    todo = hold(cells, ranks)
    done = None
    size = 1 << bits
    while True:
        ready = todo.where("lo = hi").select(*BY, "rank", F.col("lo").alias("v"))
        done = ready if done is None else done.union(ready)
        todo = todo.where("lo < hi")
        most = todo.agg(F.max("inside").alias("n")).first()["n"]
        if most is None:
            break
        spans = todo.select(*BY, "lo", "hi").distinct()  # ranks of a group often share an interval
        if most <= few:
            won = near(spans).groupBy(*BY, "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("vs"))
            won = won.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
            same = _same() & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
            done = done.union(won.join(near_by(_marked(todo)), same).select(*BY, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v")))
            break
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * size).cast("long")
        cells = near(spans).groupBy(*BY, F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), part.alias("cell")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        base = todo.select(*BY, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("below").alias("base")).distinct()
        cells = cells.join(near_by(_marked(base)), _same() & (F.col("lo0") == F.col("_lo")) & (F.col("hi0") == F.col("_hi"))).select(*BY, "lo0", "hi0", "cell", "inside", "lo", "hi", "base")
        upto = Window.partitionBy(*BY, "lo0", "hi0").orderBy("cell")
        cells = cells.withColumn("below", F.col("base") + F.sum("inside").over(upto) - F.col("inside"))
        todo = hold(cells, todo.select(*BY, "rank"))
    found = settle(done)
    out = want
    for r, v in (("r", "v0"), ("r1", "v1")):
        side = _marked(found.withColumnsRenamed({"rank": f"_{r}", "v": v}))
        out = out.join(side, _same() & (F.col(r) == F.col(f"_{r}"))).select(*out.columns, v)
    frac = F.col("at") - F.col("r")
    value = F.when((F.col("v0") == F.col("v1")) | (frac == 0), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * frac)
    return out.select(*BY, "p", "n", value.alias("value"))


def cell_counts(df: DataFrame, dims: dict[str, Column], columns: list[str], bits: int = 8) -> DataFrame:
    """The summary of a day or load: ``(*dims, metric, cell, n)`` with one cell for each ``2**-bits``
    part of a power of two.  Its size depends on the spread of values, not on their number
    (at most ``2**bits`` cells for each power of two that occurs)."""
    keys = df.select(*[c.alias(d) for d, c in dims.items()], *[order_key(F.col(c)).alias(f"_k{i}") for i, c in enumerate(columns)])
    rows = keys.select(*dims, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"_k{i}").alias("key")) for i, c in enumerate(columns)])))
    cell = F.signum("key").cast("long") * F.shiftright(F.abs("key"), 52 - bits)
    return rows.where("key is not null").groupBy(*dims, "metric", cell.alias("cell")).agg(F.count("*").alias("n"))


def merge_counts(counts: DataFrame, dims: list[str]) -> DataFrame:
    """Summaries of several days or loads -> one for each value of *dims*; counts just add."""
    return counts.groupBy(*dims, "metric", "cell").agg(F.sum("n").alias("n"))


def from_counts(counts: DataFrame, dims: list[str], ps: list[float], bits: int = 8) -> DataFrame:
    """``(*dims, metric, p, n, lo, hi)``: bounds of the value at rank ``floor(p*(n-1))``, with
    ``hi - lo <= 2**-bits * max(|lo|, |hi|)``; a merged summary gives what one over all rows would."""
    w = Window.partitionBy(*dims, "metric")
    cum = counts.withColumn("cum", F.sum("n").over(w.orderBy("cell"))).withColumn("total", F.sum("n").over(w))
    want = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("rank", F.floor(F.round(F.col("p") * (F.col("total") - 1), 9)))
    hit = want.where("cum - n <= rank and rank < cum")
    near_end = F.abs("cell") * F.lit(1 << (52 - bits))
    far_end = (F.abs("cell") + 1) * F.lit(1 << (52 - bits))
    lo = F.when(F.col("cell") < 0, key_value(-far_end)).otherwise(key_value(near_end))
    hi = F.when(F.col("cell") < 0, key_value(-near_end)).otherwise(key_value(far_end))
    return hit.select(*dims, "metric", "p", F.col("total").alias("n"), lo.alias("lo"), hi.alias("hi"))
