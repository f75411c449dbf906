"""Two-pass label review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrain.operators.sampling import running

BLIND, CHECK = 0.12, 0.10
EDITED, UNREADABLE = ("edit", "blind_typed"), "unreadable"


def one_row_a_key(sheet: DataFrame, key: str = "idx") -> DataFrame:
    """Each key once; of unlike rows the one with the greatest content."""
    cols = [c for c in sheet.columns if c != key]
    return sheet.groupBy(key).agg(F.max(F.struct(*cols)).alias("x")).select(key, "x.*")


def latest_events(events: DataFrame, key: str = "idx", ts: str = "ts") -> DataFrame:
    """The last event of each key (D12); ties by pass, action and value.  An event received twice
    counts once."""
    cols = [c for c in events.columns if c not in (key, "warnings")]
    order = F.struct(F.col(ts), *[F.col(c) for c in cols if c != ts])
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def report(sheet: DataFrame, by: list[str]) -> DataFrame:
    """Reviewed rows, edits and blind disagreement with their percentages, unreadable, pass-2
    disagreement and unresolved (A24).

    Blind disagreement is given without unreadable rows (``blind_disagree_pct``) and with them
    (``blind_disagree_all_pct``).
    """
    done = F.col("action1") != ""
    blind = F.col("blind") == "1"
    unread = F.col("action1") == UNREADABLE
    differs = F.col("gold_pass1") != F.col("public_label")
    two = F.col("action2") != ""
    split = two & (F.col("gold_pass1") != F.col("gold_pass2"))
    n = lambda c: F.count_if(c)
    pct = lambda a, b: F.round(F.try_divide(n(a) * 100.0, n(b)), 6)
    return sheet.groupBy(*by).agg(
        F.count("*").alias("n"), n(done).alias("reviewed"), n(unread).alias("unreadable"), pct(done & ~blind & (F.col("action1") == "edit"), done & ~blind & ~unread).alias("assisted_edit_pct"),
        pct(done & blind & ~unread & differs, done & blind & ~unread).alias("blind_disagree_pct"), pct(done & blind & differs, done & blind).alias("blind_disagree_all_pct"),
        n(two).alias("second_pass"), pct(split, two).alias("pass2_disagree_pct"), n(split & (F.col("resolved") != "1")).alias("unresolved"),
    )


def second_pass_queue(sheet: DataFrame, seed: str, key: str = "idx", share: float = CHECK) -> DataFrame:
    """``(key, rank)``: every edited row, every blind row judged, and a share of the accepted ones
    (at least one), in random order (G3, U4, W8)."""
    judged = sheet.where(F.col("action1") != "")
    sure = judged.where((F.col("action1") == "edit") | (F.col("blind") == "1"))
    accepted = judged.where((F.col("action1") == "accept") & (F.col("blind") != "1"))
    size = F.broadcast(accepted.agg(F.greatest(F.lit(1), F.bround(F.count("*") * share)).alias("_k")))
    ranked = running(accepted.select(key), key, seed, "_r").crossJoin(size).where("_r < _k")
    rows = sure.select(key).union(ranked.select(key)).distinct()
    return running(rows, key, f"{seed}/order", "rank").withColumn("rank", F.col("rank") + 1)


def pending(sheet: DataFrame, queue: DataFrame, key: str = "idx") -> DataFrame:
    """Queued rows without a second pass, or whose passes differ unresolved."""
    open_ = (F.col("action2") == "") | ((F.col("gold_pass1") != F.col("gold_pass2")) & (F.col("resolved") != "1"))
    return sheet.where(open_).join(queue, key)


def pace(events: DataFrame, by: list[str], ts: str = "ts", last: int = 25) -> DataFrame:
    """Seconds since the event before and their mean over the last 25."""
    w = Window.partitionBy(*by).orderBy(ts, "idx", "action")
    gap = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w)
    return events.withColumn("gap_s", F.round(gap, 6)).withColumn("mean_gap_s", F.round(F.avg("gap_s").over(w.rowsBetween(1 - last, 0)), 3))


def cooled(events: DataFrame, hours: int = 24) -> DataFrame:
    """Second-pass events with whether they came at least so long after the first pass."""
    first = events.where("pass_ = 1").groupBy("idx").agg(F.max("ts").alias("first_ts"))
    second = events.where("pass_ = 2").groupBy("idx").agg(F.min("ts").alias("second_ts"))
    age = (F.col("second_ts").cast("double") - F.col("first_ts").cast("double")) / 3600
    return first.join(second, "idx").withColumn("age_h", F.round(age, 6)).withColumn("cooled", age >= hours)


def merge_artifact(old: DataFrame, new: DataFrame, key: str, numbers: list[str], drop: list[str] | None = None, derived: dict | None = None, first: list[str] | None = None) -> DataFrame:
    """``upsert`` in full (K6): keys of *drop* go, rows of *derived* (key -> rows made from all others) are always
    made anew, and rows come in a fixed order: *first*, then derived ones, then the rest by key."""
    derived = derived or {}
    gone = [*(drop or []), *derived]
    rows = upsert(old.where(~F.col(key).isin(gone)) if gone else old, new.where(~F.col(key).isin(gone)) if gone else new, key, numbers)
    out = rows
    for make in derived.values():
        out = out.unionByName(make(rows))
    rank = F.lit(len(first or []) + len(derived))
    for i, k in reversed(list(enumerate([*(first or []), *derived]))):
        rank = F.when(F.col(key) == k, i).otherwise(rank)
    return out.orderBy(rank, key)


def upsert(old: DataFrame, new: DataFrame, key: str, numbers: list[str]) -> DataFrame:
    """New rows replace old ones of the same key, other old rows stay; a new row whose numbers are
    null or NaN raises (K6)."""
    bad: Column = F.lit(False)
    for c in numbers:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    checked = new.withColumn(key, F.when(bad, F.raise_error(F.lit("a metric is not a number"))).otherwise(F.col(key)))
    return old.join(new.select(key), key, "left_anti").unionByName(checked)
