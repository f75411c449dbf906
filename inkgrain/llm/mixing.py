"""Problem 7: mixing sources to target weights.

Method: Pfair scheduling.  The mix is cut into blocks of a given number of tokens.  Block j of a source with
weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot the
released block that is due first is taken.  At every point of a schedule each source is then within
one block of its share.

A long mix is cut into stretches of ``STRETCH`` slots.  A stretch holds the blocks that fall due in it and is
scheduled on its own, with their shares as weights, in parallel; so a source is within one block of its
share at the end of every stretch, and within two inside.  The block does not grow with the data, and no
schedule is made by the driver.  Records are dealt to blocks by prefix sums of their sizes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrain.llm.tokens import prefix_sum


def quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens to take of each source with records.

    Without ``total``: the largest mix in which every source that has tokens reaches its share
    with at most ``max_repeats`` uses of a record, so the shares come out as targeted (those of
    sources without records are spread in proportion).  With ``total``: shares of that many
    tokens; a source that cannot supply its share gives all it may, and the others share the rest
    in proportion to their weights as far as they can.
    """
    most = {s: sizes[s] * r for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and r > 0}
    weight = {s: targets[s][0] for s in most}
    if not most:
        return {}
    whole = sum(weight.values())
    if total is None:
        total = min(most[s] * whole / weight[s] for s in most)
        return {s: total * weight[s] / whole for s in most}
    out: dict[str, float] = {}
    room = float(total)
    open_ = dict(weight)
    while open_:
        scale = room / sum(open_.values())
        short = [s for s in open_ if most[s] < open_[s] * scale]
        if not short:
            return out | {s: w * scale for s, w in open_.items()}
        for s in short:
            out[s] = float(most[s])
            room -= most[s]
            del open_[s]
    return out


def pfair(weights: dict[str, Fraction], slots: int) -> list[tuple[int, str, int]]:
    """``(slot, source, block)`` by earliest deadline among released blocks; ``weights`` sum to 1.
    A slot without a released block stays empty."""

    def window(s: str, j: int) -> tuple[int, int]:
        return math.floor(j / weights[s]), math.ceil((j + 1) / weights[s])

    waiting = [(*window(s, 0), s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        if not ready:
            continue
        due, s, j = heapq.heappop(ready)
        out.append((slot, s, j))
        heapq.heappush(waiting, (*window(s, j + 1), s, j + 1))
    return out


BLOCK = 8_192  #: tokens of a block
STRETCH = 5_000  #: slots that are scheduled at once
BROADCAST_SLOTS = 50_000  #: slots are broadcast up to so many, else joined by shuffle


def due(weights: dict[str, Fraction], blocks: dict[str, int], stretch: int, last: int) -> dict[str, int]:
    """Blocks of each source that fall due by the end of a stretch (the *last* takes what is left)."""
    if stretch >= last:
        return blocks
    return {s: min(blocks[s], math.floor(stretch * STRETCH * w)) for s, w in weights.items()}


def schedule(weights: dict[str, Fraction], blocks: dict[str, int], stretch: int, last: int) -> list[tuple[int, str, int]]:
    """``(slot, source, block)`` of a stretch, counted from 1; slots of later stretches are higher."""
    first, upto = due(weights, blocks, stretch - 1, last), due(weights, blocks, stretch, last)
    own = {s: upto[s] - first[s] for s in weights if upto[s] > first[s]}
    n = sum(own.values())
    base = (stretch - 1) * (STRETCH + len(weights) + 1)
    return [(base + slot, s, first[s] + j) for slot, s, j in pfair({s: Fraction(k, n) for s, k in own.items()}, n)] if n else []


def mix(sized: DataFrame, targets: DataFrame, key: str, total: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(mix, source, key, copy, n_tokens, slot, at)``: the records of every mix, in the order
    ``slot, at, key, copy``.

    ``sized(key, source, n_tokens)``; ``targets(mix, source, target_share, max_repeats)``, a small
    table of weights.  A record is used ``copy + 1`` times at most ``max_repeats`` times; the record
    that crosses a source's quota is taken if at least half of it lies within.  Records without
    tokens or source are never needed and left out; a target without a positive share or repeats
    gives nothing.  Repeated keys are records of their own.  Empty tables give an empty mix.
    The driver holds one row for each source of ``targets``.
    """
    spark = sized.sparkSession
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.groupBy("mix", "source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).collect():
        if r["source"] is not None and (r["w"] or 0) > 0 and (r["r"] or 0) > 0:
            wanted.setdefault(r["mix"], {})[r["source"]] = (r["w"], r["r"])
    used = sorted({s for t in wanted.values() for s in t})
    records = sized.where(F.col("source").isin(used) & (F.col("n_tokens") > 0)).select(key, "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    sizes = {r["source"]: r["s"] for r in records.groupBy("source").agg(F.sum("n_tokens").alias("s")).collect()}
    plan: list[tuple] = []
    stretches: list[DataFrame] = []
    of: dict[str, tuple[dict[str, Fraction], dict[str, int], int]] = {}
    n_slots = 0
    for m, t in sorted(wanted.items()):
        quota = {s: q for s, q in quotas(sizes, t, total).items() if q > 0}
        if not quota:
            continue
        whole = sum(Fraction(q) for q in quota.values())
        blocks = {s: math.floor(q / block) + 1 for s, q in quota.items()}
        last = max(1, math.ceil(sum(quota.values()) / block / STRETCH))
        of[m] = {s: Fraction(q) / whole for s, q in quota.items()}, blocks, last
        plan += [(m, s, float(q), t[s][1], sizes[s]) for s, q in quota.items()]
        stretches.append(spark.range(1, last + 1, 1, min(last, 10_000)).select(F.lit(m).alias("mix"), F.col("id").alias("stretch")))
        n_slots += sum(blocks.values())
    empty = spark.createDataFrame([], "mix string, stretch long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, k in zip(b["mix"], b["stretch"]):
                rows = schedule(*of[m][:2], int(k), of[m][2])
                yield pd.DataFrame([(m, s, j, slot) for slot, s, j in rows], columns=["_mix", "_source", "_j", "slot"])

    slots = reduce(DataFrame.union, stretches, empty).mapInPandas(run, "_mix string, _source string, _j long, slot long")
    spread = prefix_sum(records, ["source"], [key], F.col("n_tokens"), "before", 256)
    quota_of = F.broadcast(spark.createDataFrame(plan, "mix string, _source string, quota double, repeats int, size long"))
    each = spread.join(quota_of, F.col("source") == F.col("_source"))
    passes = F.least(F.col("repeats").cast("long"), F.ceil(F.col("quota") / F.col("size")))
    each = each.select("mix", "source", key, "n_tokens", "before", "quota", "size", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("copy"))
    each = each.withColumn("at", F.col("copy") * F.col("size") + F.col("before")).where(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota"))
    each = each.withColumn("j", F.floor(F.col("at") / block).cast("long"))
    on = (F.col("mix") == F.col("_mix")) & (F.col("source") == F.col("_source")) & (F.col("j") == F.col("_j"))
    return each.join(F.broadcast(slots) if n_slots <= BROADCAST_SLOTS else slots, on, "left").select("mix", "source", key, "copy", "n_tokens", "slot", "at")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix, source, target_share, n_records, n_uses, n_tokens, share)`` for every target; shares
    of sources without records are 0."""
    got = mixed.groupBy("mix", "source").agg(F.sum((F.col("copy") == 0).cast("long")).alias("n_records"), F.count("*").alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    whole = got.groupBy("mix").agg(F.sum("n_tokens").alias("_all")).withColumnRenamed("mix", "_m")
    got = got.join(whole, F.col("mix") == F.col("_m")).withColumnsRenamed({"mix": "_mix", "source": "_source"}).drop("_m")
    out = targets.join(got, (F.col("mix") == F.col("_mix")) & (F.col("source") == F.col("_source")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("mix", "source", "target_share", zero("n_records"), zero("n_uses"), zero("n_tokens"), F.round(F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)), 6).alias("share"))
