"""Problem 6: filling fixed-capacity containers with items.

Method: the configuration program over the histogram of lengths (how many containers to fill in each
way), solved by multiplicative weights with a knapsack dynamic program as pricing.  A length's weight falls as
its items are covered, a round takes the filling of most weight, and it takes each a whole number of times and
no more items than are left, so rounding is part of every round and nothing is left over: the rounds go on
until all items are covered.  The number of containers against the least by volume (the dual bound with
weights in proportion to length) is the gap.

The histogram has at most ``capacity`` entries however many items there are, so the program is solved by
the driver; items then find their place by their rank among items of the same length, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrain.llm.tokens import prefix_sum
from inkgrain.session import settle

Runs = list[tuple[int, dict[int, int]]]  #: (number of containers, length -> items in each)


RATE = 0.1  #: part of a length's items that one filling may use up
ETA = 1.0  #: a length's weight falls by ``exp(-ETA)`` until it is covered
LEAD, SPREAD = 48, 80  #: lengths priced in a round: the least covered, and some of all others


def price(items: list[int], values: list[float], capacity: int) -> list[int]:
    """The most valuable set of *items* (their places) that fits, each taken once at most: 0/1 knapsack."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), dtype=bool)
    for i, (n, v) in enumerate(zip(items, values)):
        if n > capacity:
            continue
        with_it = best[: capacity + 1 - n] + v
        took[i, n:] = with_it > best[n:]
        best[n:] = np.maximum(with_it, best[n:])
    out, room = [], capacity
    for i in range(len(items) - 1, -1, -1):
        if took[i, room]:
            out.append(i)
            room -= items[i]
    return out


def plan(histogram: dict[int, int], capacity: int) -> Runs:
    """Whole numbers of containers and their fillings for ``histogram`` (length -> items, lengths in
    ``1..capacity``).  No container is over-full and every item has one place.

    A round prices the ``LEAD`` least covered lengths and ``SPREAD`` of the others, evenly over their range, as
    so many are enough to fill a container to the brim.  Rounds grow with the capacity, not with the items.
    """
    lengths = np.array(sorted(n for n, k in histogram.items() if k > 0), dtype=np.int64)
    if not len(lengths):
        return []
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("lengths must lie in 1..capacity")
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    left = counts.copy()
    runs: Runs = []
    while left.any():
        live = np.flatnonzero(left)
        covered = 1 - left[live] / counts[live]
        order = live[np.lexsort((-lengths[live], covered))]
        others = np.sort(order[LEAD:])
        if len(others) > SPREAD:
            others = others[np.linspace(0, len(others) - 1, SPREAD).astype(int)]
        sizes: list[int] = []
        values: list[float] = []
        what: list[tuple[int, int]] = []
        for i in np.sort(np.concatenate((order[:LEAD], others))):
            weight = lengths[i] / capacity * np.exp(-ETA * (1 - left[i] / counts[i]))
            n, times = min(int(left[i]), capacity // int(lengths[i])), 1
            while n > 0:  # bundles of 1, 2, 4, ... give every number of items
                k = min(times, n)
                sizes.append(int(lengths[i]) * k)
                values.append(float(weight) * k)
                what.append((int(i), k))
                n, times = n - k, times * 2
        fill: dict[int, int] = {}
        for at in price(sizes, values, capacity):
            i, k = what[at]
            fill[i] = fill.get(i, 0) + k
        times = max(1, min(min(int(left[i]), int(RATE * counts[i])) // k for i, k in fill.items()))
        for i, k in fill.items():
            left[i] -= k * times
        runs.append((times, {int(lengths[i]): k for i, k in fill.items()}))
    return runs


def pieces(sized: DataFrame, key: str, capacity: int) -> DataFrame:
    """``(key, piece, start, size)``: an item over ``capacity`` becomes full pieces and a rest, any
    other one piece (a size of 0 too)."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)
    cut = sized.select(key, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return cut.select(key, "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("size"))


def pack(sized: DataFrame, key: str, capacity: int) -> DataFrame:
    """``sized(key, n_tokens)`` -> ``(key, piece, start, size, container)``, containers numbered from 0.

    Every item gets a place, whole unless it alone exceeds ``capacity``; no container holds more.
    Items of size 0 take no room and are dealt round; a null size counts as 0.  Repeated keys are
    items of their own.  An empty table gives an empty result.  Nothing but the histogram of
    lengths (at most ``capacity`` rows) and the plan reaches the driver.
    """
    sized = sized.select(key, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    parts = settle(pieces(sized, key, capacity))
    hist = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}
    runs = plan({n: k for n, k in hist.items() if n > 0}, capacity)
    total = max(1, sum(t for t, _ in runs))
    spots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    filled = dict.fromkeys(hist, 0)
    for times, fill in runs:
        for n, k in fill.items():
            spots.setdefault(n, []).append((filled[n], base, k))
            filled[n] += times * k
        base += times
    table = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for n, v in spots.items()}
    shared = sized.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = shared.value
        for b in batches:
            to = np.empty(len(b), dtype=np.int64)
            sizes, ranks = b["size"].to_numpy(), b["rank"].to_numpy()
            for n in np.unique(sizes):
                own = sizes == n
                if n == 0:
                    to[own] = ranks[own] % total
                    continue
                first, at, k = where[int(n)]
                i = np.searchsorted(first, ranks[own], side="right") - 1
                to[own] = at[i] + (ranks[own] - first[i]) // k[i]
            yield b.drop(columns=["rank"]).assign(container=to)

    ranked = prefix_sum(parts, ["size"], [key, "piece"], F.lit(1), "rank")
    kind = parts.schema[key].dataType.simpleString()
    return ranked.select(key, "piece", "start", "size", "rank").mapInPandas(place, f"`{key}` {kind}, piece bigint, start bigint, size bigint, container bigint")
