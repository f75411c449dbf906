"""Problem 1: splits that keep related records together.

Method: grouped iterative stratification.  Records that share an entity are joined into
components, each component carries a vector of label counts, and components are placed with the
rarest outstanding label first into the split that needs it most.

The greedy placement is sequential, so it runs where its input has a bound: components that hold
at least 1/1000 of all rows (at most 1000 of them) are placed by the driver, the rest in hash
blocks of about ``block_size`` components.  Each block gets the part of the outstanding need that
its own labels make up, so the errors of blocks do not add up to more than one component a label.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrain.llm.components import components
from inkgrain.session import settle

ALL = ""  #: the label every row carries, so that total sizes are balanced too
HEAVY = 1000
LABELS = 100_000  #: labels at most; the driver and every block hold the need of each


def photo_number(path: Column) -> Column:
    """Digits right after ``im`` at the start of the file name, without leading zeros; null where
    there are none.  Slashes of either kind, case, queries and what follows do not matter."""
    name = F.regexp_extract(F.regexp_replace(path, r"(?s)\?.*$", ""), r"([^/\\]*)$", 1)
    return F.nullif(F.regexp_extract(name, r"(?i)^\s*im0*([0-9]+)", 1), F.lit(""))


def stratify(sizes: dict[str, dict[str, int]], need: dict[str, dict[str, float]]) -> dict[str, str]:
    """Place components (name -> label -> rows) so that each split gets its ``need`` (split ->
    label -> rows).  ``need`` is used up.  Ties fall by the need of all rows, then by name."""
    holders: dict[str, set[str]] = defaultdict(set)
    left: dict[str, int] = defaultdict(int)
    for c, v in sizes.items():
        for label, n in v.items():
            holders[label].add(c)
            left[label] += n
    placed: dict[str, str] = {}
    while True:
        open_labels = [(left[k], k) for k, own in holders.items() if own and k != ALL]
        if not open_labels and not holders[ALL]:
            return placed
        label = min(open_labels)[1] if open_labels else ALL
        for c in sorted(holders[label], key=lambda c: (-sizes[c][label], -sizes[c].get(ALL, 0), c)):
            to = max(need, key=lambda s: (need[s].get(label, 0.0), need[s].get(ALL, 0.0), s))
            placed[c] = to
            for k, n in sizes[c].items():
                need[to][k] = need[to].get(k, 0.0) - n
                left[k] -= n
                if k != label:
                    holders[k].discard(c)
        holders[label] = set()


def grouped_split(
    records: DataFrame, entity: str, link: Column, label: Column, shares: dict[str, float], block_size: int = 20_000
) -> DataFrame:
    """``(entity, component, split, n_rows)`` for every entity of *records*.

    Entities with an equal non-null ``link`` belong together, and chains of them.  ``label`` is the
    attribute whose distribution each split should keep.  ``shares`` need not sum to 1.
    Rows with a null label count towards the size of a split only; a null entity forms one component of all its rows
    (it names no group that could be told apart), returned with a null entity.
    More than ``LABELS`` different labels are an error: such a label names records rather than kinds of them.
    Repeated rows count as rows.  An empty table gives an empty result.  Extra columns of any
    name are ignored.
    """
    total_share = sum(shares.values())
    if not shares or total_share <= 0:
        raise ValueError("shares must hold a positive number")
    base = records.select(F.col(entity).cast("string").alias("e"), link.cast("string").alias("k"), label.cast("string").alias("label"))
    pairs = settle(base.groupBy("e", "k", "label").agg(F.count("*").alias("n")))
    named = pairs.where("k is not null and e is not null").select("e", "k").distinct()
    firsts = named.groupBy("k").agg(F.min("e").alias("m"), F.count("*").alias("c")).where("c > 1").select("k", "m")
    roots = components(named.join(firsts, "k").select(F.col("e").alias("a"), F.col("m").alias("b")))
    sized = pairs.groupBy("e", "label").agg(F.sum("n").alias("n"))
    vectors = settle(sized.join(roots, sized.e == roots.node, "left").select("e", "label", "n", F.coalesce("root", "e").alias("c")))
    of = vectors.groupBy("c", "label").agg(F.sum("n").alias("n"))
    if vectors.select("label").distinct().count() > LABELS:
        raise ValueError(f"more than {LABELS} labels: stratify by a coarser attribute")
    whole = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rows = sum(whole.values())
    whole.pop(None, None)
    whole[ALL] = rows
    tall = of.groupBy("c").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))).alias("v"))
    tall = settle(tall)
    heavy = {r["c"] or "": {**r["v"], ALL: r["size"]} for r in tall.where(F.col("size") * HEAVY >= rows).collect()}
    need = {s: {k: n * w / total_share for k, n in whole.items()} for s, w in shares.items()}
    placed_heavy = stratify(heavy, need)
    light = tall.where(F.col("size") * HEAVY < rows)
    n_light = max(0, tall.count() - len(heavy))
    blocks = max(1, math.ceil(n_light / block_size))
    light = light.withColumn("block", F.pmod(F.xxhash64("c"), F.lit(blocks)))
    rest = dict(whole)
    for v in heavy.values():
        for k, n in v.items():
            rest[k] -= n

    def place(part: pd.DataFrame) -> pd.DataFrame:
        sizes = {(c or ""): {**dict(v), ALL: int(n)} for c, v, n in zip(part["c"], part["v"], part["size"])}
        own: dict[str, int] = defaultdict(int)
        for v in sizes.values():
            for k, n in v.items():
                own[k] += n
        want = {s: {k: need[s].get(k, 0.0) * n / rest[k] for k, n in own.items()} for s in need}
        got = stratify(sizes, want)
        return pd.DataFrame({"c": part["c"], "split": [got[c or ""] for c in part["c"]]})

    placed = light.select("c", "v", "size", "block").groupBy("block").applyInPandas(place, "c string, split string")
    spark = records.sparkSession
    given = spark.createDataFrame([(c, s) for c, s in placed_heavy.items()], "c string, split string")
    placed = placed.union(given)
    kind = records.schema[entity].dataType
    members = vectors.groupBy("e", "c").agg(F.sum("n").alias("n_rows"))
    return members.join(placed, F.coalesce(members.c, F.lit("")) == F.coalesce(placed.c, F.lit(""))).select(
        F.col("e").cast(kind).alias(entity), members.c.cast(kind).alias("component"), "split", "n_rows"
    )


def linked_pairs(assigned: DataFrame, entity: str) -> DataFrame:
    """All pairs of entities that one component binds to the same split, the smaller first."""
    a, b = assigned.where("component is not null").alias("a"), assigned.alias("b")
    on = (F.col("a.component") == F.col("b.component")) & (F.col("a.split") == F.col("b.split")) & (F.col(f"a.{entity}") < F.col(f"b.{entity}"))
    return a.join(b, on).select(F.col(f"a.{entity}").alias(f"{entity}_lo"), F.col(f"b.{entity}").alias(f"{entity}_hi"))
