"""Problem 2: a sample that reruns, repartitionings and later deliveries leave unchanged.

Method: randomised block selection.  Regions have persistent sequence numbers (the ``pos`` of
their first delivery).  Numbers are cut into fixed blocks, and a hash of the block number alone
fixes which positions of the block are chosen, whether filled yet or not.  A region's fate hence
depends on nothing but its own number, and a later delivery can only fill positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_positions(block: Column, block_size: int, take: int, seed: str) -> Column:
    """``take`` distinct positions in ``[0, block_size)`` drawn from SHA-256 of seed and block
    number by Floyd's scheme (draw below a growing bound; a repeated draw takes the bound)."""
    digests = F.concat(*[F.sha2(F.concat(F.lit(f"{seed}:"), block.cast("string"), F.lit(f":{i}")), 256) for i in range(-(-take // 8))])
    draws = [F.conv(F.substring(digests, 8 * j + 1, 8), 16, 10).cast("long") for j in range(take)]
    got: Column = F.array().cast("array<long>")
    steps = F.array(*[F.struct(d.alias("d"), F.lit(block_size - take + j).cast("long").alias("top")) for j, d in enumerate(draws)])

    def step(acc: Column, x: Column) -> Column:
        t = F.pmod(x["d"], x["top"] + 1)
        return F.array_append(acc, F.when(F.array_contains(acc, t), x["top"]).otherwise(t))

    return F.aggregate(steps, got, step)


def first_seen(records: DataFrame, keys: list[str], order: list[str], sequence: str) -> DataFrame:
    """One row a region: ``keys`` and ``seq``, the sequence number of its first delivery.

    A region with a null in ``keys`` cannot be told from others, so each such
    record stands alone under its own number.  Records without a sequence number are left out
    (nothing fixes their fate); a null in ``order`` counts as later than any value.
    """
    alone = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1, F.col(sequence))
    rank = F.struct(*[x for o in order for x in (F.col(o).isNull(), F.col(o))], F.col(sequence))
    few = records.where(F.col(sequence).isNotNull()).select(*keys, alone.alias("_alone"), rank.alias("_rank"), F.col(sequence).alias("_seq"))
    return few.groupBy(*keys, "_alone").agg(F.min_by("_seq", "_rank").alias("seq")).drop("_alone")


def growth(records: DataFrame, keys: list[str], step: str, steps: list[int], sequence: str = "pos", block_size: int = 80, take: int = 8, seed: str = "s1") -> DataFrame:
    """``(upto, chosen, lost)`` for each of *steps*: regions chosen from the records with ``step <= upto``
    alone, and regions that a smaller step chose but this one does not.

    All samples are drawn from one shuffle of the records.  Records without a step or sequence number take no
    part; an empty table gives zeros.
    """
    alone = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1, F.col(sequence))
    few = records.where(F.col(sequence).isNotNull() & F.col(step).isNotNull()).select(*keys, alone.alias("_alone"), F.col(step).alias("_step"), F.col(sequence).cast("long").alias("_seq"))
    first = few.groupBy(*keys, "_alone", "_step").agg(F.min("_seq").alias("_seq"))
    seen = first.groupBy(*keys, "_alone").agg(F.sort_array(F.collect_list(F.struct("_step", "_seq"))).alias("_all"))

    def drawn(upto: int) -> Column:
        seq = F.get(F.filter("_all", lambda x: x["_step"] <= upto), F.lit(0))["_seq"]
        block = F.floor(seq / block_size).cast("long")
        return F.coalesce(F.array_contains(chosen_positions(block, block_size, take, seed), seq - block * block_size), F.lit(False))

    marks = seen.select(F.array(*[drawn(u) for u in steps]).alias("got"))
    lost = lambda i: F.exists(F.slice("got", 1, i), lambda x: x) & ~F.get("got", F.lit(i)) if i else F.lit(False)
    each = marks.select(*[F.get("got", F.lit(i)).alias(f"c{i}") for i in range(len(steps))], *[lost(i).alias(f"l{i}") for i in range(len(steps))])
    sums = each.agg(*[F.count_if(F.col(c)).alias(c) for c in each.columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(u).alias("upto"), F.col(f"c{i}").alias("chosen"), F.col(f"l{i}").alias("lost")) for i, u in enumerate(steps)])))


def block_sample(
    records: DataFrame, keys: list[str], order: list[str], sequence: str = "pos", block_size: int = 80, take: int = 8, seed: str = "s1"
) -> DataFrame:
    """The chosen regions: ``keys``, ``seq``, ``block``.

    Exactly ``take`` of every ``block_size`` numbers are chosen.  One shuffle on the region key
    with map-side minima; a region's many deliveries and one image's many regions spread over all
    tasks.  Empty input gives an empty sample; repeated rows change nothing; other columns are
    ignored whatever their names.
    """
    if not 0 < take <= block_size:
        raise ValueError("0 < take <= block_size")
    seen = first_seen(records, keys, order, sequence).withColumn("block", F.floor(F.col("seq") / block_size).cast("long"))
    at = F.col("seq") - F.col("block") * block_size
    return seen.where(F.array_contains(chosen_positions(F.col("block"), block_size, take, seed), at))


def floyd_sql(block: str, block_size: int, take: int, seed: str) -> str:
    """The same positions as a DuckDB expression over columns ``h0..`` of hashed 32-bit draws: a
    list built step by step, each step its own nested select."""
    if take > 8:
        raise ValueError("one digest holds eight draws")
    digest = f"sha256('{seed}:' || ({block})::varchar || ':0')"
    sql = f"select *, {digest} as dg, []::bigint[] as got0"
    for j in range(take):
        top = block_size - take + j
        draw = f"(('0x' || substr(dg, {8 * j + 1}, 8))::bigint % {top + 1})"
        sql = f"select *, list_append(got{j}, case when list_contains(got{j}, {draw}) then {top} else {draw} end) as got{j + 1} from ({sql if j else sql + ' from seen'})"
    return sql
