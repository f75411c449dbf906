"""Sizes of texts in tokens of a public tokenizer, and prefix sums without one large task."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
FILE = "byte_bpe_multi_50k.tiktoken"
#: The split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str], folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """``(key, *keep, n_tokens)``: the whole text is counted; null and empty texts have 0 tokens."""
    path = os.path.join(folder, file)
    rows = docs.select(key, *keep, text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b[text]]
            yield b.drop(columns=[text]).assign(n_tokens=pd.Series(n, dtype="int64", index=b.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInPandas(count, schema + ", n_tokens bigint")


def prefix_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, buckets: int = 64) -> DataFrame:
    """*rows* with ``name``: the sum of *value* over the rows before it in its group, in the order
    of a hash bucket, the hash and then ``order``; fixed as long as ``buckets`` is.

    A group is cut into ``buckets`` by that hash; each bucket is summed on its own and offset by
    the buckets before it, so no task holds a whole group.  The bucket sums are at most
    ``buckets`` rows a group.
    """
    h = F.xxhash64(*order)
    cut = rows.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = cut.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_o", F.coalesce(F.sum("_s").over(upto), F.lit(0))).drop("_s").withColumnsRenamed({g: f"_{g}" for g in group}).withColumnRenamed("_b", "_c")
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_b") == F.col("_c")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return summed.join(starts, on).withColumn(name, F.col(name) + F.col("_o")).drop("_h", "_b", "_c", "_o", *[f"_{g}" for g in group])
