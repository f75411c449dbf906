"""Writers (K1-K5, K7, K8): Spark folders, one line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ONE_FILE = 1_000_000  #: tokens of a bank from which on several tasks write it


def clean_cell(c: Column) -> Column:
    """A cell fit for a tab-separated line: tab and line feed as space, no carriage return (K4)."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\n\r", "  ")


def tsv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(value)``: the cells joined by tabs, without quoting (K1)."""
    return df.select(F.concat_ws("\t", *[clean_cell(F.col(c)) for c in columns]).alias("value"))


def write_tsv(df: DataFrame, columns: list[str], path: str, mode: str = "overwrite") -> None:
    tsv_lines(df, columns).write.mode(mode).text(path)


def write_frequencies(bank: DataFrame, path: str, first: str | None = None) -> None:
    """Tokens by falling count, ties by the column *first* (where a token was first seen), then by token (K2).
    The lines of all files, by file name, are in order; a bank of fewer than ``ONE_FILE`` tokens is one file."""
    order = [F.col("cnt").desc(), *([first] if first else []), "token"]
    rows = bank.orderBy(*order) if bank.count() >= ONE_FILE else bank.repartition(1).sortWithinPartitions(*order)
    tsv_lines(rows, ["token", "cnt"]).write.mode("overwrite").text(path)


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON document a row (K3, K7)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def manifest(counts: DataFrame, seed: str, config: dict[str, str]) -> DataFrame:
    """One row that tells how something was made: seed, configuration and its counts (K7)."""
    settings = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv])
    return counts.select(F.lit(seed).alias("seed"), settings.alias("config"), *counts.columns)


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def append_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines (K5)."""
    events.write.mode("append").json(path)


def replace_sheet(df: DataFrame, columns: list[str], path: str) -> str:
    """Write the sheet beside *path* and put it in its place by a rename, so that readers see the old
    or the new sheet whole (K4)."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    head = spark.range(1).select(F.lit("\t".join(columns)).alias("value"), F.lit(0).alias("o"))
    body = tsv_lines(df, columns).select("value", F.lit(1).alias("o"))
    head.union(body).repartition(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(new)
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(new), make(path))
    fs.delete(make(old), True)
    return path


def report_lines(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Aligned lines of a score table, ``nan`` for an undefined ratio (K8)."""
    cells = [F.rpad(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), 24, " ")]
    cells += [F.lpad(F.when(F.col(m).isNull(), "nan").otherwise(F.format_string("%.3f", F.col(m) * 100)), 10, " ") for m in metrics]
    return scores.select(F.concat(*cells).alias("value"))
