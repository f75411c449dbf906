"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Plain ASCII and the Vietnamese letters; the recogniser's vocabulary.
VOCAB = "".join(map(chr, range(32, 127))) + "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯư" + "".join(map(chr, range(0x1EA0, 0x1EFA)))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def once(df: DataFrame, key: str = "pos") -> DataFrame:
    """Rows delivered twice count once: the first by time of arrival."""
    when = next(c for c in ("delivered_at", "loaded_at") if c in df.columns)
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(when)).alias("x")).select(key, "x.*")


def _first(spark: SparkSession, d: str, name: str, when: str, cols: tuple[str, ...]) -> DataFrame:
    rows = table(spark, d, name)
    return once(rows.select("pos", when, *[c for c in cols if c not in ("pos", when)]) if cols else rows)


def instances(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Records once, with ``pos`` and *cols* (all columns by default), of which alone the file is read."""
    return _first(spark, d, "instances", "delivered_at", cols)


def feats(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return _first(spark, d, "feats", "loaded_at", cols)


#: The same in SQL.
INSTANCES = "inst as (select * from instances qualify row_number() over (partition by pos order by delivered_at) = 1)"
FEATS = "ft as (select * from feats qualify row_number() over (partition by pos order by loaded_at) = 1)"
#: A pattern class of the vocabulary for RE2.
CLASS = "".join("\\" + x if x in "\\[]^-" else ("''" if x == "'" else x) for x in sorted(set(VOCAB)))
