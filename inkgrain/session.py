"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or our own where it is unset (local runs)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"inkgrain-{os.getpid()}")
    if not os.path.isdir(made):
        os.makedirs(made)
        atexit.register(shutil.rmtree, made, True)
    return made


_WRITTEN: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write *df* once to the shared folder and read it back: lineage is cut and the rows
    survive the loss of executors.  Written tables are compact and still prune columns.  They stay until
    ``drop_settled``, as results are read lazily."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/inkgrain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> int:
    """Delete all tables that ``settle`` wrote in this process, once their results have been used; gives their
    number."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        path = make(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
