"""Session builder, table loader and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "pairloom", **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on; ``conf`` overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=base).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, else (tests only) a local one."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        folder = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        made = shared_dir.made = f"file://{folder}"
    return made


def cut(df: DataFrame, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    A reliable checkpoint() computes its input twice unless it is cached; a Parquet
    table is written once and read by column, so it is used instead. ``rows_per_file``:
    for rows that are costly afterwards, so that small tables are read by many tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _cuts.append(path)
    (df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_cuts: list[str] = []


def forget_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote so far, once no result that reads them is needed any more; returns how many."""
    jvm, n = spark._jvm, len(_cuts)
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for costly expressions over an input of fewer partitions than cores; else ``df`` as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


__all__ = ["StorageLevel", "build_session", "cut", "forget_cuts", "shared_dir", "spread", "table"]
