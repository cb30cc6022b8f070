"""Structured Streaming over files: quality flags as rows arrive, windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import quality as ql


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def structural_flags(df: DataFrame, ko: str = "ko_text_analysis", en: str = "en_text_analysis") -> DataFrame:
    """The flags that need one row only: they hold alike for batch and stream."""
    k, e = ql.side_flags(ko, ko, "ko"), ql.side_flags(en, en, "en")
    names = {"empty_text_flag": "empty", "decode_integrity_flag": "decode", "markup_dominant_flag": "markup", "control_char_excess_flag": "control"}
    return df.drop(*names).fillna("", [ko, en]).withColumns({n: k[c] | e[c] for n, c in names.items()})


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the newest are dropped by a stream, and none by a batch."""
    d = events.withColumn(at, F.col(at).cast("timestamp"))
    d = d.withWatermark(at, late) if events.isStreaming else d
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return d.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def first_seen(df: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def to_parquet(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """An exactly-once file sink that ends when all files there now are read."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_table(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """An aggregate as a table that each trigger replaces as a whole, so a repeated trigger changes nothing; ends when all files there now are read. Read it by ``latest_table``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/trigger={number:09d}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def latest_table(spark: SparkSession, folder: str) -> DataFrame:
    """What the last trigger of ``to_table`` wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(max(s.getPath().toString() for s in fs.listStatus(path)))


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``df`` with metrics that a listener receives as rows pass, in batch and stream, at no further scan."""
    return df.observe(name, *(m.alias(k) for k, m in metrics.items()))


def eta(done: int, total: int, seconds: float) -> dict[str, float | None]:
    """Rate and time left; both null before anything is done."""
    rate = done / seconds if seconds > 0 and done > 0 else None
    return {"rows_per_second": rate, "seconds_left": (total - done) / rate if rate else None}


def liveness(age: str | Column, stale: float = 60, dead: float = 600) -> Column:
    """LIVE, STALE or DEAD by the seconds since a snapshot; UNKNOWN for null."""
    a = F.col(age) if isinstance(age, str) else age
    return F.when(a.isNull(), "UNKNOWN").when(a < stale, "LIVE").when(a < dead, "STALE").otherwise("DEAD")
