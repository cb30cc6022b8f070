"""Queries whose expressions run alike over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from ..streaming import streams
from .registry import query


HOURLY = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(HOURLY)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("total", F.round("total", 4))


@query(HOURLY)
def streamed_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by a stream over the files, with its state and checkpoint in the shared folder."""
    source = table(spark, sf_dir, "events")
    path, where = f"{sf_dir.rstrip('/')}/events.parque[t]", f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    # A pattern, as a stream takes a folder or a pattern, and the table may be one file.
    stream = streams.file_stream(spark, path, source.schema)
    streams.to_table(streams.windowed_counts(stream, "ts", "event_type", late="3650 days"), f"{where}/out", f"{where}/state").awaitTermination()
    return streams.latest_table(spark, f"{where}/out").withColumn("total", F.round("total", 4))


@query(
    "SELECT count(*) AS n, count(*) FILTER (WHERE ko_text_analysis = '' OR en_text_analysis = '') AS empty, count(*) FILTER (WHERE contains(ko_text_analysis, chr(65533)) OR contains(en_text_analysis, chr(65533))) AS undecodable FROM pair_registry"
)
def streamed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = streams.structural_flags(table(spark, sf_dir, "pair_registry"))
    return d.agg(F.count("*").alias("n"), F.count_if("empty_text_flag").alias("empty"), F.count_if("decode_integrity_flag").alias("undecodable"))
