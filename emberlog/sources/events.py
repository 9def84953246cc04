"""The ``events`` table as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each event, in order of event_id: arrival_seq and the log columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("arrival_seq"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("timestamp"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("host-"), F.col("user_id")).alias("host_id"),
        F.col("props").alias("message"),
    )
