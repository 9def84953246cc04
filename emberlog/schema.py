"""The log record, and the columns that storage adds."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_COLUMNS = ("timestamp", "service_name", "host_id", "message")

#: ``timestamp`` has no unit: the full range of 64-bit integers is legal, so it isn't a Spark timestamp.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("service_name", T.StringType(), False),
        T.StructField("host_id", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
    ]
)

#: What a store keeps. ``local_offset`` counts the arrivals of a shard from 0, without gaps.
ARRIVALS_SCHEMA = T.StructType(
    [
        T.StructField("local_offset", T.LongType()),
        *(T.StructField(f.name, f.dataType) for f in LOG_SCHEMA),
        T.StructField("shard", T.IntegerType()),
    ]
)

#: Rows of a topic, in Kafka's columns.
TOPIC_SCHEMA = "key binary, value binary, topic string, partition int, offset bigint"
