"""Topics: Kafka, and a folder of Parquet files in Kafka's columns that stands in for it.

Both have the same rows (TOPIC_SCHEMA), so everything after the source is the same.
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceUnavailable
from ..functions.records import encoded
from ..functions.routing import ROUTERS, Md5Router, SipRouter
from ..operators.offsets import by_shard, local_offsets
from ..operators.store import Offsets
from ..schema import TOPIC_SCHEMA


class Topic(Protocol):
    name: str

    def stream(self, spark: SparkSession, starting: Offsets | None = None) -> DataFrame: ...

    def send(self, rows: DataFrame, partitions: int, router: Md5Router | SipRouter = ROUTERS["md5"]) -> None: ...


def messages(rows: DataFrame, partitions: int, router: Md5Router | SipRouter = ROUTERS["md5"]) -> DataFrame:
    """Log records as messages: JSON value, host as the key, the partition that owns the host."""
    routed = router.routed(rows, partitions)
    return routed.select(F.col("host_id").cast("binary").alias("key"), encoded().cast("binary").alias("value"), F.col("shard").alias("partition"))


class KafkaTopic:
    """Needs Spark's Kafka connector (spark-sql-kafka-0-10) on the class path."""

    def __init__(self, brokers: str, name: str, rows_per_trigger: int | None = None, tasks: int | None = None, poll_ms: int | None = None):
        """``tasks``: a micro-batch is read by so many at least, also of fewer partitions."""
        self.brokers, self.name, self.rows_per_trigger, self.tasks, self.poll_ms = brokers, name, rows_per_trigger, tasks, poll_ms

    def options(self, starting: Offsets | None = None) -> dict[str, str]:
        """Options of the source: from the earliest offsets, or from those given."""
        first = json.dumps(starting.starting()) if starting and starting.inner().get(self.name) else "earliest"
        found = {"kafka.bootstrap.servers": self.brokers, "subscribe": self.name, "startingOffsets": first}
        given = {"maxOffsetsPerTrigger": self.rows_per_trigger, "minPartitions": self.tasks, "kafkaConsumer.pollTimeoutMs": self.poll_ms}
        return found | {k: str(v) for k, v in given.items() if v}

    def _found(self, spark: SparkSession) -> None:
        loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        try:
            loader.loadClass("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        except Exception as e:
            raise SourceUnavailable("this session has no Kafka connector (spark-sql-kafka-0-10)") from e

    def stream(self, spark: SparkSession, starting: Offsets | None = None) -> DataFrame:
        """From the earliest offsets, or from those given; a checkpoint takes precedence over both."""
        self._found(spark)
        return spark.readStream.format("kafka").options(**self.options(starting)).load().select("key", "value", "topic", "partition", "offset")

    def send(self, rows: DataFrame, partitions: int, router: Md5Router | SipRouter = ROUTERS["md5"]) -> None:
        self._found(rows.sparkSession)
        out = messages(rows, partitions, router).write.format("kafka").option("kafka.bootstrap.servers", self.brokers)
        out.option("topic", self.name).option("kafka.delivery.timeout.ms", "5000").option("kafka.request.timeout.ms", "2500").save()


def ensure_topic(brokers: str, name: str, partitions: int) -> None:
    """Creates a topic with one replica; one that exists is left as it is. Needs an admin client (kafka-python)."""
    try:
        from kafka.admin import KafkaAdminClient, NewTopic
        from kafka.errors import TopicAlreadyExistsError
    except ImportError as e:
        raise SourceUnavailable("topic administration needs the package kafka-python") from e
    admin = KafkaAdminClient(bootstrap_servers=brokers)
    try:
        admin.create_topics([NewTopic(name, partitions, 1)])
    except TopicAlreadyExistsError:
        pass
    finally:
        admin.close()


class FileTopic:
    """A folder of Parquet files. ``send`` appends; offsets go on where the folder's end."""

    def __init__(self, path: str, name: str = "logs", files_per_trigger: int | None = None):
        self.path, self.name, self.files_per_trigger = path, name, files_per_trigger

    def stream(self, spark: SparkSession, starting: Offsets | None = None) -> DataFrame:
        reader = spark.readStream.schema(TOPIC_SCHEMA)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        rows = reader.parquet(self.path)
        return rows.where(F.col("offset") >= by_shard(starting.inner().get(self.name, {}) if starting else {}, 0, "partition"))

    def ends(self, spark: SparkSession) -> dict[int, int]:
        try:
            rows = spark.read.schema(TOPIC_SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return {r.partition: r.end for r in rows.groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()}

    def send(self, rows: DataFrame, partitions: int, router: Md5Router | SipRouter = ROUTERS["md5"], order: tuple[str, ...] = ("arrival_seq",)) -> None:
        routed = router.routed(rows, partitions)
        numbered = local_offsets(routed, order, self.ends(rows.sparkSession))
        value = numbered.select(
            F.col("host_id").cast("binary").alias("key"), encoded().cast("binary").alias("value"), F.lit(self.name).alias("topic"), F.col("shard").alias("partition"), F.col("local_offset").alias("offset")
        )
        # a partition is one sequence of messages, so it is one file of each send, and partitions are written in parallel
        value.repartition("partition").sortWithinPartitions("partition", "offset").write.mode("append").parquet(self.path)
