"""Event streams: file and Kafka sources, and the shared cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.clean import clip_event_texts, coerce_events, event_is_valid, parse_events

EVENT_FIELDS = ["volume_id", "timestamp", "node_id", "total_iops", "avg_latency_us"]


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines as text, so that malformed lines can be kept and counted."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).withColumnRenamed("value", "json")


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The same lines from a Kafka topic; needs the Kafka package on the cluster."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    return raw.select(F.col("value").cast("string").alias("json"))


def clean_events(lines: DataFrame, low: dict[str, float], high: dict[str, float], fields: list[str] = EVENT_FIELDS,
                 ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(clean events, rejected lines); works on streams and on tables alike.

    Parse, clip to the bounds, reject what lacks a volume or a readable time,
    make every metric a number. The time becomes the column ``ts``.
    """
    parsed = clip_event_texts(parse_events(lines, "json", fields), low, high)
    ok = event_is_valid(parsed, "volume_id", ts)
    good = coerce_events(parsed.where(ok).drop("_corrupt_record"))
    return good.withColumn("ts", F.col(ts).cast("timestamp")).drop(ts), parsed.where(~ok)
