"""Streaming scans of landing folders (and of a broker, where its connector is installed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilbus.schema import CAN_FRAMES


def files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
          glob: str | None = None, files_per_trigger: int | None = None,
          bytes_per_trigger: int = 4 << 30) -> DataFrame:
    """New files of a folder. The two limits bound one micro-batch, and with it the rows of one
    key that a stateful operator sorts at a time; the file limit wins where both are given."""
    reader = spark.readStream.format(fmt).schema(schema)
    if not files_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def table(spark: SparkSession, folder: str, name: str, schema: T.StructType,
          files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of the folder as a stream, be it one file or a folder of part files."""
    return files(spark, f"{folder}/{{{name}}}.parquet", schema, files_per_trigger=files_per_trigger)


def can_frames(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    return files(spark, folder, CAN_FRAMES, files_per_trigger=files_per_trigger)


def packets(spark: SparkSession, folder: str, schema: T.StructType,
            files_per_trigger: int | None = None) -> DataFrame:
    """JSON packets with their reception time."""
    rows = files(spark, folder, schema, "json", files_per_trigger=files_per_trigger)
    return rows.withColumn("reception_time", F.current_timestamp())


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def broker_packets(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON packets from a Kafka topic; needs the public Kafka connector on the classpath."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).load()
    body = F.from_json(F.col("value").cast("string"), schema)
    return raw.select(body.alias("_b"), F.col("timestamp").alias("reception_time")).select(
        "_b.*", "reception_time")
