"""Topics in and out: JSON messages of a message queue, or of a folder of JSON lines with the same code after the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BAD = "_corrupt_record"


def read_messages(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    """A stream with one text column, value. source: {"kafka": servers, "topics": names} or {"files": folder}."""
    if "files" in source:
        return spark.readStream.format("text").load(source["files"])
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", source["kafka"]).option("subscribe", source["topics"]).option("startingOffsets", "latest").load().select(F.col("value").cast("string").alias("value"))


def parse(messages: DataFrame, schema: str) -> DataFrame:
    """The fields of schema and _corrupt_record, which holds a message that isn't JSON of this form."""
    return messages.select(F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("m")).select("m.*")


def read_topic(spark: SparkSession, source: dict[str, str], schema: str) -> DataFrame:
    return split_dead_letters(read_messages(spark, source), schema)[0]


def split_dead_letters(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the texts of bad ones (value)."""
    parsed = messages.withColumn("m__", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    bad = F.col("m__").isNull() | F.col(f"m__.{BAD}").isNotNull()
    return parsed.where(~bad).select("m__.*").drop(BAD), parsed.where(bad).select("value")


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON text, with a key if asked."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_topic(df: DataFrame, sink: dict[str, str], checkpoint: str, key: str | None = None) -> DataStreamWriter:
    """At least once: to a topic {"kafka": servers, "topic": name} or to a folder {"files": path}."""
    out = to_messages(df, key)
    if "files" in sink:
        return out.select("value").writeStream.format("text").option("path", sink["files"]).option("checkpointLocation", checkpoint)
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", sink["kafka"]).option("topic", sink["topic"]).option("checkpointLocation", checkpoint)
