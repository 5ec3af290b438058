"""Files and tables in and out: sensor CSV, fault CSV, expert rules, measurements by date, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.graph import upsert_by_key

FAULTS = "start_idx int, end_idx int, fault_type string, affected_sensor int, duration int, start_timestamp timestamp, end_timestamp timestamp, sensor_name string"
EXPERT = (
    "causal_relationships array<struct<source:string,target:string,relation_type:string,direction:string,lag_range:array<double>,confidence:double,physics:string>>, alarm_causes array<struct<alarm_code:string,cause_parameter:string,condition:string,probability:double,action:string,priority:int>>, "
    "leading_indicators array<struct<target_event:string,indicator:string,pattern:string,lead_time:double>>, impossible_relationships array<struct<param1:string,param2:string,reason:string>>, parameter_groups array<struct<group_name:string,parameters:array<string>,description:string>>"
)


def read_pv_csv(spark: SparkSession, path: str, sensors: list[str]) -> DataFrame:
    """Wide sensor CSV (timestamp, one double for each sensor, is_anomaly) with a fixed schema, so that nothing is read twice."""
    schema = ", ".join(["timestamp timestamp", *[f"`{s}` double" for s in sensors], "is_anomaly int"])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_fault_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAULTS).option("header", True).csv(path)


def read_expert_knowledge(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of causal rules, alarm causes, leading indicators, impossible pairs and parameter groups from one JSON document; those that it lacks are empty."""
    doc = spark.read.schema(EXPERT).option("multiLine", True).json(path)
    return {c: doc.select(F.explode(c).alias("r")).select("r.*") for c in doc.columns}


def write_measurements(df: DataFrame, path: str, files_per_day: int = 1) -> None:
    """Partitioned by date, clustered by equipment and parameter inside; files_per_day splits a day over tasks, by time ranges of equal width."""
    part = F.floor((F.unix_micros(F.col("time").cast("timestamp")) % 86_400_000_000) / (86_400_000_000 / files_per_day))
    out = df.withColumn("date", F.to_date("time")).withColumn("part__", part)
    out.repartition("date", "part__").sortWithinPartitions("date", "equipment_id", "param_id", "time").drop("part__").write.partitionBy("date").mode("append").parquet(path)


def apply_retention(df: DataFrame, days: int, now, time: str = "time") -> DataFrame:
    """Rows not older than so many days before now; on a table partitioned by date the filter on date prunes folders."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    kept = df.where(F.col(time) >= since)
    return kept.where(F.col("date") >= F.to_date(since)) if "date" in df.columns else kept


def upsert_days(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], update_cols: list[str]) -> None:
    """Upsert into a table partitioned by date: only the days that occur in incoming are read and written again."""
    days = [r[0] for r in incoming.select(F.to_date("time").alias("d")).distinct().collect()]  # a row for each day
    new = incoming.withColumn("date", F.to_date("time"))
    old = spark.read.parquet(path).where(F.col("date").isin(days))
    merged = upsert_by_key(old, new.select(*old.columns), keys, update_cols)
    from millrace.operators.graph import cut

    cut(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def export_relationships(df: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON or CSV; maps and arrays become JSON text in CSV."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def route_records(df: DataFrame) -> dict[str, DataFrame]:
    """One mixed batch (topic, source_system, ...) as a table for each target."""
    rules = {
        "fdc_measurements": (F.col("topic").startswith("fdc.")) & (F.col("source_system") == "FDC"), "spc_measurements": (F.col("topic").startswith("spc.")) & (F.col("source_system") == "SPC"),
        "alarms": F.col("topic").contains("ALARM"), "lots": F.col("topic").contains("LOT"),
    }
    first = F.coalesce(*[F.when(c, F.lit(n)) for n, c in reversed(rules.items())], F.lit("other"))
    named = df.withColumn("target__", first)
    return {n: named.where(F.col("target__") == n).drop("target__") for n in [*rules, "other"]}
