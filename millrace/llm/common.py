"""What the operators share: table access, staging in the shared folder, small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words is exactly these code points; everything else belongs to a word.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote and that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with place__ (its place in that order, from 0) and, for each name, the sum over all rows before; the sort is dealt by ranges, and only a row for each range meets in one task."""
    ranged = df.withColumns({f"{k}__own": v for k, v in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumn("at__", F.monotonically_increasing_id()), "ordered").withColumn("range__", F.shiftright("at__", 33))
    here, ranges = (Window.partitionBy(k).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for k, o in (("range__", "at__"), (F.lit(0), "range__")))
    of = ranged.groupBy("range__").agg(F.count("*").alias("n__"), *[F.sum(f"{k}__own").alias(f"{k}__all") for k in sums])
    none = lambda c: F.coalesce(c, F.lit(0))
    of = of.select("range__", none(F.sum("n__").over(ranges)).alias("n__"), *[none(F.sum(f"{k}__all").over(ranges)).alias(f"{k}__all") for k in sums])
    out = ranged.join(of, "range__").select("*", (F.col("n__") + F.col("at__") - F.shiftleft("range__", 33)).alias("place__"), *[(F.col(f"{k}__all") + none(F.sum(f"{k}__own").over(here))).alias(k) for k in sums])
    return out.drop("at__", "range__", "n__", *[f"{k}__{x}" for k in sums for x in ("own", "all")])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch, for columns of whole texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often (or inside which lambda) body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def signed(x: int) -> int:
    """An unsigned 64-bit integer as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, so that reruns and lost tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)
