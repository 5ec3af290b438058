"""A table that micro-batches upsert into, at a cost that follows the batch and not the table.

Keys are dealt into buckets by hash. A batch writes one piece for each bucket that it touches: its newest row of each
key. The table is the fold of the pieces that its newest commit names: of each key, the first row with the update
columns of the last. Once a bucket has `most` pieces, the next batch that touches it writes the fold instead (so a row
is rewritten once in `most` batches at most). A commit is a small table, written last, that names the live pieces of
every bucket; a batch that runs again starts from the commit before it and so writes the same. Pieces that neither of
the last two commits names are deleted.

    <path>/pieces/batch=<id>/bucket=<b>/...   rows
    <path>/commits/batch=<id>/...             bucket, pieces (ids of the batches that wrote them)

Null keys are keys. Rows without an order value lose against others; of equal ones the larger hash wins, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, MOST = 64, 8


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, path: str) -> list[int]:
    """The committed batches that are still kept, ascending."""
    fs, at = _fs(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at) if x.isDirectory()]
    whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in whole)


def live(spark: SparkSession, path: str, batch: int | None) -> dict[int, list[int]]:
    """The pieces of each bucket after a commit: at most `buckets` rows with `most` numbers."""
    if batch is None:
        return {}
    rows = spark.read.schema("bucket int, pieces array<long>").parquet(f"{path}/commits/batch={batch}").collect()
    return {r["bucket"]: list(r["pieces"]) for r in rows}


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _pieces(spark: SparkSession, path: str, of: dict[int, list[int]], schema) -> DataFrame:
    """The rows of these pieces, with piece__ (the batch that wrote them)."""
    paths = [f"{path}/pieces/batch={p}/bucket={b}" for b, ps in of.items() for p in ps]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("piece__", F.lit(0).cast("long"))
    return spark.read.schema(schema).parquet(*paths).withColumn("piece__", F.regexp_extract(F.col("_metadata.file_path"), r"/pieces/batch=(\d+)/", 1).cast("long"))


def fold(rows: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Of each key, the row of its first piece with the update columns of its last."""
    columns = [c for c in rows.columns if c != "piece__"]
    rest = [c for c in columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "piece__").alias("first__"), F.max_by(F.struct(*rest), "piece__").alias("last__"))
    return out.select(*[F.col(c) if c in keys else F.col(f"{'last__' if c in update_cols else 'first__'}.{c}").alias(c) for c in columns])


def upsert(batch: DataFrame, batch_id: int, path: str, keys: list[str], update_cols: list[str], order: str, buckets: int = BUCKETS, most: int = MOST) -> None:
    """Take a batch into the table at path. Batch ids ascend; the last one may come again."""
    spark = batch.sparkSession
    done = [b for b in commits(spark, path) if b < batch_id]
    before = live(spark, path, done[-1] if done else None)
    rest = [c for c in batch.columns if c not in keys]
    if rest:
        newest = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
        new = batch.groupBy(*keys).agg(newest.alias("n__")).select(*[F.col(c) if c in keys else F.col(f"n__.{c}").alias(c) for c in batch.columns])
    else:
        new = batch.distinct()
    full = {b: ps for b, ps in before.items() if len(ps) >= most}
    of = _bucket(keys, buckets)
    here = f"{path}/pieces/batch={batch_id}"

    def write(rows: DataFrame, mode: str) -> None:
        rows.withColumn("bucket", of).hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(here)

    if not full:
        write(new, "overwrite")
    else:
        merged = of.isin(list(full))
        write(new.where(~merged), "overwrite")
        # the pieces of a full bucket are read only where the batch touches it
        touched = {r["b"] for r in new.where(merged).select(of.alias("b")).distinct().collect()}
        full = {b: ps for b, ps in full.items() if b in touched}
        if full:
            write(fold(_pieces(spark, path, full, batch.schema).unionByName(new.where(merged).withColumn("piece__", F.lit(batch_id).cast("long"))), keys, update_cols), "append")
    fs, at = _fs(spark, here)
    written = [int(x.getPath().getName().removeprefix("bucket=")) for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")]
    after = before | {b: [batch_id] if b in full else [*before.get(b, []), batch_id] for b in written}
    spark.createDataFrame([(b, ps) for b, ps in sorted(after.items())], "bucket int, pieces array<long>").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")

    # what only older commits name; the one before stays, for a batch that comes again
    kept = {(b, p) for of_commit in (before, after) for b, ps in of_commit.items() for p in ps}
    for old in done[:-1]:
        for b, ps in live(spark, path, old).items():
            for p in ps:
                if (b, p) not in kept:
                    fs.delete(_fs(spark, f"{path}/pieces/batch={p}/bucket={b}")[1], True)
        fs.delete(_fs(spark, f"{path}/commits/batch={old}")[1], True)


def read_upserts(spark: SparkSession, path: str, schema, keys: list[str], update_cols: list[str]) -> DataFrame:
    """The table after its newest commit; empty before the first."""
    done = commits(spark, path)
    return fold(_pieces(spark, path, live(spark, path, done[-1] if done else None), schema), keys, update_cols)
