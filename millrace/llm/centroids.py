"""Centroid clustering: Lloyd's rounds over column blocks, exact in whole numbers.

Vectors are dealt into chunks of rows, and every chunk into one block for each shard of dimensions. In a
round, the tasks of a shard's blocks compute the squared distances to their slices of the centroids; these
partial distances are added by chunk, and the nearest centroid of each vector is found there. The numbers of
the nearest go back to the blocks, where every shard sums its own dimensions for each centroid and replaces
its own slice. Only the centroids (k times the number of dimensions) and one number for each vector leave
the shards; a round reads the staged blocks, so a lost executor costs the tasks it held.

All arithmetic is in integers: a component x becomes floor(scale * x). Ties go to the smaller number, a
centroid without vectors stays.

Vectors that are null, have another length, or hold a null or non-finite component take no part; neither do
those with a component beyond 2^27 after scaling, as no long would hold their squared distances. Equal rows
count as often as they stand there. A null id counts as an empty text where starting vectors are chosen.
Fewer vectors than k: as many centroids as vectors. Empty table: no rows. Sums of distances that no long
holds are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged

K, ROUNDS, SHARDS, SCALE, SEED = 8, 10, 4, 1024, 3
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, column: str = "embedding", dims: int = 64, scale: int = SCALE) -> DataFrame:
    """vec_id and v (the components in whole numbers) of the vectors that take part."""
    scaled = lambda x: x.cast("double") * scale
    fits = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) <= LARGEST))
    return vectors.where((F.size(column) == dims) & fits).select("vec_id", F.transform(column, lambda x: F.floor(scaled(x))).alias("v"))


def column_blocks(rows: DataFrame, dims: int, shards: int = SHARDS) -> DataFrame:
    """chunk, shard, width (bytes of a number), data (the chunk's rows of that shard's columns) and ids (of the chunk, with shard 0 only)."""
    cuts = np.linspace(0, dims, shards + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not len(batch):
                continue
            all_columns = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)
            kind = np.min_scalar_type(-int(np.abs(all_columns).max()) - 1)
            data = [np.ascontiguousarray(all_columns[:, a:b].astype(kind)).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids = pa.array([batch.column(0).to_pylist()] + [None] * (shards - 1), pa.list_(batch.column(0).type))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * shards, pa.int64()), pa.array(range(shards), pa.int32()), pa.array([kind.itemsize] * shards, pa.int32()), pa.array(data, pa.binary()), ids], ["chunk", "shard", "width", "data", "ids"])
            chunk += 1

    return rows.mapInArrow(run, f"chunk long, shard int, width int, data binary, ids array<{rows.schema['vec_id'].dataType.simpleString()}>")


def starting(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()], np.int64)


def _matrix(data: bytes, width: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"i{width}")).reshape(-1, columns).astype(np.int64)


def nearest(blocks: DataFrame, centroids: np.ndarray, shards: int = SHARDS) -> DataFrame:
    """chunk, cluster and distance (a 32-bit and a 64-bit integer for each of the chunk's rows)."""
    k, dims = centroids.shape
    cuts = np.linspace(0, dims, shards + 1).astype(int)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, width, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                own = centroids[:, cuts[shard] : cuts[shard + 1]]
                rows = _matrix(data, width, own.shape[1])
                out.append(np.stack([((rows - c) ** 2).sum(axis=1) for c in own]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in parts["part"]).reshape(k, -1)
        cluster = total.argmin(axis=0)
        return pd.DataFrame({"chunk": [parts["chunk"].iloc[0]], "cluster": [cluster.astype(np.int32).tobytes()], "distance": [total.min(axis=0).tobytes()]})

    parts = blocks.select("chunk", "shard", "width", "data").mapInArrow(partial, "chunk long, part binary")
    return parts.groupBy("chunk").applyInPandas(add, "chunk long, cluster binary, distance binary")


def moved(blocks: DataFrame, near: DataFrame, centroids: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The centroids after a round: of each, the floor of the mean of its vectors, by shard and dimension."""
    k, dims = centroids.shape
    cuts = np.linspace(0, dims, shards + 1).astype(int)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for shard, width, data, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = cuts[shard], cuts[shard + 1]
                cluster = np.frombuffer(of, np.int32)
                np.add.at(count[:, a:b], cluster, 1)
                np.add.at(total[:, a:b], cluster, _matrix(data, width, b - a))
        where = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(where[0]), pa.array(where[1]), pa.array(count[where]), pa.array(total[where])], ["cluster", "dim", "n", "s"])

    with_cluster = blocks.select("chunk", "shard", "width", "data").join(near.select("chunk", "cluster"), "chunk").select("shard", "width", "data", "cluster")
    of = with_cluster.mapInArrow(sums, "cluster long, dim long, n long, s long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in of.select("cluster", "dim", F.expr("(s - pmod(s, n)) DIV n").alias("mean")).collect():  # k times dims rows
        out[r["cluster"], r["dim"]] = r["mean"]
    return out


def lloyd(vectors: DataFrame, column: str = "embedding", dims: int = 64, k: int = K, rounds: int = ROUNDS, shards: int = SHARDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, a row for each vector that takes part."""
    rows, shards = whole_numbers(vectors, column, dims, scale), min(shards, dims)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = starting(rows, k, seed)
    if not len(centroids):
        nothing = "vec_id, CAST(0 AS INT) AS cluster, 0L AS distance, 0L AS cluster_inertia, 0L AS inertia, '' AS centroid_sha256"
        return rows.where("false").selectExpr(*nothing.split(", "))
    blocks = staged(column_blocks(rows, dims, shards), "blocks")
    for _ in range(rounds):
        before, centroids = centroids, moved(blocks, nearest(blocks, centroids, shards), centroids, shards)
        if (before == centroids).all():
            break  # nothing moves any more

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cluster, distance in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(cluster, np.int32)), pa.array(np.frombuffer(distance, np.int64))], ["vec_id", "cluster", "distance"])

    ids = blocks.where("shard = 0").select("chunk", "ids")
    found = ids.join(nearest(blocks, centroids, shards), "chunk").select("ids", "cluster", "distance").mapInArrow(spread, f"vec_id {kind}, cluster int, distance long")
    found = staged(found, "clusters")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    whole = of.agg(F.sum("s").alias("all"))
    fits = lambda x: F.expr(f"try_cast({x} AS BIGINT)")
    sums = of.crossJoin(F.broadcast(whole)).select("cluster", fits("s").alias("cluster_inertia"), fits("`all`").alias("inertia"))  # one row and k rows
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1).alias("centroid_sha256"))


def sql(dims: int = 64, k: int = K, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB's SQL, with one named step for each round."""
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "xs AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        step = f"(SELECT v.r, v.vec_id, c{i}.c, list_sum(list_transform(generate_series(1, {dims}), lambda d: (v.v[d] - c{i}.v[d]) * (v.v[d] - c{i}.v[d]))) AS d FROM v, c{i})"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d FROM {step} GROUP BY r, vec_id)")
        if i < rounds:
            mean = "SELECT c, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, dim, sum(x) AS s, count(*) AS n FROM xs JOIN a" + str(i) + " USING (r) GROUP BY c, dim)"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY dim) AS v FROM ({mean}) GROUP BY c) m USING (c))")
    last = f"SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    return "WITH " + ",\n".join(out) + "\n" + last
