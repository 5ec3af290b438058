"""Nearest neighbours by inner product through randomly rotated one-bit codes, in lists around centres.

A vector is rotated at random (a few rotations after one another make the code longer) and keeps the
signs alone, packed, with two scalars: its norm and how well the signs point along it. The inner product with a
rotated query is estimated from the signs; the estimate is unbiased and its error shrinks with the
bits, which gives a bound on each side. Only vectors whose upper bound reaches what the k-th nearest has
at least are compared exactly, in double precision, with the vector itself.

Every vector lies in the list of its nearest centre; centres are fitted on a bounded sample (at most about
`SAMPLE` vectors and `SAMPLE_BYTES` of each length). The k-th best inner product of a query with that sample is one that
its k-th nearest reaches at least. A query goes to the lists that may hold such a product: that of the
centre, and a share (`Lists.reach`, at most 1) of the product of the query's length and the distance between the
centre and the list's farthest vector. That share is what `SURE` of the sample's own nearest pairs need; it is
measured again by the tests, as recall. Long lists are dealt into blocks, and so are the queries of a list; a vector is copied
only for each `QUERIES` queries that its list gets. The answers of all tasks and those from the sample meet by query. Equal vectors
count once in a block, with their k + 1 smallest ids.

Vectors that are null, empty, zero or hold null or non-finite values take no part, neither as queries
nor as candidates. Vectors are compared with those of the same length; the 64 commonest lengths have
centres, any other is one list. Ties go to the smaller id, rows that repeat an id stay candidates of
their own; as a query such an id counts once, with the least of its vectors. A query's own id is no
candidate. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged, uniform

ROTATIONS = 2
#: Half the width of the bounds, in standard errors of the estimate.
ERRORS = 3.0
VECTORS, QUERIES = 8192, 4096
#: Vectors to a list and lists to a length; the sample's vectors and bytes.
PER_LIST, LISTS, SAMPLE, SAMPLE_BYTES, LENGTHS = 512, 4096, 1 << 14, 1 << 25, 64
#: Nearest pairs of each of 512 vectors of the sample that fix the share of the distance that counts, and how many of the pairs it covers.
CALIBRATE, SURE = 20, 0.97


def rotations(dim: int, seed: int = 17, count: int = ROTATIONS) -> np.ndarray:
    """(dim, count * dim): random orthogonal matrices side by side."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)], axis=1)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norm, and the inner product of the unit vector's rotations with its unit signs."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = vectors @ turn
    count = turn.shape[1] // turn.shape[0]
    along = np.abs(turned).sum(axis=1) / (norm * np.sqrt(turn.shape[1] * count))
    return np.packbits(turned >= 0, axis=1, bitorder="little"), norm, along


def estimate(codes: np.ndarray, norm: np.ndarray, along: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector): estimated inner products and the standard error of each."""
    bits = turn.shape[1]
    count = bits // turn.shape[0]
    signs = np.unpackbits(codes, axis=1, count=bits, bitorder="little").astype(np.float32) * 2 - 1
    turned = (queries @ turn).astype(np.float32) / np.float32(np.sqrt(bits * count))
    scale = (norm / along).astype(np.float32)
    spread = (norm * np.sqrt(np.maximum(1 - along**2, 0)) / along).astype(np.float32) / np.float32(np.sqrt(max(bits - 1, 1)))
    return (turned @ signs.T) * scale, np.linalg.norm(queries, axis=1).astype(np.float32)[:, None] * spread


def valid(vector: Column) -> Column:
    """A vector that can be compared."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Lists(NamedTuple):
    """Centres, the sample they come from (distinct rows with a hash of the vector and how often each occurs), and the share of |query| * |farthest vector - centre| by which what a query has at least may exceed its product with the centre."""

    centres: np.ndarray
    ids: np.ndarray
    sample: np.ndarray
    marks: np.ndarray
    times: np.ndarray
    reach: float

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and distance to its centre."""
        near = ((self.centres**2).sum(axis=1) - 2 * (vectors @ self.centres.T)).argmin(axis=1)
        return near, np.linalg.norm(vectors - self.centres[near], axis=1)

    def scores(self, queries: np.ndarray, query_ids: np.ndarray) -> np.ndarray:
        """(query, vector of the sample): inner products, but for a query's own id."""
        score = queries @ self.sample.T
        score[query_ids[:, None] == self.ids] = -np.inf
        return score

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of each query's k best in the sample, their inner products (-inf: its own id), and what its k-th nearest has at least."""
        score = self.scores(queries, query_ids)
        top = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(self.ids) > k else np.broadcast_to(np.arange(len(self.ids)), score.shape)
        exact = np.einsum("qd,qkd->qk", queries, self.sample[top])
        exact[np.isneginf(np.take_along_axis(score, top, axis=1))] = -np.inf
        least = exact.min(axis=1) if len(self.ids) > k else np.full(len(queries), -np.inf)
        return top, exact, least - 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(self.sample, axis=1).max(initial=0)

    def reached(self, queries: np.ndarray, least: np.ndarray, far: np.ndarray) -> np.ndarray:
        """(query, list): whether a list whose farthest vector is so far from the centre may hold a product of `least` or more."""
        slack = self.reach * np.linalg.norm(queries, axis=1)[:, None] * far
        return queries @ self.centres.T + slack >= least[:, None]


def fit_lists(ids: np.ndarray, sample: np.ndarray, marks: np.ndarray, times: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> Lists:
    """Centres by a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    order = np.lexsort((*sample.T[:1], ids))
    ids, sample, marks, times = ids[order], sample[order], marks[order], times[order]
    out = Lists(sample[np.sort(rng.choice(len(ids), min(count, len(ids)), replace=False))].copy(), ids, sample, marks, times, 1.0)
    for _ in range(rounds):
        near, _ = out.of(sample)
        n = np.bincount(near, minlength=len(out.centres))
        total = np.stack([np.bincount(near, column, len(out.centres)) for column in sample.T], axis=1)
        out.centres[n > 0] = total[n > 0] / n[n > 0, None]
    near, off = out.of(sample)
    far = np.zeros(len(out.centres))
    np.maximum.at(far, near, off)
    some = rng.permutation(len(ids))[:512]
    asked = sample[some]
    v = np.argsort(-out.scores(asked, ids[some]), axis=1)[:, :CALIBRATE]
    least = (asked * sample[v[:, -1]]).sum(axis=1)
    more = least[:, None] - np.einsum("qd,qkd->qk", asked, out.centres[near[v]])
    share = more / np.maximum(np.linalg.norm(asked, axis=1)[:, None] * far[near[v]], 1e-300)
    return out._replace(reach=float(np.clip(np.quantile(share, SURE), 0, 1)) if share.size else 1.0)


def nearest_in_block(vectors: np.ndarray, ids: np.ndarray, packed: tuple, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and exact score of each query's k nearest in a block, as far as they may reach `least`; vectors are distinct by (vector, place among equals)."""
    guess, error = estimate(*packed, queries, turn)
    low, high = guess - ERRORS * error, guess + ERRORS * error
    n = len(ids)
    # one more than k, for the query itself
    floor = np.partition(low, n - (k + 1), axis=1)[:, n - (k + 1)] if n > k + 1 else np.full(len(queries), -np.inf, np.float32)
    q, v = np.nonzero(high >= np.maximum(floor, least)[:, None])
    keep = query_ids[q] != ids[v]
    q, v = q[keep], v[keep]
    # exactly, and without what the sample alone pushes out of the k nearest
    score = np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + 65536]], vectors[v[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)])
    near = score >= least[q]
    q, v, score = q[near], v[near], score[near]
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, q, "left")
    top = np.arange(len(q)) - first < k
    return q[top], v[top], score[top]


def _arrays(rows: list, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and vectors of each length."""
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.array([rows[i] for i in at.tolist()])


def _models(base: DataFrame) -> dict[int, Lists]:
    """Lists for the commonest lengths, from a bounded sample of distinct rows."""
    sizes = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    wanted = {dim: min(SAMPLE, SAMPLE_BYTES // (8 * dim)) / n for dim, n in sizes.items()}
    rate = F.coalesce(*[F.when(F.col("dim") == d, F.lit(r)) for d, r in wanted.items()], F.lit(0.0))
    rows = base.where(F.col("id").isNotNull() & (uniform(F.lit(3), F.col("id"), F.col("v")) < rate)).groupBy("id", "dim", "v", "mark").agg(F.count("*").alias("times")).collect()
    dims, ids, marks, times = (np.array([r[c] for r in rows], np.int64) for c in ("dim", "id", "mark", "times"))
    return {dim: fit_lists(ids[at], x, marks[at], times[at], min(LISTS, -(-sizes[dim] // PER_LIST))) for dim, at, x in _arrays([r["v"] for r in rows], dims)}


def _index(base: DataFrame, models: dict[int, Lists]) -> DataFrame:
    """id, v, dim, mark, list (-1: the length has no centres), far (distance to the centre), code, norm, along of every row."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            n = len(rows)
            lists, far, norm, along, code = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), np.zeros(n), [b""] * n
            for dim, at, x in _arrays(rows, np.array([len(r) for r in rows], np.int64)):
                turns[dim] = turns[dim] if dim in turns else rotations(dim)
                packed, norm[at], along[at] = encode(x, turns[dim])
                for i, c in zip(at.tolist(), packed, strict=True):
                    code[i] = c.tobytes()
                if dim in models:
                    lists[at], far[at] = models[dim].of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(far), pa.array(code, pa.binary()), pa.array(norm), pa.array(along)], ["id", "v", "dim", "mark", "list", "far", "code", "norm", "along"])

    return staged(base.select("id", "v", "dim", "mark").mapInArrow(coded, "id long, v array<double>, dim int, mark long, list int, far double, code binary, norm double, along double"), "codes")


def _probes(asked: DataFrame, models: dict[int, Lists], far: dict[int, np.ndarray], k: int) -> DataFrame:
    """id, v, dim, least, lists that the query goes to, and its nearest in the sample, as often as they occur (near, marks, scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows, ids = part.column(1).to_pylist(), part.column(0).fill_null(-1).to_numpy()
                least, lists, near, marks, scores = np.full(len(rows), -np.inf), [[-1]] * len(rows), [[]] * len(rows), [[]] * len(rows), [[]] * len(rows)
                for dim, at, x in _arrays(rows, np.array([len(r) for r in rows], np.int64)):
                    if dim in models:
                        top, score, least[at] = models[dim].best(x, ids[at], k)
                        of = models[dim]
                        for i, hit, t, s in zip(at.tolist(), models[dim].reached(x, least[at], far[dim]), top, score, strict=True):
                            lists[i] = np.flatnonzero(hit).tolist()
                            t, s = t[s > -np.inf], s[s > -np.inf]
                            often = np.minimum(of.times[t], k)
                            near[i], marks[i], scores[i] = (np.repeat(y, often).tolist() for y in (of.ids[t], of.marks[t], s))
                more = [pa.array(least), pa.array(lists, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], ["id", "v", "dim", "least", "lists", "near", "marks", "scores"])

    return asked.mapInArrow(run, "id long, v array<double>, dim int, least double, lists array<int>, near array<long>, marks array<long>, scores array<double>")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which is_query holds."""
    base = vectors.where(valid(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.withColumns({"dim": F.size("v"), "mark": F.xxhash64("v")})
    models = _models(base)
    index = _index(base, models)
    stats = staged(index.groupBy("dim", "list").agg(F.count("*").alias("n"), F.max("far").alias("far")), "lists")
    far = {dim: np.full(len(m.centres), -np.inf) for dim, m in models.items()}
    for r in stats.where("list >= 0").collect():  # at most LISTS rows for each of LENGTHS lengths
        far[r["dim"]][r["list"]] = r["far"]
    asked = base.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    sent = staged(_probes(asked, models, far, k), "probes")
    probes = sent.select("id", "v", "dim", "least", F.explode("lists").alias("list"))

    blocks = stats.select("dim", "list", F.ceil(F.col("n") / VECTORS).cast("int").alias("v_blocks")).join(probes.groupBy("dim", "list").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("q_blocks")), ["dim", "list"])
    blocks = staged(blocks, "blocks")
    keys = ["dim", "list", "vb", "qb"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    left = index.drop("far").join(blocks, ["dim", "list"]).withColumn("vb", dealt("v_blocks", "id", "v")).withColumn("qb", every("q_blocks")).drop("v_blocks", "q_blocks")
    right = probes.join(blocks, ["dim", "list"]).withColumn("qb", dealt("q_blocks", "v", "id")).withColumn("vb", every("v_blocks")).drop("v_blocks", "q_blocks")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "mark": np.zeros(0, np.int64), "score": np.zeros(0)})
        a = a.sort_values("id", kind="stable")
        # of equal vectors only the k + 1 smallest ids can be among the nearest
        a = a[a["v"].map(lambda x: x.tobytes()).groupby(a["v"].map(lambda x: x.tobytes()), sort=False).cumcount().to_numpy() <= k]
        rows = np.stack(a["v"].to_numpy())
        packed = (np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1), a["norm"].to_numpy(), a["along"].to_numpy())
        turn, ids, marks, found = rotations(rows.shape[1]), a["id"].to_numpy(np.int64), a["mark"].to_numpy(np.int64), []
        queries, query_ids, least = np.stack(b["v"].to_numpy()), b["id"].to_numpy(np.int64), b["least"].to_numpy()
        for at in range(0, len(b), 256):
            to = slice(at, at + 256)
            q, v, s = nearest_in_block(rows, ids, packed, queries[to], query_ids[to], least[to], turn, k)
            found.append((query_ids[at + q], v, s))
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": ids[v], "mark": marks[v], "score": s})

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, mark long, score double")
    # the sample's vectors count where their list was not asked; one id may have several vectors, and a row may occur often
    known = sent.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "marks", "scores")).alias("s")).select("query_id", F.col("s.near").alias("vec_id"), F.col("s.marks").alias("mark"), F.col("s.scores").alias("score"))
    both = near.withColumn("again", F.lit(0)).unionByName(known.withColumn("again", F.lit(1)))
    near = both.withColumn("first", F.min("again").over(Window.partitionBy("query_id", "vec_id", "mark"))).where(F.col("again") == F.col("first")).drop("again", "first", "mark")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
