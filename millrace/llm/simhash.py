"""SimHash near-duplicates through covering locality-sensitive hashing.

Each bit position gets a nonzero vector of radius + 1 bits; table v (any nonzero vector) looks at the
positions whose vector has an odd product with v. The vectors of at most `radius` differing positions
leave some v orthogonal to all of them, so every pair within the radius agrees in that table: no pair
is lost, and no probability is involved.

Work is done once for each distinct fingerprint, so groups of copies of any size cost one row. Of a
bucket, only a spanning forest of its links leaves a task. A bucket above `big` fingerprints is split
again by covering masks over the bits that its table left free; after that at most about 2^17
fingerprints can share a bucket, whatever the data. Tables with one row for each component or node are
written before they are joined back, so that Spark can split a component that holds most rows.

Null text: no words, fingerprint zero. Repeated rows: each gets the same component. Null doc_id: the
row takes part; a component's id is null only if none of its rows has an id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, signed, small_batches, staged

RADIUS = 4
SHINGLE = 4
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8 as an unsigned integer."""
    from xxhash import xxh64_intdigest

    ws = text.lower().split()  # of bytes: A-Z alone, and exactly the six white-space bytes
    if not ws:
        return 0
    joined, n = b" ".join(ws), len(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    spans = zip(begins[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return majority(np.fromiter((xxh64_intdigest(joined[x:y], SEED) for x, y in spans), np.uint64, n - k + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 25_500):
        bits = np.unpackbits(hashes[at : at + 25_500].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, salt (a hash of id and text) and fp (the fingerprint's bits as a long), a row for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "salt", "fp"])

    of = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("salt"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, f"doc_id {of.schema['doc_id'].dataType.simpleString()}, salt long, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions: any two numbers that differ in at most `radius` of them agree under some mask."""
    n = (1 << (radius + 1)) - 1
    vectors = {b: 1 + i % n for i, b in enumerate(bits)}
    return [sum(1 << b for b, u in vectors.items() if (u & v).bit_count() % 2) for v in range(1, n + 1)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(smallest of its group, fingerprint) for links within the radius inside one bucket, smallest first."""
    found, left = [], np.sort(fps)
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = [root]
        while edge and len(left):
            near = np.bitwise_count(left ^ edge.pop()) <= radius
            if near.any():
                new, left = left[near], left[~near]
                found += [(int(root), int(x)) for x in new]
                edge += list(new)
    return found


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) from rows (bucket columns..., fp); a bucket's rows meet in one task, buckets of one task stream by."""
    keys = [c for c in buckets.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: np.ndarray | None = None  # the bucket that the next batch may continue

        def links(rows: np.ndarray, last: bool) -> tuple[list, np.ndarray]:
            cuts = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
            parts = np.split(rows[:, -1].view(np.uint64), cuts)
            rest = rows[cuts[-1] if len(cuts) else 0 :]
            return [e for p in (parts if last else parts[:-1]) for e in forest(p, radius)], rest

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if not len(rows):
                continue
            found, carry = links(rows if carry is None else np.concatenate([carry, rows]), False)
            yield _edges(found)
        if carry is not None:
            yield _edges(links(carry, True)[0])

    # all columns are longs, so that a batch is one matrix
    return buckets.repartition(*keys).sortWithinPartitions(*keys).select(*[F.col(c).cast("long").alias(c) for c in keys], "fp").mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, big: int = 2048) -> DataFrame:
    """Pairs (a, b) of fingerprints whose connected components are those of all pairs within the radius. distinct: one column fp, each once."""
    masks = covering_masks(list(range(64)), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "key"))
    # one shuffle of all tables' rows: what shares no bucket ends here
    shared = staged(keyed.withColumn("n", F.count("*").over(Window.partitionBy("t", "key"))).where("n > 1").select("t", "key", "fp", "n"), "buckets")
    small = _bucket_links(shared.where(F.col("n") <= big).select("t", "key", "fp"), radius)

    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    again = F.array(*[F.array(*[F.lit(signed(m | x)) for x in covering_masks(f, radius)]) for m, f in zip(masks, free, strict=True)])
    split = shared.where(F.col("n") > big).select("t", "fp", F.posexplode(F.get(again, F.col("t"))).alias("t2", "mask"))
    split = split.select("t", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return small.unionByName(_bucket_links(split, radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of edges (a, b), by alternating large and small stars."""
    pairs = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        before, pairs = pairs, staged(small.where("u <> v").distinct(), "links")
        discard(before, low)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        seen = now


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, salt, fp, root (of the component, a fingerprint) and component_id, a row for each row of docs."""
    rows = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    return rows.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to), a row for each row of docs."""
    return grouped(docs, radius, shingle).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The row of docs with the smallest doc_id of each component (of several texts with that id, one), with the columns of docs."""
    first = grouped(docs, radius, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    by_text = first.groupBy("root", "salt").agg(F.count("*").alias("n__"))
    chosen = by_text.groupBy("root").agg(F.min(F.struct("salt", "n__")).alias("s"))
    return rows_of_texts(docs, staged(chosen.select(F.col("s.salt").alias("salt__"), F.col("s.n__").alias("rows__")), "chosen")).select(*docs.columns)


def rows_of_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs, with key__ and chosen's other columns, for each row of chosen: salt__ (a hash of id and text) and rows__ (how often docs has it)."""
    # the text is dealt by that key at every size, so that what a run needs grows in proportion
    keyed = docs.withColumn("key__", F.xxhash64("doc_id", "text"))
    of = lambda cond: keyed.join(chosen.where(cond).drop("rows__").hint("shuffle_hash"), F.col("key__") == F.col("salt__")).drop("salt__")
    if chosen.where("rows__ > 1").isEmpty():
        return of("rows__ = 1")
    return of("rows__ = 1").unionByName(of("rows__ > 1").dropDuplicates(["key__"]))
