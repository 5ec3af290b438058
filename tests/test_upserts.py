"""Bucketed upserts: the same table as a plain loop, also when a batch comes again, at a cost that follows the batch."""

from __future__ import annotations

import os
import random
import uuid

from millrace.operators.graph import shared_folder
from millrace.sources import upserts

SCHEMA = "k long, seen long, value double, note string"


def apply(table, batch):
    newest = {}
    for k, seen, value, note in batch:
        if k not in newest or (seen or -1) > (newest[k][0] or -1):
            newest[k] = (seen, value, note)
    for k, (seen, value, note) in newest.items():
        table[k] = (seen, value, table[k][2] if k in table else note)


def test_upserts_are_a_loop(spark):
    path, rng, table = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}", random.Random(3), {}
    clock = 0
    read = lambda: {r[0]: tuple(r)[1:] for r in upserts.read_upserts(spark, path, batch.schema, ["k"], ["seen", "value"]).collect()}
    for i in range(9):
        rows = []
        for _ in range(rng.choice([0, 1, 40])):
            clock += 1
            rows.append((rng.choice([None, *range(25)]), clock, rng.random(), f"batch {i}"))
        batch = spark.createDataFrame(rows, SCHEMA)
        upserts.upsert(batch, i, path, ["k"], ["seen", "value"], "seen", buckets=4, most=3)
        apply(table, rows)
        assert read() == table
        if i in (4, 8):  # the driver died before it noted the batch: it comes again
            upserts.upsert(batch, i, path, ["k"], ["seen", "value"], "seen", buckets=4, most=3)
            assert read() == table
    live = upserts.live(spark, path, 8)
    assert max(map(len, live.values())) <= 4 and upserts.commits(spark, path) == [7, 8]
    there = {(int(b.name[7:]), int(d.name[6:])) for d in os.scandir(f"{path.removeprefix('file:')}/pieces") for b in os.scandir(d) if b.name.startswith("bucket=")}
    needed = {(b, p) for c in (7, 8) for b, ps in upserts.live(spark, path, c).items() for p in ps}
    assert needed <= there and len(there - needed) <= 4  # old pieces are deleted


def test_a_small_batch_writes_little(spark):
    path = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    first = spark.range(20_000).selectExpr("id AS k", "id AS seen", "rand(1) AS value", "'x' AS note")
    upserts.upsert(first, 0, path, ["k"], ["seen", "value"], "seen")
    one = spark.createDataFrame([(7, 10**6, 0.5, "y")], SCHEMA)
    upserts.upsert(one, 1, path, ["k"], ["seen", "value"], "seen")
    assert spark.read.parquet(f"{path}/pieces/batch=1").count() == 1
    table = upserts.read_upserts(spark, path, first.schema, ["k"], ["seen", "value"])
    assert table.count() == 20_000 and tuple(table.where("k = 7").first()) == (7, 10**6, 0.5, "x")


def test_empty_tables(spark):
    path = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], SCHEMA)
    assert upserts.read_upserts(spark, path, none.schema, ["k"], ["value"]).count() == 0
    upserts.upsert(none, 0, path, ["k"], ["value"], "seen")
    assert upserts.read_upserts(spark, path, none.schema, ["k"], ["value"]).count() == 0
