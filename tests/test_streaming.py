"""Streams over the shared events against loops over the same rows."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from millrace.operators.graph import shared_folder
from millrace.plans import QUERIES, models
from millrace.streaming import jobs

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def measurements():
    e = pd.read_parquet(f"{DATA}/events.parquet")
    return pd.DataFrame({"id": e["event_id"], "equipment_id": (e["user_id"] % 10).astype(str), "param_id": e["event_type"], "us": e["ts"].astype("datetime64[us]").astype("int64"), "value": e["value"]}).sort_values(["us", "id"])


def test_ensemble_stream_is_a_loop_over_windows(spark, measurements):
    """All four detectors, with windows of six hours so that they hold several rows."""
    width = 6 * 3600
    got = jobs.run_now(jobs.ensemble_stream(models._stream(spark, DATA).where("equipment_id = 3"), width)).toPandas()
    assert len(got) and not got.duplicated(["window_start", "equipment_id", "param_id"]).any()
    for (equipment, param), mine in got.groupby(["equipment_id", "param_id"]):
        rows = measurements[(measurements["equipment_id"] == equipment) & (measurements["param_id"] == param)]
        g = rows.groupby(rows["us"] // (width * 10**6) * width * 10**6)["value"]
        one = pd.DataFrame({"us": (rows["us"] // (width * 10**6) * width * 10**6).astype(float), "n": 1.0, "m": rows["value"], "q": 0.0, "lo": rows["value"], "hi": rows["value"]})
        w = jobs.merged_windows(one)
        x, begins = np.column_stack([w["m"], np.sqrt(w["q"] / w["n"]), w["hi"] - w["lo"]]), w["us"].astype("int64").tolist()
        assert np.allclose(x, np.column_stack([g.mean(), g.std(ddof=0), g.max() - g.min()])) and begins == g.mean().index.tolist()
        out, _ = jobs.score_windows(x, begins, jobs.Memory(), 1000, 20, 100, 20, 0.5, 50, 64, 86_400 * 10**6)
        mine = mine.sort_values("window_start")
        n = len(mine)
        assert n >= len(x) - 2  # the newest windows are still open
        assert mine["window_start"].astype("datetime64[us]").astype("int64").tolist() == begins[:n]
        # sums in another order may turn a score that equals its limit
        same = (mine["votes"].to_numpy() == [v for _, v in out[:n]]) & np.isclose(mine["score"], [s for s, _ in out[:n]], atol=1e-6)
        assert same.mean() > 0.97, (equipment, param, same.mean())


def test_upsert_stream_keeps_the_newest(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet").sort_values("ts").groupby("user_id")["value"].last()
    got = QUERIES["upsert_stream"](spark, DATA).toPandas().set_index("user_id")["value"].sort_index()
    assert got.to_dict() == e.to_dict()


def test_rules_of_all_rows_are_those_of_each():
    rng = np.random.default_rng(4)
    for v in (rng.normal(50, 30, 400), rng.integers(40, 60, 300).astype(float), np.arange(30.0), np.tile([10.0, 90.0], 20), rng.normal(50, 3, 60)):
        center, sigma = rng.choice([45.0, 50.0, 55.0], len(v)), rng.choice([10.0, 0.0, np.nan], len(v))
        ucl, lcl = center + 30, center - 30
        for first in (0, 7, len(v) - 1):
            got = jobs.rules_of_rows(v, first, *(x[first:] for x in (ucl, lcl, center, sigma)))
            want = [",".join(jobs.rules_at_end(v[max(0, i - 24) : i + 1], ucl[i], lcl[i], center[i], sigma[i])) for i in range(first, len(v))]
            assert got.tolist() == want


@pytest.fixture(scope="module")
def in_files(spark):
    """The measurements of two machines as a stream of six files, one a micro-batch."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{DATA}/events.parquet").where("user_id % 10 IN (2, 5)").orderBy("ts").toPandas()
    for part in np.array_split(np.arange(len(rows)), 6):
        spark.createDataFrame(rows.iloc[part], spark.read.parquet(f"{DATA}/events.parquet").schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)

    def stream(limits: bool = True):
        e = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
        base = e.select(F.col("event_id").alias("measurement_id"), (F.col("user_id") % 10).cast("string").alias("equipment_id"), F.col("event_type").alias("param_id"), F.col("ts").alias("time"), "value", *[F.lit(x).alias(c) for c, x in (("usl", 150.0), ("lsl", 0.0), ("ucl", 200.0), ("lcl", -100.0), ("center", 50.0), ("sigma", 50.0))])
        return jobs.with_event_time(base.withColumn("status", F.when(F.col("value") > 60, "ALARM").otherwise("NORMAL")))

    return stream, rows


def test_charts_in_batches(in_files):
    stream, rows = in_files
    got = jobs.run_now(jobs.spc_stream(stream())).toPandas().set_index("measurement_id")
    assert got["batch_id"].nunique() == 6 and len(got) == len(rows)
    rows = rows.sort_values(["ts", "event_id"])
    for _, g in rows.groupby([rows["user_id"] % 10, "event_type"]):
        v = g["value"].to_numpy()
        mine = got.loc[g["event_id"]]
        want = [",".join(jobs.rules_at_end(v[max(0, i - 24) : i + 1], 200.0, -100.0, 50.0, 50.0)) for i in range(len(v))]
        assert mine["rules"].tolist() == want
        assert np.allclose(mine["x_bar"], g["value"].rolling(25, 1).mean()) and np.allclose(mine["std_dev"].iloc[1:], g["value"].rolling(25, 1).std().iloc[1:])


def test_patterns_in_batches(in_files):
    stream, rows = in_files
    seconds = 2 * 86_400
    got = jobs.run_now(jobs.cep_stream(stream(), 3, seconds)).toPandas()
    rows = rows[rows["value"] > 60].sort_values(["ts", "event_id"])
    want = {}
    for _, g in rows.groupby([rows["user_id"] % 10, "event_type"]):
        us = g["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        points = np.searchsorted(us, us, "right") - np.searchsorted(us, us - seconds * 10**6, "left")
        want |= {f"CEP-THRESHOLD_BREACH-{i}": int(n) for i, n in zip(g["event_id"], points, strict=True) if n >= 3}
    assert want and dict(zip(got["alert_id"], got["points"], strict=True)) == want and got["batch_id"].nunique() > 1


class FakeState:
    def __init__(self):
        self.held, self.writes = {}, []

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, k, v):
        self.held[k] = v
        self.writes.append(len(v[0]))

    def removeKey(self, k):
        del self.held[k]


def test_a_batch_writes_the_buckets_it_touches():
    find = lambda rows, lo, hi: (hi - lo >= 3, np.full(len(lo), "MAJOR", object), np.ones(len(lo)))
    p = jobs.Trailing("X", ["us", "id"], ["bigint", "bigint"], 3600, find)
    p.buckets, p.newest, p.seen = FakeState(), FakeState(), lambda us: None
    us = np.arange(0, 3600, 2) * 10**6
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"us": us, "id": np.arange(len(us))})]), None))
    held = sum(p.buckets.writes)
    assert held == len(us)
    p.buckets.writes.clear()
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"us": [3601 * 10**6], "id": [5000]})]), None))
    assert sum(p.buckets.writes) < held / 10
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"us": [90_000 * 10**6], "id": [5001]})]), None))
    assert len(p.buckets.held) == 1  # nothing that no window reaches stays
