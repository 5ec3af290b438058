"""Operators on dense and long tables against plain loops."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import cep, discovery, features, joins


def table(spark, rows, schema="measurement_id long, equipment_id string, us long, event_type string"):
    return spark.createDataFrame(rows, schema).withColumn("time", F.timestamp_micros("us")).drop("us")


def dense(seed: int, n: int, step: float) -> list[tuple]:
    """Events of three keys (one of them null) without a gap, several at one time."""
    rng = np.random.default_rng(seed)
    us = (np.cumsum(rng.exponential(step, n)) * 10).astype(np.int64) * 100_000 - 10**9
    return [(i, [None, "a", "b"][int(k)], int(u), "xyz"[int(t)]) for i, (u, k, t) in enumerate(zip(us, rng.integers(0, 3, n), rng.integers(0, 3, n), strict=True))]


def greedy(rows: list[tuple], width: int) -> dict[tuple, list[str]]:
    out, start = {}, {}
    for _, key, us, kind in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in start or us - start[key] > width:
            start[key] = us
        out.setdefault("@".join([*([key] if key else []), str(start[key])]), []).append(kind)
    return {k: v for k, v in out.items() if len(v) > 1}


@pytest.mark.parametrize("n,step", [(4000, 0.7), (300, 90.0), (40, 2000.0)])
def test_windows_of_a_key_without_gaps(spark, n, step):
    """A key without a gap was one array, copied for each of its windows."""
    rows = dense(n, n, step)
    found = discovery.sequences_by_window(table(spark, rows), 20)
    assert {r["sequence_id"]: [e["type"] for e in r["events"]] for r in found.collect()} == greedy(rows, 20_000_000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_rules_of_dense_keys(spark):
    """Sequences were built anew for each count."""
    rows = dense(5, 2000, 0.7)
    got = discovery.association_rules(discovery.sequences_by_window(table(spark, rows), 3), 0.0, 0.0)
    sets = [set(v) for v in greedy(rows, 3_000_000).values()]
    want = {(a, b): (sum({a, b} <= s for s in sets), sum({a, b} <= s for s in sets) / sum(a in s for s in sets)) for a in "xyz" for b in "xyz" if a != b}
    assert {(r["antecedent"], r["consequent"]): (r["count"], pytest.approx(r["confidence"])) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def holes(spark, n: int):
    rng = np.random.default_rng(n)
    rows = [(i, "ab"[i % 2], i * 1_000_000, "x", None if rng.random() < 0.4 else float(rng.integers(0, 90))) for i in range(n)]
    return rows, table(spark, rows, "measurement_id long, equipment_id string, us long, event_type string, value double")


def frames(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("how", ["interpolate", "bfill"])
def test_filling_grows_its_frames(spark, how):
    """Frames that reach to a key's end are gone through again for each row."""
    rows, df = holes(spark, 400)
    out = features.fill_missing(df, ["value"], ["equipment_id"], how)
    got = {r["measurement_id"]: r["value"] for r in out.collect()}
    for k in "ab":
        ids = [r[0] for r in rows if r[1] == k]
        v = np.array([np.nan if r[4] is None else r[4] for r in rows if r[1] == k])
        known = np.flatnonzero(~np.isnan(v))
        if how == "interpolate":
            want = np.interp(np.arange(len(v)), known, v[known])
        else:
            want = [v[known[min(np.searchsorted(known, i), len(known) - 1)]] for i in range(len(v))]
        assert [got[i] for i in ids] == pytest.approx(list(want))
    assert out.columns == df.columns and "unboundedfollowing" not in frames(out)


def test_outliers_are_filled_in_growing_frames(spark):
    rows, df = holes(spark, 300)
    out = features.remove_outliers(df, ["value"], ["equipment_id"], 1.0)
    got = {r["measurement_id"]: r["value"] for r in out.collect()}
    v = np.array([np.nan if r[4] is None else r[4] for r in rows if r[1] == "a"])
    v[np.abs(v - np.nanmean(v)) > np.nanstd(v, ddof=1)] = np.nan
    known = np.flatnonzero(~np.isnan(v))
    assert [got[i] for i in range(0, 300, 2)] == pytest.approx(list(np.interp(np.arange(len(v)), known, v[known])))
    assert frames(out).count("unboundedfollowing") == frames(df.withColumn("m", F.avg("value").over(Window.partitionBy("equipment_id")))).count("unboundedfollowing") * 2


def test_patterns_before_a_target_are_those_of_gathered_lookbacks(spark):
    """Lookbacks were gathered for every event, and held more events the denser these are."""
    rows = dense(8, 900, 0.7) + dense(9, 30, 500.0)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    width = 4_000_000
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    lookbacks = [w for t in rows if t[3] == "x" if len(w := [r for r in order if r[1] == t[1] and t[2] - width <= r[2] <= t[2]]) > 1]
    events = [{"us": r[2], "type": r[3]} for w in lookbacks for r in w]
    ends = np.cumsum([len(w) for w in lookbacks]).tolist()
    seqs = spark.createDataFrame([(str(b), events[a:b]) for a, b in zip([0, *ends], ends)], "sequence_id string, events array<struct<us: long, type: string>>")
    want = discovery.sequential_patterns(seqs, 4).where("pattern LIKE '%x'").collect()
    out = discovery.root_cause_patterns(table(spark, rows), "x", 4, 4)
    assert {r["pattern"]: pytest.approx(tuple(r)[1:]) for r in want} == {r["pattern"]: tuple(r)[1:] for r in out.collect()} and len(want) > 20
    assert discovery.root_cause_patterns(table(spark, rows), "none", 4, 4).count() == 0
    assert "windowspec" not in frames(out)


def test_next_failure_in_a_growing_frame(spark):
    """The frame of the next hours was gone through again for each row."""
    rows = dense(11, 900, 60.0)
    df = table(spark, rows).withColumn("failure", (F.col("event_type") == "x").cast("int"))
    out = joins.label_failure_horizon(df, 1)
    hour = 3_600_000_000
    want = {i: int(any(k == k2 and t == "x" and us < u2 <= us + hour for _, k2, u2, t in rows)) for i, k, us, _ in rows}
    assert {r["measurement_id"]: r["label"] for r in out.collect()} == want and set(want.values()) == {0, 1}
    assert "unboundedpreceding$(), -1" in frames(out)


def test_failure_rows_are_written_before_a_fit(spark):
    """Each pass of a fit sorted all rows again."""
    from millrace.plans import QUERIES, models

    x = models._failures(spark, "/root/testdata/sf0.01")
    assert "windowspec" not in frames(x) and {"measurement_id", "label", *models.FAILURE_COLS} <= set(x.columns)
    assert QUERIES["score_failure"](spark, "/root/testdata/sf0.01").count() == x.count()


def test_boosted_trees_read_written_rows(spark, monkeypatch):
    from millrace.operators import predict
    from millrace.plans import QUERIES

    seen, fit = [], predict.train_failure_model
    monkeypatch.setattr(predict, "train_failure_model", lambda df, *a, **k: seen.append(frames(df)) or fit(df, *a, **k))
    assert QUERIES["train_failure_model"](spark, "/root/testdata/sf0.01").count() == 6
    assert len(seen) == 1 and "windowspec" not in seen[0]


def test_peaks_as_high_as_the_mean():
    """Means were added up pairwise, which decides differently on a peak of exactly that height."""
    x, width = np.round(np.random.default_rng(3).integers(0, 30, 20_000) / 10 + 0.1, 2), 30
    got = features.peaks(x, width)
    for i in range(len(x)):
        w = x[max(0, i - width + 1) : i + 1]
        high = (w[1:-1] > w[:-2]) & (w[1:-1] > w[2:]) & (w[1:-1] >= np.cumsum(w)[-1] / len(w))
        assert got[i, 0] == high.sum()


def test_ranking_without_a_varying_label_is_that_of_sql(spark, tmp_path):
    """In dense hours no label is 1: SQL has no correlation then, the query had zeros."""
    from millrace.plans import QUERIES, SQL, views
    from tests.compare import rows_of, rows_of_sql

    for name, n in (("none", 0), ("one", 1), ("many", 30)):
        (tmp_path / name).mkdir()
        duckdb.sql(f"COPY (SELECT h * 5 + i AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INTEGER)) AS ts, h AS user_id, ({views.PARAMS})[i + 1] AS event_type, CAST(h + i AS DOUBLE) AS value FROM range({n}) a(h), range(5) b(i)) TO '{tmp_path / name}/events.parquet'")
        assert rows_of(QUERIES["feature_ranking"](spark, str(tmp_path / name))) == rows_of_sql(SQL["feature_ranking"], str(tmp_path / name))


def test_deleted_lots_stay_out_with_many_parts(spark, tmp_path):
    """Updates of parts beyond 1,000,000 came after the deletes."""
    from millrace.plans import QUERIES, SQL
    from tests.compare import rows_of, rows_of_sql

    duckdb.sql(f"COPY (SELECT i AS o_orderkey, 'F' AS o_orderstatus, 1e0 AS o_totalprice FROM range(40) t(i)) TO '{tmp_path}/orders.parquet'")
    duckdb.sql(f"COPY (SELECT i % 40 AS l_orderkey, CAST(i % 7 + 1 AS INTEGER) AS l_linenumber, 1e0 AS l_quantity, 900000 + i * 3000 AS l_partkey, i AS l_suppkey FROM range(100) t(i)) TO '{tmp_path}/lineitem.parquet'")
    got = rows_of(QUERIES["cdc_latest_state"](spark, str(tmp_path)))
    assert got == rows_of_sql(SQL["cdc_latest_state"], str(tmp_path)) and len(got[1]) == 36


def test_drift_by_places_in_running_sums(spark):
    """Windows were gone through again for each row; a window without spread, or one with a value that is not finite, has no drift."""
    rows = dense(12, 3000, 0.7)
    rng = np.random.default_rng(4)
    value = np.where(np.arange(3000) < 900, 1e6 + 0.1, np.round(rng.normal(0, 1, 3000), 2) + (np.arange(3000) // 150 % 2))
    value[2500] = np.inf
    df = table(spark, [(*r[:3], "p", float(v)) for r, v in zip(rows, value, strict=True)], "measurement_id long, equipment_id string, us long, param_id string, value double")
    out = cep.cep_drift(df, 12, 0.9)
    want = {}
    for i, key, us, _ in rows:
        w = np.array([value[r[0]] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == key and us - 12_000_000 <= r[2] <= us])
        if len(w) > 10 and np.isfinite(w).all() and w.min() < w.max():
            far = abs(w[len(w) // 2 :].mean() - w[: len(w) // 2].mean()) / w.std(ddof=1)
            if far >= 0.9:
                want[str(i)] = (pytest.approx(min(1, far / 4)), str(len(w)))
    assert {r["related_ids"][0]: (r["confidence"], r["context"]["count"]) for r in out.collect()} == want and len(want) > 10
    assert "windowspec" not in frames(out)


def test_counts_of_windows_by_what_enters_and_leaves(spark):
    rows = dense(13, 1500, 0.7)
    df = table(spark, rows).withColumnsRenamed({"measurement_id": "alarm_id", "event_type": "alarm_code"}).withColumn("alarm_code", F.when(F.col("alarm_code") != "z", F.col("alarm_code")))
    out = cep.cep_consecutive_alarms(df.withColumn("alarm_code", F.when(F.col("alarm_id") % 9 == 0, "w").otherwise(F.col("alarm_code"))), 5, 6)
    want = {}
    for i, key, us, _ in rows:
        w = [r for r in rows if r[1] == key and us - 6_000_000 <= r[2] <= us]
        codes = {"w" if r[0] % 9 == 0 else r[3] for r in w} - {"z"}
        if len(w) >= 5:
            want[f"CEP-CONSECUTIVE_ALARMS-{i}"] = (str(len(w)), str(len(codes)), "CRITICAL" if len(codes) > 2 else "MAJOR", sorted(str(r[0]) for r in w))
    got = {r["alert_id"]: (r["context"]["count"], r["context"]["codes"], r["severity"], sorted(r["related_ids"])) for r in out.collect()}
    assert got == want and {"2", "3"} <= {w[1] for w in want.values()}
    status = df.select(F.col("alarm_id").alias("measurement_id"), "equipment_id", "time", F.lit("p").alias("param_id"), F.lit("ALARM").alias("status"))
    for alerts in (out, cep.cep_threshold(status, 5, 6)):
        assert alerts.count() == len(want) and "rangeframe, -" not in frames(alerts.drop("related_ids"))


def test_pairs_of_alarms_and_lots_are_not_shuffled(spark):
    """All pairs went through an exchange to be told apart; repeated starts, alarm ids and whole rows give each pair once."""
    rng = np.random.default_rng(6)
    alarms = [(int(i) % 150, "ab"[int(k)], ["MAJOR", "INFO"][int(v)], int(t) * 500_000) for i, (k, v, t) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 2, 200), rng.integers(0, 400, 200), strict=True))]
    steps = [(str(lot), "ab"[int(k)], int(t) * 500_000) for lot, k, t in zip(rng.integers(0, 20, 300), rng.integers(0, 2, 300), rng.integers(0, 400, 300), strict=True)]
    a = spark.createDataFrame(alarms + alarms[:20], "alarm_id long, equipment_id string, severity string, us long").withColumn("time", F.timestamp_micros("us"))
    s = spark.createDataFrame(steps + steps[:20], "lot_id string, equipment_id string, us long").withColumn("start_time", F.timestamp_micros("us"))
    for seconds in (7, 60):
        out = joins.alarm_lot_impact(a, s, seconds)
        want = {(i, lot, "HIGH" if v == "MAJOR" else "LOW") for i, e, v, t in alarms for lot, e2, u in steps if e == e2 and t - seconds * 1_000_000 < u <= t}
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    once = joins.alarm_lot_impact(a.where("alarm_id >= 50").dropDuplicates(["alarm_id"]), s, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert once.startswith("Union")


def test_short_routes_go_before_chains(spark, monkeypatch):
    """Routes without a way back were shrunk as chains, by joins of all their nodes in each round; ends of edges were looked up for each edge."""
    from millrace.operators import graph

    route = [("S", f"{r}-{i}", "NEXT_STEP", "S", f"{r}-{i + 1}") for r in range(50) for i in range(1, r % 7 + 1)]
    ring = [("S", "9-1", "NEXT_STEP", "S", "9-0"), ("S", "9-0", "NEXT_STEP", "S", "9-1")]
    other = [("X", "u", "MAKES", "S", "1-1"), ("X", "u", "MAKES", "Y", None), ("S", "1-1", "MAKES", "Y", None)]
    nodes = spark.createDataFrame([("S", f"{r}-{i}") for r in range(50) for i in range(0, 9)], "label string, id string")
    seen, chains = [], graph._chains
    monkeypatch.setattr(graph, "_chains", lambda e, c: seen.append(c.count()) or chains(e, c))
    edge = "src_label string, src_id string, type string, dst_label string, dst_id string"
    got = sorted(tuple(r) for r in graph.check_link_constraints(nodes, spark.createDataFrame(route + ring + other, edge)).collect())
    assert got == sorted([("cycle", "9-0", 1), ("cycle", "9-1", 1), ("unknown_src", "X|u", 2), ("unknown_dst", "Y", 2)]) and sum(seen) <= 2
