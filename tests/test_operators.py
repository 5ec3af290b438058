"""Hand-computed and planted cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as fn
from millrace.operators import anomaly, capability, cep, discovery, documents, features, graph, joins, normalize, predict, spc
from millrace.streaming import jobs
from millrace.streaming.jobs import rules_at_end


def series(spark, values, **extra):
    rows = [(i, i * 60_000_000, float(v) if v is not None else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "measurement_id long, us long, value double").select("measurement_id", F.timestamp_micros("us").alias("time"), "value", F.lit("e").alias("equipment_id"), F.lit("p").alias("param_id"))
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.mark.parametrize(("value", "usl", "lsl", "want"), [(205.0, 200.0, 100.0, "ALARM"), (95.0, 200.0, 100.0, "ALARM"), (110.0, 200.0, 100.0, "NORMAL"), (190.0, 200.0, 100.0, "NORMAL"), (191.0, 200.0, 100.0, "WARNING"), (1.0, 0.0, None, "ALARM"), (None, 1.0, 0.0, "NORMAL"), (0.0, 10.0, 1.0, "ALARM")])
def test_status(spark, value, usl, lsl, want):
    df = spark.createDataFrame([(value, usl, lsl)], "v double, u double, l double")
    assert df.select(fn.fdc_status(F.col("v"), F.col("u"), F.col("l"))).first()[0] == want


def test_timestamps(spark):
    df = spark.createDataFrame([("1704067200000",), ("1704067200",), ("2024-01-01T00:00:00Z",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(fn.normalize_timestamp(F.col("t")))).collect()]
    assert got == [1704067200, 1704067200, 1704067200, None, None]


def test_normal_cdf(spark):
    zs = [-4.0, -1.96, 0.0, 0.5, 3.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select(fn.normal_cdf("z"))
    for z, r in zip(zs, df.collect(), strict=True):
        assert r[0] == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=2e-7)


def test_zero_is_a_value(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame([(0.0, 5.0), (None, 0.0)], "VALUE double, value double")
    assert [r[0] for r in normalize.coalesce_aliases(df, {"VALUE": "double"}, ["VALUE"]).collect()] == [0.0, 0.0]
    spark.conf.unset("spark.sql.caseSensitive")


def test_change_log(spark):
    row = "struct<id:long,v:string>"
    rows = [(None, (1, "a"), "c", (1, "T")), (None, (1, "b"), "u", (3, "T")), (None, (1, "c"), "u", (2, "T")), (None, (2, "x"), "c", (1, "T")), ((2, "x"), None, "d", (5, "T")), (None, None, None, None)]
    log = spark.createDataFrame(rows, f"before {row}, after {row}, op string, source struct<ts_ms:long,table:string>")
    assert [tuple(r) for r in normalize.cdc_latest_state(normalize.cdc_unwrap(log), ["id"]).select("id", "v").collect()] == [(1, "b")]


@pytest.mark.parametrize(("values", "rule"), [([50] * 8 + [51] * 9, "RULE2_RUN_ABOVE"), (list(range(1, 7)), "RULE3_TREND_UP"), ([1, 2] * 7, "RULE4_ALTERNATING"), ([170, 0, 170], "RULE5_2OF3_ABOVE_2SIGMA"), ([60] * 15, "RULE7_STRATIFICATION"), ([120, -20] * 4, "RULE8_MIXTURE")])
def test_rules_fire_at_the_exact_length(spark, values, rule):
    df = series(spark, values, ucl=200.0, lcl=-100.0, center=50.0, sigma=50.0)
    last = {r["measurement_id"]: r["rule_violations"] for r in spc.western_electric(df, ["equipment_id"], "last").collect()}
    n = spc.RULES[rule]
    assert rule in last[len(values) - 1]
    assert all(rule not in last[i] for i in range(n - 1))
    every = {r["measurement_id"]: r["rule_violations"] for r in spc.western_electric(df, ["equipment_id"], "all").collect()}
    assert all(rule in every[i] for i in range(len(values) - n, len(values)))
    assert rule in rules_at_end(np.array(values, float), 200.0, -100.0, 50.0, 50.0)


def test_stream_rules_equal_window_rules(spark):
    values = np.random.default_rng(3).exponential(50, 300)
    df = series(spark, values.tolist(), ucl=200.0, lcl=-100.0, center=50.0, sigma=50.0)
    got = [r[0] for r in spc.western_electric(df, ["equipment_id"], "last").orderBy("measurement_id").select("rule_violations").collect()]
    assert got == [rules_at_end(values[max(0, i - 24) : i + 1], 200.0, -100.0, 50.0, 50.0) for i in range(300)]


def test_windows_of_an_ensemble():
    x = np.random.default_rng(5).normal(size=(120, 3))
    x[100] = 9.0
    us = [60_000_000 * i for i in range(120)]
    settings = dict(history=60, least=20, near=30, k=5, drift=0.5, trees=30, sample=16, refit=40 * 60_000_000)
    out, memory = jobs.score_windows(x, us, jobs.Memory(), **settings)
    assert out[:20] == [(0.0, 0)] * 20 and out[100] == (max(out)[0], 4) and memory.past.tolist() == x[-60:].tolist()
    # batches don't matter, and the forest is grown anew by event time
    first = jobs.score_windows(x[:70], us[:70], jobs.Memory(), **settings)
    then = jobs.score_windows(x[70:], us[70:], first[1], **settings)
    assert first[0] + then[0] == out and then[1][2:] == memory[2:] and then[1].scores.tolist() == memory.scores.tolist()
    assert first[1].grown == us[60] and memory.grown == us[100]
    # by a plain loop over the trees, for each window after the first forest
    forest = np.frombuffer(first[1].forest, np.float32).reshape(30, -1, 3)
    for row in x[60:70]:
        depth = 0.0
        for tree in forest:
            at = 0
            while tree[at, 0] >= 0:
                at = 2 * at + 1 + int(row[int(tree[at, 0])] >= tree[at, 1])
            depth += float(tree[at, 2])
        mean = 2 * (math.log(15) + 0.5772156649) - 2 * 15 / 16
        assert jobs.isolation_score(forest, row, 16) == pytest.approx(2 ** (-depth / 30 / mean), rel=1e-6) == pytest.approx(anomaly.forest_score(forest, row[None], 16)[0], rel=1e-6)
    # the factor, by definition
    p, q = x[:30], x[40]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + np.diag(np.full(30, np.inf))
    i = np.argsort(d, axis=1)[:, :5]
    kd = np.sort(d, axis=1)[:, 4]
    dense = 1 / np.maximum(kd[i], np.take_along_axis(d, i, axis=1)).mean(1)
    e = np.sqrt(((p - q) ** 2).sum(1))
    j = np.argsort(e)[:5]
    assert jobs.outlier_factor(q, p, 5) == pytest.approx(dense[j].mean() * np.maximum(kd[j], e[j]).mean())
    assert jobs.scaled_score(3.0, np.arange(5.0)) == 1.0 and jobs.scaled_score(1.0, np.ones(20)) == 0.5 and jobs.scaled_score(50.0, np.arange(101.0)) == pytest.approx(0.5)


def test_open_windows_merge():
    import pandas as pd

    v = np.random.default_rng(6).normal(50, 3, size=40)
    us = np.repeat([0.0, 60e6], 20)
    one = pd.DataFrame({"us": us, "n": 1.0, "m": v, "q": 0.0, "lo": v, "hi": v})
    for parts in (one, pd.concat([jobs.merged_windows(one[:13]), jobs.merged_windows(one[13:30]), one[30:]])):
        got = jobs.merged_windows(parts)
        assert got["n"].tolist() == [20, 20] and np.allclose(got["m"], [v[:20].mean(), v[20:].mean()]) and np.allclose(np.sqrt(got["q"] / got["n"]), [v[:20].std(), v[20:].std()]) and got["hi"].tolist() == [v[:20].max(), v[20:].max()]


def test_cusum_is_the_loop(spark):
    values = np.random.default_rng(1).normal(size=200)
    got = [r["score"] for r in anomaly.cusum(series(spark, values.tolist()), ["value"], ["equipment_id"]).orderBy("measurement_id").collect()]
    z, up, down = (values - values.mean()) / values.std(), 0.0, 0.0
    for x, g in zip(z, got, strict=True):
        up, down = max(0, up + x - 0.5), max(0, down - x - 0.5)
        assert g == pytest.approx(max(up, down), abs=1e-9)


def test_capability_without_spread(spark):
    row = capability.capability_indices(series(spark, [5, 5, 5], usl=10.0, lsl=0.0, target=None).withColumn("target", F.col("target").cast("double")), ["equipment_id"]).first()
    assert row["cp"] == 0 and row["cr"] == float("inf") and row["cpm"] is None and row["ppm_total"] == 0
    assert capability.capability_indices(series(spark, [5], usl=10.0, lsl=0.0, target=1.0), ["equipment_id"]).count() == 0


def test_threshold_needs_three(spark):
    df = series(spark, [210, 210], status="ALARM")
    assert cep.cep_threshold(df).count() == 0
    assert cep.cep_threshold(series(spark, [210] * 4, status="ALARM")).count() == 2
    assert cep.cep_drift(series(spark, range(10))).count() == 0
    assert cep.cep_drift(series(spark, [0] * 30), 6000).count() == 0


def test_asof_ttl(spark):
    dim = spark.createDataFrame([("e", 0, "old"), ("e", 10, "new")], "equipment_id string, s long, name string").select("equipment_id", F.timestamp_seconds("s").alias("time"), "name")
    meas = spark.createDataFrame([("e", 5), ("e", 10), ("e", 75), ("x", 5)], "equipment_id string, s long").select("equipment_id", F.timestamp_seconds("s").alias("time"), "s")
    got = {(r["equipment_id"], r["s"]): r["name"] for r in joins.enrich_asof(meas, dim, "equipment_id", "time", ["name"], 60).collect()}
    assert got == {("e", 5): "old", ("e", 10): "new", ("e", 75): None, ("x", 5): None}


def test_lead_is_the_source(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=1000)
    y = np.concatenate([np.zeros(5), x[:-5]]) + 0.1 * rng.normal(size=1000)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "time long, x double, y double")
    r = discovery.cross_correlation(df, ["x", "y"], 20).first()
    assert (r["source"], r["target"], r["lag"]) == ("x", "y", 5)
    g = {(r["source"], r["target"]): r for r in discovery.granger(df, ["x", "y"], 6).collect()}
    assert g["x", "y"]["is_causal"] and g["x", "y"]["lag"] >= 5 and g["x", "y"]["p_value"] < g["y", "x"]["p_value"]
    te = {(r["source"], r["target"]): r["te"] for r in discovery.transfer_entropy(df, ["x", "y"], 6, 5, 20).collect()}
    assert te["x", "y"] > 3 * te["y", "x"]


def test_lags_do_not_depend_on_stretches(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=103)
    y = np.concatenate([rng.normal(size=4), x[:-4]]) + rng.normal(0, 0.1, 103)
    rows = [(i, float(a), float(b) if i != 50 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "time long, x double, y double")
    for size in (10, 65_536):
        got = sorted(tuple(r) for r in discovery.lagged(df, ["x", "y"], 3, size=size).collect())
        assert len(got) == 103 and all(r[0] == i + 1 and list(r[1:5]) == [float(x[i - k]) if i >= k else None for k in range(4)] for i, r in enumerate(got))
        (r,) = discovery.cross_correlation(df, ["x", "y"], 10, size=size).collect()
        p, q = np.delete(x, 50), np.delete(y, 50)
        norm = math.sqrt(((p - p.mean()) ** 2).sum() * ((q - q.mean()) ** 2).sum())
        want = sum((x[i - 4] - p.mean()) * (y[i] - q.mean()) for i in range(4, 103) if i != 50) / norm
        assert (r["source"], r["target"], r["lag"], r["n"]) == ("x", "y", 4, 102) and r["r"] == pytest.approx(want)
    assert discovery.cross_correlation(df.where("false"), ["x", "y"], 10).count() == 0 and discovery.lagged(df.where("false"), ["x", "y"], 3).count() == 0


def test_p_values():
    assert anomaly.t_p_value(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert anomaly.f_p_value(4.965, 1, 10) == pytest.approx(0.05, abs=2e-4)


@pytest.mark.parametrize("cell", [7, 4096])
def test_lof_over_all_rows(spark, cell):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(100, 2)), [[8.0, 8.0]], np.repeat([[1.0, 1.0]], 30, axis=0), rng.normal(5, 0.1, size=(20, 2))])
    rows = [(i, "k", float(a), float(b)) for i, (a, b) in enumerate(x)]
    rows += [(1000, "one", 1.0, 1.0), (1001, "few", 1.0, 1.0), (1002, "few", 2.0, 1.0), (1003, "few", 3.0, 1.0), (1004, "k", None, 1.0), (1005, "k", float("nan"), 1.0), (1006, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "measurement_id long, key string, a double, b double")
    got = {r["measurement_id"]: r for r in anomaly.lof(df, ["a", "b"], "key", k=10, cell=cell).collect()}
    assert len(got) == len(rows) and got[100]["lof"] > 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(len(x), np.inf))
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    dk = np.take_along_axis(d, near, axis=1)
    dense = 1 / np.maximum(np.maximum(dk.max(1)[near], dk).mean(1), 1e-10)
    assert [got[i]["lof"] for i in range(len(x))] == pytest.approx((dense[near].mean(1) / dense).tolist(), rel=1e-9)
    assert got[1000]["lof"] == 1.0 and got[1002]["lof"] == pytest.approx(4 / 3) and all(got[i]["lof"] is None and not got[i]["is_anomaly"] for i in (1004, 1005, 1006))
    assert anomaly.lof(df.where("false"), ["a", "b"], "key").count() == 0


def test_forest_finds_the_outlier():
    x = np.concatenate([np.random.default_rng(0).normal(size=(100, 2)), [[8.0, 8.0]]])
    f = anomaly.grow_forest(x)
    assert anomaly.forest_score(f, x, 101).argmax() == 100


def test_trees_draw_from_more_than_one_sample(spark, monkeypatch):
    kept, sampled = [], anomaly.sampled

    def watched(*args):
        out = sampled(*args)
        kept.append(out.count())
        return out

    monkeypatch.setattr(anomaly, "sampled", watched)
    anomaly.isolation_forest(series(spark, range(2000)), ["value"], "param_id", least=100, trees=20, sample=8)
    assert kept == [160]
    x = np.arange(2000.0)[:, None]
    assert len(np.unique(anomaly.grow_forest(x, 20, 8)[:, 0, 1])) == 20


def test_interpolation(spark):
    got = [r[0] for r in features.fill_missing(series(spark, [None, 1, None, None, 4, None]), ["value"], ["equipment_id"]).orderBy("measurement_id").select("value").collect()]
    assert got == [1, 1, 2, 3, 4, 4]


def test_corrected_moments(spark):
    v = [1.0, 2.0, 2.5, 9.0, 4.0, 4.5]
    r = features.shape_features(series(spark, v), ["value"], ["equipment_id"], (6,)).orderBy(F.col("measurement_id").desc()).first()
    n, d = 6, np.array(v) - np.mean(v)
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert r["value_skew_6"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))


def test_graph(spark):
    e = spark.createDataFrame([("N", a, "NEXT_STEP", "N", b) for a, b in [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("x", "y")]], "src_label string, src_id string, type string, dst_label string, dst_id string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r[0], r[1]) for r in graph.traverse(e, start, 5).select("node", "depth").collect()} == {("b", 1), ("d", 1), ("c", 2)}
    assert [r["node"] for r in graph.shortest_path(e, "b", "d").orderBy("step").collect()] == ["b", "a", "d"]
    assert graph.shortest_path(e, "a", "x").count() == 0
    kinds = {r["kind"] for r in graph.check_link_constraints(spark.createDataFrame([("N", n) for n in "abcdxy"], "label string, id string"), e).collect()}
    assert kinds == {"cycle"}


def test_route_longer_than_64_steps(spark):
    edge = "src_label string, src_id string, type string, dst_label string, dst_id string"
    chain = spark.createDataFrame([("N", str(i), "NEXT_STEP", "N", str(i + 1)) for i in range(70)], edge)
    got = {(int(r[0]), int(r[1])) for r in graph.process_route(chain).collect()}
    assert got == {(a, b) for a in range(71) for b in range(a + 1, 71)}
    lengths = graph.closure(chain.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))).collect()
    assert all(r["length"] == int(r["b"]) - int(r["a"]) for r in lengths)
    cycle = spark.createDataFrame([("N", str(i), "NEXT_STEP", "N", str((i + 1) % 70)) for i in range(70)], edge)
    found = graph.check_link_constraints(spark.createDataFrame([("N", str(i)) for i in range(70)], "label string, id string"), cycle).collect()
    assert {(r["kind"], r["key"]) for r in found} == {("cycle", str(i)) for i in range(70)} and len(found) == 70


def test_chunks():
    assert documents.chunks("") == []
    text = "One. " * 300
    parts = documents.chunks(text)
    assert all(len(p) <= 500 for p in parts) and all(p.endswith(".") for p in parts)
    assert documents.chunks("x" * 1000, 500, 50)[0] == "x" * 500


def test_degradation(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(0, 100, 400)
    rows = [("up", x, 2 * math.exp(0.03 * x) + 5) for x in t.tolist()] + [("down", x, 3 * math.exp(-0.2 * x) + 1) for x in t.tolist()] + [("noisy", x, 20 + math.exp(x / 30) + float(e)) for x, e in zip(t.tolist(), rng.normal(size=400), strict=True)]
    rows += [("flat", x, 4.0) for x in t[:5].tolist()] + [("once", 1.0, float(i)) for i in range(5)] + [("few", x, x) for x in t[:3].tolist()] + [("up", None, 1.0), ("up", 1.0, None)]
    df = spark.createDataFrame([(k, float(x) if x is not None else None, y) for k, x, y in rows], "equipment_id string, hours double, health double")
    got = {r["equipment_id"]: r for r in predict.fit_degradation(df).collect()}
    assert set(got) == {"up", "down", "noisy", "flat", "once"}
    assert [got["up"][c] for c in "abc"] == pytest.approx([2, 0.03, 5], rel=1e-5) and [got["down"][c] for c in "abc"] == pytest.approx([3, -0.2, 1], rel=1e-5)
    assert got["up"]["r2"] > 1 - 1e-9 and got["flat"]["r2"] == 0 and got["flat"]["c"] == pytest.approx(4) and got["once"]["r2"] == 0 and got["once"]["c"] == 2
    x, y = np.array([r[1] for r in rows if r[0] == "noisy"]), np.array([r[2] for r in rows if r[0] == "noisy"])
    best = max(np.corrcoef(np.exp(b * x), y)[0, 1] ** 2 for b in np.linspace(0.02, 0.05, 3001))
    assert got["noisy"]["r2"] >= best - 1e-12 and got["noisy"]["last_hour"] == x.max()
    left = {r["equipment_id"]: r["rul_hours"] for r in predict.predict_rul(predict.fit_degradation(df), 60.0).collect()}
    assert left["up"] == math.ceil(math.log((60 - 5) / 2) / 0.03 - t.max()) or left["up"] == 0
    assert predict.fit_degradation(df.where("false")).count() == 0


def test_recommendations(spark):
    chars = spark.createDataFrame([("s", 50, 1, 0.9, 0.1, 0.2, 0.0), ("l", 20000, 30, 0.0, 0.5, 0.001, 0.9), ("n", 10, 1, None, None, None, None)], "k string, rows long, features int, autocorrelation double, mean_cv double, anomaly_ratio double, pair_correlation double")
    got = {(r["k"], r["algorithm"]): r for r in predict.recommend_algorithms(chars, ["k"]).collect()}
    # half the rows: 0.1; low complexity at a low speed weight: (1 - 0.5) * 0.2; clear: 0.2; drift: 0.2; little noise: 0.1
    assert got["s", "CUSUM Detector"]["suitability"] == pytest.approx(0.7) and got["s", "CUSUM Detector"]["place"] == 1
    assert got["s", "CUSUM Detector"]["warnings"] == ["NOT rows >= 100", "anomaly_ratio > 0.1"]
    assert got["l", "Isolation Forest"]["suitability"] == pytest.approx(0.2 + 0.7 * 0.2 + 0.6 * 0.2 + 0.1 + 0.15 + 0.15) and got["l", "Isolation Forest"]["place"] == 1
    assert got["n", "Z-Score Detector"]["suitability"] == pytest.approx(0.02 + 0.1 + 0.2)
    fast = {r["algorithm"]: r["suitability"] for r in predict.recommend_algorithms(chars.where("k = 's'"), ["k"], {"speed": 0.5, "early_detection": 0.4}).collect()}
    assert fast["CUSUM Detector"] == 1.0 and fast["LSTM AutoEncoder"] == pytest.approx(0.001 + 0.3 * 0.5 + 0.3 * 0.2 + 0.3 + 0.1)


def test_detector_of_one_class(spark):
    df = spark.createDataFrame([("k", 0, 0, 0.1), ("k", 0, 1, 0.1)], "k string, y_true int, y_pred int, y_score double")
    r = predict.evaluate_detector(df, ["k"]).first()
    assert r["roc_auc"] is None and r["precision"] == 0 and r["fp"] == 1


def test_added_columns_never_replace_others(spark):
    import pytest

    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 1))
    x = np.concatenate([base, 2 * base, rng.normal(size=(200, 1))], axis=1)
    x[7] = (3.0, -6.0, 0.0)  # against the other rows' line
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "measurement_id long, error double, b double, c double")
    out = anomaly.reconstruction_error(df, ["error", "b", "c"])
    assert out.columns == ["measurement_id", "error", "b", "c", "reconstruction_error", "is_anomaly", "severity", "top_features"]
    rows = {r["measurement_id"]: r for r in out.collect()}
    assert all(rows[i]["error"] == x[i, 0] for i in range(200))
    z = (x - x.mean(0)) / x.std(0)
    _, vectors = np.linalg.eigh(np.cov(z.T))
    back = z @ vectors[:, 1:] @ vectors[:, 1:].T
    assert np.allclose([rows[i]["reconstruction_error"] for i in range(200)], ((z - back) ** 2).mean(1), atol=1e-9)
    assert rows[7]["is_anomaly"] and rows[7]["severity"] == "CRITICAL" and set(rows[7]["top_features"][:2]) == {"error", "b"}
    with pytest.raises(ValueError, match="severity"):
        anomaly.reconstruction_error(df.withColumn("severity", F.lit("x")), ["error", "b", "c"])
    assert anomaly.reconstruction_error(df.where("false"), ["error", "b", "c"]).count() == 0
