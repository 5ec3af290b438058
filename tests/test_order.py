"""Places, ranks, quantiles, inversions and what is built on them, against plain loops and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import discovery, order


def brute_inversions(x, y, k):
    return sum(int(k[i]) * int(k[j]) for i in range(len(x)) for j in range(len(x)) if x[i] < x[j] and y[i] > y[j])


@pytest.mark.parametrize("n,values", [(1, 3), (2, 2), (37, 5), (64, 1000), (130, 9)])
def test_inversions(n, values):
    rng = np.random.default_rng(n)
    x, y, k = rng.integers(0, values, n), rng.integers(0, values, n), rng.integers(1, 9, n)
    assert order.inversions(x, y, k) == brute_inversions(x, y, k)
    assert order.inversions(x, y, k * 10**9) == 10**18 * brute_inversions(x, y, k)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    n = 700
    a = rng.normal(size=n).round(2)
    b = (a + rng.normal(size=n)).round(1)
    c = np.where(rng.random(n) < 0.4, 2.0, rng.integers(0, 30, n))  # one value is frequent
    rows = [(i, float(a[i]), float(b[i]) if i % 11 else None, float(c[i]) if i % 17 else float("nan"), 1.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "time long, a double, b double, c double, d double").repartition(6)


def brute_tau(x, y):
    n = len(x)
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    s = (dx * dy).sum() / 2
    kept = [n * (n - 1) / 2 - (np.triu(d == 0, 1)).sum() for d in (dx, dy)]
    return s / math.sqrt(kept[0] * kept[1]) if all(kept) else float("nan")


@pytest.mark.parametrize("group,strips", [(1 << 20, 256), (40, 4), (3, 5)])
def test_kendall_by_strips(series, group, strips):
    rows, df = series
    got = {(r["a"], r["b"]): r for r in discovery.kendall_pairs(df, ["a", "b", "c", "d"], group, strips).collect()}
    assert len(got) == 6
    at = {name: np.array([np.nan if r[i + 1] is None else r[i + 1] for r in rows]) for i, name in enumerate("abcd")}
    for (a, b), r in got.items():
        both = ~np.isnan(at[a]) & ~np.isnan(at[b])
        want = brute_tau(at[a][both], at[b][both])
        assert r["n"] == both.sum() and (r["tau"] is None and math.isnan(want) or r["tau"] == pytest.approx(want, abs=1e-12))
    assert got["a", "b"]["p_value"] < 1e-6
    assert discovery.kendall_pairs(df.where("false"), ["a", "b"]).count() == 0


def test_quantiles_ranks_and_places(series):
    rows, df = series
    ps = [0.0, 0.05, 0.25, 0.5, 1 / 3, 0.95, 1.0]
    got = order.quantiles(df.withColumn("none", F.lit(None).cast("double")), ["a", "b", "c", "none"], ps)
    for i, name in enumerate("abc"):
        values = [r[i + 1] for r in rows if r[i + 1] is not None and not math.isnan(r[i + 1])]
        assert got[name] == pytest.approx(np.quantile(values, ps).tolist(), abs=1e-12)
    assert got["none"] == [None] * len(ps)

    ranks = sorted(tuple(r) for r in order.average_ranks(df.select("a", "c"), ["a", "c"]).where("c IS NOT NULL").collect())
    a, c = np.array([r[1] for r in rows]), np.array([r[3] if r[3] is not None else np.nan for r in rows])
    rank = lambda v, x: (v < x).sum() + ((v == x).sum() + 1) / 2
    assert ranks == sorted((rank(a, x), rank(c, y)) for x, y in zip(a, c, strict=True) if not math.isnan(y))

    keyed = df.withColumn("k", F.when(F.col("time") % 3 > 0, F.col("time") % 3))
    placed = order.placed(keyed, ["k"], ["a", "time"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0] % 3 or None, []).append((r[1], r[0]))
    assert {(r["k"], r["i__"]): r["time"] for r in placed} == {(k, i): t for k, v in by.items() for i, (_, t) in enumerate(sorted(v))}


def test_random_tables_are_shuffles():
    rng = np.random.default_rng(3)
    rows, columns = np.array([40, 25, 10]), np.array([30, 30, 15])
    labels, of = np.repeat([0, 1, 2], columns), np.repeat([0, 1, 2], rows)
    drawn = np.array([order_table.ravel() for order_table in (discovery.random_table(rng, rows, columns) for _ in range(4000))])
    shuffled = np.array([np.bincount(of * 3 + rng.permutation(labels), minlength=9) for _ in range(4000)])
    assert (drawn.reshape(-1, 3, 3).sum(axis=1) == columns).all() and (drawn.reshape(-1, 3, 3).sum(axis=2) == rows).all()
    assert drawn.mean(axis=0) == pytest.approx(shuffled.mean(axis=0), abs=0.2)
    assert drawn.std(axis=0) == pytest.approx(shuffled.std(axis=0), rel=0.06)
    huge = discovery.random_table(rng, rows * 10**9, columns * 10**9)
    assert (huge.sum(axis=0) == columns * 10**9).all() and (huge.sum(axis=1) == rows * 10**9).all()
    assert huge / 1e9 == pytest.approx(np.outer(rows, columns) / 75, abs=1e-3)


def test_transfer_entropy_against_shuffled_series(spark):
    """The same lag and entropy as a loop over the series, and z and p of really shuffled ones."""
    rng = np.random.default_rng(12)
    n, lag, bins, shuffles = 900, 3, 4, 200
    x = rng.normal(size=n)
    y = np.concatenate([rng.normal(size=lag), 0.8 * x[:-lag]]) + 0.6 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(n)], "time long, x double, y double").repartition(4)
    got = {(r["source"], r["target"]): r for r in discovery.transfer_entropy(df, ["x", "y"], 5, bins, shuffles).collect()}
    binned = {name: np.searchsorted(np.quantile(v, [i / bins for i in range(1, bins)]), v, "right") for name, v in (("x", x), ("y", y))}

    def te(s, t, k):
        first = max(k, 1)
        counts = {}
        for a, b, c in zip(t[first:], t[first - 1 : -1], s[first - k : len(s) - k], strict=True):
            counts[a, b, c] = counts.get((a, b, c), 0) + 1
        total = sum(counts.values())
        part = lambda *at: {key: sum(v for q, v in counts.items() if tuple(q[i] for i in at) == key) for key in {tuple(q[i] for i in at) for q in counts}}
        yx, yy, y1 = part(1, 2), part(0, 1), part(1)
        return sum(v / total * math.log2(v / yx[b, c] / (yy[a, b] / y1[(b,)])) for (a, b, c), v in counts.items())

    for (s, t), r in got.items():
        want = [te(binned[s], binned[t], k) for k in range(1, 6)]
        assert r["lag"] == int(np.argmax(want)) + 1 and r["te"] == pytest.approx(max(want))
        null = []
        for _ in range(shuffles):
            own = binned[s].copy()
            own[: n - r["lag"]] = rng.permutation(own[: n - r["lag"]])
            null.append(te(own, binned[t], r["lag"]))
        assert r["null_mean"] == pytest.approx(np.mean(null), rel=0.05) and r["null_std"] == pytest.approx(np.std(null), rel=0.3)
    assert got["x", "y"]["lag"] == lag and got["x", "y"]["is_causal"] and got["x", "y"]["z"] > 20
    again = {(r["source"], r["target"]): r["z"] for r in discovery.transfer_entropy(df, ["x", "y"], 5, bins, shuffles).collect()}
    assert again == {k: r["z"] for k, r in got.items()}


def test_constant_columns_have_no_correlation(spark):
    """They did fail the query, with the session's default arithmetic."""
    from millrace.operators import features

    df = spark.createDataFrame([(i, 1.0, float(i), float(i % 7)) for i in range(60)], "time long, a double, b double, c double").withColumn("k", F.lit(1))
    got = {(r["a"], r["b"]): r["r"] for r in features.all_correlations(df, [("a", "b"), ("b", "c"), ("b", "b")]).collect()}
    assert got["a", "b"] is None and got["b", "b"] == pytest.approx(1) and got["b", "c"] == pytest.approx(np.corrcoef(range(60), [i % 7 for i in range(60)])[0, 1])
    ranking = {r["feature"]: r["importance"] for r in features.feature_ranking(df, ["a", "c"], "b").collect()}
    assert ranking["a"] == 0
    rolled = discovery.rolling_correlation(df, [("a", "b"), ("b", "c")], 10, ["k"], "time").orderBy("time").collect()
    assert rolled[30]["corr_a_b"] is None and rolled[30]["corr_b_c"] == pytest.approx(np.corrcoef(range(20, 30), [i % 7 for i in range(20, 30)])[0, 1])


@pytest.mark.parametrize("width", [1, 2, 7, 500])
def test_rolling_quantiles(width):
    x = np.random.default_rng(width).integers(0, 12, 300).astype(float)
    x[::13] = np.nan
    got = order.rolling_quantiles(x, width, [0.05, 0.5, 0.95, 1.0])
    for i in range(len(x)):
        own = x[max(0, i - width + 1) : i + 1]
        own = own[~np.isnan(own)]
        assert np.isnan(got[i]).all() if not len(own) else got[i] == pytest.approx(np.quantile(own, [0.05, 0.5, 0.95, 1.0]))


ADDING = {
    "score": [("zscore_global", (["v"], ["k"])), ("zscore_rolling", (["v"], ["k"], 5)), ("cusum", (["v"], ["k"])), ("spc_detector", ("v", ["k"]))],
    "votes": [("ensemble_online", (["v"], ["f"], ["k"])), ("ensemble_batch", (["v"],))],
    "ma5": [("score_trend", (["k"], "v"))],
    "v_mean_5": [("rolling_features", (["v"], ["k"]))],
    "v_diff1": [("change_features", (["v"], ["k"]))],
    "v_skew_30": [("shape_features", (["v"], ["k"]))],
    "v_fft_peak": [("fft_features", (["v"], ["k"]))],
    "v_peak_count": [("peak_features", (["v"], ["k"]))],
    "v_slope": [("failure_features", (["v"], ["k"]))],
    "v_over_w": [("interaction_features", (["v", "w"],))],
    "is_test": [("train_test_split", ())],
    "corr_v_w": [("rolling_correlation", ([("v", "w")], 5, ["k"]))],
}


@pytest.mark.parametrize("column,name,args", [(c, n, a) for c, many in ADDING.items() for n, a in many])
def test_no_input_column_is_replaced(spark, column, name, args):
    from millrace.operators import anomaly, features

    f = next(getattr(m, name) for m in (anomaly, features, discovery) if hasattr(m, name))
    df = spark.createDataFrame([(i, i, 1, float(i), float(i % 3), True) for i in range(12)], "time long, measurement_id long, k long, v double, w double, f boolean")
    out = f(df, *args)
    assert column in out.columns and len(set(out.columns)) == len(out.columns) and set(df.columns) <= set(out.columns)
    for taken in (column, "x__"):
        with pytest.raises(ValueError, match=taken):
            f(df.withColumn(taken, F.lit(1)), *args)


@pytest.mark.parametrize("distance", [2, 3, 6])
def test_peaks_are_those_of_each_window(distance):
    from millrace.operators.features import peaks

    rng = np.random.default_rng(distance)
    for x in (rng.normal(size=300), rng.integers(0, 6, 400).astype(float), np.zeros(20), np.arange(2.0), np.zeros(0), rng.integers(0, 3, 5000).astype(float)):
        got = peaks(x, 30, distance)
        for i in [*range(min(60, len(x))), *range(4090, min(4110, len(x)))]:
            w = x[max(0, i - 29) : i + 1]
            at = np.flatnonzero((w[1:-1] > w[:-2]) & (w[1:-1] > w[2:]) & (w[1:-1] >= w.mean())) + 1 if len(w) > 2 else np.zeros(0, int)
            chosen = []
            for j in at[np.argsort(-w[at], kind="stable")].tolist():
                if all(abs(j - k) >= distance for k in chosen):
                    chosen.append(j)
            assert got[i, 0] == len(chosen) and got[i, 1] == pytest.approx(w[chosen].mean() if chosen else 0.0)
