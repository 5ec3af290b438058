"""Spectra of long series, in one task and in blocks, against numpy; the data profile against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import features, spectrum


def verdict(x):
    a = np.abs(np.fft.fft(x))[1 : len(x) // 2]
    return int(a.argmax()) + 1, a.max(), a.mean() + 3 * a.std()


@pytest.mark.parametrize("whole,cells", [(1 << 20, 1 << 18), (1000, 1 << 18), (1000, 2048)])
def test_seasonality_is_numpys(spark, whole, cells):
    rng = np.random.default_rng(4)
    made = {"prime": rng.normal(50, 1, 20_011), "even": rng.normal(0, 1, 22_000) + np.sin(np.arange(22_000) / 7), "flat": np.full(3000, 0.1), "short": np.sin(np.arange(900)), "odd": rng.normal(0, 1, 1501)}
    rows = pd.concat([pd.DataFrame({"k": k, "time": np.arange(len(x)), "tie": 0, "v": x}) for k, x in made.items()])
    df = spark.createDataFrame(rows).repartition(7)
    series = spectrum.series_of(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"], ["k"], "tie")
    got = {r["k"]: r for r in spectrum.seasonality(series, ["k", "column__"], whole=whole, cells=cells).collect()}
    assert set(got) == set(made)
    for k, x in made.items():
        frequency, height, threshold = verdict(x)
        assert got[k]["n"] == len(x)
        if k != "flat":
            assert got[k]["frequency"] == frequency and got[k]["height"] == pytest.approx(height, rel=1e-9) and got[k]["threshold"] == pytest.approx(threshold, rel=1e-9)
        assert got[k]["is_seasonal"] == (k != "flat" and len(x) > 1000 and height > threshold)
    assert got["even"]["is_seasonal"] and not got["short"]["is_seasonal"]
    assert spectrum.seasonality(series.where("false"), ["k", "column__"]).count() == 0


def test_data_characteristics_is_pandas(spark):
    rng = np.random.default_rng(6)
    frames = []
    for key, n in (("a", 1500), ("b", 105), (None, 60), ("d", 9), ("e", 1)):
        t = np.arange(n)
        x = pd.DataFrame({"k": key, "time": t, "measurement_id": t, "x": np.sin(t / 5) + rng.normal(0, 0.1, n), "y": t * 0.02 + rng.normal(0, 0.3, n), "z": 4.0, "is_anomaly": t % 7 == 0})
        x.loc[rng.random(n) < 0.1, "x"] = None
        frames.append(x)
    df = spark.createDataFrame(pd.concat(frames), "k string, time long, measurement_id long, x double, y double, z double, is_anomaly boolean").withColumns({c: F.lit(1) for c in ("n", "v", "column__", "run__")}).repartition(5)
    got = {r["k"]: r for r in features.data_characteristics(df, ["x", "y", "z"], ["k"], whole=700).collect()}
    assert set(got) == {"a", "b", None, "d", "e"}
    for x in frames:
        r, data = got[x["k"].iloc[0]], x[["x", "y", "z"]]
        series = [data[c].dropna() for c in data]
        mean = lambda xs: np.mean([v for v in xs if not np.isnan(v)] or [0.0])
        with np.errstate(all="ignore"):
            auto = mean([abs(s.autocorr(1)) for s in series if len(s) > 10])
            corr = data.corr().abs().to_numpy()[np.triu_indices(3, 1)]
            trend = any(len(s) > 100 and abs(np.corrcoef(np.arange(len(s)), s)[0, 1]) > 0.5 for s in series)
        assert r["rows"] == len(x) and r["features"] == 3 and r["anomaly_ratio"] == pytest.approx(x["is_anomaly"].mean())
        assert r["autocorrelation"] == pytest.approx(auto, abs=1e-9) and r["mean_cv"] == pytest.approx(mean([s.std() / abs(s.mean()) for s in series if len(s)]), abs=1e-9)
        assert r["pair_correlation"] == pytest.approx(mean(corr), abs=1e-9) and r["missing_ratio"] == pytest.approx(data.isna().mean().mean())
        assert r["has_trend"] == trend and r["seasonality"] == (len(x) == 1500)
