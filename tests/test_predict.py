"""Partial dependence in one pass against copies of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import predict

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] * x[:, 0] + np.sign(x[:, 2]) + rng.normal(0, 0.1, 400)
    data = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 0.5, 0.5, 1.0), (0.5, None, 0.5, 1.0)]
    return spark.createDataFrame(data, "a double, b double, c double, y double").repartition(3)


@pytest.mark.parametrize("kind,poly", [("rf", False), ("gbt", False), ("ridge", False), ("ridge", True), ("rf", True)])
def test_impact_is_that_of_copies(rows, kind, poly):
    model = predict.train_quality_model(rows, COLS, "y", kind, poly)
    for feature in ("a", "c"):
        got = {round(r["value"], 9): r["mean_prediction"] for r in predict.feature_impact(rows, model, feature, COLS, 7).collect()}
        low, high = rows.agg(F.min(feature), F.max(feature)).first()
        want = {}
        for i in range(7):
            v = low + i * (high - low) / 6
            want[round(v, 9)] = model.transform(rows.withColumn(feature, F.lit(v))).agg(F.avg("prediction")).first()[0]
        assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], rel=1e-9) for v in want)
    assert predict.feature_impact(rows.where("false"), model, "a", COLS).count() == 0
