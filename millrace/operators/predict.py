"""Failure and quality models on Spark ML, degradation curves, and the evaluation of detectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import cut


def train_failure_model(df: DataFrame, cols: list[str], label: str = "label", kind: str = "rf", seed: int = 42) -> PipelineModel:
    """A forest or boosted trees with balanced class weights."""
    share = F.avg(F.col(label).cast("double"))
    weights = df.agg(share.alias("p__"))
    p = F.greatest(F.least(F.col("p__"), F.lit(1 - 1e-6)), F.lit(1e-6))
    weighted = df.crossJoin(F.broadcast(weights)).withColumn("w__", F.when(F.col(label) == 1, 0.5 / p).otherwise(0.5 / (1 - p)))  # one row
    model = (RandomForestClassifier if kind == "rf" else GBTClassifier)(featuresCol="f__", labelCol=label, weightCol="w__", seed=seed, maxDepth=5)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="f__", handleInvalid="skip"), model]).fit(weighted)


def score_failure(model: PipelineModel, df: DataFrame) -> DataFrame:
    """probability and risk_level of each row."""
    out = model.transform(df).withColumn("probability_", F.round(vector_to_array("probability")[1], 12))
    risk = F.when(F.col("probability_") >= 0.8, "CRITICAL").when(F.col("probability_") >= 0.6, "HIGH").when(F.col("probability_") >= 0.4, "MEDIUM").otherwise("LOW")
    return out.withColumn("risk_level", risk).select(*df.columns, F.col("probability_").alias("probability"), "risk_level", F.col("prediction").cast("int").alias("prediction"))


def top_features(model: PipelineModel, n: int = 10) -> list[tuple[str, float]]:
    cols, weights = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    return sorted(zip(cols, weights.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def train_quality_model(df: DataFrame, cols: list[str], target: str, kind: str = "rf", poly: bool = False, folds: int = 0, seed: int = 42) -> PipelineModel:
    """A regressor (rf, gbt, ridge), on features of degree 2 if asked; with folds, chosen by cross-validation over its main parameter."""
    steps = [VectorAssembler(inputCols=cols, outputCol="a__", handleInvalid="skip"), StandardScaler(inputCol="a__", outputCol="b__", withMean=True)]
    feature = "b__"
    if poly:
        steps.append(PolynomialExpansion(degree=2, inputCol="b__", outputCol="c__"))
        feature = "c__"
    model = {"rf": lambda: RandomForestRegressor(seed=seed), "gbt": lambda: GBTRegressor(seed=seed, maxIter=20), "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0)}[kind]()
    model = model.setFeaturesCol(feature).setLabelCol(target)
    pipe = Pipeline(stages=[*steps, model])
    if folds:
        grid = ParamGridBuilder().addGrid(*{"rf": (model.maxDepth, [3, 5]) if kind == "rf" else None, "gbt": (model.maxDepth, [3, 5]) if kind == "gbt" else None, "ridge": (model.regParam, [0.01, 0.1, 1.0]) if kind == "ridge" else None}[kind]).build()
        return CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target), numFolds=folds, seed=seed).fit(df.dropna(subset=[*cols, target])).bestModel
    return pipe.fit(df.dropna(subset=[*cols, target]))


def quality_metrics(scored: DataFrame, target: str) -> DataFrame:
    """mse, rmse, mae, r2, mape of column prediction."""
    e = F.col("prediction") - F.col(target)
    g = scored.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(target) * F.count(target), F.lit(0.0))).alias("r2"), (F.avg(F.when(F.col(target) != 0, F.abs(e / F.col(target)))) * 100).alias("mape"))
    return g.withColumn("rmse", F.sqrt("mse"))


def score_quality(model: PipelineModel, df: DataFrame, rmse: float, z: float = 1.96) -> DataFrame:
    out = model.transform(df)
    return out.select(*df.columns, "prediction", (F.col("prediction") - z * rmse).alias("lower"), (F.col("prediction") + z * rmse).alias("upper"))


def _trees(model) -> list[tuple[float, list[tuple[int, float, int, int]]]]:
    """Of an ensemble, each tree's weight and nodes: feature (-1: leaf), threshold or a leaf's value, left, right."""
    out = []
    share = 1 / model.getNumTrees if isinstance(model, RandomForestRegressionModel) else None
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes, todo = [], [(tree._call_java("rootNode"), None)]
        while todo:
            node, parent = todo.pop()
            if parent is not None:
                nodes[parent[0]][parent[1]] = len(nodes)
            inner = node.subtreeDepth() > 0
            nodes.append([node.split().featureIndex(), node.split().threshold(), 0, 0] if inner else [-1, node.prediction(), 0, 0])
            if inner:
                at = len(nodes) - 1
                todo += [(node.rightChild(), (at, 3)), (node.leftChild(), (at, 2))]
        out.append((share if share else weight, [tuple(n) for n in nodes]))
    return out


def _walked(trees: list, x: np.ndarray, feature: int, grid: np.ndarray) -> np.ndarray:
    """The sum over the rows of x of what the trees predict with the feature at each value of the ascending grid: a row goes down a tree once, splits on the feature part the grid."""
    total = np.zeros(len(grid))
    for weight, nodes in trees:
        todo = [(0, np.arange(len(x)), 0, len(grid))]
        while todo:
            at, rows, lo, hi = todo.pop()
            f, cut_, left, right = nodes[at]
            if f < 0:
                total[lo:hi] += weight * cut_ * len(rows)
            elif f == feature:
                mid = lo + int(np.searchsorted(grid[lo:hi], cut_, "right"))
                todo += [(to, rows, a, b) for to, a, b in ((left, lo, mid), (right, mid, hi)) if a < b]
            else:
                small = x[rows, f] <= cut_
                todo += [(to, part, lo, hi) for to, part in ((left, rows[small]), (right, rows[~small])) if len(part)]
    return total


def feature_impact(df: DataFrame, model: PipelineModel, feature: str, cols: list[str], points: int = 20) -> DataFrame:
    """value, mean_prediction: the mean prediction with one feature set to each of `points` values between its bounds.

    Every row is read once. Down the trees of an ensemble it carries the whole grid, which splits on the feature part.
    A linear model, also on features of degree 2, is linear in the other features, so the mean over all rows is needed
    for one value only; the other values differ from it as they do for the mean row. Other models predict each row
    once for each value.
    """
    spark = df.sparkSession
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    if low is None:
        return spark.createDataFrame([], "value double, mean_prediction double")
    values = [float(low) + i * ((float(high) - float(low)) / max(points - 1, 1)) for i in range(points)]
    last = model.stages[-1]
    anchored = df.select(*[F.lit(values[0]).alias(c) if c == feature else F.col(c) for c in cols])
    made = lambda rows: spark.createDataFrame(rows, "value double, mean_prediction double")
    if isinstance(last, LinearRegressionModel):
        whole = model.transform(anchored).agg(F.avg("prediction").alias("p"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        if whole["p"] is None:
            return made([])
        mean_rows = spark.createDataFrame([tuple(v if c == feature else float(whole[c]) for c in cols) for v in values], ", ".join(f"`{c}` double" for c in cols))
        of = {r[feature]: r["prediction"] for r in model.transform(mean_rows).select(feature, "prediction").collect()}
        return made([(v, whole["p"] + of[v] - of[values[0]]) for v in values])
    if isinstance(last, (RandomForestRegressionModel, GBTRegressionModel)) and not any(isinstance(x, PolynomialExpansion) for x in model.stages):
        steps = PipelineModel(model.stages[:-1])
        at = cols.index(feature)
        vector = lambda rows: steps.transform(rows).select(vector_to_array(last.getFeaturesCol()).alias("x"))
        some = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])).select(*cols).limit(1)
        one = some.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], "v__ double"))).withColumn(feature, F.col("v__"))
        grid = np.sort(np.array([r["x"][at] for r in vector(one).collect()]))  # `points` rows
        if not len(grid):
            return made([])
        trees = _trees(last)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(len(grid))
            for batch in batches:
                if len(batch):
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                    n, total = n + len(x), total + _walked(trees, x, at, grid)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int64()), pa.array([n] * len(grid), pa.int64()), pa.array(total)], ["i", "n", "s"])

        sums = vector(anchored).mapInArrow(run, "i long, n long, s double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean_prediction"))
        return sums.select(F.element_at(F.array(*map(F.lit, values)), F.col("i").cast("int") + 1).alias("value"), "mean_prediction")
    grid = spark.createDataFrame([(v,) for v in values], "grid__ double")
    many = df.select(*[c for c in cols if c != feature]).crossJoin(F.broadcast(grid)).withColumn(feature, F.col("grid__"))  # `points` rows
    return model.transform(many).groupBy("grid__").agg(F.avg("prediction").alias("mean_prediction")).withColumnRenamed("grid__", "value")


def optimal_conditions(df: DataFrame, model: PipelineModel, cols: list[str], target: float | None = None, steps: int = 5, k: int = 10) -> DataFrame:
    """The k settings of a grid over at most five variables (others at their means) whose prediction is nearest to target, or largest."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max), ("m", F.avg))]).first()
    grid = df.sparkSession.range(steps ** min(len(cols), 5))
    new = {}
    for i, c in enumerate(cols):
        if i < 5:
            at = (F.floor(F.col("id") / steps**i) % steps) / max(steps - 1, 1)
            new[c] = F.lit(float(row[f"a{i}"])) + at * float(row[f"b{i}"] - row[f"a{i}"])
        else:
            new[c] = F.lit(float(row[f"m{i}"]))
    scored = model.transform(grid.withColumns(new))
    gap = F.abs(F.col("prediction") - target) if target is not None else -F.col("prediction")
    return scored.orderBy(gap, "id").select(*cols, "prediction").limit(k)


#: Growth over the whole span, exp(bend), that a curve may start its search from; one decaying and one rising way for each size.
BENDS = [*[-60 / 2**i for i in range(10)], *[60 / 2**i for i in reversed(range(10))]]


def fit_degradation(df: DataFrame, key: str = "equipment_id", hours: str = "hours", health: str = "health", rounds: int = 7) -> DataFrame:
    """Per key: a, b, c, r2 of health = a exp(b hours) + c by least squares over all its rows, and the last hour.

    For a given b the best a and c are a regression on the exponential, so only b is searched: each round fits
    every key for a row of bends at once, by sums that combine before the shuffle, and keeps the two steps around
    the best. Nothing is gathered. Rows with a null take no part; keys with fewer than 4 rows have no curve; a flat
    one has r2 0.
    """
    rows = df.select(key, F.col(hours).cast("double").alias("t"), F.col(health).cast("double").alias("y")).dropna()
    ends = rows.groupBy(key).agg(F.min("t").alias("lo"), F.max("t").alias("last_hour"), F.count("*").alias("n")).where("n > 3")
    ends = ends.withColumn("span", F.greatest(F.col("last_hour") - F.col("lo"), F.lit(1e-9))).drop("n")
    bends = cut(ends.withColumn("bends", F.array(*map(F.lit, BENDS))))
    rows = cut(rows.join(bends.select(key, "lo", "span"), key).select(key, ((F.col("t") - F.col("lo")) / F.col("span")).alias("u"), "y"))
    shape = lambda b: F.when(F.abs(b) < 1e-6, F.col("u")).otherwise(F.expm1(b * F.col("u")) / b) * F.exp(-F.greatest(b, F.lit(0.0)))
    for _ in range(rounds):
        n = len(BENDS)
        fits = rows.join(bends.select(key, "bends"), key).groupBy(key).agg(F.array(*[F.coalesce(F.regr_r2("y", shape(F.col("bends")[j])), F.lit(-1.0)) for j in range(n)]).alias("fits"))
        best = F.array_position("fits", F.array_max("fits")).cast("int")
        near = bends.join(fits, key).withColumns({"from": F.col("bends")[F.greatest(best - 2, F.lit(0))], "to": F.col("bends")[F.least(best, F.lit(n - 1))]})
        bends = cut(near.withColumn("bends", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("from") + (F.col("to") - F.col("from")) * i / (n - 1))).drop("fits", "from", "to"))
    middle = (F.col("bends")[0] + F.col("bends")[len(BENDS) - 1]) / 2
    bends = bends.withColumn("bend", F.when(F.abs(middle) < 1e-6, 1e-6).otherwise(middle))
    g = shape(F.col("bend"))
    line = rows.join(bends.select(key, "bend"), key).groupBy(key).agg(F.regr_slope("y", g).alias("s"), F.regr_intercept("y", g).alias("d"), F.when(F.var_pop("y") == 0, 0.0).otherwise(F.coalesce(F.regr_r2("y", g), F.lit(0.0))).alias("r2"), F.avg("y").alias("m"))
    rise = F.coalesce(F.col("s"), F.lit(0.0)) * F.exp(-F.greatest("bend", F.lit(0.0))) / F.col("bend")
    b = F.col("bend") / F.col("span")
    return bends.join(line, key).select(key, (rise * F.exp(-b * F.col("lo"))).alias("a"), b.alias("b"), (F.coalesce("d", "m") - rise).alias("c"), "r2", "last_hour")


def predict_rul(curves: DataFrame, threshold: float, horizon: int = 10_000) -> DataFrame:
    """Hours until the curve reaches the threshold from below, 0 if it already has, null if not within the horizon. Closed form."""
    now = F.col("a") * F.exp(F.col("b") * F.col("last_hour")) + F.col("c")
    cross = F.log((F.lit(threshold) - F.col("c")) / F.nullif("a", F.lit(0.0))) / F.nullif("b", F.lit(0.0))
    left = F.ceil(cross - F.col("last_hour"))
    return curves.withColumn("rul_hours", F.when(now >= threshold, 0).when((left >= 0) & (left <= horizon), left))


def evaluate_detector(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: confusion counts, accuracy, precision, recall, F1, ROC AUC and average precision of y_true, y_pred, y_score. Ties share an average rank."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    counts = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    # one row for each score, from high to low
    by_score = df.groupBy(*keys, "y_score").agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    w = Window.partitionBy(*keys).orderBy(F.col("y_score").desc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    cum = by_score.withColumns({"cp": F.sum("pos").over(run), "cn": F.sum("neg").over(run), "np": F.sum("pos").over(all_), "nn": F.sum("neg").over(all_)})
    auc = F.sum(F.col("neg") * (F.col("cp") - F.col("pos") / 2)) / F.nullif(F.max(F.col("np") * F.col("nn")), F.lit(0))
    ap = F.sum(F.col("pos") / F.nullif("np", F.lit(0)) * F.col("cp") / (F.col("cp") + F.col("cn")))
    curves = cum.groupBy(*keys).agg(auc.alias("roc_auc"), ap.alias("pr_auc"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.join(curves, keys).withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def early_detection_score(df: DataFrame, keys: list[str], rows: int = 10, tie: str = "measurement_id") -> DataFrame:
    """Per key: mean over fault starts of 1 if an alarm came in the rows before, else 1 - offset / rows of the first alarm after it (0 without one)."""
    w = Window.partitionBy(*keys).orderBy("time", tie)
    i = F.row_number().over(w)
    alarm = F.when(F.col("y_pred") == 1, F.col("i__"))
    x = df.withColumn("i__", i).withColumn("start__", (F.col("y_true") == 1) & (F.coalesce(F.lag("y_true").over(w), F.lit(0)) == 0))
    x = x.withColumn("first__", F.min(alarm).over(w.rowsBetween(-rows, rows)))
    late = F.col("first__") - F.col("i__")
    score = F.when(F.col("first__").isNull(), 0.0).when(late <= 0, 1.0).otherwise(1 - late / rows)
    return x.where("start__").groupBy(*keys).agg(F.avg(score).alias("early_detection"), F.count("*").alias("faults"))


def rank_algorithms(metrics: DataFrame, weights: dict[str, float], among: list[str] | None = None) -> DataFrame:
    """Weighted sum of metrics and the place by it."""
    total = reduce(Column.__add__, [F.coalesce(m, F.lit(0.0)) * w for m, w in weights.items()])
    place = F.rank().over(Window.partitionBy(*(among or [])).orderBy(F.col("weighted_score").desc()))
    return metrics.withColumn("weighted_score", total).withColumn("place", place)


#: Kind, least rows, complexity and interpretability of each algorithm; equal scores keep this order.
ALGORITHMS = {
    "Z-Score Detector": ("statistical", 100, "low", "high"),
    "CUSUM Detector": ("statistical", 100, "low", "high"),
    "SPC Control Chart Detector": ("statistical", 200, "low", "high"),
    "Isolation Forest": ("ml", 500, "medium", "medium"),
    "Local Outlier Factor": ("ml", 300, "medium", "medium"),
    "One-Class SVM": ("ml", 300, "medium", "low"),
    "AutoEncoder": ("deep_learning", 5000, "high", "low"),
    "LSTM AutoEncoder": ("deep_learning", 10000, "high", "low"),
}
#: Points for complexity and for interpretability.
EASE = {"low": 1.0, "medium": 0.6, "high": 0.3}
CLARITY = {"high": 1.0, "medium": 0.6, "low": 0.3}
#: Weights where the caller names none.
PRIORITIES = {"speed": 0.2, "accuracy": 0.4, "interpretability": 0.2, "early_detection": 0.2}
#: What a data set's profile adds to an algorithm, by its name or else by its kind.
BONUSES = {
    "autocorrelation > 0.5": {"LSTM AutoEncoder": 0.3, "CUSUM Detector": 0.2, "statistical": 0.1},
    "mean_cv > 0.3": {"deep_learning": 0.1, "Isolation Forest": 0.1, "Local Outlier Factor": 0.1},
    "mean_cv <= 0.3": {"statistical": 0.1},
    "anomaly_ratio < 0.01": {"Isolation Forest": 0.15},
    "features > 20": {"Isolation Forest": 0.15, "deep_learning": 0.1, "statistical": -0.1},
    "pair_correlation > 0.5": {"deep_learning": 0.1},
}
EARLY = {"CUSUM Detector": 0.1, "LSTM AutoEncoder": 0.1}


def recommend_algorithms(chars: DataFrame, keys: list[str], priorities: dict[str, float] | None = None) -> DataFrame:
    """algorithm, suitability (0 to 1), reasons, warnings and place for each row of data_characteristics().

    Up to 0.2 for enough rows; ease and clarity weigh by the priorities (below a speed of 0.3 more complex
    algorithms gain); the profile adds BONUSES, named in reasons. A null in the profile adds nothing; accuracy
    has a weight but no measure of its own before anything is run.
    """
    p, about = PRIORITIES | (priorities or {}), ["rows", "features", "autocorrelation", "mean_cv", "anomaly_ratio", "pair_correlation"]
    choices = []
    for name, (kind, need, complexity, clarity) in ALGORITHMS.items():
        ease = EASE[complexity] if p["speed"] > 0.3 else 1 - EASE[complexity] / 2
        fixed = ease * p["speed"] + CLARITY[clarity] * p["interpretability"] + (EARLY.get(name, 0.0) if p["early_detection"] > 0.3 else 0.0)
        given = {on: by.get(name, by.get(kind, 0.0)) for on, by in BONUSES.items()}
        score = F.least(F.col("rows") / need, F.lit(1.0)) * 0.2 + fixed + reduce(Column.__add__, [F.when(F.expr(on), x).otherwise(0.0) for on, x in given.items()])
        named = lambda texts: F.array_compact(F.array(*[F.when(F.expr(on), F.lit(on)) for on in texts]))
        enough = f"rows >= {need}"
        choices.append(F.struct(
            F.lit(name).alias("algorithm"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9).alias("suitability"), F.lit(len(choices)).alias("order__"),
            named([enough, *[on for on, x in given.items() if x > 0]]).alias("reasons"), named([f"NOT {enough}", "anomaly_ratio > 0.1", *[on for on, x in given.items() if x < 0]]).alias("warnings"),
        ))
    out = chars.select(*keys, *about).select(*keys, F.inline(F.array(*choices)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("suitability").desc(), "order__"))).drop("order__")
