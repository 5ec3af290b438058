"""Anomaly detectors and what follows them: ensembles, regions, alerts, contributions.

Statistical detectors are window expressions per key. Forest and one-class boundary fit on a bounded
sample of each key and score all rows in Arrow batches; local outlier factors search all rows, cell by cell.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from millrace.functions.columns import appends, fresh
from millrace.operators.graph import cut
from millrace.operators.order import placed, quantiles, rolling_quantiles, runs

TIE = "measurement_id"


def _ordered(keys: list[str], tie: str = TIE):
    return Window.partitionBy(*keys).orderBy("time", tie)


def _largest(cs: list[Column]) -> Column:
    return F.greatest(*cs) if len(cs) > 1 else cs[0]


def _z(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.when(std == 0, 1e-10).otherwise(std)


@appends("score", "is_anomaly")
def zscore_global(df: DataFrame, cols: list[str], keys: list[str], threshold: float = 3.0) -> DataFrame:
    """score: largest abs(z) over the columns, by mean and population std of the key; is_anomaly above the threshold.

    The statistics are aggregated first (partially on every task) and joined back, so no key is sorted.
    """
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"{n}{i}__") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    score = _largest([F.abs(_z(F.col(c), F.col(f"m{i}__"), F.col(f"s{i}__"))) for i, c in enumerate(cols)])
    out = df.join(stats, keys).withColumn("score", score)
    return out.select(*df.columns, "score", (F.col("score") > threshold).alias("is_anomaly"))


@appends("score", "is_anomaly")
def zscore_rolling(df: DataFrame, cols: list[str], keys: list[str], window: int, threshold: float = 3.0) -> DataFrame:
    w = _ordered(keys).rowsBetween(-(window - 1), 0)
    score = _largest([F.abs(_z(F.col(c), F.avg(c).over(w), F.stddev_pop(c).over(w))) for c in cols])
    return df.withColumn("score", score).withColumn("is_anomaly", F.col("score") > threshold)


@appends("score", "is_anomaly")
def cusum(df: DataFrame, cols: list[str], keys: list[str], threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """Two-sided cumulative sums of z-values in closed form: with P the running sum of (z - drift), the sum that restarts at 0 is P - min(0, least P so far)."""
    w = _ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = df.withColumns({f"z{i}__": _z(F.col(c), F.avg(c).over(whole), F.stddev_pop(c).over(whole)) for i, c in enumerate(cols)})
    out = out.withColumns({f"{n}{i}__": F.sum(sign * F.col(f"z{i}__") - drift).over(w) for i in range(len(cols)) for n, sign in (("u", 1), ("d", -1))})
    sums = [F.col(f"{n}{i}__") - F.least(F.lit(0.0), F.min(f"{n}{i}__").over(w)) for i in range(len(cols)) for n in "ud"]
    out = out.withColumn("score", _largest(sums))
    return out.select(*df.columns, "score", (F.col("score") > threshold).alias("is_anomaly"))


@appends("score", "is_anomaly")
def spc_detector(df: DataFrame, col: str, keys: list[str], n_sigma: float = 3.0) -> DataFrame:
    """Beyond n sigma, nine on one side, six trending, or two of three beyond two sigma."""
    w, whole = _ordered(keys), Window.partitionBy(*keys)
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    count = lambda c, n: F.sum(c.cast("int")).over(last(n))
    out = df.withColumns({"z__": _z(F.col(col), F.avg(col).over(whole), F.stddev_pop(col).over(whole)), "up__": F.lag(col).over(w) < F.col(col), "down__": F.lag(col).over(w) > F.col(col)})
    z = F.col("z__")
    full = lambda n: F.count(F.lit(1)).over(last(n)) == n
    run = full(9) & ((count(z > 0, 9) == 9) | (count(z < 0, 9) == 9))
    trend = full(6) & ((count(F.col("up__"), 5) == 5) | (count(F.col("down__"), 5) == 5))
    flag = (F.abs(z) > n_sigma) | run | trend | (full(3) & (count(F.abs(z) > 2, 3) >= 2))
    return out.withColumn("is_anomaly", F.coalesce(flag, F.lit(False))).withColumn("score", F.abs(z)).drop("z__", "up__", "down__")


def pivot_zscore_anomalies(df: DataFrame, keys: list[str], threshold: float = 3.0, least: int = 10) -> DataFrame:
    """Mean value of each key and time, those more than `threshold` sigma (population) from the key's mean; MAJOR above 4, else MINOR."""
    means = df.groupBy(*keys, "time").agg(F.avg("value").alias("value"))
    stats = means.groupBy(*keys).agg(F.avg("value").alias("m__"), F.stddev_pop("value").alias("s__"), F.count("value").alias("n__")).where((F.col("n__") >= least) & (F.col("s__") > 0))
    z = F.abs((F.col("value") - F.col("m__")) / F.col("s__"))
    return means.join(stats, keys).withColumn("score", z).where(F.col("score") > threshold).select(*keys, "time", "value", "score", F.when(F.col("score") > 4, "MAJOR").otherwise("MINOR").alias("severity"))


def sampled(df: DataFrame, keys: list[str], n: int, tie: str = TIE) -> DataFrame:
    """n rows of each key, by hash; keys are salted first so that a hot one is cut down where it lies."""
    order = F.xxhash64(F.lit(29), tie)
    salt = F.pmod(F.xxhash64(F.lit(31), tie), F.lit(64)).alias("salt__")
    some = df.withColumn("salt__", salt).withColumn("r__", F.row_number().over(Window.partitionBy(*keys, "salt__").orderBy(order, tie))).where(F.col("r__") <= n)
    return some.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).where(F.col("r__") <= n).drop("r__", "salt__")


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    m = np.maximum(np.asarray(n, float), 2)
    return np.where(np.asarray(n) < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m)


def grow_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> np.ndarray:
    """Isolation trees as one array (tree, node, 4): feature (-1: leaf), cut, and depth plus expected rest for leaves; children of i are 2i+1 and 2i+2.

    Each tree draws its own rows; where there are enough, no two trees share one.
    """
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    dealt = rng.permutation(len(x))[: trees * size].reshape(trees, size) if len(x) >= trees * size else None
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    out = np.full((trees, (2 << depth) - 1, 3), -1.0)
    for t in range(trees):
        todo = [(0, rng.choice(len(x), size, replace=False) if dealt is None else dealt[t], 0)]
        while todo:
            node, rows, d = todo.pop()
            span = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
            wide = np.flatnonzero(span > 0)
            if d == depth or len(rows) <= 1 or not len(wide):
                out[t, node, 2] = d + path_length(len(rows))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(x[rows, f].min(), x[rows, f].max())
            out[t, node, :2] = f, cut
            left = x[rows, f] < cut
            todo += [(2 * node + 1, rows[left], d + 1), (2 * node + 2, rows[~left], d + 1)]
    return out


def forest_score(forest: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Anomaly score in (0, 1]; above one half is unusual."""
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = tree[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            right = x[np.arange(len(x)), np.maximum(f, 0)] >= tree[at, 1]
            at = np.where(inner, 2 * at + 1 + right, at)
        total += tree[at, 2]
    return 2 ** (-(total / len(forest)) / max(float(path_length(size)), 1e-9))


#: Rows of one key that are scored together.
RUN = 20_000


def scored_by_model(rows: DataFrame, models: DataFrame, key: str, out: str, score) -> DataFrame:
    """rows with a column `out` = score(rows of a key, the key's model row). A key's rows are dealt into runs of about RUN, each of which meets the model once."""
    runs = rows.groupBy(key).agg(F.count("*").alias("n__")).select(key, F.ceil(F.col("n__") / RUN).cast("int").alias("runs__"))
    left = rows.join(runs, key).withColumn("run__", F.pmod(F.xxhash64(F.lit(37), TIE), F.col("runs__"))).drop("runs__")
    right = models.join(runs, key).withColumn("run__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs__").cast("long") - 1))).drop("runs__")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.drop(columns="run__")
        a[out] = score(a, b.iloc[0]) if len(a) and len(b) else np.zeros(len(a))
        return a if len(b) else a.iloc[:0]

    schema = T.StructType([*left.drop("run__").schema.fields, T.StructField(out, T.DoubleType())])
    return left.groupBy(key, "run__").cogroup(right.groupBy(key, "run__")).applyInPandas(meet, schema)


def isolation_forest(df: DataFrame, cols: list[str], key: str, contamination: float = 0.05, least: int = 1000, trees: int = 100, sample: int = 256) -> DataFrame:
    """decision (negative: unusual), is_anomaly and severity for all rows of keys with at least `least` rows.

    A key's trees grow from `sample` rows each, drawn from all rows of the key (for keys above trees * sample
    rows, from that many smallest hashes, cut into disjoint samples), and meet the key's rows in bounded runs. The cut is the
    key's contamination quantile.
    """
    fresh(df, "decision", "is_anomaly", "severity")
    enough = df.groupBy(key).agg(F.count("*").alias("n__")).where(F.col("n__") >= least).select(key)
    usable = df.join(enough, key, "left_semi")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(TIE)[cols].to_numpy(float)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "size__": [min(sample, len(x))], "forest__": [grow_forest(x, trees, sample).astype(np.float32).tobytes()]})

    kind = df.schema[key].dataType.simpleString()
    forests = sampled(usable.select(key, TIE, *cols), [key], trees * sample).groupBy(key).applyInPandas(grow, f"{key} {kind}, size__ int, forest__ binary")

    def decide(rows: pd.DataFrame, model: pd.Series) -> np.ndarray:
        return 0.5 - forest_score(np.frombuffer(model["forest__"], np.float32).reshape(trees, -1, 3), rows[cols].to_numpy(float), int(model["size__"]))

    scored = scored_by_model(usable, forests, key, "decision", decide)
    cut = scored.groupBy(key).agg(F.percentile_approx("decision", F.lit(contamination), F.lit(10_000)).alias("cut__"))
    out = scored.join(cut, key).withColumn("is_anomaly", F.col("decision") <= F.col("cut__")).drop("cut__")
    severity = F.when(~F.col("is_anomaly"), "NORMAL").when(F.col("decision") < -0.5, "CRITICAL").when(F.col("decision") < -0.3, "MAJOR").when(F.col("decision") < -0.1, "MINOR").otherwise("WARNING")
    return out.withColumn("severity", severity)


def nearest(q: np.ndarray, t: np.ndarray, weight: np.ndarray, k: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of t, squared distance and weight used, for the nearest rows of t until their weights reach k. Equal distances go by the row of t; with own, q is t and a row counts one time less for itself."""
    out, keep = [], min(k + own, len(t))
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        d = np.zeros((len(part), len(t)))
        for c in range(t.shape[1]):
            d += (part[:, c, None] - t[None, :, c]) ** 2
        r, i = np.nonzero(d <= np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep])
        order = np.lexsort((i, d[r, i], r))
        r, i = r[order], i[order]
        w = weight[i] - (own & (i == r + a))
        before = np.cumsum(w) - w
        used = np.minimum(w, k - (before - before[np.searchsorted(r, r)]))
        hit = used > 0
        out.append((r[hit] + a, i[hit], d[r, i][hit], used[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def neighbor_links(points: DataFrame, cols: list[str], key: str, k: int, cell: int = 4096) -> DataFrame:
    """key, id, near, d, w: the k nearest rows of each point among all points of its key (columns key, id, w rows that are equal, cols), w of them at near.

    Points lie in cells of about `cell`, cut along the first column. A point searches its own cell, which bounds
    the distance to its k-th neighbour, and then only the cells whose box comes within that bound: exact, with
    work in proportion to the points where the bound is short against a cell.
    """
    kind, id_kind = points.schema[key].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    parts = max(1, -(-points.count() // cell))
    points = cut(points.repartitionByRange(parts, key, cols[0], "id").withColumn("cell", F.spark_partition_id()))
    schema = f"{key} {kind}, id {id_kind}, near {id_kind}, d2 double, w long"

    def links(q: pd.DataFrame, t: pd.DataFrame, own: bool) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({c: [] for c in (key, "id", "near", "d2", "w")})
        t = t.sort_values("id")
        q = t if own else q
        r, i, d, w = nearest(q[cols].to_numpy(float), t[cols].to_numpy(float), t["w"].to_numpy(np.int64), k, own)
        if not own:
            within = d <= q["reach"].to_numpy()[r]
            r, i, d, w = r[within], i[within], d[within], w[within]
        return pd.DataFrame({key: t[key].iloc[0], "id": q["id"].to_numpy()[r], "near": t["id"].to_numpy()[i], "d2": d, "w": w})

    at_home = cut(points.groupBy(key, "cell").applyInPandas(lambda t: links(t, t, True), schema))
    reach = at_home.groupBy(key, "id").agg(F.when(F.sum("w") >= k, F.max("d2")).alias("reach"))
    known = cut(points.join(reach, [key, "id"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))))
    gap = lambda lo, hi, lo2, hi2: F.greatest(lo2 - hi, lo - hi2, F.lit(0.0)) ** 2
    sides = [f(c).alias(f"{n}{j}__") for j, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = cut(known.groupBy(key, "cell").agg(*sides, F.max("reach").alias("most__")))
    other = boxes.select(key, F.col("cell").alias("to"), *[F.col(f"{n}{j}__").alias(f"{n}{j}_to__") for j in range(len(cols)) for n in ("lo", "hi")])
    span = lambda j: (F.col(f"lo{j}_to__"), F.col(f"hi{j}_to__"))
    total = lambda gaps: reduce(Column.__add__, gaps)
    meet = boxes.join(other, key).where((F.col("cell") != F.col("to")) & (total([gap(F.col(f"lo{j}__"), F.col(f"hi{j}__"), *span(j)) for j in range(len(cols))]) <= F.col("most__")))
    meet = meet.select(key, "cell", "to", *other.columns[2:])
    visits = known.join(meet, [key, "cell"]).where(total([gap(F.col(c), F.col(c), *span(j)) for j, c in enumerate(cols)]) <= F.col("reach"))
    visits = cut(visits.select(key, F.col("to").alias("cell"), "id", "reach", *cols))
    runs = visits.groupBy(key, "cell").agg(F.ceil(F.count("*") / RUN).alias("runs__"))
    q = visits.join(runs, [key, "cell"]).withColumn("run__", F.pmod(F.xxhash64(F.lit(41), "id"), F.col("runs__"))).drop("runs__")
    t = points.join(runs, [key, "cell"]).withColumn("run__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs__") - 1))).drop("runs__")
    abroad = q.groupBy(key, "cell", "run__").cogroup(t.groupBy(key, "cell", "run__")).applyInPandas(lambda a, b: links(a, b, False), schema)
    before = F.coalesce(F.sum("w").over(Window.partitionBy(key, "id").orderBy("d2", "near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = at_home.unionByName(abroad).withColumn("w", F.least(F.col("w"), k - before)).where("w > 0")
    return best.select(key, "id", "near", F.sqrt("d2").alias("d"), "w")


def lof(df: DataFrame, cols: list[str], key: str, k: int = 20, contamination: float = 0.05, cell: int = 4096) -> DataFrame:
    """lof and is_anomaly of all rows: the local outlier factor among all rows of the row's key, and whether it is above the key's (1 - contamination) quantile.

    Equal rows are one point that counts as often as it occurs. Keys of up to k rows use all their rows; a key's
    only row has the factor 1. Rows with a null or NaN value, or without a key, have no factor and are no neighbours.
    """
    fresh(df, "lof", "is_anomaly")
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]) & F.col(key).isNotNull()
    names = [f"x{j}__" for j in range(len(cols))]
    rows = df.withColumns({n: F.when(whole, F.col(c).cast("double")) for n, c in zip(names, cols, strict=True)})
    points = cut(rows.where(whole).groupBy(key, *names).agg(F.min(TIE).alias("id"), F.count("*").alias("w")))
    links = cut(neighbor_links(points, names, key, k, cell))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    reach = links.groupBy(key, F.col("id").alias("near")).agg(F.max("d").alias("reach"))
    density = cut(links.join(reach, [key, "near"]).groupBy(key, "id").agg((1 / F.greatest(mean(F.greatest("reach", "d")), F.lit(1e-10))).alias("density")))
    around = links.join(density.withColumnRenamed("id", "near"), [key, "near"]).groupBy(key, "id").agg(mean(F.col("density")).alias("around"))
    factors = points.join(around.join(density, [key, "id"]), [key, "id"], "left").select(key, *names, F.coalesce(F.col("around") / F.col("density"), F.lit(1.0)).alias("lof"))
    scored = rows.join(factors, [key, *names], "left")
    limit = scored.groupBy(key).agg(F.percentile_approx("lof", F.lit(1 - contamination), F.lit(10_000)).alias("cut__"))
    return scored.join(limit, key, "left").select(*df.columns, "lof", F.coalesce(F.col("lof") > F.col("cut__"), F.lit(False)).alias("is_anomaly"))


def one_class_boundary(df: DataFrame, cols: list[str], nu: float = 0.05, features: int = 64, sample: int = 10_000, seed: int = 5) -> DataFrame:
    """decision and is_anomaly: a linear boundary over random Fourier features, fitted on at most `sample` rows (smallest hashes), scored on all."""
    fresh(df, "decision", "is_anomaly")
    rows = df.select(*cols, TIE).dropna().orderBy(F.xxhash64(F.lit(3), TIE), TIE).limit(sample).toPandas()
    x = rows[cols].to_numpy(float)
    mean, std = (x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)) if len(x) else (np.zeros(len(cols)), np.ones(len(cols)))
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 / len(cols)), (len(cols), features)), rng.uniform(0, 2 * np.pi, features)
    lift = lambda a: np.sqrt(2 / features) * np.cos((a - mean) / std @ w + b)
    z = lift(x) if len(x) else np.zeros((1, features))
    v, rho = z.mean(0), 0.0
    for step in range(200):
        rho = np.quantile(z @ v, nu)
        grad = v - z[z @ v < rho].sum(0) / max(nu * len(z), 1)
        v = v - grad / (1 + step)
    rho = float(np.quantile(z @ v, nu))

    @pandas_udf("double")
    def decide(*xs: pd.Series) -> pd.Series:
        return pd.Series(lift(np.stack([c.to_numpy(float) for c in xs], axis=1)) @ v - rho)

    return df.withColumn("decision", decide(*cols)).withColumn("is_anomaly", F.col("decision") < 0)


def reconstruction_error(df: DataFrame, cols: list[str], components: int = 2, pct: float = 0.95) -> DataFrame:
    """reconstruction_error of each complete row rebuilt from its principal components, flagged above the percentile, with severity and the three worst features.

    Without a complete row the result is empty. A column of that name, is_anomaly, severity or top_features in df is an error.
    """
    fresh(df, "reconstruction_error", "is_anomaly", "severity", "top_features")
    clean = df.dropna(subset=cols)
    row = clean.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if row["m0"] is None:  # no complete row: no components, and no errors to report
        none = F.lit(None)
        return clean.where("false").select(*df.columns, none.cast("double").alias("reconstruction_error"), none.cast("boolean").alias("is_anomaly"), none.cast("string").alias("severity"), none.cast("array<string>").alias("top_features"))
    z = clean.withColumns({f"z{i}__": (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(cols)})
    packed = VectorAssembler(inputCols=[f"z{i}__" for i in range(len(cols))], outputCol="v__").transform(z)
    model = PCA(k=components, inputCol="v__", outputCol="p__").fit(packed)
    pc = model.pc.toArray()
    out = model.transform(packed).withColumn("p__", vector_to_array("p__"))
    back = [reduce(Column.__add__, [F.col("p__")[j] * float(pc[i, j]) for j in range(components)]) for i in range(len(cols))]
    out = out.withColumns({f"e{i}__": (F.col(f"z{i}__") - back[i]) ** 2 for i in range(len(cols))})
    error = reduce(Column.__add__, [F.col(f"e{i}__") for i in range(len(cols))]) / len(cols)
    worst = F.slice(F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"e{i}__").alias("e"), F.lit(c).alias("feature")) for i, c in enumerate(cols)]))), 1, 3)
    out = out.withColumn("reconstruction_error", error).withColumn("top_features", F.transform(worst, lambda s: s["feature"]))
    cut = out.agg(F.percentile_approx("reconstruction_error", F.lit(pct), F.lit(10_000)).alias("threshold__"))
    out = out.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("reconstruction_error") > F.col("threshold__"))  # one row
    ratio = F.col("reconstruction_error") / F.col("threshold__")
    severity = F.when(~F.col("is_anomaly"), "NORMAL").when(ratio >= 3, "CRITICAL").when(ratio >= 2, "MAJOR").when(ratio >= 1.5, "MINOR").otherwise("WARNING")
    return out.withColumn("severity", severity).select(*df.columns, "reconstruction_error", "is_anomaly", "severity", "top_features")


@appends("ensemble_score", "votes", "is_anomaly", "severity")
def ensemble_online(df: DataFrame, scores: list[str], flags: list[str], keys: list[str], history: int = 1000) -> DataFrame:
    """Mean of the scores scaled by the 5th and 95th percentiles of the last rows (clipped scores below 10 rows); anomaly at two votes.

    Keys are handled in runs, each with the rows before it, and a run keeps its last rows sorted while it moves on.
    """
    rows = placed(df, keys, ["time", TIE])
    parts = runs(rows, history - 1)
    bounds = [f"{q}{i}__" for i in range(len(scores)) for q in ("lo", "hi")]
    kept = [*df.columns, "i__", *bounds]

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i__")
        for i, s in enumerate(scores):
            found = rolling_quantiles(pdf[s].to_numpy(float), history, [0.05, 0.95])
            pdf[f"lo{i}__"], pdf[f"hi{i}__"] = found[:, 0], found[:, 1]
        return pdf.loc[pdf["own__"], kept]

    schema = T.StructType([*df.schema.fields, T.StructField("i__", T.LongType()), *[T.StructField(b, T.DoubleType()) for b in bounds]])
    out = parts.groupBy(*keys, "run__").applyInPandas(scale, schema).withColumn("n__", F.least(F.col("i__") + 1, F.lit(history)))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    scaled = [F.when((F.col("n__") < 10) | (F.col(f"hi{i}__") <= F.col(f"lo{i}__")), clip(F.col(s))).otherwise(clip((F.col(s) - F.col(f"lo{i}__")) / (F.col(f"hi{i}__") - F.col(f"lo{i}__")))) for i, s in enumerate(scores)]
    out = out.withColumns({"ensemble_score": reduce(Column.__add__, scaled) / len(scores), "votes": reduce(Column.__add__, [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags])})
    e = F.col("ensemble_score")
    severity = F.when(F.col("votes") < 2, "NORMAL").when(e >= 0.95, "CRITICAL").when(e >= 0.8, "MAJOR").when(e >= 0.6, "WARNING").otherwise("INFO")
    return out.select(*df.columns, "ensemble_score", "votes", (F.col("votes") >= 2).alias("is_anomaly"), severity.alias("severity"))


@appends("ensemble_score", "votes", "is_anomaly", "two_agree", "all_agree")
def ensemble_batch(df: DataFrame, scores: list[str], pct: float = 0.95, votes: int = 3) -> DataFrame:
    """Scores scaled to 0..1 over all rows, each flagged at its percentile; mean, number of flags, and whether two, three or all agree."""
    bounds = quantiles(df, scores, [0.0, 1.0, pct])
    out = df.withColumns({f"{n}{i}__": F.lit(v).cast("double") for i, s in enumerate(scores) for n, v in zip("abq", bounds[s], strict=True)})
    scaled = [F.when(F.col(f"b{i}__") > F.col(f"a{i}__"), (F.col(s) - F.col(f"a{i}__")) / (F.col(f"b{i}__") - F.col(f"a{i}__"))).otherwise(0.0) for i, s in enumerate(scores)]
    n = reduce(Column.__add__, [(F.col(s) > F.col(f"q{i}__")).cast("int") for i, s in enumerate(scores)])
    return out.select(*df.columns, (reduce(Column.__add__, scaled) / len(scores)).alias("ensemble_score"), n.alias("votes")).withColumns({"is_anomaly": F.col("votes") >= votes, "two_agree": F.col("votes") >= 2, "all_agree": F.col("votes") == len(scores)})


@appends("ma5", "ma15")
def score_trend(df: DataFrame, keys: list[str], score: str = "score", tie: str = TIE) -> DataFrame:
    w = _ordered(keys, tie)
    return df.withColumns({"ma5": F.avg(score).over(w.rowsBetween(-4, 0)), "ma15": F.avg(score).over(w.rowsBetween(-14, 0))})


def make_alerts(df: DataFrame, scores: list[str]) -> DataFrame:
    """Detections that are not NORMAL as alerts: votes, the algorithm with the highest score, a message."""
    top = F.array_max(F.array(*[F.struct(F.col(s).alias("score"), F.lit(s).alias("name")) for s in scores]))["name"]
    out = df.where("severity <> 'NORMAL'").withColumn("top_algorithm", top)
    return out.select(F.concat(F.lit("ALERT-"), F.col(TIE).cast("string")).alias("alert_id"), "equipment_id", "time", "severity", "votes", "top_algorithm", F.format_string("%s: %d votes, led by %s", "severity", "votes", "top_algorithm").alias("message"))


def anomaly_regions(df: DataFrame, keys: list[str], gap: int = 2, tie: str = TIE) -> DataFrame:
    """Anomalous rows at most `gap` positions apart as one region: first and last position and time, and size."""
    w = _ordered(keys, tie)
    hits = df.withColumn("i__", F.row_number().over(w)).where("is_anomaly")
    h = Window.partitionBy(*keys).orderBy("i__")
    hits = hits.withColumn("r__", F.sum((F.col("i__") - F.lag("i__").over(h) > gap).cast("int")).over(h))
    g = hits.groupBy(*keys, F.coalesce("r__", F.lit(0)).alias("region")).agg(F.min("i__").alias("first_row"), F.max("i__").alias("last_row"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("size"))
    return g


def state_change_events(df: DataFrame, sensors: list[str], keys: list[str], tie: str = TIE) -> DataFrame:
    """ANOMALY_START and ANOMALY_END edges, and SENSOR_HIGH or SENSOR_LOW beyond two standard deviations."""
    w, whole = _ordered(keys, tie), Window.partitionBy(*keys)
    before = F.coalesce(F.lag("is_anomaly").over(w), F.lit(False))
    edge = df.select(*keys, "time", F.when(F.col("is_anomaly") & ~before, "ANOMALY_START").when(~F.col("is_anomaly") & before, "ANOMALY_END").alias("event_type")).where(F.col("event_type").isNotNull())
    out = df.withColumns({f"{n}{i}__": f(s).over(whole) for i, s in enumerate(sensors) for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    sides = [F.when(F.col(s) > F.col(f"m{i}__") + 2 * F.col(f"s{i}__"), f"{s.upper()}_HIGH").when(F.col(s) < F.col(f"m{i}__") - 2 * F.col(f"s{i}__"), f"{s.upper()}_LOW") for i, s in enumerate(sensors)]
    return edge.unionByName(out.select(*keys, "time", F.explode(F.array_compact(F.array(*sides))).alias("event_type")))


def pre_anomaly_change(df: DataFrame, sensors: list[str], keys: list[str], rows: int = 10, tie: str = TIE) -> DataFrame:
    """At each anomaly start: change in percent of the mean of the rows just before against the same number before those."""
    w = _ordered(keys, tie)
    start = F.col("is_anomaly") & ~F.coalesce(F.lag("is_anomaly").over(w), F.lit(False))
    near, far = w.rowsBetween(-rows, -1), w.rowsBetween(-2 * rows, -rows - 1)
    change = {f"{s}_change_pct": (F.avg(s).over(near) - F.avg(s).over(far)) / F.abs(F.nullif(F.avg(s).over(far), F.lit(0.0))) * 100 for s in sensors}
    return df.withColumns({"start__": start, **change}).where("start__").select(*keys, "time", *change)


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and np.isfinite(t) else (0.0 if np.isinf(t) else float("nan"))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 and d2 > 0 else 1.0


def with_p_value(df: DataFrame, f, out: str, *cols: str) -> DataFrame:
    """A column of p-values on rows of results (few, already aggregated)."""

    @pandas_udf("double")
    def p(*xs: pd.Series) -> pd.Series:
        return pd.Series([f(*v) if all(x is not None and x == x for x in v) else None for v in zip(*xs, strict=True)], dtype=float)

    return df.withColumn(out, p(*cols))


def anomaly_contribution(df: DataFrame, sensors: list[str]) -> DataFrame:
    """Per sensor: difference of means of anomalous and normal rows, pooled t, its p-value, Cohen's d; by size of d. One pass over the rows."""
    tall = df.select("is_anomaly", F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("v")) for s in sensors])).alias("x"))
    va, vn = F.when(F.col("is_anomaly"), F.col("x.v")), F.when(~F.col("is_anomaly"), F.col("x.v"))
    g = tall.groupBy(F.col("x.sensor").alias("sensor")).agg(F.count(va).alias("na"), F.count(vn).alias("nn"), F.avg(va).alias("ma"), F.avg(vn).alias("mn"), F.var_samp(va).alias("xa"), F.var_samp(vn).alias("xn")).where("na >= 2 AND nn >= 2")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("xa") + (F.col("nn") - 1) * F.col("xn")) / (F.col("na") + F.col("nn") - 2))
    g = g.withColumns({"mean_diff": F.col("ma") - F.col("mn"), "pooled__": pooled, "dof__": (F.col("na") + F.col("nn") - 2).cast("double")})
    g = g.withColumns({"cohens_d": F.col("mean_diff") / F.col("pooled__"), "t_stat": F.col("mean_diff") / (F.col("pooled__") * F.sqrt(1 / F.col("na") + 1 / F.col("nn")))})
    g = with_p_value(g, t_p_value, "p_value", "t_stat", "dof__")
    place = F.rank().over(Window.orderBy(F.abs("cohens_d").desc(), "sensor"))  # a row for each sensor
    return g.select("sensor", "mean_diff", "t_stat", "p_value", "cohens_d", place.alias("place"))
