"""Features and data profiles. All windows of one call share a single sort per key."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import added, appends, corr, fresh
from millrace.operators.graph import cut
from millrace.operators.order import runs
from millrace.operators.spectrum import WHOLE, seasonality, series_of

TIE = "measurement_id"


def _ordered(keys: list[str], tie: str = TIE):
    return Window.partitionBy(*keys).orderBy("time", tie)


def rolling_features(df: DataFrame, cols: list[str], keys: list[str], widths: tuple[int, ...] = (5, 10, 30, 60), tie: str = TIE) -> DataFrame:
    """Mean, sample std, max, min, range over the last rows."""
    w, new = _ordered(keys, tie), {}
    for c in cols:
        for n in widths:
            f = w.rowsBetween(-(n - 1), 0)
            new |= {f"{c}_mean_{n}": F.avg(c).over(f), f"{c}_std_{n}": F.stddev_samp(c).over(f), f"{c}_max_{n}": F.max(c).over(f), f"{c}_min_{n}": F.min(c).over(f), f"{c}_range_{n}": F.max(c).over(f) - F.min(c).over(f)}
    return added(df, new)


def change_features(df: DataFrame, cols: list[str], keys: list[str], lags: tuple[int, ...] = (1, 5, 10), tie: str = TIE) -> DataFrame:
    """First and second-lag differences, percent change, absolute difference, lags and differences to them."""
    w, new = _ordered(keys, tie), {}
    for c in cols:
        x, one, two = F.col(c), F.lag(c, 1).over(w), F.lag(c, 2).over(w)
        new |= {f"{c}_diff1": x - one, f"{c}_diff2": x - two, f"{c}_pct": F.when(one != 0, (x - one) / one), f"{c}_absdiff": F.abs(x - one)}
        new |= {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in lags} | {f"{c}_lagdiff_{k}": x - F.lag(c, k).over(w) for k in lags}
    return added(df, new)


def shape_features(df: DataFrame, cols: list[str], keys: list[str], widths: tuple[int, ...] = (30, 60), tie: str = TIE) -> DataFrame:
    """Bias-corrected skewness and kurtosis (from 3 and 4 rows on), median, coefficient of variation and z over the last rows."""
    w, new = _ordered(keys, tie), {}
    for c in cols:
        for k in widths:
            f = w.rowsBetween(-(k - 1), 0)
            n, mean, std = F.count(c).over(f), F.avg(c).over(f), F.stddev_samp(c).over(f)
            moving = F.max(c).over(f) > F.min(c).over(f)
            g1, g2 = F.skewness(c).over(f), F.kurtosis(c).over(f)
            new |= {
                f"{c}_skew_{k}": F.when((n >= 3) & moving, g1 * F.sqrt(n * (n - 1)) / (n - 2)), f"{c}_kurt_{k}": F.when((n >= 4) & moving, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
                f"{c}_median_{k}": F.percentile(c, F.lit(0.5)).over(f), f"{c}_cv_{k}": F.when(mean != 0, std / mean), f"{c}_z_{k}": F.when(std > 0, (F.col(c) - mean) / std),
            }
    return added(df, new)


def spectrum(x: np.ndarray, width: int) -> np.ndarray:
    """(row, 3): energy, peak frequency and entropy of the spectrum of the trailing window; zeros below four points."""
    out = np.zeros((len(x), 3))

    def put(rows: np.ndarray, blocks: np.ndarray) -> None:
        power = np.abs(np.fft.rfft(blocks, axis=1)) ** 2
        power = power[:, 1:]
        total = power.sum(axis=1)
        share = power / np.where(total > 0, total, 1)[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        out[rows] = np.stack([total, np.fft.rfftfreq(blocks.shape[1])[1:][power.argmax(axis=1)] * (total > 0), entropy], axis=1)

    for n in range(4, min(width, len(x) + 1)):
        put(np.array([n - 1]), x[None, :n])
    if len(x) >= width:
        whole = np.lib.stride_tricks.sliding_window_view(x, width)
        for a in range(0, len(whole), 4096):
            put(np.arange(width - 1 + a, width - 1 + a + len(whole[a : a + 4096])), whole[a : a + 4096])
    return out


def peaks(x: np.ndarray, width: int, distance: int = 2) -> np.ndarray:
    """(row, 2): number and mean height of local maxima at or above the trailing window's mean, at least `distance` apart (the higher first, of equal ones the earlier)."""
    out = np.zeros((len(x), 2))
    if len(x) < 3 or width < 3:
        return out
    top = np.zeros(len(x), bool)
    top[1:-1] = (x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])
    windows, tops = (np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(width - 1, fill), v]), width) for v, fill in ((x, np.nan), (top, False)))
    for a in range(0, len(x), 4096):
        w, at = np.ascontiguousarray(windows[a : a + 4096]), tops[a : a + 4096].copy()
        at[:, [0, -1]] = False
        total = np.zeros(len(w))
        for v in w.T:  # in the order of the rows, as SQL adds: a peak may be exactly as high as the mean
            total += np.where(np.isnan(v), 0.0, v)
        mean = total / np.minimum(np.arange(a, a + len(w)) + 1, width)
        with np.errstate(invalid="ignore"):
            at &= w >= mean[:, None]
        if distance > 2:  # strict maxima are two apart anyway
            left, at = np.where(at, w, -np.inf), np.zeros_like(at)
            while (open_rows := np.flatnonzero(left.max(axis=1) > -np.inf)).size:
                best = left[open_rows].argmax(axis=1)
                at[open_rows, best] = True
                left[open_rows] = np.where(np.abs(np.arange(width) - best[:, None]) < distance, -np.inf, left[open_rows])
        n = at.sum(axis=1)
        out[a : a + 4096, 0] = n
        out[a : a + 4096, 1] = np.where(n, np.where(at, w, 0.0).sum(axis=1) / np.maximum(n, 1), 0.0)
    return out


def _per_key(df: DataFrame, cols: list[str], keys: list[str], names: tuple[str, ...], f, width: int, tie: str) -> DataFrame:
    """Columns that f(values, width) adds, in runs of one key split by time: each run carries the width - 1 rows before it, so long keys are many groups."""
    run = 50_000
    fresh(df, *[f"{c}_{n}" for c in cols for n in names])
    rows = df.withColumn("i__", F.row_number().over(_ordered(keys, tie)) - 1).withColumn("run__", F.floor(F.col("i__") / run))
    before = rows.where(F.col("i__") % run >= run - (width - 1)).withColumn("run__", F.col("run__") + 1)
    marked = rows.withColumn("own__", F.lit(True)).unionByName(before.withColumn("own__", F.lit(False)))
    extra = [f"{c}_{n}" for c in cols for n in names]
    kept = df.columns

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i__")
        for c in cols:
            made = f(pdf[c].fillna(0).to_numpy(float), width)
            for k, n in enumerate(names):
                pdf[f"{c}_{n}"] = made[:, k]
        return pdf[pdf["own__"]][[*kept, *extra]]

    schema = T.StructType([*df.schema.fields, *[T.StructField(e, T.DoubleType()) for e in extra]])
    return marked.groupBy(*keys, "run__").applyInPandas(work, schema)


def fft_features(df: DataFrame, cols: list[str], keys: list[str], width: int = 60, tie: str = TIE) -> DataFrame:
    return _per_key(df, cols, keys, ("fft_energy", "fft_peak", "fft_entropy"), spectrum, width, tie)


def peak_features(df: DataFrame, cols: list[str], keys: list[str], width: int = 30, tie: str = TIE) -> DataFrame:
    return _per_key(df, cols, keys, ("peak_count", "peak_height"), peaks, width, tie)


def all_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, r, n for all pairs, in one pass (in chunks of 300 pairs)."""
    parts = []
    for at in range(0, len(pairs), 300):
        some = pairs[at : at + 300]
        row = df.agg(*[x for i, (a, b) in enumerate(some) for x in (corr(a, b).alias(f"r{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}"))])
        parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(some)])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def interaction_features(df: DataFrame, cols: list[str], top_n: int = 5) -> DataFrame:
    """Ratio, product and difference of the most correlated pairs of columns (a row for each pair reaches the driver)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    best = all_correlations(df, pairs).orderBy(F.abs(F.coalesce("r", F.lit(0.0))).desc(), "a", "b").limit(top_n).collect()
    new: dict[str, Column] = {}
    for r in best:
        a, b = F.col(r["a"]), F.col(r["b"])
        new |= {f"{r['a']}_over_{r['b']}": F.when(b != 0, a / b), f"{r['a']}_times_{r['b']}": a * b, f"{r['a']}_minus_{r['b']}": a - b}
    return added(df, new)


def feature_ranking(df: DataFrame, cols: list[str], target: str, constant: float = 0.0) -> DataFrame:
    """Absolute correlation of each feature with the label, with its place; `constant` where one of them is constant or NaN (as a NaN it comes first), null without rows that have both if it is a NaN."""
    label = F.col(target).cast("double")
    row = df.agg(*[x for i, c in enumerate(cols) for x in (corr(c, label).alias(f"r{i}"), F.count_if(F.col(c).isNotNull() & label.isNotNull()).alias(f"n{i}"))])

    def one(i: int) -> Column:
        r = F.coalesce(F.nanvl(f"r{i}", F.lit(constant)), F.lit(constant))
        return F.abs(F.when(F.col(f"n{i}") > 0, r) if math.isnan(constant) else r)

    out = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), one(i).alias("importance")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))  # a row for each feature


def select_top_features(df: DataFrame, cols: list[str], originals: list[str], target: str, n: int) -> DataFrame:
    top = [r["feature"] for r in feature_ranking(df, cols, target).where(F.col("place") <= n).collect()]
    keep = {*top, *originals, target}
    return df.select(*[c for c in df.columns if c in keep or c not in cols])


def fill_missing(df: DataFrame, cols: list[str], keys: list[str], how: str = "interpolate", tie: str = TIE) -> DataFrame:
    """Nulls by linear interpolation over row positions ("interpolate"), the last value ("ffill"), the mean ("mean"), or next, last, then 0 ("bfill").

    The next value is the last one of the rows in reverse: a frame that only grows, so each row is added once. One that
    reaches from a row to the key's end would be gone through again for each row.
    """
    w, whole = _ordered(keys, tie), Window.partitionBy(*keys)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.col("i__").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last, nxt = (lambda c: F.last(c, ignorenulls=True).over(past)), (lambda c: F.last(c, ignorenulls=True).over(ahead))
    if how == "ffill":
        return df.withColumns({c: last(c) for c in cols})
    if how == "mean":
        return df.withColumns({c: F.coalesce(c, F.avg(c).over(whole)) for c in cols})
    fresh(df)
    out = df.withColumn("i__", F.row_number().over(w))
    if how == "bfill":
        return out.withColumns({c: F.coalesce(nxt(c), last(c), F.lit(0.0)) for c in cols}).drop("i__")
    new = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("i__"))
        a, b, ia, ib = last(c), nxt(c), last(at), nxt(at)
        new[c] = F.coalesce(F.col(c), a + (b - a) * (F.col("i__") - ia) / F.nullif(ib - ia, F.lit(0)), a, b)
    return out.withColumns(new).drop("i__")


def remove_outliers(df: DataFrame, cols: list[str], keys: list[str], z: float = 5.0, tie: str = TIE) -> DataFrame:
    """Values more than z sample standard deviations from the mean blanked, then interpolated."""
    whole = Window.partitionBy(*keys)
    far = lambda c: F.abs(F.col(c) - F.avg(c).over(whole)) > z * F.stddev_samp(c).over(whole)
    return fill_missing(df.withColumns({c: F.when(~F.coalesce(far(c), F.lit(False)), F.col(c)) for c in cols}), cols, keys, tie=tie)


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std over all rows; constants become 0. The statistics are one row."""
    stats = df.agg(*[f(c).alias(f"{n}{i}__") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.when(F.col(f"s{i}__") > 0, (F.col(c) - F.col(f"m{i}__")) / F.col(f"s{i}__")).otherwise(F.col(c) - F.col(f"m{i}__")) for i, c in enumerate(cols)}).select(*df.columns)


@appends("is_test")
def train_test_split(df: DataFrame, ratio: float = 0.2, keys: list[str] | None = None, temporal: bool = True, tie: str = TIE) -> DataFrame:
    """is_test: the last rows of each key by time, or rows by hash."""
    if not temporal:
        return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(42), tie), F.lit(10_000)) < int(ratio * 10_000))
    return df.withColumn("is_test", F.percent_rank().over(_ordered(keys or [], tie)) > 1 - ratio)


def data_characteristics(df: DataFrame, cols: list[str], keys: list[str], label: str = "is_anomaly", tie: str = TIE, whole: int = WHOLE) -> DataFrame:
    """Per key: rows, features, anomaly ratio, mean abs lag-1 autocorrelation, mean coefficient of variation, trend, missing ratio, mean abs pair correlation, seasonality.

    A column's series are its values without nulls. Autocorrelation takes series of more than 10 values, a trend more
    than 100, a season more than 1,000; means are over the columns that have the figure (0 if none has). Series are
    handled in runs, and spectra of more than `whole` values in blocks, so no task holds a key.
    """
    series = cut(series_of(df, cols, keys, tie))
    in_runs = runs(series, 1)
    before = F.lag("v").over(Window.partitionBy(*keys, "column__", "run__").orderBy("i__"))
    pairs = in_runs.withColumn("l__", before).where("own__")
    of = pairs.groupBy(*keys, "column__").agg(F.count("*").alias("n"), F.abs(corr("v", "l__")).alias("auto"), F.abs(corr("v", F.col("i__").cast("double"))).alias("trend"), (F.stddev_samp("v") / F.abs(F.nullif(F.avg("v"), F.lit(0.0)))).alias("cv"))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    seasons = seasonality(series, [*keys, "column__"], whole=whole).select(*keys, "column__", "is_seasonal")
    same = lambda a, b, ks: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in ks])
    both = of.join(seasons, same(of, seasons, [*keys, "column__"]), "left").select(*[of[k] for k in keys], "n", "auto", "trend", "cv", "is_seasonal")
    g = both.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("n") > 10, real("auto"))), F.lit(0.0)).alias("autocorrelation"), F.coalesce(F.avg(real("cv")), F.lit(0.0)).alias("mean_cv"),
        F.coalesce(F.max((F.col("n") > 100) & (real("trend") > 0.5)), F.lit(False)).alias("has_trend"), F.coalesce(F.max("is_seasonal"), F.lit(False)).alias("seasonality"),
    )
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    couples = [F.abs(corr(value(a), value(b))) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    some = F.filter(F.array(*couples), lambda r: r.isNotNull() & ~F.isnan(r)) if couples else F.array().cast("array<double>")
    absent = reduce(Column.__add__, [F.avg(value(c).isNull().cast("double")) for c in cols]) / len(cols)
    whole_rows = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("anomaly_ratio"), absent.alias("missing_ratio"), some.alias("couples__"))
    mean = F.coalesce(F.aggregate("couples__", F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size("couples__"), F.lit(0)), F.lit(0.0))
    out = whole_rows.join(g, same(whole_rows, g, keys), "left")
    none = {"autocorrelation": F.lit(0.0), "mean_cv": F.lit(0.0), "has_trend": F.lit(False), "seasonality": F.lit(False)}
    return out.select(*[whole_rows[k] for k in keys], "rows", "anomaly_ratio", "missing_ratio", mean.alias("pair_correlation"), *[F.coalesce(c, v).alias(c) for c, v in none.items()], F.lit(len(cols)).alias("features"))


def failure_features(df: DataFrame, cols: list[str], keys: list[str], width: int = 60, tie: str = TIE) -> DataFrame:
    """Statistics over full windows, changes, ratio to the mean and slope; rows without a full window go."""
    w = _ordered(keys, tie)
    f = w.rowsBetween(-(width - 1), 0)
    x, new = df.withColumn("i__", F.row_number().over(w).cast("double")), {}
    for c in cols:
        mean, before = F.avg(c).over(f), F.lag(c).over(w)
        new |= {f"{c}_mean": mean, f"{c}_std": F.stddev_samp(c).over(f), f"{c}_min": F.min(c).over(f), f"{c}_max": F.max(c).over(f), f"{c}_range": F.max(c).over(f) - F.min(c).over(f), f"{c}_diff": F.col(c) - before, f"{c}_pct": F.when(before != 0, (F.col(c) - before) / before), f"{c}_ratio": F.when(mean != 0, F.col(c) / mean), f"{c}_slope": F.regr_slope(c, "i__").over(f)}
    fresh(df, *new)
    return x.withColumns(new).where(F.col("i__") >= width).drop("i__")
