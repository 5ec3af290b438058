"""Relationship discovery: correlation, causality, event patterns, and what becomes of the results.

Pair statistics are one pass over the rows; only the small matrices of sums leave the executors.
Event patterns are joins and counts over n-grams of ordered sequences.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import added, corr, micros
from millrace.operators.anomaly import f_p_value, t_p_value, with_p_value
from millrace.operators.features import all_correlations
from millrace.operators.graph import cut
from millrace.operators.order import GROUP, STRIPS, average_ranks, discordant, quantiles

TIE = "measurement_id"


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r for every pair of columns, also each with itself."""
    base = average_ranks(df.select(*cols).dropna(), cols) if method == "spearman" else df
    out = all_correlations(base, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]])
    own = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(c) > 0, 1.0).alias("r"), F.lit(0).cast("long").alias("n")) for c in cols])).alias("x")).select("x.*")
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n")).unionByName(own).select("a", "b", "r")


def _significance(df: DataFrame, method: str, least: int, threshold: float, alpha: float) -> DataFrame:
    t = F.abs("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    out = df.where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r")).withColumns({"t__": F.coalesce(t, F.lit(float("inf"))), "d__": (F.col("n") - 2).cast("double")})
    out = with_p_value(out, t_p_value, "p_value", "t__", "d__")
    confidence = 0.5 * F.abs("r") + 0.3 * F.greatest(1 - F.col("p_value") / alpha, F.lit(0.0)) + 0.2 * F.least(F.col("n") / 1000, F.lit(1.0))
    return out.select("a", "b", F.lit(method).alias("method"), "r", "n", "p_value", ((F.abs("r") >= threshold) & (F.col("p_value") <= alpha)).alias("is_significant"), confidence.alias("confidence"))


def correlate_pairs(df: DataFrame, cols: list[str], methods: tuple[str, ...] = ("pearson", "spearman"), least: int = 100, threshold: float = 0.5, alpha: float = 0.05, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """a, b, method, r, n, p_value, is_significant, confidence of each pair with at least `least` complete rows (Spearman: rows complete in all columns)."""
    pairs = pairs or list(itertools.combinations(cols, 2))
    out = []
    for m in methods:
        base = average_ranks(df.select(*cols).dropna(), cols) if m == "spearman" else df
        out.append(_significance(all_correlations(base, pairs), m, least, threshold, alpha))
    return reduce(DataFrame.unionByName, out)


def kendall_pairs(df: DataFrame, cols: list[str], group: int = GROUP, strips: int = STRIPS) -> DataFrame:
    """a, b, tau (tau-b), p_value (two-sided, normal approximation with ties), n of each pair of columns, over rows that have both.

    Equal points are counted first; discordant pairs are counted strip by strip (order.discordant), ties by value, so no
    task holds a series. A column without spread gives null. NaN counts as null.
    """
    pairs = list(itertools.combinations(cols, 2))
    here = lambda c: F.col(c).cast("double")
    points = df.select(F.explode(F.array(*[F.struct(F.lit(str(i)).alias("g"), here(a).alias("x"), here(b).alias("y")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    points = cut(points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").groupBy("g", "x", "y").agg(F.count("*").alias("k")))
    t = F.col("t").cast("double")
    two = t * (t - 1)

    def ties(name: str, *by: str) -> DataFrame:
        of = points.groupBy("g", *by).agg(F.sum("k").alias("t")) if by != ("x", "y") else points.withColumnRenamed("k", "t")
        return of.groupBy("g").agg(F.sum(t).alias(f"n_{name}"), F.sum(two).alias(f"two_{name}"), F.sum(two * (t - 2)).alias(f"three_{name}"), F.sum(two * (2 * t + 5)).alias(f"five_{name}"))

    sums = ties("x", "x").join(ties("y", "y"), "g").join(ties("xy", "x", "y"), "g").join(discordant(points, group, strips), "g", "left")

    def tau(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a, b = pairs[int(r["g"])]
                n = r["n_x"]
                n0, n1, n2, n3 = n * (n - 1) / 2, r["two_x"] / 2, r["two_y"] / 2, r["two_xy"] / 2
                if n0 == n1 or n0 == n2:
                    out.append((a, b, None, None, int(n)))
                    continue
                s = n0 - n1 - n2 + n3 - 2 * float(r["d"] or 0)
                v = (n * (n - 1) * (2 * n + 5) - r["five_x"] - r["five_y"]) / 18 + r["two_x"] * r["two_y"] / (2 * n * (n - 1))
                v += r["three_x"] * r["three_y"] / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0.0
                out.append((a, b, s / math.sqrt((n0 - n1) * (n0 - n2)), math.erfc(abs(s) / math.sqrt(2 * v)), int(n)))
            yield pd.DataFrame(out, columns=["a", "b", "tau", "p_value", "n"])

    return sums.mapInPandas(tau, "a string, b string, tau double, p_value double, n long")  # a row for each pair


#: Rows of a series that one task holds at once.
STRETCH = 65_536


def stretches(df: DataFrame, cols: list[str], max_lag: int, time: str = "time", size: int = STRETCH) -> DataFrame:
    """t__ (place in time order, from 1), the columns, and block__: stretches of the series, each with the max_lag rows before it.

    No task holds the series: rows are dealt by ranges of time, places are those in the range plus the rows of the ranges
    before it, and the last rows of a stretch are copied to the next. Rows of one time go by their values.
    """
    size = max(size, max_lag)
    parts = cut(df.select(F.col(time).alias("o__"), *cols).repartitionByRange("o__", *cols).withColumn("part__", F.spark_partition_id()))
    sizes = parts.groupBy("part__").agg(F.count("*").alias("n__"))  # one row a shuffle partition
    before = sizes.select("part__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    inside = F.row_number().over(Window.partitionBy("part__").orderBy("o__", *cols))
    placed = parts.withColumn("i__", inside).join(F.broadcast(before), "part__").withColumn("t__", F.col("before__") + F.col("i__"))
    own = F.floor((F.col("t__") - 1) / size)
    near_end = (F.col("t__") - 1) % size >= size - max_lag
    return placed.select("t__", *cols, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))).alias("block__"))


def lagged(df: DataFrame, cols: list[str], max_lag: int, time: str = "time", size: int = STRETCH) -> DataFrame:
    """Rows in time order with lags of every column: columns t__ and c__0 ... c__max_lag."""
    w = Window.partitionBy("block__").orderBy("t__")
    x = stretches(df, cols, max_lag, time, size)
    lags = x.select("t__", "block__", *[(F.lag(c, k).over(w) if k else F.col(c)).cast("double").alias(f"{c}__{k}") for c in cols for k in range(max_lag + 1)])
    return lags.where(F.col("block__") == F.floor((F.col("t__") - 1) / max(size, max_lag))).drop("block__")


def gram(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sums of products of all columns and a leading 1, over rows without nulls: each task adds up its own, one small matrix a task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cols) + 1, len(cols) + 1))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, len(cols)))
            x = x[np.isfinite(x).all(axis=1)]
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    rows = df.select(*cols).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(cols) + 1, len(cols) + 1))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def granger(df: DataFrame, cols: list[str], max_lag: int = 10, alpha: float = 0.05, least: int = 500, time: str = "time", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """source, target, lag, f_stat, p_value, is_causal, confidence: does the past of source help to predict target?

    For each lag, rows from that lag on enter. One job adds up the products of all lagged columns over the rows that
    have all lags; the few rows before them are added for each lag, so every pair is a small solve on the driver.
    """
    spark = df.sparkSession
    base = df.select(time, *cols).dropna()
    # centred columns keep the sums of products accurate
    means = base.agg(F.count("*").alias("n__"), *[F.avg(c).alias(c) for c in cols]).first()
    schema = "source string, target string, lag int, f_stat double, p_value double, is_causal boolean, confidence double"
    n = means["n__"]
    if n < least:
        return spark.createDataFrame([], schema)
    lags = min(max_lag, n // 10)
    x = cut(lagged(base.select(time, *[(F.col(c) - F.lit(means[c])).alias(c) for c in cols]), cols, lags, time))
    names = [f"{c}__{k}" for c in cols for k in range(lags + 1)]
    whole = gram(x.where(F.col("t__") > lags), names)
    first = {r["t__"]: [1.0, *[r[c] for c in names]] for r in x.where(F.col("t__") <= lags).select("t__", *names).collect()}  # `lags` rows
    out = []
    for p in range(1, lags + 1):
        use = [f"{c}__{k}" for c in cols for k in range(p + 1)]
        own_places = [0, *[names.index(v) + 1 for v in use]]
        edge = np.array([[row[i] for i in own_places] for t, row in first.items() if t > p], float).reshape(-1, len(own_places))
        g = whole[np.ix_(own_places, own_places)] + edge.T @ edge
        at = {name: i + 1 for i, name in enumerate(use)}

        def rss(y: str, xs: list[str]) -> float:
            i = [0, *[at[v] for v in xs]]
            return float(g[at[y], at[y]] - g[i, at[y]] @ np.linalg.lstsq(g[np.ix_(i, i)], g[i, at[y]], rcond=None)[0])

        for s, t in pairs or itertools.permutations(cols, 2):
            own = [f"{t}__{k}" for k in range(1, p + 1)]
            r1, r2 = rss(f"{t}__0", own), rss(f"{t}__0", [*own, *[f"{s}__{k}" for k in range(1, p + 1)]])
            dof = g[0, 0] - 2 * p - 1
            f = (r1 - r2) / p / (r2 / dof) if r2 > 0 and dof > 0 else 0.0
            out.append((s, t, p, f, f_p_value(f, p, dof)))
    best = {}
    for row in out:
        k = row[:2]
        if k not in best or row[4] < best[k][4]:
            best[k] = row
    rows = [(s, t, p, float(f), float(q), bool(q < alpha), float(0.5 * (1 - q) + 0.3 * min(f / 10, 1) + 0.2 * min(n / 1000, 1))) for s, t, p, f, q in best.values()]
    return spark.createDataFrame(rows, schema)


def cross_correlation(df: DataFrame, cols: list[str], max_lag: int = 100, least: int = 2, threshold: float = 0.5, time: str = "time", direction: str = "lead", size: int = STRETCH) -> DataFrame:
    """source, target, lag, r, n: the shift with the largest abs(normalized cross-correlation); the leader is source ("lead"), or the follower ("follow").

    Each stretch of the series adds up its lagged products of all columns; what is collected has a number for each lag
    and pair of columns, whatever the rows. A null stays in its place and adds nothing; means, norm and n of a pair are
    over the rows that have both. Pairs without any spread have r 0.
    """
    spark, c = df.sparkSession, len(cols)
    df = cut(df.select(time, *cols))
    means = df.agg(*[F.avg(F.col(x).cast("double")).alias(x) for x in cols]).first()
    centred = df.select(time, *[(F.col(x).cast("double") - F.lit(means[x])).alias(x) for x in cols])
    size = max(size, max_lag)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t__")
        x, first = pdf[cols].to_numpy(float), int((pdf["t__"] - 1 < pdf["block__"] * size).sum())
        z = np.concatenate([np.nan_to_num(x), ~np.isnan(x)], axis=1)
        out = []
        for k in range(max_lag + 1):
            at = np.arange(max(first, k), len(z))
            out.append(z[at].T @ z[at - k])
        out.append((z[first:] ** 2).T @ z[first:])  # squares where the other column has a value
        k, i, j = np.indices((len(out), 2 * c, 2 * c))
        return pd.DataFrame({"k": k.ravel(), "i": i.ravel(), "j": j.ravel(), "v": np.array(out).ravel()})

    parts = stretches(centred, cols, max_lag, time, size).groupBy("block__").applyInPandas(sums, "k int, i int, j int, v double")
    total = np.zeros((max_lag + 2, 2 * c, 2 * c))
    for r in parts.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["k"], r["i"], r["j"]] = r["v"]
    rows = []
    for a, b in itertools.combinations(cols, 2):
        i, j = cols.index(a), cols.index(b)
        n = int(total[0, c + i, c + j])
        if not n:
            continue
        ma, mb = total[0, i, c + j] / n, total[0, j, c + i] / n
        norm = np.sqrt(max(total[-1, i, c + j] - n * ma**2, 0) * max(total[-1, j, c + i] - n * mb**2, 0))
        shifted = lambda i, j, mi, mj: (total[:, i, j] - mi * total[:, c + i, j] - mj * total[:, i, c + j] + mi * mj * total[:, c + i, c + j])[:-1]
        later, earlier = shifted(i, j, ma, mb), shifted(j, i, mb, ma)  # a behind b by k; b behind a by k
        r = np.concatenate([earlier[:0:-1], later]) / norm if norm > 1e-12 else np.zeros(2 * max_lag + 1)
        k = int(np.abs(r).argmax())
        lag = k - max_lag  # above 0: b leads a
        source, target = (b, a) if (lag > 0) == (direction == "lead") else (a, b)
        rows.append((source, target, abs(lag), float(r[k]), n))
    out = spark.createDataFrame(rows, "source string, target string, lag int, r double, n long")
    return out.where((F.col("lag") >= least) & (F.abs("r") >= threshold))


def rolling_correlation(df: DataFrame, pairs: list[tuple[str, str]], width: int, keys: list[str], tie: str = TIE) -> DataFrame:
    """Correlation over the `width` rows before each row."""
    w = Window.partitionBy(*keys).orderBy("time", tie).rowsBetween(-width, -1)
    return added(df, {f"corr_{a}_{b}": F.when(F.count(F.lit(1)).over(w) == width, corr(a, b, w)) for a, b in pairs})


def highly_correlated(df: DataFrame, cols: list[str], threshold: float = 0.8) -> DataFrame:
    out = all_correlations(df, list(itertools.combinations(cols, 2)))
    return out.where(F.abs("r") >= threshold).select("a", "b", "r").orderBy(F.abs("r").desc(), "a", "b")


def quantile_bins(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """Columns as bin numbers by exact quantiles."""
    bounds = quantiles(df, cols, [i / bins for i in range(1, bins)])
    place = lambda c: F.size(F.filter(F.array(*[F.lit(q) for q in bounds[c]]).cast("array<double>"), lambda q: q <= F.col(c)))
    return df.withColumns({c: place(c) for c in cols})


def joint_counts(df: DataFrame, cols: list[str], max_lag: int = 5, bins: int = 10, time: str = "time") -> DataFrame:
    """source, target, lag, y, y1, x, c: how often the target's bin y followed y1 while the source's bin was x, lag rows before y."""
    x = lagged(quantile_bins(cut(df.select(time, *cols).dropna()), cols, bins), cols, max_lag, time)
    rows = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(k).alias("lag"), F.col(f"{t}__0").alias("y"), F.col(f"{t}__1").alias("y1"), F.col(f"{s}__{k}").alias("x")) for s, t in itertools.permutations(cols, 2) for k in range(1, max_lag + 1)]
    return x.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("y1 IS NOT NULL AND x IS NOT NULL").groupBy("source", "target", "lag", "y", "y1", "x").agg(F.count("*").alias("c"))


def entropies(joint: DataFrame) -> DataFrame:
    """source, target, lag, te: transfer entropy in bits, from joint counts."""
    by = lambda *k: F.sum("c").over(Window.partitionBy("source", "target", "lag", *k))
    terms = joint.withColumns({"n": by(), "cyx": by("y1", "x"), "cyy": by("y", "y1"), "cy1": by("y1")})
    te = F.sum(F.col("c") / F.col("n") * F.log2((F.col("c") / F.col("cyx")) / (F.col("cyy") / F.col("cy1"))))
    return terms.groupBy("source", "target", "lag").agg(te.alias("te"))


def entropy_transfer(df: DataFrame, cols: list[str], max_lag: int = 5, bins: int = 10, time: str = "time") -> DataFrame:
    """source, target, lag, te: transfer entropy in bits for each ordered pair and lag, from joint counts."""
    return entropies(joint_counts(df, cols, max_lag, bins, time))


def random_table(rng: np.random.Generator, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A table of counts with these sums of rows and columns, distributed as if one of two labels of every element were shuffled.

    Column by column, each a multivariate hypergeometric draw from what is left. From 10^9 elements on, where numpy has no
    exact draw, a row's share is normal with the same mean and variance (its error is beyond the 9th digit).
    """
    left, out = rows.astype(np.int64).copy(), np.zeros((len(rows), len(columns)), np.int64)
    for j, want in enumerate(columns.tolist()):
        total = int(left.sum())
        if j == len(columns) - 1 or want == total:
            out[:, j] = left
        elif total < 10**9:
            out[:, j] = rng.multivariate_hypergeometric(left, want, method="marginals")
        else:
            need, rest = want, total
            for i, have in enumerate(left.tolist()):
                mean = need * have / rest
                var = mean * (1 - have / rest) * (rest - need) / max(rest - 1, 1)
                got = int(np.clip(round(rng.normal(mean, max(var, 0) ** 0.5)), max(0, need - (rest - have)), min(have, need)))
                out[i, j], need, rest = got, need - got, rest - have
        left -= out[:, j]
    return out


def transfer_entropy(df: DataFrame, cols: list[str], max_lag: int = 5, bins: int = 10, shuffles: int = 100, alpha: float = 0.05, seed: int = 1, time: str = "time") -> DataFrame:
    """The lag of largest transfer entropy of each ordered pair, against seeded shuffles of the source: te, null_mean, null_std, z, p_value, is_causal.

    A shuffle of the source leaves the counts of its bins and of the target's steps (y, y1) as they are and deals one to the
    other at random, so the shuffled joint counts are drawn from these sums directly (random_table): no series is gathered
    or sorted again, and a shuffle costs a few thousand numbers at any length of the series.
    """
    joint = cut(joint_counts(df, cols, max_lag, bins, time))
    best = entropies(joint).groupBy("source", "target").agg(F.max_by(F.struct("lag", "te"), F.struct("te", -F.col("lag"))).alias("b")).select("source", "target", "b.*")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:  # at most (bins + 1)^3 rows
        source, target, te = pdf["source"].iloc[0], pdf["target"].iloc[0], float(pdf["te"].iloc[0])
        code = pdf["y1"] * (bins + 1) + pdf["y"]
        steps, xs = (v.groupby(k).sum() for v, k in ((pdf["c"], code), (pdf["c"], pdf["x"])))
        y1 = (steps.index // (bins + 1)).to_numpy()
        rng = np.random.default_rng([seed, *f"{source}>{target}".encode()])

        def h(counts: np.ndarray) -> float:
            p = counts[counts > 0] / counts.sum()
            return float(-(p * np.log2(p)).sum())

        of_y1 = np.stack([y1 == v for v in np.unique(y1)]).astype(np.int64)
        fixed = h(steps.to_numpy()) - h(of_y1 @ steps.to_numpy())
        null = []
        for _ in range(shuffles):
            drawn = random_table(rng, steps.to_numpy(), xs.to_numpy())
            null.append(fixed - h(drawn.ravel()) + h((of_y1 @ drawn).ravel()))
        mean, std = float(np.mean(null)), float(np.std(null))
        z = (te - mean) / std if std > 0 else 0.0
        return pd.DataFrame({"source": [source], "target": [target], "lag": [int(pdf["lag"].iloc[0])], "te": [te], "null_mean": [mean], "null_std": [std], "z": [z], "p_value": [(1 + int((np.array(null) >= te).sum())) / (1 + shuffles)]})

    found = joint.join(best, ["source", "target", "lag"])
    out = found.groupBy("source", "target").applyInPandas(work, "source string, target string, lag int, te double, null_mean double, null_std double, z double, p_value double")
    return out.withColumn("is_causal", F.col("p_value") < alpha)


def causal_graph(causal: DataFrame) -> DataFrame:
    return causal.where("is_causal").groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def sequences_by_key(events: DataFrame, key: str, tie: str = TIE) -> DataFrame:
    """sequence_id and events (us, type) in order, for keys with two events or more."""
    seq = F.array_sort(F.collect_list(F.struct(micros(F.col("time")).alias("us"), F.col(tie).alias("id"), F.col("event_type").alias("type"))))
    out = events.groupBy(F.col(key).cast("string").alias("sequence_id")).agg(seq.alias("events")).where(F.size("events") >= 2)
    return out.select("sequence_id", F.transform("events", lambda e: F.struct(e["us"].alias("us"), e["type"].alias("type"))).alias("events"))


#: Lengths of a window that one block of a key's times holds.
BLOCK = 32


def _walk(us: np.ndarray, at: int, width: int) -> list[int]:
    """Starts of the greedy windows over sorted times from place `at` on."""
    out = []
    while at < len(us):
        out.append(int(us[at]))
        at = int(np.searchsorted(us, us[at] + width, "right"))
    return out


def _entries(us: np.ndarray, begin: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that may be the first to start in a block: the latest start and, of those up to it, the block's last start."""
    known = int(np.searchsorted(us, begin + width))
    last = np.arange(min(known + 1, len(us)))
    after = np.searchsorted(us, us + width, "right")
    while (on := after[last] < len(us)).any():
        last[on] = after[last[on]]
    ends = np.flatnonzero(np.diff(last, append=-1))
    return us[ends], us[last[ends]]


def window_starts(times: DataFrame, key: str, width: int) -> DataFrame:
    """The key and s, the starts (us) of its greedy windows, of a table with the key and us.

    A key's times are cut into blocks. Each block tells where its chain of windows ends for every window that may be its first;
    with that, one row for each block, the blocks of a key are gone through in order, and then each block lists its starts.
    """
    size = BLOCK * max(width, 1)
    block = F.col("us") - F.pmod("us", F.lit(size))
    blocks = cut(times.where("us IS NOT NULL").select(key, "us").distinct().groupBy(key, block.alias("block")).agg(F.sort_array(F.collect_list("us")).alias("us")))
    name = blocks.select(key).schema

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_entries(us.values.to_numpy(), begin, width) for us, begin in zip(b["us"], b["block"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b[key], b["block"], *[pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]], [key, "block", "upto", "last"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = []
            for one in b["blocks"].to_pylist():
                at, found = None, []
                for x in one:
                    found.append({"block": x["block"], "before": at})
                    i = 0 if at is None else int(np.searchsorted(x["upto"], at + width, "right"))
                    at = x["last"][i] if i < len(x["last"]) else at
                before.append(found)
            yield pa.RecordBatch.from_arrays([b[key], pa.array(before, pa.list_(pa.struct([("block", pa.int64()), ("before", pa.int64())])))], [key, "blocks"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_walk(u := us.values.to_numpy(), 0 if at is None else int(np.searchsorted(u, at + width, "right")), width) for us, at in zip(b["us"], b["before"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(made, pa.list_(pa.int64()))], [key, "s"])

    def schema(rest: str) -> T.StructType:
        return T.StructType([*name.fields, *T.StructType.fromDDL(rest).fields])

    each = blocks.mapInArrow(summed, schema("block long, upto array<long>, last array<long>"))
    keyed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "upto", "last"))).alias("blocks")).mapInArrow(chained, schema("blocks array<struct<block: long, before: long>>"))
    before = keyed.select(F.col(key).alias("k__"), F.inline("blocks").alias("b__", "before"))
    found = blocks.join(before, blocks[key].eqNullSafe(before["k__"]) & (F.col("block") == F.col("b__"))).select(key, "us", "before")
    return found.mapInArrow(listed, schema("s array<long>")).select(key, F.explode("s").alias("s"))


def sequences_by_window(events: DataFrame, seconds: int = 300, key: str = "equipment_id", tie: str = TIE) -> DataFrame:
    """Greedy windows: an event starts a new one when it is more than `seconds` after the start of the current one.

    Starts are more than a window's length apart, so each stretch of that length holds one at most, and an event belongs to
    the start in its own stretch or else to that in the one before: an equi-join. No task gathers more than one window's events.
    """
    width = seconds * 1_000_000
    stretch = lambda c: F.col(c) - F.pmod(c, F.lit(max(width, 1)))
    rows = events.select(key, micros(F.col("time")).alias("us"), F.col(tie).alias("id"), F.col("event_type").alias("type")).where("us IS NOT NULL")
    starts = cut(window_starts(rows, key, width)).select(F.col(key).alias("k__"), "s", stretch("s").alias("at__"))
    both = starts.select("k__", "at__", F.col("s").alias("own__"), F.lit(None).cast("long").alias("past__")).unionByName(starts.select("k__", (F.col("at__") + max(width, 1)).alias("at__"), F.lit(None).cast("long").alias("own__"), F.col("s").alias("past__")))
    both = both.groupBy("k__", "at__").agg(F.max("own__").alias("own__"), F.max("past__").alias("past__"))
    own = rows.join(both, rows[key].eqNullSafe(both["k__"]) & (stretch("us") == F.col("at__"))).withColumn("from__", F.when(F.col("own__") <= F.col("us"), F.col("own__")).otherwise(F.col("past__")))
    seqs = own.groupBy(key, "from__").agg(F.sort_array(F.collect_list(F.struct("us", "id", "type"))).alias("es")).where(F.size("es") >= 2)
    return seqs.select(F.concat_ws("@", F.col(key).cast("string"), F.col("from__").cast("string")).alias("sequence_id"), F.transform("es", lambda e: F.struct(e["us"].alias("us"), e["type"].alias("type"))).alias("events"))


def _grams(seqs: DataFrame, n: int) -> DataFrame:
    """sequence_id, pattern, gap (mean seconds between its events) of every contiguous n-gram."""
    long = seqs.where(F.size("events") >= n)
    at = F.explode(F.sequence(F.lit(1), F.size("events") - (n - 1)))
    g = long.select("sequence_id", "events", at.alias("i")).select("sequence_id", F.slice("events", F.col("i"), F.lit(n)).alias("g"))
    gap = (F.element_at("g", -1)["us"] - F.element_at("g", 1)["us"]) / 1_000_000 / (n - 1)
    return g.select("sequence_id", F.transform("g", lambda e: e["type"]).alias("pattern"), gap.alias("gap"))


def sequential_patterns(seqs: DataFrame, max_len: int = 5, min_support: float = 0.01, count_mode: str = "occurrences") -> DataFrame:
    """pattern, count, support, confidence, lift, avg_gap of contiguous patterns of 2 to max_len events.

    support = occurrences / sequences (it can exceed 1; count_mode "sequences" counts each sequence once).
    Confidence is relative to the pattern without its last event; patterns of two, whose prefix is one event
    and is not counted, have confidence = support. Every length up to max_len is counted in full.
    """
    total = seqs.count()
    schema_empty = seqs.select(F.lit("").alias("pattern"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("support"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("lift"), F.lit(0.0).alias("avg_gap"))
    if not total:
        return schema_empty.where("false")
    singles = seqs.select(F.explode(F.transform("events", lambda e: e["type"])).alias("type")).groupBy("type").agg(F.count("*").alias("c"))
    counted = F.count("*") if count_mode == "occurrences" else F.count_distinct("sequence_id")
    return _scored([_grams(seqs, n).groupBy("pattern").agg(counted.alias("count"), F.avg("gap").alias("avg_gap")) for n in range(2, max_len + 1)], singles, total, min_support)


def _scored(levels: list[DataFrame], singles: DataFrame, total: int, min_support: float) -> DataFrame:
    """Support, confidence and lift of counted patterns (pattern, count, avg_gap; of two events, of three, ...) among `total` sequences with c events of each type."""
    shares = singles.agg(F.map_from_entries(F.collect_list(F.struct("type", (F.col("c") / F.lit(1.0)).alias("c")))).alias("m__"), F.sum("c").alias("t__"))  # a row for each event type
    levels = [x.where(F.col("count") / total >= min_support) for x in levels]
    out = []
    for n, level in enumerate(levels, 2):
        if n == 2:
            out.append(level.withColumn("confidence", F.col("count") / total))
        else:
            prior = levels[n - 3].select(F.col("pattern").alias("prefix__"), F.col("count").alias("base__"))
            out.append(level.join(prior, F.slice("pattern", 1, n - 1) == F.col("prefix__")).withColumn("confidence", F.col("count") / F.col("base__")).drop("prefix__", "base__"))
    found = reduce(DataFrame.unionByName, out).crossJoin(F.broadcast(shares))
    expected = F.aggregate("pattern", F.lit(1.0), lambda acc, t: acc * F.element_at(F.col("m__"), t) / F.col("t__"))
    return found.withColumn("support", F.col("count") / total).select(F.array_join("pattern", ">").alias("pattern"), "count", "support", "confidence", (F.col("support") / expected).alias("lift"), "avg_gap")


def association_rules(seqs: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5) -> DataFrame:
    """antecedent, consequent, count, support, confidence, lift over the sets of event types of the sequences."""
    sets = cut(seqs.select(F.array_sort(F.array_distinct(F.transform("events", lambda e: e["type"]))).alias("items")))
    total = sets.count()
    single = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("k"))
    both = sets.select("items", F.explode("items").alias("a")).select("a", F.explode("items").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("count"))
    j = both.where(F.col("count") / max(total, 1) >= min_support).join(single.select(F.col("item").alias("a"), F.col("k").alias("ka")), "a").join(single.select(F.col("item").alias("b"), F.col("k").alias("kb")), "b")
    out = j.withColumns({"support": F.col("count") / max(total, 1), "confidence": F.col("count") / F.col("ka")}).withColumn("lift", F.col("confidence") / (F.col("kb") / max(total, 1)))
    return out.where(F.col("confidence") >= min_confidence).select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "count", "support", "confidence", "lift")


def alarm_sequences(alarms: DataFrame, seconds: int = 300, max_len: int = 5) -> DataFrame:
    """Patterns of alarm codes within each equipment, with the equipment in front of the code."""
    e = alarms.select("equipment_id", "time", F.col("alarm_id").alias(TIE), F.concat_ws(":", "equipment_id", "alarm_code").alias("event_type"))
    return sequential_patterns(sequences_by_window(e, seconds), max_len)


def root_cause_patterns(events: DataFrame, target: str, seconds: int = 300, max_len: int = 5, key: str = "equipment_id", tie: str = TIE) -> DataFrame:
    """Patterns that end in the target event, over the events within the lookback before each target.

    No lookback is gathered: a pattern at one place of a key's order is in the lookback of each target from its last event's
    time up to its first event's time plus `seconds`, so its count is the difference of two running counts of targets. The
    later one comes from a row for each event at that later time, sorted among the targets.
    """
    width = seconds * 1_000_000
    hit = F.coalesce((F.col("type") == target).cast("int"), F.lit(0))
    rows = events.select(key, micros(F.col("time")).alias("us"), F.col(tie).alias("id"), F.col("event_type").alias("type")).where("us IS NOT NULL")
    rows = rows.withColumn("before__", F.coalesce(F.sum(hit).over(Window.partitionBy(key).orderBy("us").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = F.struct((F.col("us") + width).alias("at__"), F.lit(True).alias("later__"))
    marks = rows.withColumn("x__", F.explode(F.when(hit == 1, F.array(F.struct(F.col("us").alias("at__"), F.lit(False).alias("later__")), later)).otherwise(F.array(later)))).select(*rows.columns, "x__.*")
    by_time = Window.partitionBy(key).orderBy("at__", "later__").rowsBetween(Window.unboundedPreceding, 0)
    each = marks.withColumn("upto__", F.count_if(~F.col("later__")).over(by_time)).where("later__")
    w = Window.partitionBy(key).orderBy("us", "id", "type")
    ahead = lambda c, n: F.lead(c, n).over(w) if n else F.col(c)
    alone = (F.coalesce(F.lag("us").over(w) < F.col("us") - width, F.lit(True)) & F.coalesce(F.lead("us").over(w) > F.col("us"), F.lit(True)) & (hit == 1)).cast("int")
    grams = [F.struct(F.array().cast("array<string>").alias("pattern"), (hit - alone).cast("long").alias("n"), F.lit(0.0).alias("gap"))]
    for n in range(1, max_len + 1):
        many = F.col("upto__") - ahead("before__", n - 1) - (alone if n == 1 else 0)
        grams.append(F.struct(F.array(*[ahead("type", i).cast("string") for i in range(n)]).alias("pattern"), many.alias("n"), ((ahead("us", n - 1) - F.col("us")) / 1_000_000 / max(n - 1, 1)).alias("gap")))
    long = each.select(F.array(*grams).alias("g__")).select(F.inline("g__")).where("n > 0")
    found = cut(long.groupBy("pattern").agg(F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("avg_gap")))
    total = (found.where(F.size("pattern") == 0).agg(F.sum("count")).first() or [None])[0] or 0
    singles = found.where(F.size("pattern") == 1).select(F.element_at("pattern", 1).alias("type"), F.col("count").alias("c"))
    out = _scored([found.where(F.size("pattern") == n) for n in range(2, max_len + 1)], singles, max(total, 1), 0.01)
    return out.where(F.element_at(F.split("pattern", ">"), -1) == target)


def integrate_relationships(*dfs: DataFrame) -> DataFrame:
    """The row of highest confidence for each source, target and type."""
    union = reduce(lambda a, b: a.unionByName(b), dfs)
    keys = ["source", "target", "relation_type"]
    rest = [c for c in union.columns if c not in keys]
    best = union.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("confidence", "method")).alias("r"))
    return best.select(*keys, "r.*")


def pattern_edges(patterns: DataFrame, last_edge_only: bool = False) -> DataFrame:
    """Adjacent pairs of each pattern as PRECEDES relations with its confidence."""
    p = patterns.withColumn("p__", F.split("pattern", ">"))
    n = F.size("p__")
    first = n - 1 if last_edge_only else F.lit(1)
    out = p.select("pattern", "confidence", "p__", F.explode(F.sequence(first, n - 1)).alias("i"))
    return out.select(F.element_at("p__", F.col("i")).alias("source"), F.element_at("p__", F.col("i") + 1).alias("target"), F.lit("PRECEDES").alias("relation_type"), F.lit("sequential").alias("method"), "confidence", "pattern")


def auto_verify(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return df.withColumn("verification_status", F.when(F.col("confidence") >= threshold, "auto_approved").otherwise("pending"))


def filter_relationships(df: DataFrame, source: str | None = None, target: str | None = None, relation_type: str | None = None, min_confidence: float = 0.0, verified: bool | None = None, limit: int = 100) -> DataFrame:
    for name, value in (("source", source), ("target", target), ("relation_type", relation_type)):
        if value is not None:
            df = df.where(F.col(name) == value)
    df = df.where(F.col("confidence") >= min_confidence)
    if verified is not None:
        good = F.col("verification_status").isin("verified", "auto_approved")
        df = df.where(good if verified else ~good)
    return df.orderBy(F.col("confidence").desc(), "source", "target", "relation_type").limit(limit)


def update_verification(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status, reviewer and notes of decided relations; may_promote only for verified ones."""
    keys = ["source", "target", "relation_type"]
    new = decisions.select(*keys, F.col("decision").alias("d__"), F.col("reviewer").alias("verified_by"), "notes")
    out = df.join(new, keys, "left").withColumn("verification_status", F.coalesce("d__", "verification_status")).drop("d__")
    return out.withColumn("may_promote", F.col("verification_status") == "verified")


def discover_for_parameter(df: DataFrame, cols: list[str], target: str, time: str = "time") -> DataFrame:
    """Correlation and causality towards one parameter: only its pairs are computed."""
    others = [c for c in cols if c != target]
    r = correlate_pairs(df, cols, ("pearson",), pairs=[(c, target) for c in others]).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("CORRELATES").alias("relation_type"), "method", "confidence")
    g = granger(df, cols, time=time, pairs=[(c, target) for c in others]).where("is_causal").select("source", "target", F.lit("CAUSES").alias("relation_type"), F.lit("granger").alias("method"), "confidence")
    return r.unionByName(g)
