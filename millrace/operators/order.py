"""Order over whole tables: places, ranks, exact quantiles and inversions, without any task that holds a series.

Rows are sorted in ranges; places and running sums are those inside a range plus the totals of the ranges
before it. Values are counted before they are sorted, so a frequent value is one row.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import cut


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "i__") -> DataFrame:
    """df as a table in the shared folder with the place (from 0) of each row in its key, nulls first; null keys are a key."""
    by = [*keys, *order]
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at__", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("range__", F.shiftright("at__", 33))
    runs = ranged.groupBy(*keys, "range__").agg(F.min("at__").alias("first__"), F.count("*").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("range__").alias("r__"), *[F.col(k).alias(f"{k}__k") for k in keys], (before - F.col("first__")).alias("shift__"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}__k")) for k in keys], F.col("range__") == F.col("r__"))
    return ranged.join(runs, same).select(*df.columns, (F.col("at__") + F.col("shift__")).alias(name))


def counted(df: DataFrame, cols: list[str]) -> DataFrame:
    """c (the column's number), v, k (how often), below (values of that column before it): each value of each column once, nulls and NaN left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    counts = long.where("v IS NOT NULL AND NOT isnan(v)").groupBy("c", "v").agg(F.count("*").alias("k"))
    ranged = cut(counts.repartitionByRange("c", "v").sortWithinPartitions("c", "v").withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    inside = F.coalesce(F.sum("k").over(Window.partitionBy("c", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("c", "range").agg(F.sum("k").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(totals.select("c", "range", before.alias("before")), ["c", "range"]).select("c", "v", "k", (F.col("before") + inside).alias("below"))


def quantiles(df: DataFrame, cols: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, between two values in proportion; null for a column without values. At most two rows for each of them reach the driver."""
    ranks = cut(counted(df, cols))
    n = {r["c"]: r["n"] for r in ranks.groupBy("c").agg(F.sum("k").alias("n")).collect()}
    wanted = {c: sorted({f(p * (m - 1)) for p in probabilities for f in (math.floor, math.ceil)}) for c, m in n.items()}
    hit = [(F.col("c") == c) & F.exists(F.array(*[F.lit(p).cast("long") for p in ps]), lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("k"))) for c, ps in wanted.items()]
    rows = ranks.where(reduce(Column.__or__, hit)).collect() if hit else []
    at = {(r["c"], p): r["v"] for r in rows for p in wanted[r["c"]] if r["below"] <= p < r["below"] + r["k"]}

    def one(c: int, p: float) -> float | None:
        if c not in n:
            return None
        place = p * (n[c] - 1)
        low, high = math.floor(place), math.ceil(place)
        return at[c, low] if low == high or at[c, low] == at[c, high] else (high - place) * at[c, low] + (place - low) * at[c, high]

    return {name: [one(c, p) for p in probabilities] for c, name in enumerate(cols)}


def average_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns replaced by their average ranks, nulls and NaN by null; other columns go. Values of all columns are counted, ranked and joined once."""
    rows = cut(df.select(*cols).withColumn("id__", F.monotonically_increasing_id()))
    ranks = counted(rows, cols).select("c", "v", (F.col("below") + (F.col("k") + 1) / 2).alias("rank"))
    long = rows.select("id__", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("x")).select("id__", "x.*")
    return long.join(ranks, ["c", "v"], "left").groupBy("id__").agg(*[F.max(F.when(F.col("c") == i, F.col("rank"))).alias(c) for i, c in enumerate(cols)]).drop("id__")


def inversions(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> int:
    """How many pairs of rows have one x above and the y below the other's; row i stands for k[i] rows."""
    order = np.lexsort((y, x))
    rank, k, n = np.unique(y[order], return_inverse=True)[1].astype(np.int64), k[order].astype(np.int64), len(x)
    many = int(k.sum()) >= 1 << 31
    total, at, width, top = 0, np.arange(n), 1, int(rank.max(initial=0)) + 1
    while width < n:  # all merges of a width at once: of each right half, the weight of the left half that is larger
        block = at // (2 * width)
        by = np.argsort(block * top + rank, kind="stable")
        left = np.where((at // width) % 2 == 0, k, 0)
        upto = np.cumsum(left[by])
        ends = np.flatnonzero(np.diff(block, append=block[-1] + 1))
        larger = upto[ends][block[by]] - upto
        weight = (k - left)[by]
        total += int(np.dot(weight.astype(object), larger.astype(object))) if many else int(np.dot(weight, larger))
        width *= 2
    return total


#: Rows (of distinct x and y) whose inversions one task counts, and strips of the grid that cuts a larger group.
GROUP, STRIPS = 1 << 20, 256


def _strip(v: Column, bounds: Column) -> Column:
    """An even number between two bounds, an odd one on a bound: so a frequent value has a strip of its own."""
    return 2 * F.size(F.filter(bounds, lambda b: b < v)) + F.when(F.array_contains(bounds, v), 1).otherwise(0)


def discordant(points: DataFrame, group: int = GROUP, strips: int = STRIPS) -> DataFrame:
    """g and d: how many pairs of rows of each group have one x above and the y below the other's. points: g (string), x, y, k (rows there).

    A group of more than `group` points is cut by a grid of strips in x and in y. Pairs in different strips of both are
    counted from the grid's cells; those in one strip of x, and those in one strip of y but different strips of x, are
    groups of their own and may be cut again. Strips of a single value have no such pairs.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "d": [str(inversions(*(pdf[c].to_numpy() for c in "xyk")))]})

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.unique(pdf[c], return_inverse=True)[1] for c in ("sx", "sy"))
        grid = np.zeros((x.max() + 2, y.max() + 2), object if pdf["k"].sum() >= 1 << 31 else np.int64)
        grid[x + 1, y] = pdf["k"]
        lower_x_higher_y = np.cumsum(np.cumsum(grid, axis=0)[:, ::-1], axis=1)[:, ::-1]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "d": [str(int((grid[1:, :-1] * lower_x_higher_y[:-1, 1:]).sum()))]})

    found = []
    while True:
        points = cut(points)
        sizes = cut(points.groupBy("g").agg(F.count("*").alias("n")))
        big = sizes.where(F.col("n") > group).select("g")
        small = points.join(sizes.where(F.col("n") <= group).select("g"), "g")
        found.append(small.groupBy("g").applyInPandas(count, "g string, d string"))
        if big.isEmpty():
            break
        qs = F.array(*[F.lit(i / strips) for i in range(1, strips)])
        some = points.join(big, "g")
        of = lambda c: F.array_distinct(F.percentile_approx(c, qs, F.lit(20 * strips))).alias(f"b{c}")
        bounds = cut(some.groupBy("g").agg(of("x"), of("y")))
        # a strip that keeps all points of its group would never end
        some = some.join(bounds, "g").select("g", "x", "y", "k", _strip(F.col("x"), F.col("bx")).alias("sx"), _strip(F.col("y"), F.col("by")).alias("sy"))
        some = cut(some)
        found.append(some.groupBy("g", "sx", "sy").agg(F.sum("k").alias("k")).groupBy("g").applyInPandas(cells, "g string, d string"))
        inside = F.col("sx") % 2 == 0
        in_x = some.where(inside).select(F.concat("g", F.lit("/x"), "sx").alias("g"), "x", "y", "k")
        in_y = some.where(F.col("sy") % 2 == 0).groupBy(F.concat("g", F.lit("/y"), "sy").alias("g"), F.col("sx").cast("double").alias("x"), "y").agg(F.sum("k").alias("k"))
        points = in_x.unionByName(in_y)
    whole = reduce(DataFrame.unionByName, found)
    return whole.groupBy(F.substring_index("g", "/", 1).alias("g")).agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))


#: Rows of a key that one window holds.
RUN = 65_536


def runs(rows: DataFrame, before: int, name: str = "i__", size: int = RUN) -> DataFrame:
    """rows with run__ (stretches of `size` places of a key) and own__: false for the copies of the last `before` rows that the next run begins with."""
    size = max(size, before)
    own = F.floor(F.col(name) / size).cast("long")
    copied = F.col(name) % size >= size - before
    both = F.array(F.struct(own.alias("run__"), F.lit(True).alias("own__")), F.struct((own + 1).alias("run__"), F.lit(False).alias("own__")))
    out = rows.withColumn("r__", F.explode(F.when(copied, both).otherwise(F.slice(both, 1, 1))))
    return out.select(*rows.columns, "r__.run__", "r__.own__")


def rolling_quantiles(x: np.ndarray, width: int, probabilities: list[float]) -> np.ndarray:
    """(row, probability): exact quantiles of the last `width` values up to each row, between two values in proportion; NaN takes no part, and without values is the result.

    The window is kept sorted: a row costs two searches and two moves in it, not a sort.
    """
    window: list[float] = []
    out = np.full((len(x), len(probabilities)), np.nan)
    for i, v in enumerate(x.tolist()):
        if i >= width and x[i - width] == x[i - width]:
            del window[bisect_left(window, float(x[i - width]))]
        if v == v:
            insort(window, v)
        if window:
            for j, p in enumerate(probabilities):
                place = p * (len(window) - 1)
                low = int(place)
                high = min(low + 1, len(window) - 1)
                a, b = window[low], window[high]
                out[i, j] = a if a == b or place == low else (low + 1 - place) * a + (place - low) * b
    return out
