"""Control charts: limits, the eight run rules, status and summaries.

All rules of one chart share a single sorted window. Flags at the end of a window of n points come
from frames of the n latest rows; a point belongs to an offending window if such a flag is up at it
or at one of the n - 1 rows after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Control chart constants by subgroup size: A2, A3, D3, D4, d2, c4.
CONSTANTS = {
    2: (1.880, 2.659, 0.0, 3.267, 1.128, 0.7979),
    3: (1.023, 1.954, 0.0, 2.575, 1.693, 0.8862),
    4: (0.729, 1.628, 0.0, 2.282, 2.059, 0.9213),
    5: (0.577, 1.427, 0.0, 2.115, 2.326, 0.9400),
    6: (0.483, 1.287, 0.0, 2.004, 2.534, 0.9515),
    7: (0.419, 1.182, 0.076, 1.924, 2.704, 0.9594),
    8: (0.373, 1.099, 0.136, 1.864, 2.847, 0.9650),
    9: (0.337, 1.032, 0.184, 1.816, 2.970, 0.9693),
    10: (0.308, 0.975, 0.223, 1.777, 3.078, 0.9727),
}
NAMES = ("a2", "a3", "d3", "d4", "d2", "c4")


def constant(name: str, n: Column) -> Column:
    """A chart constant for the subgroup size in n; null for sizes outside 2 to 10."""
    k = NAMES.index(name)
    return F.get(F.array(*[F.lit(CONSTANTS[i][k] if i in CONSTANTS else None).cast("double") for i in range(11)]), F.when(n.between(2, 10), n.cast("int")))


def subgroup_stats(df: DataFrame, keys: list[str], subgroup: str) -> DataFrame:
    """Mean, sample std, range, count and first time of each subgroup."""
    return df.groupBy(*keys, subgroup).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (F.max("value") - F.min("value")).alias("range_value"), F.count("value").alias("n"), F.min("time").alias("first_time"))


def chart_limits(stats: DataFrame, keys: list[str]) -> DataFrame:
    """X-bar limits by the R and the S method and R limits, for the commonest subgroup size of each chart (the smaller in a tie)."""
    sizes = stats.groupBy(*keys, "n").agg(F.count("*").alias("c__"), F.sum("mean").alias("m__"), F.sum("range_value").alias("r__"), F.sum("std").alias("s__"), F.count("std").alias("k__"))
    g = sizes.groupBy(*keys).agg(F.max_by("n", F.struct("c__", -F.col("n"))).alias("size"), (F.sum("m__") / F.sum("c__")).alias("center"), (F.sum("r__") / F.sum("c__")).alias("r_bar"), (F.sum("s__") / F.sum("k__")).alias("s_bar"))
    n = F.col("size")
    g = g.where(n.between(2, 10))
    return g.select(
        *keys, "size", "center", "r_bar", "s_bar",
        (F.col("center") + constant("a2", n) * F.col("r_bar")).alias("xr_ucl"), (F.col("center") - constant("a2", n) * F.col("r_bar")).alias("xr_lcl"), (F.col("r_bar") / constant("d2", n) / F.sqrt(n)).alias("xr_sigma"),
        (F.col("center") + constant("a3", n) * F.col("s_bar")).alias("xs_ucl"), (F.col("center") - constant("a3", n) * F.col("s_bar")).alias("xs_lcl"), (F.col("s_bar") / constant("c4", n) / F.sqrt(n)).alias("xs_sigma"),
        (constant("d4", n) * F.col("r_bar")).alias("r_ucl"), (constant("d3", n) * F.col("r_bar")).alias("r_lcl"), (F.col("r_bar") / constant("d2", n)).alias("r_sigma"),
    )


def xbar_limits(df: DataFrame, keys: list[str], subgroup: str) -> DataFrame:
    return chart_limits(subgroup_stats(df, keys, subgroup), keys).drop("r_ucl", "r_lcl", "r_sigma")


def r_limits(df: DataFrame, keys: list[str], subgroup: str) -> DataFrame:
    return chart_limits(subgroup_stats(df, keys, subgroup), keys).select(*keys, "size", F.col("r_bar").alias("center"), "r_ucl", "r_lcl", "r_sigma")


def individual_limits(df: DataFrame, keys: list[str], tie: str = "measurement_id") -> DataFrame:
    """Mean plus and minus three times the mean moving range over 1.128."""
    w = Window.partitionBy(*keys).orderBy("time", tie)
    mr = df.withColumn("mr__", F.abs(F.col("value") - F.lag("value").over(w)))
    g = mr.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("center"), F.avg("mr__").alias("mr_bar"))
    sigma = F.col("mr_bar") / 1.128
    return g.select(*keys, "n", "center", "mr_bar", (F.col("center") + 3 * sigma).alias("ucl"), (F.col("center") - 3 * sigma).alias("lcl"), sigma.alias("sigma"))


#: Rule names and the number of points that each looks at.
RULES = {
    "RULE1_BEYOND_3SIGMA": 1, "RULE2_RUN_ABOVE": 9, "RULE2_RUN_BELOW": 9, "RULE3_TREND_UP": 6, "RULE3_TREND_DOWN": 6, "RULE4_ALTERNATING": 14, "RULE5_2OF3_ABOVE_2SIGMA": 3, "RULE5_2OF3_BELOW_2SIGMA": 3, "RULE6_4OF5_ABOVE_1SIGMA": 5, "RULE6_4OF5_BELOW_1SIGMA": 5,
    "RULE7_STRATIFICATION": 15, "RULE8_MIXTURE": 8,
}


def _end_flags(w: WindowSpec, v: Column, ucl: Column, lcl: Column, center: Column, sigma: Column) -> dict[str, Column]:
    """Whether each rule fires on the window that ends at a row."""
    rows = lambda n: w.rowsBetween(-(n - 1), 0)
    full = lambda n: F.count(F.lit(1)).over(rows(n)) == n
    count = lambda c, n: F.sum(c.cast("int")).over(rows(n))
    s = lambda k: center + k * sigma
    up, down = F.lag(v).over(w) < v, F.lag(v).over(w) > v
    turn = F.col("up__") != F.lag("up__").over(w)
    out = {
        "RULE1_BEYOND_3SIGMA": (v > ucl) | (v < lcl),
        "RULE2_RUN_ABOVE": full(9) & (count(v > center, 9) == 9), "RULE2_RUN_BELOW": full(9) & (count(v < center, 9) == 9),
        "RULE3_TREND_UP": full(6) & (count(F.col("up__"), 5) == 5), "RULE3_TREND_DOWN": full(6) & (count(F.col("down__"), 5) == 5),
        "RULE4_ALTERNATING": full(14) & (count(F.col("turn__"), 12) == 12),
        "RULE5_2OF3_ABOVE_2SIGMA": full(3) & (count(v > s(2), 3) >= 2), "RULE5_2OF3_BELOW_2SIGMA": full(3) & (count(v < s(-2), 3) >= 2) & ~(count(v > s(2), 3) >= 2),
        "RULE6_4OF5_ABOVE_1SIGMA": full(5) & (count(v > s(1), 5) >= 4), "RULE6_4OF5_BELOW_1SIGMA": full(5) & (count(v < s(-1), 5) >= 4) & ~(count(v > s(1), 5) >= 4),
        "RULE7_STRATIFICATION": full(15) & (count((v >= s(-1)) & (v <= s(1)), 15) == 15),
        "RULE8_MIXTURE": full(8) & (count((v > s(1)) | (v < s(-1)), 8) == 8),
    }
    return {"up__": up, "down__": down, "turn__": turn} | out


def western_electric(df: DataFrame, keys: list[str], mode: str = "all", tie: str = "measurement_id") -> DataFrame:
    """df (value, ucl, lcl, center, sigma) with rule_violations. mode "last": rules of the window that ends at the row; "all": of every window that holds the row.

    sigma null or 0 falls back to (ucl - center) / 3.
    """
    w = Window.partitionBy(*keys).orderBy("time", tie)
    names = df.columns
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise((F.col("ucl") - F.col("center")) / 3)
    v, ucl, lcl, center = (F.col(c) for c in ("value", "ucl", "lcl", "center"))
    flags = _end_flags(w, v, ucl, lcl, center, F.col("sigma__"))
    out = df.withColumn("sigma__", sigma).withColumns({k: flags[k] for k in ("up__", "down__")}).withColumn("turn__", flags["turn__"])
    out = out.withColumns({f"{r}__": F.coalesce(flags[r], F.lit(False)) for r in RULES})
    if mode == "all":
        hit = {r: F.max(F.col(f"{r}__").cast("int")).over(w.rowsBetween(0, n - 1)) == 1 for r, n in RULES.items()}
    else:
        hit = {r: F.col(f"{r}__") for r in RULES}
    return out.select(*names, F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in hit.items()])).alias("rule_violations"))


def spc_status(value: Column, usl: Column, lsl: Column, rules: Column) -> Column:
    """OOS beyond the specification, then OOC (rule 1), TREND (rule 3), SHIFT (rule 2), OOC (any other), NORMAL."""
    has = lambda p: F.exists(rules, lambda r: r.startswith(p))
    return F.when((value > usl) | (value < lsl), "OOS").when(has("RULE1"), "OOC").when(has("RULE3"), "TREND").when(has("RULE2"), "SHIFT").when(F.size(rules) > 0, "OOC").otherwise("NORMAL")


def spc_rolling_stats(df: DataFrame, keys: list[str], history: int = 25, tie: str = "measurement_id") -> DataFrame:
    """Mean, range of the last two, sample std, cp and cpk over the last `history` rows."""
    w = Window.partitionBy(*keys).orderBy("time", tie)
    h = w.rowsBetween(-(history - 1), 0)
    mean, std = F.avg("value").over(h), F.stddev_samp("value").over(h)
    out = df.withColumns({"x_bar": mean, "range_val": F.abs(F.col("value") - F.lag("value").over(w)), "std_dev": std})
    some = F.col("std_dev") > 0
    return out.withColumns({"cp": F.when(some, (F.col("usl") - F.col("lsl")) / (6 * F.col("std_dev"))), "cpk": F.when(some, F.least(F.col("usl") - F.col("x_bar"), F.col("x_bar") - F.col("lsl")) / (3 * F.col("std_dev")))})


def violation_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of points with each rule; points without any count under NONE."""
    rule = F.explode(F.when(F.size("rule_violations") > 0, F.col("rule_violations")).otherwise(F.array(F.lit("NONE"))))
    return df.select(*keys, rule.alias("rule")).groupBy(*keys, "rule").agg(F.count("*").alias("n"))


def control_chart(df: DataFrame, keys: list[str], limit: int = 100, tie: str = "measurement_id") -> DataFrame:
    """Individuals chart of the newest `limit` rows of each key: limits, population std, points outside, status."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("time").desc(), F.col(tie).desc()))
    last = df.withColumn("rn__", newest).where(F.col("rn__") <= limit)
    w = Window.partitionBy(*keys).orderBy("time", tie)
    whole = Window.partitionBy(*keys)
    last = last.withColumn("mr__", F.abs(F.col("value") - F.lag("value").over(w)))
    last = last.withColumns({"center": F.avg("value").over(whole), "sigma": F.avg("mr__").over(whole) / 1.128})
    out = (F.col("value") > F.col("center") + 3 * F.col("sigma")) | (F.col("value") < F.col("center") - 3 * F.col("sigma"))
    g = last.groupBy(*keys).agg(F.count("*").alias("n"), F.first("center").alias("center"), F.first("sigma").alias("sigma"), F.stddev_pop("value").alias("std"), F.count_if(out).alias("ooc_count"))
    return g.select(*keys, "n", "center", (F.col("center") + 3 * F.col("sigma")).alias("ucl"), (F.col("center") - 3 * F.col("sigma")).alias("lcl"), "std", "ooc_count", F.when(F.col("ooc_count") > 0, "OUT_OF_CONTROL").otherwise("IN_CONTROL").alias("status"))
