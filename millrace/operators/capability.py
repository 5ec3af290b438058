"""Process capability: indices, trends, ranking and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import normal_cdf
from millrace.operators.spc import constant


def level(cpk: Column) -> Column:
    return F.when(cpk >= 2.0, "EXCELLENT").when(cpk >= 1.67, "GOOD").when(cpk >= 1.33, "ACCEPTABLE").when(cpk >= 1.0, "MARGINAL").otherwise("POOR")


def _per(x: Column, by: Column) -> Column:
    """x / by, or 0 for no spread."""
    return F.when(by > 0, x / by).otherwise(0.0)


def capability_indices(df: DataFrame, keys: list[str], subgroup_size: int | None = None, tie: str = "measurement_id") -> DataFrame:
    """Short and long term indices and parts per million per key; limits and target are columns of df, equal within a key.

    The spread within is the mean moving range over 1.128, or of consecutive blocks of subgroup_size rows
    the mean range over d2 (an incomplete last block is left out; below two blocks the overall spread).
    Without spread, indices and PPM are 0 and cr is infinite. Keys with fewer than 2 values have no row.
    """
    w = Window.partitionBy(*keys).orderBy("time", tie)
    lim = [F.max("usl").alias("usl"), F.max("lsl").alias("lsl"), F.max("target").alias("target")]
    moments = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_overall"), F.avg((F.col("value") - F.col("target")) ** 2).alias("off_target"), *lim]
    if subgroup_size and subgroup_size > 1:
        blocks = df.withColumn("b__", F.floor((F.row_number().over(w) - 1) / subgroup_size))
        ranges = blocks.groupBy(*keys, "b__").agg(F.count("*").alias("c__"), (F.max("value") - F.min("value")).alias("r__")).where(F.col("c__") == subgroup_size)
        within = ranges.groupBy(*keys).agg(F.count("*").alias("blocks__"), F.avg("r__").alias("r_bar"))
        d2 = constant("d2", F.lit(subgroup_size if 2 <= subgroup_size <= 10 else 5))
        g = df.groupBy(*keys).agg(*moments).join(within, keys, "left").withColumn("std_within", F.when(F.col("blocks__") >= 2, F.col("r_bar") / d2).otherwise(F.col("std_overall")))
    else:
        mr = df.withColumn("mr__", F.abs(F.col("value") - F.lag("value").over(w)))
        g = mr.groupBy(*keys).agg(*moments, (F.avg("mr__") / 1.128).alias("std_within"))
    g = g.where("n >= 2").withColumns({"z_upper": (F.col("usl") - F.col("mean")) / F.when(F.col("std_overall") > 0, F.col("std_overall")), "z_lower": (F.col("lsl") - F.col("mean")) / F.when(F.col("std_overall") > 0, F.col("std_overall"))})
    usl, lsl, mean, sw, so = (F.col(c) for c in ("usl", "lsl", "mean", "std_within", "std_overall"))
    g = g.withColumns({
        "cp": _per(usl - lsl, 6 * sw), "cpu": _per(usl - mean, 3 * sw), "cpl": _per(mean - lsl, 3 * sw), "pp": _per(usl - lsl, 6 * so), "ppu": _per(usl - mean, 3 * so), "ppl": _per(mean - lsl, 3 * so),
        "cpm": F.when(F.col("off_target") > 0, (usl - lsl) / (6 * F.sqrt("off_target"))),
        "ppm_upper": F.coalesce((1 - normal_cdf("z_upper")) * 1e6, F.lit(0.0)), "ppm_lower": F.coalesce(normal_cdf("z_lower") * 1e6, F.lit(0.0)),
    })
    g = g.withColumns({"cpk": F.least("cpu", "cpl"), "ppk": F.least("ppu", "ppl"), "cr": F.when(F.col("cp") > 0, 1 / F.col("cp")).otherwise(float("inf")), "ppm_total": F.col("ppm_upper") + F.col("ppm_lower")})
    return g.withColumn("level", level(F.col("cpk"))).select(*keys, "n", "mean", "std_within", "std_overall", "cp", "cpu", "cpl", "cpk", "pp", "ppu", "ppl", "ppk", "cpm", "cr", "ppm_upper", "ppm_lower", "ppm_total", "level")


def capability_overall(df: DataFrame, keys: list[str]) -> DataFrame:
    """Indices from the overall spread alone, with level and the two commonest recommendations."""
    g = df.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("usl").alias("usl"), F.max("lsl").alias("lsl")).where("n >= 2")
    g = g.withColumns({"cp": _per(F.col("usl") - F.col("lsl"), 6 * F.col("std")), "cpk": F.least(_per(F.col("usl") - F.col("mean"), 3 * F.col("std")), _per(F.col("mean") - F.col("lsl"), 3 * F.col("std")))})
    advice = F.array_compact(F.array(F.when(F.col("cpk") < 1.33, F.lit("REDUCE_VARIATION")), F.when((F.col("cp") > 0) & (F.col("cpk") / F.when(F.col("cp") > 0, F.col("cp")) < 0.8), F.lit("CENTER_PROCESS"))))
    return g.select(*keys, "n", "mean", "std", "cp", "cpk", level(F.col("cpk")).alias("level"), advice.alias("recommendations"))


def quick_cpk_of(mean: Column, std: Column, usl: Column, lsl: Column, n: Column) -> Column:
    return F.when((n >= 2) & (std > 0), F.least(usl - mean, mean - lsl) / (3 * std)).otherwise(0.0)


def quick_cpk(df: DataFrame, keys: list[str]) -> DataFrame:
    cpk = quick_cpk_of(F.avg("value"), F.stddev_samp("value"), F.max("usl"), F.max("lsl"), F.count("value"))
    return df.groupBy(*keys).agg(cpk.alias("cpk"))


def capability_trend(df: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Mean, std, count and cpk of each time block."""
    cpk = quick_cpk_of(F.avg("value"), F.stddev_samp("value"), F.max("usl"), F.max("lsl"), F.count("value"))
    g = df.groupBy(F.window("time", width).alias("w"), *keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), cpk.alias("cpk"))
    return g.select(F.col("w.start").alias("bucket"), *[c for c in g.columns if c != "w"], level(F.col("cpk")).alias("level"))


def compare_capability(df: DataFrame, keys: list[str], among: list[str]) -> DataFrame:
    """Keys ranked by cpk among those that share the columns in `among`."""
    order = Window.partitionBy(*among).orderBy(F.col("cpk").desc())
    return quick_cpk(df, keys).withColumn("place", F.rank().over(order))


def capability_recommendations(indices: DataFrame, keys: list[str]) -> DataFrame:
    """Advice codes from the output of capability_indices()."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    codes = F.array_compact(F.array(
        F.when(ratio("ppk", "cpk") < 0.8, F.lit("UNSTABLE")),
        F.when(ratio("cpk", "cp") < 0.8, F.when(F.col("cpu") < F.col("cpl"), "OFF_CENTER_HIGH").otherwise("OFF_CENTER_LOW")),
        F.when(F.col("level") == "POOR", F.lit("REDESIGN")).when(F.col("level") == "MARGINAL", F.lit("REDUCE_VARIATION")).when(F.col("level") == "ACCEPTABLE", F.lit("MONITOR")),
        F.when(F.col("ppm_total") > 10_000, F.lit("PPM_CRITICAL")).when(F.col("ppm_total") > 1_000, F.lit("PPM_HIGH")),
    ))
    return indices.select(*keys, codes.alias("recommendations"))
