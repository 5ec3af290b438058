"""Windowed and grouped statistics. Aggregates combine before the shuffle, so a hot equipment costs one row a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import corr, micros


def window_stats(df: DataFrame, *widths: str) -> DataFrame:
    """Per equipment, parameter and tumbling window of each width: count, sum, min, max, mean, sample std (null below 2), alarms, warnings."""

    def one(width: str) -> DataFrame:
        g = df.groupBy(F.window("time", width).alias("w"), "equipment_id", "param_id")
        out = g.agg(
            F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.stddev_samp("value").alias("std_value"),
            F.count_if(F.col("status") == "ALARM").alias("alarm_count"), F.count_if(F.col("status") == "WARNING").alias("warning_count"),
        )
        return out.select(F.col("w.start").alias("window_start"), F.lit(width).alias("window_size"), *[c for c in out.columns if c != "w"])

    return reduce(DataFrame.unionByName, map(one, widths))


def fdc_stats_5min(df: DataFrame) -> DataFrame:
    g = df.groupBy(F.window("time", "5 minutes").alias("w"), "equipment_id", "param_id")
    out = g.agg(F.count("value").alias("n"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.stddev_samp("value").alias("std_value"), F.median("value").alias("median_value"))
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])


def spc_stats_hourly(df: DataFrame) -> DataFrame:
    g = df.groupBy(F.window("time", "1 hour").alias("w"), "process_id", "item_id")
    out = g.agg(F.count("value").alias("n"), F.avg("value").alias("avg_value"), F.stddev_samp("value").alias("std_value"), F.avg("cp").alias("avg_cp"), F.avg("cpk").alias("avg_cpk"), F.count_if(F.col("status") != "NORMAL").alias("violations"))
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])


def alarm_stats_hourly(alarms: DataFrame) -> DataFrame:
    g = alarms.groupBy(F.window("time", "1 hour").alias("w"), "equipment_id", "severity", "source_system").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("bucket"), "equipment_id", "severity", "source_system", "n")


def alert_summary(alerts: DataFrame, severities: list[str]) -> DataFrame:
    """Per hour: total and the number of each severity, with the list of severities given so that nothing is collected to find it."""
    g = alerts.groupBy(F.date_trunc("hour", "time").alias("hour")).pivot("severity", severities).agg(F.count(F.lit(1)))
    counts = [F.coalesce(s, F.lit(0)).alias(s.lower()) for s in severities]
    return g.select("hour", reduce(Column.__add__, [F.coalesce(s, F.lit(0)) for s in severities]).alias("total"), *counts)


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def dashboard_summary(equipment: DataFrame, lots: DataFrame, alarms: DataFrame, spc: DataFrame, day) -> DataFrame:
    """One row: equipment, active lots, alarms of the day, points out of control, mean Cpk. Only single-row aggregates meet."""
    parts = [
        equipment.agg(F.count("*").alias("equipment_count")),
        lots.agg(F.count_if(F.col("status") == "ACTIVE").alias("active_lots")),
        alarms.agg(F.count_if(F.to_date("time") == F.to_date(F.lit(day))).alias("alerts_today")),
        spc.agg(F.count_if(F.col("status").isin("OOC", "OOS")).alias("ooc_count"), F.avg("cpk").alias("avg_cpk")),
    ]
    return reduce(DataFrame.crossJoin, parts)


def param_statistics(df: DataFrame, key: str = "param_id") -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    return df.groupBy(key).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def param_trend(df: DataFrame, keys: list[str], tie: str = "measurement_id") -> DataFrame:
    """Linear slope over the row number, its direction at 0.01, first and last value and the change in percent."""
    at = F.struct("time", tie)
    indexed = df.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("time", tie)).cast("double"))
    out = indexed.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    direction = F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    return out.withColumn("direction", direction).withColumn("change_pct", F.when(F.col("first_value") != 0, (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100))


def window_features(df: DataFrame, width: str, keys: list[str], run: str | None = None) -> DataFrame:
    """Twelve statistics of each window (population skewness and excess kurtosis), rows and distinct runs."""
    q = lambda p: F.percentile("value", F.lit(p))
    aggs = [
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), (F.max("value") - F.min("value")).alias("range_value"), q(0.5).alias("median"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), q(0.25).alias("q25"), q(0.75).alias("q75"), (q(0.75) - q(0.25)).alias("iqr"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("rows_in_window"),
    ]
    if run:
        aggs.append(F.count_distinct(run).alias("runs"))
    out = df.groupBy(F.window("time", width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])


def window_features_10min(df: DataFrame, keys: list[str], run: str | None = None, width: str = "10 minutes") -> DataFrame:
    """window_features() with change to the window before, mean over three windows and the distance from it."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    before = F.lag("mean").over(w)
    out = window_features(df, width, keys, run).withColumn("mean_diff", F.col("mean") - before).withColumn("mean_pct", F.when(before != 0, (F.col("mean") - before) / before))
    out = out.withColumn("mean_ma3", F.avg("mean").over(w.rowsBetween(-2, 0)))
    return out.withColumn("ma3_deviation", F.col("mean") - F.col("mean_ma3"))


def window_features_1min(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population std, min, max, range of each minute, and the vector (mean, std, range)."""
    out = df.groupBy(F.window("time", "1 minute").alias("w"), *keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), (F.max("value") - F.min("value")).alias("range_value"))
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"]).withColumn("vector", F.array("mean", "std", "range_value"))


def derived_roll(rolls: DataFrame, cells: DataFrame) -> DataFrame:
    n = cells.groupBy("roll_id").agg(F.count("*").alias("cell_count"), F.count_if(F.col("grade").isin("A", "B")).alias("good_cells"))
    return rolls.join(n, "roll_id", "left").select("roll_id", F.coalesce("cell_count", F.lit(0)).alias("cell_count"), F.coalesce("good_cells", F.lit(0)).alias("good_cells"), (F.col("good_cells") / F.col("cell_count") * 100).alias("yield_pct"))


def derived_lot(lots: DataFrame, wafers: DataFrame) -> DataFrame:
    n = wafers.groupBy("lot_id").agg(F.count("*").alias("wafers"), F.count_if(F.col("status") == "GOOD").alias("good_wafers"))
    hours = (micros(F.col("end_time")) - micros(F.col("start_time"))) / 3_600_000_000
    return lots.join(n, "lot_id", "left").select("lot_id", F.coalesce("good_wafers", F.lit(0)).alias("good_wafers"), (F.col("good_wafers") / F.col("wafers") * 100).alias("lot_yield"), hours.alias("cycle_hours"))


def derived_wafer(wafers: DataFrame) -> DataFrame:
    return wafers.select("wafer_id", F.when(F.col("die_total") > 0, F.col("die_good") / F.col("die_total") * 100).alias("die_yield"))


def derived_cell(cells: DataFrame) -> DataFrame:
    hours = (micros(F.col("formation_end")) - micros(F.col("formation_start"))) / 3_600_000_000
    return cells.select("cell_id", (F.col("capacity_ah") * F.col("voltage_v")).alias("energy_wh"), hours.alias("formation_hours"))


def derived_module(cells: DataFrame) -> DataFrame:
    return cells.groupBy("module_id").agg(F.count("*").alias("actual_cells"), F.avg("capacity_ah").alias("avg_capacity"), F.stddev_samp("capacity_ah").alias("std_capacity"), F.sum(F.col("capacity_ah") * F.col("voltage_v")).alias("energy_wh"), ((F.max(micros(F.col("formation_end"))) - F.min(micros(F.col("formation_start")))) / 3_600_000_000).alias("assembly_hours"))


def derived_pack(modules: DataFrame) -> DataFrame:
    return modules.groupBy("pack_id").agg(F.count("*").alias("module_count"), F.avg("energy_wh").alias("avg_energy"), F.sum("energy_wh").alias("total_energy"), ((F.max(micros(F.col("assembly_end"))) - F.min(micros(F.col("assembly_start")))) / 3_600_000_000).alias("cycle_hours"))


def route_times(steps: DataFrame, tie: str = "step_id") -> DataFrame:
    """Cycle time of each step and its queue time: start minus the end of the step before."""
    w = Window.partitionBy("lot_id").orderBy("sequence_no", tie)
    start, end = micros(F.col("actual_start")), micros(F.col("actual_end"))
    return steps.select("lot_id", "sequence_no", tie, ((end - start) / 1_000_000).alias("cycle_seconds"), ((start - F.lag(end).over(w)) / 1_000_000).alias("queue_seconds"))


def compare_periods(wide: DataFrame, sensors: list[str], a: Column, b: Column) -> DataFrame:
    """Per sensor: change of the mean in percent and ratio of the std between the rows of two conditions; one pass."""
    both = wide.select(*sensors, a.alias("a__"), b.alias("b__")).where("a__ OR b__")
    # one row per sensor and value, summed before the shuffle
    tall = both.select("a__", "b__", F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).alias("v")) for s in sensors])).alias("x"))
    va, vb = F.when(F.col("a__"), F.col("x.v")), F.when(F.col("b__"), F.col("x.v"))
    g = tall.groupBy(F.col("x.sensor").alias("sensor")).agg(F.avg(va).alias("mean_a"), F.avg(vb).alias("mean_b"), F.stddev_samp(va).alias("std_a"), F.stddev_samp(vb).alias("std_b"))
    return g.withColumn("mean_change_pct", F.when(F.col("mean_a") != 0, (F.col("mean_b") - F.col("mean_a")) / F.abs("mean_a") * 100)).withColumn("std_ratio", F.when(F.col("std_a") != 0, F.col("std_b") / F.col("std_a")))


def compare_correlations(wide: DataFrame, sensors: list[str], a: Column, b: Column) -> DataFrame:
    """Per pair of sensors: correlation under both conditions and its change; all pairs in one aggregate."""
    pairs = [(x, y) for i, x in enumerate(sensors) for y in sensors[i + 1 :]]
    at = lambda c, s: F.when(c, F.col(s))
    row = wide.agg(*[corr(at(c, x), at(c, y)).alias(f"{n}{i}") for i, (x, y) in enumerate(pairs) for n, c in (("a", a), ("b", b))])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("sensor1"), F.lit(y).alias("sensor2"), F.col(f"a{i}").alias("corr_a"), F.col(f"b{i}").alias("corr_b")) for i, (x, y) in enumerate(pairs)])).alias("r"))
    return out.select("r.*").withColumn("corr_change", F.col("corr_b") - F.col("corr_a"))


def value_distribution(df: DataFrame, group: Column, low: float, high: float, bins: int) -> DataFrame:
    """Histogram of equal bins (0 below, bins + 1 above) of the values of each group, with each bin's share of its group."""
    g = df.groupBy(group.alias("grp"), F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def label_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = vertices.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("vertex").alias("kind"), "label", "n")
    return v.unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("label"), "n"))


def relationship_summary(rel: DataFrame) -> DataFrame:
    """Counts by type and method with those above 0.7."""
    return rel.groupBy("relation_type", "method").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") > 0.7).alias("high_confidence"), F.max("confidence").alias("best"))
