"""Complex event patterns over trailing event-time windows.

The window of a row is closed at both ends. Its counts are running sums of what enters and leaves, so their work does not
grow with the window; only rows that fire carry the list of ids. Ids of alerts are hashes of pattern, key and row, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import micros


def _trailing(keys: list[str], seconds: int):
    return Window.partitionBy(*keys).orderBy(micros(F.col("time"))).rangeBetween(-seconds * 1_000_000, 0)


def _alert(df: DataFrame, pattern: str, row_id: str, severity: Column, confidence: Column, ids: Column, context: Column, equipment: str = "equipment_id") -> DataFrame:
    return df.select(
        F.concat(F.lit(f"CEP-{pattern}-"), F.col(row_id).cast("string")).alias("alert_id"), F.lit(pattern).alias("pattern_id"), F.col(equipment).alias("equipment_id"), severity.alias("severity"), F.col("time").alias("detected_at"),
        confidence.cast("double").alias("confidence"), F.transform(F.array_sort(ids), lambda x: x.cast("string")).alias("related_ids"), context.alias("context"),
    )


def _counted(df: DataFrame, keys: list[str], seconds: int, until: dict[str, Column]) -> DataFrame:
    """df with the count of the rows in the trailing window as count__, and under each name that of those which stay until the given time (us), or until they leave the window if that is sooner or null.

    Each row is a mark at its time and one at the end of its stay for each count; a count is the running sum of its marks.
    """
    us = micros(F.col("time"))
    goes = us + seconds * 1_000_000 + 1
    ends = {"count__": goes, **{n: F.least(goes, c) for n, c in until.items()}}
    row = F.struct(*df.columns)

    def mark(at: Column, own: Column, amount: int, names: set[str]) -> Column:
        return F.struct(at.alias("at__"), own.alias("own__"), *[F.lit(amount if n in names else 0).alias(n) for n in ends])

    marks = F.array(mark(us, row, 1, set(ends)), *[mark(c, F.lit(None), -1, {n}) for n, c in ends.items()])
    named = [f"{k}__k" for k in keys]
    upto = Window.partitionBy(*named).orderBy("at__").rangeBetween(Window.unboundedPreceding, 0)
    running = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.inline(marks)).withColumns({n: F.sum(n).over(upto) for n in ends})
    return running.where("own__ IS NOT NULL").select("own__.*", *ends)


def cep_threshold(df: DataFrame, n: int = 3, seconds: int = 180) -> DataFrame:
    """At least n rows with status ALARM or WARNING of one equipment and parameter within the window."""
    keys = ["equipment_id", "param_id"]
    hits = _counted(df.where(F.col("status").isin("ALARM", "WARNING")).select(*keys, "measurement_id", "time"), keys, seconds, {})
    hits = hits.withColumn("ids__", F.when(F.col("count__") >= n, F.collect_list("measurement_id").over(_trailing(keys, seconds)))).where(F.col("count__") >= n)
    return _alert(hits, "THRESHOLD_BREACH", "measurement_id", F.lit("MAJOR"), F.least(F.lit(1.0), F.col("count__") / n), F.col("ids__"), F.create_map(F.lit("param_id"), F.col("param_id"), F.lit("count"), F.col("count__").cast("string")))


def cep_consecutive_alarms(alarms: DataFrame, n: int = 5, seconds: int = 300) -> DataFrame:
    """At least n alarms of one equipment within the window; CRITICAL with three codes or more.

    Of the alarms of one code in a window the last one counts for it: it stays until the code's next alarm.
    """
    keys = ["equipment_id"]
    us = micros(F.col("time"))
    after = F.lead(us).over(Window.partitionBy("equipment_id", "alarm_code").orderBy(us))
    rows = alarms.select("equipment_id", "alarm_id", "time", F.when(F.col("alarm_code").isNull(), us).otherwise(after).alias("next__"))
    hits = _counted(rows, keys, seconds, {"codes__": F.col("next__")})
    hits = hits.withColumn("ids__", F.when(F.col("count__") >= n, F.collect_list("alarm_id").over(_trailing(keys, seconds)))).where(F.col("count__") >= n)
    return _alert(hits, "CONSECUTIVE_ALARMS", "alarm_id", F.when(F.col("codes__") >= 3, "CRITICAL").otherwise("MAJOR"), F.least(F.lit(1.0), F.col("count__") / n), F.col("ids__"), F.create_map(F.lit("codes"), F.col("codes__").cast("string"), F.lit("count"), F.col("count__").cast("string")))


def _drifts(us: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's window over rows in order: its rows, and how far the mean of its second half is from that of its first, also in sample standard deviations (NaN where it has no spread, or a value that is not finite)."""
    lo, hi = np.searchsorted(us, us - width), np.searchsorted(us, us, "right")
    odd = ~np.isfinite(value)
    v = np.where(odd, 0.0, value)
    v = (v - v.mean()).astype(np.longdouble)
    s, q, bad = (np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)]) for x in (v, v * v, odd.astype(np.int64)))
    changed = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] != value[:-1]]), np.arange(len(v)), 0))
    n = hi - lo
    mid = lo + n // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.sqrt(np.maximum(q[hi] - q[lo] - (s[hi] - s[lo]) ** 2 / n, 0) / (n - 1))
        diff = (s[hi] - s[mid]) / (hi - mid) - (s[mid] - s[lo]) / (mid - lo)
        far = np.abs(diff) / std
    far[(changed[hi - 1] <= lo) | (bad[hi] > bad[lo]) | (std == 0)] = np.nan
    return n, diff.astype(float), far.astype(float)


def cep_drift(df: DataFrame, seconds: int = 600, sigma: float = 2.0, least: int = 10) -> DataFrame:
    """At least `least` earlier points: the means of both halves of the window differ by sigma sample standard deviations or more.

    A key's rows are cut by time into blocks of 16 windows, each with the window before it; in a block, windows are places in
    running sums of the values less their mean, so none is gathered. Rows of one time are in the window together, by
    measurement_id within the halves; rows without a value take no part.
    """
    keys, width = ["equipment_id", "param_id"], seconds * 1_000_000
    size = 16 * max(width, 1)
    rows = df.where(F.col("value").isNotNull()).select(*keys, "time", "measurement_id", micros(F.col("time")).alias("us__"), F.col("value").cast("double").alias("v__")).where("us__ IS NOT NULL")
    fields = rows.schema.fields[:4]
    within = F.pmod("us__", F.lit(size))
    block = F.col("us__") - within
    both = F.array(F.struct(block.alias("block__"), F.lit(True).alias("own__")), F.struct((block + size).alias("block__"), F.lit(False).alias("own__")))
    blocks = rows.select("*", F.inline(F.when(within >= size - width, both).otherwise(F.slice(both, 1, 1))))

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("us__", "ascending"), ("measurement_id", "ascending")])
        n, diff, far = _drifts(t["us__"].to_numpy(), t["v__"].to_numpy(), width)
        fires = t["own__"].to_numpy() & (n > least) & (far >= sigma)
        out = t.select([f.name for f in fields]).filter(pa.array(fires))
        return out.append_column("n__", pa.array(n[fires])).append_column("diff__", pa.array(diff[fires])).append_column("sigmas__", pa.array(far[fires]))

    x = blocks.groupBy(*keys, "block__").applyInArrow(work, T.StructType([*fields, *T.StructType.fromDDL("n__ long, diff__ double, sigmas__ double").fields]))
    direction = F.when(F.col("diff__") > 0, "UP").otherwise("DOWN")
    return _alert(x, "DRIFT_DETECTED", "measurement_id", F.when(F.col("sigmas__") < 3, "WARNING").otherwise("MAJOR"), F.least(F.lit(1.0), F.col("sigmas__") / 4), F.array("measurement_id"), F.create_map(F.lit("param_id"), F.col("param_id"), F.lit("direction"), direction, F.lit("count"), F.col("n__").cast("string")))


def cep_alerts(measurements: DataFrame, alarms: DataFrame) -> DataFrame:
    """The alerts of the three patterns."""
    return cep_threshold(measurements).unionByName(cep_consecutive_alarms(alarms)).unionByName(cep_drift(measurements))
