"""Enrichment, as-of, interval and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import micros


def enrich_measurements(meas: DataFrame, equipment: DataFrame, recipe: DataFrame, lot: DataFrame) -> DataFrame:
    """Three left joins. Spark broadcasts a dimension below its size threshold and splits skewed keys of larger ones."""
    eq = equipment.select("equipment_id", F.col("name").alias("equipment_name"), F.col("type").alias("equipment_type"), "location")
    rc = recipe.select("recipe_id", "recipe_name", F.col("version").alias("recipe_version"))
    lt = lot.select("lot_id", F.col("current_step").alias("process_id"), "product_code")
    out = meas.join(eq, "equipment_id", "left").join(rc, "recipe_id", "left").join(lt, "lot_id", "left")
    return out.withColumn("process_name", F.lit(None).cast("string"))


def enrich_asof(meas: DataFrame, dim: DataFrame, key: str, ts: str, columns: list[str], ttl_seconds: int) -> DataFrame:
    """The newest row of dim at or before each measurement, unless it is older than the TTL: one union, one sorted window, no join."""
    names = meas.columns
    left = meas.select(F.struct(*names).alias("m__"), F.col(key).alias("k__"), micros(F.col(ts)).alias("t__"), F.lit(1).alias("o__"), F.lit(None).cast(dim.select(F.struct(micros(F.col(ts)).alias("at"), *columns)).schema[0].dataType).alias("d__"))
    right = dim.select(F.lit(None).cast(left.schema["m__"].dataType).alias("m__"), F.col(key).alias("k__"), micros(F.col(ts)).alias("t__"), F.lit(0).alias("o__"), F.struct(micros(F.col(ts)).alias("at"), *columns).alias("d__"))
    seen = Window.partitionBy("k__").orderBy("t__", "o__").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("d__", F.last("d__", ignorenulls=True).over(seen)).where(F.col("m__").isNotNull())
    fresh = F.col("t__") - F.col("d__.at") <= ttl_seconds * 1_000_000
    return out.select("m__.*", *[F.when(fresh, F.col(f"d__.{c}")).alias(c) for c in columns])


def label_fault_intervals(pv: DataFrame, faults: DataFrame, ts: str = "time", bucket_seconds: int = 300) -> DataFrame:
    """pv with is_anomaly: 1 where start <= ts <= end of a fault. Each interval is put into the time buckets that it touches, so the range becomes an equi-join."""
    second = lambda c: F.floor(micros(c) / 1_000_000 / bucket_seconds)
    spans = faults.select(F.col("start_timestamp").alias("s__"), F.col("end_timestamp").alias("e__")).where("s__ <= e__").distinct()
    spans = spans.withColumn("b__", F.explode(F.sequence(second(F.col("s__")), second(F.col("e__")))))
    hit = (F.col("b__") == second(F.col(ts))) & (F.col(ts) >= F.col("s__")) & (F.col(ts) <= F.col("e__"))
    times = pv.select(ts).distinct().join(spans, hit, "left_semi").select(F.col(ts).alias("hit__"))
    return pv.join(times, F.col(ts) == F.col("hit__"), "left").withColumn("is_anomaly", F.col("hit__").isNotNull().cast("int")).drop("hit__")


def lookback_events(events: DataFrame, target: str, seconds: int = 300, key: str = "equipment_id") -> DataFrame:
    """For each target event, the other events of its key at most so many seconds earlier: target_time, event_type, time."""
    width = seconds * 1_000_000
    e = events.select(key, "event_type", "time", micros(F.col("time")).alias("us"))
    targets = e.where(F.col("event_type") == target).select(F.col(key).alias("k__"), F.col("time").alias("target_time"), F.col("us").alias("tus"))
    targets = targets.withColumn("b__", F.explode(F.array(F.floor(F.col("tus") / width), F.floor(F.col("tus") / width) - 1)))
    e = e.withColumn("b", F.floor(F.col("us") / width))
    hit = (F.col("k__") == F.col(key)) & (F.col("b__") == F.col("b")) & (F.col("us") < F.col("tus")) & (F.col("us") >= F.col("tus") - width)
    return e.join(targets, hit).select(key, "target_time", "event_type", "time")


def label_failure_horizon(df: DataFrame, hours: int, key: str = "equipment_id") -> DataFrame:
    """label 1 if a failure of the same equipment follows within (t, t + hours]: the next failure's time, by a frame over the rows in reverse that only grows, no join."""
    us = micros(F.col("time"))
    later = Window.partitionBy(key).orderBy(us.desc()).rangeBetween(Window.unboundedPreceding, -1)
    following = F.min(F.when(F.col("failure") == 1, us)).over(later)
    return df.withColumn("label", F.coalesce((following - us <= hours * 3_600_000_000).cast("int"), F.lit(0)))


def _edge(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") == kind)


def wafer_lot_equipment(edges: DataFrame) -> DataFrame:
    """wafer, lot, equipment along BELONGS_TO and PROCESSED_AT."""
    belongs = _edge(edges, "BELONGS_TO").select(F.col("src_id").alias("wafer_id"), F.col("dst_id").alias("lot_id"))
    at = _edge(edges, "PROCESSED_AT").select(F.col("src_id").alias("lot_id"), F.col("dst_id").alias("equipment_id"))
    return belongs.join(at, "lot_id").select("wafer_id", "lot_id", "equipment_id")


def lots_in_process(edges: DataFrame, lots: DataFrame, equipment: str) -> DataFrame:
    """Lots processed at an equipment with their status."""
    at = _edge(edges, "PROCESSED_AT").where(F.col("dst_id") == equipment).select(F.col("src_id").alias("lot_id")).distinct()
    return lots.join(at, "lot_id").select("lot_id", "status")


def lot_genealogy(steps: DataFrame, equipment: DataFrame, lot: str) -> DataFrame:
    """A lot's history over equipment, by start."""
    return steps.where(F.col("lot_id") == lot).join(equipment, "equipment_id").select("lot_id", "start_time", "equipment_id", "name").orderBy("start_time", "equipment_id")


def lot_with_wafer_count(lots: DataFrame, wafers: DataFrame) -> DataFrame:
    """Each lot with the number of its wafers (0 without any); wafers are counted before the join."""
    n = wafers.groupBy("lot_id").agg(F.count("*").alias("wafer_count"))
    return lots.join(n, "lot_id", "left").select("lot_id", "status", F.coalesce("wafer_count", F.lit(0)).alias("wafer_count"))


def equipment_alarms(alarms: DataFrame, equipment: str, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Newest alarms of an equipment."""
    found = alarms.where(F.col("equipment_id") == equipment)
    if severity:
        found = found.where(F.col("severity") == severity)
    return found.orderBy(F.col("time").desc(), F.col("alarm_id").desc()).limit(limit)


def alarm_lot_impact(alarms: DataFrame, steps: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Lots at the alarm's equipment that started within so many seconds before it; impact HIGH for critical or major alarms, else LOW.

    Of a lot's starts at an equipment an alarm meets the last one before it only, so each pair comes once and pairs are neither
    shuffled nor compared; only those of an alarm_id with several rows are.
    """
    width = seconds * 1_000_000
    size = max(-(-width // 4), 1)  # of four buckets in the time before an alarm, a fifth of what is compared does not meet
    impact = F.when(F.col("severity").isin("CRITICAL", "MAJOR"), "HIGH").otherwise("LOW")
    a = alarms.select("alarm_id", F.col("equipment_id").alias("e__"), impact.alias("impact_level"), micros(F.col("time")).alias("t")).distinct()
    a = a.withColumn("several__", F.count("*").over(Window.partitionBy("alarm_id")) > 1).withColumn("b__", F.floor(F.col("t") / size))
    s = steps.select("lot_id", "equipment_id", micros(F.col("start_time")).alias("s")).distinct()
    s = s.withColumn("next__", F.lead("s").over(Window.partitionBy("equipment_id", "lot_id").orderBy("s"))).withColumn("b", F.floor(F.col("s") / size)).withColumn("b", F.explode(F.array(*[F.col("b") + i for i in range(5)])))
    hit = (F.col("e__") == F.col("equipment_id")) & (F.col("b__") == F.col("b")) & (F.col("s") <= F.col("t")) & (F.col("s") > F.col("t") - width) & (F.col("next__").isNull() | (F.col("next__") > F.col("t")))
    pairs = lambda some: s.join(some, hit).select("alarm_id", "lot_id", "impact_level")
    return pairs(a.where("NOT several__")).unionByName(pairs(a.where("several__")).distinct())


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("\x1f", F.least(a, b), F.greatest(a, b))


def validate_relationships(found: DataFrame, causal: DataFrame, impossible: DataFrame) -> DataFrame:
    """Without impossible pairs (in either order); rules of experts raise the confidence by 0.2 (at most 1), others are flagged and get 0.5 at most as pending."""
    bad = impossible.select(pair_key(F.col("param1"), F.col("param2")).alias("pair__")).distinct()
    rules = causal.select(F.col("source").alias("s__"), F.col("target").alias("t__"), F.lit(True).alias("known__")).distinct()
    left = found.withColumn("pair__", pair_key(F.col("source"), F.col("target"))).join(bad, "pair__", "left_anti").drop("pair__")
    both = left.join(rules, (F.col("source") == F.col("s__")) & (F.col("target") == F.col("t__")), "left")
    known = F.col("known__").isNotNull()
    return both.withColumn("confidence", F.when(known, F.least(F.lit(1.0), F.col("confidence") + 0.2)).otherwise(F.least(F.col("confidence"), F.lit(0.5)))).withColumn("verification_status", F.when(known, "expert_confirmed").otherwise("pending")).drop("s__", "t__", "known__")


def find_bidirectional(causal: DataFrame) -> DataFrame:
    """Pairs that are causal in both directions, once each: both directions meet in one group, no self-join."""
    d = causal.where("is_causal").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("up")).where("a <> b")
    return d.groupBy("a", "b").agg(F.count_distinct("up").alias("n")).where("n = 2").select("a", "b")


def knowledge_lookup(table: DataFrame, kind: str, key: str) -> DataFrame:
    """What the experts' tables (sources.files.read_expert_knowledge) say of one key.

    kind 'causes' or 'effects' of a parameter, from the causal rules, most confident first; 'alarm_causes' of an alarm
    code by priority; 'leading_indicators' of an event, earliest first; 'group' of a parameter, the first by name that holds it.
    """
    if kind == "alarm_causes":
        return table.where(F.col("alarm_code") == key).orderBy("priority", "cause_parameter")
    if kind == "leading_indicators":
        return table.where(F.col("target_event") == key).orderBy(F.col("lead_time").desc(), "indicator")
    if kind == "group":
        return table.where(F.array_contains("parameters", key)).orderBy("group_name").limit(1)
    if kind not in ("causes", "effects"):
        raise ValueError(f"unknown kind {kind}")
    own, other = ("target", "source") if kind == "causes" else ("source", "target")
    return table.where(F.col(own) == key).select(F.col(other).alias("parameter"), "relation_type", "confidence").orderBy(F.col("confidence").desc(), "parameter")


def alarm_checklist(causes: DataFrame, code: str | None = None) -> DataFrame:
    """Checks by priority, with the first two as suspects."""
    if code is not None:
        causes = causes.where(F.col("alarm_code") == code)
    rn = F.row_number().over(Window.partitionBy("alarm_code").orderBy("priority", "cause_parameter"))
    return causes.withColumn("step", rn).withColumn("is_suspect", F.col("step") <= 2)
