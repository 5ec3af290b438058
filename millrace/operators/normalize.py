"""Change logs and raw records into clean rows: projections, predicates and scalar work only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import normalize_timestamp


def cdc_unwrap(changes: DataFrame) -> DataFrame:
    """The row after a change (before it, for deletes) with op, table, ts_ms and deleted; tombstones (no op) go."""
    gone = F.col("op") == "d"
    row = F.when(gone, F.col("before")).otherwise(F.col("after"))
    kept = changes.where(F.col("op").isNotNull()).select(row.alias("row__"), "op", F.col("source.table").alias("table"), F.col("source.ts_ms").alias("ts_ms"), gone.alias("deleted"))
    return kept.where(F.col("row__").isNotNull()).select("row__.*", "op", "table", "ts_ms", "deleted")


def cdc_latest_state(changes: DataFrame, keys: list[str], order: str = "ts_ms") -> DataFrame:
    """The newest row of each key; keys whose newest change is a delete are left out. Aggregates, so hot keys combine before the shuffle."""
    names = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(F.col(order), F.xxhash64(*names))).alias("row__"))
    return newest.select(*keys, "row__.*").where(~F.col("deleted"))


def apply_column_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source columns under the names of the model; other columns stay."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def coalesce_aliases(df: DataFrame, fields: dict[str, str], required: list[str]) -> DataFrame:
    """Fields that come in upper or lower case as one column of the given type; rows without a required field go. Zero is a value."""
    names = set(df.columns)

    def one(field: str, kind: str) -> Column:
        found = [F.col(n) for n in (field.upper(), field.lower()) if n in names]
        return (F.coalesce(*found) if found else F.lit(None)).cast(kind).alias(field.lower())

    out = df.select(*[one(f, k) for f, k in fields.items()])
    return out.where(" AND ".join(f"`{r.lower()}` IS NOT NULL" for r in required)) if required else out


#: Alarm levels.
SEVERITIES = {"1": "CRITICAL", "2": "MAJOR", "3": "MINOR", "4": "WARNING", "5": "INFO"}


def normalize_alarm(alarms: DataFrame) -> DataFrame:
    """Alarms in the model's form: severity by number or name (WARNING otherwise), affected lots as an array, values as a context map."""
    level = F.upper(F.trim(F.col("alarm_level").cast("string")))
    by_number = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    severity = F.coalesce(F.try_element_at(by_number, level), F.when(level.isin(*SEVERITIES.values()), level), F.lit("WARNING"))
    context = F.map_filter(F.create_map(F.lit("alarm_value"), F.col("alarm_value").cast("string"), F.lit("threshold"), F.col("threshold").cast("string")), lambda k, v: v.isNotNull())
    return alarms.select(
        normalize_timestamp(F.col("alarm_time").cast("string")).alias("time"), "alarm_id", "alarm_code", "alarm_name", severity.alias("severity"), F.lit("FAULT").alias("category"), "equipment_id", "lot_id", F.lit("ACTIVE").alias("status"),
        F.array_compact(F.array("lot_id")).alias("affected_lots"), context.alias("context"),
    )


def filter_measurements(df: DataFrame, equipment: str | None = None, param: str | None = None, since=None, until=None, limit: int = 100) -> DataFrame:
    """The newest `limit` measurements under the given predicates; ties on time by id."""
    for name, value, op in (("equipment_id", equipment, "="), ("param_id", param, "="), ("time", since, ">="), ("time", until, "<=")):
        if value is not None:
            c = F.col(name)
            df = df.where(c == value if op == "=" else c >= F.lit(value) if op == ">=" else c <= F.lit(value))
    return df.orderBy(F.col("time").desc(), F.col("measurement_id").desc()).limit(limit)


def filter_anomalies(df: DataFrame, equipment: str | None = None, severity: str | None = None, rule: str | None = None, since=None, limit: int = 100) -> DataFrame:
    """Anomalies or rule violations, newest first."""
    if equipment is not None:
        df = df.where(F.col("equipment_id") == equipment)
    if severity is not None:
        df = df.where(F.col("severity") == severity)
    if rule is not None:
        df = df.where(F.array_contains("rule_violations", rule))
    if since is not None:
        df = df.where(F.col("time") >= F.lit(since))
    return df.orderBy(F.col("time").desc(), F.col("measurement_id").desc()).limit(limit)


def alarm_history(alarms: DataFrame, hours: int, now, equipment: str | None = None, code: str | None = None) -> DataFrame:
    """Per equipment: alarms of the last hours before now, and those of them that are active."""
    recent = alarms.where((F.col("time") > F.lit(now) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("time") <= F.lit(now)))
    if equipment is not None:
        recent = recent.where(F.col("equipment_id") == equipment)
    if code is not None:
        recent = recent.where(F.col("alarm_code") == code)
    return recent.groupBy("equipment_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ACTIVE").alias("active"))


def list_entities(df: DataFrame, filters: dict[str, str], order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of entities; order must end in a unique column."""
    for name, value in filters.items():
        df = df.where(F.col(name) == value)
    return df.orderBy(*order).offset(offset).limit(limit)
