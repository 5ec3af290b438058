"""The shared tables as tables of a factory, for Spark, and the same as SQL for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import fdc_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Added before rounding on both sides, so that exact halves round the same way in both engines.
NUDGE = 3e-10


def plain(sql: str) -> str:
    """The SQL with nudged rounding, and with conditional counts that are BIGINT and 0 over nothing."""
    out = sql.replace("round(", f"round({NUDGE!r} + ")
    while (at := out.find("count_if(")) >= 0:
        begin = end = at + len("count_if(")
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        out = f"{out[:at]}count(*) FILTER (WHERE {out[begin : end - 1]}){out[end:]}"
    return out


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows where there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = plain(sql)
        return f

    return put


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c + NUDGE, digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero as zero; timestamps without a zone."""
    fix = {"double": lambda c: rnd(c, digits), "float": lambda c: rnd(c.cast("double"), digits), "timestamp": lambda c: c.cast("timestamp_ntz")}
    return df.select(*[fix[t](F.col(f"`{c}`")).alias(c) if t in fix else F.col(f"`{c}`") for c, t in df.dtypes])


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def sensors(spark: SparkSession, d: str) -> DataFrame:
    """Sensor and quality measurements: events by ten pieces of equipment and five parameters."""
    e = load(spark, d, "events")
    base = e.select(
        F.col("event_id").alias("measurement_id"), (F.col("user_id") % 10).cast("string").alias("equipment_id"), F.col("event_type").alias("param_id"), F.col("ts").alias("time"), "value",
        F.lit(150.0).alias("usl"), F.lit(0.0).alias("lsl"), F.lit(50.0).alias("target"), F.lit(200.0).alias("ucl"), F.lit(-100.0).alias("lcl"), F.lit(50.0).alias("center"), F.lit(50.0).alias("sigma"), F.col("user_id"),
    )
    return base.withColumn("status", fdc_status(F.col("value"), F.col("usl"), F.col("lsl")))


M = """m AS (
  SELECT event_id AS measurement_id, CAST(user_id % 10 AS VARCHAR) AS equipment_id, event_type AS param_id, ts AS time, value, 150e0 AS usl, 0e0 AS lsl, 50e0 AS target, 200e0 AS ucl, -100e0 AS lcl, 50e0 AS center, 50e0 AS sigma, user_id,
         CASE WHEN value > 150 OR value < 0 THEN 'ALARM' WHEN value > 135 OR value < 15 THEN 'WARNING' ELSE 'NORMAL' END AS status
  FROM events
)"""


def alarms(spark: SparkSession, d: str) -> DataFrame:
    """Error events as alarms; code and level from the number in props."""
    return as_alarms(load(spark, d, "events"))


def as_alarms(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    level: Column = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "MAJOR", "MINOR", "WARNING", "INFO")]), k % 5 + 1)
    return e.select(F.col("event_id").alias("alarm_id"), (F.col("user_id") % 10).cast("string").alias("equipment_id"), F.concat(F.lit("A"), (k % 7).cast("string")).alias("alarm_code"), level.alias("severity"), F.lit("FDC").alias("source_system"), F.col("ts").alias("time"), F.when(k % 3 == 0, "ACTIVE").otherwise("CLEARED").alias("status"), "value")


A = """a AS (
  SELECT event_id AS alarm_id, CAST(user_id % 10 AS VARCHAR) AS equipment_id, 'A' || CAST(k % 7 AS VARCHAR) AS alarm_code, (['CRITICAL', 'MAJOR', 'MINOR', 'WARNING', 'INFO'])[k % 5 + 1] AS severity, 'FDC' AS source_system, ts AS time,
         CASE WHEN k % 3 = 0 THEN 'ACTIVE' ELSE 'CLEARED' END AS status, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error')
)"""

PARAMS = ["click", "error", "purchase", "signup", "view"]


def wide_hours(spark: SparkSession, d: str) -> DataFrame:
    """One row for each hour with all parameters: their mean values."""
    hours = load(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("time")).pivot("event_type", PARAMS).agg(F.avg("value"))
    return hours.na.drop(subset=PARAMS)


P = """p AS (
  SELECT date_trunc('hour', ts) AS time, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error, avg(value) FILTER (event_type = 'purchase') AS purchase,
         avg(value) FILTER (event_type = 'signup') AS signup, avg(value) FILTER (event_type = 'view') AS view
  FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5
)"""


def equipment(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as equipment: type by region, location by nation."""
    s, n, r = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").cast("string").alias("equipment_id"), F.col("s_name").alias("name"), F.col("r_name").alias("type"), F.col("n_name").alias("location"), F.when(F.col("s_acctbal") > 0, "RUNNING").otherwise("IDLE").alias("status"))


EQ = """eq AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS equipment_id, s_name AS name, r_name AS type, n_name AS location, CASE WHEN s_acctbal > 0 THEN 'RUNNING' ELSE 'IDLE' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def recipes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("recipe_id"), F.col("p_name").alias("recipe_name"), F.col("p_brand").alias("version"))


def lots(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("HOLD")
    end = F.expr("o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 40 AS INT), 0, 0, 0)")
    return o.select(F.col("o_orderkey").cast("string").alias("lot_id"), F.col("o_orderpriority").alias("current_step"), F.col("o_custkey").cast("string").alias("product_code"), status.alias("status"), F.col("o_orderdate").alias("start_time"), end.cast("timestamp_ntz").alias("end_time"))


L = """l AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS lot_id, o_orderpriority AS current_step, CAST(o_custkey AS VARCHAR) AS product_code, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'ACTIVE' ELSE 'HOLD' END AS status,
         o_orderdate AS start_time, o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS end_time
  FROM orders
)"""

#: Lines have no key of their own: these four columns make one.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Lines as production steps of lots at equipment."""
    line = load(spark, d, "lineitem")
    return line.select(
        F.concat_ws("-", *LINE).alias("step_id"), F.col("l_orderkey").cast("string").alias("lot_id"), F.col("l_suppkey").cast("string").alias("equipment_id"), F.col("l_partkey").cast("string").alias("recipe_id"), F.col("l_linenumber").alias("sequence_no"), F.col("l_shipdate").alias("start_time"),
        F.col("l_shipdate").alias("actual_start"), F.expr("l_shipdate + make_interval(0, 0, 0, 0, CAST(l_quantity AS INT), 0, 0)").cast("timestamp_ntz").alias("actual_end"), F.col("l_quantity").alias("value"),
    )


S = """s AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS step_id, CAST(l_orderkey AS VARCHAR) AS lot_id, CAST(l_suppkey AS VARCHAR) AS equipment_id, CAST(l_partkey AS VARCHAR) AS recipe_id, l_linenumber AS sequence_no,
         l_shipdate AS start_time, l_shipdate AS actual_start, l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS actual_end, l_quantity AS value
  FROM lineitem
)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Lines as cells: roll = part, module = order, pack = customer."""
    line, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    j = line.join(o, line.l_orderkey == o.o_orderkey)
    return j.select(
        F.concat_ws("-", *LINE).alias("cell_id"), F.col("l_partkey").cast("string").alias("roll_id"), F.col("l_orderkey").cast("string").alias("module_id"), F.col("o_custkey").cast("string").alias("pack_id"), F.col("l_quantity").alias("capacity_ah"), (F.col("l_discount") + 3.6).alias("voltage_v"),
        F.when(F.col("l_returnflag") == "R", "NG").otherwise(F.col("l_returnflag")).alias("grade"), F.col("l_shipdate").alias("formation_start"), F.expr("l_shipdate + make_interval(0, 0, 0, 0, CAST(l_quantity AS INT), 0, 0)").cast("timestamp_ntz").alias("formation_end"),
    )


C = """c AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cell_id, CAST(l_partkey AS VARCHAR) AS roll_id, CAST(l_orderkey AS VARCHAR) AS module_id, CAST(o_custkey AS VARCHAR) AS pack_id, l_quantity AS capacity_ah,
         l_discount + 3.6e0 AS voltage_v, CASE l_returnflag WHEN 'R' THEN 'NG' ELSE l_returnflag END AS grade, l_shipdate AS formation_start, l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS formation_end
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The foreign keys as typed edges: wafer (line) to lot, lot to equipment, lot to product, equipment to its nation."""
    st = steps(spark, d)
    lot = load(spark, d, "orders")
    sup = load(spark, d, "supplier")

    def one(df: DataFrame, sl: str, s: Column, kind: str, dl: str, t: Column) -> DataFrame:
        return df.select(F.lit(sl).alias("src_label"), s.cast("string").alias("src_id"), F.lit(kind).alias("type"), F.lit(dl).alias("dst_label"), t.cast("string").alias("dst_id")).distinct()

    out = one(st, "Wafer", F.concat(F.lit("W"), "step_id"), "BELONGS_TO", "Lot", F.concat(F.lit("L"), "lot_id"))
    out = out.unionByName(one(st, "Lot", F.concat(F.lit("L"), "lot_id"), "PROCESSED_AT", "Equipment", F.concat(F.lit("E"), "equipment_id")))
    out = out.unionByName(one(lot, "Lot", F.concat(F.lit("L"), "o_orderkey"), "MAKES", "Product", F.concat(F.lit("P"), "o_custkey")))
    return out.unionByName(one(sup, "Equipment", F.concat(F.lit("E"), "s_suppkey"), "LOCATED_IN", "Site", F.concat(F.lit("S"), "s_nationkey")))


G = f"""{S}, g AS (
  SELECT DISTINCT 'Wafer' AS src_label, 'W' || step_id AS src_id, 'BELONGS_TO' AS type, 'Lot' AS dst_label, 'L' || lot_id AS dst_id FROM s
  UNION ALL SELECT DISTINCT 'Lot', 'L' || lot_id, 'PROCESSED_AT', 'Equipment', 'E' || equipment_id FROM s
  UNION ALL SELECT DISTINCT 'Lot', 'L' || CAST(o_orderkey AS VARCHAR), 'MAKES', 'Product', 'P' || CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT DISTINCT 'Equipment', 'E' || CAST(s_suppkey AS VARCHAR), 'LOCATED_IN', 'Site', 'S' || CAST(s_nationkey AS VARCHAR) FROM supplier
)"""
