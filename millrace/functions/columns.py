"""Column expressions that several operators share. All are built-in functions inside code generation."""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def fresh(df: DataFrame, *names: str) -> None:
    """Raise where a column that an operator adds would take the place of one of df's own; names that end in `__` are the operators'."""
    if clash := sorted({c for c in df.columns if c in names or c.endswith("__")}):
        raise ValueError(f"columns {', '.join(clash)} exist already; rename them first")


def appends(*names: str):
    """For operators whose first argument is a table to which they add these columns: see fresh()."""

    def wrap(f):
        @wraps(f)
        def checked(df: DataFrame, *args, **kwargs):
            fresh(df, *names)
            return f(df, *args, **kwargs)

        return checked

    return wrap


def added(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns, none of which takes the place of one of its own."""
    fresh(df, *new)
    return df.withColumns(new)


def corr(a: str | Column, b: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation over the rows that have both, as an aggregate or over a window; null where one of them is constant (the built-in function fails there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    both, x, y = (p.over(over) for p in parts) if over is not None else parts
    r = both / F.nullif(x * y, F.lit(0.0))
    return F.when(F.isnan(r), r).when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fdc_status(value: Column, usl: Column, lsl: Column) -> Column:
    """ALARM outside a limit, WARNING in the outer tenth of the band, else NORMAL; null values are NORMAL, zero limits count."""
    band = (usl - lsl) * 0.1
    return F.when((value > usl) | (value < lsl), "ALARM").when((value > usl - band) | (value < lsl + band), "WARNING").otherwise("NORMAL")


def normalize_timestamp(raw: Column) -> Column:
    """A timestamp from ISO text (also with Z), epoch milliseconds (above 1e12) or epoch seconds, all given as text."""
    number = raw.try_cast("double")
    millis = F.timestamp_millis(number.cast("long"))
    seconds = F.timestamp_micros((number * 1_000_000).cast("long"))
    return F.when(number > 1e12, millis).when(number.isNotNull(), seconds).otherwise(raw.try_cast("timestamp"))


def route_topic_name(topic: Column) -> Column:
    """fdc.FDC.X becomes fdc.X: the schema in the middle goes."""
    return F.regexp_replace(topic, r"^([^.]+)\.[^.]+\.([^.]+)$", "$1.$2")


def table_of_topic(topic: Column) -> Column:
    return F.element_at(F.split(topic, r"\."), -1)


#: Coefficients of the rational approximation of erfc (relative error below 1.2e-7), highest power first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def erfc_sql(x: str) -> str:
    """erfc as SQL that Spark and DuckDB both run."""
    t = f"(1e0 / (1e0 + 0.5e0 * abs({x})))"
    poly = reduce(lambda acc, c: f"({c!r} + {t} * {acc})" if acc else repr(c), ERFC, "")
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(CASE WHEN ({x}) >= 0 THEN {tail} ELSE 2e0 - {tail} END)"


def normal_cdf_sql(z: str) -> str:
    return f"(0.5e0 * {erfc_sql(f'(-({z}) / sqrt(2e0))')})"


def normal_cdf(z: str) -> Column:
    """The normal distribution function of a column given by name or SQL."""
    return F.expr(normal_cdf_sql(z))


def register_spc_function(spark: SparkSession) -> None:
    """check_spc_rules(vals, ucl, lcl, center): rule names for the newest value (last), callable from SQL."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION check_spc_rules(vals ARRAY<DOUBLE>, ucl DOUBLE, lcl DOUBLE, center DOUBLE) RETURNS ARRAY<STRING>
        RETURN array_compact(array(
          CASE WHEN element_at(vals, -1) > ucl OR element_at(vals, -1) < lcl THEN 'RULE1_BEYOND_3SIGMA' END,
          CASE WHEN size(vals) >= 9 AND forall(slice(vals, -9, 9), v -> v > center) THEN 'RULE2_RUN_ABOVE'
               WHEN size(vals) >= 9 AND forall(slice(vals, -9, 9), v -> v < center) THEN 'RULE2_RUN_BELOW' END))""")


def spc_rules_array(vals: Column, ucl: Column, lcl: Column, center: Column) -> Column:
    """check_spc_rules() as a column expression."""
    last, nine = F.element_at(vals, -1), F.slice(vals, -9, 9)
    long = F.size(vals) >= 9
    run = F.when(long & F.forall(nine, lambda v: v > center), "RULE2_RUN_ABOVE").when(long & F.forall(nine, lambda v: v < center), "RULE2_RUN_BELOW")
    return F.array_compact(F.array(F.when((last > ucl) | (last < lcl), "RULE1_BEYOND_3SIGMA"), run))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, the order for range frames."""
    return F.unix_micros(ts.cast("timestamp"))
