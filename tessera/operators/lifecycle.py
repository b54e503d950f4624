"""Bot lifecycle: failure streaks, transitions, identity changes, sessions by gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Transitions that the lifecycle allows, by state before.
ALLOWED = {
    "UNINITIALIZED": ("QR_READY", "ONLINE", "ERROR"),
    "QR_READY": ("ONLINE", "QR_EXPIRED", "ERROR"),
    "QR_EXPIRED": ("QR_READY", "ERROR"),
    "ONLINE": ("DISCONNECTED", "QR_EXPIRED", "ERROR"),
    "DISCONNECTED": ("ONLINE", "QR_READY", "QR_EXPIRED", "ERROR"),
    "ERROR": ("QR_READY", "ONLINE", "DISCONNECTED"),
}


def failure_streaks(df: DataFrame, key: str, order: str, failed: str, n: int = 10) -> DataFrame:
    """Rows at which the run of failures reaches ``n`` (and starts anew)."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_island", island).filter(F.col(failed))
    run = F.row_number().over(Window.partitionBy(key, "_island").orderBy(order)).cast("long")
    return rows.withColumn("run", run).filter(F.col("run") % n == 0).drop("_island")


def invalid_transitions(df: DataFrame, key: str, order: str, state: str) -> DataFrame:
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(order)), F.lit("UNINITIALIZED"))
    rows = df.withColumn("before", before)
    ok = F.col(state) == F.col("before")
    for b, after in ALLOWED.items():
        ok = ok | ((F.col("before") == b) & F.col(state).isin(*after))
    return rows.filter(~ok)


def identity_changes(df: DataFrame, key: str, order: str, who: str) -> DataFrame:
    before = F.lag(who).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("before", before).filter(F.col("before").isNotNull() & F.col(who).isNotNull() & (F.col("before") != F.col(who)))


def drop_stale(df: DataFrame, key: str, order: str, generation: str) -> DataFrame:
    """Rows of the newest generation seen so far; what an older client still sends goes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_newest", F.max(generation).over(w)).filter(F.col(generation) == F.col("_newest")).drop("_newest")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Spans of writes with less than ``gap`` between neighbours."""
    rows = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_write"), F.max(ts).alias("last_write"), F.count("*").alias("writes"))
    return rows.drop("w")


def log_line(**fields: Column | str) -> Column:
    """``name=value`` pairs in the order given; a null value is written as ``null``."""
    parts = []
    for name, value in fields.items():
        text = F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("null"))
        parts.append(F.concat(F.lit(f"{name}="), text))
    return F.concat_ws(" ", *parts)


def alerts(df: DataFrame, kind: str, key: str, measure: str, critical_from: int, message: str) -> DataFrame:
    """A warning for each row, and a critical line besides where the measure reaches its limit."""
    warning = log_line(type=kind, botId=F.col(key), **{measure: F.col(measure)}, severity="WARN")
    critical = log_line(type=f"{kind}_CRITICAL", botId=F.col(key), **{measure: F.col(measure)}, severity="CRITICAL", message=f'"{message}"')
    lines = F.when(F.col(measure) >= critical_from, F.array(warning, critical)).otherwise(F.array(warning))
    return df.withColumn("line", F.explode(lines))


def token_status(given: Column, token: str) -> Column:
    """200 or 401; digests of equal length are compared, so the time taken says nothing of the token."""
    return F.when(F.sha2(F.coalesce(given, F.lit("")), 256) == F.sha2(F.lit(token), 256), 200).otherwise(401)
