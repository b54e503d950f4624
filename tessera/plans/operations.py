"""Queries over metrics, lifecycle, registry and fan-out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import collated as C
from ..operators import lifecycle as L
from ..operators import metrics as X
from ..operators import registry as R
from .catalog import query


@query("metrics_by_type", "SELECT type, count(*) AS n FROM metric GROUP BY type UNION ALL SELECT 'total', count(*) FROM metric", "metric")
def _(t):
    return X.by_type(t.metric)


@query("metrics_rounds", "SELECT sum(fc_rounds)::bigint AS rounds, max(fc_rounds) AS most FROM metric", "metric")
def _(t):
    return t.metric.agg(F.sum("fc_rounds").alias("rounds"), F.max("fc_rounds").alias("most"))


@query("metrics_int_avg", "SELECT type, CASE WHEN sum(llm_calls) = 0 THEN 0 ELSE sum(llm_ms)::bigint // sum(llm_calls)::bigint END AS avg_llm_ms FROM metric GROUP BY type", "metric")
def _(t):
    return t.metric.groupBy("type").agg(F.sum("llm_ms").alias("ms"), F.sum("llm_calls").alias("n")).select("type", X.integer_average("ms", "n", "avg_llm_ms"))


@query(
    "message_stats",
    """WITH p AS (SELECT user_id, sum(fc_rounds)::bigint AS rounds, sum(llm_calls)::bigint AS calls, sum(llm_ms)::bigint AS llm, sum(total_ms)::bigint AS ms, count(*) AS n FROM metric GROUP BY 1)
    SELECT user_id, rounds, calls, ms // n AS avg_ms, CASE WHEN calls = 0 THEN 0 ELSE llm // calls END AS avg_llm_ms FROM p""",
    "metric",
)
def _(t):
    return X.message_stats(t.metric)


@query("latency_percentiles", "SELECT quantile_disc(total_ms, 0.5) AS p50, quantile_disc(total_ms, 0.95) AS p95, count(*) AS n FROM (SELECT total_ms FROM metric ORDER BY event_id DESC LIMIT 200)", "metric")
def _(t):
    return X.percentiles(X.ring(t.metric, "event_id"), "total_ms")


def _nearest(column: str, by: str = "") -> str:
    """Nearest ranks by numbering all rows."""
    group = f"PARTITION BY {by} " if by else ""
    rows = f"SELECT *, row_number() OVER ({group}ORDER BY {column}) AS rn, count({column}) OVER ({group}) AS c FROM metric"
    at = lambda p: f"coalesce(min({column}) FILTER (rn >= greatest(1, ceil({p}::double * c))), 0)"
    return f"SELECT {by + ', ' if by else ''}{at(0.5)} AS p50, {at(0.95)} AS p95, count(*) AS n FROM ({rows}) {'GROUP BY ' + by if by else ''}"


@query("latency_by_user", _nearest("total_ms", "user_id"), "metric")
def _(t):
    return X.percentiles(t.metric, "total_ms", ["user_id"])


@query("latency_by_type", _nearest("total_ms", "type"), "metric")
def _(t):
    return X.percentiles(t.metric, "total_ms", ["type"])


@query("value_percentiles", _nearest("value").replace("FROM metric", "FROM events"))
def _(t):
    return X.percentiles(t.events, "value")


@query("latency_ring_200", "SELECT event_id, total_ms FROM metric ORDER BY event_id DESC LIMIT 200", "metric")
def _(t):
    return X.ring(t.metric, "event_id").select("event_id", "total_ms")


@query(
    "health_rollup",
    "SELECT count(*) FILTER (state = 'ONLINE') AS online, count(*) FILTER (state = 'ERROR') AS error, count(*) FILTER (state = 'DISCONNECTED') AS disconnected, count(*) AS total FROM (SELECT bot_id, arg_max(state, seq) AS state FROM state GROUP BY bot_id)",
    "state",
)
def _(t):
    return X.health(R.latest(t.state, "bot_id", "seq", "state", "state"))


@query(
    "failure_streaks",
    """WITH i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY bot_id ORDER BY seq) AS island FROM heartbeat),
    r AS (SELECT *, row_number() OVER (PARTITION BY bot_id, island ORDER BY seq) AS run FROM i WHERE failed) SELECT bot_id, seq, run FROM r WHERE run % 3 = 0""",
    "heartbeat",
)
def _(t):
    return L.failure_streaks(t.heartbeat, "bot_id", "seq", "failed", 3).select("bot_id", "seq", "run")


@query(
    "state_transitions_invalid",
    """WITH b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY bot_id ORDER BY seq), 'UNINITIALIZED') AS before FROM state)
    SELECT bot_id, seq, before, state FROM b WHERE before <> state AND NOT (
      (before = 'UNINITIALIZED' AND state IN ('QR_READY', 'ONLINE', 'ERROR')) OR (before = 'QR_READY' AND state IN ('ONLINE', 'QR_EXPIRED', 'ERROR'))
      OR (before = 'QR_EXPIRED' AND state IN ('QR_READY', 'ERROR')) OR (before = 'ONLINE' AND state IN ('DISCONNECTED', 'QR_EXPIRED', 'ERROR'))
      OR (before = 'DISCONNECTED' AND state IN ('ONLINE', 'QR_READY', 'QR_EXPIRED', 'ERROR')) OR (before = 'ERROR' AND state IN ('QR_READY', 'ONLINE', 'DISCONNECTED')))""",
    "state",
)
def _(t):
    return L.invalid_transitions(t.state, "bot_id", "seq", "state").select("bot_id", "seq", "before", "state")


@query("degradations", "SELECT bot_id, seq FROM (SELECT *, lag(state) OVER (PARTITION BY bot_id ORDER BY seq) AS before FROM state) WHERE state = 'ERROR' AND before IN ('ONLINE', 'DISCONNECTED')", "state")
def _(t):
    before = F.lag("state").over(Window.partitionBy("bot_id").orderBy("seq"))
    return t.state.withColumn("before", before).filter("state = 'ERROR' and before in ('ONLINE', 'DISCONNECTED')").select("bot_id", "seq")


@query("stale_event_filter", "SELECT bot_id, seq, generation FROM (SELECT *, max(generation) OVER (PARTITION BY bot_id ORDER BY seq) AS g FROM state) WHERE generation = g", "state")
def _(t):
    return L.drop_stale(t.state, "bot_id", "seq", "generation").select("bot_id", "seq", "generation")


@query(
    "identity_changes",
    "SELECT event_type, event_id, user_id, before FROM (SELECT event_type, event_id, user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> user_id",
)
def _(t):
    return L.identity_changes(t.events.select("event_type", "event_id", "user_id"), "event_type", "event_id", "user_id")


@query(
    "cache_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first_write, max(ts) AS last_write, count(*) AS writes FROM s GROUP BY user_id, k""",
)
def _(t):
    return L.sessions(t.events.select("user_id", "ts"), "user_id", "ts")


@query("uptime_minutes", "SELECT user_id, (epoch(max(ts)) - epoch(min(ts)))::bigint // 60 AS minutes FROM events GROUP BY user_id")
def _(t):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", X.whole_minutes(F.col("a"), F.col("b")).alias("minutes"))


@query("misrouted_sends", "SELECT event_id, user_id, event_id % 7 AS target FROM events WHERE user_id % 7 <> event_id % 7")
def _(t):
    return t.events.select("event_id", "user_id", (F.col("event_id") % 7).alias("target")).filter(F.col("user_id") % 7 != F.col("target"))


@query("scan_registry", 'SELECT bot_id AS "botId", label, wechat_user_id AS "wechatUserId", created_at AS "createdAt" FROM registry_old ORDER BY created_at', "registry_old")
def _(t):
    return t.registry_old.select(
        F.col("bot_id").alias("botId"), "label", F.col("wechat_user_id").alias("wechatUserId"), F.col("created_at").alias("createdAt")
    ).orderBy("createdAt")


@query(
    "registry_upsert_coalesce",
    """SELECT coalesce(n.bot_id, o.bot_id) AS bot_id, coalesce(n.label, o.label) AS label, coalesce(n.wechat_user_id, o.wechat_user_id) AS wechat_user_id,
    coalesce(o.created_at, n.created_at) AS created_at, CASE WHEN n.bot_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE o.last_active_at END AS last_active_at
    FROM registry_old o FULL JOIN registry_new n ON o.bot_id = n.bot_id""",
    "registry_old",
    "registry_new",
)
def _(t):
    return R.upsert(t.registry_old, t.registry_new, "bot_id", ["label", "wechat_user_id"], "2024-02-01 00:00:00")


FOLDED = "lower(strip_accents(rtrim(bot_id)))"


@query(
    "registry_upsert_collated",
    f"""WITH n AS (SELECT {FOLDED} AS k, arg_min(bot_id, event_id) AS bot_id, arg_max(label, event_id) FILTER (label IS NOT NULL) AS label,
      arg_max(wechat_user_id, event_id) FILTER (wechat_user_id IS NOT NULL) AS wechat_user_id, min(ts) AS created_at FROM registry_spelled GROUP BY 1),
    o AS (SELECT *, {FOLDED} AS k FROM registry_old WHERE length(bot_id) < 7)
    SELECT coalesce(o.bot_id, n.bot_id) AS bot_id, coalesce(n.label, o.label) AS label, coalesce(n.wechat_user_id, o.wechat_user_id) AS wechat_user_id, coalesce(o.created_at, n.created_at) AS created_at,
      CASE WHEN n.k IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE o.last_active_at END AS last_active_at FROM o FULL JOIN n ON o.k = n.k""",
    "registry_old",
    "registry_spelled",
)
def _(t):
    new = C.one_each(t.registry_spelled, "bot_id", ["label", "wechat_user_id", "ts"], "event_id")
    first = C.one_each(t.registry_spelled, "bot_id", [], "ts").select("bot_id", F.col("_since").alias("created_at"))
    new = C.join(new.drop("ts", "_since"), first, ["bot_id"])
    return R.upsert(t.registry_old.filter("length(bot_id) < 7"), new, "bot_id", ["label", "wechat_user_id"], "2024-02-01 00:00:00", C.COLLATION)


@query("registry_delete_collated", f"SELECT * FROM registry_old WHERE {FOLDED} NOT IN (SELECT {FOLDED} FROM registry_spelled WHERE event_id % 9 = 0)", "registry_old", "registry_spelled")
def _(t):
    return R.delete(t.registry_old, t.registry_spelled.filter("event_id % 9 = 0"), "bot_id", C.COLLATION)


@query("writes_by_collated_bot", f"SELECT o.bot_id, count(*) AS writes, max(event_id) AS last FROM registry_old o JOIN (SELECT *, {FOLDED} AS k FROM registry_spelled) s ON lower(strip_accents(rtrim(o.bot_id))) = s.k GROUP BY 1", "registry_old", "registry_spelled")
def _(t):
    return C.join(t.registry_old.select("bot_id"), t.registry_spelled.select("bot_id", "event_id"), ["bot_id"]).groupBy("bot_id").agg(F.count("*").alias("writes"), F.max("event_id").alias("last"))


@query("registry_delete", "SELECT * FROM registry_old WHERE bot_id NOT IN (SELECT bot_id FROM registry_new WHERE label IS NULL)", "registry_old", "registry_new")
def _(t):
    return R.delete(t.registry_old, t.registry_new.filter("label is null"), "bot_id")


@query("registry_touch", "SELECT bot_id, CASE WHEN bot_id = 'bot_7' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_active_at END AS last_active_at FROM registry_old", "registry_old")
def _(t):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return t.registry_old.select("bot_id", F.when(F.col("bot_id") == "bot_7", now).otherwise(F.col("last_active_at")).alias("last_active_at"))


@query("registry_label_norm", "SELECT bot_id, nullif(trim(label), '') AS label FROM registry_old", "registry_old")
def _(t):
    return t.registry_old.select("bot_id", S.blank_to_null(F.col("label")).alias("label"))


@query("registry_reverse_lookup", "SELECT wechat_user_id, min(bot_id) AS bot_id FROM registry_old WHERE wechat_user_id IS NOT NULL GROUP BY 1", "registry_old")
def _(t):
    return t.registry_old.filter("wechat_user_id is not null").groupBy("wechat_user_id").agg(F.min("bot_id").alias("bot_id"))


@query("bot_summary_json", "SELECT bot_id, CASE WHEN label IS NULL THEN '{\"botId\":\"' || bot_id || '\"}' ELSE '{\"botId\":\"' || bot_id || '\",\"label\":\"' || label || '\"}' END AS summary FROM registry_old", "registry_old")
def _(t):
    return t.registry_old.select("bot_id", F.to_json(F.struct(F.col("bot_id").alias("botId"), "label")).alias("summary"))


@query(
    "entity_profile_4way",
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT s_nationkey AS nk, count(*) AS n FROM supplier GROUP BY 1),
    l AS (SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c_custkey, n_name AS nation, coalesce(o.n, 0) AS orders, coalesce(s.n, 0) AS suppliers, coalesce(l.n, 0) AS items FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o.k = c_custkey LEFT JOIN s ON s.nk = c_nationkey LEFT JOIN l ON l.k = c_custkey""",
)
def _(t):
    count = F.count("*").alias("n")
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(count)
    items = t.lineitem.select("l_orderkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.groupBy(F.col("o_custkey").alias("c_custkey")).agg(count)
    base = t.customer.select("c_custkey", F.col("c_nationkey").alias("nk"))
    base = base.join(t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation")), "nk", "left")
    base = base.join(t.supplier.groupBy(F.col("s_nationkey").alias("nk")).agg(F.count("*").alias("suppliers")), "nk", "left")
    out = R.fan_out(base, "c_custkey", {"orders": orders, "items": items})
    zero = F.lit(0).cast("long")
    return out.select("c_custkey", "nation", F.coalesce("orders.n", zero).alias("orders"), F.coalesce("suppliers", zero).alias("suppliers"), F.coalesce("items.n", zero).alias("items"))


@query("tools_called", "SELECT run, array_to_string(list_sort(list(DISTINCT name)), ',') AS tools FROM calls GROUP BY run", "calls")
def _(t):
    return t.calls.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tools"))


@query("generated_files", "SELECT run, string_agg(file_path, ',' ORDER BY p) AS files FROM (SELECT run, file_path, min(step_id) AS p FROM calls WHERE file_path IS NOT NULL GROUP BY ALL) GROUP BY run", "calls")
def _(t):
    first = t.calls.filter("file_path is not null").groupBy("run", "file_path").agg(F.min("step_id").alias("p"))
    rows = F.array_sort(F.collect_list(F.struct("p", "file_path")))
    return first.groupBy("run").agg(F.array_join(F.transform(rows, lambda x: x["file_path"]), ",").alias("files"))


@query(
    "alert_lines",
    """WITH a AS (SELECT event_id, user_id, event_id % 7 AS attempts FROM events WHERE event_type = 'error')
    SELECT event_id, 'type=LOGIN botId=' || user_id || ' attempts=' || attempts || ' severity=WARN' AS line FROM a
    UNION ALL SELECT event_id, 'type=LOGIN_CRITICAL botId=' || user_id || ' attempts=' || attempts || ' severity=CRITICAL message="failed three times"' FROM a WHERE attempts >= 3""",
)
def _(t):
    rows = t.events.filter("event_type = 'error'").select("event_id", "user_id", (F.col("event_id") % 7).alias("attempts"))
    return L.alerts(rows, "LOGIN", "user_id", "attempts", 3, "failed three times").select("event_id", "line")


@query("audit_lines", "SELECT seq, 'action=state_change botId=' || bot_id || ' from=' || coalesce(lag(state) OVER (PARTITION BY bot_id ORDER BY seq), 'null') || ' to=' || state AS line FROM state", "state")
def _(t):
    before = F.lag("state").over(Window.partitionBy("bot_id").orderBy("seq"))
    rows = t.state.withColumn("before", before)
    return rows.select("seq", L.log_line(action="state_change", botId=F.col("bot_id"), **{"from": F.col("before"), "to": F.col("state")}).alias("line"))


@query("token_status", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 200 ELSE 401 END AS status FROM events")
def _(t):
    given = F.when(F.col("event_id") % 3 == 0, "t0ken").when(F.col("event_id") % 3 == 1, F.col("props"))
    return t.events.select("event_id", L.token_status(given, "t0ken").alias("status"))
