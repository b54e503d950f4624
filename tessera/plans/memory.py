"""Queries over versioned memory and preferences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import memory as Y
from ..operators import messages as M
from ..operators import notes as N
from ..operators import registry as R
from ..operators.routing import VOICES
from .catalog import query

TRIM = "lower(trim(dimension))"
VALID = "coalesce(trim(dimension) <> '' AND trim(content) <> '' AND action IN ('new', 'supersede', 'skip'), false)"
CHAIN = """log AS (SELECT * FROM memory_log WHERE action <> 'skip'), s AS (SELECT *,
    CASE WHEN action = 'supersede' THEN lag(id) OVER (PARTITION BY user_id, dimension ORDER BY id) END AS supersedes_id,
    CASE WHEN lead(action) OVER (PARTITION BY user_id, dimension ORDER BY id) = 'supersede' THEN 'superseded' ELSE 'active' END AS status FROM log)"""


@query("memory_entries_valid", f"SELECT id, {TRIM} AS dimension, content, action, CASE WHEN lower(trim(memory_type)) = 'preference' THEN 'preference' ELSE 'fact' END AS memory_type FROM entries WHERE {VALID}", "entries")
def _(t):
    return Y.entries(t.entries)[0]


@query("memory_entries_rejected", f"SELECT * FROM entries WHERE NOT {VALID}", "entries")
def _(t):
    return Y.entries(t.entries)[1]


@query("memory_supersede", f"WITH {CHAIN} SELECT id, user_id, dimension, action, supersedes_id, status FROM s", "memory_log")
def _(t):
    return Y.supersede(t.memory_log).select("id", "user_id", "dimension", "action", "supersedes_id", "status")


@query("memory_active_multi", f"WITH {CHAIN} SELECT user_id, dimension, count(*) AS n FROM s WHERE status = 'active' GROUP BY ALL", "memory_log")
def _(t):
    return Y.supersede(t.memory_log).filter("status = 'active'").groupBy("user_id", "dimension").agg(F.count("*").alias("n"))


@query("supersede_pairs", f"WITH {CHAIN} SELECT a.id, b.id AS old_id, a.content, b.content AS old_content FROM s a JOIN s b ON a.supersedes_id = b.id", "memory_log")
def _(t):
    return Y.supersede_pairs(Y.supersede(t.memory_log))


@query(
    "supersede_chains",
    f"""WITH RECURSIVE {CHAIN}, c AS (SELECT id, id AS root, 0::bigint AS depth FROM s WHERE supersedes_id IS NULL
      UNION ALL SELECT s.id, c.root, c.depth + 1 FROM s JOIN c ON s.supersedes_id = c.id) SELECT id, root, depth, false AS cyclic FROM c""",
    "memory_log",
)
def _(t):
    return Y.chains(Y.supersede(t.memory_log))


@query(
    "event_chains",
    "SELECT event_id AS id, first_value(event_id) OVER w AS root, row_number() OVER w - 1 AS depth, false AS cyclic FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
def _(t):
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return Y.chains(t.events.select(F.col("event_id").alias("id"), before.alias("supersedes_id")))


@query(
    "memory_stack_with_deletes",
    """WITH RECURSIVE e AS (SELECT user_id, dimension, id, action, NULL::bigint AS target FROM memory_log UNION ALL SELECT user_id, 'error', event_id, 'delete', event_id - 3 FROM events WHERE event_type = 'error'),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id, dimension ORDER BY id, action) AS n FROM e),
    r AS (SELECT DISTINCT user_id, dimension, 0::bigint AS n, []::bigint[] AS stack, NULL::bigint AS id, NULL::bigint AS old, NULL::bigint AS gone FROM l
      UNION ALL SELECT l.user_id, l.dimension, l.n, CASE WHEN l.action = 'delete' THEN [x for x in r.stack if x <> l.target] WHEN l.action = 'skip' THEN r.stack
        WHEN l.action = 'supersede' AND len(r.stack) > 0 THEN list_append(r.stack[1:len(r.stack) - 1], l.id) ELSE list_append(r.stack, l.id) END,
        CASE WHEN l.action IN ('new', 'supersede') THEN l.id END, CASE WHEN l.action = 'supersede' AND len(r.stack) > 0 THEN r.stack[len(r.stack)] END,
        CASE WHEN l.action = 'delete' AND list_contains(r.stack, l.target) THEN l.target END
      FROM r JOIN l ON r.user_id = l.user_id AND r.dimension = l.dimension AND l.n = r.n + 1)
    SELECT a.user_id, a.dimension, a.id, CASE WHEN s.old IS NOT NULL THEN 'superseded' WHEN d.gone IS NOT NULL THEN 'deleted' ELSE 'active' END AS status, a.old AS supersedes_id
    FROM r a LEFT JOIN r s ON s.old = a.id AND s.user_id = a.user_id AND s.dimension = a.dimension LEFT JOIN r d ON d.gone = a.id AND d.user_id = a.user_id AND d.dimension = a.dimension WHERE a.id IS NOT NULL""",
    "memory_log",
)
def _(t):
    log = t.memory_log.select("user_id", "dimension", "id", "action", F.lit(None).cast("long").alias("target"))
    gone = t.events.filter("event_type = 'error'").select(
        "user_id", F.lit("error").alias("dimension"), F.col("event_id").alias("id"), F.lit("delete").alias("action"), (F.col("event_id") - 3).alias("target")
    )
    return Y.supersede_with_deletes(log.unionByName(gone))


@query(
    "note_calls",
    """WITH p AS (SELECT call_id, user_id, try_cast(args AS json) IS NULL AS broken, trim(coalesce(json_extract_string(try_cast(args AS json), '$.operation'), '')) AS op,
      trim(coalesce(json_extract_string(try_cast(args AS json), '$.content'), '')) AS content, coalesce(try_cast(json_extract_string(try_cast(args AS json), '$.note_id') AS bigint), -1) AS target FROM note_calls),
    k AS (SELECT *, NOT broken AND trim(user_id) <> '' AS ok FROM p), w AS (SELECT * FROM k WHERE ok AND op = 'write' AND content <> ''),
    d AS (SELECT user_id, target, call_id FROM k WHERE ok AND op = 'delete'),
    n AS (SELECT w.*, min(d.call_id) AS gone FROM w LEFT JOIN d ON d.user_id = w.user_id AND d.target = w.call_id AND d.call_id > w.call_id GROUP BY ALL),
    l AS (SELECT k.call_id, n.call_id AS note_id, n.content FROM k JOIN n ON k.user_id = n.user_id AND n.call_id < k.call_id AND (gone IS NULL OR gone > k.call_id) WHERE k.ok AND k.op = 'list'
      QUALIFY row_number() OVER (PARTITION BY k.call_id ORDER BY n.call_id DESC) <= 50),
    j AS (SELECT call_id, to_json(list({'note_id': note_id, 'content': content} ORDER BY note_id DESC))::varchar AS notes FROM l GROUP BY 1)
    SELECT k.call_id, user_id, CASE WHEN broken THEN '{"error": "笔记操作异常"}' WHEN NOT ok THEN '{"error": "缺少用户上下文，无法操作记忆"}'
      WHEN op = 'write' THEN CASE WHEN content = '' THEN '{"error": "content 不能为空"}' ELSE '{"success": true, "note_id": ' || k.call_id || ', "message": "已记住，后续对话会自动参考该笔记"}' END
      WHEN op = 'list' THEN '{"success": true, "notes": ' || coalesce(notes, '[]') || '}' WHEN op = 'delete' THEN CASE WHEN target <= 0 THEN '{"error": "note_id 无效"}' ELSE '{"success": true, "message": "笔记已删除"}' END
      ELSE '{"error": "不支持的操作: ' || op || '，可用操作: write/list/delete"}' END AS answer FROM k LEFT JOIN j ON k.call_id = j.call_id""",
    "note_calls",
)
def _(t):
    return N.remember(t.note_calls)


@query("note_soft_delete", "WITH d AS (SELECT DISTINCT event_id AS id, user_id FROM events WHERE event_type = 'error') SELECT m.id, m.user_id, m.memory_type, CASE WHEN d.id IS NOT NULL THEN 'deleted' ELSE m.status END AS status FROM memory m LEFT JOIN d ON m.id = d.id AND m.user_id = d.user_id", "memory")
def _(t):
    gone = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id")
    return Y.soft_delete(t.memory, gone).select("id", "user_id", "memory_type", "status")


@query("memory_audit_trail", "SELECT * FROM memory WHERE user_id = 7 AND dimension = 'click' ORDER BY id", "memory")
def _(t):
    return t.memory.filter("user_id = 7 and dimension = 'click'").orderBy("id")


@query("memory_latest_dim", "SELECT user_id, dimension, max(id) AS id, arg_max(content, id) AS content FROM memory WHERE status = 'active' GROUP BY ALL", "memory")
def _(t):
    return Y.active(t.memory).groupBy("user_id", "dimension").agg(F.max("id").alias("id"), F.max_by("content", "id").alias("content"))


def _top(types: str, n: int) -> str:
    return f"SELECT id, user_id, memory_type, content FROM memory WHERE status = 'active' AND memory_type IN ({types}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= {n}"


@query("memory_top_facts", _top("'fact', 'preference'", 5), "memory")
def _(t):
    return M.newest(Y.active(t.memory, "fact", "preference"), ["user_id"], "id", 5).select("id", "user_id", "memory_type", "content")


@query("memory_latest_summary", _top("'summary'", 1), "memory")
def _(t):
    return M.newest(Y.active(t.memory, "summary"), ["user_id"], "id", 1).select("id", "user_id", "memory_type", "content")


@query("memory_top_notes", _top("'note'", 3), "memory")
def _(t):
    return M.newest(Y.active(t.memory, "note"), ["user_id"], "id", 3).select("id", "user_id", "memory_type", "content")


@query(
    "memory_injection",
    f"""WITH s AS (SELECT user_id, arg_max(content, id) AS summary FROM memory WHERE status = 'active' AND memory_type = 'summary' GROUP BY 1),
    f AS (SELECT user_id, string_agg('[' || memory_type || '/' || dimension || '] ' || content, chr(10) ORDER BY id DESC) AS facts FROM (SELECT * FROM memory WHERE status = 'active' AND memory_type IN ('fact', 'preference') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 5) GROUP BY 1),
    n AS (SELECT user_id, string_agg(content, chr(10) ORDER BY id DESC) AS notes FROM (SELECT * FROM memory WHERE status = 'active' AND memory_type = 'note' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 3) GROUP BY 1)
    SELECT u.user_id, summary, facts, notes FROM (SELECT DISTINCT user_id FROM memory) u LEFT JOIN s USING (user_id) LEFT JOIN f USING (user_id) LEFT JOIN n USING (user_id)""",
    "memory",
)
def _(t):
    return Y.injection(t.memory)


@query(
    "memory_known_facts",
    """WITH n AS (SELECT * FROM memory WHERE status = 'active' AND memory_type IN ('fact', 'preference') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 20)
    SELECT user_id, string_agg('- [' || dimension || '] ' || content, chr(10) ORDER BY id DESC) AS known FROM n GROUP BY user_id""",
    "memory",
)
def _(t):
    return Y.known_facts(t.memory)


@query("memory_provenance", "SELECT m.id, m.source_message_id, c.role, c.user_id AS source_user FROM memory m LEFT JOIN chat c ON m.source_message_id = c.id", "memory", "chat")
def _(t):
    source = t.chat.select(F.col("id").alias("source_message_id"), "role", F.col("user_id").alias("source_user"))
    return t.memory.select("id", "source_message_id").join(source, "source_message_id", "left")


@query(
    "pref_lookup_default",
    """WITH a AS (SELECT user_id, arg_max(voice, id) AS voice FROM preference WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, arg_max(voice, id) AS voice FROM preference WHERE event_type = 'signup' GROUP BY 1)
    SELECT u.user_id, coalesce(a.voice, b.voice, 'longanhuan') AS voice FROM (SELECT DISTINCT user_id FROM preference) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""",
    "preference",
)
def _(t):
    p = t.preference
    stores = [R.latest(p.filter(F.col("event_type") == k), "user_id", "id", "voice", "voice") for k in ("purchase", "signup")]
    return R.lookup(p, stores, "user_id", "voice", "longanhuan")


@query("pref_valid_writes", "SELECT * FROM preference WHERE voice IN (SELECT id FROM voices)", "preference", "voices")
def _(t):
    return t.preference.filter(F.col("voice").isin(*VOICES.values()))


@query("pref_reset", "SELECT * FROM preference WHERE user_id NOT IN (SELECT conv_id FROM conversations)", "preference")
def _(t):
    return R.delete(t.preference, t.conversations.select(F.col("conv_id").alias("user_id")), "user_id")
