"""Queries over conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import messages as M
from ..operators.collated import COLLATION
from ..sources import sinks
from ..sources import streams as N
from ..sources.shared import folder
from .catalog import query

PROMPT = "You are a helpful assistant."
KEYS = ["bot_id", "user_id"]


@query("retention_keep", "SELECT id, bot_id, user_id, turn, role, content FROM chat QUALIFY row_number() OVER (PARTITION BY bot_id, user_id ORDER BY id DESC) <= 4", "chat")
def _(t):
    return M.newest(t.chat, KEYS, "id", 4)


@query(
    "retention_deleted",
    "SELECT c.* FROM chat c LEFT JOIN (SELECT id FROM chat QUALIFY row_number() OVER (PARTITION BY bot_id, user_id ORDER BY id DESC) <= 4) k ON c.id = k.id WHERE k.id IS NULL",
    "chat",
)
def _(t):
    return M.retention_deleted(t.chat, KEYS, "id", 4)


@query("scan_conversation", "SELECT * FROM chat WHERE bot_id = 'bot_1' AND user_id = 6 ORDER BY id", "chat")
def _(t):
    return M.scan_session(t.chat, "bot_1", 6)


@query("scan_conversation_collated", "SELECT * FROM chat WHERE lower(strip_accents(rtrim(bot_id))) = 'bot_1' AND user_id = 6 ORDER BY id", "chat")
def _(t):
    return M.scan_session(t.chat, "BÖT_1 ", 6, COLLATION)


@query("latest_id", "SELECT bot_id, user_id, max(id) AS latest FROM chat GROUP BY ALL", "chat")
def _(t):
    return t.chat.groupBy(*KEYS).agg(F.max("id").alias("latest"))


@query("persistable_messages", "SELECT * FROM chat WHERE role <> 'system'", "chat")
def _(t):
    return t.chat.filter("role <> 'system'")


@query("conversation_clear", "SELECT * FROM chat WHERE NOT (bot_id = 'bot_1' AND user_id = 6)", "chat")
def _(t):
    return t.chat.filter(~((F.col("bot_id") == "bot_1") & (F.col("user_id") == 6)))


@query(
    "history_with_system",
    f"SELECT DISTINCT user_id, 0::bigint AS id, 'system' AS role, '{PROMPT}' AS content FROM chat UNION ALL SELECT user_id, id, role, content FROM chat WHERE role <> 'system'",
    "chat",
)
def _(t):
    return M.with_system_row(t.chat, "user_id", PROMPT)


@query(
    "cache_trim_keep",
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM chat WHERE role <> 'system')
    SELECT id, user_id, role FROM n WHERE r <= CASE WHEN c <= 4 THEN c ELSE 4 - (c - 4) % 2 END""",
    "chat",
)
def _(t):
    return M.cache_trim(t.chat.filter("role <> 'system'"), ["user_id"], "id", 2).select("id", "user_id", "role")


@query(
    "context_window_20",
    """WITH u AS (SELECT * FROM chat WHERE role <> 'system' AND content IS NOT NULL AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 20)
    SELECT user_id, count(*) AS n, string_agg(role || ': ' || content, chr(10) ORDER BY id) AS context FROM u GROUP BY user_id""",
    "chat",
)
def _(t):
    return M.context_window(t.chat, ["user_id"], "id", 20)


@query(
    "nth_turn_trigger",
    "SELECT user_id, id, n AS turn_no FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM chat WHERE role = 'user') WHERE n % 2 = 0",
    "chat",
)
def _(t):
    return M.nth_turn(t.chat.filter("role = 'user'"), "user_id", "id", 2).select("user_id", "id", "turn_no")


@query(
    "post_processing",
    """WITH r AS (SELECT user_id, id, length(content) AS n, row_number() OVER (PARTITION BY user_id ORDER BY id) AS turn_no FROM chat WHERE role = 'assistant'),
    f AS (SELECT *, turn_no % 2 = 0 AS due, turn_no % 2 = 0 AND n % 3 = 0 AS lost, n % 5 = 0 AS bad FROM r)
    SELECT user_id, id, turn_no, CASE WHEN lost THEN 'summarize' WHEN due THEN 'summarize,extract' ELSE 'extract' END AS ran, NOT lost AND NOT bad AS ok FROM f""",
    "chat",
)
def _(t):
    tasks = M.after_replies(t.chat.filter("role = 'assistant'"), "user_id", "id", 2)
    n = F.length("content")
    return M.task_outcomes(tasks, "user_id", "id", F.when(F.col("task") == "summarize", n % 3 == 0).otherwise(n % 5 == 0))


@query(
    "retention_by_increments",
    "SELECT id, bot_id, user_id, turn, role, content FROM chat QUALIFY row_number() OVER (PARTITION BY bot_id, user_id ORDER BY id DESC) <= 4",
    "chat",
)
def _(t):
    """The log in five batches, each of which reads and replaces the sessions that it touches."""
    path = f"{folder(t.spark)}/retention-{uuid.uuid4().hex}"
    write = sinks.retention_writer(path, KEYS, "id", 4, 16)
    for k in range(5):
        write(t.chat.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == k), k)
    return t.spark.read.parquet(path).drop("_bucket")


@query(
    "tool_pairs_sanitized",
    """WITH m AS (SELECT *, CASE WHEN role <> 'tool' THEN (role = 'assistant' AND has_calls) END AS lead_in FROM tool_chat),
    a AS (SELECT *, coalesce(last_value(lead_in IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ok FROM m),
    b AS (SELECT *, lead(role) OVER (PARTITION BY user_id ORDER BY id) AS nxt FROM a WHERE role <> 'tool' OR ok)
    SELECT id, user_id, role, has_calls FROM b WHERE NOT (role = 'assistant' AND has_calls) OR coalesce(nxt, '') = 'tool'""",
    "tool_chat",
)
def _(t):
    return M.sanitize_tool_pairs(t.tool_chat, "user_id", "id").select("id", "user_id", "role", "has_calls")


@query(
    "leading_tool_drop",
    """WITH m AS (SELECT *, max(CASE WHEN role NOT IN ('tool', 'system') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY id) AS s FROM (SELECT * FROM tool_chat WHERE turn >= 2))
    SELECT id, user_id, role FROM m WHERE role <> 'tool' OR s = 1""",
    "tool_chat",
)
def _(t):
    return M.drop_leading_tools(t.tool_chat.filter("turn >= 2"), "user_id", "id").select("id", "user_id", "role")


@query(
    "last_user_message",
    """SELECT user_id, arg_max(content, id) FILTER (role = 'user' AND content IS NOT NULL) AS last_with_text,
    arg_max(coalesce(content, ''), id) FILTER (role = 'user') AS last_any FROM chat GROUP BY user_id""",
    "chat",
)
def _(t):
    return M.last_user_message(t.chat, "user_id", "id")


@query(
    "loop_guard_cut",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step_id) - 1 AS step, ok AND coalesce(lag(ok) OVER (PARTITION BY run, call_key ORDER BY step_id), false) AS again FROM calls),
    c AS (SELECT *, coalesce(min(step) FILTER (again) OVER (PARTITION BY run), 15) AS stop FROM s)
    SELECT run, step_id, call_key, ok, step FROM c WHERE step <= stop AND step < 15""",
    "calls",
)
def _(t):
    return M.loop_guard(t.calls, "run", "call_key", "step_id", "ok").select("run", "step_id", "call_key", "ok", "step")


@query("tool_trace_rows", "SELECT id, user_id, role FROM tool_chat WHERE role = 'tool' OR (role = 'assistant' AND has_calls)", "tool_chat")
def _(t):
    return t.tool_chat.filter("role = 'tool' or (role = 'assistant' and has_calls)").select("id", "user_id", "role")


@query(
    "tool_rows_dedup",
    "SELECT tool_call_id, min(id) AS id, arg_min(user_id, id) AS user_id FROM tool_chat WHERE role = 'tool' GROUP BY tool_call_id",
    "tool_chat",
)
def _(t):
    return M.dedupe(t.tool_chat.filter("role = 'tool'").select("tool_call_id", "id", "user_id"), ["tool_call_id"], "id")


@query(
    "prompt_assembly",
    f"""WITH p AS (SELECT DISTINCT user_id, 0 AS slot, 0::bigint AS o, 'system' AS role, '{PROMPT}' AS content FROM chat
    UNION ALL SELECT user_id, 1, id, 'system', '[' || memory_type || '/' || dimension || '] ' || content FROM
      (SELECT * FROM memory WHERE status = 'active' AND user_id IN (SELECT user_id FROM chat) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 5)
    UNION ALL SELECT user_id, 2, id, role, content FROM chat WHERE role <> 'system')
    SELECT user_id, slot, role, content, row_number() OVER (PARTITION BY user_id ORDER BY slot, o) AS place FROM p""",
    "chat",
    "memory",
)
def _(t):
    chat = t.chat
    users = chat.select("user_id").distinct()
    head = users.select("user_id", F.lit(0).cast("long").alias("id"), F.lit("system").alias("role"), F.lit(PROMPT).alias("content"))
    known = M.newest(t.memory.filter("status = 'active'"), ["user_id"], "id", 5).join(users, "user_id", "left_semi")
    text = F.concat(F.lit("["), "memory_type", F.lit("/"), "dimension", F.lit("] "), "content")
    known = known.select("user_id", "id", F.lit("system").alias("role"), text.alias("content"))
    rest = chat.filter("role <> 'system'").select("user_id", "id", "role", "content")
    return M.assemble([(0, head), (1, known), (2, rest)], "user_id", "id")


@query(
    "domain_prompt_inject",
    """WITH f AS (SELECT *, min(id) FILTER (role = 'system') OVER (PARTITION BY user_id) AS first FROM chat)
    SELECT user_id, id, role, CASE WHEN id = first THEN 'Rules' || chr(10) || chr(10) || coalesce(content, '') ELSE content END AS content FROM f
    UNION ALL SELECT DISTINCT user_id, 0::bigint, 'system', 'Rules' FROM f WHERE first IS NULL""",
    "chat",
)
def _(t):
    return M.inject_prompt(t.chat, "user_id", "id", "Rules")


@query("reply_sendable", "SELECT id, NOT starts_with(CASE WHEN id % 3 = 0 THEN '【' || content ELSE content END, '【') AS sendable FROM chat", "chat")
def _(t):
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit("【"), "content")).otherwise(F.col("content"))
    return t.chat.select("id", S.sendable(reply).alias("sendable"))


RICH = """r AS (SELECT id, role, content, CASE id % 5 WHEN 0 THEN to_json({'role': role, 'n': id})::varchar WHEN 1 THEN '{broken' WHEN 2 THEN '  ' WHEN 3 THEN to_json({'content': substr(content, 1, 9)})::varchar END AS rich FROM chat)"""


@query(
    "message_decode",
    f"""WITH {RICH}, d AS (SELECT id, CASE WHEN trim(rich) <> '' AND json_valid(rich) THEN rich ELSE to_json({{'role': role, 'content': content}})::varchar END AS m FROM r)
    SELECT id, json_extract_string(m, '$.role') AS role, json_extract_string(m, '$.content') AS content, json_extract_string(m, '$.n') AS n FROM d""",
    "chat",
)
def _(t):
    m = F.col("id") % 5
    rich = (
        F.when(m == 0, F.to_json(F.struct("role", F.col("id").alias("n"))))
        .when(m == 1, "{broken")
        .when(m == 2, "  ")
        .when(m == 3, F.to_json(F.struct(F.substring("content", 1, 9).alias("content"))))
    )
    out = S.decode_message(rich, F.col("role"), F.col("content"))
    return t.chat.select("id", *(F.get_json_object(out, f"$.{n}").alias(n) for n in ("role", "content", "n")))


@query(
    "cache_read",
    """SELECT id, CASE WHEN id % 4 = 0 THEN 2 WHEN id % 4 = 1 AND json_valid(content) AND json_type(content) = 'ARRAY' THEN 0 END::bigint AS n_messages, id % 4 <> 0 AS miss FROM chat""",
    "chat",
)
def _(t):
    m = F.col("id") % 4
    one = F.struct("role", "content")
    value = F.when(m == 0, F.to_json(F.array(one, one))).when(m == 1, F.col("content")).when(m == 2, F.to_json(one)).otherwise("  ")
    found = S.cached_messages(value)
    return t.chat.select("id", F.when(found.isNotNull(), F.size(found)).cast("long").alias("n_messages"), found.isNull().alias("miss"))


@query(
    "inbound_items",
    """WITH m AS (SELECT bot_id, user_id::varchar AS user_id, id AS seq, turn, content, role FROM chat)
    SELECT bot_id, user_id, seq, 0::bigint AS item_no, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'voice' WHEN 2 THEN 'file' ELSE 'image' END AS kind, content AS body FROM m
    UNION ALL SELECT bot_id, user_id, seq, 2, 'text', role FROM m WHERE turn % 3 = 0""",
    "chat",
)
def _(t):
    turn = F.col("turn")
    item = lambda body, of: F.struct(*(F.when(of == i, body).alias(k) for i, k in enumerate(N.KINDS)))
    pushed = F.array(item(F.col("content"), turn % 4), item(F.lit(None).cast("string"), F.lit(0)), item(F.when(turn % 3 == 0, F.col("role")), F.lit(0)))
    return N.items(t.chat.select("bot_id", F.col("user_id").cast("string").alias("user_id"), F.col("id").alias("seq"), pushed.alias("items")))


@query("media_entries", "SELECT id, '[用户发送了一张图片，内容：' || content || ']' AS image, '[已发送图片，提示词：' || content || ']' AS drawing FROM chat", "chat")
def _(t):
    return t.chat.select("id", S.image_entry(F.col("content")).alias("image"), S.drawing_entry(F.col("content")).alias("drawing"))


@query("intent_marker", "SELECT id, starts_with(m, '[VOICE]') OR starts_with(m, '[VOICE_SWITCH:') AS marked, CASE WHEN id % 4 = 1 THEN 'v' || (id % 9)::varchar END AS voice FROM (SELECT id, CASE id % 4 WHEN 0 THEN '[VOICE] ' || role WHEN 1 THEN '[VOICE_SWITCH:v' || (id % 9)::varchar || ']' ELSE role END AS m FROM chat)", "chat")
def _(t):
    m = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("[VOICE] "), "role"))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("[VOICE_SWITCH:v"), (F.col("id") % 9).cast("string"), F.lit("]")))
        .otherwise(F.col("role"))
    )
    return t.chat.select("id", (m.startswith("[VOICE]") | m.startswith("[VOICE_SWITCH:")).alias("marked"), S.voice_switch(m).alias("voice"))


@query("file_text_head", "SELECT doc_id, substr(text, 1, 2000) AS head, length(text) > 2000 AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 1, 2000).alias("head"), (F.length("text") > 2000).alias("cut"))
