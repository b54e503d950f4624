"""Schemas of the logical tables and their bindings to the test tables.

A binding is a SELECT that both Spark and DuckDB understand; ``{name}`` stands
for a raw table. Queries read the binding as a DataFrame, oracles as a CTE, so
both sides start from the same rows while the operators differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.routing import PARAMETERS, SIGNALS, TOOLS, VOICES

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _struct(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name.rstrip("!"), _KINDS[kind], not name.endswith("!")))
    return T.StructType(fields)


_KINDS = {"long": T.LongType(), "string": T.StringType(), "ntz": T.TimestampNTZType()}

CHAT_MESSAGE = _struct("id! long,bot_id! string,user_id! string,role! string,content string,rich_content string,metadata string,created_at! ntz")
BOT_REGISTRY = _struct("bot_id! string,label string,wechat_user_id string,wechat_bot_id string,bot_token string,base_url string,created_at! ntz,last_active_at ntz,last_login_at ntz")
AGENT_MEMORY = _struct("id! long,user_id! string,memory_type! string,dimension! string,content! string,source_message_id long,status! string,supersedes_id long,created_at! ntz,updated_at ntz")

#: Logical tables with the column that they are clustered by.
TABLES = {"chat_message": (CHAT_MESSAGE, "user_id"), "bot_registry": (BOT_REGISTRY, "bot_id"), "agent_memory": (AGENT_MEMORY, "user_id")}


def create_tables(spark: SparkSession, database: str, buckets: int = 64) -> None:
    """The logical tables where they are missing, bucketed by the key that their reads and joins use."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (schema, key) in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS")


def _values(rows) -> str:
    """Rows for a VALUES list."""
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


BINDINGS = {
    "chat": """
        SELECT conv_id * 1000 + turn AS id, concat('bot_', cast(conv_id % 5 AS string)) AS bot_id, conv_id AS user_id,
               turn, role, text AS content FROM {conversations}""",
    "tool_chat": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS user_id, turn,
               CASE WHEN turn % 5 = 3 THEN 'tool' ELSE role END AS role,
               (role = 'assistant' AND turn % 5 = 2) AS has_calls,
               CASE WHEN turn % 5 = 3 THEN concat('call_', cast(conv_id AS string), '_', cast(turn % 10 AS string)) END AS tool_call_id,
               text AS content FROM {conversations}""",
    "memory_log": """
        SELECT event_id AS id, user_id, event_type AS dimension, props AS content,
               CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'supersede' ELSE 'skip' END AS action,
               CASE event_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'summary' ELSE 'note' END AS memory_type
        FROM {events}""",
    "memory": """
        SELECT event_id AS id, user_id, event_type AS dimension, props AS content,
               event_id - event_id % 10 AS source_message_id,
               CASE event_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'summary' ELSE 'note' END AS memory_type,
               CASE event_id % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'superseded' ELSE 'active' END AS status
        FROM {events}""",
    "entries": """
        SELECT event_id AS id,
               CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('  ', upper(event_type), '  ') ELSE event_type END AS dimension,
               CASE event_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE props END AS content,
               CASE event_id % 6 WHEN 0 THEN 'replace' WHEN 1 THEN 'supersede' WHEN 2 THEN 'skip' ELSE 'new' END AS action,
               CASE event_id % 4 WHEN 0 THEN 'Preference' WHEN 1 THEN NULL ELSE 'other' END AS memory_type
        FROM {events}""",
    "registry_old": """
        SELECT concat('bot_', cast(user_id AS string)) AS bot_id,
               CASE WHEN user_id % 2 = 0 THEN NULL ELSE concat(' user ', cast(user_id AS string), ' ') END AS label,
               CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('wx_', cast(user_id AS string)) END AS wechat_user_id,
               min(ts) AS created_at, max(ts) AS last_active_at
        FROM {events} WHERE event_type IN ('view', 'click') GROUP BY user_id""",
    "registry_new": """
        SELECT concat('bot_', cast(user_id AS string)) AS bot_id,
               CASE WHEN user_id % 5 < 2 THEN NULL ELSE concat('renamed ', cast(user_id AS string)) END AS label,
               CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('wx2_', cast(user_id AS string)) END AS wechat_user_id,
               min(ts) AS created_at, max(ts) AS last_active_at
        FROM {events} WHERE event_type IN ('signup', 'error') GROUP BY user_id""",
    "registry_spelled": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('bot_', cast(user_id AS string)) WHEN 1 THEN concat('BOT_', cast(user_id AS string), '  ')
                                           WHEN 2 THEN concat('böt_', cast(user_id AS string)) ELSE concat('Bót_', cast(user_id AS string), ' ') END AS bot_id,
               CASE WHEN event_id % 5 < 2 THEN NULL ELSE concat('label ', cast(event_id AS string)) END AS label,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('wx3_', cast(event_id AS string)) END AS wechat_user_id, ts
        FROM {events}""",
    "note_calls": """
        SELECT event_id + 1 AS call_id, CASE WHEN event_id % 41 = 0 THEN ' ' ELSE cast(user_id AS string) END AS user_id,
               CASE WHEN event_id % 37 = 0 THEN '{broken' WHEN event_type = 'signup' THEN concat('{"operation":"write","content":" note ', cast(event_id AS string), ' "}')
                    WHEN event_type = 'click' THEN '{"operation":" list "}' WHEN event_type = 'view' THEN concat('{"operation":"delete","note_id":', cast(event_id - event_id % 300 AS string), '}')
                    WHEN event_type = 'purchase' THEN concat('{"operation":"write","content":"', CASE WHEN event_id % 3 = 0 THEN '' ELSE cast(event_id % 100 AS string) END, '"}') ELSE '{"operation":"read"}' END AS args
        FROM {events}""",
    "metric": """
        SELECT event_id, user_id, event_type AS type, cast(floor(value * 100) AS bigint) AS total_ms, event_id % 6 AS fc_rounds,
               event_id % 4 AS llm_calls, cast(floor(value * 40) AS bigint) AS llm_ms FROM {events}""",
    "heartbeat": "SELECT user_id AS bot_id, event_id AS seq, ts, event_type = 'error' AS failed FROM {events}",
    "state": """
        SELECT user_id AS bot_id, event_id AS seq, ts, cast(floor(event_id / 8) AS bigint) % 5 AS generation,
               CASE event_type WHEN 'signup' THEN 'QR_READY' WHEN 'view' THEN 'ONLINE' WHEN 'click' THEN 'QR_EXPIRED'
                               WHEN 'purchase' THEN 'DISCONNECTED' ELSE 'ERROR' END AS state FROM {events}""",
    "calls": """
        SELECT user_id AS run, event_id AS step_id, event_type AS name, concat(event_type, ':', cast(event_id % 2 AS string)) AS call_key,
               event_id % 3 <> 0 AS ok, CASE WHEN event_id % 4 = 0 THEN concat('f', cast(event_id % 50 AS string), '.docx') END AS file_path
        FROM {events}""",
    "signals": f"""
        SELECT * FROM (VALUES {_values((i, d, x) for i, (d, x) in enumerate(((d, x) for d, words in SIGNALS.items() for x in words), 1))}) AS t(ord, domain, signal)""",
    "voices": f"""
        SELECT * FROM (VALUES {_values((i, *v) for i, v in enumerate(VOICES.items(), 1))}) AS t(ord, label, id)""",
    "tools": f"""
        SELECT * FROM (VALUES {_values((i, *t) for i, t in enumerate(TOOLS, 1))}) AS t(ord, name, domain, description)""",
    "parameters": f"""
        SELECT tool, param, type, required = 1 AS required FROM (VALUES {_values((*p[:3], int(p[3])) for p in PARAMETERS)}) AS t(tool, param, type, required)""",
    "asks": """
        SELECT conv_id * 1000 + turn AS id, CASE WHEN (conv_id + turn) % 13 = 0 THEN '  ' ELSE concat(text, ' ', phrase) END AS content
        FROM {conversations} JOIN (VALUES (0, '今天天气'), (1, '这个文档'), (2, '公司分析'), (3, '画图'), (4, '公司的天气'), (5, '随便聊聊'), (6, '把简历转pdf'), (7, '股价和湿度')) AS p(ord, phrase)
        ON (conv_id * 3 + turn) % 8 = p.ord""",
    "spoken": f"""
        SELECT conv_id * 1000 + turn AS id, text, lead, CASE turn % 4 WHEN 0 THEN label WHEN 1 THEN v.id WHEN 2 THEN substr(label, 2, 2) ELSE substr(text, 1, 4) END AS name
        FROM {{conversations}} JOIN (VALUES (0, '切换音色为'), (1, '换成'), (2, '切换成用'), (3, '用语音回复我 '), (4, '帮我画一张'), (5, '随便聊聊'), (6, '换音色')) AS p(ord, lead) ON (conv_id + turn) % 7 = p.ord
        JOIN (VALUES {_values((i, *v) for i, v in enumerate(VOICES.items()))}) AS v(ord, label, id) ON (conv_id * 5 + turn) % 24 = v.ord""",
    "resume_json": """
        SELECT s_suppkey AS k, concat('{"name":"', s_name, ' <&>","language":"', CASE WHEN s_suppkey % 3 = 0 THEN 'en' ELSE 'zh' END, '"',
          CASE WHEN s_suppkey % 2 = 0 THEN ',"phone":"12"' ELSE '' END, CASE WHEN s_suppkey % 3 <> 1 THEN ',"email":"e@x"' ELSE '' END,
          CASE WHEN s_suppkey % 4 = 0 THEN ',"city":"C"' ELSE '' END, CASE WHEN s_suppkey % 5 = 0 THEN ',"github":"g"' ELSE '' END, CASE WHEN s_suppkey % 7 = 0 THEN ',"linkedin":"l"' ELSE '' END,
          CASE WHEN s_suppkey % 3 <> 2 THEN concat(',"target_role":"Role ', cast(s_suppkey AS string), '"') ELSE '' END,
          CASE WHEN s_suppkey % 4 <> 3 THEN concat(',"profile":"Sum ', cast(s_suppkey AS string), ' & more"') ELSE '' END,
          CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(',"workExperienceList":[{"title":"T0","company":"Org0","location":"L","start":"2019"', CASE WHEN s_suppkey % 2 = 0 THEN ',"end":"2020"' ELSE '' END,
            CASE WHEN s_suppkey % 5 = 1 THEN ',"tools":"TL"' ELSE '' END, ',"bullets":["b1"," "]}', CASE WHEN s_suppkey % 3 = 2 THEN ',{"role":"T1","organization":"Org1","responsibilities":["r1","r2"]}' ELSE '' END, ']') END,
          CASE WHEN s_suppkey % 2 = 1 THEN ',"projectList":[{"role":"P","bulletPoints":["x <y>"],"tools":"spark"}]' ELSE '' END,
          CASE WHEN s_suppkey % 6 = 0 THEN ',"internshipList":[{"role":"I","organization":"IO","team_size":"S"}]' ELSE '' END,
          CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat(',"educationList":[{"school":"U', cast(s_suppkey AS string), '","degree":"BSc","field":"CS","start":"2015","courses":["c1","c2"]', CASE WHEN s_suppkey % 3 = 0 THEN ',"GPA":"4.0"' ELSE '' END,
            CASE WHEN s_suppkey % 5 = 2 THEN ',"honors":"H"' ELSE '' END, '}]') END,
          CASE WHEN s_suppkey % 3 = 1 THEN '' ELSE ',"skillList":[{"category":"Lang","skills":["a","b"]},{"skills":["z"]}]' END,
          CASE WHEN s_suppkey % 5 = 0 THEN ',"publicationList":[{"authors":"A","title":"T","journal":"J","year":"2020","volume":"1","issue":"2","pages":"3-4","doi":"10/1"}]' ELSE '' END,
          CASE WHEN s_suppkey % 5 = 1 THEN ',"patentList":[{"title":"PT","patentNumber":"N1","inventors":"I1","status":"S1"}]' ELSE '' END,
          CASE WHEN s_suppkey % 3 = 0 THEN ',"awardList":[{"title":"AW","organization":"AO","date":"2021"}]' ELSE '' END,
          CASE WHEN s_suppkey % 4 = 1 THEN ',"languageList":[{"language":"English","reading":"R","speaking":"S","certification":"C1"}],"certificateList":["CERT"]' ELSE '' END, '}') AS data
        FROM {supplier}""",
    "preference": """
        SELECT event_id AS id, user_id, event_type,
               CASE event_id % 5 WHEN 0 THEN 'longanhuan' WHEN 1 THEN 'longanyang' WHEN 2 THEN 'longhua_v3' WHEN 3 THEN 'longwan_v3' ELSE 'nobody' END AS voice
        FROM {events}""",
    "requirement": """
        SELECT item_id, concat('RQ-', lpad(cast(item_id AS string), 3, '0')) AS requirement_id, 1 + item_id % 5 AS weight,
               concat('JS-', lpad(cast(item_id % 7 AS string), 3, '0')) AS source_id, item_id % 11 = 0 AS eligibility,
               CASE item_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE 'F' END AS credibility
        FROM {benchmark}""",
    "evidence": """
        SELECT doc_id, concat('EV-', lpad(cast(doc_id AS string), 6, '0')) AS evidence_id, source AS experience, doc_id % 37 AS item_id,
               doc_id % 6 AS match_score, CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 4 END AS credit,
               doc_id % 9 <> 0 AS confirmed, lang FROM {documents}""",
    "bullet": """
        SELECT event_id, concat('BL-', lpad(cast(event_id AS string), 6, '0')) AS bullet_id, event_id % 211 AS doc_id FROM {events}""",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table or a binding."""
    if name in RAW:
        return raw(spark, sf_dir, name)
    sql = BINDINGS[name]
    used = {t: raw(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    # Braces that name no table are text.
    text = re.sub(r"\{(\w+)\}", "\x00\\1\x01", sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("\x00", "{").replace("\x01", "}"), **used)


def ctes(*names: str) -> str:
    """``WITH name AS (...)`` over the raw tables, for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', BINDINGS[n])})" for n in names) + " "
