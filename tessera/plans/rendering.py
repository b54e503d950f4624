"""Queries over rendering functions, vocabularies, payloads and the queue replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import documents as D
from ..sources import sinks as K
from ..streaming import stateful
from .catalog import query


@query("skills_line", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand || '：' || CASE WHEN p_partkey % 2 = 0 THEN p_type || '、' || p_name ELSE '' END END AS line FROM part")
def _(t):
    k = F.col("p_partkey")
    category = F.when(k % 3 != 0, F.col("p_brand")).otherwise("  ")
    return t.part.select("p_partkey", S.skills_line(category, F.when(k % 2 == 0, F.array("p_type", "p_name"))).alias("line"))


@query(
    "citation_line",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '. ' ELSE '' END || '《' || p_name || '》' || CASE WHEN p_partkey % 3 = 0 THEN '. ' || p_type ELSE '' END
    || '. ' || p_size::varchar || CASE WHEN p_partkey % 5 = 0 THEN ': 1-9' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '. DOI: 10/' || p_partkey::varchar ELSE '' END AS line FROM part""",
)
def _(t):
    k = F.col("p_partkey")
    line = S.citation(
        F.when(k % 2 == 0, F.col("p_brand")),
        F.col("p_name"),
        F.when(k % 3 == 0, F.col("p_type")),
        F.col("p_size").cast("string"),
        F.when(k % 5 == 0, F.lit("1-9")),
        F.when(k % 7 == 0, F.concat(F.lit("10/"), k.cast("string"))),
    )
    return t.part.select("p_partkey", line.alias("line"))


def _labels(name: str, vocabulary: dict[str, str]) -> str:
    rows = ", ".join(f"({i}, '{zh}', '{en}')" for i, (zh, en) in enumerate(vocabulary.items()))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t(ord, zh, en))"


@query(
    "status_labels",
    f"""WITH {_labels("a", S.PUBLICATION_STATUS)}, {_labels("b", S.PATENT_STATUS)}
    SELECT p_partkey, coalesce(a.en, 'Needs user confirmation') AS publication, coalesce(b.en, 'Needs user confirmation') AS patent
    FROM part LEFT JOIN a ON p_partkey % 12 = a.ord LEFT JOIN b ON p_partkey % 13 = b.ord""",
)
def _(t):
    given = lambda words, n: F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % n).cast("int"))
    pub, pat = given(S.PUBLICATION_STATUS, 12), given(S.PATENT_STATUS, 13)
    return t.part.select(
        "p_partkey",
        S.status_label(F.coalesce(pub, F.col("p_name")), S.PUBLICATION_STATUS).alias("publication"),
        S.status_label(pat, S.PATENT_STATUS).alias("patent"),
    )


@query("candidate_stage", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'STUDENT' WHEN c_custkey % 7 BETWEEN 0 AND 2 AND c_custkey % 6 < 3 THEN 'RECENT_GRADUATE' WHEN c_custkey % 6 >= 3 THEN 'EXPERIENCED' ELSE 'UNKNOWN' END AS stage FROM customer")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", S.candidate_stage(F.col("c_nationkey") % 4 == 0, k % 7, k % 6).alias("stage"))


@query("history_entry", "SELECT doc_id, '[用户发送了一个文件，文件名：f' || doc_id::varchar || '，服务器路径：/tmp/f，内容摘要：' || chr(10) || substr(text, 1, 2000) || chr(10) || ']' AS entry FROM documents")
def _(t):
    return t.documents.select("doc_id", S.history_entry(F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.lit("/tmp/f"), F.col("text")).alias("entry"))


@query(
    "payload_paths",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || event_id::varchar END AS audio, event_id % 4 = 0 AS failed, event_id % 5 = 0 AS ok, event_id % 5 = 0 AS ok_literal FROM events""",
)
def _(t):
    e = F.col("event_id")
    text = e.cast("string")
    audio = F.when(e % 3 == 0, F.concat(F.lit('{"output":{"audio":{"url":"u'), text, F.lit('"}}}'))).otherwise('{"output":{"audio":{"url":" "}}}')
    error = F.when(e % 4 == 0, '{"code":"1","message":"m"}').otherwise('{"code":"1"}')
    result = F.when(e % 5 == 0, '{"success": true}').otherwise('{"success": false}')
    return t.events.select(
        "event_id", S.audio_url(audio).alias("audio"), S.api_error(error).alias("failed"), S.success_value(result).alias("ok"), S.success_flag(result).alias("ok_literal")
    )


@query(
    "speech_sentences",
    """SELECT id, coalesce(nullif(array_to_string([x for x in string_split(content, '. ') if length(x) % 2 = 0], ''), ''), j) AS text FROM
    (SELECT id, content, CASE WHEN len([x for x in string_split(content, '. ') if length(x) % 2 = 0]) = 0 THEN to_json({'sentences': [{'text': x, 'sentence_end': false} for x in string_split(content, '. ')]})::varchar END AS j FROM chat)""",
    "chat",
)
def _(t):
    parts = F.transform(F.split("content", "[.] "), lambda x: F.struct(x.alias("text"), (F.length(x) % 2 == 0).alias("sentence_end")))
    return t.chat.select("id", S.sentences(F.to_json(F.struct(parts.alias("sentences")))).alias("text"))


@query(
    "bullet_variants",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN string_split(text, chr(10)) END AS points, string_split(text, '. ') AS duties FROM documents)
    SELECT doc_id, array_to_string([x for x in CASE WHEN len(points) > 0 THEN points ELSE duties END if NOT regexp_matches(x, '^\\s*$')], '|') AS bullets FROM d""",
)
def _(t):
    points = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.split("text", "\n"))
    return t.documents.select("doc_id", F.array_join(S.bullets(points, F.split("text", "[.] ")), "|").alias("bullets"))


@query(
    "render_html",
    """SELECT s_suppkey, '<h1>' || replace(s_name, '#', '#') || '</h1>' || CASE WHEN s_suppkey % 2 = 0 THEN '<p>m &amp; p</p>' ELSE '' END || CASE WHEN s_suppkey % 5 <> 0 THEN '<ul><li>&lt;one&gt;</li></ul>' ELSE '' END AS html FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    df = t.supplier.select("s_suppkey", "s_name", F.when(k % 2 == 0, "m & p").alias("c"), F.array(F.when(k % 5 != 0, "<one>").otherwise("")).alias("items"))
    return D.render_html(df, "s_name", ["c"], "items").select("s_suppkey", "html")


@query(
    "tunnel_pick",
    "SELECT page_id // 3 AS tunnels, coalesce(first(url ORDER BY page_id) FILTER (starts_with(url, 'https')), first(url ORDER BY page_id)) AS url FROM pages GROUP BY page_id // 3",
)
def _(t):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"])
    rows = t.pages.groupBy(F.expr("page_id div 3").alias("tunnels")).agg(listed.alias("urls"))
    return rows.select("tunnels", S.pick_tunnel(F.col("urls")).alias("url"))


@query("convertible_files", "SELECT p_partkey, f <> '' AND (ends_with(lower(f), '.economy') OR ends_with(lower(f), '.promo')) AND lower(f) NOT IN ('.economy', '.promo') AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END || '.' || p_type AS f FROM part)")
def _(t):
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")), F.lit("."), F.col("p_type"))
    return t.part.select("p_partkey", S.extension_ok(name, (".economy", ".promo")).alias("ok"))


@query(
    "payload_functions",
    """SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN event_type END), ''), trim(CASE WHEN event_id % 2 = 0 THEN '  ' || props || ' ' END), '') AS said,
    CASE WHEN event_id % 2 = 0 THEN 'u' || event_type ELSE 'i' || event_type END AS image, 'data:image/png;base64,' || base64(encode(props)) AS url, hex(substr(props, 2)) AS voice,
    json_extract_string(props, '$.k') AS k, event_id % 2 = 0 AS sent, event_type || CASE WHEN event_id % 3 = 0 THEN '"' ELSE '' END || 'x' AS literal, replace(replace(replace(props || chr(10) || event_type, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS escaped,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS named FROM events""",
)
def _(t):
    e, kind, props = F.col("event_id"), F.col("event_type"), F.col("props")
    content = F.when(e % 3 == 0, "  ").when(e % 3 == 1, kind)
    reasoning = F.when(e % 2 == 0, F.concat(F.lit("  "), props, F.lit(" ")))
    result = F.concat(F.lit('{"output":{"results":[{"url":"u'), kind, F.lit('"}]}}'))
    choice = F.concat(F.lit('{"output":{"choices":[{"message":{"content":[{"image":"i'), kind, F.lit('"}]}}]}}'))
    named = F.when(e % 2 == 0, F.concat(F.lit('{"city":"'), kind, F.lit('","k":1}'))).otherwise(props)
    data = props.cast("binary")
    return t.events.select(
        "event_id",
        S.text_or_reasoning(content, reasoning).alias("said"),
        S.image_url(F.when(e % 2 == 0, result).otherwise(choice)).alias("image"),
        S.data_url("image/png", data).alias("url"),
        F.hex(S.drop_first_byte(data)).alias("voice"),
        S.json_text(props, "k").alias("k"),
        S.explicit_send(F.when(e % 2 == 0, '{"operation": "send_document"}').otherwise('{"operation": "send"}')).alias("sent"),
        S.json_text_literal(F.concat(F.lit('{"a": 1,"file_path":"'), kind, F.when(e % 3 == 0, '\\"').otherwise(""), F.lit('x","b":"c"}')), "file_path").alias("literal"),
        S.json_escape(F.concat(props, F.lit("\n"), kind)).alias("escaped"),
        S.first_named(named, ("location", "city", "k")).alias("named"),
    )


@query(
    "fenced_records",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 2 END::bigint AS n, CASE WHEN event_id % 3 <> 2 THEN event_type END AS dimension, CASE WHEN event_id % 3 <> 2 THEN json_extract_string(props, '$.k') END AS content FROM events""",
)
def _(t):
    body = F.concat(F.lit('[{"dimension":"'), "event_type", F.lit('","content":"'), F.get_json_object("props", "$.k"), F.lit('"},{"other":1}]'))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, body).otherwise(F.col("props"))
    rows = S.parse_records(text, "struct<dimension:string,content:string>")
    first = F.get(rows, F.lit(0))
    return t.events.select("event_id", F.size(rows).cast("long").alias("n"), first["dimension"].alias("dimension"), first["content"].alias("content"))


@query(
    "cache_live",
    """WITH c AS (SELECT user_id AS key, arg_max(props, ts) AS value, max(ts) AS written_at FROM events WHERE event_type <> 'purchase' GROUP BY user_id), r AS (SELECT user_id AS key, max(ts) AS read_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT key, value FROM c JOIN r USING (key) WHERE date_diff('microsecond', written_at, read_at) < 1800000000""",
)
def _(t):
    writes = t.events.filter("event_type <> 'purchase'").select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("ts").alias("written_at"))
    reads = t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("read_at"))
    return K.cache_live(K.cache_put(writes.limit(0), writes).join(reads, "key"), F.col("read_at")).select("key", "value")


@query(
    "cache_reads",
    """WITH w AS (SELECT user_id AS key, ts, max(props) AS value FROM events WHERE event_type <> 'purchase' GROUP BY ALL), r AS (SELECT user_id AS key, ts AS read_at, event_id FROM events WHERE event_type = 'purchase')
    SELECT r.key, read_at, coalesce(date_diff('microsecond', w.ts, read_at) < 12 * 3600000000, false) AS hit, CASE WHEN hit THEN value END AS value FROM r ASOF LEFT JOIN w ON r.key = w.key AND r.read_at >= w.ts""",
)
def _(t):
    writes = t.events.filter("event_type <> 'purchase'").select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("ts").alias("written_at"))
    return K.cache_reads(writes, t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("read_at")), 12 * 60)


@query(
    "ext_bounded_queue",
    """WITH RECURSIVE l AS (SELECT user_id AS bot_id, event_id AS seq, event_type <> 'purchase' AS arrives, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT DISTINCT bot_id, 0::bigint AS n, NULL::bigint AS seq, NULL::boolean AS accepted, 0::bigint AS held FROM l
      UNION ALL SELECT l.bot_id, l.n, l.seq, CASE WHEN l.arrives THEN r.held < 10 END, CASE WHEN NOT l.arrives THEN greatest(r.held - 1, 0) WHEN r.held < 10 THEN r.held + 1 ELSE r.held END
      FROM r JOIN l ON r.bot_id = l.bot_id AND l.n = r.n + 1)
    SELECT bot_id, seq, accepted FROM r WHERE accepted IS NOT NULL""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("bot_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "purchase").alias("arrives"))
    return stateful.bounded_queue(rows, 10)
