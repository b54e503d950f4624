"""Queries over routing, scalar functions, JSON payloads and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import documents as D
from ..operators import registry as R
from ..operators import routing as U
from ..sources import feed
from ..sources import office as O
from .catalog import query

SWAP = "CASE doc_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.gif' WHEN 4 THEN '.bmp' ELSE '.txt' END"


@query("signal_hits", "SELECT id, signal, domain FROM asks JOIN signals ON contains(content, signal)", "asks", "signals")
def _(t):
    return U.signal_hits(t.asks, U.signal_table(t.spark)).select("id", "signal", "domain")


@query(
    "signal_vocabulary",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{9,}')) AS signal FROM conversations)
    SELECT doc_id, signal FROM documents JOIN w ON contains(text, signal)""",
)
def _(t):
    words = t.conversations.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))).alias("signal")).distinct()
    return U.signal_hits(t.documents, words, "text", ["doc_id"]).select("doc_id", "signal")


ROUTED = """h AS (SELECT id, count(DISTINCT domain) AS n, min(domain) AS d FROM asks JOIN signals ON contains(content, signal) WHERE trim(content) <> '' GROUP BY id),
    r AS (SELECT c.id, coalesce(n, 0) AS n_domains, CASE WHEN n = 1 THEN d END AS domain, coalesce(n, 0) <> 1 AS is_fallback FROM asks c LEFT JOIN h USING (id))"""


@query("single_domain_route", f"WITH {ROUTED} SELECT * FROM r", "asks", "signals")
def _(t):
    return U.route(t.asks, U.signal_table(t.spark), "id")


@query("route_tools", f"WITH {ROUTED} SELECT id, t.ord, t.name FROM r JOIN tools t ON r.domain = t.domain OR t.domain = 'general' OR is_fallback", "asks", "signals", "tools")
def _(t):
    return U.tools_of(U.route(t.asks, U.signal_table(t.spark), "id"), t.tools).select("id", "ord", "name")


@query(
    "route_prompt",
    f"""WITH {ROUTED}, c AS (SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY ord) AS catalog FROM tools)
    SELECT id, CASE WHEN is_fallback THEN '{U.FALLBACK}' || catalog WHEN domain = 'company' THEN '{U.GUIDELINES["company"]}' END AS prompt FROM r, c""",
    "asks",
    "signals",
    "tools",
)
def _(t):
    routed = U.route(t.asks, U.signal_table(t.spark), "id")
    return U.with_prompt(routed, t.tools, U.GUIDELINES).select("id", "prompt")


OFFERED = f"{ROUTED}, o AS (SELECT id, t.ord, t.name, t.description FROM r JOIN tools t ON r.domain = t.domain OR t.domain = 'general' OR is_fallback)"


@query("offered_catalog", f"WITH {OFFERED} SELECT id, string_agg('- ' || name || ': ' || description, chr(10) ORDER BY ord) AS catalog FROM o GROUP BY id", "asks", "signals", "tools")
def _(t):
    offered = U.tools_of(U.route(t.asks, U.signal_table(t.spark), "id"), t.tools)
    return U.catalogs(offered, t.tools, "id")


@query(
    "offered_parameters",
    f"WITH {OFFERED} SELECT id, param, arg_min(tool, ord) AS tool, arg_min(type, ord) AS type, arg_min(required, ord) AS required FROM o JOIN parameters p ON o.name = p.tool GROUP BY id, param",
    "asks",
    "signals",
    "tools",
    "parameters",
)
def _(t):
    return U.offered_parameters(U.tools_of(U.route(t.asks, U.signal_table(t.spark), "id"), t.tools), t.parameters, "id")


@query("dispatch_unknown", "SELECT event_id, n AS name, coalesce(description, 'unknown tool: ' || n) AS answer FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'remember' WHEN event_type = 'view' THEN 'get_weather' ELSE event_type END AS n FROM events) LEFT JOIN tools ON n = name", "tools")
def _(t):
    name = F.when(F.col("event_type") == "error", "remember").when(F.col("event_type") == "view", "get_weather").otherwise(F.col("event_type"))
    return U.dispatch(t.events.select("event_id", name.alias("name")), t.tools)


@query("tool_catalog_text", "SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY ord) AS catalog FROM tools", "tools")
def _(t):
    return U.catalog(t.tools)


@query("schema_merge_first", "SELECT p AS param, arg_min(name, ord) AS tool FROM (SELECT ord, name, unnest(['path', domain]) AS p FROM tools) GROUP BY p", "tools")
def _(t):
    params = t.tools.select("ord", F.col("name").alias("tool"), F.explode(F.array(F.lit("path"), "domain")).alias("param"))
    return R.first_by(params, "param", "ord").select("param", "tool")


@query(
    "voice_match",
    """WITH p AS (SELECT asked, v.id, ord, CASE WHEN v.id = asked THEN 0 WHEN contains(asked, substr(label, 1, 3)) THEN 1 WHEN contains(label, asked) THEN 2 END AS r FROM (SELECT DISTINCT name AS asked FROM spoken), voices v)
    SELECT s.id, s.name AS asked, b.id AS voice FROM spoken s LEFT JOIN (SELECT asked, id FROM p WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY r, ord) = 1) b ON s.name = b.asked""",
    "spoken",
    "voices",
)
def _(t):
    rows = t.spoken.select("id", F.col("name").alias("asked"))
    return rows.join(U.match_voice(rows.select("asked").distinct(), U.voice_table(t.spark)), "asked", "left")


@query("voice_ids", "SELECT s.id, (SELECT arg_min(v.id, CASE WHEN v.id = trim(name) THEN 0 WHEN contains(trim(name), substr(label, 1, 3)) THEN 100 ELSE 200 END + ord) FROM voices v WHERE v.id = trim(name) OR contains(trim(name), substr(label, 1, 3)) OR contains(label, trim(name))) AS voice FROM spoken s", "spoken", "voices")
def _(t):
    return t.spoken.select("id", U.voice_id(F.col("name")).alias("voice"))


HINT = " [more]"


@query(
    "watcher_hint",
    f"""WITH c AS (SELECT run, list(DISTINCT name) AS called FROM calls GROUP BY run)
    SELECT run, CASE WHEN run % 2 = 0 AND run % 3 <> 0 AND list_contains(called, 'view') AND NOT list_contains(called, 'nothing') THEN 'answer{HINT}' ELSE 'answer' END AS answer FROM c""",
    "calls",
)
def _(t):
    called = t.calls.groupBy("run").agg(F.collect_set(F.when(F.col("name") == "view", "search_company_info").otherwise(F.col("name"))).alias("called"))
    message = F.when(F.col("run") % 3 != 0, "请做分析").otherwise("地址")
    domain = F.when(F.col("run") % 2 == 0, "company").otherwise("weather")
    return called.select("run", U.watcher(message, F.lit("answer"), F.col("called"), domain, HINT).alias("answer"))


def _after(signal: str) -> str:
    return f"CASE WHEN contains(t, '{signal}') THEN nullif(trim(regexp_replace(trim(substr(t, strpos(t, '{signal}') + {len(signal)})), '^(为|成|到|用)', '')), '') END"


def _any(words) -> str:
    return " OR ".join(f"contains(t, '{w}')" for w in words)


@query(
    "intent_classes",
    f"""WITH m AS (SELECT id, trim(lead || name || CASE WHEN id % 5 = 0 THEN ' ' || text ELSE '' END) AS t FROM spoken), n AS (SELECT id, t, coalesce({', '.join(map(_after, U.SWITCH))}) AS name FROM m),
    r AS (SELECT n.*, EXISTS (SELECT 1 FROM voices v WHERE v.id = n.name OR contains(n.name, substr(label, 1, 3)) OR contains(label, n.name)) AS known FROM n)
    SELECT id, CASE WHEN name IS NOT NULL AND known THEN '4:' || name WHEN {_any(U.VOICE)} THEN '3' WHEN {_any(U.DRAW)} THEN '1' ELSE '2' END AS intent FROM r""",
    "spoken",
    "voices",
)
def _(t):
    text = F.concat("lead", "name", F.when(F.col("id") % 5 == 0, F.concat(F.lit(" "), "text")).otherwise(""))
    return t.spoken.select("id", U.intent(text).alias("intent"))


@query("image_type_by_ext", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'gif' WHEN 4 THEN 'bmp' ELSE 'unknown' END AS kind FROM (SELECT doc_id, 'f' || {SWAP} AS f FROM documents)")
def _(t):
    return t.documents.select("doc_id", S.image_type(F.expr(f"concat('f', {SWAP})")).alias("kind"))


@query("image_scale", "SELECT doc_id, least(n_chars, 500)::bigint * 9525 AS w, CASE WHEN n_chars > 500 THEN floor((doc_id + 1)::double * 500 / n_chars + 0.5) ELSE (doc_id + 1)::double END::bigint * 9525 AS h FROM documents WHERE n_chars > 0")
def _(t):
    w, h = S.emu(F.col("n_chars"), F.col("doc_id") + 1)
    return t.documents.filter("n_chars > 0").select("doc_id", w.alias("w"), h.alias("h"))


@query("arg_guards", "SELECT event_id, k BETWEEN 0 AND 10 AS indent_ok, k BETWEEN 1 AND 6 AS level_ok, k > 0 AS note_ok FROM (SELECT event_id, (props ->> '$.k')::bigint - 40 AS k FROM events)")
def _(t):
    """Arguments as they come in a call's JSON."""
    k = F.get_json_object("props", "$.k").cast("long") - 40
    return t.events.select("event_id", S.within(k, *D.INDENTS).alias("indent_ok"), S.within(k, *D.LEVELS).alias("level_ok"), S.within(k, 1).alias("note_ok"))


@query(
    "text_functions",
    r"""SELECT page_id, url, CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || '...' ELSE url END AS cut,
    substr(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g'), 1, 20) AS safe,
    CASE WHEN NOT contains(url, '/') THEN '/tmp/files/' || url ELSE url END AS path,
    regexp_replace(url || '//', '/+$', '') AS bare,
    replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
    CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN '' ELSE '2020' END WHEN page_id % 2 = 0 THEN '2019 - 至今' ELSE '2019 - 2020' END AS dates,
    CASE WHEN page_id % 4 >= 3 THEN 'critical' ELSE 'warning' END AS severity FROM pages""",
)
def _(t):
    c, p = F.col("url"), F.col("page_id")
    start, end = F.when(p % 3 != 0, "2019"), F.when(p % 2 != 0, "2020")
    return t.pages.select(
        "page_id",
        "url",
        S.truncate(c, 20).alias("cut"),
        S.file_safe(c).alias("safe"),
        S.resolve_path(c, "/tmp/files").alias("path"),
        S.strip_slashes(F.concat(c, F.lit("//"))).alias("bare"),
        S.html_escape(F.col("html")).alias("escaped"),
        S.date_range(start, end).alias("dates"),
        S.severity(p % 4, F.lit(0)).alias("severity"),
    )


@query("human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars::varchar || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 102.4 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 104857.6 + 0.5) / 10) END AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", S.human_size(F.col("n_chars")).alias("size"))


@query("json_first_live", "SELECT n_nationkey, n_name || ' weather: 20 C' AS sentence FROM nation")
def _(t):
    payload = F.concat(F.lit('{"status":"1","lives":[{"city":"'), "n_name", F.lit('","temperature":"20"},{"city":"x","temperature":"1"}]}'))
    live = F.element_at(F.from_json(payload, "struct<status:string,lives:array<struct<city:string,temperature:string>>>")["lives"], 1)
    return t.nation.select("n_nationkey", F.concat(live["city"], F.lit(" weather: "), live["temperature"], F.lit(" C")).alias("sentence"))


@query("feed_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(t):
    """Messages of the feed, decoded."""
    feed.register(t.spark)
    messages = t.spark.read.format(feed.Feed.name()).load(f"{t.sf_dir}/pages.parquet")
    page = F.from_json("payload", "page_id long, url string, html string")
    return messages.select(page.alias("p")).select("p.page_id", "p.url", F.length("p.html").cast("long").alias("chars"))


@query("feed_turns", "SELECT role, count(*) AS n, sum(length(text))::bigint AS chars FROM conversations GROUP BY role")
def _(t):
    feed.register(t.spark)
    messages = t.spark.read.format(feed.Feed.name()).load(f"{t.sf_dir}/conversations.parquet")
    turn = messages.select(F.from_json("payload", "role string, text string").alias("m")).select("m.*")
    return turn.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _hits(quote: str) -> str:
    parts = []
    for k in range(7):
        date = "" if k % 2 else f',"date":"2024-01-0{k + 1}"'
        parts.append(f"'{{\"title\":\"t{k}-', cast(page_id as string), '\",\"link\":\"l{k}\"{date}}}{',' if k < 6 else ''}'")
    return f"concat('{{\"webpages\":[', {', '.join(parts)}, ']}}')"


@query(
    "search_top5",
    f"""WITH p AS (SELECT page_id, {_hits("'")} AS j FROM pages), i AS (SELECT page_id, j, unnest(generate_series(0, 4)) AS k FROM p)
    SELECT page_id, k AS pos, coalesce(json_extract_string(j, '$.webpages[' || k || '].title'), '') AS title, coalesce(json_extract_string(j, '$.webpages[' || k || '].link'), '') AS url, coalesce(json_extract_string(j, '$.webpages[' || k || '].date'), '') AS date FROM i""",
)
def _(t):
    kind = "struct<webpages:array<struct<title:string,link:string,date:string>>>"
    rows = t.pages.select("page_id", F.posexplode(F.slice(F.from_json(F.expr(_hits("'")), kind)["webpages"], 1, 5)).alias("pos", "x"))
    empty = F.lit("")
    return rows.select("page_id", F.col("pos").cast("long"), F.coalesce("x.title", empty).alias("title"), F.coalesce("x.link", empty).alias("url"), F.coalesce("x.date", empty).alias("date"))


@query("ext_bernoulli_by_hash", "SELECT event_id FROM events WHERE event_id * 7919 % 1000 < 300")
def _(t):
    return t.events.filter(F.col("event_id") * 7919 % 1000 < 300).select("event_id")


PARAS = r"""p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n+$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, '\n+$', ''), chr(10)), 1) - 1 AS para_no FROM documents),
    q AS (SELECT doc_id, para_no, CASE WHEN para_no = 0 THEN 'Heading1' ELSE 'Normal' END AS style, text FROM p)"""


@query("doc_paragraphs", f"WITH {PARAS} SELECT * FROM q")
def _(t):
    return D.paragraphs(t.documents)


@query("para_indent", f"WITH {PARAS} SELECT doc_id, para_no, CASE WHEN style = 'Normal' AND trim(text) <> '' THEN 480 ELSE 0 END::bigint AS indent FROM q")
def _(t):
    return D.indent(D.paragraphs(t.documents), 2).select("doc_id", "para_no", "indent")


@query("word_roundtrip", f"WITH {PARAS} SELECT * FROM q")
def _(t):
    return O.read_word(O.write_word(D.paragraphs(t.documents)))


@query("doc_modify_title", f"WITH {PARAS} SELECT doc_id, para_no, style, CASE WHEN para_no = 0 THEN 'Title' ELSE text END AS text FROM q")
def _(t):
    return D.modify_title(D.paragraphs(t.documents), F.lit("Title"))


@query("doc_add_heading", f"WITH {PARAS}, x AS (SELECT doc_id, para_no::double AS o, style, text FROM q UNION ALL SELECT doc_id, max(para_no) + 0.5, 'Heading2', 'More' FROM q GROUP BY doc_id) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS para_no, style, text FROM x")
def _(t):
    return D.add_heading(D.paragraphs(t.documents), "More", 2)


@query("doc_format", f"WITH {PARAS} SELECT doc_id, para_no, CASE WHEN style = 'Heading1' THEN true END AS bold, CASE WHEN style = 'Heading1' THEN 22 END AS size FROM q")
def _(t):
    return D.format_matching(D.paragraphs(t.documents), "all_headings", True, D.HEADING_SIZE[1]).select("doc_id", "para_no", "bold", "size")


@query("doc_indent_counts", f"WITH {PARAS} SELECT doc_id, count(*) FILTER (style = 'Normal' AND trim(text) <> '') AS modified FROM q GROUP BY doc_id")
def _(t):
    return D.indent_counts(D.operate(D.paragraphs(t.documents), "set_first_line_indent", indent_chars=2))


@query("doc_format_result", f"WITH {PARAS} SELECT doc_id, count(*) FILTER (contains(text, 'ation')) AS modified, CASE WHEN count(*) FILTER (contains(text, 'ation')) = 0 THEN 'no match: ation' END AS error FROM q GROUP BY doc_id")
def _(t):
    return D.format_result(D.paragraphs(t.documents), "ation")


def _image_sql(at: str) -> str:
    return f"""WITH {PARAS}, e AS (SELECT doc_id, min(para_no) AS a, max(para_no) AS z, min(para_no) FILTER (contains(text, 'ation')) AS f FROM q GROUP BY doc_id),
    x AS (SELECT doc_id, para_no::double AS o, style, text FROM q UNION ALL SELECT doc_id, {at}, 'Image', 'i.png' FROM e)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS para_no, style, text FROM x"""


for _name, _position, _at in (
    ("beginning", "beginning", "a - 0.5"),
    ("before_text", "before_text", "coalesce(f - 0.5, z + 0.5)"),
    ("after_text", "after_text", "coalesce(f + 0.5, z + 0.5)"),
    ("end", "end", "z + 0.5"),
):

    @query(f"doc_add_image_{_name}", _image_sql(_at))
    def _(t, position=_position):
        return D.operate(D.paragraphs(t.documents), "add_image", image="i.png", position=position, text="ation")


def _sheets(t):
    row = F.array("o_orderstatus", F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    missing = F.when(F.col("o_orderkey") % 5 != 0, row)
    return t.orders.select(
        F.col("o_orderkey").alias("sheet_id"), F.array(row, missing).alias("rows"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("headers")
    )


@query(
    "sheet_cells",
    """WITH r AS (SELECT o_orderkey AS sheet_id, unnest([0, 1]) AS row_no, [o_orderstatus, o_custkey::varchar, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END] AS a FROM orders),
    c AS (SELECT sheet_id, row_no::bigint AS row_no, unnest([0, 1, 2])::bigint AS col_no, unnest(a) AS raw FROM r WHERE row_no = 0 OR sheet_id % 5 <> 0)
    SELECT sheet_id, row_no, col_no, CASE WHEN try_cast(raw AS double) IS NOT NULL THEN 'number' ELSE 'text' END AS kind, coalesce(raw, '') AS value FROM c""",
)
def _(t):
    return D.sheet_cells(_sheets(t))


@query("sheet_roundtrip", "SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END::bigint AS n_rows, max(o_orderstatus) AS first_cell, max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END) AS last_cell FROM orders GROUP BY o_orderkey")
def _(t):
    back = O.read_sheets(O.write_sheets(_sheets(t).select("sheet_id", "rows")))
    first = F.get("rows", F.lit(0))
    return back.select("sheet_id", F.size("rows").cast("long").alias("n_rows"), F.get(first, F.lit(0)).alias("first_cell"), F.get(first, F.lit(2)).alias("last_cell"))


@query("sheet_dims", "SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END::bigint AS n_cols, 2::bigint AS n_rows FROM orders")
def _(t):
    return D.sheet_dims(_sheets(t))


def _section_values() -> str:
    return ", ".join(f"('{t}', '{s}', {p[i]})" for s, p in D.SECTIONS.items() for i, t in enumerate(D.TEMPLATES) if p[i])


@query("template_catalog", f"SELECT template, count(*) AS sections, max(ordinal)::bigint AS last FROM (VALUES {_section_values()}) AS t(template, section, ordinal) GROUP BY template")
def _(t):
    return D.section_table(t.spark).groupBy("template").agg(F.count("*").alias("sections"), F.max("ordinal").alias("last"))


@query(
    "section_order",
    f"""WITH s AS (SELECT * FROM (VALUES {_section_values()}) AS t(template, section, ordinal)), n AS (SELECT DISTINCT section FROM s),
    c AS (SELECT doc_id, section, (doc_id + length(section)) % 3 AS n_items FROM documents, n)
    SELECT doc_id, template, section, row_number() OVER (PARTITION BY doc_id, template ORDER BY ordinal) AS place FROM c JOIN s USING (section) WHERE n_items > 0""",
)
def _(t):
    names = F.array(*[F.lit(s) for s in D.SECTIONS])
    content = t.documents.select("doc_id", F.explode(names).alias("section")).withColumn("n_items", (F.col("doc_id") + F.length("section")) % 3)
    return D.section_order(content, D.section_table(t.spark))


@query(
    "render_markdown",
    """SELECT s_suppkey, concat_ws(chr(10) || chr(10), '# ' || s_name, nullif(concat_ws(' | ', CASE WHEN s_suppkey % 2 = 0 THEN 'mail' END, CASE WHEN s_suppkey % 3 = 0 THEN 'phone' END), ''),
    '- one' || CASE WHEN s_suppkey % 5 <> 0 THEN chr(10) || '- two' ELSE '' END) AS markdown FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    df = t.supplier.select(
        "s_suppkey",
        "s_name",
        F.when(k % 2 == 0, "mail").alias("mail"),
        F.when(k % 3 == 0, "phone").alias("phone"),
        F.array(F.lit("one"), F.when(k % 5 != 0, "two").otherwise("  ")).alias("items"),
    )
    return D.render_markdown(df, "s_name", ["mail", "phone"], "items").select("s_suppkey", "markdown")


@query("nested_counts", "SELECT o_custkey, count(*) AS n_orders, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_custkey")
def _(t):
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("a"), F.collect_set("o_orderpriority").alias("b"))
    return lists.select("o_custkey", F.size("a").cast("long").alias("n_orders"), F.size("b").cast("long").alias("n_priorities"))


@query("provider_stub", "SELECT item_id, text AS prompt, 'reply: ' || text AS answer FROM benchmark")
def _(t):
    from ..sources.providers import Echo, complete

    return complete(t.benchmark.select("item_id", F.col("text").alias("prompt")), Echo("reply: "))
