"""Literal cases, random comparisons with plain loops, sinks and streaming forms."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import documents as D
from tessera.operators import lifecycle as L
from tessera.operators import memory as Y
from tessera.operators import messages as M
from tessera.operators import metrics as X
from tessera.operators import resumes
from tessera.operators import routing as U
from tessera.sources import files, office, providers, sinks, streams, tables
from tessera.streaming import stateful


def one(spark, expression, **values):
    return spark.createDataFrame([Row(**values)]).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("  Answer_Style  ", "answer_style"), ("TIMEZONE", "timezone"), ("\ta ", "a")])
def test_dimension(spark, given, wanted):
    assert one(spark, S.normalize_dimension(F.col("c")), c=given) == wanted


def test_fenced_records(spark):
    kind = "struct<memory_type:string,dimension:string>"
    got = one(spark, S.parse_records(F.col("c"), kind), c='```json\n[{"memory_type":"preference","dimension":"timezone"}]\n```')
    assert [tuple(r) for r in got] == [("preference", "timezone")]
    for bad in ("not json", '{"a": 1}', ""):
        assert one(spark, S.parse_records(F.col("c"), kind), c=bad) == []


@pytest.mark.parametrize(
    "text, wanted",
    [("帮我画一只猫", "1"), ("我想画个流程图", "2"), ("用语音回复我", "3"), ("帮我做个表格", "2"), ("切换音色为龙安欢", "4:龙安欢"), ("切换音色为某某", "2"),
     ("切换音色为longhua_v3", "4:longhua_v3"), ("换成 Bella", "4:Bella"), ("画一张山水画", "1"), ("语音回答一下", "3"), (None, "2")],
)
def test_intent(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(U.intent(F.col("c")).alias("x")).first()["x"] == wanted


def test_routing_vocabulary(spark):
    asks = [(1, "上海的气温", 1, "weather", False), (2, "聊一聊吧", 0, None, True), (3, "这家公司的天气", 2, None, True), (4, " ", 0, None, True), (5, None, 0, None, True), (6, "写一份简历", 1, "document", False)]
    df = spark.createDataFrame([a[:2] for a in asks], "id long, content string")
    got = {r["id"]: (r["n_domains"], r["domain"], r["is_fallback"]) for r in U.route(df, U.signal_table(spark), "id").collect()}
    assert got == {a[0]: a[2:] for a in asks}
    # Lists have no limit.
    long = spark.range(100_001).selectExpr("cast(id as string) as signal").union(spark.createDataFrame([("天气",)], "signal string"))
    assert [(r["id"], r["signal"]) for r in U.signal_hits(df, long).collect()] == [(3, "天气")]


def test_message_decode(spark):
    cases = [('{"content":"hi"}', '{"content":"hi"}'), ("{broken", '{"role":"r","content":"c"}'), (" ", '{"role":"r","content":"c"}'), (None, '{"role":"r","content":"c"}')]
    df = spark.createDataFrame([(a,) for a, _ in cases], "rich string")
    got = df.select(S.decode_message(F.col("rich"), F.lit("r"), F.lit("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [b for _, b in cases]


def test_whole_minutes_round_their_seconds(spark):
    """As in SQL: 59.6 seconds are a minute, 59.5 as well (60 is even), 120.5 are two; a null has none."""
    for micros, wanted in ((59_600_000, 1), (59_500_000, 1), (59_400_000, 0), (120_500_000, 2), (0, 0), (None, None)):
        df = spark.createDataFrame([(micros,)], "us long").selectExpr("timestamp_micros(0) as a", "timestamp_micros(us) as b")
        assert df.select(X.whole_minutes(F.col("a"), F.col("b")).alias("x")).first()["x"] == wanted


def test_generated_ids(spark):
    df = spark.range(200).select(S.new_bot_id().alias("b"), S.new_trace_id().alias("t")).collect()
    assert all(re.fullmatch("bot_[a-z0-9]{8}", r["b"]) and re.fullmatch("[0-9a-f]{8}", r["t"]) for r in df)
    assert len({r["b"] for r in df}) > 195


def test_sampled(spark):
    df = spark.range(20_000)
    assert 5600 < df.filter(S.sampled(F.col("id"), 0.3)).count() < 6400
    assert df.filter(S.sampled(F.col("id"), 1.0)).count() == 20_000
    assert df.filter(S.sampled(F.col("id"), 0.5, enabled=False)).count() == 0


def test_retries():
    class Flaky:
        def __init__(self, fails):
            self.fails = fails

        def answer(self, prompts):
            self.fails -= 1
            if self.fails >= 0:
                raise OSError("down")
            return list(prompts)

    assert providers.Retrying(Flaky(2), wait=0).answer(["a"]) == ["a"]
    with pytest.raises(providers.ProviderFailed):
        providers.Retrying(Flaky(3), wait=0).answer(["a"])


def test_operations(spark):
    paras = D.paragraphs(spark.createDataFrame([(1, "T\na\nb")], "doc_id long, text string"))
    texts = lambda df: [r["text"] for r in df.orderBy("para_no").collect()]
    assert texts(D.operate(paras, "add_image", image="i", position="before_text", text="b")) == ["T", "a", "i", "b"]
    assert texts(D.operate(paras, "add_image", image="i", position="after_text", text="zz")) == ["T", "a", "b", "i"]
    assert D.indent_counts(D.operate(paras, "set_first_line_indent")).first()["modified"] == 2
    for bad in ({"operation": "none"}, {"operation": "set_first_line_indent", "indent_chars": 11}, {"operation": "add_heading", "text": "x", "level": 7}):
        with pytest.raises(ValueError):
            D.operate(paras, **bad)


def test_resume_of_little(spark):
    df = spark.createDataFrame([('{"name":"N"}',), ("{}",), ("no json",)], "c string").select(resumes.parse(F.col("c")).alias("r"))
    got = df.select(F.size(resumes.word(F.col("r"))).alias("n"), resumes.markdown(F.col("r")).alias("m"), resumes.html(F.col("r")).alias("h")).collect()
    assert [r["n"] for r in got] == [2, 2, -1] or got[0]["n"] == got[1]["n"] == 2
    assert got[0]["m"] == "# N\n\n" and "<h1>N</h1>" in got[0]["h"]


def test_resume_operations_by_name(spark):
    data = '{"name":"A & B","language":"en","profile":"Does things"}'
    r = spark.createDataFrame([(1, data)], "k int, data string").select("k", resumes.parse(F.col("data")).alias("r"))
    found = {name: resumes.operate(r, f" {name} ").first()["result"] for name in resumes.OPERATIONS}
    assert found["generate_markdown"].startswith("# A & B") and "<h1>A &amp; B</h1>" in found["generate_html"]
    assert [x["text"] for x in found["generate_resume"]][0] == "A & B"
    assert resumes.operate(r, "generate_html", editable=True).first()["result"] != found["generate_html"]
    for unknown in ("", None, "send_resume"):
        with pytest.raises(ValueError, match="generate_resume, generate_html, generate_markdown"):
            resumes.operate(r, unknown)


def test_routed_prompt_is_the_guideline(spark):
    asks = spark.createDataFrame([(1, "小米公司怎么样"), (2, "天气"), (3, "随便")], "id long, content string")
    tools = spark.createDataFrame([(i, *t) for i, t in enumerate(U.TOOLS, 1)], "ord int, name string, domain string, description string")
    routed = U.route(asks, U.signal_table(spark), "id")
    prompts = {r["id"]: r["prompt"] for r in U.with_prompt(routed, tools, U.GUIDELINES).collect()}
    assert prompts[1] == U.GUIDELINES["company"] and prompts[2] is None
    assert prompts[3].startswith(U.FALLBACK) and prompts[3].count("\n- ") == len(U.TOOLS)
    offered = {r["id"]: r["catalog"] for r in U.catalogs(U.tools_of(routed, tools), tools, "id").collect()}
    assert [x.split(":")[0] for x in offered[1].split("\n")] == ["- search_company_info", "- search_industry_news", "- remember"]
    assert prompts[3] == U.FALLBACK + offered[3]


def test_tasks_after_replies(spark):
    replies = spark.createDataFrame([(u, 10 * i + u) for u in (1, 2) for i in range(1, 6)], "user_id long, id long")
    tasks = M.after_replies(replies, "user_id", "id", 3)
    assert [(r["turn_no"], r["task"]) for r in tasks.filter("user_id = 1").orderBy("id", "step").collect()] == [(1, "extract"), (2, "extract"), (3, "summarize"), (3, "extract"), (4, "extract"), (5, "extract")]
    out = M.task_outcomes(tasks, "user_id", "id", F.when(F.col("task") == "summarize", F.col("user_id") == 1).otherwise(F.col("turn_no") == 5))
    assert {(r["user_id"], r["turn_no"]): (r["ran"], r["ok"]) for r in out.collect() if r["turn_no"] > 2} == {
        (1, 3): ("summarize", False), (1, 4): ("extract", True), (1, 5): ("extract", False), (2, 3): ("summarize,extract", True), (2, 4): ("extract", True), (2, 5): ("extract", False)
    }
    assert M.after_replies(replies, "user_id", "id", 0).filter("task = 'summarize'").count() == 0


def test_tables_are_created_once(spark):
    tables.create_tables(spark, "tessera_test", 2)
    tables.create_tables(spark, "tessera_test", 2)
    assert {r["tableName"] for r in spark.sql("show tables in tessera_test").collect()} == set(tables.TABLES)
    assert spark.table("tessera_test.agent_memory").columns == tables.AGENT_MEMORY.names
    spark.sql("drop database tessera_test cascade")


def test_cache_trim_odd(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "k long, id long")
    assert {r["id"] for r in M.cache_trim(df, ["k"], "id", 2).collect()} == {2, 3, 4}


def test_cache_trim_random(spark):
    rng = random.Random(1)
    rows, wanted = [], set()
    for k in range(40):
        n, half = rng.randrange(0, 14), 3
        kept = list(range(n))
        while len(kept) > 2 * half:
            kept = kept[2:]
        rows += [(k, i) for i in range(n)]
        wanted |= {(k, i) for i in kept}
    df = spark.createDataFrame(rows, "k long, id long")
    assert {tuple(r) for r in M.cache_trim(df, ["k"], "id", 3).collect()} == wanted


def test_orphan_tool_removed(spark):
    df = spark.createDataFrame([(1, 0, "system", False), (1, 1, "tool", False), (1, 2, "user", False)], "k long, id long, role string, has_calls boolean")
    assert [r["role"] for r in M.sanitize_tool_pairs(df, "k", "id").orderBy("id").collect()] == ["system", "user"]


def test_loop_guard(spark):
    same = [(1, i, "a", True) for i in range(6)]
    turns = [(2, i, "a", i % 2 == 0) for i in range(30)]
    df = spark.createDataFrame(same + turns, "run long, step_id long, call_key string, ok boolean")
    got = {r["run"]: r["n"] for r in M.loop_guard(df, "run", "call_key", "step_id", "ok").groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 2, 2: 15}


def test_supersede_stack_matches_window_without_deletes(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), "d", i, rng.choice(["new", "supersede", "skip"]), "c") for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, dimension string, id long, action string, content string")
    a = {(r["id"], r["status"], r["supersedes_id"]) for r in Y.supersede(df).collect()}
    b = {(r["id"], r["status"], r["supersedes_id"]) for r in Y.supersede_with_deletes(df.withColumn("target", F.lit(None).cast("long"))).collect()}
    assert a == b


def test_supersede_with_delete(spark):
    rows = [(1, "d", 1, "new", None), (1, "d", 2, "new", None), (1, "d", 3, "delete", 2), (1, "d", 4, "supersede", None)]
    df = spark.createDataFrame(rows, "user_id long, dimension string, id long, action string, target long")
    got = {r["id"]: (r["status"], r["supersedes_id"]) for r in Y.supersede_with_deletes(df).collect()}
    assert got == {1: ("superseded", None), 2: ("deleted", None), 4: ("active", 1)}


def test_percentiles(spark):
    got = X.percentiles(spark.createDataFrame([(i,) for i in range(1, 21)], "v long"), "v").first()
    assert (got["p50"], got["p95"]) == (10, 19)
    assert X.percentiles(spark.createDataFrame([], "v long"), "v").first()["p95"] == 0


def test_streak_fires_every_n(spark):
    df = spark.createDataFrame([(1, i, i not in (4, 20)) for i in range(30)], "bot_id long, seq long, failed boolean")
    assert sorted(r["seq"] for r in L.failure_streaks(df, "bot_id", "seq", "failed", 3).collect()) == [2, 7, 10, 13, 16, 19, 23, 26, 29]


def test_headings(spark):
    df = spark.createDataFrame([(1, "T\na\nb\n\n"), (2, "x")], "doc_id long, text string")
    paras = D.paragraphs(df)
    assert paras.count() == 4
    got = D.add_heading(paras, "New", 2, "a").filter("doc_id = 1").orderBy("para_no").collect()
    assert [r["text"] for r in got] == ["T", "a", "New", "b"]


def test_providers(spark):
    tools = providers.Tools(providers.Tool("shout", "general", "upper case", str.upper))
    tools.register(spark)
    assert spark.sql("select shout('a') as x").first()["x"] == "A"
    assert tools.call("none", "") == "unknown tool: none"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i) for i in range(300)], "k long, o long")
    got = sinks.with_ids(df, ["o"], 1000, f"{tmp_path}/ids", 5).orderBy("o").collect()
    assert [r["id"] for r in got] == list(range(1001, 1301))
    # Beyond the sample that bounds are made from, and with a column that the counts do not read.
    many = spark.range(1_500_000).selectExpr("hash(id) as o", "id as other", "concat('text ', id) as text")
    ids = sinks.with_ids(many, ["o", "other"], 0, f"{tmp_path}/many").agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(ids) == (1_500_000, 1, 1_500_000)
    sinks.append_messages(spark.createDataFrame([("system", "a"), ("user", "b")], "role string, content string"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 1
    (tmp_path / "t.txt").write_text("x" * 3000)
    assert len(files.read_text_heads(spark, f"{tmp_path}/t.txt").first()["head"]) == 2000
    assert one(spark, files.inside("/v", F.col("c")), c="../a") is None


def stream_of(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def run(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streaming_streaks_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([(b, i, rng.random() < 0.7) for b in range(4) for i in range(60)], "bot_id long, seq long, failed boolean")
    batch = {tuple(r) for r in L.failure_streaks(df, "bot_id", "seq", "failed", 3).select("bot_id", "seq").collect()}
    got = run(spark, stateful.failure_streaks(stream_of(spark, tmp_path, df), "bot_id", "seq", "failed", 3), "streaks", tmp_path)
    assert {(r["bot_id"], r["seq"]) for r in got.collect()} == batch


def test_streaming_order_across_batches(spark, tmp_path):
    """Two files, one a batch: what the first batch misses comes in the second."""
    kind = "bot long, seq long, text string"
    spark.createDataFrame([(1, 1, "b"), (1, 3, "d"), (2, 0, "x"), (2, 0, "again")], kind).coalesce(1).write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/q")
    q = stateful.in_order(stream, "bot", "seq", "text").writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        assert {(r["key"], r["seq"]) for r in spark.table("ordered").collect()} == {(2, 0)}
        spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (2, 2, "z")], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r["seq"], r["value"]) for r in spark.table("ordered").collect() if r["key"] == 1]
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_message_stream(spark, tmp_path):
    lines = ['{"bot_id":"b","user_id":"u","seq":1,"items":[{"text":"hi"},{"image":"p.png"},{}]}', '{"bot_id":"b","user_id":"u","seq":2,"items":[]}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    got = run(spark, streams.items(streams.message_stream(spark, f"{tmp_path}/in")), "inbound", tmp_path)
    assert [(r["seq"], r["item_no"], r["kind"], r["body"]) for r in got.orderBy("item_no").collect()] == [(1, 0, "text", "hi"), (1, 1, "image", "p.png")]


def test_word_files(spark):
    paras = D.paragraphs(spark.createDataFrame([(1, "Title & <x>\n  two  spaces\né 🙂"), (2, "one")], "doc_id long, text string"))
    files_ = office.write_word(paras).unionByName(spark.createDataFrame([(3, b"no zip"), (4, None)], "doc_id long, content binary"))
    assert sorted(map(tuple, office.read_word(files_).collect())) == sorted(map(tuple, paras.select("doc_id", "para_no", "style", "text").collect()))
    changed = D.operate(office.read_word(files_), "modify_title", title="New")
    assert "New" in {r["text"] for r in office.read_word(office.write_word(changed)).collect()}


def test_sheet_files(spark):
    table = [["a", "b & c", None], ["1.5", "x", "-2"], [str(i) for i in range(30)]]
    df = spark.createDataFrame([(1, table), (2, [])], "sheet_id long, rows array<array<string>>")
    made = office.write_sheets(df)
    got = {r["sheet_id"]: r["rows"] for r in office.read_sheets(made).collect()}
    assert got == {1: [["a", "b & c", ""], *table[1:]], 2: []}
    more = spark.createDataFrame([(1, [["last"]]), (5, [["new", "2"]])], "sheet_id long, rows array<array<string>>")
    got = {r["sheet_id"]: r["rows"] for r in office.read_sheets(office.append_rows(made, more)).collect()}
    assert got[1][-1] == ["last"] and len(got[1]) == 4 and got[5] == [["new", "2"]] and got[2] == []
    kind = "sheet_id long, rows array<array<string>>, headers array<string>"
    more = spark.createDataFrame([(1, [["last"]], ["h"]), (2, [["r"]], ["h"]), (5, [["new"]], ["h"]), (6, None, None)], kind)
    got = {r["sheet_id"]: r["rows"] for r in office.read_sheets(office.append_rows(made, more)).collect()}
    assert got[1][0][0] == "a" and got[2] == got[5][:1] + [["r"]] == [["h"], ["r"]] and got[6] == []


def container(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files_of_other_programs(spark):
    """Parts under other names, prefixed namespaces, absolute targets, shared texts in runs, cells without places."""
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = container({
        "_rels/.rels": f'<Relationships {package}><Relationship Id="a" Type="{relation}/officeDocument" Target="/book/main.xml"/></Relationships>',
        "book/main.xml": f'<x:workbook xmlns:x="{main}" xmlns:q="{relation}"><x:sheets><x:sheet name="Data" sheetId="7" q:id="z9"/><x:sheet name="Other" sheetId="1" q:id="z1"/></x:sheets></x:workbook>',
        "book/_rels/main.xml.rels": f'<Relationships {package}><Relationship Id="z1" Type="{relation}/worksheet" Target="sheets/one.xml"/><Relationship Id="z9" Type="{relation}/worksheet" Target="/book/sheets/nine.xml"/><Relationship Id="s" Type="{relation}/sharedStrings" Target="../texts.xml"/></Relationships>',
        "book/sheets/one.xml": f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>1</v></c></row></sheetData></worksheet>',
        "book/sheets/nine.xml": f'<x:worksheet xmlns:x="{main}"><x:sheetData><x:row r="1"><x:c r="B1" t="s"><x:v>0</x:v></x:c><x:c t="b"><x:v>1</x:v></x:c></x:row><x:row><x:c t="str"><x:f>A1</x:f><x:v>sum</x:v></x:c><x:c><x:v>2.5</x:v></x:c></x:row></x:sheetData></x:worksheet>',
        "texts.xml": f'<sst xmlns="{main}"><si><r><t>two </t></r><r><t>runs</t></r></si><si><t>other</t></si></sst>',
    })
    assert office.sheet_rows(book) == [[None, "two runs", "1"], ["sum", "2.5"]]
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = container({
        "_rels/.rels": f'<Relationships {package}><Relationship Id="a" Type="{relation}/officeDocument" Target="text/body.xml"/></Relationships>',
        "text/body.xml": f'<v:document xmlns:v="{word}"><v:body><v:p><v:pPr><v:pStyle v:val="Heading2"/></v:pPr><v:r><v:t>A</v:t></v:r><v:r><v:t>B</v:t></v:r></v:p><v:p/></v:body></v:document>',
    })
    assert office.word_paragraphs(doc) == [("Heading2", "AB"), ("Normal", "")]
    texts = ["1e5", "nan", "inf", "007", "1_000", "-0.50", "12345678901234567890", "3", "", None, " 4"]
    back = office.sheet_rows(office.sheet_file([texts]))[0]
    assert back == ["1e5", "nan", "inf", "007", "1_000", "-0.5", "12345678901234567890", "3", "", "", " 4"]
    for broken in (b"", None, b"PK", container({"a": "b"}), container({"_rels/.rels": "<no"})):
        assert office.sheet_rows(broken) == [] == office.word_paragraphs(broken)


def test_arguments_in_range(spark):
    values = [(None,), (0,), (1,), (6,), (7,), (10,), (11,), (-1,)]
    df = spark.createDataFrame(values, "k long").select("k", S.within(F.col("k"), *D.INDENTS).alias("i"), S.within(F.col("k"), *D.LEVELS).alias("l"), S.within(F.col("k"), 1).alias("n"))
    for r in df.collect():
        k = r["k"]
        assert (r["i"], r["l"], r["n"]) == (k is not None and 0 <= k <= 10, k is not None and 1 <= k <= 6, k is not None and k > 0)


def test_providers_read_bytes(spark):
    class Sizes:
        def answer(self, prompts):
            return [None if p is None else f"{len(p)} bytes" for p in prompts]

    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "image binary")
    assert {r["answer"] for r in providers.complete(df, Sizes(), "image").collect()} == {"3 bytes", None}


def test_streaming_turns(spark, tmp_path):
    df = spark.createDataFrame([(u, i) for u in range(3) for i in range(25)], "user_id long, id long")
    got = run(spark, stateful.turn_counter(stream_of(spark, tmp_path, df), "user_id", "id"), "turns", tmp_path)
    assert {(r["user_id"], r["turn_no"]) for r in got.collect()} == {(u, t) for u in range(3) for t in (10, 20)}


def test_sheets_are_written_by_all_cores(spark):
    """A small table in one part has much work."""
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("sheet_id"), F.array(F.array(F.col("id").cast("string"), F.lit("x"))).alias("rows"))
    files = office.write_sheets(rows)
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r["sheet_id"], r["rows"]) for r in office.read_sheets(files).collect()) == [(i, [[str(i), "x"]]) for i in range(40)]


def test_many_small_files_share_their_work(monkeypatch):
    """Of each file only its body is packed, unpacked and parsed; the rest is known from the files before."""
    opened, parsed = [], []
    opens, parse = zipfile.ZipFile.__init__, office.ElementTree.fromstring
    monkeypatch.setattr(zipfile.ZipFile, "__init__", lambda *a, **k: (opened.append(1), opens(*a, **k))[1])
    monkeypatch.setattr(office.ElementTree, "fromstring", lambda *a: (parsed.append(1), parse(*a))[1])
    tables = [[[str(i), "x"], ["y", " z "]] for i in range(200)]
    assert [office.sheet_rows(office.sheet_file(t)) for t in tables] == tables
    paragraphs = [[("Title", str(i)), ("Normal", "a")] for i in range(200)]
    assert [office.word_paragraphs(office.word_file(p)) for p in paragraphs] == paragraphs
    assert len(opened) <= 10 and len(parsed) <= 410


def test_written_containers_are_plain_zip_files(monkeypatch):
    """Other programs' readers find sound parts; the same rows give the same bytes; long parts are written as well."""
    rows = [["é & <x>", "1.5", None], [], ["\n" * 3]]
    made = [(office.sheet_file(rows), office.sheet_rows), (office.word_file([("Title", "é & <x>")]), office.word_paragraphs)]
    monkeypatch.setattr(office, "_LONG", 100)
    made += [(office.sheet_file(rows), office.sheet_rows), (office.word_file([("Title", "é & <x>")]), office.word_paragraphs)]
    monkeypatch.undo()
    assert office.sheet_file(rows) == made[0][0]
    for content, _ in made:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            assert z.testzip() is None and names[0] == "[Content_Types].xml" and len(names) == len(set(names)) == (5 if len(names) > 3 else 3)
    assert [read(content) for content, read in made] == 2 * [[["é & <x>", "1.5", ""], [], ["\n" * 3]], [("Title", "é & <x>")]]


def test_unusual_and_damaged_containers():
    """Comments, bytes in front, other packings, names and long records read as well; a damaged part gives no rows."""
    rows = [["a", "2"]]
    content = office.sheet_file(rows)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}

    def packed(method=zipfile.ZIP_STORED, comment=b"", extra=(), long=False):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.comment = comment
            for name in (*extra, *parts):
                with z.open(name, "w", force_zip64=long) as f:
                    f.write(parts.get(name, b"other"))
        return out.getvalue()

    for other in (packed(), packed(zipfile.ZIP_DEFLATED), packed(zipfile.ZIP_LZMA), packed(comment=b"made by hand"), b"front" + content, packed(extra=("é", "z")), packed(long=True)):
        assert office.sheet_rows(other) == rows
    at = content.index(b"xl/worksheets/sheet1.xml") + len("xl/worksheets/sheet1.xml")
    for damaged in (content[:at] + b"\xff" * 9 + content[at + 9 :], content[:-1], content[:200], packed().replace(b"<t xml", b"<t  ml")):
        assert office.sheet_rows(damaged) == []
