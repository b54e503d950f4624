"""Keyword routing: signals in texts, domains, tools, intents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import after_signal, contains_any, trim
from .contents import contains_join

# Words that decide an intent.
DRAW = ("画一张", "画一幅", "画一只", "帮我画", "帮我生成", "生成图片", "画图", "绘制")
VOICE = ("用语音回复", "语音回答", "语音回复我", "用语音说", "语音告诉我")
SWITCH = ("切换音色", "换音色", "切换成", "换成")
DEEP = ("分析", "前景", "投资", "评估", "报告", "怎么样")
# Words by which a message belongs to a domain.
SIGNALS = {
    "weather": ("天气", "气温", "下雨", "刮风", "晴天", "阴天", "温度", "湿度"),
    "document": (
        "文档", "word", "标题", "缩进", " 段落", "字体", "加粗", "修改", "创建", "生成一份", "excel", "表格", "xlsx", "电子表格",
        "数据表", "pdf", "PDF", "转pdf", "转PDF", "简历", "resume", "cv",
    ),
    "company": ("公司", "企业", "股票", "股价", "行业", "分析", "报告", "上市", "融资", "工商", "查询"),
    "draw": ("画图", "生成图片", "绘制", "画一个"),
}
# Voices in the order in which they are tried, label and id.
VOICES = {
    "龙安欢（女·元气）": "longanhuan", "龙安洋（男·阳光）": "longanyang", "龙华（女·甜美）": "longhua_v3",
    "龙婉（女·柔声）": "longwan_v3", "龙星（女·温婉）": "longxing_v3", "龙橙（男·智慧青年）": "longcheng_v3",
    "龙泽（男·温暖）": "longze_v3", "龙安柔（女·闺蜜）": "longanrou_v3", "龙呼呼（女童·天真）": "longhuhu_v3",
    "龙泡泡（童声·可爱）": "longpaopao_v3", "龙闪闪（童声·戏剧）": "longshanshan_v3", "龙嘉欣（粤语女）": "longjiaxin_v3",
    "龙老铁（东北话）": "longlaotie_v3", "龙陕哥（陕西话）": "longshange_v3", "Bella（美式英语女）": "loongbella_v3",
    "Abby（美式英语女）": "loongabby_v3", "Emily（英式英语女）": "loongemily_v3", "Riko（日语女）": "loongriko_v3",
    "Kyong（韩语女）": "loongkyong_v3", "龙小淳（助手·中英）": "longxiaochun_v3", "龙小夏（助手·中文）": "longxiaoxia_v3",
    "龙妙（有声书）": "longmiao_v3", "龙三叔（有声书男）": "longsanshu_v3", "龙硕（新闻播报男）": "longshuo_v3",
}
# What a message without a single domain is prefaced with, before the list of tools.
FALLBACK = "系统未能精确识别您的意图，已进入自主决策模式。\n请根据用户问题，自行判断需要调用哪些工具。如果不确定，可以反问用户澄清。\n\n可用工具：\n"
# What a message of a domain is prefaced with.
GUIDELINES = {
    "company": """【企业研究类任务执行准则】

当你面对企业研究类任务时，请遵循以下业界通用分析方法：

1. 信息完整性原则：一份高质量的企业分析报告应包含"工商基本面"和"行业动态/政策面"两个维度。
2. 工具调用策略：
   - 如果用户仅询问"公司地址/法人"等事实性问题，只需调用 search_company_info。
   - 如果用户要求"分析前景"、"发展规划"、"是否值得投资"，请按序调用 search_company_info（获取基本面）和 search_industry_news（获取政策与动态），最后整合成结构化报告。
3. 异常处理：如果某个工具返回空数据或报错，请不要中断整个流程。基于已有的部分数据生成结论，并明确告知用户缺失的部分。"""
}
# The tools in the order of their registration: name, domain, description.
TOOLS = (
    ("get_weather", "weather", "查询指定城市的实时天气，返回天气状况、气温、湿度、风力风向等信息"),
    ("word_document", "document", "操作Word文档，支持创建文档、添加多级标题、修改标题、调整标题格式（字体/加粗/斜体/下划线/颜色）、设置首行缩进、发送文件给用户。当用户需要创建或编辑Word文档时调用此工具。file_path 可从之前工具调用的返回结果中获取。"),
    ("create_excel", "document", "创建或修改 Excel 表格（.xlsx）。支持新建含标题行的表格、追加数据到已有表格。当用户需要将查询结果整理成结构化表格时调用此工具。"),
    ("word_to_pdf", "document", "将Word文档(.doc/.docx)转换为PDF并自动发送给用户。适用于：1) 将 word_document 工具生成的 Word 文件转为 PDF；2) 用户上传的 Word 文件转为 PDF。转换完成后会直接发送给用户。"),
    ("resume", "document", "简历生成与管理工具。支持从结构化信息生成 Word/HTML/Markdown 格式的简历。当用户要求生成简历时调用：先用对话收集个人信息，再用 generate_resume 生成简历文件。详细的简历编写规则和模板位于 resources/resume-builder/ 目录下。"),
    ("generate_image", "draw", "AI生成图片。当用户要求画图、生成图片时调用，返回本地图片路径，可用于后续插入Word文档等操作。"),
    ("search_company_info", "company", "根据公司名称查询企业的完整工商档案，包括法人、注册资本、成立时间、经营范围、股东、主要人员、对外投资。当用户需要了解某家公司基本信息时调用。"),
    ("search_industry_news", "company", "联网搜索行业政策、公司动态、发展规划等最新信息。当用户需要了解行业趋势、政策动向、公司最新动态时调用。"),
    ("remember", "general", '管理用户的长期笔记：写入、查看、删除。笔记会持久化保存并在后续对话中自动注入，不会被自动覆盖，需要时由用户主动删除。当用户说"记住xxx"、"提醒我xxx"、"记一下xxx"时调用。'),
)
# The tools' own parameters: tool, name, type, required.
PARAMETERS = (
    ("get_weather", "city", "string", True),
    ("word_document", "operation", "string", True),
    ("word_document", "file_path", "string", False),
    ("create_excel", "file_path", "string", False),
    ("create_excel", "sheet_name", "string", False),
    ("create_excel", "headers", "string", False),
    ("create_excel", "data_rows", "string", False),
    ("create_excel", "append", "boolean", False),
    ("word_to_pdf", "file_path", "string", True),
    ("resume", "operation", "string", True),
    ("generate_image", "prompt", "string", True),
    ("search_company_info", "company_name", "string", True),
    ("search_industry_news", "query", "string", True),
    ("search_industry_news", "time_range", "string", False),
    ("remember", "operation", "string", True),
    ("remember", "content", "string", False),
    ("remember", "note_id", "integer", False),
)
#: Tools are sent to every executor up to so many rows; longer lists are met by a shuffled join.
MAX_LISTED = 100_000


def signal_table(spark: SparkSession) -> DataFrame:
    rows = [(d, s) for d, words in SIGNALS.items() for s in words]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "ord int, domain string, signal string")


def voice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *v) for i, v in enumerate(VOICES.items(), 1)], "ord int, label string, id string")


def signal_hits(messages: DataFrame, signals: DataFrame, text: str = "content", keep: Sequence[str] | None = None) -> DataFrame:
    """(message, signal) pairs where the text contains the signal, for any number of signals; see ``contains_join``."""
    return contains_join(messages, signals, text, "signal", keep)


def route(messages: DataFrame, signals: DataFrame, key: str, text: str = "content") -> DataFrame:
    """``(key, n_domains, domain, is_fallback)``: a domain where exactly one is hit; a null or blank text has none."""
    spoken = messages.select(key, text).filter(~F.col(text).rlike(r"^\s*$"))
    hits = signal_hits(spoken, signals, text, [key]).groupBy(key).agg(
        F.count_distinct("domain").alias("n"), F.min("domain").alias("d")
    )
    n = F.coalesce("n", F.lit(0)).cast("long")
    return messages.select(key).join(hits, key, "left").select(
        key, n.alias("n_domains"), F.when(n == 1, F.col("d")).alias("domain"), (n != 1).alias("is_fallback")
    )


def tools_of(routed: DataFrame, tools: DataFrame) -> DataFrame:
    """The domain's tools and the general ones; a fallback gets all. An equi-join: rows ask for domains, ``*`` for all."""
    offered = tools.select("ord", "name", F.col("domain").alias("_d")).unionByName(tools.select("ord", "name", F.lit("*").alias("_d")))
    asked = F.when(F.col("is_fallback"), F.array(F.lit("*"))).otherwise(F.array_distinct(F.array("domain", F.lit("general"))))
    return routed.withColumn("_d", F.explode(asked)).join(offered, "_d").drop("_d")


def catalog(tools: DataFrame) -> DataFrame:
    """One row: a line for each tool, in their order."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), "description")
    rows = F.array_sort(F.collect_list(F.struct("ord", line.alias("l"))))
    return tools.agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("catalog"))


def catalogs(offered: DataFrame, tools: DataFrame, key: str) -> DataFrame:
    """``(key, catalog)``: for each row the lines of the tools that it was offered, in their order. Equal offers are written once."""
    sets = offered.groupBy(key).agg(F.array_sort(F.collect_set("ord")).alias("_set"))
    line = F.concat(F.lit("- "), "name", F.lit(": "), "description")
    kinds = sets.select("_set").distinct()
    lines = kinds.select("_set", F.explode("_set").alias("ord")).join(tools.select("ord", line.alias("_line")), "ord")
    lines = lines.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("ord", "_line"))).alias("_rows"))
    return sets.join(lines, "_set").select(key, F.array_join(F.transform("_rows", lambda x: x["_line"]), "\n").alias("catalog"))


def offered_parameters(offered: DataFrame, parameters: DataFrame, key: str) -> DataFrame:
    """``(key, param, tool, type, required)``: the parameters of all tools that a row was offered; of one name the first tool's holds."""
    rows = offered.select(key, "ord", F.col("name").alias("tool")).join(parameters, "tool")
    first = F.min(F.struct("ord", "tool", "type", "required")).alias("first")
    return rows.groupBy(key, "param").agg(first).select(key, "param", "first.tool", "first.type", "first.required")


def with_prompt(routed: DataFrame, tools: DataFrame, guidelines: dict[str, str]) -> DataFrame:
    """``prompt``: the fallback text with the list of tools, or the domain's guidelines, or null."""
    own = F.lit(None).cast("string")
    for domain, text in guidelines.items():
        own = F.when(F.col("domain") == domain, text).otherwise(own)
    # One row of tools is joined to all.
    return routed.join(F.broadcast(catalog(tools)), F.lit(True)).withColumn(
        "prompt", F.when(F.col("is_fallback"), F.concat(F.lit(FALLBACK), "catalog")).otherwise(own)
    ).drop("catalog")


def voice_id(name: Column, voices: dict[str, str] = VOICES) -> Column:
    """The id itself, else the first voice whose label's first three characters are in the name, else whose label has the name."""
    name = trim(name)
    out = F.when(name.isin(*voices.values()), name)
    for label, own in voices.items():
        out = out.when(name.contains(label[:3]), own)
    for label, own in voices.items():
        out = out.when(F.lit(label).contains(name), own)
    return out


def intent(text: Column, voices: dict[str, str] = VOICES) -> Column:
    """4:name, 3, 1 or 2, in this order; a switch needs a voice that is known."""
    t = trim(F.coalesce(text, F.lit("")))
    name = after_signal(t, SWITCH)
    resolved = voice_id(name, voices).isNotNull()
    return (
        F.when(name.isNotNull() & resolved, F.concat(F.lit("4:"), name))
        .when(contains_any(t, VOICE), "3")
        .when(contains_any(t, DRAW), "1")
        .otherwise("2")
    )


def watcher(message: Column, answer: Column, called: Column, domain: Column, hint: str, deep: Sequence[str] = DEEP) -> Column:
    """Append ``hint`` to company answers that skipped the news tool in a deep question."""
    due = (
        (domain == "company")
        & contains_any(message, deep)
        & F.array_contains(called, "search_company_info")
        & ~F.array_contains(called, "search_industry_news")
    )
    return F.when(due, F.concat(answer, F.lit(hint))).otherwise(answer)


def match_voice(names: DataFrame, voices: DataFrame) -> DataFrame:
    """Exact id; else the first entry whose first three characters are in the name; else whose label has it.

    Equality, then two joins by content in opposite directions: no name is compared with every voice.
    """
    asked = names.select("asked").distinct()
    own = voices.select("ord", "id", "label", F.substring("label", 1, 3).alias("head"))
    ranked = [
        asked.join(own, F.col("asked") == F.col("id")),
        contains_join(asked, own, "asked", "head"),
        contains_join(own, asked, "label", "asked"),
    ]
    pairs = [df.select("asked", "id", F.struct(F.lit(r), "ord").alias("rank")) for r, df in enumerate(ranked)]
    best = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).groupBy("asked").agg(F.min_by("id", "rank").alias("voice"))
    return names.join(best, "asked", "left")


def dispatch(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """The tool of a call, or the message for an unknown one."""
    known = tools.select("name", F.col("description").alias("_found"))
    known = F.broadcast(known) if known.count() <= MAX_LISTED else known
    return calls.join(known, "name", "left").withColumn(
        "answer", F.coalesce("_found", F.concat(F.lit("unknown tool: "), F.col("name")))
    ).drop("_found")
