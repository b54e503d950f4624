"""Column functions. All are built from Spark's own, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters up to the space, which a trim of the source platform removes.
CONTROL = "".join(map(chr, range(33)))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(CONTROL))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def normalize_dimension(c: Column) -> Column:
    return F.lower(trim(c))


def normalize_type(c: Column) -> Column:
    return F.when(F.lower(trim(c)) == "preference", "preference").otherwise("fact")


def truncate(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def strip_fences(c: Column) -> Column:
    """Drop a leading and a trailing code fence where the text starts with one."""
    inner = F.regexp_replace(F.regexp_replace(trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```\s*$", "")
    return F.when(trim(c).startswith("```"), inner).otherwise(trim(c))


def parse_records(c: Column, schema: str) -> Column:
    """An array of records; anything that is no JSON array gives an empty one."""
    text = strip_fences(c)
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, f"array<{schema}>")), F.array().cast(f"array<{schema}>"))


def decode_message(rich: Column, role: Column, content: Column) -> Column:
    """The rich JSON where there is one that parses, else role and content."""
    parsed = F.try_parse_json(blank_to_null(rich))
    return F.when(parsed.isNotNull(), rich).otherwise(F.to_json(F.struct(role.alias("role"), content.alias("content"))))


def text_or_reasoning(content: Column, reasoning: Column) -> Column:
    return F.coalesce(blank_to_null(content), trim(reasoning), F.lit(""))


def file_safe(c: Column, cut: int | None = 20) -> Column:
    safe = F.regexp_replace(c, r'[\\/:*?"<>|]', "_")
    return F.substring(safe, 1, cut) if cut else safe


def resolve_path(c: Column, folder: str) -> Column:
    bare = ~c.contains("/") & ~c.contains("\\")
    return F.when(bare, F.concat(F.lit(folder.rstrip("/") + "/"), c)).otherwise(c)


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024)))
    )


def date_range(start: Column, end: Column, present: str = "至今") -> Column:
    return (
        F.when(start.isNull() & end.isNull(), "")
        .when(start.isNull(), end)
        .when(end.isNull(), F.concat(start, F.lit(" - " + present)))
        .otherwise(F.concat(start, F.lit(" - "), end))
    )


def json_escape(c: Column) -> Column:
    """Backslash, quote, line feed, carriage return and tab, in this order; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def first_named(c: Column, names: Sequence[str]) -> Column:
    """A field of a JSON object under the first of several names that it has."""
    return F.coalesce(*(F.get_json_object(c, f"$.{n}") for n in names))


def new_bot_id() -> Column:
    """``bot_`` and eight random characters; not deterministic, so store it before use."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    one = lambda: F.substring(F.lit(letters), (F.floor(F.rand() * len(letters)) + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("bot_"), *(one() for _ in range(8)))


def new_trace_id() -> Column:
    return F.substring(F.expr("uuid()"), 1, 8)


def sendable(reply: Column) -> Column:
    """Replies that begin with the mark of an error text are not sent."""
    return ~reply.startswith("【")


def image_entry(vision: Column) -> Column:
    return F.concat(F.lit("[用户发送了一张图片，内容："), vision, F.lit("]"))


def drawing_entry(prompt: Column) -> Column:
    return F.concat(F.lit("[已发送图片，提示词："), prompt, F.lit("]"))


def cached_messages(c: Column) -> Column:
    """The messages of a cache entry, a JSON array; null (a miss) where it is missing, blank or no array."""
    parsed = F.try_parse_json(blank_to_null(c))
    return F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))


def sampled(key: Column, rate: float, enabled: bool = True, seed: int = 0) -> Column:
    """Whether a row is in a sample of the given rate: by a hash of its key, so it stays in it when a task is run again."""
    if not enabled or rate <= 0:
        return F.lit(False)
    return F.lit(True) if rate >= 1 else F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))


def strip_slashes(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def after_signal(c: Column, signals: Sequence[str], leads: str = "为|成|到|用") -> Column:
    """What follows the first signal of the list that has a rest; one lead word is dropped."""
    found = []
    for s in signals:
        at = F.instr(c, s)
        rest = trim(F.substring(c, at + F.lit(len(s)), F.lit(1 << 30)))
        found.append(F.when(at > 0, F.nullif(trim(F.regexp_replace(rest, f"^({leads})", "")), F.lit(""))))
    return F.coalesce(*found)


def within(value: Column, low: int, high: int | None = None) -> Column:
    """Whether a numeric argument is in its range; one that is missing or no number is not."""
    inside = value >= low if high is None else value.between(low, high)
    return F.coalesce(inside, F.lit(False))


def image_type(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.endswith(".png"), "png").when(low.endswith(".jpg") | low.endswith(".jpeg"), "jpeg")
    return out.when(low.endswith(".gif"), "gif").when(low.endswith(".bmp"), "bmp").otherwise("unknown")


def emu(width: Column, height: Column, cap: int = 500) -> tuple[Column, Column]:
    """Width and height in document units, the width capped and the aspect kept."""
    wide = width > cap
    h = F.when(wide, F.floor(height * cap / width + 0.5)).otherwise(height)
    return (F.when(wide, cap).otherwise(width) * 9525).cast("long"), (h * 9525).cast("long")


def voice_switch(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\[VOICE_SWITCH:([^\]]*)\]", 1), F.lit(""))


def success_flag(c: Column) -> Column:
    """By literal text, as the source does; ``success_value`` reads the JSON."""
    return c.contains('"success": true')


def success_value(c: Column) -> Column:
    return F.coalesce(F.get_json_object(c, "$.success") == "true", F.lit(False))


def api_error(c: Column) -> Column:
    return F.get_json_object(c, "$.code").isNotNull() & F.get_json_object(c, "$.message").isNotNull()


def sentences(c: Column) -> Column:
    """Finished sentences of a recogniser's JSON, or the input where there are none."""
    kind = "struct<sentences:array<struct<text:string,sentence_end:boolean>>>"
    rows = F.from_json(c, kind)["sentences"]
    text = F.array_join(F.transform(F.filter(rows, lambda x: x["sentence_end"] & x["text"].isNotNull()), lambda x: x["text"]), "")
    return F.coalesce(F.nullif(text, F.lit("")), c)


def image_url(c: Column) -> Column:
    first = F.nullif(F.get_json_object(c, "$.output.results[0].url"), F.lit(""))
    return F.coalesce(first, F.get_json_object(c, "$.output.choices[0].message.content[0].image"))


def severity(attempts: Column, offline_minutes: Column) -> Column:
    return F.when((attempts >= 3) | (offline_minutes >= 5), "critical").otherwise("warning")


def bullets(points: Column, duties: Column) -> Column:
    """Points that are not blank; duties where the list of points is empty or missing."""
    keep = lambda a: F.filter(a, lambda x: ~x.rlike(r"^\s*$"))
    return F.when(F.coalesce(F.size(points), F.lit(0)) > 0, keep(points)).otherwise(keep(duties))


def data_url(kind: str, data: Column) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(data))


def skills_line(category: Column, skills: Column) -> Column:
    """Category and list; null for a blank category."""
    line = F.concat(category, F.lit("："), F.coalesce(F.array_join(skills, "、"), F.lit("")))
    return F.when(~F.coalesce(category.rlike(r"^\s*$"), F.lit(True)), line)


def citation(authors: Column, title: Column, journal: Column, year: Column, pages: Column, doi: Column) -> Column:
    """A reference line of the parts that are there."""

    def part(before: str, c: Column, after: str = "") -> Column:
        return F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))

    return F.concat(
        part("", authors, ". "), part("《", title, "》"), part(". ", journal), part(". ", year), part(": ", pages), part(". DOI: ", doi)
    )


def contact_line(parts: Sequence[Column], separator: str) -> Column:
    return F.concat_ws(separator, *parts)


def drop_first_byte(data: Column) -> Column:
    return F.when(F.octet_length(data) > 0, F.substring(data, 2, 1 << 30))


def audio_url(c: Column) -> Column:
    return blank_to_null(F.get_json_object(c, "$.output.audio.url"))


def history_entry(name: Column, path: Column, summary: Column) -> Column:
    head = F.concat(F.lit("[用户发送了一个文件，文件名："), name, F.lit("，服务器路径："), path)
    return F.concat(head, F.lit("，内容摘要：\n"), F.substring(summary, 1, 2000), F.lit("\n]"))


def json_text(c: Column, key: str) -> Column:
    """A string field of a JSON object, escapes resolved."""
    return F.get_json_object(c, f"$.{key}")


def json_text_literal(c: Column, key: str) -> Column:
    """By literal text, as the source does: no space before the value, a backslash stands for the character behind it."""
    start = f'"{key}":"'
    raw = F.regexp_extract(c, f'{start}((?:[^"\\\\]|\\\\.)*)', 1)
    return F.when(c.contains(start), F.regexp_replace(raw, r"(?s)\\(.)", "$1"))


def explicit_send(c: Column) -> Column:
    """By literal text: the result of the tool that sends documents."""
    return c.contains('"send_document"')


# Status labels in Chinese and English.
PUBLICATION_STATUS = {
    "已发表": "Published",
    "已接收": "Accepted",
    "同行评审中": "Under peer review",
    "投稿待审中": "Submitted, pending editorial screening",
    "手稿准备中": "Manuscript in preparation",
    "预印本": "Preprint",
    "会议摘要": "Conference abstract",
    "会议海报": "Conference poster",
    "需用户确认": "Needs user confirmation",
}
PATENT_STATUS = {
    "已授权发明专利": "Granted invention patent",
    "发明专利申请": "Patent application",
    "实用新型专利": "Utility model",
    "外观设计专利": "Design patent",
    "PCT申请": "PCT application",
    "公开中": "Published application",
    "审查中": "Under examination",
    "已驳回": "Rejected",
    "已放弃": "Abandoned",
    "需用户确认": "Needs user confirmation",
}


def status_label(c: Column, vocabulary: dict[str, str]) -> Column:
    """The English label; what the vocabulary does not know needs confirmation."""
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit("Needs user confirmation"))


def candidate_stage(enrolled: Column, years_since: Column, years_worked: Column) -> Column:
    """The conditions that can be counted; all else is unknown."""
    return (
        F.when(enrolled, "STUDENT")
        .when(years_since.between(0, 2) & (F.coalesce(years_worked, F.lit(0)) < 3), "RECENT_GRADUATE")
        .when(years_worked >= 3, "EXPERIENCED")
        .otherwise("UNKNOWN")
    )


def pick_tunnel(urls: Column) -> Column:
    """The first https address, else the first."""
    return F.coalesce(F.get(F.filter(urls, lambda u: u.startswith("https")), F.lit(0)), F.get(urls, F.lit(0)))


def extension_ok(name: Column, allowed: Sequence[str]) -> Column:
    """Validation before a conversion: a named file with one of the extensions."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(False)
    for e in allowed:
        out = out | (low.endswith(e) & (F.length(low) > len(e)))
    return out
