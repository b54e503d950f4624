"""Resumes: nested input with aliased names, rendered as paragraphs, Markdown or HTML.

A resume is one struct column. Every rendering is a column expression over it, so a
table of resumes is rendered in one narrow pass, without any Python on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import date_range, html_escape

# Names that input may use for a field.
TEXT_FIELDS = {
    "name": (), "language": (), "phone": (), "email": (), "github": (), "linkedin": (),
    "targetRole": ("target_role", "targetPosition", "desired_position"),
    "location": ("city", "address"),
    "summary": ("professional_summary", "profile", "objective"),
}
EXPERIENCE = {
    "organization": ("company", "employer", "org"),
    "role": ("title", "position", "job_title"),
    "location": (),
    "startDate": ("start_date", "start"),
    "endDate": ("end_date", "end"),
    "scope": ("team_size", "teamSize", "team_scope"),
    "responsibilities[]": (),
    "bulletPoints[]": ("bullet_points", "bullets", "achievements", "highlights"),
    "methods": (), "tools": (), "results": (),
}
EDUCATION = {
    "institution": ("school", "university"),
    "degree": (),
    "major": ("field", "field_of_study", "major_name"),
    "startDate": ("start_date", "start"),
    "endDate": ("end_date", "end", "graduation_date"),
    "gpa": ("gpa_scale",),
    "relevantCourses[]": ("relevant_courses", "courses"),
    "honors": (),
}
LISTS = {
    "educationList": EDUCATION,
    "workExperienceList": EXPERIENCE,
    "projectList": EXPERIENCE,
    "internshipList": EXPERIENCE,
    "skillList": {"category": (), "skills[]": ()},
    "publicationList": dict.fromkeys(("authors", "title", "journal", "year", "volume", "issue", "pages", "doi"), ()),
    "patentList": dict.fromkeys(("title", "patentNumber", "inventors", "status"), ()),
    "awardList": dict.fromkeys(("title", "organization", "date"), ()),
    "languageList": dict.fromkeys(("language", "reading", "writing", "speaking", "certification"), ()),
}

# Sections of each template in order, with their Chinese and English headings.
WORD = {
    "default": (
        ("summary", "职业概述", "Professional Summary"),
        ("workExperienceList", "工作经历", "Experience"),
        ("projectList", "项目经历", "Projects"),
        ("educationList", "教育背景", "Education"),
        ("skillList", "核心技能", "Skills"),
        ("publicationList", "论文发表", "Publications"),
        ("patentList", "专利", "Patents"),
        ("awardList", "获奖与荣誉", "Awards & Honors"),
        ("languageList", "语言与证书", "Languages & Certifications"),
    ),
    "student": (
        ("summary", "个人简介", "Profile"),
        ("educationList", "教育背景", "Education"),
        ("projectList", "项目经历", "Projects"),
        ("internshipList", "实习经历", "Internships"),
        ("skillList", "技能", "Skills"),
        ("awardList", "获奖与荣誉", "Awards & Honors"),
    ),
    "research": (
        ("summary", "研究兴趣", "Research Interests"),
        ("publicationList", "代表性论文", "Selected Publications"),
        ("projectList", "研究经历", "Research Experience"),
        ("workExperienceList", "工作经历", "Professional Experience"),
        ("educationList", "教育背景", "Education"),
        ("skillList", "实验/计算方法与技能", "Methods & Skills"),
        ("patentList", "专利", "Patents"),
        ("awardList", "荣誉与奖励", "Honors & Awards"),
    ),
    "modern": (
        ("summary", None, None),
        ("workExperienceList", "工作经历", "Experience"),
        ("projectList", "项目", "Projects"),
        ("educationList", "教育", "Education"),
        ("skillList", "技能", "Skills"),
    ),
}
PAGE = (
    ("summary", "职业概述", "Professional Summary"),
    ("workExperienceList", "工作经历", "Experience"),
    ("projectList", "项目经历", "Projects"),
    ("educationList", "教育背景", "Education"),
    ("skillList", "核心技能", "Skills"),
    ("publicationList", "论文发表", "Publications"),
    ("awardList", "获奖与荣誉", "Awards & Honors"),
)
RULE = "————————————————"
_LINE = "array<struct<style:string,text:string>>"


# --- input ------------------------------------------------------------------


def _kind(name: str) -> str:
    return "array<string>" if name.endswith("[]") else "string"


def _ddl(fields: dict[str, Sequence[str]]) -> str:
    return ",".join(f"{x}:{_kind(n)}" for n, others in fields.items() for x in (n.removesuffix("[]"), *others))


def _named(get: Callable[[str], Column], fields: dict[str, Sequence[str]]) -> Column:
    """A struct of the fields under their own names; of several names given the first counts."""
    out = []
    for n, others in fields.items():
        own = n.removesuffix("[]")
        value = F.coalesce(*(get(x) for x in (own, *others)))
        out.append((F.coalesce(value, F.array().cast("array<string>")) if n.endswith("[]") else value).alias(own))
    return F.struct(*out)


def _reader(fields: dict[str, Sequence[str]]) -> Callable[[Column], Column]:
    return lambda x: _named(x.getField, fields)


def parse(c: Column) -> Column:
    """The resume struct of a JSON text; lists that are missing are empty, the language is Chinese unless said."""
    text = F.regexp_replace(c, r'"GPA"(\s*:)', '"gpa"$1')
    lists = ",".join(f"{n}:array<struct<{_ddl(f)}>>" for n, f in LISTS.items())
    raw = F.from_json(text, f"struct<{_ddl(TEXT_FIELDS)},{lists},certificateList:array<string>>")
    top = _named(raw.getField, TEXT_FIELDS)
    fields = [top.getField(n).alias(n) for n in TEXT_FIELDS if n != "language"]
    fields.append(F.coalesce(top.getField("language"), F.lit("zh")).alias("language"))
    for n, spec in LISTS.items():
        own = F.transform(raw.getField(n), _reader(spec))
        kind = ",".join(f"{f.removesuffix('[]')}:{_kind(f)}" for f in spec)
        fields.append(F.coalesce(own, F.array().cast(f"array<struct<{kind}>>")).alias(n))
    fields.append(F.coalesce(raw.getField("certificateList"), F.array().cast("array<string>")).alias("certificateList"))
    return F.when(raw.isNotNull(), F.struct(*fields))


# --- parts ------------------------------------------------------------------


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^\s*$")


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _if_there(c: Column, before: str = "", after: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))


def _dates(e: Column) -> Column:
    return date_range(e["startDate"], e["endDate"])


def _full(items: Column) -> Column:
    return F.filter(items, lambda x: ~_blank(x))


def _chinese(r: Column, template: str = "") -> Column:
    return r["language"].isin("zh", "bilingual") if template == "default" else r["language"] == "zh"


def _contacts(r: Column, separator: str, link: Callable[[str, Column], Column], escape: Callable[[Column], Column] = lambda c: c) -> Column:
    own = [escape(r[n]) for n in ("phone", "email", "location")]
    return F.concat_ws(separator, *own, link("GitHub", escape(r["github"])), link("LinkedIn", escape(r["linkedin"])))


# --- paragraphs -------------------------------------------------------------


def _line(style: str, text: Column, when: Column | None = None) -> Column:
    one = F.array(F.struct(F.lit(style).alias("style"), text.alias("text")))
    return one if when is None else F.when(when, one).otherwise(F.array().cast(_LINE))


def _bullets(items: Column) -> Column:
    return F.transform(_full(items), lambda x: F.struct(F.lit("Bullet").alias("style"), F.concat(F.lit("•  "), x).alias("text")))


def _each(items: Column, lines: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(items, lines))


def _experience(e: Column) -> Column:
    dates = _dates(e)
    meta = F.concat(_or_empty(e["organization"]), _if_there(e["location"], "  ·  "), F.when(dates != "", F.concat(F.lit("    "), dates)).otherwise(""))
    shown = (e["organization"].isNotNull() | e["startDate"].isNotNull()) & (meta != "")
    title = F.concat(_or_empty(e["role"]), F.when(shown, F.concat(F.lit("    "), meta)).otherwise(""))
    points = F.when(F.size(e["bulletPoints"]) > 0, e["bulletPoints"]).otherwise(e["responsibilities"])
    details = F.concat(_if_there(e["methods"], "方法：", "；"), _if_there(e["tools"], "工具：", "；"), _if_there(e["results"], "成果："))
    return F.concat(_line("Entry", title), _line("Detail", e["scope"], ~_blank(e["scope"])), _bullets(points), _line("Bullet", F.concat(F.lit("•  "), details), details != ""))


def _experience_compact(e: Column) -> Column:
    dates = _dates(e)
    title = F.concat(_or_empty(e["role"]), _if_there(e["organization"], "  @  "), F.when(dates != "", F.concat(F.lit("  ("), dates, F.lit(")"))).otherwise(""))
    return F.concat(_line("Entry", title), _bullets(e["bulletPoints"]))


def _school(e: Column) -> Column:
    return F.concat(_or_empty(e["institution"]), _if_there(e["degree"], "  |  "), _if_there(e["major"], "  ·  "))


def _span(e: Column, before: str, after: str = "") -> Column:
    there = e["startDate"].isNotNull() | e["endDate"].isNotNull()
    return F.when(there, F.concat(F.lit(before), _or_empty(e["startDate"]), F.lit(" - "), _or_empty(e["endDate"]), F.lit(after))).otherwise("")


def _education(e: Column) -> Column:
    return F.concat(
        _line("Entry", F.concat(_school(e), _span(e, "    "))),
        _line("Detail", F.concat(F.lit("GPA: "), e["gpa"]), ~_blank(e["gpa"])),
        _line("Detail", F.concat(F.lit("相关课程: "), F.array_join(e["relevantCourses"], "、")), F.size(e["relevantCourses"]) > 0),
        _line("Detail", e["honors"], ~_blank(e["honors"])),
    )


def _publication(e: Column) -> Column:
    parts = [_if_there(e["authors"], "", ". "), _if_there(e["title"], "《", "》")]
    parts += [_if_there(e[n], before, after) for n, before, after in (("journal", ". ", ""), ("year", ". ", ""), ("volume", "; ", ""), ("issue", "(", ")"), ("pages", ": ", ""), ("doi", ". DOI: ", ""))]
    return _line("Entry", F.concat(*parts))


def _patent(e: Column) -> Column:
    return _line("Entry", F.concat(_or_empty(e["title"]), _if_there(e["patentNumber"], " (", ")"), _if_there(e["inventors"], ". 发明人："), _if_there(e["status"], ". 状态：")))


def _award(e: Column) -> Column:
    return F.concat(_or_empty(e["title"]), _if_there(e["organization"], " — "), _if_there(e["date"], " (", ")"))


def _spoken(e: Column) -> Column:
    skills = F.concat(_if_there(e["reading"], "读:", " "), _if_there(e["writing"], "写:", " "), _if_there(e["speaking"], "说:"))
    some = e["reading"].isNotNull() | e["writing"].isNotNull() | e["speaking"].isNotNull()
    return F.concat(_or_empty(e["language"]), F.when(some, F.concat(F.lit("（"), skills, F.lit("）"))).otherwise(""), _if_there(e["certification"], " [", "]"))


def _skills(e: Column) -> Column:
    return _line("Entry", F.concat(e["category"], F.lit("："), F.array_join(e["skills"], "、")), ~_blank(e["category"]))


def word(r: Column, template: str = "default") -> Column:
    """The paragraphs ``(style, text)`` of a Word resume; sections without content have no heading."""
    compact = template == "modern"
    chinese = _chinese(r, template)
    contact = _contacts(r, "  |  ", lambda n, c: F.concat(F.lit(f"{n}: "), c))
    target = F.concat(F.when(r["language"] == "zh", "目标岗位：").otherwise("Target: "), r["targetRole"])
    parts = [_line("Title", _or_empty(r["name"])), _line("Target", target, ~_blank(r["targetRole"])), _line("Contact", contact, contact != ""), _line("Empty", F.lit(""))]
    entries = {
        "workExperienceList": _experience_compact if compact else _experience,
        "projectList": _experience_compact if compact else _experience,
        "internshipList": _experience,
        "educationList": (lambda e: _line("Entry", F.concat(_school(e), _span(e, "  (", ")")))) if compact else _education,
        "skillList": _skills,
        "publicationList": _publication,
        "patentList": _patent,
        "awardList": lambda e: _line("Entry", F.concat(F.lit("• "), _award(e))),
    }
    for name, zh, en in WORD[template]:
        if name == "summary":
            there, lines = ~_blank(r["summary"]), _line("Body", r["summary"])
        elif name == "languageList":
            there = (F.size(r[name]) > 0) | (F.size(r["certificateList"]) > 0)
            spoken = F.concat(F.transform(r[name], _spoken), r["certificateList"])
            lines = F.transform(spoken, lambda x: F.struct(F.lit("Bullet").alias("style"), F.concat(F.lit("•  "), x).alias("text")))
        else:
            there, lines = F.size(r[name]) > 0, _each(r[name], entries[name])
        if zh:
            lines = F.concat(_line("Section", F.when(chinese, zh).otherwise(en)), _line("Rule", F.lit(RULE)), lines)
        parts.append(F.when(there, lines).otherwise(F.array().cast(_LINE)))
    return F.concat(*parts)


# --- Markdown ---------------------------------------------------------------


def markdown(r: Column) -> Column:
    """A Markdown resume; responsibilities are no substitute for bullets here."""
    chinese = _chinese(r)
    nl = F.lit("\n")

    def joined(items: Column, each: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(items, each), "")

    def dated(e: Column) -> Column:
        return F.when(_dates(e) != "", F.concat(F.lit("  \n*"), _dates(e), F.lit("*"))).otherwise("")

    def points(e: Column) -> Column:
        return joined(_full(e["bulletPoints"]), lambda x: F.concat(F.lit("- "), x, nl))

    def work(e: Column) -> Column:
        return F.concat(F.lit("### "), _or_empty(e["role"]), F.lit("\n\n**"), _or_empty(e["organization"]), F.lit("**"), _if_there(e["location"], " · "), dated(e), F.lit("\n\n"), points(e), nl)

    def project(e: Column) -> Column:
        tools = F.coalesce(F.concat(F.lit("\n*"), F.when(chinese, "工具").otherwise("Tools"), F.lit("："), e["tools"], F.lit("*\n")), F.lit(""))
        return F.concat(F.lit("### "), _or_empty(e["role"]), F.lit("\n\n"), _if_there(e["organization"], "**", "**\n\n"), points(e), tools, nl)

    def school(e: Column) -> Column:
        line = F.concat(_or_empty(e["degree"]), F.lit(" · "), _or_empty(e["major"]))
        return F.concat(F.lit("### "), _or_empty(e["institution"]), F.lit("\n\n"), line, dated(e), F.lit("\n\n"), _if_there(e["gpa"], "GPA: ", "\n\n"), _if_there(e["honors"], "", "\n\n"))

    def skill(e: Column) -> Column:
        return F.coalesce(F.concat(F.lit("- **"), e["category"], F.lit("：**"), F.array_join(e["skills"], "、"), nl), F.lit(""))

    def paper(e: Column) -> Column:
        return F.concat(F.lit("- "), _if_there(e["authors"], "", ". "), F.lit("《"), _or_empty(e["title"]), F.lit("》"), _if_there(e["journal"], ". "), _if_there(e["year"], ". "), nl)

    bodies = {
        "workExperienceList": (work, ""),
        "projectList": (project, ""),
        "educationList": (school, ""),
        "skillList": (skill, "\n"),
        "publicationList": (paper, "\n"),
        "awardList": (lambda e: F.concat(F.lit("- "), _award(e), nl), "\n"),
    }
    contact = _contacts(r, " | ", lambda n, c: F.concat(F.lit(f"[{n}]("), c, F.lit(")")))
    parts = [F.concat(F.lit("# "), _or_empty(r["name"]), F.lit("\n\n")), F.when(contact != "", F.concat(contact, F.lit("\n\n")))]
    role = F.concat(F.lit("**"), F.when(chinese, "目标岗位").otherwise("Target Role"), F.lit("：**"), r["targetRole"], F.lit("\n\n"))
    parts.append(F.when(~_blank(r["targetRole"]), role))
    for name, zh, en in PAGE:
        head = F.concat(F.lit("## "), F.when(chinese, zh).otherwise(en), F.lit("\n\n"))
        if name == "summary":
            parts.append(F.when(~_blank(r["summary"]), F.concat(head, r["summary"], F.lit("\n\n"))))
        else:
            each, end = bodies[name]
            parts.append(F.when(F.size(r[name]) > 0, F.concat(head, joined(r[name], each), F.lit(end))))
    return F.concat_ws("", *parts)


# --- HTML -------------------------------------------------------------------


def _tag(name: str, *content: Column, of: str = "") -> Column:
    opened = f"<{name} class=\"{of}\">" if of else f"<{name}>"
    return F.concat(F.lit(opened), *content, F.lit(f"</{name}>"))


def html(r: Column, editable: bool = False, style: str = "") -> Column:
    """A page with the resume's content, escaped.

    The plain form has one column for scanners: entries keep their place and dates
    apart, responsibilities stand in for missing bullets, skills are a list of
    definitions. The editable form shows bullets only, and grades and publications
    besides. The look is up to ``style``.
    """
    chinese = _chinese(r)
    safe = lambda c: html_escape(_or_empty(c))
    word_for = lambda zh, en: F.when(chinese, zh).otherwise(en)
    listed = lambda items: F.array_join(F.transform(_full(items), lambda x: _tag("li", safe(x))), "")

    def entry(e: Column) -> Column:
        points = e["bulletPoints"] if editable else F.when(F.size(e["bulletPoints"]) > 0, e["bulletPoints"]).otherwise(e["responsibilities"])
        bullets = F.when(F.size(points) > 0, _tag("ul", listed(points))).otherwise("")
        title = _tag("div", safe(e["role"]), of="entry-title")
        if editable:
            return _tag("div", title, _tag("div", safe(e["organization"]), F.lit("  "), _dates(e), of="entry-meta"), bullets, of="entry")
        place = F.concat(safe(e["organization"]), F.coalesce(F.concat(F.lit(" · "), html_escape(e["location"])), F.lit("")))
        head = _tag("div", _tag("div", title, _tag("div", place, of="entry-meta")), _tag("div", _dates(e), of="entry-date"), of="entry-head")
        return _tag("article", head, bullets, of="entry")

    def project(e: Column) -> Column:
        if not editable:
            return entry(e)
        bullets = F.when(F.size(e["bulletPoints"]) > 0, _tag("ul", listed(e["bulletPoints"]))).otherwise("")
        return _tag("div", _tag("div", safe(e["role"]), of="entry-title"), _tag("div", safe(e["organization"]), of="entry-meta"), bullets, of="entry")

    def school(e: Column) -> Column:
        degree = F.concat(safe(e["degree"]), F.lit(" · "), safe(e["major"]))
        if editable:
            title = _tag("div", _tag("span", safe(e["institution"]), of="keep-token"), of="entry-title")
            grade = F.coalesce(_tag("div", F.lit("GPA: "), html_escape(e["gpa"])), F.lit(""))
            return _tag("div", title, _tag("div", degree, F.lit("  "), _dates(e), of="entry-meta"), grade, of="entry")
        named = _tag("div", _tag("div", safe(e["institution"]), of="entry-title"), _tag("div", degree, of="entry-meta"))
        return _tag("article", _tag("div", named, _tag("div", _dates(e), of="entry-date"), of="entry-head"), of="entry")

    def skill(e: Column) -> Column:
        every = safe(F.array_join(e["skills"], ", "))
        pair = (_tag("div", safe(e["category"]), of="skills-cat"), _tag("div", every)) if editable else (_tag("dt", safe(e["category"])), _tag("dd", every))
        return F.when(e["category"].isNotNull(), F.concat(*pair)).otherwise("")

    def paper(e: Column) -> Column:
        there = lambda n, before: F.coalesce(F.concat(F.lit(before), html_escape(e[n])), F.lit(""))
        title = F.coalesce(_tag("em", html_escape(e["title"])), F.lit(""))
        return _tag("li", F.coalesce(F.concat(html_escape(e["authors"]), F.lit(". ")), F.lit("")), title, there("journal", ". "), there("year", ". "))

    each = {"workExperienceList": entry, "projectList": project, "educationList": school, "skillList": skill, "publicationList": paper}
    around = {"skillList": ("div", "skills-grid") if editable else ("dl", "skills"), "publicationList": ("ul", "")}
    contact = _contacts(r, " &nbsp;|&nbsp; ", lambda n, c: F.concat(F.lit(f"{n}: "), c), html_escape)
    title = _tag("h1", safe(r["name"]))
    target = safe(r["targetRole"])
    if editable:
        role = F.coalesce(_tag("p", _tag("strong", word_for("目标岗位：", "Target: "), html_escape(r["targetRole"]))), F.lit(""))
        parts = [title, _tag("div", contact, of="contact"), role]
    else:
        named = _tag("div", title, F.when(target != "", _tag("div", target, of="target")).otherwise(""))
        parts = [_tag("header", named, _tag("div", contact, of="contact"))]
    for name, zh, en in PAGE:
        if name == "awardList" or name == "publicationList" and not editable:
            continue
        head = _tag("h2", word_for(zh, en))
        if name == "summary":
            there = r["summary"].isNotNull() if editable else ~_blank(r["summary"])
            body = _tag("p", safe(r["summary"]))
        else:
            there, body = F.size(r[name]) > 0, F.array_join(F.transform(r[name], each[name]), "")
            if name in around:
                body = _tag(around[name][0], body, of=around[name][1])
        parts.append(F.when(there, F.concat(head, body) if editable else _tag("section", head, body)).otherwise(""))
    lang = F.concat(F.lit('<!doctype html><html lang="'), word_for("zh-CN", "en"), F.lit('">'))
    head = _tag("head", F.lit('<meta charset="utf-8">'), _tag("title", safe(r["name"]), F.lit(" - "), target), _tag("style", F.lit(style)))
    return F.concat(lang, head, _tag("body", *parts), F.lit("</html>"))


#: Operations on parsed resumes by name, each ``f(resume, **arguments)``.
OPERATIONS: dict[str, Callable[..., Column]] = {
    "generate_resume": lambda r, template="default": word(r, template),
    "generate_html": lambda r, editable=False, style="": html(r, editable, style),
    "generate_markdown": lambda r: markdown(r),
}


def operate(resumes: DataFrame, operation: str, column: str = "r", out: str = "result", **arguments) -> DataFrame:
    """``resumes`` with the result of one of ``OPERATIONS``; no name and unknown names are refused with those there are."""
    name = (operation or "").strip()
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation!r}; there are {', '.join(OPERATIONS)}")
    return resumes.withColumn(out, OPERATIONS[name](F.col(column), **arguments))
