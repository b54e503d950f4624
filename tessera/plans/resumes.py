"""Queries over rendered resumes; the oracles spell out the text for the input's cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resumes as X
from ..sources import office as O
from .catalog import query

BREAK = "chr(10)"
ZH = "k % 3 <> 0"


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


def _join(*lines: str) -> str:
    return f"concat_ws({BREAK}, {', '.join(lines)})"


def _head(zh: str, en: str, there: str) -> str:
    return _when(there, f"'Section: ' || CASE WHEN {ZH} THEN '{zh}' ELSE '{en}' END || {BREAK} || 'Rule: {X.RULE}'")


SPAN = "CASE WHEN k % 2 = 0 THEN '2019 - 2020' ELSE '2019 - 至今' END"
WORK, SECOND, PROJECT, STAY, SCHOOL, SKILL = "k % 3 <> 0", "k % 3 = 2", "k % 2 = 1", "k % 6 = 0", "k % 4 <> 0", "k % 3 <> 1"
PAPER, PATENT, AWARD, SPOKEN, SUMMARY = "k % 5 = 0", "k % 5 = 1", "k % 3 = 0", "k % 4 = 1", "k % 4 <> 3"
CONTACT = """concat_ws('{0}', CASE WHEN k % 2 = 0 THEN '12' END, CASE WHEN k % 3 <> 1 THEN 'e@x' END, CASE WHEN k % 4 = 0 THEN 'C' END, CASE WHEN k % 5 = 0 THEN '{1}g{3}' END, CASE WHEN k % 7 = 0 THEN '{2}l{3}' END)"""
TOP = [
    "'Title: ' || name",
    _when("k % 3 <> 2", f"'Target: ' || CASE WHEN {ZH} THEN '目标岗位：' ELSE 'Target: ' END || 'Role ' || k"),
    "'Contact: ' || nullif(" + CONTACT.format("  |  ", "GitHub: ", "LinkedIn: ", "") + ", '')",
    "'Empty: '",
]
SUM = "'Sum ' || k || ' & more'"
WORKS = [
    _when(WORK, f"'Entry: T0    Org0  ·  L    ' || {SPAN}"),
    _when(WORK, "'Bullet: •  b1'"),
    _when(f"{WORK} AND k % 5 = 1", "'Bullet: •  工具：TL；'"),
    _when(SECOND, _join("'Entry: T1    Org1'", "'Bullet: •  r1'", "'Bullet: •  r2'")),
]
PROJECTS = [_when(PROJECT, _join("'Entry: P'", "'Bullet: •  x <y>'", "'Bullet: •  工具：spark；'"))]
STAYS = [_when(STAY, _join("'Entry: I    IO'", "'Detail: S'"))]
SCHOOLS = [
    _when(SCHOOL, "'Entry: U' || k || '  |  BSc  ·  CS    2015 - '"),
    _when(f"{SCHOOL} AND k % 3 = 0", "'Detail: GPA: 4.0'"),
    _when(SCHOOL, "'Detail: 相关课程: c1、c2'"),
    _when(f"{SCHOOL} AND k % 5 = 2", "'Detail: H'"),
]
SKILLS = [_when(SKILL, "'Entry: Lang：a、b'")]
PAPERS = [_when(PAPER, "'Entry: A. 《T》. J. 2020; 1(2): 3-4. DOI: 10/1'")]
PATENTS = [_when(PATENT, "'Entry: PT (N1). 发明人：I1. 状态：S1'")]
AWARDS = [_when(AWARD, "'Entry: • AW — AO (2021)'")]
TONGUES = [_when(SPOKEN, _join("'Bullet: •  English（读:R 说:S） [C1]'", "'Bullet: •  CERT'"))]
LINES = {
    "default": [
        *TOP, _head("职业概述", "Professional Summary", SUMMARY), _when(SUMMARY, f"'Body: ' || {SUM}"), _head("工作经历", "Experience", WORK), *WORKS, _head("项目经历", "Projects", PROJECT), *PROJECTS,
        _head("教育背景", "Education", SCHOOL), *SCHOOLS, _head("核心技能", "Skills", SKILL), *SKILLS, _head("论文发表", "Publications", PAPER), *PAPERS, _head("专利", "Patents", PATENT), *PATENTS,
        _head("获奖与荣誉", "Awards & Honors", AWARD), *AWARDS, _head("语言与证书", "Languages & Certifications", SPOKEN), *TONGUES,
    ],
    "student": [
        *TOP, _head("个人简介", "Profile", SUMMARY), _when(SUMMARY, f"'Body: ' || {SUM}"), _head("教育背景", "Education", SCHOOL), *SCHOOLS, _head("项目经历", "Projects", PROJECT), *PROJECTS,
        _head("实习经历", "Internships", STAY), *STAYS, _head("技能", "Skills", SKILL), *SKILLS, _head("获奖与荣誉", "Awards & Honors", AWARD), *AWARDS,
    ],
    "research": [
        *TOP, _head("研究兴趣", "Research Interests", SUMMARY), _when(SUMMARY, f"'Body: ' || {SUM}"), _head("代表性论文", "Selected Publications", PAPER), *PAPERS, _head("研究经历", "Research Experience", PROJECT), *PROJECTS,
        _head("工作经历", "Professional Experience", WORK), *WORKS, _head("教育背景", "Education", SCHOOL), *SCHOOLS, _head("实验/计算方法与技能", "Methods & Skills", SKILL), *SKILLS,
        _head("专利", "Patents", PATENT), *PATENTS, _head("荣誉与奖励", "Honors & Awards", AWARD), *AWARDS,
    ],
    "modern": [
        *TOP, _when(SUMMARY, f"'Body: ' || {SUM}"), _head("工作经历", "Experience", WORK), _when(WORK, f"'Entry: T0  @  Org0  (' || {SPAN} || ')' || {BREAK} || 'Bullet: •  b1'"), _when(SECOND, "'Entry: T1  @  Org1'"),
        _head("项目", "Projects", PROJECT), _when(PROJECT, _join("'Entry: P'", "'Bullet: •  x <y>'")), _head("教育", "Education", SCHOOL), _when(SCHOOL, "'Entry: U' || k || '  |  BSc  ·  CS  (2015 - )'"), _head("技能", "Skills", SKILL), *SKILLS,
    ],
}
INPUT = "(SELECT s_suppkey AS k, s_name || ' <&>' AS name FROM supplier)"


def _resumes(t):
    return t.resume_json.select("k", X.parse(F.col("data")).alias("r"))


for _template, _lines in LINES.items():

    @query(f"resume_word_{_template}", f"SELECT k, {_join(*_lines)} AS lines FROM {INPUT}")
    def _(t, template=_template):
        lines = F.transform(X.word(F.col("r"), template), lambda x: F.concat(x["style"], F.lit(": "), x["text"]))
        return _resumes(t).select("k", F.array_join(lines, "\n").alias("lines"))


@query("resume_word_file", f"SELECT k, {_join(*LINES['default'])} AS lines FROM {INPUT}")
def _(t):
    """Written as a Word file and read back."""
    paras = _resumes(t).select(F.col("k").alias("doc_id"), F.posexplode(X.word(F.col("r"))).alias("para_no", "x")).select("doc_id", "para_no", "x.*")
    back = O.read_word(O.write_word(paras))
    lines = F.array_sort(F.collect_list(F.struct("para_no", F.concat("style", F.lit(": "), "text").alias("line"))))
    return back.groupBy(F.col("doc_id").alias("k")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))


def _title(zh: str, en: str, before: str = "## ", after: str = f" || {BREAK} || {BREAK}") -> str:
    return f"'{before}' || CASE WHEN {ZH} THEN '{zh}' ELSE '{en}' END{after}"


N = BREAK
MARKDOWN = " || ".join(
    [
        f"'# ' || name || {N} || {N}",
        f"coalesce(nullif({CONTACT.format(' | ', '[GitHub](', '[LinkedIn](', ')')}, '') || {N} || {N}, '')",
        f"CASE WHEN k % 3 <> 2 THEN '**' || CASE WHEN {ZH} THEN '目标岗位' ELSE 'Target Role' END || '：**Role ' || k || {N} || {N} ELSE '' END",
        f"CASE WHEN {SUMMARY} THEN {_title('职业概述', 'Professional Summary')} || {SUM} || {N} || {N} ELSE '' END",
        f"CASE WHEN {WORK} THEN {_title('工作经历', 'Experience')} || '### T0' || {N} || {N} || '**Org0** · L  ' || {N} || '*' || {SPAN} || '*' || {N} || {N} || '- b1' || {N} || {N} ELSE '' END",
        f"CASE WHEN {SECOND} THEN '### T1' || {N} || {N} || '**Org1**' || {N} || {N} || {N} ELSE '' END",
        f"CASE WHEN {PROJECT} THEN {_title('项目经历', 'Projects')} || '### P' || {N} || {N} || '- x <y>' || {N} || {N} || '*' || CASE WHEN {ZH} THEN '工具' ELSE 'Tools' END || '：spark*' || {N} || {N} ELSE '' END",
        f"CASE WHEN {SCHOOL} THEN {_title('教育背景', 'Education')} || '### U' || k || {N} || {N} || 'BSc · CS  ' || {N} || '*2015 - 至今*' || {N} || {N} || CASE WHEN k % 3 = 0 THEN 'GPA: 4.0' || {N} || {N} ELSE '' END || CASE WHEN k % 5 = 2 THEN 'H' || {N} || {N} ELSE '' END ELSE '' END",
        f"CASE WHEN {SKILL} THEN {_title('核心技能', 'Skills')} || '- **Lang：**a、b' || {N} || {N} ELSE '' END",
        f"CASE WHEN {PAPER} THEN {_title('论文发表', 'Publications')} || '- A. 《T》. J. 2020' || {N} || {N} ELSE '' END",
        f"CASE WHEN {AWARD} THEN {_title('获奖与荣誉', 'Awards & Honors')} || '- AW — AO (2021)' || {N} || {N} ELSE '' END",
    ]
)


@query("resume_markdown", f"SELECT k, {MARKDOWN} AS markdown FROM {INPUT}")
def _(t):
    return _resumes(t).select("k", X.markdown(F.col("r")).alias("markdown"))


def _h2(zh: str, en: str) -> str:
    return f"'<h2>' || CASE WHEN {ZH} THEN '{zh}' ELSE '{en}' END || '</h2>'"


def _part(there: str, body: str, section: bool) -> str:
    return f"CASE WHEN {there} THEN {chr(39) + '<section>' + chr(39) + ' || ' if section else ''}{body}{' || ' + chr(39) + '</section>' + chr(39) if section else ''} ELSE '' END"


SAFE = "replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ROLE = "CASE WHEN k % 3 <> 2 THEN 'Role ' || k ELSE '' END"
OPEN = f"'<!doctype html><html lang=\"' || CASE WHEN {ZH} THEN 'zh-CN' ELSE 'en' END || '\"><head><meta charset=\"utf-8\"><title>' || {SAFE} || ' - ' || {ROLE} || '</title><style></style></head><body>'"
LINE = CONTACT.format(" &nbsp;|&nbsp; ", "GitHub: ", "LinkedIn: ", "")
SAFE_SUM = f"'<p>' || replace({SUM}, '&', '&amp;') || '</p>'"


def _ats(title: str, meta: str, dates: str, bullets: str) -> str:
    return f"'<article class=\"entry\"><div class=\"entry-head\"><div><div class=\"entry-title\">{title}</div><div class=\"entry-meta\">{meta}</div></div><div class=\"entry-date\">' || {dates} || '</div></div>{bullets}</article>'"


def _plain(title: str, meta: str, bullets: str) -> str:
    return f"'<div class=\"entry\"><div class=\"entry-title\">{title}</div><div class=\"entry-meta\">{meta}</div>{bullets}</div>'"


ATS = " || ".join(
    [
        OPEN,
        f"'<header><div><h1>' || {SAFE} || '</h1>' || CASE WHEN k % 3 <> 2 THEN '<div class=\"target\">' || {ROLE} || '</div>' ELSE '' END || '</div><div class=\"contact\">' || {LINE} || '</div></header>'",
        _part(SUMMARY, f"{_h2('职业概述', 'Professional Summary')} || {SAFE_SUM}", True),
        _part(WORK, f"{_h2('工作经历', 'Experience')} || {_ats('T0', 'Org0 · L', SPAN, '<ul><li>b1</li></ul>')} || CASE WHEN {SECOND} THEN {_ats('T1', 'Org1', chr(39) * 2, '<ul><li>r1</li><li>r2</li></ul>')} ELSE '' END", True),
        _part(PROJECT, f"{_h2('项目经历', 'Projects')} || {_ats('P', '', chr(39) * 2, '<ul><li>x &lt;y&gt;</li></ul>')}", True),
        _part(SCHOOL, f"{_h2('教育背景', 'Education')} || {_ats(chr(39) + ' || ' + chr(39) + 'U' + chr(39) + ' || k || ' + chr(39), 'BSc · CS', chr(39) + '2015 - 至今' + chr(39), '')}", True),
        _part(SKILL, f"{_h2('核心技能', 'Skills')} || '<dl class=\"skills\"><dt>Lang</dt><dd>a, b</dd></dl>'", True),
        "'</body></html>'",
    ]
)
EDITABLE = " || ".join(
    [
        OPEN,
        f"'<h1>' || {SAFE} || '</h1><div class=\"contact\">' || {LINE} || '</div>' || CASE WHEN k % 3 <> 2 THEN '<p><strong>' || CASE WHEN {ZH} THEN '目标岗位：' ELSE 'Target: ' END || {ROLE} || '</strong></p>' ELSE '' END",
        _part(SUMMARY, f"{_h2('职业概述', 'Professional Summary')} || {SAFE_SUM}", False),
        _part(WORK, f"{_h2('工作经历', 'Experience')} || {_plain('T0', 'Org0  ' + chr(39) + ' || ' + SPAN + ' || ' + chr(39), '<ul><li>b1</li></ul>')} || CASE WHEN {SECOND} THEN {_plain('T1', 'Org1  ', '')} ELSE '' END", False),
        _part(PROJECT, f"{_h2('项目经历', 'Projects')} || {_plain('P', '', '<ul><li>x &lt;y&gt;</li></ul>')}", False),
        _part(SCHOOL, f"{_h2('教育背景', 'Education')} || '<div class=\"entry\"><div class=\"entry-title\"><span class=\"keep-token\">U' || k || '</span></div><div class=\"entry-meta\">BSc · CS  2015 - 至今</div>' || CASE WHEN k % 3 = 0 THEN '<div>GPA: 4.0</div>' ELSE '' END || '</div>'", False),
        _part(SKILL, f"{_h2('核心技能', 'Skills')} || '<div class=\"skills-grid\"><div class=\"skills-cat\">Lang</div><div>a, b</div></div>'", False),
        _part(PAPER, f"{_h2('论文发表', 'Publications')} || '<ul><li>A. <em>T</em>. J. 2020</li></ul>'", False),
        "'</body></html>'",
    ]
)


@query("resume_html_ats", f"SELECT k, {ATS} AS html FROM {INPUT}")
def _(t):
    return _resumes(t).select("k", X.html(F.col("r")).alias("html"))


@query("resume_html_editable", f"SELECT k, {EDITABLE} AS html FROM {INPUT}")
def _(t):
    return _resumes(t).select("k", X.html(F.col("r"), editable=True).alias("html"))
