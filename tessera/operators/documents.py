"""Documents as rows: paragraphs, sheets, sections, rendering.

A document is ``(doc_id, para_no, style, text)``; operations are projections and
filters over those rows, positions are fractional and renumbered at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Places of sections by template (0: not rendered).
TEMPLATES = ("word_default", "word_student", "word_research", "word_modern", "html_ats", "html_editable", "markdown")
SECTIONS = {
    "summary": (1, 1, 1, 1, 1, 1, 1),
    "work": (2, 0, 4, 2, 2, 2, 2),
    "projects": (3, 3, 3, 3, 3, 3, 3),
    "internships": (0, 4, 0, 0, 0, 0, 0),
    "education": (4, 2, 5, 4, 4, 4, 4),
    "skills": (5, 5, 6, 5, 5, 5, 5),
    "publications": (6, 0, 2, 0, 0, 6, 6),
    "patents": (7, 0, 7, 0, 0, 0, 0),
    "awards": (8, 6, 8, 0, 0, 0, 7),
    "languages": (9, 0, 0, 0, 0, 0, 0),
}
HEADING_SIZE = {1: 22, 2: 18, 3: 16, 4: 14, 5: 13, 6: 12}


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line; empty lines at the end are no paragraphs."""
    lines = F.split(F.regexp_replace(text, r"\n+$", ""), "\n")
    return df.select("doc_id", F.posexplode(lines).alias("para_no", "text")).select(
        "doc_id",
        F.col("para_no").cast("long"),
        F.when(F.col("para_no") == 0, "Heading1").otherwise("Normal").alias("style"),
        "text",
    )


def is_heading() -> Column:
    return F.col("style").startswith("Heading")


def modify_title(paras: DataFrame, title: Column) -> DataFrame:
    """The first heading gets the title; documents without one get a heading on top."""
    w = Window.partitionBy("doc_id")
    first = F.min(F.when(is_heading(), F.col("para_no"))).over(w)
    rows = paras.withColumn("_f", first)
    changed = rows.withColumn("text", F.when(F.col("para_no") == F.col("_f"), title).otherwise(F.col("text"))).drop("_f")
    new = rows.filter("_f is null").select("doc_id").distinct().select(
        "doc_id", F.lit(-1).cast("long").alias("para_no"), F.lit("Heading1").alias("style"), title.alias("text")
    )
    return renumber(changed.unionByName(new))


def renumber(paras: DataFrame, order: str = "para_no") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)).cast("long") - 1
    out = paras.withColumn("_p", place)
    return out.withColumn("para_no", F.col("_p")).drop("_p", *([order] if order != "para_no" else []))


def indent(paras: DataFrame, chars: int) -> DataFrame:
    """Twips for paragraphs that are neither headings nor blank."""
    hit = ~is_heading() & ~F.col("text").rlike(r"^\s*$")
    return paras.withColumn("indent", F.when(hit, F.lit(chars * 240)).otherwise(0).cast("long"))


def indent_counts(indented: DataFrame) -> DataFrame:
    """How many paragraphs of each document ``indent`` reached."""
    return indented.groupBy("doc_id").agg(F.count_if(F.col("indent") > 0).alias("modified"))


def add_image(paras: DataFrame, image: Column, position: str = "end", text: str | None = None) -> DataFrame:
    """A paragraph of style ``Image`` at the beginning or end, or before or after the first paragraph that contains ``text``.

    Where no paragraph has the text, and for any other position, it goes to the end.
    """
    end = F.max("para_no") + 0.5
    if position == "beginning":
        at = F.min("para_no") - 0.5
    elif position in ("before_text", "after_text") and text is not None:
        found = F.min(F.when(F.col("text").contains(text), F.col("para_no")))
        at = F.coalesce(found + (-0.5 if position == "before_text" else 0.5), end)
    else:
        at = end
    new = paras.groupBy("doc_id").agg(at.cast("double").alias("_o"))
    new = new.select("doc_id", "_o", F.lit("Image").alias("style"), image.alias("text"))
    rows = paras.select("doc_id", F.col("para_no").cast("double").alias("_o"), "style", "text")
    return renumber(rows.unionByName(new), "_o")


def format_result(paras: DataFrame, target: str) -> DataFrame:
    """``(doc_id, modified, error)``: how many paragraphs a format reaches; none is an error."""
    hit = is_heading() if target.lower() == "all_headings" else F.col("text").contains(target)
    n = F.count_if(hit)
    return paras.groupBy("doc_id").agg(n.alias("modified"), F.when(n == 0, F.concat(F.lit("no match: "), F.lit(target))).alias("error"))


def add_heading(paras: DataFrame, text: str, level: int, after: str | None = None) -> DataFrame:
    """A heading at the end, or behind the first paragraph that contains ``after``."""
    found = F.max("para_no") if after is None else F.min(F.when(F.col("text").contains(after), F.col("para_no")))
    at = paras.groupBy("doc_id").agg(found.alias("at")).filter("at is not null")
    new = at.select("doc_id", (F.col("at") + 0.5).alias("_o"), F.lit(f"Heading{level}").alias("style"), F.lit(text).alias("text"))
    rows = paras.select("doc_id", F.col("para_no").cast("double").alias("_o"), "style", "text")
    return renumber(rows.unionByName(new), "_o")


def format_matching(paras: DataFrame, target: str, bold: bool | None = None, size: int | None = None) -> DataFrame:
    """Formats of paragraphs that contain ``target`` (or of all headings); only what is given changes."""
    hit = is_heading() if target.lower() == "all_headings" else F.col("text").contains(target)
    old_bold = F.col("bold") if "bold" in paras.columns else F.lit(None).cast("boolean")
    old_size = F.col("size") if "size" in paras.columns else F.lit(None).cast("int")
    return paras.withColumns(
        {
            "bold": F.when(hit, F.coalesce(F.lit(bold), old_bold)).otherwise(old_bold),
            "size": F.when(hit, F.coalesce(F.lit(size), old_size)).otherwise(old_size),
        }
    )


def sheet_cells(df: DataFrame, rows: str = "rows") -> DataFrame:
    """``(sheet_id, row_no, col_no, kind, value)``; null rows are skipped, null cells are empty text."""
    out = df.select("sheet_id", F.posexplode(rows).alias("row_no", "cells")).filter("cells is not null")
    out = out.select("sheet_id", "row_no", F.posexplode("cells").alias("col_no", "raw"))
    number = F.expr("try_cast(raw as double)")
    return out.select(
        "sheet_id",
        F.col("row_no").cast("long"),
        F.col("col_no").cast("long"),
        F.when(number.isNotNull(), "number").otherwise("text").alias("kind"),
        F.coalesce("raw", F.lit("")).alias("value"),
    )


def sheet_dims(df: DataFrame) -> DataFrame:
    cols = F.coalesce(F.size("headers"), F.size(F.get("rows", F.lit(0))), F.lit(0))
    return df.select("sheet_id", cols.cast("long").alias("n_cols"), F.coalesce(F.size("rows"), F.lit(0)).cast("long").alias("n_rows"))


def section_table(spark: SparkSession) -> DataFrame:
    rows = [(t, s, places[i]) for s, places in SECTIONS.items() for i, t in enumerate(TEMPLATES) if places[i]]
    return spark.createDataFrame(rows, "template string, section string, ordinal long")


def section_order(content: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of each document by template, empty ones dropped, numbered anew."""
    rows = content.filter("n_items > 0").join(F.broadcast(sections), "section")
    place = F.row_number().over(Window.partitionBy("doc_id", "template").orderBy("ordinal")).cast("long")
    return rows.select("doc_id", "template", "section", place.alias("place"))


def render_markdown(df: DataFrame, title: str, contact: Sequence[str], items: str) -> DataFrame:
    """A heading, a contact line of what is there, and one bullet per item that is not blank."""
    body = F.array_join(F.transform(F.filter(items, lambda x: ~x.rlike(r"^\s*$")), lambda x: F.concat(F.lit("- "), x)), "\n")
    return df.withColumn(
        "markdown", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col(title)), F.nullif(F.concat_ws(" | ", *contact), F.lit("")), F.nullif(body, F.lit("")))
    )


def render_html(df: DataFrame, title: str, contact: Sequence[str], items: str) -> DataFrame:
    """The same content as escaped HTML; what is missing leaves no element."""
    from ..functions.scalar import contact_line, html_escape

    line = F.nullif(contact_line([F.col(c) for c in contact], " · "), F.lit(""))
    points = F.transform(F.filter(items, lambda x: ~x.rlike(r"^\s*$")), lambda x: F.concat(F.lit("<li>"), html_escape(x), F.lit("</li>")))
    body = F.when(F.size(points) > 0, F.concat(F.lit("<ul>"), F.array_join(points, ""), F.lit("</ul>")))
    return df.withColumn(
        "html",
        F.concat_ws("", F.concat(F.lit("<h1>"), html_escape(F.col(title)), F.lit("</h1>")), F.concat(F.lit("<p>"), html_escape(line), F.lit("</p>")), body),
    )


# Ranges of arguments, characters of an indent and levels of a heading.
INDENTS, LEVELS = (0, 10), (1, 6)
#: Operations on paragraphs by name, each ``f(paras, **arguments)``.
OPERATIONS = {
    "modify_title": lambda paras, title: modify_title(paras, F.lit(title)),
    "set_first_line_indent": lambda paras, indent_chars=2: indent(paras, indent_chars),
    "add_heading": lambda paras, text, level=1, after=None: add_heading(paras, text, level, after),
    "format_heading": lambda paras, target_text, bold=None, size=None: format_matching(paras, target_text, bold, size),
    "add_image": lambda paras, image, position="end", text=None: add_image(paras, F.lit(image), position, text),
}


def operate(paras: DataFrame, operation: str, **arguments) -> DataFrame:
    """One of ``OPERATIONS``; arguments out of range and unknown names are refused."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    if not INDENTS[0] <= arguments.get("indent_chars", 0) <= INDENTS[1] or not LEVELS[0] <= arguments.get("level", 1) <= LEVELS[1]:
        raise ValueError(f"{operation}: argument out of range")
    return OPERATIONS[operation](paras, **arguments)
