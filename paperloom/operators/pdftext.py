"""Paragraphs out of the extracted text of a PDF, as windows over its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import link


def paragraphs(texts: DataFrame, boilerplate: list[str] | None = None, paper: str = "paper_openreview_id", text: str = "text") -> DataFrame:
    """(paper, paragraph_idx, section, content) from (paper, text).

    Lines are assembled, cut to Abstract ... References, and freed of math noise, bare numbers and boilerplate; a
    heading is "Abstract" or a short line that starts with a section number. A block goes on with the paragraph before it
    unless that ends with a full stop and the block does not start a list. Captions are held back
    until the section's text is through.
    """
    lines = texts.select(paper, F.posexplode(F.split(text, r"\r?\n")).alias("line_at", "line"))
    rows = link.assemble(lines, paper, "line_at", "line")
    content = F.col("content")
    rows = link.between_markers(rows, paper, "at", F.lower(content) == "abstract", F.lower(content) == "references")
    heading = (F.lower(content) == "abstract") | (content.rlike(r"^\d+(\.\d+)*\.?\s+\p{Lu}") & (F.length("content") <= 80) & ~content.rlike(r"[.!?]$"))
    rows = link.carry_heading(rows.withColumn("is_heading", heading), paper, "at", F.when(heading, content))
    drop = F.col("is_heading") | X.math_noise("content") | content.rlike(r"^\d+$")
    if boilerplate:
        drop = drop | X.contains_any("content", boilerplate)
    rows = rows.where(~drop & F.col("section").isNotNull()).withColumn("caption", content.rlike("^(Figure|Table)"))
    section = Window.partitionBy(paper, "section").orderBy("caption", "at")
    before = F.lag("content").over(section)
    starts_list = content.rlike(r"^(\d[.)]|•|\()")
    fresh = F.col("caption") | before.isNull() | (before.rlike(r"\.$") & ~starts_list)
    rows = rows.withColumn("part", F.sum(fresh.cast("int")).over(section))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), " ")
    parts = rows.groupBy(paper, "section", "part").agg(F.min("at").alias("at"), joined.alias("content"))
    section_at = F.min("at").over(Window.partitionBy(paper, "section"))
    index = F.row_number().over(Window.partitionBy(paper).orderBy("section_at", "part")) - 1
    return parts.withColumn("section_at", section_at).withColumn("paragraph_idx", index).select(paper, "paragraph_idx", "section", "content")
