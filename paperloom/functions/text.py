"""Strings, ids and dates as Column -> Column functions; none runs Python for a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_title(c: C) -> Column:
    """Lower case, trimmed, single spaces; null becomes ''."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    odd = reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")])  # the others are as the pattern would leave them
    return F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def clean_title(c: C) -> Column:
    """Only ASCII letters, digits and white space, collapsed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9\s]", ""), r"\s+", " ")))


def fold_title(c: C) -> Column:
    """Lower case, without punctuation, for letters of any script; full-width forms become ASCII."""
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F))
    narrow = "".join(chr(i) for i in range(0x21, 0x7F))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(_c(c), wide, narrow)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def strip_nul(c: C) -> Column:
    return F.replace(_c(c), F.lit("\x00"), F.lit(""))


def printable(c: C) -> Column:
    """Without control and other unprintable characters."""
    return F.regexp_replace(_c(c), r"\p{C}", "")


def printable_json(c: C) -> Column:
    """As printable, also for escaped control characters inside a JSON text."""
    return F.regexp_replace(printable(c), r"\\u00[01][0-9a-fA-F]|(?<!\\)\\[bfnrt]", "")


def drop_commands(c: C) -> Column:
    """LaTeX commands go together with their arguments."""
    return F.regexp_replace(_c(c), r"\\[a-zA-Z]+(\[[^\]]*\])?(\{[^}]*\})?", "")


def drop_markup(c: C) -> Column:
    """LaTeX command words and braces go, the text stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"\\[a-zA-Z]+\s?", ""), r"[{}]", ""))


def _argument(c: C, command: str) -> Column:
    got = F.regexp_extract(_c(c), rf"\\{command}\{{([^}}]+)\}}", 1)
    return F.when(got != "", got)


def label_of(c: C) -> Column:
    return _argument(c, "label")


def caption_of(c: C) -> Column:
    return _argument(c, "caption")


def label_for(c: C) -> Column:
    return F.concat(F.lit("\\label{"), _c(c), F.lit("}"))


def refs(c: C) -> Column:
    """Labels of all reference macros."""
    return F.regexp_extract_all(_c(c), F.lit(r"\\ref\{([^}]+)\}"), F.lit(1))


#: The citation macros.
CITE_MACROS = "cite citet citep citealt citealp citeauthor citeyear citeyearpar citenum parencite textcite autocite fullcite footcite supercite".split()


def cites(c: C, optional_arguments: bool = False) -> Column:
    """Keys of all citation macros in order, split at commas and trimmed."""
    option = r"(?:\[[^\]]*\])*" if optional_arguments else ""
    found = F.regexp_extract_all(_c(c), F.lit(rf"\\(?:{'|'.join(CITE_MACROS)})\*?{option}\{{([^}}]+)\}}"), F.lit(1))
    return F.filter(F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda k: F.trim(k)))), lambda k: k != "")


def reference_type(c: C) -> Column:
    low = F.lower(_c(c))
    return F.when(low.startswith("fig"), "figure").when(low.startswith("tab"), "table")


#: Where sentences and paragraphs of LaTeX text end.
SENTENCE_END = r"(?<=[.!?])\s+|\n+|\\\\|&"
PARAGRAPH_END = r"\n\n|\\\\|\}\n"


def _parts(c: C, end: str) -> Column:
    return F.split(F.trim(F.regexp_replace(_c(c), r"^\s+|\s+$", "")), end)


def last_sentence(c: C) -> Column:
    """Struct of the unfinished text after the last sentence end, and whether a sentence ended before it."""
    parts = _parts(c, SENTENCE_END)
    last = F.element_at(parts, -1)
    ended = last.rlike("[.?!]$")
    return F.struct(F.when(ended, "").otherwise(last).alias("text"), (ended | (F.size(parts) > 1)).alias("complete"))


def first_sentence(c: C) -> Column:
    parts = _parts(c, SENTENCE_END)
    first = F.element_at(parts, 1)
    return F.struct(first.alias("text"), (first.rlike("[.?!]$") | (F.size(parts) > 1)).alias("complete"))


def last_paragraph(c: C) -> Column:
    parts = _parts(c, PARAGRAPH_END)
    return F.struct(F.element_at(parts, -1).alias("text"), (F.size(parts) > 1).alias("complete"))


def first_paragraph(c: C) -> Column:
    parts = _parts(c, PARAGRAPH_END)
    return F.struct(F.element_at(parts, 1).alias("text"), (F.size(parts) > 1).alias("complete"))


def flat_name(c: C) -> Column:
    return F.replace(_c(c), F.lit("/"), F.lit("_"))


def figure_target(c: C) -> Column:
    """pdf and eps figures are kept as png."""
    return F.regexp_replace(_c(c), r"(?i)\.(pdf|eps)$", ".png")


#: arXiv ids of the new and the old style.
_ARXIV_ID = r"(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})"


def arxiv_id(c: C) -> Column:
    """Struct of base id and version (int or null); a base of null marks an invalid id."""
    pattern = rf"^\s*{_ARXIV_ID}(?:v(\d+))?\s*$"
    return F.struct(_extracted(c, pattern).alias("base"), F.regexp_extract(_c(c), pattern, 2).try_cast("int").alias("version"))


def prefixed_arxiv_id(c: C) -> Column:
    """Without arXiv: and version, with ARXIV: in front."""
    return F.concat(F.lit("ARXIV:"), F.regexp_replace(F.regexp_replace(F.trim(_c(c)), r"(?i)^arxiv:", ""), r"v\d+$", ""))


def strip_abs_url(c: C) -> Column:
    return F.regexp_replace(_c(c), r"^https?://arxiv\.org/abs/", "")


def _extracted(c: C, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(_c(c), pattern, group)
    return F.when(got != "", got)


def url_to_id(c: C) -> Column:
    """Id, with its version if there is one, in an abs or pdf URL; query, fragment and .pdf are left out."""
    bare = F.regexp_replace(_c(c), r"[?#].*$", "")
    return _extracted(bare, r"arxiv\.org/(?:abs|pdf)/((?:\d{4}\.\d{4,5}|[A-Za-z-]+(?:\.[A-Za-z-]+)?/\d{7})(?:v\d+)?)(?:\.pdf)?$")


def doi_to_id(c: C) -> Column:
    """Id in an arXiv DOI, without version; null for other DOIs."""
    bare = F.regexp_replace(F.trim(_c(c)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")
    return F.regexp_replace(_extracted(bare, r"(?i)^10\.48550/arxiv\.([^?#]+)"), r"v\d+$", "")


def bib_to_id(c: C) -> Column:
    return _extracted(c, rf"(?i)eprint\s*=\s*[{{\"]?\s*(?:arxiv:)?{_ARXIV_ID}")


def any_to_id(value: C, kind: C) -> Column:
    """Id of an input whose kind is id, bib or url."""
    k = F.lower(_c(kind))
    return F.when(k == "id", arxiv_id(value)["base"]).when(k == "bib", F.coalesce(bib_to_id(value), journal_id(value))).when(k == "url", F.coalesce(url_to_id(value), doi_to_id(value)))


def journal_id(c: C) -> Column:
    return _extracted(c, rf"(?i)arxiv[:\s]+(?:preprint\s+arxiv:)?{_ARXIV_ID}")


def first_author(c: C) -> Column:
    return F.trim(F.element_at(F.split(_c(c), r"\band\b"), 1))


def surname(c: C) -> Column:
    author = first_author(c)
    return F.when(author.contains(","), F.trim(F.substring_index(author, ",", 1))).otherwise(F.element_at(F.split(author, r"\s+"), -1))


def paragraph_number(c: C) -> Column:
    return F.regexp_extract(_c(c), r"^text_(\d+)$", 1).try_cast("int")


def is_blank(c: C) -> Column:
    return _c(c).isNull() | (F.trim(_c(c)) == "")


def math_noise(c: C) -> Column:
    """At least three of 0-9 + - * / = and fewer than ten letters."""
    return (F.regexp_count(_c(c), F.lit(r"[0-9+\-*/=]")) >= 3) & (F.regexp_count(_c(c), F.lit("[A-Za-z]")) < 10)


def contains_any(c: C, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_c(c).contains(p) for p in parts], F.lit(False))


#: Marks of table and figure environments.
ENVIRONMENTS = "figure\\*? subfigure table\\*? subtable tabular tabularx tabulary longtable array".split()
RULES = "multicolumn multirow cline toprule midrule bottomrule cmidrule".split()


def environment_chunk(c: C) -> Column:
    """Chunks that hold a table or figure environment."""
    return _c(c).rlike(rf"(?i)hline|\\begin\{{(?:{'|'.join(ENVIRONMENTS)})\}}|\\(?:{'|'.join(RULES)})")


def major_category(c: C, category: str) -> Column:
    return F.exists(_c(c), lambda x: F.substring_index(x, ".", 1) == category)


def not_withdrawn(venueid: C) -> Column:
    return F.element_at(F.split(_c(venueid), "/"), -1) != "Withdrawn_Submission"


def era(venue: C) -> Column:
    """Record layout of a venue: v1 up to 2023 with exceptions, else v2."""
    v = _c(venue)
    return F.when(v.rlike("20(1[0-9]|2[0-3])") & ~v.rlike(r"ICML\.cc/2023|NeurIPS\.cc/2023|EMNLP/2023"), "v1").otherwise("v2")


def decision(venueid: C, venue_text: C) -> Column:
    last = F.element_at(F.split(_c(venueid), "/"), -1)
    return F.when(last == "Conference", _c(venue_text)).otherwise(last)


def reply_title(fields: Column, writer: Column, layout: Column) -> Column:
    """Title of a reply from the names of its content fields, its writer and its record layout."""
    has = lambda name: F.array_contains(fields, name)
    old = F.when(has("summary_of_the_paper") | has("rating"), F.concat(F.lit("Official Review by "), writer))
    new = F.when(has("summary"), F.concat(F.lit("Official Review by "), writer)).when(has("metareview"), F.concat(F.lit("Meta Review by "), writer))
    answer = F.when(F.lower(writer).contains("reviewer"), F.concat(F.lit("Response by "), writer)).otherwise("Response by Authors")
    return F.coalesce(F.when(layout == "v1", old).otherwise(new), F.when(has("decision"), "Paper Decision"), answer)


def writer(signatures: C) -> Column:
    return F.element_at(F.split(F.try_element_at(_c(signatures), F.lit(-1)), "/"), -1)


def from_millis(c: C) -> Column:
    """Epoch milliseconds as yyyy-MM-dd HH:mm:ss of the session time zone."""
    return F.date_format(F.timestamp_millis(_c(c)), "yyyy-MM-dd HH:mm:ss")


def lenient_date(c: C) -> Column:
    """YYYY-MM-DD, or YYYY-MM as the first of the month; else null."""
    text = F.trim(_c(c))
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")), F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")))


def lenient_year(c: C) -> Column:
    return F.year(F.try_to_timestamp(_c(c).cast("string")))


def appendix_flag(c: C) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))) == "true", F.lit(False))


def within_years(date: C, first: int, last: int, is_seed: Column | None = None) -> Column:
    """Inclusive; seeds always pass."""
    inside = F.year(_c(date)).between(first, last)
    return inside if is_seed is None else is_seed | inside
