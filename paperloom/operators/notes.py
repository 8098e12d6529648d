"""Raw submission notes: replies, profiles and lenient JSON to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.literal import literal_json


def reviews(notes: DataFrame) -> DataFrame:
    """Rows of openreview_reviews, with the paper they belong to.

    notes: venue, id, replies array<struct<id, replyto, tmdate, signatures, content map>>.
    """
    reply = notes.select("venue", F.col("id").alias("paper_openreview_id"), F.explode("replies").alias("r"))
    layout = X.era("venue")
    who = X.writer("r.signatures")
    who = F.when(layout == "v1", who).otherwise(F.lower(who))
    return reply.select(
        "venue", "paper_openreview_id", F.col("r.id").alias("review_openreview_id"), F.col("r.replyto").alias("replyto_openreview_id"), who.alias("writer"),
        X.reply_title(F.map_keys("r.content"), who, layout).alias("title"), F.to_json("r.content").alias("content"), X.from_millis("r.tmdate").alias("time"),
    )


def paper_reviews(notes: DataFrame) -> DataFrame:
    return reviews(notes).select("venue", "paper_openreview_id", "review_openreview_id", "title", "time")


def first_decision(replies: Column) -> Column:
    """The decision of the first reply that has one."""
    field = lambda r: F.coalesce(F.try_element_at(r["content"], F.lit("recommendation")), F.try_element_at(r["content"], F.lit("decision")))
    return F.try_element_at(F.filter(F.transform(replies, field), lambda d: d.isNotNull()), F.lit(1))


def papers(notes: DataFrame) -> DataFrame:
    """Rows of openreview_papers; withdrawn submissions of the newer layout are left out."""
    v1 = X.era("venue") == "v1"
    kept = notes.where(v1 | F.coalesce(X.not_withdrawn("venueid"), F.lit(True)))
    decided = F.when(v1, first_decision(F.col("replies"))).otherwise(X.decision("venueid", "venue_text"))
    return kept.select("venue", F.col("id").alias("paper_openreview_id"), "title", "abstract", decided.alias("paper_decision"), F.col("pdf").alias("paper_pdf_link"))


def paper_authors(notes: DataFrame) -> DataFrame:
    return notes.select("venue", F.col("id").alias("paper_openreview_id"), F.explode(F.array_distinct("authorids")).alias("author_openreview_id"))


def profiles(raw: DataFrame) -> DataFrame:
    """Author rows with fall-backs: preferred or first name, preferred or first confirmed or first mail."""
    c = lambda path: F.col(f"content.{path}")
    preferred = F.try_element_at(F.filter(c("names"), lambda n: n["preferred"]), F.lit(1))
    name = F.coalesce(preferred["fullname"], F.try_element_at(c("names"), F.lit(1))["fullname"], F.lit(""))
    mail = F.coalesce(c("preferredEmail"), F.get(c("emailsConfirmed"), F.lit(0)), F.get(c("emails"), F.lit(0)), F.lit(""))
    place = F.coalesce(F.get(c("history"), F.lit(0))["institution"]["name"], F.lit(""))
    return raw.select(
        "venue", F.col("id").alias("author_openreview_id"), name.alias("author_full_name"), mail.alias("email"), place.alias("affiliation"),
        F.coalesce(c("homepage"), F.lit("")).alias("homepage"), F.coalesce(c("dblp"), F.lit("")).alias("dblp"),
    )


def lenient_json(c: Column | str) -> Column:
    """Valid JSON text of a value: JSON itself; a Python literal (one that is no dict as {"_value": ...}); other text as {"_raw": text}; blank is {}."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    blank, is_json = X.is_blank(text), F.try_parse_json(text).isNotNull()
    literal = literal_json(F.when(~blank & ~is_json, text))  # the others pass as nulls
    return F.when(blank, "{}").when(is_json, text).otherwise(F.coalesce(literal, F.to_json(F.struct(text.alias("_raw")))))


def encoded(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in df.dtypes])
