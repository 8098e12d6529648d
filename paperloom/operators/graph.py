"""Expansion over citations, and the heterogeneous graph of papers, chunks and objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import link
from paperloom.session import checkpoint


def expand(
    seeds: DataFrame, citations: DataFrame, max_hops: int = 2, papers: DataFrame | None = None, constraint: Callable[[DataFrame], Column] | None = None, cap: int | None = None
) -> DataFrame:
    """(paper, hop, endpoint) reached from the seeds along (citing, cited) edges, each at its least hop.

    ``constraint`` maps the candidates (joined with ``papers`` on paper, if given) to a condition that new papers meet. Papers
    beyond ``cap``, in order of hop and id, are endpoints: kept, but not expanded. Each hop is one join and one
    anti-join; lineage is cut in the checkpoint folder.
    """
    visited = checkpoint(seeds.select("paper").distinct().select("paper", F.lit(0).alias("hop"), F.lit(False).alias("endpoint")))
    frontier, taken = visited, 0
    for hop in range(1, max_hops + 1):
        if cap is not None:
            taken += frontier.count()
            if taken >= cap:
                break
        found = citations.join(frontier.where("not endpoint"), citations["citing"] == frontier["paper"], "left_semi").select(F.col("cited").alias("paper")).where("paper is not null").distinct()
        found = found.join(visited, "paper", "left_anti")
        if constraint is not None:
            known = found if papers is None else found.join(papers, "paper", "left")
            found = known.where(constraint(known)).select("paper").distinct()
        found = found.withColumn("hop", F.lit(hop))
        if cap is None:
            found = found.withColumn("endpoint", F.lit(False))
        else:
            first = found.orderBy("paper").limit(max(0, cap - taken)).select("paper", F.lit(False).alias("inside"))
            found = found.join(first, "paper", "left").select("paper", "hop", F.col("inside").isNull().alias("endpoint"))
        frontier = checkpoint(found)
        if frontier.isEmpty():
            break
        visited = checkpoint(visited.unionByName(frontier))
    return visited


def heterogeneous(chunks: DataFrame, citations: DataFrame, figures: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph of papers, text chunks, figures and tables.

    chunks: paper_id, section, at, chunk_id, content; citations: paper_id, key, target (a paper); figures: paper_id,
    label, paths; tables: paper_id, label, content. Only objects that a chunk refers to are nodes, and of figures those of exactly one file.
    nodes: id, type, paper_id, content; edges: source, target, type.
    """
    whole = F.concat_ws(":", "paper_id", "chunk_id")
    text = chunks.withColumn("chunk_id", whole)
    single = figures.where(F.size("paths") == 1).withColumn("target", F.concat_ws(":", "paper_id", X.figure_target(X.flat_name(F.col("paths")[0]))))
    filled = tables.where(~X.is_blank("content")).withColumn("target", F.concat_ws(":", "paper_id", "label"))
    labels = single.select("paper_id", "label", "target", F.lit("ref_figure").alias("type")).unionByName(filled.select("paper_id", "label", "target", F.lit("ref_table").alias("type")))
    refs = text.select("paper_id", "chunk_id", F.explode(X.refs("content")).alias("label")).distinct().join(labels, ["paper_id", "label"])
    ref_edges = refs.select(F.col("chunk_id").alias("source"), "target", "type").distinct()
    papers = chunks.select("paper_id").distinct()
    cited = text.select("paper_id", "chunk_id", F.explode(X.cites("content")).alias("key")).distinct().join(citations, ["paper_id", "key"])
    cited = cited.join(papers.select(F.col("paper_id").alias("target")), "target", "left_semi")
    citing = cited.select(F.col("paper_id").alias("source"), "target", F.lit("citing_edge").alias("type")).distinct()
    current = cited.select(F.col("chunk_id").alias("source"), F.col("paper_id").alias("target"), F.lit("current_paper_edge").alias("type")).distinct()
    edges = citing.unionByName(current).unionByName(ref_edges).unionByName(link.adjacent_edges(text))
    used = ref_edges.select("target").distinct()
    nodes = papers.select(F.col("paper_id").alias("id"), F.lit("paperNode").alias("type"), "paper_id", F.lit(None).cast("string").alias("content"))
    nodes = nodes.unionByName(text.select(F.col("chunk_id").alias("id"), F.lit("textNode").alias("type"), "paper_id", "content"))
    objects = single.select("target", F.lit("figureNode").alias("type"), "paper_id", F.col("paths")[0].alias("content"))
    objects = objects.unionByName(filled.select("target", F.lit("tableNode").alias("type"), "paper_id", "content")).dropDuplicates(["target"])
    return nodes.unionByName(objects.join(used, "target", "left_semi").withColumnRenamed("target", "id")), edges


def touched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge points to."""
    return nodes.join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_semi")
