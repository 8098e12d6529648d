"""Mixing sources to target weights, with DataFrame operations only.

Targets: sources ordered by code point (null last) weigh 1, 2, 3, repeating, and share all words;
a target stops at ``MOST`` times its source's size and the excess is shared again by weight. In
closed form every uncapped source gets level * weight, where the level follows from one ordered
pass over the sources, range by range.

Drawing: a source's documents are permuted by a hash and laid end to end, again and again; the
mix takes the first ``target`` words of that stream, so no document is taken more than ``MOST``
times. The stream is cut into blocks of ``block_words`` words. A binary tree over the sources splits the exact block quotas
among ``2**depth`` output shards of equal size (but for one block): a node holds how many blocks of its sources each shard gets, and hands its left half a
multivariate-hypergeometric draw of these, shard after shard, down to the single sources. Every draw is inverted exactly, in double precision.
Leaf s of a source then owns the next run of its permuted blocks, disjoint from all others, and ``order_key`` shuffles the blocks inside a shard.

At scale: documents cross one shuffle as (id, source, size) rows, by (source, hash bucket), so a
source with a third of all rows is spread over buckets of about ``BUCKET_ROWS`` rows; running
positions are a sum inside a bucket plus the sum of the buckets before it. Tables by source have one
row for each source and are dealt by ranges and tree nodes; no task holds all sources.

Defined cases: a null or blank text has size 0 and takes nothing; a null source is a source of its
own; rows with equal id, source and text are interchangeable and each counts; a very long text is one row like others, counted whole; an
empty table gives no rows; only carried columns are kept, and they must not have the names of result columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.store import with_ids
from paperloom.session import checkpoint

MOST = 3
BUCKET_ROWS = 8192
WORD = r"[^\x20\x09-\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(total: str, marked: str, draws: str, uniform: str) -> str:
    """SQL for a draw of how many of ``draws`` out of ``total`` are among the ``marked``.

    The distribution is inverted over all counts within eight deviations (and eight counts) of the mean, so the work follows the deviation.
    """
    ratio = "CAST(g.k - k AS DOUBLE) * (g.n - k) / ((k + 1D) * (g.t - g.k - g.n + k + 1))"
    weigh = f"aggregate(sequence(g.a, g.b), struct(1D AS p, 0D AS s), (w, k) -> struct(w.p * {ratio} AS p, w.s + w.p AS s)).s"
    pick = f"aggregate(sequence(g.a, g.b), struct(1D AS p, 0D AS s, CAST(null AS BIGINT) AS x), (w, k) -> struct(w.p * {ratio} AS p, w.s + w.p AS s, coalesce(w.x, if(w.s + w.p >= h.goal, k, null)) AS x)).x"
    inverted = _let(f"struct({uniform} * {weigh} AS goal)", "h", f"coalesce({pick}, g.b)")
    basic = f"struct({total} AS t, {marked} AS k, {draws} AS n, greatest(0L, {draws} - ({total} - {marked})) AS lo, least({draws}, {marked}) AS hi, coalesce(try_divide({draws} * CAST({marked} AS DOUBLE), {total}), 0D) AS mean)"
    spread = "struct(f.t AS t, f.k AS k, f.n AS n, f.lo AS lo, f.hi AS hi, f.mean AS mean, coalesce(sqrt(f.mean * (1 - try_divide(CAST(f.k AS DOUBLE), f.t)) * try_divide(CAST(f.t - f.n AS DOUBLE), greatest(f.t - 1, 1L))), 0D) AS sd)"
    window = "struct(e.t AS t, e.k AS k, e.n AS n, e.lo AS lo, e.hi AS hi, greatest(e.lo, CAST(floor(e.mean - 8 * e.sd - 8) AS BIGINT)) AS a, least(e.hi, CAST(ceil(e.mean + 8 * e.sd + 8) AS BIGINT)) AS b)"
    return _let(basic, "f", _let(spread, "e", _let(window, "g", f"CASE WHEN g.lo >= g.hi THEN g.lo ELSE {inverted} END")))


def split_quotas(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(key, shard, n_blocks) from (key, n_blocks): exact quotas split among 2**depth shards.

    Shards differ by one block at most, and a key's counts add up to its quota.
    """
    keyed = checkpoint(with_ids(quotas.select("key", "n_blocks"), ["key"], 0, "at"))
    levels, shards = max(0, keyed.count() - 1).bit_length(), 1 << depth
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda j: F.struct(j.alias("level"), F.expr("at").alias("at"))))
    spots = keyed.select("n_blocks", above.alias("s")).select(F.col("s.level").alias("level"), F.floor(F.col("s.at") / F.pow(F.lit(2), levels - F.col("s.level"))).alias("node"), "n_blocks")
    totals = checkpoint(spots.groupBy("level", "node").agg(F.sum("n_blocks").alias("total")))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(F.col("total") / shards) + (i < F.col("total") % shards).cast("long"))
    nodes = totals.where("level = 0").select("node", even.alias("counts"))
    for level in range(1, levels + 1):
        lefts = totals.where((F.col("level") == level) & (F.col("node") % 2 == 0)).select(F.floor(F.col("node") / 2).alias("node"), F.col("total").alias("left_total"))
        uniform = f"((pmod(xxhash64({seed}L, {level}, node, i), 4503599627370496L) + 0.5D) / 4503599627370496D)"
        step = _let(_hypergeometric("acc.rest", "counts[i]", "acc.draws", uniform), "x", "struct(acc.rest - counts[i] AS rest, acc.draws - x AS draws, concat(acc.out, array(x)) AS out)")
        total = "aggregate(counts, 0L, (s, c) -> s + c)"
        left = f"aggregate(sequence(0, {shards - 1}), struct({total} AS rest, left_total AS draws, CAST(array() AS ARRAY<BIGINT>) AS out), (acc, i) -> {step}).out"
        nodes = nodes.join(lefts, "node").withColumn("left", F.expr(left))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "left", lambda c, x: c - x).alias("counts")),
        )
        nodes = nodes.select(F.explode(halves).alias("half")).select("half.node", "half.counts")
        if level % 4 == 0:
            nodes = checkpoint(nodes)
    return nodes.join(keyed, F.col("node") == F.col("at")).select("key", F.posexplode("counts").alias("shard", "n_blocks"))


def _targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to (key, source_size)."""
    cap = F.lit(MOST) * F.col("source_size")
    numbered = with_ids(sources, ["key"], 0, "at").select("key", "source_size", (F.col("at") % 3 + 1).alias("weight"))
    ranged = numbered.withColumn("ratio", cap / F.col("weight")).repartitionByRange("ratio", "key").withColumn("range", F.spark_partition_id())
    ranged = checkpoint(ranged)
    sums = ranged.groupBy("range").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    everything = sums.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("size", "weight")])
    inside = Window.partitionBy("range").orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    used = [F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("source_size", "weight")]
    rest = F.lit(everything["size"]) - F.lit(MOST) * (F.col("size_before") + used[0])
    level = rest / (F.lit(everything["weight"]) - F.col("weight_before") - used[1])
    levelled = ranged.join(F.broadcast(offsets), "range").withColumn("own_level", level)  # one row a partition
    open_ones = levelled.where(F.col("ratio") > F.col("own_level")).agg(F.min(F.struct("ratio", "key", "own_level")).alias("first")).first()["first"]
    target = cap.cast("double") if open_ones is None else F.least(cap.cast("double"), F.lit(open_ones["own_level"]) * F.col("weight"))
    return ranged.select("key", "source_size", "weight", target.alias("target"))


def _passes(value: Column) -> list[Column]:
    return [value + F.lit(p) * F.col("source_size") for p in range(MOST)]


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block_words: int = 1024, depth: int = 6, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, shards, order_keys, words_taken, carried columns.

    ``shards`` holds the output shard of each time the document is taken, in order,
    ``order_keys`` the place of its block in that shard's local shuffle, and ``words_taken`` the words it takes.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    base = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(text).cast("string")).alias("mark"), *carry))
    n_buckets = max(1, -(-base.count() // BUCKET_ROWS))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    placed = base.withColumn("key", key).withColumn("h", F.xxhash64(F.lit(seed), "key", "doc_id", "size", "mark")).withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = checkpoint(sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))))
    targets = _targets(sums.groupBy("key").agg(F.sum("bucket_size").alias("source_size")))
    targets = checkpoint(targets.withColumn("goal", F.floor(F.col("target") + 0.5)))
    quotas = targets.select("key", F.ceil(F.col("goal") / block_words).alias("n_blocks"))
    shards = split_quotas(quotas, depth, seed)
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "n_blocks"))), lambda x: x["n_blocks"])
    running = F.aggregate(ends, F.array().cast("array<bigint>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    owned = checkpoint(targets.join(shards.groupBy("key").agg(running.alias("ends")), "key", "left"))
    info = sums.join(owned, "key").select("key", "bucket", "bucket_start", "source_size", "target", "goal", "ends")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(info, ["key", "bucket"]).withColumn("start", F.col("bucket_start") + F.sum("size").over(inside) - F.col("size"))
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - at)) for at in _passes(F.col("start"))]
    taken = sum(parts[1:], parts[0])
    draws = F.filter(F.array(*[F.struct(F.floor(at / block_words).alias("block"), part.alias("words")) for part, at in zip(parts, _passes(F.col("start")), strict=True)]), lambda d: d["words"] > 0)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), draws.alias("draws"), "key", "ends", *carry)
    rows = rows.withColumn("blocks", F.col("draws.block"))
    shard_of = F.transform("blocks", lambda b: F.size(F.filter("ends", lambda e: e <= b)))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "taken", shard_of.alias("shards"),
        F.transform("blocks", lambda b: F.xxhash64(F.lit(seed), F.col("key"), b)).alias("order_keys"), F.col("draws.words").alias("words_taken"), *carry,
    )


def dealt(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: shard, order_key, doc_id, source, size, target, taken, words and text for each time a document is taken.

    Rows lie in the order of shard and order_key, which shuffles the blocks of all sources inside a shard; the last document that a target
    reaches is cut after the words taken. A document that is not taken has no row. ``mixed`` comes from mix() and carries the text.
    """
    draws = F.explode(F.arrays_zip("shards", "order_keys", "words_taken")).alias("draw")
    rows = mixed.select("doc_id", "source", "size", "target", "taken", F.col(text).alias("text"), draws)
    rows = rows.select(
        F.col("draw.shards").alias("shard"), F.col("draw.order_keys").alias("order_key"), "doc_id", "source", "size", "target", "taken", F.col("draw.words_taken").alias("words"), "text"
    )
    blank = r"[\x20\x09-\x0D]"
    pieces = F.split("text", rf"(?<={blank})(?={blank.replace('[', '[^')})")  # a word and the blanks after it, behind leading blanks
    first_words = F.array_join(F.slice(pieces, F.lit(1), (F.col("words") + F.col("text").rlike(rf"\A{blank}").cast("int")).cast("int")), "")
    whole = rows.withColumn("text", F.when(F.col("words") < F.col("size"), first_words).otherwise(F.col("text")))
    return whole.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key", "doc_id", "words")
