"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources receive integer numbers of blocks by the highest quotients votes / (2j + 1),
each source's blocks are apportioned in the same way to its shards, and every shard then
fills its quota from its documents in a seeded order.  DataFrame functions only.

Rows of equal doc_id, source and text are copies; up to ``COPIES`` of them are dealt as one item, whose
words its copies share as evenly as whole words allow.  Shards and order are drawn from doc_id
and text, so many rows of one doc_id, or without one, spread over all shards.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of
its own and comes last; copies count as separate documents; ties of quotients go to the
smaller source rank or shard number, ties of the seeded order to the smaller doc_id, size,
text digest and item; an empty table gives an empty mix; other columns than doc_id, text and source
are ignored by ``mix_sources`` and kept by ``mixed_documents`` (of copies: those of one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skewline.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 4
SHARD_DOCS = 4096
COPIES = 64
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source of (source, docs, size): its rank, weight and target words.

    Sources whose cap ``max_repeat * size`` is below their share are filled first: in
    order of cap / weight, source k is capped while its cap is at most its share of what
    the capped sources before it leave.  The table has one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("weight", weight)
              .withColumn("cap", (F.col("size") * max_repeat).cast("double")))
    every = W.partitionBy(F.lit(0))
    before = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(
        W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = (F.sum(F.col("size").cast("double")).over(every)
            - F.coalesce(F.sum("cap").over(before), zero))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    level = ranked.withColumn("level", left / weight_left)
    capped = level.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # The first uncapped source fixes the level of all uncapped ones.
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"),
                                                    F.col("level")))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", final * F.col("weight")))
    return capped.withColumn("target", target).select("source", "rank", "docs", "size", "target")


def sainte_lague(cells: DataFrame, group: list[str], cell: str) -> DataFrame:
    """Apportion ``seats`` (equal within a group) to cells by their ``votes``.

    Rounding votes at the ideal divisor gives each cell its seats up to a few; with S
    cells the true divisor differs from the ideal one by at most S / 2 seats in all, which
    bounds how far a cell's seats can move.  Only quotients within that distance are made
    and ranked, about two a cell.
    """
    g = W.partitionBy(*[F.col(c) for c in group]) if group else W.partitionBy(F.lit(0))
    total, n = F.sum("votes").over(g), F.count(F.lit(1)).over(g)
    share = F.when(F.col("_total") > 0, F.col("votes") * F.col("seats") / F.col("_total")).otherwise(F.lit(0.0))
    reach = F.when(F.col("seats") > 0, F.ceil(F.col("_share") * F.col("_n") / (2 * F.col("seats")))).otherwise(0) + 1
    c = (cells.withColumn("_total", total).withColumn("_n", n).withColumn("_share", share)
         .withColumn("_near", F.floor(F.col("_share") + 0.5).cast("long"))
         .withColumn("_reach", reach.cast("long"))
         .withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.col("_near") - F.col("_reach"))))
    c = c.withColumn("_open", F.col("seats") - F.sum("_sure").over(g))
    q = (c.withColumn("_j", F.explode(F.sequence(F.col("_sure"), F.col("_near") + F.col("_reach"))))
         .withColumn("_quotient", F.col("votes") / (2 * F.col("_j") + 1)))
    by_quotient = g.orderBy(F.col("_quotient").desc(), F.col(cell), F.col("_j"))
    q = q.withColumn("_won", (F.row_number().over(by_quotient) <= F.col("_open")) & (F.col("votes") > 0))
    return (q.groupBy(*group, cell)
            .agg((F.max("_sure") + F.sum(F.col("_won").cast("long"))).alias("quota")))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def takes(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
          block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """One row per item: doc_id, source, digest, size of one copy, copies, item, source_size, target
    and the words ``taken`` from all its copies."""
    copies = (docs.select("doc_id", F.col("source").cast("string").alias("source"), text_digest(F.col("text")).alias("digest"),
                          (word_count(F.col("text")) if size is None else size).alias("size"))
              .groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("rows")))
    items = (copies.withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / COPIES) - 1)))
             .withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("rows") - F.col("item") * COPIES)).drop("rows"))
    # Read by three branches below: the texts are counted once.
    items = Scratch(docs.sparkSession, "mix").store(items)
    words = F.col("size") * F.col("copies")
    sizes = items.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(words).alias("size"))
    targets = source_targets(sizes, weights, max_repeat)
    seats = F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words).cast("long")
    quotas = sainte_lague(targets.withColumn("votes", F.col("target")).withColumn("seats", seats), [], "rank")
    plan = (targets.join(quotas, "rank")
            .select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target",
                    F.col("quota").alias("source_quota"),
                    F.greatest(F.lit(1), F.ceil(F.col("docs") / shard_docs)).cast("long").alias("shards")))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", F.col("item").cast("string")))
    d = (items.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
         .withColumn("words", words).withColumn("draw", draw)
         .withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards")))
    cells = (d.groupBy("source", "shard")
             .agg(F.sum("words").alias("shard_size"), F.max("source_quota").alias("seats")))
    cells = cells.withColumn("votes", F.col("shard_size").cast("double"))
    shard_quota = sainte_lague(cells, ["source"], "shard")
    shard_plan = (cells.select("source", "shard", "shard_size")
                  .join(shard_quota.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "quota"),
                        F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
                  .select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size",
                          F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeat).alias("quota")))
    d = d.join(shard_plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    line = (W.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", "digest", "item")
            .rowsBetween(W.unboundedPreceding, -1))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("quota") - rounds * F.col("shard_size")
    start = F.coalesce(F.sum("words").over(line), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("words"), rest - F.col("_start")))
    return (d.withColumn("_start", start)
            .withColumn("taken", (rounds * F.col("words") + part).cast("long"))
            .select("doc_id", "source", "digest", "size", "copies", "item", "source_size", "target", "taken"))


def mix_sources(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
                block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``docs``."""
    items = takes(docs, size, weights, max_repeat, block_words, shard_docs, seed)
    copy = items.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    upto = lambda c: F.floor(F.col("taken") * c / F.col("copies"))
    return copy.select("doc_id", "source", "size", "source_size", "target",
                       (upto(F.col("_copy") + 1) - upto(F.col("_copy"))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as many times as the mix takes their
    words, to the nearest whole document: documents with less than half taken, and those without
    words, go.  Of a source with words taken, the document with the largest share stays at least."""
    def key(digest: Column) -> Column:
        return F.md5(F.concat_ws("|", digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                 F.col("source").isNull().cast("string"), F.col("source").cast("string")))

    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    whole = (takes(docs).withColumn("_key", key(F.col("digest"))).groupBy("_key", "source", "size").agg(F.sum("taken").alias("taken"))
             .withColumn("_share", share))
    whole = Scratch(docs.sparkSession, "mix").store(whole)
    first = (whole.groupBy("source").agg(F.max(F.struct("_share", "_key")).alias("first")).where("first._share > 0 and first._share < 0.5")
             .select(F.col("first._key").alias("_first")))
    times = F.when(F.col("_first").isNotNull(), 1).otherwise(F.floor(F.col("_share") + 0.5)).cast("int")
    mix = whole.join(first, F.col("_key") == F.col("_first"), "left").select("_key", times.alias("_times")).where("_times > 0")
    one = docs.withColumn("_key", key(text_digest(F.col("text")))).dropDuplicates(["_key"])
    return one.join(mix, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
