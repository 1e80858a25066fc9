"""I-Match document fingerprints with randomised lexicon subsets; DataFrame functions only.

The lexicon keeps terms whose document frequency lies in a band.  Terms are known by a
64-bit hash; document frequencies are counted over all distinct texts in ``BUCKETS`` hash buckets,
so copies push no term out of the band, and the lexicon is a table of fixed size (512 KB)
whatever the corpus: a bucket's level is 0 inside the band, else 1 and the octaves between it and the
band, 7 at most.  A document keeps its terms of level 0, and where these are less than one in
``FEW`` (a large group of near copies puts its own terms above the band, a small language's
lie below it) the terms nearest to the band up to that share, ties by hash; so one term more
or less never exchanges the kept ones.  Kept terms are made distinct and sorted.  The hash of
all of them is the classic signature; beside it, the lexicon is split at random into subsets of falling density (scale s holds
2^-(s+1) of it, in ``PARTS`` parts), and each subset that keeps 1 to ``SPARSE`` of the document's
terms adds a hash of its own.  For a document of any length some scales are sparse enough
to survive edits, so the share of equal subset hashes tells how alike two texts are.

Likeness: 1 for equal signatures, else equal subset hashes over subsets present in either.

Defined results: a null text is empty; a text without a term has no subsets, so it is like its
equals only; a null doc_id comes last in the order;
equal doc_ids are ordered by text; the one document of a table is its own successor; where
every doc_id is null the next text is empty; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
# The band: a term is kept if its share of the documents lies between these.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2
FEW = 4
SCALES, PARTS = 12, 8
SPARSE = 4
FAR = 7
# Order ranges hold about RANGE_DOCS documents.
RANGE_DOCS = 4096

_LOW56 = (1 << 56) - 1
_LOW60 = (1 << 60) - 1


def term_hashes(text: Column) -> Column:
    """Sorted distinct hashes of the lower-case words of a text."""
    terms = F.array_remove(F.split(F.lower(text), r"[\x09-\x0D\x20]+"), "")
    return F.sort_array(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t))))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Column:
    """FAR less the level of every bucket (0 for unseen ones) in four bits each: a constant array
    of BUCKETS / 16 longs."""
    text = [F.xxhash64("text").alias("hash"), F.length("text").alias("chars")]
    n = docs.select(*text).distinct().count()
    mask = F.lit(BUCKETS - 1).cast("long")
    buckets = F.array_distinct(F.transform(term_hashes(F.col("text")), lambda h: h.bitwiseAND(mask).cast("int")))
    distinct = docs.where("text is not null").select(*text, buckets.alias("b")).groupBy("hash", "chars").agg(F.first("b").alias("b"))
    low, high = least * n, max(1.0, most * n)
    df = F.col("df")
    octaves = F.floor(F.log2(F.when(df < low, F.lit(low) / df).otherwise(df / high))).cast("long")
    level = F.when((df >= low) & (df <= high), F.lit(0).cast("long")).otherwise(F.least(F.lit(FAR).cast("long"), octaves + 1))
    rows = (distinct.select(F.explode("b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df"))
            .select(F.shiftright("b", 4).alias("word"), F.col("b").bitwiseAND(15).alias("at"), (FAR - level).alias("near"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(near, cast(4 * at as int))")).alias("levels")))
    words = ["0"] * (BUCKETS // 16)
    for r in rows.collect():  # at most BUCKETS / 16 rows
        words[r.word] = str(r.levels)
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>")


def fingerprint(hashes: Column, levels: Column) -> Column:
    """struct(signature, subsets) of an array of distinct term hashes."""
    mask = F.lit(BUCKETS - 1).cast("long")
    low, low60 = F.lit(_LOW56).cast("long"), F.lit(_LOW60).cast("long")

    def ranked(h: Column) -> Column:
        """Level above the hash's low 60 bits."""
        b = h.bitwiseAND(mask)
        word = F.get(levels, F.shiftright(b, 4).cast("int"))
        near = F.call_function("shiftright", word, (b.bitwiseAND(F.lit(15).cast("long")) * 4).cast("int")).bitwiseAND(F.lit(15).cast("long"))
        return F.shiftleft(F.lit(FAR).cast("long") - near, 60).bitwiseOR(h.bitwiseAND(low60))

    def placed(h: Column) -> Column:
        x = F.shiftrightunsigned(h, BUCKET_BITS + 3)
        scale = F.least(F.bit_count(x.bitwiseAND(-x) - 1), F.lit(SCALES - 1))
        part = F.shiftright(h, BUCKET_BITS).bitwiseAND(F.lit(PARTS - 1).cast("long"))
        return F.shiftleft(scale.cast("long") * PARTS + part, 56).bitwiseOR(h.bitwiseAND(low))

    def closed(state: Column) -> Column:
        entry = F.shiftleft(state["subset"], 56).bitwiseOR(state["hash"].bitwiseAND(low))
        return F.when(state["n"].between(1, SPARSE), F.concat(state["out"], F.array(entry))).otherwise(state["out"])

    def step(state: Column, x: Column) -> Column:
        subset = F.shiftright(x, 56)
        same = state["subset"] == subset
        return F.struct(subset.alias("subset"), F.when(same, state["n"] + 1).otherwise(F.lit(1)).alias("n"),
                        F.when(same, F.xxhash64(state["hash"], x)).otherwise(F.xxhash64(x)).alias("hash"),
                        F.when(same, state["out"]).otherwise(closed(state)).alias("out"))

    start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"),
                     F.expr("cast(array() as array<bigint>)").alias("out"))

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """f(value), with the value worked out once."""
        return F.get(F.transform(F.array(value), f), 0)

    def kept(terms: Column) -> Column:
        """``terms`` are ranked and sorted."""
        inside = F.size(F.filter(terms, lambda h: h <= low60))
        nearest = F.slice(terms, 1, F.greatest(inside, F.ceil(F.size(terms) / FEW).cast("int")))
        return F.sort_array(F.transform(nearest, lambda h: h.bitwiseAND(low60)))

    def made(terms: Column) -> Column:
        return F.struct(F.xxhash64(terms).alias("signature"),
                        F.aggregate(F.sort_array(F.transform(terms, placed)), start, step, closed).alias("subsets"))

    return bound(bound(F.sort_array(F.transform(hashes, ranked)), kept), made)


def written(print_: Column) -> Column:
    """The fingerprint as text: the signature, then the subset hashes."""
    entries = F.concat(F.array(print_["signature"]), print_["subsets"])
    return F.array_join(F.transform(entries, lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    def names(p: Column) -> Column:
        return F.transform(p["subsets"], lambda x: F.shiftright(x, 56))

    either = F.size(F.array_union(names(a), names(b)))
    shared = F.size(F.array_intersect(a["subsets"], b["subsets"]))
    return (F.when(a["signature"] == b["signature"], 1.0).when(either == 0, 0.0).otherwise(shared / either))


def with_next(docs: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """Every row with ``next_<column>`` of the next row by descending doc_id (after the
    last: the first).

    Ranges of doc_id end at approximate quantiles, which are ids of the table; the
    document that heads a range also goes, as a mark, to the end of the range above it.
    One shuffle; a range is a window of about ``RANGE_DOCS`` rows.  Quantiles are taken twice, of all
    ids and inside each coarse range, so a row is compared with about sqrt(ranges) ends.
    """
    n = docs.count()
    parts = max(1, math.ceil(math.sqrt(n / RANGE_DOCS)))
    fractions, accuracy = [(i + 1) / parts for i in range(parts)], 1000 * parts
    got = docs.agg(F.percentile_approx("doc_id", fractions, accuracy).alias("q"), F.max("doc_id").alias("top")).first()
    coarse = sorted({*got.q, got.top}) if got.top is not None else []

    def below(ends: Column) -> Column:
        return F.size(F.filter(ends, lambda e: e < F.col("doc_id")))

    number = below(F.array(*[F.lit(e).cast("long") for e in coarse[:-1]]).cast("array<bigint>"))
    fine = {r.number: sorted({*r.q, coarse[r.number]}) for r in docs.where("doc_id is not null").groupBy(number.alias("number"))
            .agg(F.percentile_approx("doc_id", fractions, accuracy).alias("q")).collect()} if coarse else {}
    ends = F.from_json(F.lit(json.dumps([fine[i] for i in range(len(coarse))])), "array<array<bigint>>")
    first = [0, *itertools.accumulate(len(fine[i]) for i in range(len(coarse)))]
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(below(F.get(ends, number))) if coarse else F.lit(0)
    start = F.get(F.array(*[F.lit(k) for k in first]), number)
    placed = docs.withColumn("_number", number).withColumn("_place", place)
    heads = F.coalesce(F.get(F.get(ends, F.col("_number")), F.col("_place")) == F.col("doc_id"), F.lit(False)) if coarse else F.lit(False)
    range_ = (start + F.col("_place")).cast("int")
    own = F.struct(range_.alias("range"), F.lit(0).alias("mark"))
    above = F.struct(F.pmod(range_ + 1, F.lit(max(1, first[-1]))).cast("int").alias("range"), F.lit(1).alias("mark"))
    placed = placed.withColumn("at", F.explode(F.when(heads, F.array(own, above)).otherwise(F.array(own)))).drop("_number", "_place")
    line = W.partitionBy("at.range").orderBy("at.mark", F.col("doc_id").desc_nulls_last(), tie)
    return (placed.withColumns({f"next_{c}": F.lead(c).over(line) for c in columns})
            .where("at.mark = 0").drop("at"))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with their likenesses."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    levels = lexicon(docs, least, most)
    marked = docs.withColumn("print", fingerprint(term_hashes(F.col("text")), levels))
    rows = with_next(marked, ["text", "print"], "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = (rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
            .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print",
                    fingerprint(term_hashes(F.col("edited")), levels).alias("edited_print")))
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("print")).alias("fingerprint"),
                       written(F.col("edited_print")).alias("edited_fingerprint"),
                       likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                       F.when(F.col("next_print").isNull(), 0.0).otherwise(likeness(F.col("print"), F.col("next_print"))).alias("near_next"))
