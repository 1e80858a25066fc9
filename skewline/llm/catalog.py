"""Registered queries of the corpus operators: each applies one operator, with its
production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.llm import fim, imatch, langid, mixing, neardup_embeddings, ngramjoin, packing, pii, pseudolm, quality, suffixdedup, urls, whitening
from skewline.llm.common import table
from skewline.llm.oracles import ORACLES as LLM_ORACLES  # noqa: F401
from skewline.session import apply_engine_conf

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_engine_conf(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    LLM_QUERIES[fn.__name__] = run
    return run


@query
def op1_imatch_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_int8_neardup(spark, sf_dir):
    """Links and components of all embeddings."""
    return neardup_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_crf_language(spark, sf_dir):
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op4_url_boosted_trees(spark, sf_dir):
    """Verdict of every page's URL by rule, else by boosted trees."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op5_weak_supervision_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op6_pseudo_likelihood(spark, sf_dir):
    """Masked pseudo-likelihood of every document."""
    return pseudolm.score(table(spark, sf_dir, "documents"))


@query
def op7_harmonic_packing(spark, sf_dir):
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_chosen_path_join(spark, sf_dir):
    """Class and number of links of every document at shingle Jaccard similarity 0.8 or more."""
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_boosted_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_sainte_lague_mix(spark, sf_dir):
    """Words that the mix takes from each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


@query
def op11_suffix_array_dedup(spark, sf_dir):
    """What stays of every document without its repeated passages."""
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_repeated_capture_fim(spark, sf_dir):
    """Fill-in-middle form of every document, as digests of its output and of the text restored from it."""
    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op13_polarisation_whitening(spark, sf_dir):
    """Whitened embeddings: 32 components of every usable vector."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", whitening.as_long(F.col("deviation"))).drop("dim")
