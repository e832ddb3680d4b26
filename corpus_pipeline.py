"""Corpus preparation in five stages: toxicity, quality, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller may write and read again; all but the last
return the columns of the documents. Models are fitted on the labelled documents among those that the stage gets. An empty
table passes through; the operators' docstrings say what nulls, empty texts and repeated rows do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import bpe, mixing, neardup, quality, toxicity
from loomery.llm._common import materialize, table

#: Token totals per domain (clean, junk, toxic) against those that the stage gets: clean text is raised.
MIX_FACTORS = [1.1, 1.0, 1.0]
#: No document's rate falls under this, so that nothing is thinned out.
LEAST_RATE = 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.learn_labels(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model gives the best grade with probability 0.5 or more."""
    return quality.keep_quality(docs, quality.learn_ratings(docs, quality.graded(table(spark, sf_dir, "labels")), "grade"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.drop_near_duplicates(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates that bring the domains' token totals to MIX_FACTORS times the present ones, once at least."""
    return mixing.mix(docs, mixing.domain_of(table(spark, sf_dir, "labels")), MIX_FACTORS, LEAST_RATE)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and their decoding, as digests."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("byte_bpe", encode_tokens),
]

#: Fitted models and hashing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
