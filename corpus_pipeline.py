"""The corpus pipeline: bad documents and copies go, sources are mixed to their weights, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet and read again as the docs of the next. All but the last return the
columns of documents. The mix repeats documents where a source's target is
larger than the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foilframe.llm import bpe, exact_dedup, mixing, ngram_join
from foilframe.llm import quality as classifier
from foilframe.llm.staging import documents, new_path, removed, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays."""
    return ngram_join.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens and the digests of the ids and of what they decode to."""
    return bpe.round_trip_digests(docs, keep=("doc_id", "source", "lang"), with_ids=True)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("token_ids", token_ids)]

#: A trained classifier, a 64-bit hash and byte-pair merges decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage writes on its way is removed once its result is written, and a result once the next one is."""
    docs, written = documents(spark, sf_dir), None
    for name, stage_of in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            made = stage_of(spark, docs, sf_dir)
            made.write.parquet(path)
        if written:
            removed(spark, written)
        docs, written = spark.read.schema(made.schema).parquet(path), path
    return docs
