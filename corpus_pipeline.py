"""A corpus pipeline of the llm operators: each stage reads what the one before kept, written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import mixing, near, packing, ranking, repetition
from tabprep.llm.common import materialize, table
from tabprep.llm.queries import LANGUAGES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking lets pass; learned from all labels. Repeated rows are judged alike."""
    return ranking.fit(docs, table(spark, sf_dir, "labels")).score(docs, only_passing=True)


def repetition_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too much repetition inside. Null and empty texts have too few words and go."""
    prefix = "_rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    measured = repetition.apply_rules(docs, prefix=prefix)
    return measured.filter(f"{prefix}kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (words in fives), the one of the smallest id.

    Rows without id stay, of a repeated id one row stays; texts without words are linked with nothing.
    """
    kept = materialize(near.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")))
    chosen = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id"])
    return chosen.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, for the target shares of the languages. Each row has its own rate."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    return mixing.mix(docs, labelled, LANGUAGES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in windows of 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality), ("quality_rules", repetition_rules), ("near_dedup", one_of_each),
    ("mixing", mix_languages), ("packing", pack),
]
#: Suffix arrays, signatures, learned models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
