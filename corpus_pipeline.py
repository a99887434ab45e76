"""Five operators one after the other over documents: each stage works on all that the one before kept.

Defined cases, of all stages: null and empty texts have no language and go in the first stage; texts of any length are
worked on whole; rows equal in every column are near copies, and those that share a kept doc_id stay together; rows
without a doc_id pass through, a group of near copies that all lack one keeps them all; of copies the smallest doc_id
stays; an empty table gives no rows; extra columns, whatever their names, come out of all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import chunks, langid, packing, pii, simhash
from pagemill.llm.common import stored
from pagemill.llm.queries import PII_KEY, tokenizer_path, with_length


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject; lang stays as it came."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)], "doc_id", "text")
    found = langid.identify(rows, langid.learn(docs.select("doc_id", "text", "lang")), own)
    return found.where("not rejected").select(*own).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows that share a doc_id stay or go together."""
    groups = simhash.near_duplicates(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["first"]), "left_semi")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that came before."""
    return with_length(chunks.dedup_substrings(docs).select(*docs.columns))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return with_length(pii.replace_pii(docs, PII_KEY).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in training sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("substring dedup", substrings), ("PII", private_data), ("best-fit packing", packed)]

#: Language models, components and byte-pair merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
