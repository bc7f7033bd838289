"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkgrade.llm.common import read, stored
from inkgrade.llm.mixing import mix_documents
from inkgrade.llm.ngram_join import near_duplicates
from inkgrade.llm.packing import pack, tokenized
from inkgrade.llm.pii import mask_pii
from inkgrade.llm.quality import quality_verdicts
from inkgrade.operators.lineage import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep.

    Null, empty and short texts go; repeated rows are judged one by one and stay together; very long texts are judged
    whole. All columns stay as they are, also those named like a verdict.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    judged = quality_verdicts(whole, read(spark, sf_dir, "labels"), keep=("__row",))
    return judged.where("kept").select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near duplication, the one of least id; a document without id stays.

    Rows that repeat an id are one document: of those with equal texts the least row stays, all with other texts stay
    along with it. Null and empty texts have no duplicates and stay.
    """
    gone = stored(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = stored(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"))
    rows = F.min(F.struct(*docs.columns)).alias("__row")
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(rows).select("__row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, repeated rows stay."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; null and empty texts count no words and are taken at their source's rate."""
    return mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences; null texts are empty, rows that repeat are
    packed one by one."""
    pieces = tokenized(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", one_of_each_group), ("personal data", personal_data),
    ("source mix", source_mix), ("packing", packed_sequences),
]

#: Trees, votes and genetic packing have no SQL twin; tests hold the operators, and the stages on edge rows, against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{at}")
            docs = spark.read.parquet(f"{folder}/{at}")
    return docs
