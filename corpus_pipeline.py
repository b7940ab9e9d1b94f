"""From documents to training sequences: four stages, each an operator of ``speechframe.llm``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from speechframe.llm import common, minhash, packing, quality, rules
from speechframe.session import configure


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those without text are rejected."""
    configure(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    configure(spark)
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, Jaccard
    similarity 0.8 or more."""
    configure(spark)
    return minhash.keep_one(docs, width=5, similarity=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences of at most 2048 ids. ``input_ids``,
    the sequence itself, is on the row of its first piece (offset 0), NULL on the others."""
    configure(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut_pieces(docs, tokenizer, capacity=2048, end_id=1, ids=False, packed=True)
    return packing.assemble(pieces, capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the compressor or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Each stage's rows are written as Parquet to the shared folder
    of ``spark.checkpoint.dir``, and the next one reads them from there."""
    configure(spark)
    common.checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
    return docs
