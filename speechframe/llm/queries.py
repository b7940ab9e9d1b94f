"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.llm import (
    chat,
    gridorder,
    htmltext,
    langid,
    merkle,
    minhash,
    naming,
    oracles,
    packing,
    quality,
    resample,
    rules,
    sentencepieces,
    sharding,
)

SHARDS = 24
SHARD_SEED = 2024
CAPACITY = 2048
BUCKETS = 10_000
DRAW_SEED = 2024
END_ID = 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``: counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    sized = load(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(sized, SHARDS, order=["doc_id"], seed=SHARD_SEED)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of at most 2048 ids. The sequences are assembled, and
    ``in_place`` tells whether each piece is found at its place there."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = load(spark, sf_dir, "documents")
    pieces = packing.cut_pieces(
        docs, tokenizer, capacity=CAPACITY, end_id=END_ID, ids=False, packed=True
    )
    return packing.assemble(pieces, capacity=CAPACITY, ids=False)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.encode(load(spark, sf_dir, "documents"), model)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learn = F.coalesce(remainder != 0, F.lit(False))
    found = langid.identify(docs, langid.dictionaries(docs, learn))
    held_out = F.coalesce(remainder == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "narrow")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = [
        spark.range(1).select(
            F.lit(-1).cast("bigint").alias("conv_id"),
            F.lit(turn).cast("bigint").alias("turn"),
            F.lit(role).alias("role"),
            F.lit(said).alias("text"),
        )
        for turn, role in enumerate(("user", "assistant"))
    ]
    rows = turns.union(own[0]).union(own[1])
    return chat.read_back(chat.format_turns(rows, tokenizer), tokenizer)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; their source is the host, its language section the path."""
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents by shingles of four words."""
    found = minhash.near_duplicates(load(spark, sf_dir, "documents"), width=4, similarity=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors."""
    return gridorder.near_duplicates(load(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = load(spark, sf_dir, "pages")
    return htmltext.main_text(pages).select("page_id", "url", "text", "n_chars")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and verdict of all documents."""
    return rules.apply_rules(load(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn by importance for the benchmark's texts."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    target = load(spark, sf_dir, "benchmark").select("text")
    gains = resample.bucket_gains(
        resample.bucket_counts(docs, buckets=BUCKETS),
        resample.bucket_counts(target, buckets=BUCKETS),
        buckets=BUCKETS,
    )
    weighed = resample.weigh(docs, gains, buckets=BUCKETS)
    drawn = resample.draw(weighed, seed=DRAW_SEED, percent=10, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents equal but for the case of A-Z."""
    return naming.exact_duplicates(load(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by source, and each document checked against it after half of them lost
    their line ends."""
    docs = load(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = docs.withColumn("leaf_now", merkle.leaf([*columns[:-1], now]))
    entries = merkle.manifest(
        found, columns, group="source", order="doc_id", arity=3, carry=["leaf_now"]
    )
    folded = merkle.fold(F.col("leaf_now"), F.col("path"))
    return entries.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_packing,
        op3_sentencepiece,
        op4_language,
        op5_chat,
        op6_quality,
        op7_minhash,
        op8_embeddings,
        op9_html,
        op10_rules,
        op11_resample,
        op12_naming,
        op13_merkle,
        pipeline,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = oracles.ORACLES
