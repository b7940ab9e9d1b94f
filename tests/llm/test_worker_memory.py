"""What a Python worker keeps between tasks goes when another operator's task begins."""

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from speechframe.llm import common, minhash, packing, rules

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def held() -> int:
    return packing.word_encoder.cache_info().currsize


def task_of(module: str):
    def task(batches):
        yield from batches

    task.__module__ = module
    return common.tidy(task)


def test_another_operators_task_drops_the_encoder():
    packing.word_encoder(TOKENIZER).encode("some words")
    assert list(task_of("speechframe.llm.packing")(iter([1]))) == [1] and held()
    assert list(task_of("speechframe.llm.minhash")(iter([1]))) == [1] and not held()


@pytest.mark.parametrize("stage", ["sketches", "rules"])
def test_workers_of_a_later_stage_hold_no_encoder(spark, stage):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a few words of a text").alias("text"))
    docs = docs.repartition(1)
    packing.cut_pieces(docs, TOKENIZER, ids=False).collect()
    if stage == "sketches":
        minhash.sketch_documents(docs, width=4).collect()
    else:
        rules.apply_rules(docs).collect()

    def encoders(batches):
        for batch in batches:
            yield pd.DataFrame({"held": [packing.word_encoder.cache_info().currsize] * len(batch)})

    found = docs.mapInPandas(encoders, "held int").collect()
    assert {r.held for r in found} <= {0}


def test_words_go_with_their_task(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text")).repartition(1)
    packing.cut_pieces(docs, TOKENIZER, ids=False).collect()

    def words(batches):
        for batch in batches:
            own = packing.word_encoder(TOKENIZER)
            yield pd.DataFrame({"held": [len(own.new) + len(own.old)] * len(batch)})

    assert {r.held for r in docs.mapInPandas(words, "held int").collect()} == {0}
