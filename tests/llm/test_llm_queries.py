"""The registered queries of speechframe.llm on the smallest tables, against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_components, brute_kept, brute_rules

import corpus_pipeline
from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    def read(name):
        return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()

    return read


@pytest.fixture(scope="module")
def result(spark):
    def run(name):
        return queries()[name](spark, SMALL).collect()

    return run


def test_sharding(table, result):
    from speechframe.llm.queries import SHARD_SEED
    from speechframe.llm.sharding import locate

    docs = sorted(table("documents"), key=lambda r: r["doc_id"])
    found = {r["doc_id"]: r for r in result("op1_sharding")}
    assert len(found) == len(docs)
    for number, d in enumerate(docs):
        data = d["text"].encode()
        r = found[d["doc_id"]]
        wanted = (len(data) + 8, zlib.crc32(data), "rows", *locate(number, len(docs), 24, SHARD_SEED), None)
        assert tuple(r)[1:7] == wanted


def test_packing(table, result):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {}
    for d in table("documents"):
        ids = plain.encode(d["text"], add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = np.asarray(ids[s : s + 2048], "<u4")
            wanted[d["doc_id"], s] = (len(part), zlib.crc32(part.tobytes()), len(ids))
    found = result("op2_packing")
    assert wanted == {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found}
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * sum(n for n, _, _ in wanted.values())


def test_sentencepiece(table, result):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in result("op3_sentencepiece")}
    for d in table("documents"):
        assert found[d["doc_id"]]["ids"] == library.encode(d["text"]) and found[d["doc_id"]]["round_trip"]


def test_language(table, result):
    found = {r["doc_id"]: r for r in result("op4_language")}
    held = [d for d in table("documents") if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == {d["doc_id"] for d in held}
    assert sum(found[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.93 * len(held)


def test_chat(table, result):
    turns = collections.defaultdict(list)
    for r in table("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    found = result("op5_chat")
    assert len(found) == len(turns)
    for r in found:
        own = sorted(turns[r["conv_id"]])
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_quality(table, result):
    found = {r["doc_id"]: r["kept"] for r in result("op6_quality")}
    assert len(found) == len(table("documents"))
    right = [found[r["doc_id"]] == (r["quality"] == 1) for r in table("labels") if r["doc_id"] in found]
    assert sum(right) >= 0.97 * len(right)


def test_minhash(table, result):
    wanted = brute_components([(d["doc_id"], d["text"]) for d in table("documents")], 4)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in result("op7_minhash"))
    assert found == sorted((i, n, c) for i, n, c in wanted)


def test_pages(table, result):
    import html
    import re

    found = {r["page_id"]: r for r in result("op9_html")}
    for page in table("pages"):
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        parts = [html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", article)]
        text = "\n".join(" ".join(x.split()) for x in parts if x.strip())
        assert (found[page["page_id"]]["text"], found[page["page_id"]]["n_chars"]) == (text, len(text))


def test_rules(table, result):
    found = {r["doc_id"]: r for r in result("op10_rules")}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for d in table("documents"):
        assert tuple(found[d["doc_id"]][n] for n in names) == brute_rules(d["text"])
        assert found[d["doc_id"]]["kept"] == brute_kept(d["text"])
    good = {r["doc_id"] for r in table("labels") if r["quality"] == 1}
    assert all(found[i]["kept"] for i in good if not found[i]["base_failed"])


def test_pipeline(spark, table, result):
    """The stages by brute force: what classifier and rules keep, one of each group, packed."""
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    good = {r["doc_id"] for r in result("op6_quality") if r["kept"]}
    passed = {r["doc_id"] for r in result("op10_rules") if r["kept"]}
    rest = [(i, docs[i]) for i in sorted(good & passed)]
    wanted = {c for _, _, c in brute_components(rest, 5)}
    assert {r["doc_id"] for r in result("pipeline")} == wanted
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "packing"]


def test_pipeline_gives_training_sequences(table, result):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {d["doc_id"]: plain.encode(d["text"], add_special_tokens=False).ids + [1] for d in table("documents")}
    rows = result("pipeline")
    whole = {r["sequence_id"]: r["input_ids"] for r in rows if r["input_ids"] is not None}
    assert rows and set(whole) == {r["sequence_id"] for r in rows}
    for r in rows:
        ids = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert ids == docs[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["in_place"]
    assert all(r["in_place"] for r in result("op2_packing"))


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


def test_embeddings(spark, tmp_path):
    """The registered query over a table with planted links, chains of them, copies and odd vectors, against its
    SQL: the given table has no pair."""
    from oracle_check import connect, rows

    from __spark_entry__ import oracle_sql

    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(20):
        at = rng.normal(size=64)
        for _ in range(6):  # a chain: neighbours are near, its ends are not
            vectors.append(at.tolist())
            at = at + rng.normal(size=64) * 0.42
    vectors += [vectors[0], [3 * x for x in vectors[7]], [0.0] * 64, None, [float("nan")] * 64]
    table = [(i * 3, v, i % 5) for i, v in enumerate(vectors)]
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    column = next(f.name for f in given.schema if f.name.startswith("emb"))
    made = spark.createDataFrame(table, f"vec_id long, {column} array<double>, label int")
    made.withColumn(column, made[column].cast(given.schema[column].dataType)).coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    con = connect(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = queries()["op8_embeddings"](spark, str(tmp_path))
    cursor = con.execute(oracle_sql()["op8_embeddings"])
    wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == wanted
    linked = [r for r in found.collect() if r["n_links"]]
    assert len(linked) > 60 and len({r["component_id"] for r in linked}) > 10
