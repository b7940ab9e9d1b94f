"""The operators of speechframe.llm on small tables: brute force, and rows that are odd."""

import collections
import hashlib
import random
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from speechframe.llm import (
    chat,
    common,
    gridorder,
    htmltext,
    langid,
    minhash,
    packing,
    quality,
    rules,
    sentencepieces,
    sharding,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n string"


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns, and extra ones whose names operators use too."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", None) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (4, "a"), (4, "a"), (5, "long " * 30_000)]


# --- sharding --------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 100, 257])
def test_permutation_covers_every_place_once(rows):
    places = [sharding.locate(i, rows, 5, seed=3) for i in range(rows)]
    sizes = collections.Counter(s for s, _ in places)
    assert len(set(places)) == rows and max(sizes.values()) - min(sizes.values()) <= (rows > 5) or rows < 5
    assert all(slot < sizes[shard] for shard, slot in places)


def test_shards_follow_the_plain_form_whatever_the_layout(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, size long")
    one = sharding.shard_rows(table, 24, order=["doc_id"], seed=9)
    two = sharding.shard_rows(table.repartition(7, "size"), 24, order=["doc_id"], seed=9)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    for r in one.collect():
        assert r["row_number"] == r["doc_id"]
        assert (r["shard"], r["slot"]) == sharding.locate(r["row_number"], 1000, 24, seed=9)


@pytest.mark.parametrize("rows, seed", [(3, 2024), (21, 2024), (5, 0), (703, 0), (100, 7), (257, 3)])
def test_walks_end_where_cycles_lie_outside(spark, rows, seed):
    steps = sharding.walk_length(spark, rows, seed)
    number = sharding.permute(F.col("id"), rows, seed, steps)
    placed = sorted(tuple(r) for r in spark.range(rows).select("id", number.alias("p")).collect())
    assert placed == [(i, sharding.locate(i, rows, 1, seed)[1]) for i in range(rows)]


def test_shards_of_odd_rows(spark):
    table = spark.createDataFrame([(None, 1)] * 40 + [(1, None)] * 3 + [(2, 2)], "doc_id long, size long")
    found = sharding.shard_rows(table, 4, order=["doc_id"]).collect()
    assert sorted(r["row_number"] for r in found) == list(range(44))
    assert collections.Counter(r["shard"] for r in found) == dict.fromkeys(range(4), 11)
    assert sharding.shard_rows(table.limit(0), 4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(table.withColumn("slot", F.lit(1)), 4)


# --- packing ---------------------------------------------------------------------------------


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    random.seed(5)
    pieces = ["The", "it's", "'s", " ", "\n", "\t", "\x1c", "　", "É", "é", "日本", "12", "!?", "_", "İ", "Σ",
              "<|endoftext|>", "<|", " ", "👍🏽", "''s", "word" * 20]
    for _ in range(600):
        text = "".join(random.choices(pieces, k=random.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_patterns_hold_every_piece_once():
    random.seed(2)
    counts = {n: random.randint(1, 50) for n in random.sample(range(1, 257), 90)}
    found = packing.pack_histogram(counts, 256)
    used = collections.Counter()
    for pattern, number in found:
        assert sum(length * copies for length, copies in pattern) <= 256
        for length, copies in pattern:
            used[length] += copies * number
    assert used == counts
    assert packing.pack_histogram({}, 8) == []
    with pytest.raises(ValueError):
        packing.pack_histogram({9: 1}, 8)


def test_packed_pieces_give_the_documents_back(spark):
    from tokenizers import Tokenizer

    random.seed(1)
    rows = ODD + [(i, " ".join(random.choices("alpha beta gamma délta".split(), k=i))) for i in range(10, 120)]
    pieces = packing.cut_pieces(documents(spark, rows), WORDS, capacity=64)
    placed = packing.pack(pieces, capacity=64).cache()
    got = placed.collect()
    assert len(got) == pieces.count()
    plain = Tokenizer.from_file(WORDS)
    wanted = collections.Counter()
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            wanted[doc_id, s, zlib.crc32(np.asarray(part, "<u4").tobytes()), len(ids)] += 1
    assert wanted == collections.Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_sequence) == set(range(len(by_sequence)))
    sequences = {r["sequence_id"]: r for r in packing.sequences(placed, capacity=64).collect()}
    for number, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and sequences[number]["input_ids"][at : at + r["length"]] == r["ids"]
            at += r["length"]
        assert at == sequences[number]["n_tokens"] <= 64
        assert len(sequences[number]["input_ids"]) in (64, at)
    assert packing.pack(pieces.limit(0), capacity=64).collect() == []


def test_assembled_sequences_hold_every_piece(spark):
    random.seed(2)
    rows = ODD + [(i, " ".join(random.choices("alpha beta gamma délta".split(), k=i))) for i in range(10, 120)]
    rows += [((1 << 60) + 1, "long id")]
    pieces = packing.cut_pieces(documents(spark, rows), WORDS, capacity=64, packed=True)
    plain = collections.Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in pieces.collect())
    got = packing.assemble(pieces.drop("ids"), capacity=64, pad_id=7).collect()
    whole = {r["sequence_id"]: r["input_ids"] for r in got if r["input_ids"] is not None}
    assert all((r["offset"] == 0) == (r["input_ids"] is not None) and r["in_place"] for r in got)
    assert set(whole) == {r["sequence_id"] for r in got}
    parts = [(r, whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) for r in got]
    assert plain == collections.Counter((r["doc_id"], r["start"], tuple(ids)) for r, ids in parts)
    for r in got:
        ids, n = whole[r["sequence_id"]], r["n_tokens"]
        assert len(ids) == (n if n & (n - 1) == 0 else 64) and set(ids[n:]) <= {7}
        assert n == sum(x["length"] for x in got if x["sequence_id"] == r["sequence_id"])
    assert packing.assemble(pieces.drop("ids").limit(0), capacity=64).collect() == []


# --- pieces ----------------------------------------------------------------------------------


def test_pieces_equal_the_library_in_any_parts():
    model = sentencepieces.PieceModel(PIECES)
    own = sentencepieces.Encoder(model)
    random.seed(3)
    signs = "aeitnsr THE.,!'\n  日本é🙂\t0123▁<>|aaab"
    for _ in range(400):
        text = "".join(random.choices(signs, k=random.randint(0, 70)))
        wanted = model.processor.encode(text)
        assert own.encode(text).tolist() == wanted
        assert sentencepieces.decode_ids(model, wanted) == model.processor.decode(wanted)
        stream, plain = sentencepieces.StreamEncoder(model), model.normalize(text)
        parts = [i for at in range(0, len(plain), 9) for i in stream.feed(plain[at : at + 9])]
        assert parts + stream.finish() == wanted


def test_both_forms_of_the_search_give_equal_ids():
    import pyarrow.parquet as pq

    model = sentencepieces.PieceModel(PIECES)
    own = sentencepieces.Encoder(model)
    seen = set()
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        seen.update(own.split.findall(model.normalize(text or "")))
    for segment in seen:
        stream = sentencepieces.StreamEncoder(model)
        assert stream.feed(segment) + stream.finish() == own._window(segment), segment


def test_window_stays_small_without_spaces():
    model = sentencepieces.PieceModel(PIECES)
    random.seed(4)
    text = "".join(random.choices("aeitnsrhdlo", k=20_000))
    stream = sentencepieces.StreamEncoder(model)
    ids = stream.feed(text) + stream.finish()
    assert ["▁", *ids] and sentencepieces.decode_ids(model, ids) == text
    assert stream.widest < 40 * model.longest


def test_unigram_search_is_the_best_path():
    model = sentencepieces.PieceModel(PIECES, unigram=True)
    random.seed(6)
    for _ in range(60):
        text = "".join(random.choices("aeintr▁s", k=random.randint(1, 14)))
        best = {0: 0.0}
        for end in range(1, len(text) + 1):
            options = [
                best[start] + model.scores.get(text[start:end], model.lowest)
                for start in range(end)
                if text[start:end] in model.scores or end - start == 1
            ]
            best[end] = max(options)
        stream = sentencepieces.StreamEncoder(model)
        ids = stream.feed(text) + stream.finish()
        total = sum(model.scores.get(model.processor.id_to_piece(i), model.lowest) for i in ids)
        assert total == pytest.approx(best[len(text)])


def test_pieces_of_odd_rows(spark):
    rows = sentencepieces.encode(documents(spark, ODD), PIECES)
    found = {(r["doc_id"], r["n_ids"] > 0, r["round_trip"]) for r in rows.collect()}
    assert {(1, False, None), (2, False, True), (None, True, True), (4, True, True), (5, True, True)} <= found
    texts = collections.Counter((r["doc_id"], r["text"]) for r in sentencepieces.decode(rows, PIECES).collect())
    assert texts == collections.Counter(ODD)
    assert sentencepieces.encode(documents(spark, []), PIECES).collect() == []


# --- languages -------------------------------------------------------------------------------


def test_language_of_odd_rows(spark):
    random.seed(7)
    syllables = {"xx": ["ka", "mo", "ri", "tu"], "yy": ["schl", "ung", "eit", "ber"]}
    rows = []
    for i in range(200):
        lang = ("xx", "yy")[i % 2]
        words = ["".join(random.choices(syllables[lang], k=3)) for _ in range(40)]
        rows.append((i, " ".join(words), None if i % 10 == 0 else lang))
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 !?", None), (None, "kamori turika", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    learn = F.col("doc_id") < 100
    contents = langid.dictionaries(docs, learn)
    assert set(contents) == {"xx", "yy"}
    found = {r["doc_id"]: r for r in langid.identify(docs, contents).collect()}
    assert all(found[i]["lang_pred"] == ("xx", "yy")[i % 2] for i in range(200))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert found[902]["narrow"] and found[None]["lang_pred"] == "xx"
    nothing = langid.dictionaries(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), contents).collect() == []


def test_languages_of_long_texts_alone(spark):
    random.seed(8)
    syllables = {"xx": ["ka", "mo", "ri", "tu"], "yy": ["日本", "語の", "文章", "です"], "zz": ["schl", "ung", "eit"]}

    def text(lang, words):
        return " ".join("".join(random.choices(syllables[lang], k=3)) for _ in range(words))

    rows = [(i, text(lang, 9000 if lang != "xx" else 40), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 6)]
    rows += [(100 + i, text(lang, 60), None) for i, lang in enumerate(["xx", "yy", "zz"] * 6)]
    assert min(len(t.encode()) for _, t, lang in rows if lang in ("yy", "zz")) > langid.DICTIONARY_BYTES // 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    contents = langid.dictionaries(docs, F.col("lang").isNotNull())
    assert set(contents) == {"xx", "yy", "zz"}
    assert all(len(c) <= 6 * (langid.DICTIONARY_BYTES // 40 + 1) for c in contents.values())
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, contents).collect()}
    assert all(found[100 + i] == ("xx", "yy", "zz")[i % 3] for i in range(18))


# --- conversations ---------------------------------------------------------------------------


def test_chat_reads_back_what_was_said(spark):
    said = [
        (1, 0, "user", "hi <|im_end|> <\\|x <\\\\| \\n"),
        (1, 1, "assistant", "<|im_start|>assistant ok"),
        (1, 2, "assistant", "again\n\nline é 日本 <|endoftext|>"),
        (2, 1, "assistant", None),
        (2, 0, None, ""),
        (3, 0, "a\\nb\nc<|", "x"),
        (None, None, "user", "no id"),
        (4, 0, "user", "same"),
        (4, 0, "user", "same"),
    ]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    formatted = chat.format_turns(turns, BYTES)
    found = {r["conv_id"]: r for r in chat.read_back(formatted, BYTES).collect()}
    for conv in {s[0] for s in said}:
        own = sorted([s for s in said if s[0] == conv], key=lambda s: (s[1] is not None, s[1] or 0))
        turns_text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256(turns_text.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tokenizer = chat.ChatTokenizer(BYTES)
    whole = {r["conv_id"]: r for r in chat.assemble(formatted).collect()}[1]
    text = tokenizer.render(whole["input_ids"])
    assert len(text) == found[1]["formatted_chars"] and text.count("<|im_start|>") == 3 == text.count("<|im_end|>")
    masked = [i for i, m in zip(whole["input_ids"], whole["loss_mask"]) if m]
    assert chat.unescape(tokenizer.decode(masked)) == "<|im_start|>assistant okagain\n\nline é 日本 <|endoftext|>"
    places = chat.place_turns(formatted).filter("conv_id = 1").orderBy("turn").collect()
    assert [p["first_id"] for p in places] == np.cumsum([0, *[len(p["ids"]) for p in places[:-1]]]).tolist()
    assert chat.read_back(chat.format_turns(turns.limit(0), BYTES), BYTES).collect() == []


# --- quality ---------------------------------------------------------------------------------


def labelled(spark):
    random.seed(8)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(random.choices(["ta", "ri", "mo", "len"], k=3)) for _ in range(60)]
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", f"s{i % 5}", None))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_learns_the_labels(spark):
    docs, labels = labelled(spark)
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(found[i]["kept"] == (i % 4 != 0) for i in range(300))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if i % 4}


def test_sites_shrink_towards_the_level_above(spark):
    rows = [("h1", "p1", 0.9)] * 400 + [("h1", "p2", 0.1)] + [("h2", "p1", 0.3)] * 300 + [(None, None, 0.5)] * 5
    rates = quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"), ["host", "path"], 0.5)
    found = {(r["host"], r["path"]): r for r in rates.collect()}
    assert found["h1", "p1"]["rate"] == pytest.approx(0.9, abs=0.02)
    assert found["h2", "p1"]["rate"] == pytest.approx(0.3, abs=0.02)
    assert 0.1 < found["h1", "p2"]["rate"] < 0.95 and found["h1", "p2"]["host_rate"] > 0.85
    assert found[None, None]["n"] == 5


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = docs.unionByName(documents(spark, ODD).select(docs.columns)).withColumn("rate", F.lit("x"))
    odd = odd.withColumn("source", F.when(F.col("doc_id") != 4, F.col("source")))
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1), (1, None)], labels.schema))
    found = quality.classify(odd, odd_labels)
    assert found.count() == odd.count()
    # Ids 1 to 3 are of ordinary documents too.
    assert found.filter("not kept and p_good = 0").count() == 3
    assert quality.classify(odd, odd_labels.limit(0)).filter("kept").count() == odd.count() - 3
    assert quality.classify(odd.limit(0), odd_labels).collect() == []
    assert quality.keep_good(odd.limit(0), odd_labels.limit(0)).columns == odd.columns


# --- near duplicates of texts ----------------------------------------------------------------


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    n = len(words)
    return {tuple(words[i : i + width]) for i in range(max(1, n - width + 1))} if words else set()


def brute_components(rows, width):
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def corpus(seed, base_words):
    """Groups of near copies on both sides of the limit, chains of them, and shared passages."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = random.choices(vocabulary, k=60)
    rows = []
    for _ in range(12):
        base = random.choices(vocabulary, k=base_words)
        for edits in (0, 0, 1, 2, 3, 5, 8, 12):
            words = list(base)
            for _ in range(max(0, edits * base_words // 150)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
        for _ in range(3):  # a chain
            base = [random.choice(vocabulary) if random.random() < 0.02 else w for w in base]
            rows.append((len(rows), " ".join(base).upper()))
        rows.append((len(rows), " ".join(passage + random.choices(vocabulary, k=20))))
    return rows


@pytest.mark.parametrize(("seed", "base_words"), [(1, 30), (2, 70), (3, 400)])
def test_links_of_near_copies(spark, seed, base_words, monkeypatch):
    rows = corpus(seed, base_words) + [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (9002, "one two")]
    found = minhash.near_duplicates(documents(spark, rows), width=4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    wanted = sorted((i, n, i if c is None else c) for i, n, c in brute_components(rows, 4))
    assert got == wanted
    kept = {r["doc_id"] for r in found.filter("kept").collect()}
    assert kept == {c for _, _, c in wanted}


@pytest.mark.parametrize("block_set", [1024, 16])
def test_long_lists_are_compared_in_blocks(spark, monkeypatch, block_set):
    """Classes that the smallest of their lists doesn't link, in lists of several blocks, of sets of one level
    or of two."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SET", block_set)
    random.seed(11)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        cut, more = random.randrange(0, 16), random.choice((0, 0, 6))  # 37 shingles, or more and fewer than 32
        own = [f"x{i // 4}y{j}" for j in range(cut)]
        rows.append((i, " ".join(base[more : 40 - cut] + own)))
    found = minhash.near_duplicates(documents(spark, rows), width=4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == sorted(brute_components(rows, 4))


def test_one_of_each_group_stays(spark):
    rows = ODD + corpus(5, 40)
    docs = documents(spark, [(None if i is None else i + (1000 if at >= len(ODD) else 0), t) for at, (i, t) in enumerate(rows)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {c for _, n, c in brute_components(every, 5) if n and c is not None}
    assert sorted(i for i, t in texts if shingle_set(t, 5) and i is not None) == sorted(groups)
    assert collections.Counter(t for _, t in texts if not shingle_set(t, 5)) == {None: 1, "": 1, " \n\t": 1}
    assert (None, "no id here") in texts
    assert minhash.keep_one(docs.limit(0)).collect() == []


# --- near duplicates of vectors --------------------------------------------------------------


def test_links_of_vectors(spark):
    random.seed(9)
    rng = np.random.default_rng(9)
    rows = []
    for c in range(12):
        center = rng.normal(size=16)
        for _ in range(12):
            rows.append((len(rows), (center + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.6])).tolist()))
    rows += [(500 + i, rows[i][1]) for i in range(30)]  # copies
    rows += [(600, [2 * x for x in rows[0][1]]), (601, [1.0, 2.0]), (602, [2.0, 4.0]), (603, [1e200] * 16), (604, [1e-200] * 16)]
    bad = [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [None] + [1.0] * 15), (705, [float("inf")] * 16)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("kept", F.lit(0))
    found = {r["vec_id"]: r for r in gridorder.near_duplicates(table, block_rows=16).collect()}
    linked = collections.defaultdict(set)
    for i, x in rows:
        for j, y in rows:
            if i != j and len(x) == len(y):
                a, b = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    linked[i].add(j)
    for i, _ in rows + bad:
        group, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - group
            group |= new
            todo += new
        assert (found[i]["n_links"], found[i]["component_id"]) == (len(linked[i]), min(group)), i
        assert found[i]["kept"] == (i == min(group))
    assert gridorder.near_duplicates(table.limit(0)).collect() == []


# --- pages -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content-7"><article><header><h1>Title &amp; more</h1></header><p>First <b>bold
text<p>Second&nbsp;one, 1 < 2 &copy;</p><div class="ad">Buy</div><form><input value="x">Send</form><ul><li>item one<li>item two</ul>
<section class="comments"><p>Reader says a lot of things that are long, longer than all the rest of it.</p></section></article></div>
<aside>Side</aside><footer>Foot</footer>"""


def test_main_text(spark):
    wanted = "Title & more\nFirst bold text\nSecond one, 1 < 2 ©\nitem one\nitem two"
    odd = "<html><body><div><p>Only a page without article."
    rows = [(i, "http://a.org/x", PAGE.replace("content-7", f"content-{i}")) for i in range(5)]
    rows += [(6, "http://a.org/y", odd), (7, None, PAGE), (8, "http://b.org", None), (9, "", ""), (9, "", ""), (None, "nonsense", "<p>x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))
    found = htmltext.main_text(table).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in found}
    assert all(by_id[i] == wanted for i in (0, 1, 2, 3, 4, 7)), by_id[0]
    assert by_id[6] == "Only a page without article." and by_id[8] == "" == by_id[9] and by_id[None] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    paths = {r["host"]: (r["path"], r["votes"]) for r in htmltext.host_paths(table).collect()}
    assert paths["a.org"] == (">body>div.content-#>article", 5)
    assert htmltext.main_text(table.limit(0)).collect() == []


LONG = "A sentence of the article that says something, and some more of it after the comma. " * 6


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<article><p>One two.</p><section id='related-work'><h2>Related work</h2><p>Three.</p></section></article>", "One two.|Related work|Three."),
        ("<article><p>One two.</p><h2 id='comments'>Comments</h2><p>Three.</p></article>", "One two.|Comments|Three."),
        ("<article><div id='social-history'><p>Three.</p></div><p>Four</p></article>", "Three.|Four"),
        ("<article><p>One <span class='share-price'>12</span> two.</p><p class='share-price'>3</p></article>", "One 12 two.|3"),
        ("<article><p>One <a class='related' href='x'>two</a> three.</p></article>", "One two three."),
        ("<article class='post no-comments'><p>One two.</p></article>", "One two."),
        ("<div class='content with-sidebar'><article><p>One two.</p></article></div>", "One two."),
        ("<div class='sidebar'><article><p>One two.</p><div class='comments'>No no no no no no</div></article></div>", "One two."),
        (f"<div id='page' class='sidebar-right'><p>{LONG}</p><div class='sidebar'>Side</div></div>", LONG.strip()),
        (f"<article><p>One.</p></article><div class='comment-list'><p>{LONG}</p></div>", "One."),
        ("<article><p title='a hidden gem in town'>One <a title='hidden'>two</a>.</p></article>", "One two."),
        ("<article><p>One.</p><p hidden>Two.</p><p style='color:red; display: none'>3</p><p aria-hidden=true>4</p></article>", "One."),
        ("<article><p>One <b hidden>x<p>Two.</p></b></p></article>", "One|Two."),
    ],
)
def test_names_drop_no_article_text(page, wanted):
    assert htmltext.extract(f"<html><body>{page}</body></html>", None) == wanted.replace("|", "\n")


def test_whole_articles_around_the_voted_path(spark):
    text = LONG.strip()
    wrapped = f"<article><h1>Head</h1><p class=lead>Lead.</p><div class=entry-content><p>{LONG}</p><p>{LONG}</p></div></article>"
    divs = f"<div class=post><h1>Head</h1><div class=entry><p>{LONG}</p></div><div class=links><a href=x>{LONG * 2}</a></div></div>"
    two = f"<article><div class=part-a><p>{LONG}</p></div><div class=part-b><p>Rest.</p></div></article>"
    other = f"<div class=post><div class=teaser>Short.</div></div><div class=story><p>{LONG}</p><p>{LONG}</p></div>"
    teaser = "<div class=post><div class=teaser>The whole article of this page.</div></div>"
    pages = [(1, "a", wrapped), (2, "b", divs.replace("<div class=links>", "<div class=more>")), (3, "c", two)]
    pages += [(10, "d", other), *[(i, "d", teaser) for i in (11, 12)]]
    rows = [(i, f"http://{host}.org/{i}", f"<html><body>{body}</body></html>") for i, host, body in pages]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in htmltext.main_text(table).collect()}
    assert found[1] == f"Head\nLead.\n{text}\n{text}" and found[3] == f"{text}\nRest."
    assert found[10].endswith(f"{text}\n{text}") and found[11] == "The whole article of this page."
    lead = f"<div class=post><h1>Head</h1><p>Lead.</p><div class=entry><p>{LONG}</p></div></div>"
    assert htmltext.extract(lead, ">div.post>div.entry") == f"Head\nLead.\n{text}"
    assert htmltext.extract(divs, ">div.post>div.entry") == text


# --- rules -----------------------------------------------------------------------------------


def brute_rules(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(marked), failed


def brute_kept(text):
    """The verdict of the bands, with another client's compressor and plain loops."""
    import math

    data = (text or "").encode()
    counts = brute_rules(text)
    if counts[5]:
        return False

    def ratio(part):
        import zstandard

        return len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)

    def limit(n):
        points = [(math.log2(a), b) for a, b in rules.HIGH]
        x = math.log2(n)
        if x <= points[0][0]:
            return points[0][1]
        for (a, y), (b, z) in zip(points, points[1:]):
            if x <= b:
                return y + (z - y) * (x - a) / (b - a)
        return points[-1][1]

    least = next(low for size, low in rules.LOW if len(data) < size)
    if not least <= ratio(data) <= limit(len(text)):
        return False
    width = min(1024 if len(data) >= 4096 else 256, len(data))
    bad = 0
    for start in range(0, len(data), width):
        part = data[start : start + width]
        seen = part if len(part) == width else data[-width:]
        begun = sum(b & 0xC0 != 0x80 for b in seen)
        bad += len(part) * (not 0.15 <= ratio(seen) <= limit(begun))
    return bad <= 0.3 * len(data)


def test_rules(spark):
    random.seed(10)
    signs = ["a", "b", "é", "日", " ", " ", "\n", "\t", "\x1c", " ", "#", "|", "a b\n", "a b a b "]
    texts = [None, "", " \n"] + ["".join(random.choices(signs, k=random.randint(0, 400))) for _ in range(200)]
    prose = " ".join("".join(random.choices(["ta", "ri", "mo", "len", "su", "ka"], k=random.randint(1, 5))) for _ in range(3000))
    noise = " ".join("".join(random.choices(string.ascii_letters + string.digits + "+/", k=76)) for _ in range(200))
    drone = " ".join(f"{'abcdefgh' * 40} {i}" for i in range(200))
    texts += [prose, noise, drone]
    found = {r["doc_id"]: r for r in rules.apply_rules(documents(spark, list(enumerate(texts)))).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, text in enumerate(texts):
        assert tuple(found[i][n] for n in names) == brute_rules(text), text
        assert found[i]["kept"] == brute_kept(text)
    at = len(texts) - 3
    assert found[at]["kept"] and found[at]["reason"] is None
    assert found[at + 1]["reason"] == "incompressible" and found[at + 2]["reason"] == "repetitive"
    docs = documents(spark, [*ODD, (77, prose)])
    assert [r["doc_id"] for r in rules.keep_good(docs).collect()] == [77]
    assert rules.keep_good(docs).columns == docs.columns
    assert rules.apply_rules(docs.limit(0)).collect() == []


def test_rules_see_every_byte():
    import base64

    import zstandard

    compressor = zstandard.ZstdCompressor(level=3)
    random.seed(11)
    raw = base64.b64encode(random.randbytes(20_000)).decode()
    syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
    lexicon = ["".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(900)]
    clean = " ".join(random.choices(lexicon, k=3000))

    def junk(size, width=8):
        return " ".join(raw[i : i + width] for i in range(0, len(raw), width))[:size]

    for good, bad in ((4096, 4090), (1500, 2500), (1000, 1500), (0, 460), (0, 739), (0, 5000), (8192, 8000)):
        found = rules.judge(clean[:good] + junk(bad), compressor)
        assert not found[5] and not found[6] and found[10] in ("chunks", "incompressible"), (good, bad, found)
    for size in (600, 1000, 3000, 4096, 4097, 5000, 16_000):
        assert rules.judge(clean[:size], compressor)[6], size
    # A fifth of garbage is below the share, whether the last chunk reaches back or not.
    assert rules.judge(clean[:4097] + junk(1024), compressor)[6]


# --- helpers ---------------------------------------------------------------------------------


def test_components(spark):
    random.seed(12)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {(r["v"], r["root"]) for r in found} == {(x, root(x)) for x in up if x not in alone}
    assert len(found) == len({r["v"] for r in found})


# --- pages that are laid out in odd ways, or made to take long --------------------------------

PROSE = "Words of the article and more of them. " * 8


@pytest.mark.parametrize(
    "page,wanted",
    [
        # Servers wrap pages into one form; forms to fill in are no text.
        (f"<body><form action=x><input type=hidden><article><h1>T</h1><p>{PROSE}</p></article><input></form>", f"T\n{PROSE}"),
        ("<body><form><p>some text here</p></form></body>", "some text here"),
        (f"<article><p>{PROSE}</p></article><form>Get our news <input><button>Go</button></form>", PROSE),
        (f"<article><p>{PROSE}</p></article><fieldset><label>Name</label><select></select></fieldset>", PROSE),
        # A quote opens a value only behind its sign.
        (f"<article><h1>T</h1><p title=don't>{PROSE}</p><p>end</p></article>", f"T\n{PROSE}\nend"),
        (f"<article><p a=\"x>y\" b='>' c=d/>{PROSE}</p></article>", PROSE),
        ("<article><p>The <label>marked</label> word</p><xmp>a <b> &amp; c</xmp></article>", "The marked word\na <b> &amp; c"),
        # A page is shown by its script later; elements inside it may be hidden.
        (f"<body style='display: none' hidden><article><p>{PROSE}</p><p hidden>no</p></article></body>", PROSE),
        ("<p>1 < 2 & 3 > 2 <!-- no --> x <![CDATA[y]]> z", "1 < 2 & 3 > 2 x z"),
    ],
)
def test_odd_layouts(page, wanted):
    path, _ = htmltext.best_path(page)
    found = htmltext.extract(page, path)
    assert found == "\n".join(" ".join(x.split()) for x in wanted.split("\n")) == htmltext.extract(page, None)


@pytest.mark.parametrize(
    "part,after",
    [
        ("<a ", ""), ("<a ", ">"), ("<a b=\"", ""), ("<a b='", "'>"), ("<div>", ""), ("<div class=sidebar>", "x"),
        ("<div class=sidebar><div class=menu>t", ""), ("<ul><li>x", ""), ("<i><p>", "</i>" * 9000), ("<font>", "<div>x" * 9000),
        ("<b>", "</i>" * 9000), ("<blockquote>", "<p>x" * 9000), ("<!--", ""), ("<script>", ""), ("<xmp>", ""), ("<", ""),
        ("&", ""), ("<div class=a>", "text</div>" * 9000), ("<article>", "x"), ("<a =", ""), ("</div", ">"),
    ],
)
def test_time_is_in_proportion_to_the_page(part, after):
    """Pages of 300 KB that would take minutes if anything were looked at again for each element."""
    import time

    page = part * (300_000 // len(part)) + after
    started = time.process_time()
    htmltext.extract(page, htmltext.best_path(page)[0])
    assert time.process_time() - started < 15


# --- rules in other scripts -------------------------------------------------------------------

#: Clean prose, words apart, in scripts of two and three bytes to a character.
CLEAN = {
    "Korean": """지난 주말에 우리 가족은 오랜만에 바닷가로 여행을 다녀왔다. 아침 일찍 출발했지만 고속도로에 차가 많아서 예상보다 두 시간이나 늦게 도착했다. 그래도 창밖으로 보이는 푸른 바다를 보니 피곤함이 모두 사라지는 것 같았다. 점심으로는 시장에서 산 신선한 생선회와 매운탕을 먹었는데 정말 맛있었다. 오후에는 아이들과 모래성을 쌓고 조개껍데기를 주우며 놀았다. 저녁이 되자 하늘이 붉게 물들었고 우리는 말없이 해가 지는 모습을 바라보았다. 할머니께서는 젊었을 때 이 마을에서 사셨다고 하시며 옛날이야기를 들려주셨다. 밤에는 숙소 마당에 모여 고기를 구워 먹으며 앞으로의 계획에 대해 이야기를 나누었다. 다음 날에는 근처에 있는 오래된 절을 방문하여 조용히 산책을 즐겼다. 돌아오는 길에 막내가 또 오고 싶다고 말해서 모두가 웃었다.""",
    "Japanese": """昨日 の 夕方、 友人 と 一緒 に 駅前 の 小さな 喫茶店 へ 行きました。 店内 は 静か で、 古い 時計 の 音 だけ が 聞こえて いました。 窓 の 外 で は 雨 が 降り 始め、 傘 を 持たない 人々 が 急いで 走って いきました。 私たち は 温かい 珈琲 を 飲みながら、 学生 時代 の 思い出 に ついて 長い 間 話しました。 彼 は 来月 から 海外 で 働く こと に なった そう です。 新しい 生活 への 期待 と 不安 が 入り混じった 表情 が とても 印象的 でした。 帰り道、 雨 は すっかり 上がり、 空 に は 大きな 虹 が かかって いました。 また いつか この 店 で 会おう と 約束 して、 私たち は 別れました。""",
    "Hindi": """पिछले महीने हम लोग पहाड़ों की यात्रा पर गए थे और वहाँ का मौसम बहुत सुहावना था। सुबह की ठंडी हवा में चाय पीते हुए हमने दूर तक फैली हरी घाटियों को देखा। गाँव के लोग बहुत मिलनसार थे और उन्होंने हमें अपने घर में बना हुआ खाना खिलाया। दोपहर में हम नदी के किनारे बैठे और बच्चों ने पानी में खूब मस्ती की। शाम को मंदिर की घंटियों की आवाज़ पूरे इलाके में गूँज रही थी। मेरे दादाजी ने बताया कि वे भी बचपन में यहाँ आया करते थे। रात में आसमान तारों से भरा हुआ था और हमने अलाव के पास बैठकर कहानियाँ सुनीं। अगले दिन लौटते समय सबका मन थोड़ा उदास था लेकिन यादें हमेशा साथ रहेंगी।""",
    "Russian": """Вчера вечером мы долго гуляли по набережной и разговаривали о том, как быстро проходит время. Над рекой медленно поднимался туман, фонари отражались в тёмной воде, а где-то вдалеке играла тихая музыка. Мой брат рассказал, что собирается поступать в университет и изучать историю древних городов. Мама беспокоится, потому что ему придётся уехать далеко от дома, но отец считает, что это хороший выбор. Потом начался дождь, и мы спрятались под крышей старого кафе, где пахло свежим хлебом и корицей. Хозяйка принесла нам горячий чай с мёдом и спросила, откуда мы приехали. Домой мы вернулись уже за полночь, усталые, но очень довольные.""",
    "Greek": """Το περασμένο καλοκαίρι ταξιδέψαμε με το πλοίο σε ένα μικρό νησί του Αιγαίου. Τα σπίτια ήταν άσπρα με μπλε παράθυρα και στους στενούς δρόμους έπαιζαν παιδιά. Κάθε πρωί πηγαίναμε στη θάλασσα και το απόγευμα τρώγαμε φρέσκο ψάρι στην ταβέρνα του χωριού. Ο παππούς μου έλεγε ιστορίες για τους ναυτικούς που γύριζαν μετά από πολλά χρόνια. Το βράδυ βλέπαμε τα αστέρια από την ταράτσα και ακούγαμε τα κύματα. Θέλω να ξαναπάμε του χρόνου με όλους τους φίλους μας και να μείνουμε περισσότερες μέρες.""",
    "Arabic": """في الصيف الماضي سافرنا مع العائلة إلى قرية صغيرة على ساحل البحر. كانت البيوت بيضاء والشوارع ضيقة ومليئة بالأطفال الذين يلعبون كرة القدم. في الصباح كنا نشرب القهوة ونراقب الصيادين وهم يعودون بقواربهم الملونة. حدثنا جدي عن أيام شبابه وكيف كان يعمل في الميناء قبل أن ينتقل إلى المدينة. وعند المساء جلسنا على الشرفة نستمع إلى صوت الأمواج وننظر إلى النجوم. أتمنى أن نعود إلى هناك في العام القادم مع جميع أصدقائنا وأن نبقى وقتا أطول.""",
    "Thai": """เมื่อ วัน หยุด ที่ ผ่าน มา ครอบครัว ของ ฉัน ไป เที่ยว ทะเล ด้วย กัน อากาศ ดี มาก และ น้ำ ทะเล ใส จน มอง เห็น ปลา ตัว เล็ก เรา นั่ง กิน อาหาร ทะเล ที่ ร้าน ริม หาด แล้ว เดิน เล่น บน ทราย ตอน เย็น พ่อ เล่า เรื่อง สมัย เด็ก ให้ ฟัง ทุก คน หัวเราะ กัน อย่าง มี ความ สุข ก่อน กลับ บ้าน แม่ ซื้อ ของ ฝาก ให้ เพื่อน บ้าน หลาย อย่าง ฉัน อยาก กลับ ไป อีก ใน ปี หน้า กับ เพื่อน ๆ ที่ โรงเรียน""",
    "Chinese": """上 个 周末 我们 全家 去 海边 旅行 了 。 早上 很 早 就 出发 ， 可是 路上 车 太 多 ， 晚 到 了 两 个 小时 。 中午 在 市场 买 了 新鲜 的 鱼 和 虾 ， 味道 非常 好 。 下午 孩子们 在 沙滩 上 堆 城堡 ， 还 捡 了 许多 漂亮 的 贝壳 。 傍晚 天空 变 成 红色 ， 大家 安静 地 看 着 太阳 落 下去 。 奶奶 讲 了 她 年轻 时候 的 故事 ， 说 这个 村子 以前 只有 几 户 人家 。 第二 天 参观 了 一座 古老 的 寺庙 ， 然后 慢慢 走 回 旅馆 。""",
}


@pytest.mark.parametrize("language", CLEAN)
def test_rules_keep_clean_prose_of_any_script(language):
    import base64

    import zstandard

    compressor = zstandard.ZstdCompressor(level=3)
    text = CLEAN[language]
    words = text.split(" ")
    assert rules.judge(text, compressor)[6]
    for start in range(0, len(words) - 55, 5):  # any 55 words of it
        found = rules.judge(" ".join(words[start : start + 55]), compressor)
        assert found[6], (start, found)
    random.seed(12)
    raw = base64.b64encode(random.randbytes(3000)).decode()
    junk = " ".join(raw[i : i + 8] for i in range(0, len(raw), 8))
    found = rules.judge(text + " " + junk[: 2 * len(text.encode())], compressor)
    assert found[10] in ("chunks", "incompressible")


def test_characters_of_cut_bytes():
    data = "aé日𝄞".encode()
    assert rules.characters(data) == 4 and rules.characters(data[1:]) == 3 and rules.characters(data[2:]) == 2
    assert rules.characters(b"") == 0 and rules.characters(b"abc") == 3
