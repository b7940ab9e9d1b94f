"""Sequence packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from speechframe.llm import common
from speechframe.llm.common import number_rows, tidy

#: Words a task remembers with their ids, those used last (results don't depend on it).
MEMO_WORDS = 1_000_000
#: Words above this length are encoded each time.
MEMO_CHARS = 48

PLACES = "sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and ends words with ``</w>``.

    Its merges never cross words, so each different word is encoded once. Texts that are not in
    NFC, or that may hold one of its special strings, go through the tokenizer as a whole.
    """

    #: The tokenizer's own word pattern.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    #: The model spells a byte that is no printable Latin-1 character by the next one from 256 on.
    BYTES = {
        byte: 256 + number
        for number, byte in enumerate([*range(33), *range(127, 161), 173])
    }
    #: The first character behind the Latin blocks of Unicode.
    LATIN = "\u0250"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        self.last = np.zeros(vocabulary[-1][1] + 1, dtype=bool)
        for token, number in vocabulary:
            self.last[number] = token.endswith("</w>")
        # The dotted capital I is the one letter that lower case makes a letter and a mark of.
        self.unusual = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + ["İ"]
        self.model = self.tokenizer.model
        # The newer half of the memory takes what is used from the older one, which goes when the newer is full.
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: set[str] = set()

    def forget(self) -> None:
        """Drops the words, at the end of a task: several workers take turns, and idle ones would hold theirs."""
        self.new, self.old = {}, {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _plain(self, part: str) -> bool:
        """Letters of the Latin blocks alone, in lower case: one word, and normalised as it is."""
        # Capitals of ASCII are gone here.
        return part.isalpha() and (part.isascii() or (max(part) < self.LATIN and part == part.lower()))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words that the tokenizer may normalise: one text of them all, cut behind each
        word's last id."""
        known = {}
        for start in range(0, len(words), 1000):
            part = words[start : start + 1000]
            encoded = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.asarray(encoded[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                known.update((w, self._whole(w)) for w in part)
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                known[word] = data[4 * begin : 4 * end]
                begin = end
        return known

    def _add(self, parts: set[str]) -> None:
        """Puts parts that are not in the newer half of the memory there. A word is a part too."""
        new, old, split, fresh = self.new, self.old, {}, set()
        for part in parts:
            ids = old.get(part)
            if ids is not None:
                new[part] = ids
            elif self._plain(part):
                new[part] = self._word(part)
            else:
                base = part.rstrip(".,;:!?")
                if len(base) < len(part) and self._plain(base):
                    words = [base, part[len(base) :]]  # signs in a row are one word
                else:
                    words = self.WORDS.findall(part)
                split[part] = words
                fresh.update(words)
        learn = []
        for word in fresh.difference(new):
            ids = old.get(word)
            if ids is not None:
                new[word] = ids
            elif self._plain(word):
                new[word] = self._word(word)
            else:
                learn.append(word)
        new.update(self._learn(learn))
        for part, words in split.items():
            new[part] = b"".join(map(new.__getitem__, words))
        for part in parts | fresh:
            if len(part) > MEMO_CHARS:
                self.long.add(part)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.BYTES)
        ids = [token.id for token in self.model.tokenize(word)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(t in text for t in self.unusual) or not unicodedata.is_normalized("NFC", text):
            return self._whole(text)
        parts = text.replace("\n", " ").encode().lower().decode().split(" ")
        if len(self.new) > MEMO_WORDS // 2:
            self.old, self.new = self.new, {}
        missing = set(parts).difference(self.new)
        if missing:
            self._add(missing)
        out = b"".join(map(self.new.__getitem__, parts))
        while self.long:
            del self.new[self.long.pop()]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, for as long as it packs."""
    return WordEncoder(path)


def _drop_encoders() -> bool:
    held = word_encoder.cache_info().currsize > 0
    word_encoder.cache_clear()
    return held


common.keeps(__name__, _drop_encoders)


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    ids: bool = True,
    packed: bool = False,
) -> DataFrame:
    """Documents (doc_id, text) to pieces of at most ``capacity`` ids.

    (doc_id, start, length, ids_crc32, doc_tokens[, ids][, packed]): a document's ids and ``end_id``, cut
    every ``capacity`` ids; ``start`` counts its ids before the piece. NULL and empty texts are
    one piece with the end id alone; a NULL doc_id stays NULL; repeated rows give repeated pieces.
    ``ids=False`` leaves the ids out (placements only); ``packed`` adds them as compressed bytes, two for each id if all fit.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer)
        compress = zstandard.ZstdCompressor(level=1).compress
        narrow = packed and max(len(encoder.last) - 1, end_id) < 1 << 16
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                data = (encoder.encode(text) if text else b"") + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)
                    if ids:
                        row = (*row, np.frombuffer(piece, "<u4").astype("i4"))
                    if packed:
                        # Two bytes are enough for each id of a small vocabulary.
                        kept = np.frombuffer(piece, "<u4").astype("<u2").tobytes() if narrow else piece
                        row = (*row, compress(kept))
                    rows.append(row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids, *["packed"] * packed]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        encoder.forget()

    schema += ", ids array<int>" * ids + ", packed binary" * packed
    return docs.select("doc_id", "text").mapInPandas(tidy(cut), schema)


def pack_histogram(
    counts: Mapping[int, int], capacity: int
) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, copies), ...) with the number of sequences that follow each.

    Lengths are placed longest first, each into the pack that is shortest so far (the one with
    most room), or a new one if none has room. Packs of one filling are one counted pattern, so
    work and memory follow the number of different lengths, not of pieces.
    """
    by_room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted
    done = []

    def put(room: int, pattern: tuple, number: int) -> None:
        if room == 0:
            done.append((pattern, number))
            return
        if not by_room[room]:
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        by_room[room].append((pattern, number))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left = counts[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, number = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop()
            else:
                room, pattern, number = capacity, (), left
            used = min(number, left)
            if number > used:
                put(room, pattern, number - used)
            if pattern and pattern[-1][0] == length:
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1))
            else:
                grown = (*pattern, (length, 1))
            put(room - length, grown, used)
            left -= used
    return done + [entry for room in rooms for entry in by_room[room]]


def _slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """For every length, consecutive ranges of ranks: the first rank of the range, its first
    sequence, how many pieces of that length a sequence takes, and where they begin."""
    rows, taken, sequence = [], defaultdict(int), 0
    for pattern, number in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += number * copies
            offset += length * copies
        sequence += number
    names = ["length", "rank", "sequence", "copies", "offset"]
    return pd.DataFrame(rows, columns=names).astype("int64").sort_values(["length", "rank"])


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Pieces (any columns, with ``length``) with sequence_id and offset.

    Only the histogram of lengths, ``capacity`` numbers at most, comes to the driver. Pieces are
    numbered by length and their other columns; the number inside a length is a piece's rank, and
    patterns hand out ranks. The table of rank ranges has at most a few entries for each length
    and pattern, and travels with the tasks. Equal pieces get different ranks. A length outside
    1 .. capacity is an error; an empty table stays empty.
    """
    order = ["length", *[c for c in ("doc_id", "start") if c in pieces.columns]]
    numbered, _ = number_rows(pieces, order, "__number")  # from here on the pieces are written down
    counts = numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {row["length"]: row["n"] for row in counts}
    slots = _slots(pack_histogram(histogram, capacity))
    starts = np.zeros(capacity + 2, dtype="int64")
    for length, number in histogram.items():
        starts[length + 1] = number
    starts = np.cumsum(starts)  # pieces shorter than a length
    lengths, ranks = slots["length"].to_numpy(), slots["rank"].to_numpy()
    sequences, copies = slots["sequence"].to_numpy(), slots["copies"].to_numpy()
    offsets = slots["offset"].to_numpy()
    bits = 44
    keys = (lengths << bits) | ranks

    @F.pandas_udf(PLACES)
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        own = length.to_numpy("int64")
        rank = number.to_numpy("int64") - starts[own]
        at = np.searchsorted(keys, (own << bits) | rank, side="right") - 1
        inside = rank - ranks[at]
        return pd.DataFrame(
            {
                "sequence_id": sequences[at] + inside // copies[at],
                "offset": offsets[at] + inside % copies[at] * own,
            }
        )

    placed = numbered.withColumn("__place", place("length", "__number"))
    return placed.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def sequences(placed: DataFrame, *, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, doc_starts, n_tokens) of placed pieces with ids: joined in order of
    offsets, padded to ``capacity`` unless the length is a power of two. A sequence holds at most
    ``capacity`` ids, so a group is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(ordered.alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("ids")
    whole = F.bit_count(n) == 1
    fill = F.array_repeat(F.lit(pad_id), F.when(whole, 0).otherwise(F.lit(capacity) - n))
    return joined.select(
        "sequence_id", ids.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("doc_starts")
    ).select("sequence_id", F.concat("ids", fill).alias("input_ids"), "doc_starts", n.cast(LongType()).alias("n_tokens"))


def assemble(pieces: DataFrame, *, capacity: int = 2048, pad_id: int = 0, ids: bool = True) -> DataFrame:
    """Pieces with ``packed`` ids (:func:`cut_pieces`) packed and put together to sequences.

    All pieces with their places (:func:`pack`), without ``packed``, and (n_tokens, in_place[, input_ids]):
    the ids of the piece's sequence without padding; whether the sequence, read at the piece's place, has
    the piece's checksum; and the sequence itself, padded as in :func:`sequences`, on the row of its first
    piece (offset 0) and NULL on the others, so that ``input_ids IS NOT NULL`` gives every sequence once and
    the other rows its bounds. ``ids=False`` assembles and checks, but leaves ``input_ids`` out.

    Pieces are written down once, with a number of their own, and only their lengths are sorted for packing.
    A sequence has at most ``capacity`` pieces, so no task gathers more than that.
    """
    key = "__piece"
    keyed = common.cut(pieces.withColumn(key, F.monotonically_increasing_id()))
    placed = pack(keyed.drop("packed"), capacity=capacity)
    joined = placed.join(keyed.select(key, "packed"), key).drop(key)
    dealt = joined.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    schema = StructType([f for f in joined.schema if f.name != "packed"])
    schema = schema.add("n_tokens", LongType()).add("in_place", BooleanType())
    if ids:
        schema = schema.add("input_ids", ArrayType(IntegerType()))
    pad = np.asarray([pad_id], dtype="<i4").tobytes()

    def whole(rows: pa.Table, decompress) -> pa.Table:
        """Rows of whole sequences."""
        numbers, offsets, lengths, sums = (
            rows[c].to_numpy() for c in ("sequence_id", "offset", "length", "ids_crc32")
        )
        data = [decompress(x) for x in rows["packed"].to_pylist()]
        data = [
            np.frombuffer(x, "<u2").astype("<u4").tobytes() if len(x) == 2 * n else x
            for x, n in zip(data, lengths.tolist())
        ]
        begins = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        first = np.zeros(len(numbers), dtype=bool)
        right = np.zeros(len(numbers), dtype=bool)
        totals = np.zeros(len(numbers), dtype="int64")
        padded = []
        for a, b in zip(begins, begins[1:]):
            sequence = b"".join(data[a:b])
            n = len(sequence) // 4
            first[a], totals[a:b] = True, n
            for i in range(a, b):
                piece = sequence[4 * offsets[i] : 4 * (offsets[i] + lengths[i])]
                right[i] = n <= capacity and len(piece) == 4 * lengths[i] and zlib.crc32(piece) == sums[i]
            padded.append(sequence if n & (n - 1) == 0 else sequence + pad * (capacity - n))
        out = rows.drop_columns("packed")
        out = out.append_column("n_tokens", pa.array(totals)).append_column("in_place", pa.array(right))
        if not ids:
            return out
        sizes = np.zeros(len(numbers) + 1, dtype="int32")
        sizes[1:][first] = [len(x) // 4 for x in padded]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum(sizes, dtype="int32")),
            pa.array(np.frombuffer(b"".join(padded), "<i4")),
            mask=pa.array(~first),
        )
        return out.append_column("input_ids", lists)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        held = None  # rows of a sequence that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            numbers = rows["sequence_id"].to_numpy()
            last = int(np.searchsorted(numbers, numbers[-1]))
            held = rows.slice(last)
            if last:
                yield from whole(rows.slice(0, last), decompress).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from whole(held, decompress).combine_chunks().to_batches()

    return dealt.mapInArrow(tidy(put_together), schema)
