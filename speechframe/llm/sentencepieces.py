"""SentencePiece ids of whole texts by a streaming Viterbi search, and texts of ids.

The search keeps one entry per character boundary (how the best path gets there) in a window of
the longest piece's length, and commits ids as soon as all paths still alive pass one boundary.
What "best" means depends on the model: the sum of scores for a unigram model; for a BPE model the
only path whose neighbouring pieces each survive the merges of the two together, which is what the
merges of the whole text give.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Segments a worker remembers with their ids, those used last (results don't depend on it).
MEMO_SEGMENTS = 1_000_000
MEMO_CHARS = 48
#: Characters between two looks for a boundary to commit, as a multiple of the longest piece.
COMMIT_EVERY = 4
SPACE = "▁"


class PieceModel:
    """Pieces, scores and settings read from a model file."""

    def __init__(self, path: str, unigram: bool = False):
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_file=path)
        self.unigram = unigram
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.text = [b""] * sp.get_piece_size()
        self.unknown = sp.unk_id()
        byte_pieces = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.text[i] = bytes([int(piece[3:-1], 16)])
                byte_pieces += 1
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.byte_fallback = byte_pieces == 256
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.scores.values()) - 10.0
        #: Neighbouring characters inside some piece. No piece crosses any other boundary.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.prefixed = sp.encode("a", out_type=str)[0].startswith(SPACE)
        #: Beginnings of pieces: where to stop trying longer ones.
        self.beginnings = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self._pairs: dict[str, dict[str, bool]] = {}
        self._history: dict[str, list[tuple[float, str, str]] | None] = {}
        #: Behind a piece (None: at the beginning), which beginnings of pieces are pieces that may follow it.
        self._behind: dict[str | None, dict[str, bool]] = {}

    def normalize(self, text: str) -> str:
        """The model's own normalisation, with its mark for spaces."""
        plain = self.processor.normalize(text)
        return plain.replace(" ", SPACE)

    def history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, best score first, leftmost on ties: the
        score of each and the outermost parts behind it. None if they end in several pieces."""
        if piece not in self._history:
            parts, made = list(piece), [(0.0, piece[0], piece[-1])]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = self.scores.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                made.append((best, parts[0], parts[-1]))
            self._history[piece] = made if len(parts) == 1 else None
        return self._history[piece]

    def alone(self, piece: str) -> bool:
        return self.history(piece) is not None

    def follows(self, left: str, right: str) -> bool:
        """Whether the merges of both together leave exactly these two pieces: both are merged side
        by side, in the order of scores, and at no time their inner edges merge first."""
        own = self._pairs.get(left)
        if own is None:
            if len(self._pairs) > 200_000:  # unknown characters count as pieces here
                self._pairs.clear()
            own = self._pairs[left] = {}
        known = own.get(right)
        if known is None:
            known = own[right] = self._apart(self.history(left), self.history(right))
        return known

    def behind(self, left: str | None) -> dict[str, bool]:
        """What is known of the pieces behind this one."""
        own = self._behind.get(left)
        if own is None:
            if len(self._behind) > 200_000:
                self._behind.clear()
            own = self._behind[left] = {}
        return own

    def _apart(self, left: list[tuple[float, str, str]], right: list[tuple[float, str, str]]) -> bool:
        never = (float("-inf"),)
        i = j = 0
        while True:
            next_left = (left[i + 1] if i + 1 < len(left) else never)[0]
            next_right = (right[j + 1] if j + 1 < len(right) else never)[0]
            across = self.scores.get(left[i][2] + right[j][1])
            if across is not None and across > next_left and across >= next_right:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if i + 1 < len(left) and next_left >= next_right:
                i += 1
            else:
                j += 1

    def piece_ids(self, piece: str) -> list[int]:
        number = self.ids.get(piece)
        if number is not None:
            return [number]
        if self.byte_fallback:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]


class StreamEncoder:
    """Ids of a normalised text that comes in parts, in memory of one window."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""  # from the last committed boundary on
        self.best: list[tuple[float, int] | None] = [(0.0, 0)]  # by boundary: score, last piece's length
        self.before: str | None = None  # the piece before the window
        self.widest = 0  # most boundaries ever held

    def _extend(self, end: int) -> None:
        model, text = self.model, self.text
        found: tuple[float, int] | None = None
        for length in range(min(model.longest, end), 0, -1):
            last = self.best[end - length]
            if last is None:
                continue
            piece = text[end - length : end]
            score = model.scores.get(piece)
            if score is None:
                if length > 1:
                    continue
                score = model.lowest
            if model.unigram:
                total = last[0] + score
                if found is None or total > found[0]:
                    found = (total, length)
                continue
            if end == length:
                left = self.before
            else:
                left = text[end - length - last[1] : end - length]
            if model.alone(piece) and (left is None or model.follows(left, piece)):
                found = (0.0, length)
                break
        self.best.append(found)

    def _commit(self, boundary: int) -> list[int]:
        pieces, at = [], boundary
        while at > 0:
            length = self.best[at][1]
            pieces.append(self.text[at - length : at])
            at -= length
        ids = [i for piece in reversed(pieces) for i in self.model.piece_ids(piece)]
        if pieces:
            self.before = pieces[0]
            base = self.best[boundary][0]
            self.best = [e and (e[0] - base, e[1]) for e in self.best[boundary:]]
            self.best[0] = (0.0, 0)
            self.text = self.text[boundary:]
        return ids

    def _converged(self) -> int:
        """The last boundary that every path still alive passes. Alive are the paths to the
        boundaries a later piece can start at."""
        end = len(self.best) - 1
        alive = {i for i in range(max(0, end - self.model.longest + 1), end + 1) if self.best[i]}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - self.best[last][1])
        return alive.pop()

    def feed(self, part: str) -> list[int]:
        ids: list[int] = []
        step = COMMIT_EVERY * self.model.longest
        for start in range(0, len(part), step):
            self.text += part[start : start + step]
            while len(self.best) <= len(self.text):
                self._extend(len(self.best))
            self.widest = max(self.widest, len(self.best))
            ids += self._commit(self._converged())
        return ids

    def finish(self) -> list[int]:
        return self._commit(len(self.text))


class Encoder:
    """Whole texts. Where two neighbouring characters are in no piece together, all paths meet, so
    the segments between such boundaries are encoded each for itself and remembered."""

    SEGMENTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def __init__(self, model: PieceModel):
        self.model = model
        # Of segments and of words, the newer and the older half of the memory: what is used again moves to
        # the newer one, and the older one goes when that is full.
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        spaced = any(SPACE in p.lstrip(SPACE) for p in model.ids) or "\n" in "".join(model.ids)
        self.split = None if spaced else self.SEGMENTS

    def _segment(self, segment: str) -> bytes:
        if self.model.unigram or len(segment) > 2 * self.model.longest:
            stream = StreamEncoder(self.model)
            ids = stream.feed(segment) + stream.finish()
        else:
            ids = self._window(segment)
        return np.asarray(ids, dtype="<i4").tobytes()

    def _window(self, text: str) -> list[int]:
        """The same search over a text that fits into one window: nothing to commit before its end."""
        model = self.model
        beginnings, history = model.beginnings, model.history
        ids, size = model.ids, len(text)
        last: list[str | None] = [None] * (size + 1)
        for start in range(size):
            left = last[start]
            if left is None and start:
                continue
            known = model.behind(left)
            end, piece = start + 1, text[start]
            if piece not in ids and last[end] is None:
                last[end] = piece
            while piece in beginnings:
                if last[end] is None:
                    fits = known.get(piece)
                    if fits is None:
                        whole = piece in ids and history(piece) is not None
                        fits = known[piece] = whole and (left is None or model.follows(left, piece))
                    if fits:
                        last[end] = piece
                end += 1
                if end > size:
                    break
                piece = text[start:end]
        out, at = [], size
        while at:
            out.append(last[at])
            at -= len(last[at])
        if len(out) == 1:
            return model.piece_ids(out[0])
        return [i for piece in reversed(out) for i in model.piece_ids(piece)]

    def _word(self, word: str) -> bytes:
        """A run without white space inside, cut where no piece crosses."""
        joined, out, start = self.model.joined, [], 0
        for i in range(1, len(word) + 1):
            if i < len(word) and word[i - 1 : i + 1] in joined:
                continue
            part = word[start:i]
            ids = self.known.get(part)
            if ids is None:
                ids = self.known_before.get(part)
                if ids is None:
                    ids = self._segment(part)
                if len(part) <= MEMO_CHARS:
                    self.known[part] = ids
            out.append(ids)
            start = i
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        plain = self.model.normalize(text)
        if not plain:
            return np.empty(0, dtype="<i4")
        if self.split is None:
            return np.frombuffer(self._word(plain), dtype="<i4")
        parts = self.split.findall(plain)
        if len(self.words) > MEMO_SEGMENTS // 2:
            self.words_before, self.words = self.words, {}
        if len(self.known) > MEMO_SEGMENTS // 2:
            self.known_before, self.known = self.known, {}
        words, before = self.words, self.words_before
        missing = set(parts).difference(words)
        for part in missing:
            ids = before.get(part)
            words[part] = self._word(part) if ids is None else ids
        data = b"".join(map(words.__getitem__, parts))
        for part in missing:
            if len(part) > MEMO_CHARS:
                del words[part]
        return np.frombuffer(data, dtype="<i4")


def decode_ids(model: PieceModel, ids: Iterable[int]) -> str:
    """The text of ids. Byte pieces are put together; bytes that are no UTF-8 become U+FFFD."""
    text = b"".join([model.text[i] for i in ids]).decode("utf-8", errors="replace")
    return text[1:] if model.prefixed and text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str, unigram: bool = False) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(PieceModel(path, unigram))


def encode(docs: DataFrame, model: str, *, unigram: bool = False) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for every row of ``docs`` (doc_id, text).

    Whole texts. NULL texts give NULL ids, n_ids 0 and round_trip NULL; empty texts give no ids.
    ``round_trip`` tells whether decoding the ids gives the text back (it can't where the text
    holds the model's own mark for spaces, or where the model normalises). Other columns are left
    out; repeated rows stay repeated. ``unigram`` reads the model's scores as those of a unigram
    model.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(model, unigram)
        for batch in batches:
            ids, same = [], []
            for text in batch["text"]:
                if text is None:
                    ids.append(None)
                    same.append(None)
                    continue
                found = own.encode(text)
                ids.append(found)
                same.append(decode_ids(own.model, found.tolist()) == text)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "ids": ids,
                    "n_ids": [0 if x is None else len(x) for x in ids],
                    "round_trip": pd.array(same, dtype="boolean"),
                }
            )

    schema = "doc_id long, ids array<int>, n_ids long, round_trip boolean"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); NULL ids give a NULL text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(model).model
        for batch in batches:
            texts = [None if x is None else decode_ids(own, np.asarray(x).tolist()) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
