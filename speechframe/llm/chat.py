"""Conversations as token sequences with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reserved ids, above the vocabulary of the tokenizer: marks of a turn's begin and end.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"

_OPEN, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash between ``<`` and ``|``, however many there are."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles end at a line end, so theirs are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class ChatTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in texts are text
        self.start = self.tokenizer.get_vocab_size()
        self.end = self.start + 1

    def encode(self, segments: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        return [e.ids for e in found]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def render(self, ids: list[int]) -> str:
        """The formatted text of a sequence, with the marks of turns."""
        out, held = [], []
        for i in ids:
            if i < self.start:
                held.append(i)
                continue
            out += [self.decode(held), START if i == self.start else END]
            held = []
        return "".join([*out, self.decode(held)])


@lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> ChatTokenizer:
    return ChatTokenizer(path)


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, loss_start, loss_end) for every row (conv_id, turn, role, text).

    ``ids``: start mark, role and line end, text, end mark, line end. The segments are encoded each
    for itself and put together, so no token crosses a mark and control strings inside a text,
    escaped, can't become one. ``loss_start`` .. ``loss_end`` bound the ids of an assistant's text
    (equal for other roles): prefix sums over the lengths of the segments. NULL roles and texts are
    empty. Every row is encoded for itself, so a large conversation spreads over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = chat_tokenizer(tokenizer)
        for batch in batches:
            roles = [x or "" for x in batch["role"]]
            texts = [x or "" for x in batch["text"]]
            heads = own.encode([escape_role(r) + "\n" for r in roles])
            bodies = own.encode([escape(t) for t in texts])
            (tail,) = own.encode(["\n"])
            ids, starts, ends = [], [], []
            for role, head, body in zip(roles, heads, bodies):
                segments = [[own.start], head, body, [own.end], tail]
                places = np.cumsum([0, *map(len, segments)])
                ids.append(np.concatenate([np.asarray(s, dtype="i4") for s in segments]))
                starts.append(int(places[2]))
                ends.append(int(places[3] if role == ASSISTANT else places[2]))
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"].astype("Int64"),
                    "turn": batch["turn"].astype("Int64"),
                    "role": roles,
                    "text": texts,
                    "ids": ids,
                    "loss_start": starts,
                    "loss_end": ends,
                }
            )

    schema = (
        "conv_id long, turn long, role string, text string, ids array<int>, "
        "loss_start long, loss_end long"
    )
    return turns.select("conv_id", "turn", "role", "text").mapInPandas(run, schema)


#: Rows of a conversation in this order; equal rows are interchangeable.
ORDER = ["turn", "role", "text"]


def place_turns(formatted: DataFrame) -> DataFrame:
    """Formatted turns with first_id: their ids' place in the whole conversation, a prefix sum."""
    before = Window.partitionBy("conv_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0))
    return formatted.withColumn("first_id", first)


def assemble(formatted: DataFrame) -> DataFrame:
    """(conv_id, input_ids, loss_mask): one row for each conversation, turns in order. A row holds a
    whole conversation; for longer ones than fit in a row, use the turns as they are."""
    turn = F.struct(*ORDER, "ids", "loss_start", "loss_end")
    rows = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))

    def mask(t):
        return F.concat(
            F.array_repeat(F.lit(0), t["loss_start"].cast("int")),
            F.array_repeat(F.lit(1), (t["loss_end"] - t["loss_start"]).cast("int")),
            F.array_repeat(F.lit(0), (F.size(t["ids"]) - t["loss_end"]).cast("int")),
        )

    return rows.select(
        "conv_id",
        F.flatten(F.transform("t", lambda t: t["ids"])).alias("input_ids"),
        F.flatten(F.transform("t", mask)).alias("loss_mask"),
    )


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) decoded from the
    ids of formatted turns alone.

    Turns of a conversation are met in order in one sorted stream, and only running digests are
    held, so memory doesn't grow with a conversation. NULL conv_ids are one conversation.
    """

    def turn_parts(own: ChatTokenizer, ids: np.ndarray, start: int, end: int):
        ids = ids.tolist()
        body = ids[1 : ids.index(own.end)]
        role, _, text = own.decode(body).partition("\n")
        masked = own.decode(ids[start:end])
        return unescape_role(role), unescape(text), unescape(masked), len(own.render(ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = chat_tokenizer(tokenizer)
        key, state, first = None, None, True

        def row():
            turns, all_turns, chars, loss, length = state
            return (key, turns, all_turns.hexdigest(), chars, loss.hexdigest(), length)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv, ids, start, end in zip(
                batch["conv_id"], batch["ids"], batch["loss_start"], batch["loss_end"]
            ):
                conv = None if pd.isna(conv) else int(conv)
                if first or conv != key:
                    if not first:
                        out.append(row())
                    key, first = conv, False
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, masked, length = turn_parts(own, ids, start, end)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += length
            if out:
                table = pd.DataFrame(out, columns=names)
                yield table.assign(conv_id=table["conv_id"].astype("Int64"))
        if not first:
            table = pd.DataFrame([row()], columns=names)
            yield table.assign(conv_id=table["conv_id"].astype("Int64"))

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return ordered.select("conv_id", "ids", "loss_start", "loss_end").mapInPandas(run, schema)
