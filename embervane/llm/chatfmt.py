"""Chat formatting at the level of tokens.

Role names and contents are encoded separately, as ordinary text, and reserved ids are spliced between
them, so no content can yield a reserved id.  Control strings that occur in a content are escaped all the
same, by a backslash that ``unescape`` takes out, so that text made of the tokens can't be read as control
either.  The loss mask has +1 where a trained span begins and -1 where it ends; its prefix sums are the mask.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm.bpe import RANKS, codec
from embervane.llm.common import map_arrow

#: Reserved strings by name; their ids follow the vocabulary's.
RESERVED = ("endoftext", "im_start", "im_end")
TRAINED_ROLE = "assistant"
#: Tokens that a batch of results holds before it is given on, one conversation at least.
TOKENS_AT_ONCE = 1 << 18

_CONTROL = re.compile(rf"<(\\*)\|({'|'.join(RESERVED)})\|>")
_ESCAPED = re.compile(rf"<(\\*)\\\|({'|'.join(RESERVED)})\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def reserved_ids(ranks: str = RANKS) -> dict[str, int]:
    return {name: len(codec(ranks).size) + k for k, name in enumerate(RESERVED)}


def assemble(messages: list[tuple[str | None, str | None]], ranks: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, loss mask) of a conversation's (role, content) messages in order."""
    c, ids = codec(ranks), reserved_ids(ranks)
    start, end, stop = (np.array([ids[x]], np.int64) for x in ("im_start", "im_end", "endoftext"))
    line = c.encode("\n")
    parts: list[np.ndarray] = []
    at = 0
    edges: list[tuple[int, int]] = []
    for role, text in messages:
        name = role if role is not None else "unknown"
        head = [start, c.encode(escape(name)), line]
        body = [c.encode(escape(text or "")), end]
        a = at + sum(map(len, head))
        at = a + sum(map(len, body)) + len(line)
        if name == TRAINED_ROLE:
            edges.append((a, at - len(line)))
        parts += [*head, *body, line]
    parts.append(stop)
    tokens = np.concatenate(parts).astype(np.int32)
    delta = np.zeros(len(tokens) + 1, np.int32)
    for a, b in edges:
        delta[a] += 1
        delta[b] -= 1
    return tokens, np.cumsum(delta)[:-1].astype(np.int32)


def format_chats(messages: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(conv_id, n_messages, tokens, loss_mask, n_tokens, n_trained) of every conversation.

    Messages go by turn, null turns first, ties by role and text; repeated rows are repeated messages.  A
    null role is the role "unknown", a null text an empty content.  Rows with null conv_id belong to no
    conversation in common: each is one of its own, of null id.  The mask is 1 on the assistant's contents and the
    ids that end them.  A conversation is one row, however long.  Other columns are ignored; an empty table gives
    no rows.
    """
    own = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("m"))
    chats = own.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    chats = chats.union(own.where("conv_id IS NULL").select("conv_id", F.array("m")))
    lists = pa.list_(pa.int32())

    def made(done: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _, _ in done], pa.int64()), pa.array([n for _, n, _, _ in done], pa.int32()), pa.array([t for _, _, t, _ in done], lists), pa.array([k for _, _, _, k in done], lists), pa.array([len(t) for _, _, t, _ in done], pa.int32()), pa.array([int(k.sum()) for _, _, _, k in done], pa.int32())],
            ["conv_id", "n_messages", "tokens", "loss_mask", "n_tokens", "n_trained"],
        )

    def f(batches):
        done: list = []
        size = 0
        for b in batches:
            for conv, chat in zip(b.column("conv_id"), b.column("m")):
                chat = chat.as_py()
                done.append((conv.as_py(), len(chat), *assemble([(m["role"], m["text"]) for m in chat], ranks)))
                size += len(done[-1][2])
                if size > TOKENS_AT_ONCE:
                    yield made(done)
                    done, size = [], 0
        if done:
            yield made(done)

    return map_arrow(chats, f, "conv_id bigint, n_messages int, tokens array<int>, loss_mask array<int>, n_tokens int, n_trained int")
