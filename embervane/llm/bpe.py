"""Byte-level BPE by monoid tree reduction.

A text is halved until a piece has at most ``LEAF`` characters; pieces are encoded on their own, and
neighbours are joined by encoding anew a window about the seam.  The window grows on either side until
it ends at a synchronising point: a single space between two characters that aren't white space.  The
pre-tokenizer starts a pre-token at such a space whatever stands before it, and ends one there whatever
comes after, so tokens outside the window are those of the whole text.  Joining is associative, and the
result is that of encoding the text at once.  Decoding concatenates the bytes up the tree.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow

#: A file of "base64 rank" lines.
RANKS = os.environ.get("EMBERVANE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, FIRST_WINDOW = 2048, 64

_SYNC = re.compile(r"(?<=\S) (?=\S)")


class TreeCodec:
    def __init__(self, ranks: str = RANKS, leaf: int = LEAF):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.leaf = max(leaf, 2)
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.size[rank] = len(token)

    def flat(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self.flat(text[a:b])
        mid = (a + b) // 2
        return self.join(text, a, mid, b, self._encode(text, a, mid), self._encode(text, mid, b))

    def join(self, text: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of text[a:b] from those of text[a:mid] and text[mid:b]."""
        lo, hi = _sync_before(text, a, mid), _sync_after(text, mid, b)
        keep = len(left) - self._tokens(left[::-1], len(text[lo:mid].encode()))
        skip = self._tokens(right, len(text[mid:hi].encode()))
        return np.concatenate([left[:keep], self.flat(text[lo:hi]), right[skip:]])

    def _tokens(self, ids: np.ndarray, n: int) -> int:
        """How many tokens the first n bytes take; n is at a token's end."""
        if not n:
            return 0
        total = np.cumsum(self.size[ids[:n]])
        k = int(np.searchsorted(total, n))
        if k == len(total) or total[k] != n:
            raise AssertionError("a synchronising point isn't at a token's end")
        return k + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.core.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _sync_before(text: str, a: int, mid: int) -> int:
    w = FIRST_WINDOW
    while True:
        lo = max(a, mid - w)
        last = -1
        for m in _SYNC.finditer(text, lo, mid):  # looks behind lo into the text, and not beyond mid
            last = m.start()
        if last > a:
            return last
        if lo == a:
            return a
        w *= 2


def _sync_after(text: str, mid: int, b: int) -> int:
    w = FIRST_WINDOW
    while True:
        hi = min(b, mid + w)
        m = _SYNC.search(text, mid + 1, hi)
        if m:
            return m.start()
        if hi == b:
            return b
        w *= 2


@functools.lru_cache(4)
def codec(ranks: str = RANKS, leaf: int = LEAF) -> TreeCodec:
    return TreeCodec(ranks, leaf)


def encode_documents(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip): the token ids of each row's whole text, and whether decoding them gives its bytes back.

    One row for every row of ``docs``, repeated ones and null ids too; a null text has null tokens, an
    empty one none.  Other columns are left out; an empty table gives no rows.
    """

    def f(batches):
        c = codec(ranks)
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                texts = b.column("text").to_pylist()
                ids = [None if t is None else c.encode(t) for t in texts]
                same = [None if t is None else c.decode(i) == t.encode() for t, i in zip(texts, ids)]
                n = [None if i is None else len(i) for i in ids]
                at = np.concatenate([[0], np.cumsum([k or 0 for k in n])]).astype(np.int32)
                some = [i for i in ids if i is not None]
                values = np.concatenate(some).astype(np.int32) if some else np.zeros(0, np.int32)
                null = pa.array([i is None for i in ids])
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=null)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), tokens, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, f, "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean")
