"""Edit-aware token counts.

A document keeps a segment tree: the leaves are its pre-tokens with their lengths in characters and their
numbers of tokens, an inner node has the sums of its two children.  An edit descends to the leaves that it
touches, widens to boundary context until both ends are synchronising points of the pre-tokenizer (bpe.py),
encodes the text between anew, writes the new leaves over the old, and updates the sums above them.  What lies
outside isn't read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.bpe import PATTERN, RANKS, codec
from embervane.llm.common import map_arrow

_PRE = regex.compile(PATTERN)
#: Distinct pre-tokens whose counts a worker remembers; beyond it the memory is begun anew.
REMEMBERED = 1 << 19

#: (start, end, replacement), ascending and apart
Edit = tuple[int, int, str]

#: What the registered query edits: personal data, as a privacy pass would.
PRIVATE = regex.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{13,16}\b|\+\d{1,2} \(\d{3}\) \d{3}-\d{4}")
MASK = "<masked>"


class PreTokenCounter:
    def __init__(self, ranks: str = RANKS):
        self.core = codec(ranks).core
        self.known: dict[str, int] = {}

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """(lengths in characters, numbers of tokens) of the pre-tokens."""
        pieces = _PRE.findall(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.core.encode_ordinary(p))
        return list(map(len, pieces)), [known[p] for p in pieces]


@functools.lru_cache(2)
def counter(ranks: str = RANKS) -> PreTokenCounter:
    return PreTokenCounter(ranks)


class SegmentTree:
    """Sums of (characters, tokens) over a document's leaves; node k has children 2k and 2k + 1, leaf i is node size + i."""

    def __init__(self, text: str, counts: PreTokenCounter, leaves: tuple | None = None):
        """The tree of a text; with kept ``leaves`` (characters, tokens) nothing is encoded."""
        self.counts = counts
        self.text = text
        chars, tokens = counts.leaves(text) if leaves is None else leaves
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.node = np.zeros((2 * self.size, 2), np.int64)
        self.node[self.size : self.size + len(chars), 0] = chars
        self.node[self.size : self.size + len(chars), 1] = tokens
        width = self.size
        while width > 1:
            level = self.node[width : 2 * width]
            self.node[width // 2 : width] = level[::2] + level[1::2]
            width //= 2
        self.encoded = 0  # characters encoded anew by edits

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of the leaves, those that edits have emptied left out."""
        own = self.node[self.size :]
        own = own[own[:, 0] > 0]
        return own[:, 0], own[:, 1]

    @property
    def n_tokens(self) -> int:
        return int(self.node[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character."""
        k, at = 1, 0
        while k < self.size:
            k *= 2
            if char >= at + self.node[k, 0]:
                at += int(self.node[k, 0])
                k += 1
        return k - self.size, at

    def _synchronises(self, char: int) -> bool:
        t = self.text
        return char in (0, len(t)) or (0 < char < len(t) - 1 and t[char] == " " and not t[char - 1].isspace() and not t[char + 1].isspace())

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end, counted in the present text."""
        old = self.text
        if not old:
            encoded = self.encoded
            self.__init__(new, self.counts)
            self.encoded = encoded + len(new)
            return
        first, a = self.leaf_at(min(start, len(old) - 1))
        # a synchronising point is a leaf's start; both characters at it must be outside the edit
        while not (a == 0 or (a + 1 < start and self._synchronises(a))):
            first, a = self.leaf_at(a - 1)
        last, b0 = self.leaf_at(min(max(end, start), len(old) - 1))
        b = b0 + int(self.node[self.size + last, 0])
        while not (b == len(old) or (b > end and self._synchronises(b))):
            last, b0 = self.leaf_at(b)
            b = b0 + int(self.node[self.size + last, 0])
        middle = old[a:start] + new + old[end:b]
        chars, tokens = self.counts.leaves(middle)
        self.encoded += len(middle)
        self.text = old[:a] + middle + old[b:]
        room = last - first + 1
        leaf = np.zeros((room, 2), np.int64)
        fit = min(room, len(chars))
        leaf[:fit, 0], leaf[:fit, 1] = chars[:fit], tokens[:fit]
        if len(chars) > room:  # what doesn't fit is summed in the last leaf, to be encoded anew whole if it is touched
            leaf[-1] += (sum(chars[room:]), sum(tokens[room:]))
        lo, hi = self.size + first, self.size + last
        self.node[lo : hi + 1] = leaf
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            self.node[lo : hi + 1] = self.node[2 * lo : 2 * hi + 2 : 2] + self.node[2 * lo + 1 : 2 * hi + 2 : 2]

    def apply(self, edits: list[Edit]) -> None:
        """Edits given in characters of the text before any of them."""
        for start, end, new in sorted(edits, reverse=True):
            self.edit(start, end, new)


def masking_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), MASK) for m in PRIVATE.finditer(text)]


def count_with_edits(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = masking_edits, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded): tokens of each row's text before and after its edits.

    Edits must not overlap.  One row for every row of ``docs``, repeated ones and null ids too; a null
    text has null counts, an empty one 0 tokens.  n_chars_encoded is how many characters the edits made
    be encoded anew.  Other columns are left out; an empty table gives no rows.
    """

    def f(batches):
        counts = counter(ranks)
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                rows = []
                for text in b.column("text").to_pylist():
                    if text is None:
                        rows.append((None,) * 4)
                        continue
                    edits = edits_of(text)
                    if not edits:
                        n = sum(counts.leaves(text)[1])
                        rows.append((n, 0, n, 0))
                        continue
                    tree = SegmentTree(text, counts)
                    n = tree.n_tokens
                    tree.apply(edits)
                    rows.append((n, len(edits), tree.n_tokens, tree.encoded))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows))], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, f, "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_chars_encoded bigint")


def build_trees(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, text, chars, tokens): the leaves of every row's tree, to be kept in a table beside the text, for edit_trees().

    One row for every row of ``docs``, repeated ones and null ids too; null texts have null leaves, empty ones none.
    Other columns are left out; an empty table gives no rows.
    """
    lists = pa.list_(pa.int32())

    def f(batches):
        counts = counter(ranks)
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                leaves = [(None, None) if t is None else counts.leaves(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array([x for x, _ in leaves], lists), pa.array([y for _, y in leaves], lists)], ["doc_id", "text", "chars", "tokens"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, f, "doc_id bigint, text string, chars array<int>, tokens array<int>")


def edit_trees(trees: DataFrame, edits_of: Callable[[str], list[Edit]] = masking_edits, ranks: str = RANKS) -> DataFrame:
    """build_trees()'s table after edits: (doc_id, text, chars, tokens, n_tokens, n_edits, n_chars_encoded), the kept leaves of what edits don't touch taken over and only their surroundings encoded.

    Every row stays; one with null text or leaves has null counts.  The result can be kept and edited again.
    """
    lists = pa.list_(pa.int32())

    def f(batches):
        counts = counter(ranks)
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                rows = []
                for text, chars, tokens in zip(b.column("text"), b.column("chars"), b.column("tokens")):
                    if not (text.is_valid and chars.is_valid and tokens.is_valid):
                        rows.append((text.as_py(), None, None, None, None, None))
                        continue
                    text, leaves = text.as_py(), (chars.values.to_numpy(), tokens.values.to_numpy())
                    edits = edits_of(text)
                    if not edits:
                        rows.append((text, *leaves, int(leaves[1].sum()), 0, 0))
                        continue
                    tree = SegmentTree(text, counts, leaves)
                    tree.apply(edits)
                    rows.append((tree.text, *tree.leaves(), tree.n_tokens, len(edits), tree.encoded))
                text, chars, tokens, *numbers = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), pa.array(chars, lists), pa.array(tokens, lists), *(pa.array(x, pa.int64()) for x in numbers)], ["doc_id", "text", "chars", "tokens", "n_tokens", "n_edits", "n_chars_encoded"])

    return map_arrow(trees.select("doc_id", "text", "chars", "tokens"), f, "doc_id bigint, text string, chars array<int>, tokens array<int>, n_tokens bigint, n_edits bigint, n_chars_encoded bigint")
