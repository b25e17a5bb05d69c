"""Templates of web pages from equivalence classes of tokens, and what their slots hold.

A page is a sequence of tokens: tags (attribute values that vary with content left out) and the words between
them, a word being told from the same word under another tag.  Tokens of a host's pages that occur equally often
in every page, those with one occurrence vector, are an equivalence class.  Classes of two tokens or more, in at
least ``SUPPORT`` of the pages, may be part of the template; a class is valid where its tokens keep one order in all
pages (tokens that break it are dropped, the worst first).  Classes that occur just once in ``SUPPORT`` of the pages
are nested in each other, the most frequent first: one goes in where none of its tokens changes places with those
already there, and together they are the skeleton.  Valid classes that recur within a page are nested in the gaps of
the skeleton, as records: each occurrence of their tokens bounds slots like the skeleton's.  What the template leaves
of a page are its slots.

No host is ever gathered in one place.  Partitions tell the tokens frequent in their own pages, with their counts,
and only tokens that can still be frequent in all pages are counted and ordered exactly; the sums by host are added
up as a stream, first by a salt, then by host, and joined back to the pages: by a broadcast of checked size, else by
host and a salt that cuts large hosts.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow
from embervane.session import staged

SUPPORT, LEAST_PAGES = 0.8, 3
#: A partition tells the tokens in this share of its own pages of a host.
LOCAL = 0.6
#: Tokens of all hosts that are sent to every executor at most (8 bytes each); more are joined by a shuffle.
BROADCAST_TOKENS = 2_000_000
#: Pages of a host that one salt takes where pages are joined by a shuffle; salts that sums by host are added up by first.
SALT_PAGES, SALTS = 20_000, 32
#: Orders of tokens that a host's sums remember, so as not to enter them again.
REMEMBERED = 4096

_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_VARYING = r"""(?i)\s(?:href|src|srcset|content|alt|title|value|lang|style|data-[\w-]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens:
    """The tokens of a run of pages."""

    def __init__(self, pages: pa.Array):
        text = pc.replace_substring_regex(pc.replace_substring_regex(pages, _UNSEEN, " "), _VARYING, "")
        data, at = K.buffers(text)
        n = len(data)
        opens, closes = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        after = data[np.minimum(opens + 1, max(n - 1, 0))] if n else opens
        letter = ((after | 32) >= 97) & ((after | 32) <= 122) | (after == 47) | (after == 33)
        opens = opens[letter & (opens + 1 < n)]
        k = np.searchsorted(closes, opens)
        opens, k = opens[k < len(closes)], k[k < len(closes)]
        k, first = np.unique(k, return_index=True)
        opens, ends = opens[first], closes[k] + 1
        same = np.searchsorted(at, opens, "right") == np.searchsorted(at, ends - 1, "right")
        opens, ends = opens[same], ends[same]
        inside = np.zeros(n + 1, np.int8)
        inside[opens] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside)[:n].astype(bool)
        word = ~inside & ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before, nxt = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], nxt[:-1] = word[:-1], word[1:]
        start = np.flatnonzero(word & ~(before & ~edge[:n]))
        end = np.flatnonzero(word & ~(nxt & ~edge[1:])) + 1
        every = np.concatenate([opens, start])
        order = np.argsort(every, kind="stable")
        self.start = every[order]
        self.end = np.concatenate([ends, end])[order]
        self.tag = order < len(opens)
        self.plain = np.where(inside, np.uint8(32), data)
        self.at = np.searchsorted(self.start, at)
        self.row_at = at
        h = K.hash_ranges(data, self.start, self.end)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.at))
        last = np.maximum.accumulate(np.where(self.tag, np.arange(len(h)), -1)) if len(h) else np.zeros(0, np.int64)
        context = np.where(last >= self.at[:-1][self.row], h[np.maximum(last, 0)], K.U64(1)) if len(h) else h
        self.id = np.where(self.tag, h, K.mix(h ^ (context * K.U64(0x9E3779B97F4A7C15)))).view(np.int64)

    def text(self, a: int, b: int) -> str:
        return " ".join(entities.unescape(self.plain[a:b].tobytes().decode("utf-8", "replace")).split())


def _by_host(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    host = np.array(batch.column("host").to_pylist(), object)
    order = np.argsort(host, kind="stable")
    cut = np.flatnonzero(host[order][1:] != host[order][:-1]) + 1
    for rows in np.split(order, cut):
        yield host[rows[0]], np.sort(rows)


def _rows_tokens(t: Tokens, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the tokens of some rows, the rows' ordinal of each)."""
    n = np.diff(t.at)[rows]
    idx = np.arange(int(n.sum())) + np.repeat(t.at[rows] - (np.cumsum(n) - n), n)
    return idx, np.repeat(np.arange(len(rows)), n)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, pages, tokens, counts) of this partition: tokens in ``LOCAL`` of its own pages of the host, and in how many."""
    pages: dict[str, int] = {}
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(host: str) -> tuple[np.ndarray, np.ndarray]:
        token, back = np.unique(np.concatenate([x for x, _ in found[host]]), return_inverse=True)
        return token, np.bincount(back, np.concatenate([n for _, n in found[host]])).astype(np.int64)

    for batch in batches:
        for b in K.text_slices(batch, "html"):
            t = Tokens(b.column("html"))
            for host, rows in _by_host(b):
                idx, own = _rows_tokens(t, rows)
                pair = np.unique(np.stack([t.id[idx], own]), axis=1)[0] if len(idx) else np.zeros(0, np.int64)
                pages[host] = pages.get(host, 0) + len(rows)
                found.setdefault(host, []).append(np.unique(pair, return_counts=True))
                if len(found[host]) > 16:
                    token, n = merged(host)
                    found[host] = [(token, n)]
    hosts = list(pages)
    tokens, counts = [], []
    for host in hosts:
        token, n = merged(host)
        enough = n >= LOCAL * pages[host] - 1e-9
        tokens.append(token[enough])
        counts.append(n[enough])
    lists = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([pages[h] for h in hosts], pa.int64()), pa.array(tokens, lists), pa.array(counts, lists)], ["host", "pages", "tokens", "counts"])


def _candidates(frequent: DataFrame) -> DataFrame:
    """(host, pages, tokens) from the partitions' (host, pages, tokens, counts): the tokens that may be in ``SUPPORT`` of the host's pages, taking them to be in almost ``LOCAL`` of the pages of partitions that don't tell them."""
    pages = frequent.groupBy("host").agg(F.sum("pages").alias("all"))
    each = frequent.select("host", "pages", F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("host", F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n"), F.sum("pages").alias("told"))
    may = each.join(pages, "host").where(F.col("n") + LOCAL * (F.col("all") - F.col("told")) >= SUPPORT * F.col("all") - 1e-6)
    lists = may.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return pages.join(lists, "host", "left").select("host", F.col("all").alias("pages"), F.coalesce("tokens", F.array().cast("array<bigint>")).alias("tokens"))


class Sums:
    """Of a host's candidate tokens: two prints of the occurrence vector, and in how many pages, how often, in how many pages just once, whether a tag; which was ever first before which."""

    def __init__(self, tokens: np.ndarray):
        m = len(tokens)
        self.tokens = tokens
        self.prints = np.zeros((2, m), np.uint64)
        self.counts = np.zeros((4, m), np.int64)
        self.before = np.zeros((m, m), bool)
        self.orders: set[int] = set()

    def add_pages(self, t: Tokens, rows: np.ndarray, page: np.ndarray) -> None:
        m = len(self.tokens)
        idx, own = _rows_tokens(t, rows)
        k = np.minimum(np.searchsorted(self.tokens, t.id[idx]), m - 1)
        hit = self.tokens[k] == t.id[idx]
        idx, own, k = idx[hit], own[hit], k[hit]
        counts = np.bincount(own * m + k, minlength=len(rows) * m).reshape(len(rows), m)
        first = np.full(len(rows) * m, np.iinfo(np.int64).max)
        np.minimum.at(first, own * m + k, idx)
        first = first.reshape(len(rows), m)
        seed = page[rows][:, None] + counts.astype(np.uint64) * K.U64(0xD1B54A32D192ED03)
        for j in (0, 1):
            self.prints[j] += np.where(counts > 0, K.mix(seed ^ K.U64(0x5851F42D4C957F2D * j)), K.U64(0)).sum(axis=0, dtype=np.uint64)
        self.counts[0] += (counts > 0).sum(0)
        self.counts[1] += counts.sum(0)
        self.counts[2] += (counts == 1).sum(0)
        np.maximum.at(self.counts[3], k, t.tag[idx].astype(np.int64))
        for f in first:
            there = np.flatnonzero(f < np.iinfo(np.int64).max)
            there = there[np.argsort(f[there])]
            order = hash(there.tobytes())
            if order in self.orders:
                continue
            if len(self.orders) >= REMEMBERED:
                self.orders.clear()
            self.orders.add(order)
            for i, x in enumerate(there[:-1]):
                self.before[x, there[i + 1 :]] = True

    def add(self, prints: np.ndarray, counts: np.ndarray, before: np.ndarray) -> None:
        self.prints += prints
        self.counts[:3] += counts[:3]
        np.maximum(self.counts[3], counts[3], out=self.counts[3])
        self.before |= before

    @staticmethod
    def batch(each: list[tuple[str, int, Sums]]) -> pa.RecordBatch:
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _, _ in each], pa.string()), pa.array([n for _, n, _ in each], pa.int64()), pa.array([s.tokens for _, _, s in each], lists), pa.array([s.prints.view(np.int64).ravel() for _, _, s in each], lists), pa.array([s.counts.ravel() for _, _, s in each], lists), pa.array([np.packbits(s.before).tobytes() for _, _, s in each], pa.binary())],
            ["host", "pages", "tokens", "prints", "counts", "before"],
        )


SUMS = "host string, pages bigint, tokens array<bigint>, prints array<bigint>, counts array<bigint>, before binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of this partition's pages by host."""
    state: dict[str, tuple[int, Sums]] = {}
    for batch in batches:
        for b in K.text_slices(batch, "html"):
            t = Tokens(b.column("html"))
            page = K.mix(b.column("uid").to_numpy().view(np.uint64))
            for host, rows in _by_host(b):
                if host not in state:
                    state[host] = b.column("pages")[int(rows[0])].as_py(), Sums(np.array(b.column("tokens")[int(rows[0])].as_py(), np.int64))
                if len(state[host][1].tokens):
                    state[host][1].add_pages(t, rows, page)
    for host, (n, s) in state.items():
        yield Sums.batch([(host, n, s)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Sums]]:
    """The sums of each host of batches sorted by host; one host's are held at a time."""
    name, pages, total = None, 0, None
    for b in batches:
        for r in range(b.num_rows):
            host = b.column("host")[r].as_py()
            if host != name:
                if total is not None:
                    yield name, pages, total
                name, pages, total = host, b.column("pages")[r].as_py(), Sums(b.column("tokens")[r].values.to_numpy())
            m = len(total.tokens)
            before = np.unpackbits(np.frombuffer(b.column("before")[r].as_py(), np.uint8), count=m * m).astype(bool).reshape(m, m)
            total.add(b.column("prints")[r].values.to_numpy().view(np.uint64).reshape(2, m), b.column("counts")[r].values.to_numpy().reshape(4, m), before)
    if total is not None:
        yield name, pages, total


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _added(batches):
        yield Sums.batch([x])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, pages, s in _added(batches):
        skeleton, nested = build_template(s, pages)
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([pages], pa.int64()), pa.array([skeleton], pa.list_(pa.int64())), pa.array([nested], pa.list_(pa.list_(pa.int64())))], ["host", "pages", "skeleton", "nested"])


def build_template(s: Sums, pages: int) -> tuple[list[int], list[list[int]]]:
    """(skeleton in its order, nested classes in theirs) from the sums over all pages of a host."""
    if pages < LEAST_PAGES or not len(s.tokens):
        return [], []
    in_pages, total, once, tag = s.counts
    enough = in_pages >= SUPPORT * pages - 1e-9
    single = enough & (once >= SUPPORT * pages - 1e-9)
    swaps = s.before & s.before.T

    def ordered(members: np.ndarray) -> np.ndarray:
        conflict = swaps[np.ix_(members, members)]
        alive = np.ones(len(members), bool)
        while True:
            bad = (conflict & alive[None, :]).sum(1) * alive
            if not bad.any():
                break
            alive[len(bad) - 1 - int(bad[::-1].argmax())] = False
        return by_place(members[alive])

    def by_place(members: np.ndarray) -> np.ndarray:
        return members[np.argsort(-s.before[np.ix_(members, members)].sum(1), kind="stable")]

    classes: dict[tuple, list[int]] = {}
    for j in np.flatnonzero(enough):
        classes.setdefault((int(s.prints[0, j]), int(s.prints[1, j]), int(in_pages[j]), int(total[j])), []).append(int(j))
    every = [np.array(c) for c in classes.values() if len(c) > 1]
    skeleton = np.zeros(0, np.int64)
    for own in sorted((c for c in every if single[c[0]]), key=lambda c: (-in_pages[c[0]], -len(c), s.tokens[c[0]])):
        own = ordered(own)
        if len(own) > 1 and not swaps[np.ix_(own, skeleton)].any():
            skeleton = np.concatenate([skeleton, own])
    if not len(skeleton):
        return [], []
    skeleton = by_place(skeleton)
    nested = [ordered(c) for c in every if not single[c[0]] and tag[c].any()]
    nested = [c for c, whole in zip(nested, (c for c in every if not single[c[0]] and tag[c].any())) if len(c) == len(whole)]
    return s.tokens[skeleton].tolist(), [s.tokens[c].tolist() for c in sorted(nested, key=lambda c: int(s.tokens[c[0]]))]


def page_slots(t: Tokens, row: int, skeleton: list[int], nested: list[list[int]]) -> list[dict]:
    """The slots of a page, in its order: number of the template's token before it (0: none), and its text.  The skeleton's tokens are numbered first, then those of the nested classes; a record gives one slot for each of its gaps that holds text."""
    a, b = int(t.at[row]), int(t.at[row + 1])
    ids = t.id[a:b]
    marks = [(0, int(t.row_at[row]), int(t.row_at[row]))]
    found, first = np.unique(ids, return_index=True)
    where = dict(zip(found.tolist(), first.tolist()))
    here = [(where[token], k) for k, token in enumerate(skeleton, 1) if token in where]
    inner = [token for c in nested for token in c]
    number = {token: k for k, token in enumerate(inner, len(skeleton) + 1)}
    here += [(i, number[int(ids[i])]) for i in np.flatnonzero(np.isin(ids, np.array(inner, np.int64))).tolist()]
    for i, r in sorted(here):
        marks.append((r, int(t.start[a + i]), int(t.end[a + i])))
    out = []
    for k, (r, _, x) in enumerate(marks):
        y = marks[k + 1][1] if k + 1 < len(marks) else int(t.row_at[row + 1])
        text = t.text(x, y)
        if text:
            out.append({"slot": r, "items": [text]})
    return out


def extract_slots(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, template_tokens, slots) of every page; slots are (slot, items), numbered alike in all pages of a host.

    Every row gives one row.  Comments, scripts and styles are left out, entities resolved, white space
    joined.  A null page has null slots, an empty one none.  Pages of fewer than LEAST_PAGES of a host, of
    a null or unreadable URL, or of a host without a valid skeleton have no template: all their text is slot
    0.  Repeated rows count as pages of their own: they weigh on what is frequent, and change no class.  A
    very long page is taken whole.  Other columns are left out; an empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("host", F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit(""))).withColumn("uid", F.xxhash64("page_id", "url", "html"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = own.where("html IS NOT NULL AND host <> ''")
    told = staged(map_arrow(known.select("host", "html"), _frequent, "host string, pages bigint, tokens array<bigint>, counts array<bigint>"), "frequent")
    frequent = staged(_candidates(told), "candidates")
    few = frequent.agg(F.sum(1 + F.size("tokens"))).first()[0] or 0
    with_tokens = _with_host(known.select("host", "html", "uid"), frequent, few)
    sums = map_arrow(with_tokens.select("host", "html", "uid", "pages", "tokens"), _vectors, SUMS)
    sums = sums.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(parts, "host", "__salt").drop("__salt").sortWithinPartitions("host")
    sums = map_arrow(sums, _salted, SUMS)
    templates = map_arrow(sums.repartition(parts, "host").sortWithinPartitions("host"), _templates, "host string, pages bigint, skeleton array<bigint>, nested array<array<bigint>>")
    templates = staged(templates, "templates")
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("items", pa.list_(pa.string()))]))

    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "html"):
                t = Tokens(b.column("html"))
                skeletons, nested = b.column("skeleton"), b.column("nested")
                slots: list = []
                sizes: list = []
                for row in range(b.num_rows):
                    skeleton = skeletons[row].as_py() or []
                    sizes.append(len(skeleton))
                    slots.append(page_slots(t, row, skeleton, nested[row].as_py() or []) if b.column("html")[row].is_valid else None)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(sizes, pa.int32()), pa.array(slots, kind)], ["page_id", "url", "host", "template_tokens", "slots"])

    joined = _with_host(own, templates, few).select("page_id", "url", "host", "html", "skeleton", "nested")
    return map_arrow(joined, f, "page_id bigint, url string, host string, template_tokens int, slots array<struct<slot:int,items:array<string>>>")


def _with_host(own: DataFrame, by_host: DataFrame, tokens: int) -> DataFrame:
    """Pages with their host's columns: by a broadcast where all hosts have few tokens; else by host and salt, a host of many pages having as many salts as it has ``SALT_PAGES``."""
    if tokens <= BROADCAST_TOKENS:
        return own.join(F.broadcast(by_host), "host", "left")
    salts = F.ceil(F.col("pages") / SALT_PAGES).cast("int")
    # hosts of one salt need no lookup of their number of salts; those of more are few, a SALT_PAGES-th of the pages at most
    large = by_host.where(salts > 1).select("host", salts.alias("__salts"))
    own = own.join(large, "host", "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.col("uid"), F.col("__salts")).cast("int")).when(F.col("host") == "", -1 - F.pmod(F.col("uid"), F.lit(4096)).cast("int")).otherwise(0)).drop("__salts")
    return own.join(by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))), ["host", "__salt"], "left").drop("__salt")
