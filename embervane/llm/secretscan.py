"""Secrets found by character Markov models.

Candidates are maximal runs of ``LEAST`` or more characters of A-Z a-z 0-9 + / _ -.  Each class of labelled
samples gives a second-order Markov model: random strings by alphabet (hexadecimal, base32, base62, base64),
and ordinary words, identifiers and numbers.  What is scored in a run is its best segment, that of the greatest
sum of the characters' log-likelihood ratios, so ordinary characters about a secret (paths, names) don't outweigh
it; what is left of the run on either side is searched in turn.  A segment is a secret where the likelihood under
random strings exceeds that under ordinary ones by ``BAR`` nats, and by ``CUT`` or ``INNER_CUT`` for each of its
ends that isn't an end of the run; either side is the mean over its classes.  A run that passes as a whole stays
one secret unless the segment scores twice ``BAR`` more.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow

LEAST, BAR = 12, 10.0
#: What an end of a segment within a run costs, in nats: beside one of + / _ -, and between letters and digits.
CUT, INNER_CUT = 3.0, 8.0
#: Random strings generated for each alphabet, and documents whose words are taken as ordinary samples at most.
RANDOM_SAMPLES, ORDINARY_DOCS = 4000, 1000
#: Labelled samples that are read for each label, and labels, at most.
PER_LABEL, MOST_LABELS = 20_000, 64
REDACTED = "[SECRET]"

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
END = len(ALPHABET)
WIDTH = END + 1
RANDOM = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "upper": string.ascii_uppercase + string.digits, "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_"}
ORDINARY = ("word", "identifier", "number")

_CODE = np.full(256, END, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_IN = _CODE < END
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in "+/_-"]] = True


@dataclass
class Models:
    random: np.ndarray  # classes x WIDTH ** 3 log-probabilities
    ordinary: np.ndarray
    names: list[str]


def _fit(samples: list[str], smoothing: float) -> np.ndarray:
    """Second-order model, each context smoothed towards the first-order one, that towards the counts of characters."""
    code = [np.concatenate([[END, END], _CODE[np.frombuffer(s.encode(), np.uint8)]]) for s in samples if s]
    counts = np.zeros(WIDTH**3)
    for c in code:
        np.add.at(counts, (c[:-2] * WIDTH + c[1:-1]) * WIDTH + c[2:], 1)
    counts = counts.reshape(WIDTH, WIDTH, WIDTH)
    one = counts.sum(axis=(0, 1)) + smoothing
    one /= one.sum()
    two = counts.sum(axis=0) + 20 * one
    two /= two.sum(axis=1, keepdims=True)
    three = counts + 20 * two
    return np.log(three / three.sum(axis=2, keepdims=True)).ravel()


#: A labelled sample: (class, whether the class is of secrets, text).
Sample = tuple[str, bool, str]


def made_samples(words: list[str]) -> list[Sample]:
    """Labelled samples for want of others: random strings of each alphabet, from a fixed seed, and ``words`` alone, joined to identifiers, and numbers."""
    rng = np.random.Generator(np.random.PCG64(4))
    out: list[Sample] = []
    for name, chars in RANDOM.items():
        letters = np.array(list(chars))
        out += [(name, True, "".join(letters[rng.integers(0, len(letters), n)])) for n in rng.integers(12, 65, RANDOM_SAMPLES)]
    words = sorted({w for w in words if w}) or ["name", "value", "index"]
    pick = lambda: words[int(rng.integers(len(words)))]
    out += [("word", False, w) for w in words]
    for _ in range(20_000):
        parts = [pick() for _ in range(int(rng.integers(2, 5)))]
        style = rng.integers(6)
        s = {0: "_".join(parts), 1: "-".join(parts), 2: parts[0].lower() + "".join(p.capitalize() for p in parts[1:]), 3: "/".join(parts), 4: "_".join(parts).upper(), 5: parts[0]}[int(style)]
        out.append(("identifier", False, s + str(rng.integers(0, 10_000)) * int(rng.integers(3) == 0)))
    for _ in range(5000):
        n = "".join(map(str, rng.integers(0, 10, int(rng.integers(4, 24)))))
        style = rng.integers(4)
        out.append(("number", False, n if style else "-".join(n[i : i + 4] for i in range(0, len(n), 4)) if rng.integers(2) else f"20{n[:2]}-{n[2:4]}-{n[4:6]}" + ("T" if rng.integers(2) else "/") + n))
    return out


def fit_models(samples: list[Sample]) -> Models:
    """A model for each class of labelled samples; there must be classes of secrets and ordinary ones."""
    by: dict[tuple[bool, str], list[str]] = {}
    for label, secret, text in samples:
        by.setdefault((secret, label), []).append(text)
    names = [label for secret, label in by if secret]
    ordinary = [_fit(own, 1e-2) for (secret, _), own in by.items() if not secret]
    if not names or not ordinary:
        raise ValueError("samples of secrets and ordinary ones are needed")
    return Models(np.stack([_fit(by[True, label], 1e-3) for label in names]), np.stack(ordinary), names)


def train(docs: DataFrame, most_docs: int = ORDINARY_DOCS, samples: DataFrame | None = None) -> Models:
    """Models of labelled samples (label, secret, text), at most ``PER_LABEL`` of each label by a hash of their text; without such a table, of made_samples() with the letter-only words of at most ``most_docs`` documents, chosen by a hash of their ids."""
    if samples is not None:
        from pyspark.sql.window import Window

        own = samples.select(F.col("label").cast("string").alias("label"), F.col("secret").cast("boolean").alias("secret"), F.col("text").cast("string").alias("text")).dropna().distinct()
        if own.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
            raise ValueError(f"there may be {MOST_LABELS} labels")
        order = Window.partitionBy("label").orderBy(F.xxhash64("text"), "text")
        return fit_models(sorted(tuple(r) for r in own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LABEL).drop("k").toLocalIterator()))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,30}(?![A-Za-z0-9+/_-])"), 0))).alias("w")).distinct()
    return fit_models(made_samples([r[0] for r in words.orderBy("w").collect()]))


def _scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood ratio, likeliest random class) of byte ranges, each as if it stood alone."""
    idx, first, key = _keys(data, start, end)
    random = np.stack([np.add.reduceat(m[key], first) for m in models.random])
    ordinary = np.stack([np.add.reduceat(m[key], first) for m in models.ordinary])
    return np.logaddexp.reduce(random, axis=0) - np.log(len(random)) - np.logaddexp.reduce(ordinary, axis=0) + np.log(len(ordinary)), random.argmax(axis=0)


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each byte of the ranges, first of each range among them, index into a model)."""
    size = end - start
    first = np.cumsum(size) - size
    idx = np.arange(int(size.sum())) + np.repeat(start - first, size)
    within = np.arange(len(idx)) - np.repeat(first, size)
    c0 = _CODE[data[idx]]
    c1 = np.where(within >= 1, _CODE[data[np.maximum(idx - 1, 0)]], END)
    c2 = np.where(within >= 2, _CODE[data[np.maximum(idx - 2, 0)]], END)
    return idx, first, (c2 * WIDTH + c1) * WIDTH + c0


def _best_segments(data: np.ndarray, start: np.ndarray, end: np.ndarray, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, ratio less costs) of the segment of ``LEAST`` bytes or more of each range with the greatest ratio less costs under any random class, each stretch without + / _ - under the ordinary one likeliest for it."""
    idx, first, key = _keys(data, start, end)
    size = end - start
    run = np.repeat(np.arange(len(size)), size)
    n = np.arange(len(idx))
    joint = _JOINT[data[idx]]
    new = joint.copy()
    new[1:] |= joint[:-1]
    new[first] = True
    pieces = np.flatnonzero(new)
    likeliest = np.stack([np.add.reduceat(m[key], pieces) for m in models.ordinary]).argmax(axis=0)
    ordinary = models.ordinary[np.repeat(likeliest, np.diff(np.append(pieces, len(idx)))), key]
    opens, closes = np.full(len(idx), INNER_CUT), np.full(len(idx), INNER_CUT)
    opens[1:][joint[:-1] | joint[1:]] = CUT
    closes[:-1][joint[1:] | joint[:-1]] = CUT
    opens[first] = closes[first + size - 1] = 0
    late = n - np.repeat(first, size) >= LEAST - 1
    best, a, b = np.full(len(size), -np.inf), start.copy(), end.copy()
    for m in models.random:
        ratio = m[key] - ordinary
        total = np.cumsum(ratio)
        total -= np.repeat(total[first] - ratio[first], size)
        open_at = total - ratio + opens
        # each range lies below all before it, so none of those is the least
        open_at -= run * (np.ptp(open_at) + 1)
        least = np.minimum.accumulate(open_at)
        where = np.maximum.accumulate(np.where(np.concatenate([[True], least[1:] < least[:-1]]), n, 0))
        begin = where[np.maximum(n - LEAST + 1, 0)]
        value = np.where(late, total - closes - (total - ratio + opens)[begin], -np.inf)
        top = np.maximum.reduceat(value, first)
        j = np.flatnonzero(value == top[run])
        j = j[np.unique(run[j], return_index=True)[1]]
        more = top > best
        best[more], a[more], b[more] = top[more], idx[begin[j]][more], idx[j][more] + 1
    return a, b, best


def secret_segments(data: np.ndarray, start: np.ndarray, end: np.ndarray, models: Models, bar: float = BAR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, size, score, class) of the secrets in ascending disjoint runs of bytes; one whose end cuts letters and digits takes all of them."""
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0), none)]
    whole = True
    while True:
        long = end - start >= LEAST
        start, end = start[long], end[long]
        if not len(start):
            break
        a, b, best = _best_segments(data, start, end, models)
        score, kind = _scores(data, a, b, models)
        hit = np.minimum(best, score) >= bar
        if whole:
            # later rounds search parts of runs that have a secret
            all_score, all_kind = _scores(data, start, end, models)
            only = (all_score >= bar) & ~(hit & (score >= all_score + 2 * bar))
            hit &= ~only
            found.append((start[only], end[only], all_score[only], all_kind[only]))
            whole = False
        start, end, a, b, score, kind = (x[hit] for x in (start, end, a, b, score, kind))
        if not len(a):
            break
        a, b = _to_joints(data, start, end, a, b)
        found.append((a, b, score, kind))
        start, end = np.concatenate([start, b]), np.concatenate([a, end])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    start, end, score, kind = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    start, end, score, kind = start[order], end[order], score[order], kind[order]
    return start, end, end - start, score, kind


def _to_joints(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments widened to where letters and digits end, within their ranges."""
    joints = np.flatnonzero(_JOINT[data])
    if len(joints):
        k = np.searchsorted(joints, a)
        before = np.where(k > 0, joints[np.maximum(k - 1, 0)] + 1, 0)
        a = np.where(_JOINT[data[a]], a, np.maximum(start, before))
        k = np.searchsorted(joints, b)
        after = np.where(k < len(joints), joints[np.minimum(k, len(joints) - 1)], len(data))
        b = np.where(_JOINT[data[b - 1]], b, np.minimum(end, after))
        return a, b
    return start, end


def scan(texts: pa.Array, models: Models, bar: float = BAR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte in its row, first character in its row, length, score, class) of the secrets."""
    data, at = K.buffers(texts)
    n = len(data)
    ok = _IN[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    step = np.zeros(n + 1, np.int8)
    step[1:n] = ok[1:] != ok[:-1] if n else 0
    change = np.flatnonzero((step != 0) | edge)
    start = change[:-1][ok[change[:-1]]] if n else change[:0]
    end = change[1:][ok[change[:-1]]] if n else start
    start, end, size, score, kind = secret_segments(data, start, end, models, bar)
    row = np.searchsorted(at, start, "right") - 1
    # rows that are empty share a bound with the next; the last of them is the one that holds the byte
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return row, start - at[row], chars[start] - chars[at[row]], size, score, kind


def find_secrets(docs: DataFrame, models: Models | None = None, bar: float = BAR) -> DataFrame:
    """(doc_id, start, length, kind, score): every secret of every row; start counts characters from 0, kind is the likeliest alphabet.

    Rows with null ids or texts and texts without runs of ``LEAST`` characters give none; repeated rows give theirs each
    time.  The secret itself isn't returned.  Other columns are ignored; an empty table gives no rows.
    """
    models = models or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                row, _, start, size, score, kind = scan(b.column("text"), shared.value, bar)
                names = np.array(shared.value.names, object)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size.astype(np.int32)), pa.array(names[kind].tolist(), pa.string()), pa.array(np.round(score, 6))], ["doc_id", "start", "length", "kind", "score"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return map_arrow(own, f, "doc_id bigint, start bigint, length int, kind string, score double")


def redact(docs: DataFrame, models: Models | None = None, bar: float = BAR) -> DataFrame:
    """``docs`` with ``REDACTED`` in place of every secret; n_chars, where there is such a column, is the new length.

    All rows and other columns stay as they are: null and empty texts, null ids, repeated rows, texts without runs
    of ``LEAST`` characters, which aren't scored.  A very long text is searched whole; an empty table stays empty.
    """
    models = models or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns

    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                row, start, _, size, _, _ = scan(b.column("text"), shared.value, bar)
                if len(row):
                    texts = b.column("text").to_pylist()
                    for r, s, n in zip(row[::-1].tolist(), start[::-1].tolist(), size[::-1].tolist()):
                        raw = texts[r].encode() if isinstance(texts[r], str) else texts[r]
                        texts[r] = raw[:s] + REDACTED.encode() + raw[s + n :]
                    changed = {r: texts[r].decode() for r in set(row.tolist())}
                    texts = [changed.get(r, t) for r, t in enumerate(texts)]
                    columns = dict(zip(names, b.columns))
                    columns["text"] = pa.array(texts, b.column("text").type)
                    if "n_chars" in columns:
                        chars = columns["n_chars"].to_pylist()
                        for r, t in changed.items():
                            chars[r] = len(t)
                        columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
                    b = pa.RecordBatch.from_arrays([columns[c] for c in names], names)
                yield b

    return map_arrow(docs, f, docs.schema)
