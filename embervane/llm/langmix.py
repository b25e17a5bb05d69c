"""Language mixtures of documents by expectation-maximisation.

A word's likelihood under a language is the product of its byte trigrams' probabilities, learned from
labelled documents; under the background ``und`` every trigram is equally likely.  Expectation-maximisation
finds the proportions of languages that make a document's words most likely, and goes on until the likelihood is
proven to lie within ``GAP`` of its greatest.  Of all sets of languages the one with the greatest likelihood less
its penalty, half the logarithm of the number of words for each language beyond the first, times ``PENALTY``, is the
document's.  No set is more likely than all languages together, so most sets need no run: once the best set found
is as good as any larger one could be, the search ends.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow

#: Documents of each label that the model is trained on at most.
TRAIN_PER_LANGUAGE = 500
#: Rows of the training sample's ids that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_SAMPLE = 100_000
BUCKETS = 1 << 15
PENALTY, SMOOTHING = 4.0, 0.5
#: How far from the greatest log-likelihood expectation-maximisation may stop, in nats; steps between looks at which rows are done.
GAP, LOOK = 0.05, 4
#: A language takes part in sets of two or more where its proportion among all languages is above this.
LEAST_SHARE = 1e-4
#: Languages of a model at most: each has a row of the table that is sent to every executor.
LANGUAGES = 256
UND = "und"


@dataclass
class Model:
    languages: list[str]  # UND is the last
    logp: np.ndarray  # languages x buckets


def word_grams(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram that ends in or just after a word, bounds by word); beyond a word stands a space."""
    start, end, data = words.start, words.end, words.data
    size = end - start + 1
    at = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
    first = np.repeat(start, size)
    pos = first + within
    length = np.repeat(size, size) - 1

    def byte(back: int) -> np.ndarray:
        p = within - back
        x = data[np.clip(pos - back, 0, max(len(data) - 1, 0))].astype(np.uint32)
        return np.where((p >= 0) & (p < length), x, np.uint32(32))

    code = byte(2) * np.uint32(0x9E3779B1) + byte(1) * np.uint32(0x85EBCA77) + byte(0) * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(17)).astype(np.int64), np.concatenate([at, [int(size.sum())]])


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """The model of the ``lang`` values of ``docs``, from at most ``per_language`` whole documents of each, chosen by a hash of their ids."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("doc_id", "lang")
    languages = ids.select("lang").distinct().count()
    if languages > LANGUAGES:
        raise ValueError(f"a model of {languages} languages isn't fitted: there may be {LANGUAGES}")
    if languages * per_language <= BROADCAST_SAMPLE:
        some = F.broadcast(some)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(some, "doc_id")

    def count(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                words = K.split_words(b.column("text"), hashed=False)
                code, at = word_grams(words)
                label, names = np.unique(np.array(b.column("lang").to_pylist(), object), return_inverse=True)
                row = np.repeat(names[words.row], np.diff(at))
                total = np.bincount(row * BUCKETS + code, minlength=len(label) * BUCKETS).reshape(len(label), BUCKETS)
                y, x = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(label[y].tolist(), pa.string()), pa.array(x.astype(np.int32)), pa.array(total[y, x])], ["lang", "gram", "n"])

    counts = map_arrow(texts, count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique().tolist())
    table = np.full((len(names) + 1, BUCKETS), SMOOTHING)
    table[[names.index(x) for x in counts["lang"]], counts["gram"]] += counts["n"]
    table[-1] = 1
    return Model([*names, UND], np.log(table / table.sum(axis=1, keepdims=True)))


def _em(lik: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions: languages x rows, log-likelihood by row) of the allowed languages; lik: languages x words, at: bounds of rows with words.

    The log-likelihood is concave in the proportions, so it lies below its greatest by at most n times (the greatest
    mean ratio of an allowed language, less 1): a row is done where that is under ``GAP``.
    """
    shares = allowed / allowed.sum(axis=0)
    value = np.zeros(len(at) - 1)
    open_rows, n = np.arange(len(at) - 1), np.diff(at)
    while True:
        row = np.repeat(np.arange(len(n)), n)
        share, own_at = shares[:, open_rows], np.concatenate([[0], np.cumsum(n)])[:-1]
        for _ in range(LOOK):
            total = np.einsum("lw,lw->w", lik, share[:, row])
            inverse = 1 / np.maximum(total, 1e-300)
            ratio = np.add.reduceat(lik * inverse, own_at, axis=1) / n
            last, share = share, share * ratio
        shares[:, open_rows] = last
        value[open_rows] = np.add.reduceat(np.log(np.maximum(total, 1e-300)), own_at)
        going = n * ((ratio * (allowed[:, open_rows] > 0)).max(axis=0) - 1) > GAP
        if not going.any():
            return shares, value
        shares[:, open_rows[going]] = share[:, going]
        lik, open_rows, n = lik[:, going[row]], open_rows[going], n[going]


def _best_sets(lik: np.ndarray, at: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Proportions (languages x rows) of each row's best set, ``cost`` being the penalty of a language beyond the first."""
    k, n = len(lik), np.diff(at)
    full, greatest = _em(lik, at, np.ones((k, len(n))))
    singles = np.add.reduceat(np.log(np.maximum(lik, 1e-300)), at[:-1], axis=1)
    best = np.zeros((k, len(n)))
    best[singles.argmax(axis=0), np.arange(len(n))] = 1
    score = singles.max(axis=0)
    for size in range(2, k + 1):
        going = np.flatnonzero(score < greatest + GAP - cost * (size - 1))
        if not len(going):
            break
        words = np.repeat(np.arange(len(n)), n)
        rows_of = np.zeros(len(n), bool)
        rows_of[going] = True
        own, own_at = lik[:, rows_of[words]], np.concatenate([[0], np.cumsum(n[going])])
        for members in itertools.combinations(range(k), size):
            allowed = np.zeros((k, len(going)))
            allowed[list(members)] = 1
            if size == k:
                share, value = full[:, going], greatest[going]
            else:
                # a set of languages that full proportions leave out can't be told from smaller ones
                some = full[list(members)][:, going].min(axis=0) > LEAST_SHARE
                if not some.any():
                    continue
                pick = np.flatnonzero(some)
                take = some[np.repeat(np.arange(len(going)), n[going])]
                share, value = np.zeros((k, len(going))), np.full(len(going), -np.inf)
                share[:, pick], value[pick] = _em(own[:, take], np.concatenate([[0], np.cumsum(n[going][pick])]), allowed[:, pick])
            better = value - cost[going] * (size - 1) > score[going]
            best[:, going[better]] = share[:, better]
            score[going[better]] = (value - cost[going] * (size - 1))[better]
    return best


def mixtures(texts: pa.Array, model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(shares: languages x rows, 0 for languages outside the chosen set; words by row)."""
    words = K.split_words(texts, hashed=False)
    count = np.diff(words.at)
    shares = np.zeros((len(model.languages), len(count)))
    some = np.flatnonzero(count)
    if not len(some):
        return shares, count
    code, g_at = word_grams(words)
    log = np.stack([np.add.reduceat(p[code], g_at[:-1]) for p in model.logp])
    top = log.max(axis=0)
    lik = np.exp(log - top)
    # a language's likelihood of a word stays above 0 in floating point
    shares[:, some] = _best_sets(np.maximum(lik, 1e-280), np.concatenate([[0], np.cumsum(count[some])]), penalty / 2 * np.log(count[some]))
    return shares, count


def rejected(shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rows that are in no language of the model: without words, or the background's by half or more."""
    return (words == 0) | (shares[-1] >= 0.5)


def identify(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, language, share, languages, n_words, rejected) of every row, repeated rows and null ids too.

    ``languages`` are the chosen set's (language, share) by descending share, ties by name; language and
    share are the first's.  A null, empty or wordless text has no languages, 0 words, and is rejected.  Sets that
    are equally good go to the smaller one, then the one whose names come first.
    Other columns are left out.  Without a model, one is trained on the table's own labels; an empty table
    gives no rows.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())]))

    def f(batches):
        names = shared.value.languages
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                shares, words = mixtures(b.column("text"), shared.value, penalty)
                order = np.argsort(-shares, axis=0, kind="stable").T.tolist()
                lists = [[{"language": names[k], "share": float(s[k])} for k in o if s[k] > 0] for o, s in zip(order, shares.T)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([x[0]["language"] if x else None for x in lists], pa.string()), pa.array([x[0]["share"] if x else None for x in lists], pa.float64()), pa.array(lists, kind), pa.array(words.astype(np.int32)), pa.array(rejected(shares, words))],
                    ["doc_id", "language", "share", "languages", "n_words", "rejected"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, f, "doc_id bigint, language string, share double, languages array<struct<language:string,share:double>>, n_words int, rejected boolean")


def in_known_languages(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that aren't rejected.

    Null, empty and wordless texts are rejected, whatever their label; rows with null ids or labels are judged by
    their text alone, and of repeated rows all stay or all go.  A very long text is judged whole.  Where no row has a
    label there is no language but the background, and every row is rejected; an empty table stays empty.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                yield b.filter(pa.array(~rejected(*mixtures(b.column("text"), shared.value, penalty))))

    return map_arrow(docs, f, docs.schema)
