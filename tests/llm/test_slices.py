import random

import numpy as np
import pyarrow as pa
import pytest

from embervane.llm import kernel as K
from embervane.llm import ngram_join, slices


def joined(sets, t, batch=7):
    """The root of each set after slice_links()' two steps."""
    g, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    blobs = pa.Table.from_batches(list(slices.sliced(2, t, lambda *_: (g, at), ngram_join.set_prints)([pa.RecordBatch.from_pydict({"text": ["x"]})])))
    nodes, known = np.unique(ngram_join.set_prints(g, at), return_inverse=True)
    forest = ngram_join.Forest(len(nodes))
    for b in slices._slice_links(t, ngram_join.Forest)(iter(blobs.sort_by("at").to_batches(max_chunksize=batch))):
        forest.link(*(np.searchsorted(nodes, b.column(k).to_numpy()) for k in (0, 1)))
    return forest.parent[known]


def sampled(rng, t):
    """Sets of many sizes with others at and about the threshold: contained, containing and of equal size."""
    pool, out = [rng.getrandbits(64) for _ in range(3000)], []
    for _ in range(50):
        n = rng.choice([1, 2, 3, 4, 5, 7, 12, 25, 40, 63, 64, 100, 130, 300, 700])
        base = rng.sample(pool[: max(2 * n, 50)] if rng.random() < 0.5 else pool, n)
        out.append(base)
        for _ in range(6):
            kind, more = rng.randrange(3), lambda k: [rng.getrandbits(64) for _ in range(k)]
            e = int(n * (1 - t) / (1 + t) + 1e-9) if kind == 2 else int(n * (1 - t) + 1e-9)
            out.append((base[: n - e], base + more(int(n * (1 / t - 1) + 1e-9)), base[e:] + more(e))[kind])
    return [np.unique(np.array(s, np.uint64)) for s in out]


@pytest.mark.parametrize("t", [0.4, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("small", [False, True])
def test_no_pair_at_the_threshold_is_lost(t, small, monkeypatch):
    if small:
        for name, value in {"GATHERED": 3000, "ROWS": 16, "KEYS": 64, "PAIRS": 32, "COUNTERS": 64}.items():
            monkeypatch.setattr(slices, name, value)
    sets = sampled(random.Random(int(10 * t)), t)
    root, own, pairs = joined(sets, t), [set(s.tolist()) for s in sets], 0
    for i, a in enumerate(own):
        for j in range(i):
            both = len(a & own[j])
            if both / (len(a) + len(own[j]) - both) >= t:
                pairs += 1
                assert root[i] == root[j]
    assert pairs > 300 and len(np.unique(root)) > 20


def test_sets_in_many_slices_of_frequent_ngrams_are_joined(monkeypatch):
    """Runs of more than 1,024 rows are taken in blocks."""
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([pool[:2], rng.choice(pool[2:], 8, replace=False)])) for _ in range(1500)]
    root, hit = joined(sets, 0.6), 0
    has = np.stack([np.isin(pool, s) for s in sets]).astype(int)
    both = has @ has.T
    for i, j in zip(*np.nonzero(np.triu(both / (20 - both) >= 0.6, 1))):
        hit += 1
        assert root[i] == root[j]
    assert hit > 100


def test_links_count_wherever_their_differences_lie(spark):
    """Pairs that differ just in those n-grams which one sample of an eighth holds: a bound on a sample of them can't see that they are similar."""
    docs, pairs = [], []
    for k in range(8):
        words = [f"p{k}w{i}" for i in range(400)]
        g, _ = K.grams(K.split_words(pa.array([" ".join(words)])), 2)
        at = np.flatnonzero((K.mix(g ^ K.U64(0xA5A5A5A5A5A5A5A5)) & K.U64(7)) == 0)[:49] + 1
        other = [f"q{k}w{i}" if i in set(at.tolist()) else w for i, w in enumerate(words)]
        a, b = ({*zip(x, x[1:])} for x in (words, other))
        assert len(a & b) / len(a | b) >= 0.6
        pairs.append((len(docs), len(docs) + 1))
        docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(table).collect()}
    assert got == {d: (a, 1) for a, b in pairs for d in (a, b)}


def test_classes_alone_take_no_work_for_each_pair_of_a_large_one(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(120)]
    sets = [np.unique(np.array([*base[:100], *(rng.getrandbits(64) for _ in range(10))], np.uint64)) for _ in range(300)]
    side = np.zeros(len(sets), np.int32)
    found = {}
    for counted in (True, False):
        forest = ngram_join.Forest(len(sets))
        found[counted] = 0
        for i, j, _ in ngram_join.similar_in_block(sets, side, 0.6, None if counted else forest):
            forest.link(i, j)
            found[counted] += len(i)
        assert (forest.parent == 0).all()
    assert found[True] == 300 * 299 // 2 and found[False] < 300 * 20
    texts = [" ".join(f"w{k}" for k in range(60)) + f" x{i} y{i}" for i in range(200)] + ["quite another text"]
    left = ngram_join.without_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 200]
