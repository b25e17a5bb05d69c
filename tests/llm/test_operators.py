"""Every text operator against brute force, round trips and held-out labels, and on odd tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from embervane.llm import bpe, chatfmt, common, decontam, htmltemplate, isomedia, langmix, ngram_join, secretscan, shardtree, tokencount

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, a string, b string, score double, `key` int, row int, hash int, id int"
DATA = "/root/testdata/sf0.001"
VOWELS = {"aa": "aeiou", "bb": "xyzqk"}


def table(spark, rows):
    """rows of (doc_id, text, lang), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", 0.0, 1, 2, 3, 4) for i, t, lang in rows], DOCS)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [(None, "no id at all here", "aa"), (1, None, "aa"), (2, "", None), (3, " \n ", "aa"), (4, "one", "aa"), (4, "one", "aa"), (5, "ein zwei drei \U0001f600 你好 " * 20000, "bb"), (6, "...", "bb")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1

def edits(rng, w, n):
    w = list(w)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [w[k], f"new{rng.randrange(999)}"]])
    return w


def slow_least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_least_edits_is_the_dynamic_program():
    rng = random.Random(3)
    for _ in range(200):
        p, t = [rng.randrange(5) for _ in range(rng.randrange(1, 70))], [rng.randrange(5) for _ in range(rng.randrange(0, 90))]
        assert decontam.least_edits(p, t) == min(slow_least_edits(p, t), len(p))


def test_decontamination_recall_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, words(1000 + i, rng.choice([9, 16, 31, 60, 90]), 5000)) for i in range(40)]
    docs = []
    for d in range(160):
        w = words(d, rng.randrange(5, 300), 5000)
        if d % 2:
            own = items[d % 40][1]
            at = rng.randrange(len(w))
            w[at:at] = edits(rng, own, rng.randrange(0, int(0.2 * len(own)) + 1))
        docs.append((d, w))
    want = {(d, i): e for d, w in docs for i, p in items if (e := slow_least_edits(p, w)) <= int(0.2 * len(p) + 1e-9)}
    got = {tuple(r)[:2]: r[2] for r in decontam.contained_items(table(spark, [(d, " ".join(w), "aa") for d, w in docs]), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id bigint, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= set(got)


def edited(rng, w, kind, n):
    at = set(rng.sample(range(len(w)), n))
    new = lambda: f"new{rng.randrange(10**6)}"
    return [y for i, x in enumerate(w) for y in ([x] if i not in at else {"substituted": [new()], "deleted": [], "inserted": [x, new()]}[kind])]


@pytest.mark.parametrize("kind", ["substituted", "deleted", "inserted"])
@pytest.mark.parametrize("n", [5, 10, 15, 32, 64, 128, 256])
def test_decontamination_finds_everything_at_the_declared_distance(n, kind):
    rng = random.Random(n)
    items = [words(2000 + i, n, 5000) for i in range(40)]
    docs = [words(i, rng.randrange(200), 5000) + edited(rng, w, kind, int(0.2 * n)) + words(i + 50, rng.randrange(200), 5000) for i, w in enumerate(items)]
    row, item, d = decontam.ItemIndex(list(range(40)), [" ".join(w) for w in items]).matches(pa.array([" ".join(w) for w in docs]))
    got = dict(zip(zip(row.tolist(), item.tolist()), d.tolist()))
    assert set(got) >= {(i, i) for i in range(40)}
    assert all(e == slow_least_edits(items[i], docs[r]) <= int(0.2 * n) for (r, i), e in list(got.items())[:5])


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (None, "one"), (2, None), (3, ""), (4, "you find this nowhere")], "item_id bigint, text string")
    assert [tuple(r) for r in decontam.contained_items(odd, items).collect()] == [(4, 1, 0)]
    left = decontam.without_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 2
    assert decontam.contained_items(odd, items.where("false")).count() == 0
    assert decontam.without_contaminated(odd, items.where("false")).count() == len(ODD)
    assert decontam.contained_items(odd.where("false"), items).count() == 0
    assert [tuple(r) for r in decontam.contained_items(odd, items, at_once=1).collect()] == [(4, 1, 0)]
    assert decontam.without_contaminated(odd, items, at_once=1).count() == len(ODD) - 2


def test_index_of_many_long_items_is_cut_by_bytes(spark):
    items = spark.createDataFrame([(i, " ".join(words(i, 100, 5000))) for i in range(300)], "item_id bigint, text string")
    parts = list(decontam._indexes(items, 0.2, 20_000))
    assert sum(len(p.ids) for p in parts) == 300 and len(parts) > 8
    size = lambda p: sum(x.nbytes for x in p.words) + sum(x.nbytes for own in p.pieces.values() for x in own[:3])
    assert max(map(size, parts)) < 25 * 20_000


# 2

def test_edited_counts_are_those_of_the_whole_text():
    rng = random.Random(2)
    counts = tokencount.counter()
    for _ in range(150):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "42", "...", "ä你", " a"]) for _ in range(rng.randrange(0, 60)))
        tree = tokencount.SegmentTree(text, counts)
        for _ in range(4):
            n = len(tree.text)
            a = rng.randrange(n + 1)
            b = min(n, a + rng.randrange(6))
            new = rng.choice(["", "x", " ", "\n\n", " new words", "'s"])
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.n_tokens == len(counts.core.encode_ordinary(want))


def test_edits_encode_only_their_surroundings():
    text = " ".join(words(1, 20000)) + " mail me@example.org now " + " ".join(words(2, 20000))
    tree = tokencount.SegmentTree(text, tokencount.counter())
    tree.apply(tokencount.masking_edits(text))
    assert "<masked>" in tree.text and tree.encoded < 200


def test_counts_edges(odd):
    got = {r["doc_id"]: r for r in tokencount.count_with_edits(odd).collect()}
    assert got[1]["n_tokens"] is None and got[2]["n_tokens"] == 0 and got[4]["n_tokens"] == 1
    assert tokencount.count_with_edits(odd).count() == len(ODD) and tokencount.count_with_edits(odd.where("false")).count() == 0
    assert tokencount.build_trees(odd).count() == len(ODD)


def test_kept_trees_take_edits_without_encoding_the_rest(spark, odd, documents):
    core = tokencount.counter().core
    trees = tokencount.build_trees(documents)
    for r in trees.where("text IS NOT NULL").limit(40).collect():
        assert sum(r["chars"]) == len(r["text"]) and sum(r["tokens"]) == len(core.encode_ordinary(r["text"]))
    once = tokencount.edit_trees(trees)
    twice = tokencount.edit_trees(once, lambda t: [(0, min(4, len(t)), "New"), (len(t), len(t), " end")] if len(t) > 9 else [])
    whole = {r["doc_id"]: r for r in tokencount.count_with_edits(documents).collect()}
    for a, b in zip(once.collect(), twice.collect()):
        assert a["n_tokens"] == whole[a["doc_id"]]["n_tokens_edited"] and a["n_chars_encoded"] == whole[a["doc_id"]]["n_chars_encoded"]
        assert sum(b["tokens"] or []) == b["n_tokens"] == len(core.encode_ordinary(b["text"])) and sum(b["chars"]) == len(b["text"])
        assert len(b["text"]) < 2000 or b["n_chars_encoded"] < len(b["text"])
    got = tokencount.edit_trees(tokencount.build_trees(odd)).collect()
    assert len(got) == len(ODD) and [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [None, 0]
    assert tokencount.edit_trees(tokencount.build_trees(odd.where("false"))).count() == 0


# 3

def test_language_accuracy_on_held_out_documents(documents):
    train, rest = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    got = langmix.identify(rest, langmix.train(train)).join(rest.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND n_words >= 5").toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.97


def test_mixtures_are_found(documents):
    m = langmix.train(documents)
    texts = {r["lang"]: r["text"] for r in documents.where("n_chars BETWEEN 2000 AND 20000").collect()}
    a, b = sorted(texts)[:2]
    half = lambda t: " ".join(t.split()[:150])
    shares, _ = langmix.mixtures(pa.array([half(texts[a]) + " " + half(texts[b]), half(texts[a])]), m)
    k = [m.languages.index(x) for x in (a, b)]
    assert (np.abs(shares[k, 0] - 0.5) < 0.15).all() and shares[k[0], 1] > 0.9 and np.allclose(shares.sum(0), 1)


def slow_mixture(lik, penalty):
    """The best (score, set, shares) over every set of languages, by expectation-maximisation of very many steps; lik: words x languages."""
    n, k = lik.shape
    best = None
    for size in range(1, k + 1):
        for own in itertools.combinations(range(k), size):
            share = np.full(size, 1 / size)
            for _ in range(20000):
                p = lik[:, own] * share
                new = (p / p.sum(1, keepdims=True)).mean(0)
                if np.abs(new - share).max() < 1e-12:
                    break
                share = new
            score = np.log((lik[:, own] * share).sum(1)).sum() - penalty / 2 * np.log(n) * (size - 1)
            if best is None or score > best[0] + 1e-9:
                best = score, own, share
    return best


def test_best_sets_against_all_sets():
    rng = np.random.default_rng(3)
    agree = 0
    for trial in range(40):
        n, k = int(rng.integers(3, 120)), int(rng.integers(2, 6))
        truth = rng.dirichlet(np.full(k, 0.5))
        label = rng.choice(k, n, p=truth)
        lik = np.exp(rng.normal(0, 1.5, (n, k)) + 3 * (np.arange(k) == label[:, None]))
        penalty = 4.0
        score, own, share = slow_mixture(lik, penalty)
        got = langmix._best_sets(lik.T.copy(), np.array([0, n]), penalty / 2 * np.log(np.array([n])))[:, 0]
        chosen = np.flatnonzero(got)
        value = np.log((lik * got).sum(1)).sum() - penalty / 2 * np.log(n) * (len(chosen) - 1)
        assert value >= score - 2 * langmix.GAP
        agree += tuple(chosen) == own and np.allclose(got[chosen], share, atol=0.05)
    assert agree >= 38


def test_many_rows_at_once_are_those_alone():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 60, 30)
    lik = np.exp(rng.normal(0, 3, (4, int(n.sum()))))
    at = np.concatenate([[0], np.cumsum(n)])
    cost = 2 * np.log(n)
    every = langmix._best_sets(lik, at, cost)
    for i in range(30):
        alone = langmix._best_sets(lik[:, at[i] : at[i + 1]], np.array([0, n[i]]), cost[i : i + 1])[:, 0]
        assert np.allclose(every[:, i], alone, atol=1e-9)


def test_training_sample_without_broadcast_is_the_same(documents, monkeypatch):
    a = langmix.train(documents)
    monkeypatch.setattr(langmix, "BROADCAST_SAMPLE", 0)
    b = langmix.train(documents)
    assert a.languages == b.languages and np.array_equal(a.logp, b.logp)
    monkeypatch.setattr(langmix, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        langmix.train(documents)


def test_language_edges(odd):
    got = {r["doc_id"]: r for r in langmix.identify(odd).collect()}
    assert got[1]["rejected"] and got[2]["rejected"] and got[3]["rejected"] and got[6]["n_words"] == 0 and got[5]["language"] == "bb"
    assert langmix.identify(odd.where("false")).count() == 0
    kept = langmix.in_known_languages(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 2").count() == 0


# 4

def slow_join(docs, t=0.6, n=2):
    def grams(text):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = [(d, grams(x)) for d, x in docs]
    return {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len(x & y) / len(x | y) >= t}


def slow_classes(docs, t=0.6):
    """(class, links) by document of slow_join()'s pairs; documents of one id don't occur."""
    pairs = set(slow_join(docs, t))
    least = {d: d for d, _ in docs}
    for _ in docs:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    n = {d: 0 for d, _ in docs}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {d: (least[d], n[d]) for d, _ in docs}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    docs = []
    for g in range(25):
        base = words(g, rng.choice([3, 12, 60, 400]))
        for _ in range(rng.randrange(1, 12)):
            docs.append((len(docs), " ".join(edits(rng, base, rng.randrange(0, 1 + len(base) // 9)))))
    return docs


def classes(spark, docs):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(table(spark, [(d, t, "aa") for d, t in docs])).collect()}


def test_join_against_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    assert classes(spark, copies) == slow_classes(copies)
    member, pairs = ngram_join.similar_texts(table(spark, [(d, t, "aa") for d, t in copies]))
    of = {}
    for d, rep in map(tuple, member.collect()):
        of.setdefault(rep, []).append(d)
    got = {(min(x, y), max(x, y)): s for a, b, s in map(tuple, pairs.collect()) for x in of[a] for y in of[b]}
    got |= {p: 1.0 for own in of.values() for p in itertools.combinations(sorted(own), 2)}
    want = slow_join(copies)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_full_buckets_are_parted_anew(spark, copies, monkeypatch):
    for most in (2, 5):
        monkeypatch.setattr(ngram_join, "BUCKET", most)
        assert classes(spark, copies) == slow_classes(copies)


def test_join_with_a_full_filter_is_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    assert classes(spark, copies) == slow_classes(copies)


def test_contained_sets_and_sets_at_the_threshold_are_found():
    rng = random.Random(3)
    found = tried = 0
    for n in (4, 9, 40, 70, 130, 400):
        for kind in ("contained", "equal"):
            for _ in range(60):
                g = np.array(sorted(rng.getrandbits(64) for _ in range(2 * n)), np.uint64)
                k = int(np.ceil(0.6 * n)) if kind == "contained" else int(np.ceil(0.75 * n))
                a, b = (g[:n], g[:k]) if kind == "contained" else (g[:n], g[n - k : 2 * n - k])
                keys = [set(np.concatenate([x[2] for x in ngram_join._route(s, np.array([0, len(s)]), 0.6)]).tolist()) for s in (a, b)]
                tried += 1
                found += bool(keys[0] & keys[1])
    assert found >= 0.995 * tried


def test_no_task_takes_a_bucket_of_frequent_words_whole(spark, monkeypatch):
    """Unrelated texts of Zipf's words share single n-grams: however full their buckets are, a tree has BUCKET members at most."""
    monkeypatch.setattr(ngram_join, "BUCKET", 32)
    rng = np.random.default_rng(4)
    weight = 1 / np.arange(1, 300)
    texts = [" ".join(f"w{k}" for k in rng.choice(299, 60, p=weight / weight.sum())) for _ in range(3000)]
    sketch = ngram_join.map_arrow(table(spark, [(i, t, "aa") for i, t in enumerate(texts)]).select("doc_id", "text"), ngram_join._sketches(2, 0.6), f"doc_id bigint, node bigint, n int, levels {ngram_join.LEVELS}")
    keys = sketch.selectExpr("node", "explode(levels) AS x").selectExpr("node", "explode(x.keys) AS key").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert keys > 60
    made = []

    class Counted(ngram_join.CountTree):
        def __init__(self, counts, sizes):
            made.append(len(sizes))
            super().__init__(counts, sizes)

    monkeypatch.setattr(ngram_join, "CountTree", Counted)
    rows = sketch.selectExpr("node", "explode(levels) AS x").selectExpr("node", "x.counts", "x.size", "explode(x.keys) AS key").selectExpr("key", "node", "CAST(size AS INT) AS size", "counts", "0 AS side").orderBy("key").toArrow()
    list(ngram_join._bucket_links(0.6, 32)(iter(rows.to_batches(max_chunksize=500))))
    assert made and max(made) <= 32


def test_join_edges(spark, odd):
    alone = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(odd).collect()}
    assert alone == {d: (d, 0) for d in (1, 2, 3, 4, 5, 6)} and ngram_join.similarity_classes(odd.where("false")).count() == 0
    more = odd.union(table(spark, [(7, "One", "aa"), (8, "one!", "aa"), (9, "other words", "aa"), (9, "one", "aa")]))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(more).collect()}
    assert all(got[d] == (4, 3) for d in (4, 7, 8, 9)) and got[6] == (6, 0)


def test_one_of_each_class_stays(spark, odd, copies):
    more = odd.union(table(spark, [(7, "One", "aa"), (8, "one!", "aa"), (9, "other words", "aa"), (10, "other words", "aa"), (10, "other words", "aa")]))
    left = ngram_join.without_duplicates(more)
    assert left.columns == more.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, d) for d in (1, 2, 3, 4, 5, 6, 9)] + [(True, 0)]
    assert ngram_join.without_duplicates(more.where("false")).count() == 0
    left = ngram_join.without_duplicates(table(spark, [(d, t, "aa") for d, t in copies]))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for c, _ in slow_classes(copies).values()})


# 5

def test_chats(spark):
    rows = [(1, 0, "user", "Say <|im_end|> and <\\|im_start|>"), (1, 1, "assistant", "No <|endoftext|>"), (2, None, None, None), (2, 5, "assistant", ""), (None, 0, "user", "hello"), (1, 1, "assistant", "No <|endoftext|>")]
    t = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, m string, tokens int")
    got = {r["conv_id"]: r for r in chatfmt.format_chats(t).collect()}
    ids = chatfmt.reserved_ids()
    for conv, n in ((1, 3), (2, 2), (None, 1)):
        k = got[conv]["tokens"]
        assert [k.count(ids[x]) for x in ("im_start", "im_end", "endoftext")] == [n, n, 1] and len(got[conv]["loss_mask"]) == len(k) == got[conv]["n_tokens"]
    own, mask = got[1]["tokens"], got[1]["loss_mask"]
    trained = bpe.codec().decode(np.array([x for x, m in zip(own, mask) if m and x < ids["endoftext"]])).decode()
    assert chatfmt.unescape(trained) == "No <|endoftext|>" * 2 and "<|endoftext|>" not in trained
    assert sum(got[2]["loss_mask"]) == 1 and chatfmt.format_chats(t.where("false")).count() == 0
    for x in ("<|im_end|>", "<\\\\|im_end|>", "plain"):
        assert chatfmt.unescape(chatfmt.escape(x)) == x


def slow_chat(rows, core):
    """Tokens and mask of (turn, role, text) rows, one message after the other, straight from the vocabulary."""
    n = core.n_vocab
    ids = {"endoftext": n, "im_start": n + 1, "im_end": n + 2}
    hidden = re.compile(r"<(\\*)\|(endoftext|im_start|im_end)\|>")
    tokens, mask = [], []
    key = lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or ""))
    for _, role, text in sorted(rows, key=key):
        plain = lambda x: core.encode_ordinary(hidden.sub(lambda m: f"<{m[1]}\\|{m[2]}|>", x))
        head = [ids["im_start"], *plain(role if role is not None else "unknown"), *core.encode_ordinary("\n")]
        body = [*plain(text or ""), ids["im_end"]]
        tokens += head + body + core.encode_ordinary("\n")
        mask += [0] * len(head) + [int(role == "assistant")] * len(body) + [0] * len(core.encode_ordinary("\n"))
    return [*tokens, ids["endoftext"]], [*mask, 0]


def test_chats_against_brute_force(spark):
    rng = random.Random(12)
    parts = ["<|im_end|>", "<|im_start|>", "<|endoftext|>", "<\\|im_end|>", "plain words", " ", "\n", "ä你", "<|", "|>", "it's 42"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice([None, *("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(9))])) for _ in range(120)]
    rows += [(9, k, rng.choice(["user", "assistant"]), "turn " * 50) for k in range(2000)]
    got = chatfmt.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    core = bpe.codec().core
    real = {r["conv_id"]: (list(r["tokens"]), list(r["loss_mask"])) for r in got if r["conv_id"] is not None}
    assert real == {c: slow_chat([r[1:] for r in rows if r[0] == c], core) for c in (1, 2, 3, 9)}
    nameless = sorted((list(r["tokens"]), list(r["loss_mask"])) for r in got if r["conv_id"] is None)
    assert nameless == sorted(slow_chat([r[1:]], core) for r in rows if r[0] is None)


def test_chats_of_the_given_table(spark):
    messages = spark.read.parquet(f"{DATA}/conversations.parquet")
    core, by = bpe.codec().core, {}
    for r in messages.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: (list(r["tokens"]), list(r["loss_mask"])) for r in chatfmt.format_chats(messages).collect()}
    assert got == {c: slow_chat(rows, core) for c, rows in by.items()}


# 6

def test_secrets_held_out(spark, documents):
    models = secretscan.train(documents)
    rng = random.Random(77)
    made = ["".join(rng.choice(c) for _ in range(rng.randrange(20, 48))) for c in secretscan.RANDOM.values() for _ in range(60)]
    names = ["get_user_name_from_session", "2024-01-02T10-11-12", "internationalization", "path/to/some/file_name", "HTTP_RESPONSE_CODE", "computeAverageValue", "1234-5678-9012-3456"]
    found = secretscan.find_secrets(table(spark, [(k, f"ä key {s} end", "aa") for k, s in enumerate(made + names)]), models).collect()
    ids = {r["doc_id"] for r in found}
    assert len(ids & set(range(len(made)))) >= 0.95 * len(made) and not ids & set(range(len(made), len(made) + len(names)))
    assert all(r["start"] == 6 for r in found)


def test_secrets_within_paths_and_names(spark, documents):
    models = secretscan.train(documents)
    rng = random.Random(78)
    names = sorted({w for r in documents.limit(50).collect() for w in re.findall(r"\b[a-z]{4,9}\b", r["text"] or "")})
    part = lambda n, j: j.join(rng.choice(names) for _ in range(n))
    made, want = [], []
    for chars, n in (("0123456789abcdef", 32), ("0123456789abcdef", 40), (secretscan.RANDOM["upper"], 20), (secretscan.RANDOM["base62"], 32)):
        for words_before in (3, 6, 12):
            for j in "/_":
                key = "".join(rng.choice(chars) for _ in range(n))
                made.append(f"see {part(words_before, j)}{j}{key}{j}{part(2, j)} end")
                want.append(key)
    two = "0a1b" * 2 + "9f86d081884c7d659a2feaa0"
    made.append(f"{part(8, '/')}/{two}/{part(8, '/')}/{two}/{part(8, '/')}")
    ordinary = [f"{part(5, '/')}/2024/01/{part(4, '-')}-{rng.randrange(10**7)}" for _ in range(200)] + [part(9, "_") for _ in range(200)]
    row, start, _, size, _, _ = secretscan.scan(pa.array(made + ordinary), models)
    got = [(r, (made + ordinary)[r][a : a + n]) for r, a, n in zip(row.tolist(), start.tolist(), size.tolist())]
    assert not [x for x in got if x[0] >= len(made)]
    assert sum(want[r] in x and len(x) <= len(want[r]) + 12 for r, x in got if r < len(want)) >= 0.95 * len(want)
    assert [x for r, x in got if r == len(want)] == [two, two]
    left = [r["text"] for r in secretscan.redact(table(spark, [(0, made[0], "aa")]), models).collect()]
    assert left == [made[0].replace(want[0], "[SECRET]")]


def test_redaction(spark, odd, documents):
    models = secretscan.train(documents)
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    t = odd.union(table(spark, [(7, f"你 {key} and {key}.", "aa")]))
    got = secretscan.redact(t, models)
    assert got.columns == t.columns and got.count() == len(ODD) + 1
    assert tuple(got.where("doc_id = 7").select("text", "n_chars").first()) == ("你 [SECRET] and [SECRET].", len("你 [SECRET] and [SECRET]."))
    assert secretscan.find_secrets(odd, models).count() == 0 and secretscan.redact(odd.where("false"), models).count() == 0
    assert secretscan.find_secrets(odd).count() == 0


def test_models_are_those_of_counting(documents):
    """Log-likelihoods of a few strings, from counts of characters after two others, as dictionaries."""
    from collections import Counter

    samples = [("hex", True, "0a1b2c3d"), ("hex", True, "ffa09c"), ("word", False, "ordinary"), ("word", False, "ordinal"), ("id", False, "get_name")]
    models = secretscan.fit_models(samples)

    def slow(own, smoothing, text):
        one, two, three = Counter(), Counter(), Counter()
        for s in own:
            padded = "##" + s
            for i in range(2, len(padded)):
                one[padded[i]] += 1
                two[padded[i - 1 : i + 1]] += 1
                three[padded[i - 2 : i + 1]] += 1
        width = len(secretscan.ALPHABET) + 1
        p1 = lambda c: (one[c] + smoothing) / (sum(one.values()) + smoothing * width)
        begin = lambda table, head: sum(n for k, n in table.items() if k[:-1] == head)
        p2 = lambda b, c: (two[b + c] + 20 * p1(c)) / (begin(two, b) + 20)
        p3 = lambda a, b, c: (three[a + b + c] + 20 * p2(b, c)) / (begin(three, a + b) + 20)
        padded = "##" + text
        return sum(np.log(p3(*padded[i - 2 : i + 1])) for i in range(2, len(padded)))

    texts = ["0a1bff", "ordinary", "get_ord", "Zz9"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    ratio, _ = secretscan._scores(data, end - [len(t) for t in texts], end, models)
    for t, r in zip(texts, ratio):
        random_ = slow(["0a1b2c3d", "ffa09c"], 1e-3, t)
        ordinary = np.logaddexp(slow(["ordinary", "ordinal"], 1e-2, t), slow(["get_name"], 1e-2, t)) - np.log(2)
        assert r == pytest.approx(random_ - ordinary)


def test_models_from_a_table_of_labelled_samples(spark, documents, tmp_path):
    rng = random.Random(31)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    vocabulary = sorted({w for r in documents.collect() for w in re.findall(r"[a-z]{3,9}", r["text"] or "")})
    secret = lambda: rng.choice([("hex", key("0123456789abcdef", 32)), ("token", key(secretscan.RANDOM["base62"], 36)), ("cloud", "AKIA" + key(secretscan.RANDOM["upper"], 16))])
    plain = lambda: rng.choice([("snake", "_".join(rng.choices(vocabulary, k=4))), ("path", "/".join(rng.choices(vocabulary, k=5))), ("date", f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}-{rng.randrange(10**6)}")])
    rows = [(*(x := secret()), True) for _ in range(3000)] + [(*(x := plain()), False) for _ in range(6000)]  # noqa: F841
    spark.createDataFrame([(label, s, t) for label, t, s in rows], "label string, secret boolean, text string").write.parquet(str(tmp_path / "samples"))
    models = secretscan.train(documents, samples=spark.read.parquet(str(tmp_path / "samples")))
    assert sorted(models.names) == ["cloud", "hex", "token"]
    held = [secret()[1] for _ in range(300)] + [plain()[1] for _ in range(300)]
    row, *_ = secretscan.scan(pa.array([f"value {t} here" for t in held]), models)
    assert len(set(row.tolist()) & set(range(300))) >= 297 and not set(row.tolist()) & set(range(300, 600))
    with pytest.raises(ValueError):
        secretscan.fit_models([("word", False, "x")])


# 7

def test_moves_stay_in_the_changed_subtree(spark):
    tree = shardtree.uniform_tree()
    grown = shardtree.reweighted(tree, "g1r2s3", 9.0)
    t = spark.createDataFrame([(i, "old", 1) for i in range(20000)] + [(None, "x", 1)], "doc_id bigint, region string, moved int")
    m = shardtree.moves(t, tree, grown)
    assert m.where("moved AND new_region <> region AND new_region <> 'g1'").count() == 0
    assert m.where("moved AND new_region = region AND new_rack <> rack AND new_rack <> 'g1r2'").count() == 0
    assert m.where("moved AND new_rack = rack AND new_shard <> 'g1r2s3'").count() == 0
    assert m.where("doc_id IS NULL AND shard IS NULL AND moved IS NULL").count() == 1
    total = sum(w for racks in tree.values() for s in racks.values() for w in s.values())
    share = {r["shard"]: r["count"] / 20000 for r in m.where("shard IS NOT NULL").groupBy("shard").count().collect()}
    assert all(abs(share[s] - w / total) < 0.006 for racks in tree.values() for shards in racks.values() for s, w in shards.items())
    assert shardtree.assign(t.where("false"), tree).count() == 0
    with pytest.raises(ValueError):
        shardtree.assign(t, {"a": {"b": {"c": -1.0}}})


# 8

def test_media(spark):
    payload = bytes(range(256)) * 40
    blob = isomedia.multiplex(payload)
    video, sound = isomedia.read_tracks(blob)
    assert (video["codec"], video["kind"], sound["codec"]) == ("avc1", "vide", "mp4a") and video["n_samples"] == 40
    assert [blob[a:b] for a, b in zip(video["key_start"], video["key_end"])] == [payload[k * 256 : (k + 1) * 256] for k in range(0, 40, 12)]
    assert video["duration"] == pytest.approx(40 * 1001 / 30000)
    rows = [(1, blob), (1, blob), (None, blob), (2, None), (3, b""), (4, blob[:-9]), (5, b"\0\0\0\1moov"), (6, blob[:60])]
    got = isomedia.media_columns(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, media binary, tracks string, other string")).collect()
    assert [(r["tracks"] is None, r["media_error"] is None) for r in got] == [(False, True)] * 5 + [(True, False)] * 3
    assert got[0]["other"] == "y" and got[3]["tracks"] == []


def hand_made():
    """A container by hand: version 1 heads, stco, several runs of chunks, sizes of 4 bits, no stss; then a fragment of two runs."""
    u = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    box = lambda kind, *parts: u(8 + len(b"".join(parts))) + kind + b"".join(parts)
    mdat = box(b"mdat", bytes(range(60)))
    tkhd = box(b"tkhd", u(1 << 24, 0, 0, 0, 0, 7, 0, 0, 0), bytes(60))
    mdhd = box(b"mdhd", u(1 << 24, 0, 0, 0, 0, 90000, 0, 0, 0))
    sizes = [3, 5, 2, 9, 4]
    stz2 = box(b"stz2", u(0, 4, 5), bytes([3 << 4 | 5, 2 << 4 | 9, 4 << 4]))
    stsc = box(b"stsc", u(0, 2, 1, 2, 1, 3, 1, 1))
    stco = box(b"stco", u(0, 3, 8, 30, 50))
    stbl = box(b"stbl", box(b"stsd", u(0, 1), box(b"hvc1", bytes(70))), box(b"stts", u(0, 2, 2, 3000, 3, 1500)), stsc, stz2, stco)
    trak = box(b"trak", tkhd, box(b"mdia", mdhd, box(b"hdlr", u(0, 0), b"vide", bytes(13)), box(b"minf", stbl)))
    moov = box(b"moov", trak, box(b"mvex", box(b"trex", u(0, 7, 1, 100, 6, 0x10000))))
    runs = box(b"trun", u(5, 2), u(500), u(0)), box(b"trun", u(0x200, 3, 1, 2, 3))
    moof = box(b"moof", box(b"traf", box(b"tfhd", u(0x20000, 7)), *runs))
    head = mdat + moov
    want = [(8, 11), (11, 16), (30, 32), (32, 41), (50, 54), (len(head) + 500, len(head) + 506)]
    return head + moof + bytes(600), want, sizes


def test_media_by_hand():
    blob, want, sizes = hand_made()
    blob = blob[: -600] + (608).to_bytes(4, "big") + b"mdat" + bytes(600)
    (track,) = isomedia.read_tracks(blob)
    assert (track["track_id"], track["codec"], track["n_samples"]) == (7, "hvc1", 10)
    assert list(zip(track["key_start"], track["key_end"])) == want
    assert track["duration"] == pytest.approx((2 * 3000 + 3 * 1500 + 5 * 100) / 90000)


def test_forged_media_cost_an_error_only(spark):
    u = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    deep = b""
    for _ in range(3000):
        deep = u(8 + len(deep)) + b"stbl" + deep
    deep = u(16 + len(deep)) + b"moov" + u(8 + len(deep)) + b"trak" + deep
    whole = isomedia.multiplex(bytes(range(256)) * 40)
    forged = []
    for kind, skip, value in ((b"stsz", 8, 0xFFFFFFFF), (b"stsc", 12, 0xFFFFFFFF), (b"stts", 8, 0xFFFFFFFF), (b"co64", 8, 0xFFFFFFFF), (b"stss", 8, 0xFFFFFFFF)):
        at = whole.rindex(kind) + skip
        forged.append(whole[:at] + u(value) + whole[at + 4 :])
    at = whole.rindex(b"stsz") + 8
    forged.append(whole[:at] + u(1, 0xF0000000) + whole[at + 8 :])
    got = isomedia.media_columns(spark.createDataFrame([(i, b) for i, b in enumerate([deep, *forged])], "doc_id bigint, media binary")).collect()
    assert len(got) == 1 + len(forged) and got[0]["media_error"] and got[-1]["media_error"]
    assert all((r["tracks"] is None) != (r["media_error"] is None) for r in got)


# 9

def test_templates(spark):
    def page(title, items, host="http://h.org/"):
        return f"<html><head><title>{title}</title></head><body><h1>Shop front</h1><ul>{''.join(f'<li class=x>{i}</li>' for i in items)}</ul><p>Contact us</p></body></html>"

    rows = [(k, f"http://h.org/{k}", page(f"name{k}", [f"thing{k}a", f"thing{k}b", f"thing{k}c"][: 1 + k % 3])) for k in range(9)]
    rows += [(20, "http://h.org/x", None), (21, None, "<p>alone</p>"), (22, "http://single.org/", "<p>one page</p>"), (None, "http://h.org/n", page("nameless", ["q"])), (0, "http://h.org/0", rows[0][2]), (23, "http://h.org/e", "")]
    t = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id bigint, url string, html string, host string, uid int")
    got = htmltemplate.extract_slots(t).collect()
    assert len(got) == len(rows)
    flat = lambda r: [i for s in r["slots"] for i in s["items"]]
    by = {r["page_id"]: r for r in got}
    for k in range(9):
        text = " ".join(flat(by[k]))
        assert f"name{k}" in text and f"thing{k}a" in text and "Shop" not in text and "Contact" not in text
    assert by[20]["slots"] is None and flat(by[21]) == ["alone"] and flat(by[22]) == ["one page"] and by[23]["slots"] == []
    assert htmltemplate.extract_slots(t.where("false")).count() == 0


def test_templates_leave_out_the_words_of_records(spark):
    def page(k, more=""):
        records = "".join(f"<li>Price: p{k}x{j} Stock: s{k}x{j}</li>" for j in range(1 + k % 3))
        return f"<html><head><title>name{k}</title></head><body><h1>Shop front</h1><ul>{records}</ul><p>Contact us</p>{more}</body></html>"

    rows = [(k, f"http://h.org/{k}", page(k, "<p>Contact us</p>" * (k == 7))) for k in range(30)]
    got = {r["page_id"]: [(s["slot"], i) for s in r["slots"] for i in s["items"]] for r in htmltemplate.extract_slots(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in set(range(30)) - {7}:
        assert [i for _, i in got[k]] == [f"name{k}", *(f"{c}{k}x{j}" for j in range(1 + k % 3) for c in "ps")]
    fields = {(i[0], s) for k in got if k != 7 for s, i in got[k] if i[0] in "ps"}
    assert len(fields) == 2


def slow_template(pages):
    """(template tokens, nested tokens) of pages (lists of (token, whether a tag)) by comparing occurrence vectors and orders as they are."""
    every = sorted({t for page in pages for t, _ in page})
    vector = {t: tuple(sum(x == t for x, _ in page) for page in pages) for t in every}
    support = 0.8 * len(pages)
    classes = {}
    for t in every:
        if sum(n > 0 for n in vector[t]) >= support:
            classes.setdefault(vector[t], []).append(t)
    first = [{t: i for i, (t, _) in reversed(list(enumerate(page)))} for page in pages]

    def swapped(a, b):
        found = {f[a] < f[b] for f in first if a in f and b in f}
        return len(found) > 1

    single, nested = [], set()
    for v, own in sorted(classes.items(), key=lambda x: (-sum(n > 0 for n in x[0]), -len(x[1]), x[1][0])):
        if len(own) < 2:
            continue
        if sum(n == 1 for n in v) >= support:
            while any(swapped(a, b) for a, b in itertools.combinations(own, 2)):
                bad = [sum(swapped(a, b) for b in own if b != a) for a in own]
                own = [t for i, t in enumerate(own) if i != max(range(len(own)), key=lambda i: (bad[i], i))]
            if len(own) > 1 and not any(swapped(a, b) for a in own for b in single):
                single += own
        elif not any(swapped(a, b) for a, b in itertools.combinations(own, 2)) and any(tag and t in own for page in pages for t, tag in page):
            nested |= set(own)
    return set(single), nested if single else set()


def web(rng, host, n):
    def page(k):
        fields = "".join(f"<li class=r>Name: n{rng.randrange(999)} Cost: c{rng.randrange(999)}</li>" for _ in range(rng.randrange(1, 4)))
        extra = "<div class=ad>Buy now here</div>" if rng.random() < 0.9 else ""
        swap = ["<b>one</b>", "<i>two</i>"]
        rng.shuffle(swap)
        word = "sometimes" if rng.random() < 0.85 else "never"
        return f"<html><body><h1>Front page</h1>{extra}<p>{word} w{k} w{rng.randrange(99)}</p>{''.join(swap)}<ul>{fields}</ul><footer>All rights reserved</footer></body></html>"

    return [(f"http://{host}/{k}", page(k)) for k in range(n)]


@pytest.mark.parametrize("copies_of_each", [1, 2])
def test_templates_against_brute_force(spark, monkeypatch, copies_of_each):
    rng = random.Random(6)
    rows = [(k, u, h) for k, (u, h) in enumerate([x for host in ("a.org", "b.org", "c.org") for x in web(rng, host, 25)]) for _ in range(copies_of_each)]
    t = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {r["page_id"]: r for r in htmltemplate.extract_slots(t).collect()}
    for host in ("a.org", "b.org", "c.org"):
        own = [r for r in rows if f"//{host}/" in r[1]]
        tokens = htmltemplate.Tokens(pa.array([r[2] for r in own]))
        pages = [list(zip(tokens.id[a:b].tolist(), tokens.tag[a:b].tolist())) for a, b in zip(tokens.at, tokens.at[1:])]
        single, nested = slow_template(pages)
        for i, r in enumerate(own):
            marks = [k for k in range(tokens.at[i], tokens.at[i + 1]) if int(tokens.id[k]) in nested or int(tokens.id[k]) in single and int(tokens.id[k]) not in tokens.id[tokens.at[i] : k]]
            ends = [int(tokens.row_at[i]), *(int(tokens.end[k]) for k in marks)], [*(int(tokens.start[k]) for k in marks), int(tokens.row_at[i + 1])]
            want = [x for a, b in zip(*ends) if (x := tokens.text(a, b))]
            assert [x for s in got[r[0]]["slots"] for x in s["items"]] == want and got[r[0]]["template_tokens"] == len(single)
    monkeypatch.setattr(htmltemplate, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(htmltemplate, "SALT_PAGES", 7)
    again = {r["page_id"]: r for r in htmltemplate.extract_slots(t).collect()}
    assert again == got


# 10

def test_tree_encoding_is_the_flat_one():
    rng = random.Random(8)
    small = bpe.TreeCodec(leaf=7)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "'", "s", "42", "...", "ä你", "\U0001f600", " a", " "]) for _ in range(rng.randrange(0, 80)))
        ids = small.encode(text)
        assert ids.tolist() == small.core.encode_ordinary(text) and small.decode(ids) == text.encode()


def test_encoding_edges(odd):
    got = {r["doc_id"]: r for r in bpe.encode_documents(odd).collect()}
    assert got[1]["tokens"] is None and got[2]["tokens"] == [] and all(r["round_trip"] in (True, None) for r in got.values())
    assert bpe.encode_documents(odd).count() == len(ODD) and bpe.encode_documents(odd.where("false")).count() == 0
