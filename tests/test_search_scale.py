"""Searches at size: what a task holds and what is moved, and the same results as brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embervane.functions import codec as C
from embervane.operators import knn
from embervane.operators.strata_index import StratifiedIndex

DIM = 16


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).standard_normal((300, DIM)).astype("float32")
    x[10] = x[11] = x[12]
    x[20] = 0
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").cache()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(ids, q, own, x, k, metric, exclude_self):
    unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(1)), 1e-30)[:, None]
    s = {"cosine": lambda: unit(q) @ unit(x).T, "dot": lambda: q @ x.T, "l2": lambda: -np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))}[metric]()
    r = np.round(s, 9)
    if exclude_self:
        r[ids[:, None] == own[None]] = -np.inf
    return [[int(own[j]) for j in np.lexsort((own, -r[i])) if r[i, j] > -np.inf][:k] for i in range(len(ids))]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_a_unit_is_brute_force(metric, k):
    rng = np.random.default_rng(k)
    for x in (rng.standard_normal((200, DIM)), np.round(rng.standard_normal((200, 4))), rng.standard_normal((5, 8))[rng.integers(0, 5, 200)], rng.standard_normal((200, 8)) + 1000, rng.standard_normal((200, 8)) * (rng.random((200, 1)) < 0.5)):
        ids, q = rng.permutation(400)[:60], x[rng.integers(0, 200, 60)]
        own = rng.permutation(400)[:200]
        s = knn._Nearest(ids, q, k, metric, True, 64)
        for a in range(0, 200, 37):
            s.add(own[a : a + 37], x[a : a + 37])
        got = [[] for _ in ids]
        for i, _, j, _ in zip(*s.best()):
            got[i].append(int(j))
        assert got == brute(ids, q, own, x, k, metric, True)


def test_copies_of_the_base_grow_with_the_input_alone():
    """12 cores: as many units at 10,000 rows as at 600,000, and the base is cut only where queries are few."""
    assert {knn._cut(n, n, 10, 12) for n in (10_256, 102_564, 615_384)} == {(1, 36)}
    parts, units = knn._cut(10_000_000, 100, 10, 12)
    assert units == 1 and parts == 36
    assert knn._cut(0, 0, 10, 12) == (1, 1) and knn._cut(1_000_000, 1_000_000, 1 << 30, 12)[1] == 250_000


def test_few_queries_of_many_rows_and_repeated_ids(spark, table, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK", 20)
    few = table.where("vec_id < 5")
    assert knn._cut(300, 5, 4, spark.sparkContext.defaultParallelism)[0] > 1
    some = knn.topk(table, few, 4, dim=DIM, exclude_self=True).select("query", "rank", "id")
    monkeypatch.setattr(knn, "FEW", 8)
    every = knn.topk(table, table, 4, dim=DIM, exclude_self=True).select("query", "rank", "id")
    assert some.count() == 20 and some.exceptAll(every).count() == 0
    twice = knn.topk(table, table.union(table.where("vec_id = 7")), 4, dim=DIM, exclude_self=True).where("query = 7")
    assert twice.count() == 4 and sorted(r["rank"] for r in twice.collect()) == [0, 1, 2, 3]


def test_whole_searches_sort_no_hits(table):
    """Before, every pair of chunks gave its hits to a window."""
    assert "Window" not in plan(knn.topk(table, table, 4, dim=DIM)) and "array<float>" in knn._slim(table, "vec_id", "embedding", DIM).dtypes[1][1]


def test_reranking_moves_no_vectors_of_hits(table, monkeypatch):
    fused = knn.search(table, table, C.Codec(DIM, 2), 5, 4, exclude_self=True)
    assert "Join" not in plan(fused)
    joined = knn.rerank(knn.adc_topk(C.encode(table, C.Codec(DIM, 2)), table, C.Codec(DIM, 2), 20, exclude_self=True), table, table, 5, DIM)
    assert fused.withColumn("score", F.round("score", 9)).exceptAll(joined.withColumn("score", F.round("score", 9))).count() == 0 and fused.count() == joined.count() == 1500


def test_a_wide_cell_is_searched_by_units_of_its_queries(table, monkeypatch):
    """Before, all queries of a cell were gathered with each of its chunks."""
    monkeypatch.setattr(knn, "QUERIES", 16)
    rows = C.usable(table, "vec_id", "embedding", DIM).withColumn("cell", F.lit(0))

    def held(t):
        assert t.num_rows < 60, "a unit has too many queries"
        return knn._column("vec", DIM)(t)

    q = C.usable(table, "vec_id", "embedding", DIM)
    got = knn.best(knn.scan_cells(rows, q.select(F.col("id").alias("query"), F.lit(0).alias("cell")), q, 5, DIM, True, query_matrix=held), 5).select("query", "rank", "id")
    want = knn.topk(table, table, 5, dim=DIM, exclude_self=True).select("query", "rank", "id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 1500


def test_stratified_search_is_one_pass(table):
    ix = StratifiedIndex.build(table, "label", {"0": 4, "1": 2}, DIM)
    assert sorted(ix.parts) == [2, 3, 4] and ix.bits == {"0": 4, "1": 2, "2": 3}
    parts = [knn.adc_topk(rows, table, codec, 6) for codec, rows in ix.parts.values()]
    got, want = ix.search(table, 6, ix.digest), knn.merge(parts, 6)
    assert "Window" not in plan(got)
    assert got.select("query", "rank", "id").exceptAll(want.select("query", "rank", "id")).count() == 0 and got.count() == want.count()


def test_sweep_is_its_searches_in_one_pass(spark, table):
    points = [(2, 1), (2, 3), (4, 1)]
    got = {(r["bits"], r["times"]): r["recall"] for r in knn.recall_sweep(table, points, 5, DIM).collect()}
    exact = knn.topk(table, table, 5, dim=DIM, exclude_self=True)
    for bits, fetch in points:
        found = knn.search(table, table, C.Codec(DIM, bits), 5, fetch, exclude_self=True)
        assert got[bits, fetch] == pytest.approx(knn.recall(exact, found, 5).agg({"recall": "avg"}).first()[0], abs=1e-12)
    none = knn.recall_sweep(table.where("false"), points, 5, DIM).collect()
    assert len(none) == 3 and all(r["recall"] is None for r in none)


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_rolling_cuts_a_key_to_blocks(spark, monkeypatch, kind):
    """Before, a task sorted and summed all rows of a key."""
    from pyspark.sql.window import Window

    from embervane.operators import stats

    monkeypatch.setattr(stats, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else "ab"[int(i % 10 < 2)], None if i % 7 == 0 else int(rng.integers(0, 100))) for i in rng.permutation(120).tolist()]
    df = spark.createDataFrame(rows, "event_id bigint, event_type string, value bigint").withColumn("value", F.col("value").cast(kind))
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(-4, 0)
    want = df.select("event_type", "event_id", "value").withColumns({"n": F.count("value").over(w), "mean": F.round(F.avg("value").over(w), 9), "least": F.min("value").over(w)})
    got = stats.rolling(df, "event_type", "event_id", "value", 5)
    assert got.dtypes == want.dtypes
    got = got.withColumn("mean", F.round("mean", 9))
    assert got.count() == 120 and got.exceptAll(want).count() == 0
    assert "block" in plan(got)
    assert stats.rolling(df.where("false"), "event_type", "event_id", "value", 5).count() == 0
    nan = spark.createDataFrame([(0, "a", float("nan")), (1, "a", 2.0), (2, "a", float("inf"))], "event_id bigint, event_type string, value double")
    r = [tuple(map(str, x[3:])) for x in stats.rolling(nan, "event_type", "event_id", "value", 2).orderBy("event_id").collect()]
    assert r == [("1", "nan", "nan"), ("2", "nan", "2.0"), ("2", "inf", "2.0")]
