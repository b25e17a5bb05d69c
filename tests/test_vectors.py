import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embervane.functions import codec as C
from embervane.functions import plugins
from embervane.__main__ import main as cli
from embervane.operators import agreement, certificate, compress, hubness, knn, probe, shards, stats, strata_index, tensor
from embervane.operators.index import VectorIndex
from embervane.operators.ivf import InvertedFile
from embervane.operators.pca import Principal, Quantized, allocate_bits, codebook, codebook_error, coverage, drift
from embervane.operators.ranks import rank_correlation, ranked
from embervane.operators.shards import ShardedIndex
from embervane.operators.strata_index import StratifiedIndex
from embervane.plans import catalogue, dialect, policy
from embervane.sources import formats
from embervane.sources.exports import export
from embervane.streaming import monitor

DIM = 16
SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score double"


@pytest.fixture(scope="module")
def rows():
    x = np.random.default_rng(1).standard_normal((60, DIM)).astype("float32")
    return x, [(i, v.tolist(), i % 3, "clash", 0.5) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows[1], SCHEMA)


def exact(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k]


def test_topk_is_brute_force_over_chunks(monkeypatch, rows, table):
    monkeypatch.setattr(knn, "CHUNK", 13)
    got = knn.topk(table, table, 5, dim=DIM, exclude_self=True).orderBy("query", "rank").toPandas()
    assert got["id"].to_numpy().reshape(60, 5).tolist() == exact(rows[0], 5).tolist()


def test_topk_edges(spark, table):
    odd = spark.createDataFrame([(None, [1.0] * DIM, 0, "", 0.0), (1, None, 0, "", 0.0), (2, [1.0] * 3, 0, "", 0.0), (3, [None] * DIM, 0, "", 0.0), (4, [0.0] * DIM, 0, "", 0.0), (5, [1.0] * DIM, 0, "", 0.0), (5, [1.0] * DIM, 0, "", 0.0)], SCHEMA)
    got = [tuple(r) for r in knn.topk(odd, odd, 2, dim=DIM).where("query = 4").orderBy("rank").collect()]
    assert got == [(4, 0, 4, 0.0), (4, 1, 5, 0.0)]
    none = table.where("false")
    assert knn.topk(none, table, 2, dim=DIM).count() == knn.topk(table, none, 2, dim=DIM).count() == 0
    assert C.encode(none, C.Codec(DIM)).count() == 0


def test_compressed_search_with_rerank_has_recall(table):
    found = knn.search(table, table, C.Codec(DIM), 5, 4, exclude_self=True)
    full = knn.topk(table, table, 5, dim=DIM, exclude_self=True)
    assert knn.recall(full, found, 5).agg({"recall": "avg"}).first()[0] >= 0.95


def test_probing_every_cell_is_exact(table):
    cells = knn.centroids(table, "label", DIM)
    a = knn.ivf_search(table, cells, table, 5, 3, DIM, exclude_self=True).select("query", "rank", "id")
    b = knn.topk(table, table, 5, dim=DIM, exclude_self=True).select("query", "rank", "id")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_inverted_file_is_exact_from_one_probe(table):
    cells = knn.centroids(table, "label", DIM)
    b = knn.topk(table, table, 5, dim=DIM, exclude_self=True).select("query", "rank", "id")
    assert knn.recall(b, knn.ivf_search(table, cells, table, 5, 1, DIM, exclude_self=True), 5).agg({"recall": "avg"}).first()[0] < 1
    a = knn.ivf_exact(table, cells, table, 5, 1, DIM, exclude_self=True).select("query", "rank", "id")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 4), st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_tight_packing_round_trip(bits, codes):
    assert C.unpack_tight(C.pack_tight(np.array(codes), bits), bits, len(codes)).tolist() == codes


def test_slots_records_and_transform(spark, table):
    for bits in (2, 3, 4):
        codec = C.Codec(DIM, bits)
        e = C.encode(table, codec)
        assert e.where(C.unpack_slots(C.pack_slots(e.codes, bits, DIM), bits, DIM) != e.codes).count() == 0
    r = e.first()
    data = C.record(codec, np.array(r["codes"]), r["cnorm"]) * 2
    back = C.records(data)
    assert len(back) == 2 and back[1][1].tolist() == r["codes"] and back[0][0] == codec
    for broken in (data[:-1], b"TQE2" + data[4:], data[:10]):
        with pytest.raises(ValueError):
            C.records(broken)
    x = np.arange(8.0)
    assert np.allclose(C.walsh_hadamard(C.walsh_hadamard(x)), 8 * x)
    assert np.allclose(C.rotation(DIM) @ C.rotation(DIM).T, np.eye(DIM))
    long, z = C.Codec(1024), np.random.default_rng(1).standard_normal((3, 1024))
    assert np.allclose(long.turn(z), z @ long.rotated_by().T) and np.allclose(long.unturn(long.turn(z)), z)
    assert export(e, codec).count() == 60
    with pytest.raises(ValueError):
        export(e, codec, "unknown")


def test_moments(rows, table):
    mean, c = stats.covariance(table, DIM)
    assert np.allclose(mean, rows[0].mean(0), atol=1e-6) and np.allclose(c, np.cov(rows[0].T), atol=1e-5)
    assert stats.covariance(table.where("false"), DIM)[1].sum() == 0
    assert stats.suggest_dim(np.array([8.0, 1, 1])) == 3


def test_hubs_sum_up(table):
    edges = knn.topk(table, table, 4, dim=DIM, exclude_self=True)
    areas = table.selectExpr("vec_id AS id", "label AS area")
    assert hubness.census(edges, areas).agg({"n_k": "sum"}).first()[0] == 240
    assert hubness.digest(areas).first() == hubness.digest(areas.repartition(3)).first()
    report = hubness.strata_differential(edges, edges, areas, 4, q_min=1, least=0.5)
    assert hubness.gate(report, 0.5).isEmpty() and hubness.summary(report).first()["exit_code"] == 0
    thin = hubness.strata_differential(edges, edges, areas, 4, q_min=10**6)
    assert hubness.summary(thin).first()["exit_code"] == 3 and hubness.gate(thin, 2.0).isEmpty()
    with pytest.raises(ValueError):
        hubness.guarded(hubness.with_digest(edges, areas), hubness.with_digest(edges, areas.where("id > 3")))
    assert hubness.guarded(hubness.with_digest(edges, areas), hubness.with_digest(areas, areas))


def test_ranks_need_no_single_partition(spark):
    rng = np.random.default_rng(3)
    x = [(i, float(a), float(b), i % 2) for i, (a, b) in enumerate(rng.integers(0, 20, (500, 2)))]
    t = spark.createDataFrame(x, "id bigint, a double, b double, g int").repartition(7)
    got = {r["id"]: r["r"] for r in ranked(t, ["a", "id"], "r").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((a, i) for i, a, _, _ in x), 1)}
    place = lambda j: {i: k for k, (_, i) in enumerate(sorted((r[j], r[0]) for r in x))}
    pa_, pb = place(1), place(2)
    want = np.corrcoef([pa_[i] for i in range(500)], [pb[i] for i in range(500)])[0, 1]
    assert rank_correlation(t, "a", "b").first()[0] == pytest.approx(want)
    assert ranked(t.where("false"), ["a", "id"], "r").count() == 0


def test_certificates_count_each_pair_of_distances_once(spark):
    d = np.array([1.0, 1.0, 2.0])
    assert certificate.mu_hat(d, 1.0) == 0 and certificate.mu_hat(d, 1.5) == pytest.approx(1 / 3) and certificate.mu_hat(d, 3) == 1
    rng = np.random.default_rng(5)
    d = np.abs(rng.normal(1, 0.3, 60))
    for k in (1.0, 1.1, 1.7):
        slow = sum(max(a, b) < k * min(a, b) for i, a in enumerate(d) for b in d[i + 1 :])
        assert certificate.mu_hat(d, k) == pytest.approx(slow / (60 * 59 / 2))
    most = certificate.max_certifiable_kappa(d)
    assert certificate.mu_hat(d, most) <= 0.5 < certificate.mu_hat(d, most + 0.01)
    assert np.isnan(certificate.measure_kappa(np.array([0.0, 1.0]), np.array([1.0, 1.0]))) and certificate.measure_kappa(d, np.zeros(60)) == np.inf
    pairs = spark.createDataFrame([(float(a), float(a) * 1.01) for a in d], "exact double, approx double")
    row = certificate.certificate(pairs).first()
    assert row["kappa"] == pytest.approx(1) and row["tau_floor"] == pytest.approx(1) and not row["vacuous"]


def test_flips(spark):
    t = spark.createDataFrame([(1, 1)] * 10 + [(1, 0)] * 6 + [(0, 1)] * 2 + [(0, 0)] * 2 + [(None, 1)], "b int, q int")
    r = agreement.flip_rate(t, F.col("b") == 1, F.col("q") == 1).first()
    assert (r["n"], r["regressions"], r["recoveries"], r["net_delta"]) == (20, 0.3, 0.1, -0.2)
    assert r["mcnemar_p"] == pytest.approx(2 * sum(math.comb(8, i) for i in range(3)) / 256)
    assert agreement.mcnemar(0, 0) == (0.0, 1.0) and agreement.mcnemar(60, 20)[1] < 1e-4
    assert agreement.flip_rate(t.where("false"), F.col("b") == 1, F.col("q") == 1).first()["n"] == 0


def test_components_pipelines_and_drift(rows, table, tmp_path):
    x = rows[0].astype(float)
    p = Principal.fit(table, 6, DIM)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(p.eigenvalues, s**2 / 59, atol=1e-5) and np.allclose(np.abs(p.components), np.abs(v[:6]), atol=1e-4)
    halves = Principal.fit(table.where("vec_id < 30"), 6, DIM).merge(table.where("vec_id >= 30"))
    assert np.allclose(halves.eigenvalues, p.eigenvalues) and halves.n == 60
    p.save(str(tmp_path / "p.npz"))
    assert np.allclose(Principal.load(str(tmp_path / "p.npz")).components, p.components)
    back = {r["id"]: r["vec"] for r in p.inverse(p.transform(table)).collect()}
    assert np.allclose(back[7], p.back(p.project(x[7:8]))[0])
    white = Principal.fit(table, DIM, DIM, whiten=True)
    z = np.array([r["vec"] for r in white.transform(table).collect()])
    assert np.allclose(np.cov(z.T), np.eye(DIM), atol=1e-3)
    assert p.suggest_dim(0.5) <= p.suggest_dim(0.9) <= DIM and sum(n for n, _ in p.bit_schedule(3)) == 6
    full = Principal.fit(table, DIM, DIM)
    for model in (Quantized.uniform(full, 4), Quantized.weighted(full, 3)):
        q = model.quality(table).first()
        assert q["mean"] > 0.9 and model.ratio > 1
        assert model.decompress(model.compress(table)).count() == 60
    assert not drift(full, table).stale and drift(p, table.withColumn("embedding", F.expr("transform(embedding, x -> x * 3 + 5)"))).mean_shift > 1
    with pytest.raises(ValueError):
        Quantized.weighted(p, schedule=[(3, 4)])
    c = coverage(table, table, DIM)
    assert c.verdict == "ok" and abs(c.jeffreys) < 1e-6
    even = allocate_bits(np.eye(4), 8.0)
    assert np.allclose(even.bits, 2) and allocate_bits(np.diag([16.0, 1, 1, 1]), 8.0).bits[0] > 3


def test_learned_levels_have_less_error(table):
    codec = C.Codec(DIM, 3)
    book = codebook(table, codec)
    assert len(book) == 8 and (np.diff(book) >= 0).all() and codebook_error(table, codec, book) <= codebook_error(table, codec) + 1e-6


def test_inverted_file_on_disk(spark, table, tmp_path):
    ix = InvertedFile.create(table, str(tmp_path / "ivf"), C.Codec(DIM, 4), 5)
    s = ix.stats().first()
    assert s["rows"] == 60 and s["cells"] <= 5
    flat = knn.adc_topk(C.encode(table, C.Codec(DIM, 4)), table, C.Codec(DIM, 4), 5).select("query", "rank", "id")
    every, probes = ix.search(table, 5, nprobe=5)
    assert every.select("query", "rank", "id").exceptAll(flat).count() == 0 and ix.scan_fraction(probes).first()["scan_fraction"] == 1
    few, probes = ix.search(table, 5, nprobe=1)
    assert ix.scan_fraction(probes).first()["scan_fraction"] < 1
    truth = knn.topk(table, table, 5, dim=DIM)
    found, _ = ix.search(table, 5, radius_scale=1.0, originals=table)
    assert knn.recall(truth, found, 5).agg({"recall": "avg"}).first()[0] >= 0.9


def test_stratified_index_and_allocation(table):
    ix = StratifiedIndex.build(table, "label", {"0": 4, "1": 2}, DIM)
    assert ix.mean_bits() == pytest.approx((4 + 2 + 3) / 3)
    assert ix.search(table, 3, ix.digest).count() == 180
    with pytest.raises(ValueError):
        ix.search(table, 3, "another")
    report = [{"area": a, "verdict": v, "anti_hub_recall": r} for a, v, r in (("a", "pass", 0.5), ("b", "pass", 0.9), ("c", "ABSTAIN", None), ("d", "pass", 0.7))]
    n = dict.fromkeys("abcd", 100)
    for bits in (strata_index.allocate_by_fragility(report, n), strata_index.allocate_max_min(report, n)):
        assert sum(bits.values()) / 4 <= 3 and bits["a"] == 4 and bits["b"] <= 3
    assert strata_index.stale_areas("mutation", set("abc"), "a", {"a": {"b", "z"}}) == {"a", "b"}
    assert strata_index.stale_areas("map_recompute", set("ab")) == set("ab") and strata_index.stale_areas("operating_point", set("ab"), "b") == {"b"}
    with pytest.raises(KeyError):
        strata_index.stale_areas("mutation", set("ab"), "x")


def test_sweeps_and_targets(table):
    swept = compress.sweep(table, [8, DIM], [2, 4], DIM, 5, share_of_queries=2).cache()
    best, frontier = compress.auto_compress(swept, "cosine > 0.9")
    assert best["mean_cosine"] > 0.9 and frontier.count() >= 1
    assert compress.auto_compress(swept, "cosine > 1.5")[0] is None and compress.autotune(swept, 0.0)[0]["ratio"] == swept.agg({"ratio": "max"}).first()[0]
    assert compress.parse_target("recall@5 >= 0.9").k == 5
    with pytest.raises(ValueError):
        compress.parse_target("speed > 3")


def test_policy(spark, table):
    p = policy.Policy()
    hits = spark.createDataFrame([(q, r, r, 1 - 0.0001 * r) for q in range(4) for r in range(3)], "query bigint, rank int, id bigint, score double")
    assert p.retrieval(hits).action == "rerank_more" and not p.certificate({"vacuous": False, "tau_floor": 0.9}).conservative
    assert p.certificate({"vacuous": True, "tau_floor": -1.0}).conservative and p.kv_keys(regime="unknown").conservative and not p.kv_keys(0.9).conservative
    assert [d.situation for d in p.all(displacement=0.1, routing={"margin_p10": 1.0})] == ["routing", "a2"]


def test_plugins():
    r = plugins.Registry()
    r.register(plugins.Plugin("nf4", plugins.BlockNF4))
    with pytest.raises(ValueError):
        r.register(plugins.Plugin("nf4", plugins.BlockNF4))
    with pytest.raises(KeyError):
        r.create("none")
    x = np.random.default_rng(0).normal(size=(40, 50))
    for name in plugins.REGISTRY.known:
        assert all(plugins.conformance(plugins.REGISTRY.create(name), x).values()), name
    for f in (plugins.READ_OPERATORS["identity"], plugins.softmax_read(x[:4]), plugins.declared(np.diag(np.arange(50.0)))):
        assert all(plugins.read_conformance(f, x).values())
    with pytest.raises(ValueError):
        plugins.declared(-np.eye(3))


def test_formats(spark, table, tmp_path):
    codec = C.Codec(DIM, 3)
    e = C.encode(table, codec)
    for kind in ("record", "value", "message"):
        back = formats.deserialized(formats.serialized(e, codec, kind), codec, kind)
        assert back.join(e.withColumnRenamed("codes", "c"), "id").where("codes = c").count() == 60
    broken = formats.deserialized(spark.createDataFrame([(1, b"xx"), (2, None)], "id bigint, data binary"), codec, "message")
    assert broken.where("codes IS NULL").count() == 2
    r = e.first()
    data = C.record(codec, np.array(r["codes"]), r["cnorm"])
    assert data[4] == 2 and formats.record_size(data + b"more") == len(data)
    old = C.record(C.Codec(DIM, 3, 42, "qr"), np.array(r["codes"]), r["cnorm"])
    assert old[4] == 1 and C.records(old + data)[0][0].family == "qr" and len(C.records(old + data)) == 2
    at = str(tmp_path / "c")
    formats.write_container(at, 3, [("meta", b"{}"), ("codes", bytes(100))])
    assert formats.read_container(at) == (3, {"meta": b"{}", "codes": bytes(100)})
    raw = open(at, "rb").read()
    for bad in (raw[:-1], raw[:-1] + b"x", raw[:20], b"XXXX" + raw[4:]):
        open(at, "wb").write(bad)
        with pytest.raises(ValueError):
            formats.read_container(at)
    with pytest.raises(ValueError):
        formats.write_container(at, 1, [("a", b""), ("a", b"")])
    r_k, k, estimator = formats.unpack_scale(formats.pack_scale(np.arange(5.0), 10))
    assert r_k.tolist() == [0, 1, 2, 3, 4] and (k, estimator) == (10, "exact_knn")
    near = [(900, 0.5), (3, 0.25), (70000, 1.0)]
    assert formats.unpack_neighbours(formats.pack_neighbours(near)) == sorted(near) and formats.unpack_neighbours(formats.pack_neighbours([])) == []


def test_bootstrap_interval_holds_the_mean(spark):
    x = np.random.default_rng(2).random(300)
    r = stats.bootstrap_ci(spark.createDataFrame(list(enumerate(x.tolist())), "query bigint, recall double"), n_boot=200).first()
    assert r["lo"] < r["mean"] < r["hi"] and abs((r["hi"] - r["lo"]) / 2 - 1.96 * x.std() / np.sqrt(300)) < 0.02


def test_centroids_beyond_a_broadcast(table, monkeypatch):
    cells = knn.centroids(table, "label", DIM)
    a = {r["id"]: r["cell"] for r in knn.assign(table, cells, DIM).collect()}
    monkeypatch.setattr(knn, "CENTROID_BYTES", 0)
    assert {r["id"]: r["cell"] for r in knn.assign(table, cells, DIM).collect()} == a


def test_index_lifecycle_and_dialect(spark, table, tmp_path):
    codec = C.Codec(DIM)
    ix = VectorIndex.create(table.where("vec_id < 40"), str(tmp_path / "ix"), codec)
    with pytest.raises(ValueError):
        ix.add(table.where("vec_id BETWEEN 39 AND 50"))
    ix.add(table.where("vec_id >= 40"))
    ix.delete(spark.createDataFrame([(1,), (2,), (None,), (999,)], "id bigint"))
    ix = VectorIndex(spark, str(tmp_path / "ix"))
    assert ix.stats().first()[:3] == (60, 58, 2)
    assert ix.search(table, 3).where("id IN (1, 2)").isEmpty()
    ix.add(table.where("vec_id = 1"), upsert=True)
    ix.compact()
    assert ix.stats().first()[:3] == (59, 59, 0)
    assert ix.info()["segments"] == 1 and ix.vacuum() == 5 and ix.migrate() == 2 and ix.search(table, 3).count() == 180
    sql = f"SELECT id, score FROM '{ix.path}' ORDER BY COSINE(:q) LIMIT 5 WITH (RECALL >= 0.9)"
    with pytest.raises(RuntimeError):
        dialect.execute(sql, ix, table, table)
    sweep = dialect.execute(f"ANALYZE INDEX '{ix.path}' WITH (K = 5)", ix, table, table).collect()
    assert [r["cost"] for r in sweep] == list(dialect.GRID) and sweep[-1]["recall"] >= 0.9
    assert dialect.catalog(VectorIndex(spark, ix.path))["geometry"]["rows"] == 60
    told = dialect.execute("EXPLAIN " + sql, ix, table, table).first()
    assert told["recall"] >= 0.9 and told["reachable"] and not told["warnings"]
    assert dialect.execute("EXPLAIN " + sql.replace("LIMIT 5", "LIMIT 6"), ix, table, table).first()["warnings"]
    assert dialect.execute(sql, ix, table, table).count() == 300
    certified = dialect.execute(sql.replace("RECALL >= 0.9", "RERANK = 2, CERTIFY"), ix, table, table)
    assert certified.count() == 300 and "tau_floor" in certified.columns
    assert dialect.execute(f"SELECT id FROM '{ix.path}' LIMIT 2", ix, table, table).columns == ["query", "rank", "id"]
    for bad in (sql.replace("ORDER", "WHERE id = 1 ORDER"), "SELECT 1", sql.replace("0.9", "1.5"), sql + " more", sql.replace("LIMIT 5", "LIMIT 0"), "ANALYZE INDEX", sql.replace("id, score", "name")):
        with pytest.raises(ValueError):
            dialect.parse(bad)


def test_index_versions_stay_whole(spark, table, tmp_path):
    ix = VectorIndex.create(table, str(tmp_path / "ix"), C.Codec(DIM))
    other = VectorIndex(spark, ix.path)
    ix.delete(spark.createDataFrame([(3,)], "id bigint"))
    with pytest.raises(RuntimeError):
        other.add(table.where("vec_id < 0"))
    (tmp_path / "ix" / "_log" / "00000099.zzz.part").write_text("{")
    assert VectorIndex(spark, ix.path).stats().first()["live"] == 59
    with pytest.raises(FileNotFoundError):
        VectorIndex(spark, str(tmp_path / "none"))


def test_shards(spark, table, tmp_path):
    codec = C.Codec(DIM)
    ix = ShardedIndex.create(table, str(tmp_path / "a"), codec, 16)
    assert ix.stats() == {"shards": 4, "rows": 60} and ix.missing(6) == [4, 5]
    flat = knn.adc_topk(C.encode(table, codec), table, codec, 5)
    same = lambda x: x.select("query", "rank", "id").exceptAll(flat.select("query", "rank", "id")).count() == 0 and x.count() == 300
    place = shards.placed(ix.manifest, 3)
    assert same(ix.search(table, 5)) and same(shards.scatter_gather(ix, table, 5, place))
    cells = knn.centroids(table, "label", DIM)
    ix.build_cells(table, cells)
    assert same(ix.search_routed(table, cells, 5, 3))
    assert shards.servers_for(ix.routed(table, cells, 1), place).select("server").distinct().count() <= 3
    for n, part in enumerate(("vec_id < 30", "vec_id >= 30")):
        ShardedIndex.write_shard(table.where(part), str(tmp_path / "b"), n, codec)
    ShardedIndex.write_shard(table.where("vec_id >= 30"), str(tmp_path / "b"), 1, codec)
    assert ShardedIndex.finalize(spark, str(tmp_path / "b"), codec).stats() == {"shards": 2, "rows": 60}
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert same(ShardedIndex.create_streaming(stream, str(tmp_path / "c"), codec, str(tmp_path / "state")).search(table, 5))


def test_command_line(spark, table, tmp_path, capsys):
    at, ix = str(tmp_path / "v"), str(tmp_path / "ix")
    table.write.parquet(at)
    for args, code in ((["create", ix, at, "--dim", str(DIM)], 0), (["info", ix], 0), (["anatomy", at, "--dim", str(DIM), "-k", "3"], 0), (["strata", at, "label", "--dim", str(DIM), "-k", "3"], 3), (["hubdiff", ix, at, "label", "--dim", str(DIM), "-k", "3", "--q-min", "1", "--least", "1.1"], 1), (["info", str(tmp_path / "none")], 2), (["query", "SELECT 1", at, at], 2), (["nothing"], 2)):
        assert cli(args) == code, args


def test_quality_streams_and_cache(spark, table):
    pairs = table.selectExpr("vec_id AS id", "label", "CAST(embedding AS array<double>) AS original", "transform(CAST(embedding AS array<double>), (x, i) -> IF(vec_id > 45, IF(i = 0, 9D, 0D), x)) AS reconstructed")
    s = monitor.quality_stats(monitor.with_quality(pairs), "label", "id", floor=0.9)
    got = {r["label"]: r for r in s.collect()}
    assert all(r["n_total"] == 20 and not r["healthy"] and r["mean"] < 0.9 for r in got.values())
    assert monitor.alerts(s, "label", 0.9).count() >= 3 and monitor.metrics(s, "label").count() == 24
    puts = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", 60), ("a", 2, "2024-01-01 00:01:00", 60), ("b", 3, "2024-01-01 00:00:00", 60), ("c", 4, "2023-01-01 00:00:00", None)], "key string, value int, at string, ttl int").withColumn("at", F.to_timestamp("at"))
    live = monitor.store(puts, "key", "at", "ttl", "2024-01-01 00:01:30")
    assert {r["key"]: r["value"] for r in live.collect()} == {"a": 2, "c": 4}
    found = monitor.looked_up(spark.createDataFrame([("a",), ("b",), ("x",)], "key string"), live, "key")
    assert monitor.hit_counts(found).first()[:3] == (3, 1, 2)


def test_quality_window_may_be_all_rows(table):
    pairs = table.selectExpr("vec_id AS id", "label", "CAST(embedding AS array<double>) AS original", "CAST(embedding AS array<double>) AS reconstructed")
    q = monitor.with_quality(pairs)
    kept = monitor.quality_stats(q, "label", "id", window=7).collect()
    assert all((r["n_total"], r["n_window"]) == (20, 7) for r in kept)
    every = monitor.quality_stats(q, "label", "id", window=None, drift=False)
    assert "drifted" not in every.columns and all((r["n_total"], r["n_window"]) == (20, 20) for r in every.collect())


def test_quality_monitor_leaves_no_row_of_a_large_label_out(spark, tmp_path):
    v = [[float(np.cos(i + j)) for j in range(64)] for i in range(11)]
    spark.createDataFrame([(i, v[i % 11], 0) for i in range(1100)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    r = catalogue.QUERIES["quality_monitor"](spark, str(tmp_path)).first()
    assert r["n_total"] == r["n_window"] == 1100


def test_probes(table):
    r = probe.recommend(table, DIM, every=10)
    assert r["recommendation"] in ("polar", "per_channel") and r["polar"] > 0.9 and r["per_channel"] > 0.9
    assert probe.spectrum(np.diag([4.0, 2, 1e-9])) == {"effective_rank": 2, "condition": pytest.approx(4e9)}
    assert sum(probe.taper(100)) == 100 and probe.taper(100)[0] == 4
    x = C.usable(table, "vec_id", "embedding", DIM)
    assert probe.tapered(x, [8] * DIM, DIM).count() == 60
    a, b = (probe.block_hashes({"m": 1}, list(range(40)) + tail) for tail in ([7] * 8, [8] * 8))
    assert len(a) == 3 and a[:2] == b[:2] and a[2] != b[2] and probe.block_hashes({"m": 2}, list(range(40)))[0] != a[0]
    with pytest.raises(ValueError):
        probe.block_hashes({"m": None}, [1])
    assert not probe.compatible({"m": None}, {"m": None}) and probe.compatible({"m": 1}, {"m": 1})
    assert probe.fingerprint(table, "vec_id", "embedding") == probe.fingerprint(table.repartition(5), "vec_id", "embedding")


def test_hierarchical_cells_and_channel_levels(table):
    tops, leaves = knn.hierarchical_cells(table, 3, 4, 2, DIM)
    a = knn.assign_hierarchical(table, tops, leaves, 4, DIM)
    top = {r["id"]: r["cell"] for r in knn.assign(table, tops, DIM).collect()}
    assert a.count() == 60 and all(r["cell"] // 4 == top[r["id"]] for r in a.collect())
    x = tensor.long_table(table, 4)
    lv = tensor.calibrated_levels(x, 2, 3)
    own = x.join(lv, ["h", "d"]).withColumn("y", F.element_at("levels", tensor.nearest_of("x", "levels") + 1))
    flat = tensor.per_channel(x, 2)
    assert lv.count() == DIM and own.agg(F.avg((F.col("x") - F.col("y")) ** 2)).first()[0] < flat.agg(F.avg((F.col("x") - F.col("y")) ** 2)).first()[0]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", float(i % 17)) for i in range(200)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema("event_id bigint, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    out = monitor.drained(monitor.rolling_monitor(e, "event_type", "event_id", "value", 1000, floor=100.0), "test")
    last = {r["event_type"]: r for r in out.orderBy("seen").collect()}
    for key in "ab":
        own = [v for _, k, v in rows if k == key]
        assert (last[key]["seen"], last[key]["mean"], last[key]["alert"]) == (len(own), pytest.approx(np.mean(own)), True)
