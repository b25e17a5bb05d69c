"""The stages on a small corpus with planted cases, and on odd tables; brute force of each operator is in test_operators.py."""

import corpus_pipeline
from embervane.llm import bpe

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = docs.where("n_chars BETWEEN 300 AND 3000").orderBy("doc_id").limit(60)
    item = " ".join(f"question{k} about" for k in range(20))
    first = clean.first()
    planted = spark.createDataFrame(
        [(9001, first["text"], first["lang"], "s", 1), (9002, first["text"] + " " + item, first["lang"], "s", 1), (9003, "", "en", "s", 0), (9004, first["text"][:200] + f" token {KEY} " + "other words that stand here alone for this case " * 3, first["lang"], "s", 1), (None, None, None, None, None)],
        docs.schema,
    )
    clean.union(planted).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        step.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in step.collect()}
    assert 9003 not in seen["language"] and None not in seen["language"]
    assert 9001 in seen["language"] and 9001 not in seen["near_duplicates"]
    assert 9002 not in seen["decontamination"]
    assert KEY in seen["decontamination"][9004] and KEY not in seen["secrets"][9004]
    assert len(seen["secrets"]) >= 50
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    core = bpe.codec().core
    assert {r["doc_id"]: list(r["tokens"]) for r in got} == {d: core.encode_ordinary(t) for d, t in seen["secrets"].items()}


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, `key` string, rows int, __own int, levels string, class_id bigint, a string, b string"


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ties, clashing names; then no rows at all."""
    words = " ".join(f"wort{k % 977} und {k}" for k in range(30000))
    long = " ".join(f"stück{k} oder" for k in range(400_000))
    rows = [(1, words, "de"), (1, words, "de"), (2, words, None), (3, None, "de"), (4, "", "de"), (None, words + " anderer", "de"), (5, long, "de"), (6, "wort1 und 5 wort2 und 77 stück9 oder stück44 oder wort3 und 8", "de"), (7, "wort1 und 5 wort2 und 77 stück9 oder stück44 oder wort3 und 8", None), (8, " . ! ", None)]
    more = (0, "x", 1, 2, "y", 3, "z", "w")
    docs = spark.createDataFrame([(i, t, lang, None, None, *more) for i, t, lang in rows], COLUMNS)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *docs.columns[5:])
    spark.createDataFrame([(1, "frage die in keinem text steht"), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {"language": [1, 1, 2, 5, 6, 7, None], "near_duplicates": [1, 5, 6, None], "decontamination": [1, 5, 6, None], "secrets": [1, 5, 6, None]}
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        if name in want:
            assert step.columns == docs.columns
            step.write.parquet(str(tmp_path / name))
            step = spark.read.parquet(str(tmp_path / name))
            assert sorted((r[0] for r in step.select("doc_id").collect()), key=lambda i: (i is None, i or 0)) == want[name], name
            assert {r["class_id"] for r in step.collect()} == {3} if "class_id" in step.columns else True
    core = bpe.codec().core
    got = {r["doc_id"]: list(r["tokens"]) for r in step.collect()}
    assert got == {i: core.encode_ordinary(t) for i, t in ((1, words), (5, long), (6, rows[7][1]), (None, words + " anderer"))}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0, name
