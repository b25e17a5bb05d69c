"""Command line: ``python -m embervane VERB ...``; exit 0 for a pass, 1 for a failed gate, 2 for wrong use, 3 where every area abstains."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession


def _print(df: DataFrame, most: int = 1000) -> None:
    for r in df.limit(most).collect():
        print(json.dumps(r.asDict(recursive=True), default=str))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="embervane")
    verbs = p.add_subparsers(dest="verb", required=True)
    add = lambda name, *names: [verbs.add_parser(name)] + [verbs.choices[name].add_argument(n) for n in names]
    for name in ("create", "add", "delete"):
        add(name, "index", "vectors")
    for name in ("compact", "info", "migrate"):
        add(name, "index")
    add("query", "statement", "vectors", "queries")
    add("certify", "index", "vectors")
    add("anatomy", "vectors")
    add("strata", "vectors", "area")
    add("hubdiff", "index", "vectors", "area")
    add("plan", "vectors", "target")
    for v in verbs.choices.values():
        v.add_argument("--bits", type=int, default=4)
        v.add_argument("--dim", type=int, default=64)
        v.add_argument("-k", type=int, default=10)
        v.add_argument("--least", type=float, default=0.7)
        v.add_argument("--n-min", type=int, default=2000)
        v.add_argument("--q-min", type=int, default=500)
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return _run(SparkSession.builder.getOrCreate(), a)
    except (ValueError, KeyError, RuntimeError, FileNotFoundError) as e:
        print(f"embervane: {e}", file=sys.stderr)
        return 2


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from embervane.functions import vector as V
    from embervane.functions.codec import Codec, usable
    from embervane.operators import compress, hubness, knn
    from embervane.operators.index import VectorIndex
    from embervane.plans import dialect
    from embervane.session import staged

    vectors = spark.read.parquet(a.vectors) if "vectors" in a else None
    index = VectorIndex(spark, a.index) if "index" in a and a.verb != "create" else None
    if a.verb == "create":
        print(json.dumps(VectorIndex.create(vectors, a.index, Codec(a.dim, a.bits)).info()))
    elif a.verb in ("add", "delete"):
        index.add(vectors) if a.verb == "add" else index.delete(vectors, "vec_id")
        print(json.dumps(index.info()))
    elif a.verb in ("compact", "migrate", "info"):
        if a.verb != "info":
            getattr(index, a.verb)()
        print(json.dumps(index.info()))
    elif a.verb == "query":
        s = dialect.parse(a.statement)
        _print(dialect.execute(a.statement, VectorIndex(spark, s.path), vectors, spark.read.parquet(a.queries)))
    elif a.verb == "certify":
        c = dialect.certify(index, vectors)
        _print(c)
        return int(c.first()["vacuous"])
    elif a.verb == "plan":
        best, front = compress.auto_compress(compress.sweep(vectors, [a.dim // 2, a.dim], [2, 3, 4], a.dim, a.k).cache(), a.target)
        _print(front)
        print(json.dumps(best))
        return int(best is None)
    else:
        x = usable(vectors, "vec_id", "embedding", a.dim)
        if a.verb == "hubdiff":
            areas = vectors.select(F.col("vec_id").alias("id"), F.col(a.area).alias("area"))
            report = staged(hubness.strata_differential(staged(knn.topk(vectors, vectors, a.k, dim=a.dim, exclude_self=True), "exact"), staged(index.search(vectors, a.k, exclude_self=True), "found"), areas, a.k, a.q_min, least=a.least), "report")
        else:
            mean = x.agg(F.array(*(F.avg(F.get("vec", F.lit(j))) for j in range(a.dim))).alias("m"))
            central = x.crossJoin(F.broadcast(mean)).select("id", (-V.distance(F.col("vec"), F.col("m"))).alias("central"))
            edges = staged(knn.topk(vectors, vectors, a.k, "l2", a.dim, exclude_self=True), "edges")
            if a.verb == "anatomy":
                _print(hubness.anatomy(edges, central, a.k))
                return 0
            report = staged(hubness.strata(edges, vectors.select(F.col("vec_id").alias("id"), F.col(a.area).alias("area")), central, a.k, a.n_min, a.q_min), "report")
        _print(report)
        return hubness.summary(report).first()["exit_code"]
    return 0


if __name__ == "__main__":
    sys.exit(main())
