"""Hubs of a kNN graph: census, anatomy, differential, transit between areas, strata and their gates.

Edges are (query, rank, id, score), the score being higher for nearer; areas are (id, area).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embervane.operators.ranks import rank_correlation, ranked
from embervane.session import staged

#: A hub is central, or dense without being central, where it lies in this upper part of the population.
CENTRAL_TAIL, DENSE_TAIL = 0.95, 0.85


def _one(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def census(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_k): how often each node is a neighbour, zeros too."""
    n = edges.groupBy("id").agg(F.count("*").alias("n_k"))
    return nodes.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n_k", F.lit(0)).cast("bigint").alias("n_k"))


def tail(counts: DataFrame, k: int) -> DataFrame:
    """One row of (nodes, max_n_k, skew, frac_above_2k, robin_hood); nulls where there are no nodes."""
    s = counts.agg(F.count("*").alias("nodes"), F.max("n_k").alias("max_n_k"), F.skewness("n_k").alias("skew"), F.avg(_one(F.col("n_k") > 2 * k)).alias("frac_above_2k"), F.avg("n_k").alias("m"), F.sum("n_k").alias("t"))
    spread = counts.crossJoin(F.broadcast(s.select("m"))).agg(F.sum(F.abs(F.col("n_k") - F.col("m"))).alias("d"))
    return s.crossJoin(spread).select("nodes", "max_n_k", "skew", "frac_above_2k", (F.col("d") / 2 / F.col("t")).alias("robin_hood"))


def gini(counts: DataFrame, column: str = "n_k") -> DataFrame:
    """One row (gini) of the counts, over values and their multiplicities, so that ranks need no single partition of all nodes."""
    by = counts.groupBy(F.col(column).alias("n_k")).agg(F.count("*").alias("c"))
    w = Window.orderBy("n_k").rowsBetween(Window.unboundedPreceding, 0)
    ranks = by.select("n_k", "c", F.sum("c").over(w).alias("upto"))
    # ranks of equal values sum to c * (2 * upto - c + 1) / 2
    s = ranks.agg(F.sum(F.col("n_k") * F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2).alias("r"), F.sum("c").alias("n"), F.sum(F.col("n_k") * F.col("c")).alias("t"))
    return s.select((2 * F.col("r") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def mechanism(central: Column, dense: Column, material: Column) -> Column:
    """What makes hubs, from the shares of hubs that are central and dense; unclear where no count is material."""
    named = F.when(central >= 0.75, "centrality").when(dense >= 0.75, "density").when((central >= 0.25) & (dense >= 0.25), "mixed").otherwise("unclear")
    return F.when(material, named).otherwise("unclear")


def anatomy(edges: DataFrame, centrality: DataFrame, k: int, hub_quantile: float = 0.99) -> DataFrame:
    """One row: the counts' tail, rank correlations of counts with centrality, -d_k and -d_1, medians of hubs and of all, and the mechanism.

    ``edges`` join every node to its k nearest, the score being the negative distance; ``centrality`` is (id, central).
    """
    far = edges.groupBy(F.col("query").alias("id")).agg(F.min("score").alias("neg_dk"), F.max("score").alias("neg_d1"))
    n = staged(census(edges, centrality).join(centrality, "id").join(far, "id"), "anatomy")
    bar = n.agg(F.percentile("n_k", F.lit(hub_quantile)).alias("bar"), F.count("*").alias("n"))
    r = ranked(ranked(n, ["central", "id"], "rc"), ["neg_dk", "id"], "rd").crossJoin(F.broadcast(bar))
    hub = F.col("n_k") >= F.col("bar")
    # the share of rows above a hub: those of higher rank
    is_central = 1 - (F.col("n") - F.col("rc")) / F.col("n") >= CENTRAL_TAIL
    is_dense = ~is_central & (1 - (F.col("n") - F.col("rd")) / F.col("n") >= DENSE_TAIL)
    of_hubs = lambda c: F.percentile(F.when(hub, F.col(c)), F.lit(0.5))
    s = r.agg(
        F.sum(F.when(hub, F.col("n_k"))).alias("hub_mass"), F.sum("n_k").alias("mass"), F.max("n_k").alias("top"), F.avg(F.when(hub, _one(is_central))).alias("hub_frac_central"), F.avg(F.when(hub, _one(is_dense))).alias("hub_frac_dense"),
        of_hubs("central").alias("hub_central"), F.percentile("central", F.lit(0.5)).alias("all_central"), (-of_hubs("neg_dk")).alias("hub_dk"), (-F.percentile("neg_dk", F.lit(0.5))).alias("all_dk"), (-of_hubs("neg_d1")).alias("hub_d1"), (-F.percentile("neg_d1", F.lit(0.5))).alias("all_d1"),
    )
    s = s.crossJoin(tail(n.select("id", "n_k"), k))
    for name, c in (("corr_central", "central"), ("corr_neg_dk", "neg_dk"), ("corr_neg_d1", "neg_d1")):
        s = s.crossJoin(rank_correlation(n, "n_k", c).withColumnRenamed("rho", name))
    s = s.withColumn("hub_mass_share", F.col("hub_mass") / F.greatest("mass", F.lit(1e-12))).withColumn("mechanism", mechanism(F.col("hub_frac_central"), F.col("hub_frac_dense"), F.col("top") >= 2.5 * k))
    return s.drop("hub_mass", "mass", "top")


def per_query(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query, recall, first): the share of each query's k best that was found, and its nearest."""
    hit = exact.select("query", "id", "rank").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.lit(float(k))).alias("recall"), F.min_by("id", "rank").alias("first"))


def _with_tail(exact: DataFrame, found: DataFrame, nodes: DataFrame, k: int, anti_quantile: float) -> DataFrame:
    """per_query() with the count of the nearest and whether it is an anti-hub: among the lowest counts of all nodes."""
    counts = census(exact, nodes)
    bar = counts.agg(F.percentile("n_k", F.lit(anti_quantile)).alias("bar"))
    return per_query(exact, found, k).join(counts.withColumnRenamed("id", "first"), "first").crossJoin(F.broadcast(bar)).withColumn("anti", F.col("n_k") <= F.col("bar"))


def differential(exact: DataFrame, found: DataFrame, nodes: DataFrame, k: int, hub_quantile: float = 0.99, anti_quantile: float = 0.1) -> DataFrame:
    """One row of what an approximate search does to hubs: recall and its 5th percentile, agreement on hubs, recall of queries whose nearest is an anti-hub, skews."""
    q = _with_tail(exact, found, nodes, k, anti_quantile)
    s = q.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall_at_k"), F.percentile("recall", F.lit(0.05)).alias("recall_p05"), F.avg(F.when(F.col("anti"), F.col("recall"))).alias("anti_hub_recall"), F.avg(_one(F.col("anti"))).alias("anti_hub_query_frac"))
    both = staged(census(exact, nodes).withColumnRenamed("n_k", "ce").join(census(found, nodes).withColumnRenamed("n_k", "ca"), "id"), "counts")
    bars = both.agg(F.percentile("ce", F.lit(hub_quantile)).alias("be"), F.percentile("ca", F.lit(hub_quantile)).alias("ba"))
    he, ha = F.col("ce") >= F.col("be"), F.col("ca") >= F.col("ba")
    agree = both.crossJoin(F.broadcast(bars)).agg((F.sum(_one(he & ha)) / F.sum(_one(he | ha))).alias("hub_set_jaccard"), F.skewness("ce").alias("exact_skew"), F.skewness("ca").alias("approx_skew"))
    return s.crossJoin(agree).crossJoin(rank_correlation(both, "ce", "ca").withColumnRenamed("rho", "hub_rank_corr"))


def decile_curve(exact: DataFrame, found: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(decile, queries, recall) by the deciles of the counts of the queries' nearest; a decile's lower edge belongs to it, the last's upper too."""
    q = _with_tail(exact, found, nodes, k, 0.1).select("recall", "n_k")
    edges = q.agg(F.percentile("n_k", F.array(*(F.lit(i / 10) for i in range(11)))).alias("e"))
    q = q.crossJoin(F.broadcast(edges))
    inside = lambda i: (F.col("n_k") >= F.get("e", F.lit(i))) & ((F.col("n_k") <= F.get("e", F.lit(10))) if i == 9 else (F.col("n_k") < F.get("e", F.lit(i + 1))))
    decile = F.coalesce(*(F.when(inside(i), i) for i in range(10)))
    return q.groupBy(decile.alias("decile")).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"))


def row_transit(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area, n_k, tau): of the hits on each row, the share from queries of other areas."""
    q = areas.select(F.col("id").alias("query"), F.col("area").alias("query_area"))
    per = edges.join(q, "query").join(areas, "id").groupBy("id").agg(F.count("*").alias("n"), F.count(F.when(F.col("query_area") == F.col("area"), 1)).alias("i"))
    n = F.coalesce("n", F.lit(0))
    return areas.join(per, "id", "left").select("id", "area", n.alias("n_k"), ((n - F.coalesce("i", F.lit(0))) / F.greatest(n, F.lit(1))).alias("tau"))


def transit(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, transit, n_edges): of the edges from an area's queries, the share that leads to other areas."""
    q = areas.select(F.col("id").alias("query"), F.col("area").alias("query_area"))
    e = edges.join(q, "query").join(areas, "id")
    return e.groupBy(F.col("query_area").alias("area")).agg(F.avg(_one(F.col("query_area") != F.col("area"))).alias("transit"), F.count("*").alias("n_edges"))


def flow(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """(query_area, area, hits) of every pair of areas that has hits."""
    q = areas.select(F.col("id").alias("query"), F.col("area").alias("query_area"))
    return edges.join(q, "query").join(areas, "id").groupBy("query_area", "area").agg(F.count("*").alias("hits"))


def area_class(skew: Column, tau: Column, most: Column, tau_bar: float, count_bar: float) -> Column:
    """stub, backbone, NSHA (local hubs without transit), hub, plain, tried in this order."""
    local, few = tau < tau_bar, most < count_bar
    return F.when(few & local & (skew < 1), "stub").when(~local & ~few, "backbone").when((skew >= 1) & local, "NSHA").when(skew >= 1, "hub").otherwise("plain")


def strata(edges: DataFrame, areas: DataFrame, centrality: DataFrame, k: int, n_min: int = 2000, q_min: int = 500, tau_bar: float = 0.5, count_bar: float | None = None) -> DataFrame:
    """For every area its rows, queries and verdict, ABSTAIN below ``n_min`` rows or ``q_min`` queries, which isn't a pass; of the others the counts' moments, mean transit, rank correlations and class."""
    far = edges.groupBy(F.col("query").alias("id")).agg(F.min("score").alias("neg_dk"))
    rows = staged(row_transit(edges, areas).join(centrality, "id", "left").join(far, "id", "left"), "strata")
    asked = edges.select(F.col("query").alias("id")).distinct().join(areas, "id").groupBy("area").agg(F.count("*").alias("n_queries"))
    s = rows.groupBy("area").agg(F.count("*").alias("n"), F.skewness("n_k").alias("count_skew"), F.max("n_k").alias("max_nk"), F.avg("tau").alias("tau_mean"), F.avg(_one(F.col("n_k") > 2 * k)).alias("frac_above_2k"), F.avg("n_k").alias("m"), F.sum("n_k").alias("t"))
    spread = rows.join(s.select("area", "m"), "area").groupBy("area").agg(F.sum(F.abs(F.col("n_k") - F.col("m"))).alias("d"))
    s = s.join(spread, "area").join(asked, "area", "left").withColumn("n_queries", F.coalesce("n_queries", F.lit(0)))
    for name, c in (("corr_neg_dk", "neg_dk"), ("corr_centrality", "central")):
        s = s.join(rank_correlation(rows, "n_k", c, by="area").withColumnRenamed("rho", name), "area", "left")
    thin = (F.col("n") < n_min) | (F.col("n_queries") < q_min)
    s = s.withColumn("robin_hood", F.col("d") / 2 / F.greatest("t", F.lit(1e-12))).withColumn("class", area_class(F.coalesce("count_skew", F.lit(0.0)), F.col("tau_mean"), F.col("max_nk"), tau_bar, count_bar if count_bar is not None else 5 * k))
    told = ["count_skew", "max_nk", "tau_mean", "robin_hood", "frac_above_2k", "corr_neg_dk", "corr_centrality", "class"]
    return s.select("area", "n", "n_queries", F.when(thin, "ABSTAIN").otherwise("pass").alias("verdict"), *(F.when(~thin, F.col(c)).alias(c) for c in told))


def strata_differential(exact: DataFrame, found: DataFrame, areas: DataFrame, k: int, q_min: int = 500, anti_quantile: float = 0.1, least: float | None = None) -> DataFrame:
    """For every area of queries: recall, its 5th percentile, recall of queries whose nearest is an anti-hub of all nodes, their share, and the verdict: ABSTAIN below ``q_min`` queries, fail under ``least``, else pass."""
    q = _with_tail(exact, found, areas, k, anti_quantile).join(areas.select(F.col("id").alias("query"), "area"), "query")
    s = q.groupBy("area").agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall_at_k"), F.percentile("recall", F.lit(0.05)).alias("p05_recall"), F.avg(F.when(F.col("anti"), F.col("recall"))).alias("anti_hub_recall"), F.avg(_one(F.col("anti"))).alias("anti_hub_query_frac"))
    thin = F.col("n_queries") < q_min
    failed = F.coalesce(F.col("anti_hub_recall") < least, F.lit(False)) if least is not None else F.lit(False)
    told = ["recall_at_k", "p05_recall", "anti_hub_recall", "anti_hub_query_frac"]
    return s.select("area", "n_queries", F.when(thin, "ABSTAIN").when(failed, "fail").otherwise("pass").alias("verdict"), *(F.when(~thin, F.col(c)).alias(c) for c in told))


def summary(report: DataFrame) -> DataFrame:
    """One row of a strata report: areas, abstaining and failed ones, the least anti-hub recall, and the exit code, 0 for a pass, 1 for a failure, 3 where every area abstains."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    least = F.min("anti_hub_recall") if "anti_hub_recall" in report.columns else F.lit(None).cast("double")
    s = report.agg(F.count("*").alias("n_areas"), n("ABSTAIN").alias("n_abstain"), n("fail").alias("n_failed"), least.alias("least_anti_hub_recall"))
    return s.withColumn("exit_code", F.when(F.col("n_areas") == F.col("n_abstain"), 3).when(F.col("n_failed") > 0, 1).otherwise(0))


def gate(report: DataFrame, least: float) -> DataFrame:
    """(area, anti_hub_recall) of the areas that fail: no rows is a pass.  An area that abstains, or has no anti-hub queries, neither passes nor fails."""
    return report.where((F.col("verdict") != "ABSTAIN") & F.col("anti_hub_recall").isNotNull() & (F.col("anti_hub_recall") < least)).select("area", "anti_hub_recall")


def digest(areas: DataFrame) -> DataFrame:
    """One row (digest) of an area map's content, whatever its order or partitions."""
    one = areas.select(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("area").cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)").alias("h"))
    return one.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("h").cast("string")), 256).alias("digest"))


def require_same_map(*digests: str | None) -> None:
    """Results under different area maps, or maps without identity, must not be compared, merged or gated together."""
    if any(not d for d in digests) or len(set(digests)) > 1:
        raise ValueError("results were computed under different area maps")


def with_digest(df: DataFrame, areas: DataFrame) -> DataFrame:
    """``df`` with the digest of the area map that it was computed under."""
    return df.crossJoin(F.broadcast(digest(areas).withColumnRenamed("digest", "area_map_digest")))


def guarded(*tables: DataFrame) -> str:
    """The one area map digest of all tables (area_map_digest); more than one is an error."""
    found: set[str | None] = set()
    for t in tables:
        found |= {r[0] for r in t.select("area_map_digest").distinct().limit(2).collect()}
    require_same_map(*found)
    return found.pop()


def two_means(df: DataFrame, x: str, id: str = "id") -> DataFrame:
    """One row (separation): how far the best split of a column's values in two explains their squared deviations, every split tried; 0 for fewer than 4 rows or equal values."""
    r = staged(ranked(df.where(F.col(x).isNotNull()), [x, id], "i"), "split")
    part = F.expr("i DIV 100000")
    sums = r.groupBy(part.alias("p")).agg(F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("p", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("q").over(before), F.lit(0.0)).alias("q0"))
    own = Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c = r.withColumn("p", part).join(sums, "p").select("i", (F.col("s0") + F.sum(x).over(own)).alias("c1"), (F.col("q0") + F.sum(F.col(x) * F.col(x)).over(own)).alias("c2"))
    t = r.agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    rest = F.col("n") - F.col("i")
    ss = (F.col("c2") - F.col("c1") * F.col("c1") / F.col("i")) + (F.col("q") - F.col("c2") - (F.col("s") - F.col("c1")) * (F.col("s") - F.col("c1")) / rest)
    total = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    best = c.crossJoin(F.broadcast(t)).where(rest > 0).groupBy("n", total.alias("total")).agg(F.min(ss).alias("ss"))
    return best.select(F.when((F.col("n") < 4) | (F.col("total") <= 0), 0.0).otherwise(1 - F.col("ss") / F.col("total")).alias("separation"))
