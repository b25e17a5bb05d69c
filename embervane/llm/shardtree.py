"""Placement by a hierarchical weighted hash tree: region, rack, shard.

At each level every child of the node reached draws -ln(u) / weight, u being a hash of the key and the
child's name, and the least draw is descended into.  A child's draw depends on its own weight alone, so
a changed weight moves keys only into children whose weight grew or out of children whose weight fell;
below a child that keeps its keys nothing moves.  All of it is built-in expressions: no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[str, float]]]

#: Hexadecimal digits of the hash that make a draw.
DIGITS = 13


def uniform_tree(regions: int = 3, racks: int = 4, shards: int = 8) -> dict[str, dict[str, dict[str, float]]]:
    """Shards whose weights are 1 to 3 in turn."""
    return {f"g{g}": {f"g{g}r{r}": {f"g{g}r{r}s{s}": 1.0 + (r + s) % 3 for s in range(shards)} for r in range(racks)} for g in range(regions)}


def reweighted(tree: Tree, shard: str, weight: float) -> dict[str, dict[str, dict[str, float]]]:
    return {g: {r: {s: weight if s == shard else w for s, w in shards.items()} for r, shards in racks.items()} for g, racks in tree.items()}


def levels(tree: Tree) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children of each parent with their weights; an inner weight is the sum of the shards' below."""
    names = [*tree, *(r for racks in tree.values() for r in racks), *(s for racks in tree.values() for shards in racks.values() for s in shards)]
    weights = [w for racks in tree.values() for shards in racks.values() for w in shards.values()]
    if len(set(names)) < len(names):
        raise ValueError("names of nodes must differ")
    if any(not (w >= 0) or math.isinf(w) for w in weights):
        raise ValueError("weights must be finite and not negative")
    rack = {r: sum(shards.values()) for racks in tree.values() for r, shards in racks.items()}
    return [
        {"": [(g, sum(rack[r] for r in racks)) for g, racks in tree.items()]},
        {g: [(r, rack[r]) for r in racks] for g, racks in tree.items()},
        {r: list(shards.items()) for racks in tree.values() for r, shards in racks.items()},
    ]


def _draw(key: Column, child: Column) -> Column:
    part = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), child["name"]).cast("binary")), 1, DIGITS), 16, 10).cast("bigint")
    u = (part.cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / child["weight"]


def assign(docs: DataFrame, tree: Tree, prefix: str = "", key: str = "doc_id") -> DataFrame:
    """``docs`` with columns region, rack and shard (behind ``prefix``) of each row's key, replacing columns of these names.

    Every row gets one place, the same wherever its key recurs.  Children of weight 0 get nothing; a null
    key or a tree without weight gives nulls.  Other columns aren't read.  An empty table stays empty.
    """
    columns = [f"{prefix}{x}" for x in ("region", "rack", "shard")]
    kept = [c for c in docs.columns if c not in columns]
    at = [docs[c] for c in kept]
    own = docs.select(*at, F.col(key).cast("string").alias("__key"))
    # level by level, so that a level's draws are made once and not anew within each level below
    steps = levels(tree)
    for k, column in enumerate(columns):
        parent = own[columns[k - 1]] if k else None
        own = own.withColumn(column, _level(F.col("__key"), steps[k], parent))
    return own.drop("__key")


def _level(key: Column, children: Mapping[str, list[tuple[str, float]]], parent: Column | None) -> Column:
    table = {p: [(n, w) for n, w in c if w > 0] for p, c in children.items()}
    arrays = {p: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in c)) for p, c in table.items() if c}
    if not arrays:
        return F.lit(None).cast("string")
    at = arrays[""] if parent is None else F.element_at(F.create_map(*(x for p, c in arrays.items() for x in (F.lit(p), c))), parent)
    best = F.array_min(F.transform(at, lambda c: F.struct(_draw(key, c).alias("draw"), c["name"].alias("name"))))
    return F.when(key.isNotNull(), best["name"])


def moves(docs: DataFrame, before: Tree, after: Tree) -> DataFrame:
    """(doc_id, region, rack, shard, new_region, new_rack, new_shard, moved) of every row under two trees; moved is null for a null id."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    both = assign(assign(own, before), after, "new_")
    return both.withColumn("moved", F.col("shard") != F.col("new_shard"))


def oracle(before: Tree, after: Tree, table: str = "documents") -> str:
    """DuckDB SQL of moves()."""

    def nodes(tree: Tree, k: int) -> str:
        return ", ".join(f"('{p}', '{n}', {float(w)!r})" for p, c in levels(tree)[k].items() for n, w in c if w > 0)

    ctes, last = [], f"(SELECT row_number() OVER () AS row, doc_id, '' AS p FROM {table})"
    ctes.append(f"d AS MATERIALIZED (SELECT row, doc_id FROM {last})")
    for t, tree in (("", before), ("new_", after)):
        at = "(SELECT row, doc_id, '' AS p FROM d)"
        for k, level in enumerate(("region", "rack", "shard")):
            draw = f"-ln((('0x' || substr(md5(x.doc_id::VARCHAR || ':' || n.name), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**DIGITS}.0) / n.weight"
            ctes.append(f"{t}{level} AS (SELECT x.row, any_value(x.doc_id) AS doc_id, arg_min(n.name, {draw}) AS p FROM {at} x JOIN (VALUES {nodes(tree, k)}) n(parent, name, weight) ON n.parent = x.p WHERE x.doc_id IS NOT NULL GROUP BY x.row)")
            at = f"{t}{level}"
    names = [f"{t}{level}" for t in ("", "new_") for level in ("region", "rack", "shard")]
    return f"WITH {', '.join(ctes)} SELECT d.doc_id, {', '.join(f'{n}.p AS {n}' for n in names)}, shard.p <> new_shard.p AS moved FROM d {' '.join(f'LEFT JOIN {n} ON {n}.row = d.row' for n in names)}"
