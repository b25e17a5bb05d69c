"""JSON rows as vector databases take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embervane.functions.codec import Codec, pack_slots


def _fields(codec: Codec) -> dict[str, Column]:
    packed = F.base64(pack_slots(F.col("codes"), codec.bits, codec.dim))
    id, bits, dim = F.col("id"), F.lit(codec.bits).alias("bits"), F.lit(codec.dim).alias("dim")
    named = lambda **k: F.struct(*(c.alias(n) for n, c in k.items()))
    return {
        "generic": named(id=id, compressed_b64=packed, norm=F.col("cnorm"), dim=dim, bits=bits),
        "milvus": named(id=id, vector=F.col("vec"), compressed_bytes=packed),
        "qdrant": named(id=id, vector=named(default=F.col("vec")), payload=named(tq_compressed=packed, tq_bits=bits, tq_dim=dim)),
        "weaviate": named(id=id.cast("string"), vector=F.col("vec"), properties=named(tq_compressed=packed, tq_bits=bits, tq_dim=dim)),
        "pinecone": named(id=id.cast("string"), values=F.col("vec"), metadata=named(tq_compressed=packed, tq_bits=bits, tq_dim=dim)),
    }


def export(rows: DataFrame, codec: Codec, kind: str = "generic") -> DataFrame:
    """(id, json) of rows (id, codes, cnorm, and vec but for generic)."""
    if kind not in (names := ("generic", "milvus", "qdrant", "weaviate", "pinecone")):
        raise ValueError(f"no such format: {kind}; there are {', '.join(names)}")
    if kind == "generic" and "vec" not in rows.columns:
        rows = rows.withColumn("vec", F.lit(None).cast("array<double>"))
    return rows.select("id", F.to_json(_fields(codec)[kind]).alias("json"))
