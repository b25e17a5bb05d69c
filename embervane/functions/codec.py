"""Scalar quantization of rotated vectors: codebooks, Hadamard rotation, codes, packing, wire records.

A vector is divided by its norm, its signs are flipped by a fixed pattern, it is rotated by the normalised
Hadamard matrix, and each coordinate takes the code of the interval it lies in.  Codebooks are the published
Lloyd-Max levels of the normal distribution, divided by the square root of the dimension.
"""

from __future__ import annotations

import functools
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embervane.session import prepare

_HALF = {2: (0.453, 1.510), 3: (0.069, 0.500, 1.050, 1.748), 4: (0.066, 0.262, 0.524, 0.800, 1.099, 1.437, 1.844, 2.401)}
SLOTS = {1: 1, 2: 2, 3: 4, 4: 4}
#: Numbers of a row from which the fast transform is faster than a matrix product.
FAST = 512


def levels(bits: int, dim: int) -> np.ndarray:
    if bits not in _HALF:
        raise ValueError("bits must be 2, 3 or 4")
    half = np.array(_HALF[bits])
    return np.concatenate([-half[::-1], half]) / math.sqrt(dim)


def bounds(bits: int, dim: int) -> np.ndarray:
    c = levels(bits, dim)
    return (c[1:] + c[:-1]) / 2


def signs(dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=dim)


@functools.lru_cache(8)
def rotation(dim: int, seed: int = 42, family: str = "auto") -> np.ndarray:
    """The orthogonal matrix R of r = R v: ``hadamard`` with flipped signs, for powers of two, or ``qr`` of a seeded normal matrix; ``auto`` is the first where it can be."""
    if family == "qr" or (family == "auto" and dim & (dim - 1)):
        return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    h = np.ones((1, 1))
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h * signs(dim, seed) / math.sqrt(dim)


def walsh_hadamard(a: np.ndarray) -> np.ndarray:
    """The transform without a factor, of rows whose length is a power of two."""
    a = np.array(a, np.float64)
    width = 1
    while width < a.shape[-1]:
        b = a.reshape(*a.shape[:-1], -1, 2, width)
        a = np.stack([b[..., 0, :] + b[..., 1, :], b[..., 0, :] - b[..., 1, :]], axis=-2).reshape(a.shape)
        width *= 2
    return a


@dataclass(frozen=True)
class Codec:
    """codes = #{bounds < R v / |v|}; decoding gives |v| R' levels[codes]."""

    dim: int
    bits: int = 4
    seed: int = 42
    family: str = "auto"

    def rotated_by(self) -> np.ndarray:
        return rotation(self.dim, self.seed, self.family)

    def _fast(self) -> bool:
        return self.dim >= FAST and self.family != "qr" and not self.dim & (self.dim - 1)

    def turn(self, x: np.ndarray) -> np.ndarray:
        """R x of each row: by the fast transform for long rows, by the matrix for short ones."""
        return walsh_hadamard(x * signs(self.dim, self.seed)) / math.sqrt(self.dim) if self._fast() else x @ self.rotated_by().T

    def unturn(self, r: np.ndarray) -> np.ndarray:
        return walsh_hadamard(r) * signs(self.dim, self.seed) / math.sqrt(self.dim) if self._fast() else r @ self.rotated_by()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(x, np.float64)
        n = np.sqrt((x * x).sum(axis=1))
        r = self.turn(x / np.maximum(n, 1e-30)[:, None])
        return np.searchsorted(bounds(self.bits, self.dim), r, side="left").astype(np.int8), n

    def rotated(self, codes: np.ndarray) -> np.ndarray:
        return levels(self.bits, self.dim)[codes]

    def decode(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.unturn(self.rotated(codes)) * np.asarray(n)[:, None]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def list_column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def usable(df: DataFrame, id: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) of the rows that have both, in the codec's dimension and without null entries; other columns go."""
    v = F.col(vec).cast("array<double>")
    return df.select(F.col(id).cast("bigint").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull()))


def encode(df: DataFrame, codec: Codec, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, codes, cnorm, vrnorm) of every usable row; vrnorm is 1 / |decoded|.  Rows without id or whole vector go; repeated rows stay; no rows give none."""

    def f(batches):
        for b in batches:
            codes, n = codec.encode(matrix(b.column("vec"), codec.dim))
            c = codec.rotated(codes)
            length = np.sqrt((c * c).sum(axis=1)) * n
            yield pa.RecordBatch.from_arrays([b.column("id"), list_column(codes, pa.int8()), pa.array(n), pa.array(1 / np.maximum(length, 1e-30))], ["id", "codes", "cnorm", "vrnorm"])

    prepare(df.sparkSession)
    return usable(df, id, vec, codec.dim).mapInArrow(f, "id bigint, codes array<tinyint>, cnorm double, vrnorm double")


def decode(index: DataFrame, codec: Codec) -> DataFrame:
    """(id, vec) from (id, codes, cnorm)."""

    def f(batches):
        for b in batches:
            x = codec.decode(matrix(b.column("codes"), codec.dim), b.column("cnorm").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("id"), list_column(x, pa.float64())], ["id", "vec"])

    prepare(index.sparkSession)
    return index.select("id", "codes", "cnorm").mapInArrow(f, "id bigint, vec array<double>")


def packed_cols(dim: int, slot: int) -> int:
    return -(-dim * slot // 8)


def pack_slots(codes: Column, bits: int, dim: int) -> Column:
    """Codes in slots of 1, 2 or 4 bits, the first in the lowest bits of a byte, as binary."""
    slot = SLOTS[bits]
    per = 8 // slot
    byte = lambda k: functools.reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.coalesce(F.get(codes, k * per + j).cast("int"), F.lit(0)), j * slot) for j in range(per)])
    digits = F.transform(F.sequence(F.lit(0), F.lit(packed_cols(dim, slot) - 1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def unpack_slots(packed: Column, bits: int, dim: int) -> Column:
    slot = SLOTS[bits]
    per = 8 // slot
    at = lambda j: F.conv(F.substring(F.hex(packed), (2 * F.floor(j / per) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.floor(at(j) / F.pow(F.lit(2), (j % per) * slot)).cast("int").bitwiseAND((1 << slot) - 1).cast("tinyint"))


def pack_tight(codes: np.ndarray, bits: int) -> bytes:
    """One stream of bits, the lowest of each code first."""
    return np.packbits((np.asarray(codes)[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_tight(data: bytes, bits: int, n: int) -> np.ndarray:
    if len(data) < -(-n * bits // 8):
        raise ValueError("packed codes are cut off")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (flat << np.arange(bits)).sum(axis=1).astype(np.int8)


_RECORD, _TURNED = struct.Struct("<4sBBHIfI"), struct.Struct("<4sBBHIfBI")
_FAMILIES = ("qr", "hadamard")


def record(codec: Codec, codes: np.ndarray, n: float) -> bytes:
    """A self-describing record of one vector: magic, version, bits, dimension, seed, norm, length, packed codes; version 2 tells the rotation too, version 1 is QR's."""
    data = pack_tight(codes, codec.bits)
    family = codec.family if codec.family != "auto" else "qr" if codec.dim & (codec.dim - 1) else "hadamard"
    if family == "qr":
        return _RECORD.pack(b"TQE1", 1, codec.bits, codec.dim, codec.seed, n, len(data)) + data
    return _TURNED.pack(b"TQE1", 2, codec.bits, codec.dim, codec.seed, n, _FAMILIES.index(family), len(data)) + data


def records(data: bytes) -> list[tuple[Codec, np.ndarray, float]]:
    """The records of a stream; a wrong magic, version, width or rotation and cut off data are errors."""
    out, at = [], 0
    while at < len(data):
        kind = _TURNED if data[at + 4 : at + 5] == b"\2" else _RECORD
        if len(data) - at < kind.size:
            raise ValueError("a record is cut off")
        magic, version, bits, dim, seed, n, *turned, size = kind.unpack_from(data, at)
        if magic != b"TQE1" or version not in (1, 2) or bits not in _HALF or (turned and turned[0] >= len(_FAMILIES)):
            raise ValueError("not a record of a known version")
        body = data[at + kind.size : at + kind.size + size]
        if len(body) < size:
            raise ValueError("a record is cut off")
        family = _FAMILIES[turned[0]] if turned else "qr"
        auto = "qr" if dim & (dim - 1) else "hadamard"
        out.append((Codec(dim, bits, seed, "auto" if family == auto else family), unpack_tight(body, bits, dim), n))
        at += kind.size + size
    return out


def fingerprint(codec: Codec, tag: str = "") -> Column:
    return F.sha2(F.lit(f"{codec.dim}:{codec.bits}:{codec.seed}:hadamard:{tag}"), 256)
