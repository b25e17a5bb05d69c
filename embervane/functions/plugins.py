"""Named quantizers and read operators: a registry, conformance checks, and a few quantizers of other schools."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import metadata
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from embervane.operators.tensor import NF4

GROUP = "embervane.quantizers"


class Quantizer(Protocol):
    """Rows of numbers in, anything out, and back."""

    def compress(self, x: np.ndarray) -> object: ...

    def decompress(self, c: object) -> np.ndarray: ...


@dataclass(frozen=True)
class Plugin:
    name: str
    factory: Callable[..., Quantizer]
    targets: tuple[str, ...] = ("embedding",)
    tier: str = "experimental"
    summary: str = ""


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Plugin] = {}
        self.broken: dict[str, str] = {}

    def register(self, plugin: Plugin, overwrite: bool = False) -> Plugin:
        if plugin.name in self.known and not overwrite:
            raise ValueError(f"{plugin.name} is registered already")
        self.known[plugin.name] = plugin
        return plugin

    def create(self, name: str, **config) -> Quantizer:
        if name not in self.known:
            raise KeyError(f"no such plugin: {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name].factory(**config)

    def available(self, target: str | None = None) -> list[Plugin]:
        return [p for _, p in sorted(self.known.items()) if target is None or target in p.targets]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.name, list(p.targets), p.tier, p.summary) for p in self.available()], "name string, targets array<string>, tier string, summary string")

    def load_entry_points(self, group: str = GROUP) -> list[str]:
        """Registers what installed packages offer under ``group``; one that fails to load is told in ``broken`` and left out."""
        loaded = []
        for e in metadata.entry_points(group=group):
            try:
                self.register(e.load(), overwrite=True)
                loaded.append(e.name)
            except Exception as error:  # noqa: BLE001 - a plugin may fail in any way
                self.broken[e.name] = f"{type(error).__name__}: {error}"
        return loaded

    def resolve(self, discipline: str, target: str) -> list[str]:
        return [p.name for p in self.available(target) if discipline in p.summary or discipline == "any"]


def conformance(q: Quantizer, x: np.ndarray, rel_err_max: float = 0.75) -> dict[str, bool]:
    """Whether a round trip keeps shape, is finite, near enough and the same twice, and whether an empty table passes."""
    y = np.asarray(q.decompress(q.compress(x)))
    again = np.asarray(q.decompress(q.compress(x)))
    error = np.linalg.norm(y - x) / max(np.linalg.norm(x), 1e-30) if y.shape == x.shape else np.inf
    empty = np.asarray(q.decompress(q.compress(x[:0])))
    return {"shape": y.shape == x.shape, "finite": bool(np.isfinite(y).all()), "near": bool(error <= rel_err_max), "deterministic": bool(np.array_equal(y, again)), "empty": empty.shape == x[:0].shape}


class BlockNF4:
    """Blocks of a row times their greatest magnitude, at the sixteen normal floats."""

    def __init__(self, block: int = 64):
        self.block, self.levels = block, np.array(NF4)

    def compress(self, x: np.ndarray) -> tuple:
        flat = np.pad(x.ravel(), (0, -x.size % self.block)).reshape(-1, self.block)
        top = np.maximum(np.abs(flat).max(axis=1, initial=0), 1e-12)
        code = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, flat / top[:, None]).astype(np.uint8)
        return x.shape, code, top

    def decompress(self, c: tuple) -> np.ndarray:
        shape, code, top = c
        return (self.levels[code] * top[:, None]).ravel()[: int(np.prod(shape))].reshape(shape)


class Int8Outlier:
    """Rows in 8 bits but for columns with values above a threshold, which are kept."""

    def __init__(self, threshold: float = 6.0):
        self.threshold = threshold

    def compress(self, x: np.ndarray) -> tuple:
        out = (np.abs(x) > self.threshold).any(axis=0) if len(x) else np.zeros(x.shape[1], bool)
        rest = np.where(out, 0.0, x)
        top = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-12) / 127
        return np.rint(rest / top[:, None]).astype(np.int8), top, np.flatnonzero(out), x[:, out]

    def decompress(self, c: tuple) -> np.ndarray:
        code, top, at, kept = c
        x = code * top[:, None]
        x[:, at] = kept
        return x


class GroupInt4:
    """Groups of columns in 4 bits between their least and greatest value."""

    def __init__(self, group: int = 32):
        self.group = group

    def compress(self, x: np.ndarray) -> tuple:
        g = np.pad(x, ((0, 0), (0, -x.shape[1] % self.group)), mode="edge").reshape(len(x), -(-x.shape[1] // self.group), self.group)
        lo, hi = g.min(axis=2, keepdims=True), g.max(axis=2, keepdims=True)
        step = np.maximum(hi - lo, 1e-12) / 15
        return x.shape, np.rint((g - lo) / step).astype(np.uint8), lo, step

    def decompress(self, c: tuple) -> np.ndarray:
        shape, code, lo, step = c
        return (code * step + lo).reshape(shape[0], code.shape[1] * self.group)[:, : shape[1]]


class FloatTable:
    """Values at the nearest of a float format's values, times a scale for each row."""

    def __init__(self, exponent: int = 4, mantissa: int = 3):
        bias = (1 << exponent - 1) - 1
        values = {0.0}
        for e in range(1 << exponent):
            for m in range(1 << mantissa):
                values.add((m / (1 << mantissa)) * 2.0 ** (1 - bias) if e == 0 else (1 + m / (1 << mantissa)) * 2.0 ** (e - bias))
        top = sorted(values)
        self.levels = np.array([-v for v in reversed(top[1:])] + top)

    def compress(self, x: np.ndarray) -> tuple:
        scale = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-12) / self.levels[-1]
        return np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, x / scale[:, None]).astype(np.uint8), scale

    def decompress(self, c: tuple) -> np.ndarray:
        return self.levels[c[0]] * c[1][:, None]


REGISTRY = Registry()
for _p in (
    Plugin("nf4", BlockNF4, ("weight", "key"), summary="blocks of normal floats"),
    Plugin("int8_outlier", Int8Outlier, ("weight",), summary="8 bits with outlier columns kept"),
    Plugin("int4_group", GroupInt4, ("weight",), summary="groups of 4 bits"),
    Plugin("fp8", FloatTable, ("key", "value"), summary="e4m3 values"),
    Plugin("fp4", lambda **k: FloatTable(2, 1), ("key", "value"), summary="e2m1 values"),
):
    REGISTRY.register(_p)

#: Read operators by name: functions of activations (rows of numbers) to a symmetric matrix without negative directions.
READ_OPERATORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def register_read_operator(name: str, f: Callable[[np.ndarray], np.ndarray], overwrite: bool = False) -> None:
    if name in READ_OPERATORS and not overwrite:
        raise ValueError(f"{name} is registered already")
    READ_OPERATORS[name] = f


def declared(matrix: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A given operator, made symmetric and checked once."""
    m = (np.asarray(matrix, float) + np.asarray(matrix, float).T) / 2
    if np.linalg.eigvalsh(m).min() < -1e-9:
        raise ValueError("an operator has no negative directions")
    return lambda x: m


def softmax_read(queries: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """How much attention weights of these queries move with the keys: the mean Gram matrix of their derivatives."""

    def f(keys: np.ndarray) -> np.ndarray:
        s = queries @ keys.T / np.sqrt(keys.shape[1])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        spread = (p * (1 - p)).sum(axis=1)
        return (queries * spread[:, None]).T @ queries / (len(queries) * keys.shape[1])

    return f


register_read_operator("identity", lambda x: np.eye(x.shape[1]))


def read_conformance(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tol: float = 1e-9) -> dict[str, bool]:
    m, again = f(x), f(x)
    return {"shape": m.shape == (x.shape[1],) * 2, "finite": bool(np.isfinite(m).all()), "symmetric": bool(np.allclose(m, m.T, atol=tol)), "positive": bool(np.linalg.eigvalsh((m + m.T) / 2).min() >= -tol), "deterministic": bool(np.array_equal(m, again))}
