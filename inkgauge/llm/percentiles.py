"""Percentiles of very large numeric columns (problem 2).

Deterministic buffer collapsing. Values fill buffers of ``k`` sorted values of
weight 1; when more than ``b`` buffers stand, all buffers of the lowest level
collapse into one of level + 1: of their weighted merge the values at evenly
spaced positions are kept, and the weights add up to W.

Error. Let r be the weight of values <= x before a collapse and r' after it.
The kept positions are offset + j*W, so r' = W * (floor((r - offset) / W) + 1)
and -offset < r' - r <= W - offset. With offset = (W + 1) // 2 one collapse
moves any rank by at most ceil(W / 2). The sketch adds these up (``err``); a
percentile it returns has a true rank within ``err`` of the rank asked for,
whatever the order of the values and however sketches were merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, B = 2048, 10
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_LAYOUT = "n long, err long, levels array<int>, weights array<long>, buffers array<array<double>>, tail array<double>"


class Sketch:
    """n values in buffers (level, weight, sorted array) and an unfilled tail."""

    def __init__(self, k: int = K, b: int = B):
        self.k, self.b, self.n, self.err = k, b, 0, 0
        self.full: list[tuple[int, int, np.ndarray]] = []
        self.tail = np.empty(0)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._take(values)

    def _take(self, values: np.ndarray) -> None:
        values = np.concatenate([self.tail, values]) if len(self.tail) else np.asarray(values, dtype=float)
        whole = len(values) // self.k * self.k
        for i in range(0, whole, self.k):
            self.full.append((0, 1, np.sort(values[i : i + self.k])))
            self._shrink()
        self.tail = values[whole:].copy()

    def _shrink(self) -> None:
        while len(self.full) > self.b:
            levels = sorted(x[0] for x in self.full)
            low = levels[1]  # two buffers at least, so a lone lowest one goes along
            group = [x for x in self.full if x[0] <= low]
            rest = [x for x in self.full if x[0] > low]
            total = sum(x[1] for x in group)
            values, ends = _merged(group)
            at = (total + 1) // 2 + total * np.arange(self.k, dtype=np.int64)
            self.err += (total + 1) // 2
            self.full = [*rest, (low + 1, total, values[np.searchsorted(ends, at)])]

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.err += other.err
        for x in other.full:
            self.full.append(x)
            self._shrink()
        self._take(other.tail)

    def quantiles(self, qs) -> list[float | None]:
        """For each q the value of rank max(1, ceil(q * n)); None when empty."""
        if not self.n:
            return [None for _ in qs]
        values, ends = _merged([*self.full, (0, 1, np.sort(self.tail))])
        ranks = [max(1, int(np.ceil(q * self.n - 1e-9))) for q in qs]
        return [float(values[min(np.searchsorted(ends, r), len(values) - 1)]) for r in ranks]

    def row(self) -> tuple:
        return self.n, self.err, [x[0] for x in self.full], [x[1] for x in self.full], [x[2].tolist() for x in self.full], self.tail.tolist()

    @classmethod
    def of(cls, r, k: int, b: int) -> Sketch:
        s = cls(k, b)
        s.n, s.err, s.tail = int(r.n), int(r.err), np.asarray(r.tail, dtype=float)
        s.full = [(int(a), int(w), np.asarray(v, dtype=float)) for a, w, v in zip(r.levels, r.weights, r.buffers, strict=True)]
        return s


def _merged(group: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([x[2] for x in group])
    weights = np.concatenate([np.full(len(x[2]), x[1], dtype=np.int64) for x in group])
    order = np.argsort(values, kind="stable")
    return values[order], np.cumsum(weights[order])


def _schema(df: DataFrame, keys: list[str], extra: str) -> T.StructType:
    own = T.StructType([df.schema[k] for k in keys])
    return T.StructType([*own.fields, *T.StructType.fromDDL(extra).fields])


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=schema.names)
    for f in schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            out[f.name] = out[f.name].astype("Int64")
    return out


def sketches(df: DataFrame, keys: list[str], features: list[str], k: int = K, b: int = B) -> DataFrame:
    """One sketch per (keys, feature) from one scan: (keys, feature, n, err, ...).

    Counts present, finite values from 0 up; null keys form a group. Every
    partition sketches what it holds, so a hot group is many small sketches
    that are merged, first in blocks and then as a whole (a tree), never a
    group of rows in a task. A group without a value gives no row.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)])
    schema = _schema(slim, names, "feature string, " + _LAYOUT)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple, Sketch] = {}
        for pdf in batches:
            for key, part in pdf.groupby(names, dropna=False, sort=False):
                for i, f in enumerate(features):
                    v = part[f"_v{i}"].to_numpy(dtype=float)
                    v = v[np.isfinite(v) & (v >= 0)]
                    if len(v):
                        own.setdefault((*[None if pd.isna(x) else x for x in key], f), Sketch(k, b)).add(v)
        if own:
            yield _frame([(*key, *s.row()) for key, s in own.items()], schema)

    parts = slim.mapInPandas(scan, schema).withColumn("_block", F.spark_partition_id() % 64)
    made = merged(merged(parts, [*names, "feature", "_block"], k, b), [*names, "feature"], k, b)
    return made.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def merged(parts: DataFrame, keys: list[str], k: int = K, b: int = B) -> DataFrame:
    """Sketches of equal ``keys`` merged; also combines loads or days later.

    Rows of one key come sorted and one after the other, so a task holds one
    open sketch and one batch, however many sketches a key has.
    """
    schema = _schema(parts, keys, _LAYOUT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                key = tuple(None if pd.isna(x) else x for x in (getattr(r, c) for c in schema.names[: len(keys)]))
                if own is None or key != at:
                    if own is not None:
                        done.append((*at, *own.row()))
                    at, own = key, Sketch(k, b)
                own.merge(Sketch.of(r, k, b))
            if done:
                yield _frame(done, schema)
        if own is not None:
            yield _frame([(*at, *own.row())], schema)

    safe = [c if not c.startswith("_") else "x" + c for c in keys]
    moved = parts.select(*[F.col(c).alias(s) for c, s in zip(keys, safe, strict=True)], *T.StructType.fromDDL(_LAYOUT).names)
    schema = _schema(moved, safe, _LAYOUT)
    out = moved.repartition(*safe).sortWithinPartitions(*safe).mapInPandas(run, schema)
    return out.withColumnsRenamed(dict(zip(safe, keys, strict=True)))


def percentiles(made: DataFrame, quantiles=QUANTILES, k: int = K, b: int = B) -> DataFrame:
    """(keys, feature, n, rank_error, q, value) from sketches, one row per quantile.

    ``rank_error`` is the proven bound on the distance in ranks; 0 is exact.
    """
    keys = [c for c in made.columns if c not in T.StructType.fromDDL(_LAYOUT).names]
    schema = _schema(made, keys, "n long, rank_error long, q double, value double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                s = Sketch.of(SimpleNamespace(**{str(c): v for c, v in r.items() if c not in keys}), k, b)
                own = tuple(None if pd.isna(r[c]) else r[c] for c in keys)
                rows += [(*own, s.n, s.err, q, v) for q, v in zip(quantiles, s.quantiles(quantiles), strict=True)]
            yield _frame(rows, schema)

    return made.mapInPandas(run, schema)
