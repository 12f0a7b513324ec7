"""Boosted regression trees on binned features, a task for each model.

Squared error as Spark's learner has it: the first tree fits the label, each
further one, weighted by the rate, twice what is still missing; a share of the
rows is drawn for each tree. Cut points come from quantile summaries of all
rows, merged in the order of their partitions. Rows go to the model's task as a
byte per feature and lie in a file of its own there, so that its memory holds
one block of them. Sums are of whole numbers: their order doesn't matter, and a
task that is run again gives the same trees.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
MAX_DEPTH = 10
#: Points of a quantile summary, and summaries merged at a time.
POINTS, MERGED = 512, 32
#: Rows of a block; targets lie within +-REACH, in LEVELS steps. A row's weight in a histogram is UNIT plus its
#: step, so one sum holds both count and total: a block's is under 2**53, hence exact.
BLOCK, REACH, LEVELS = 1 << 16, 4.0, 1 << 20
UNIT, STEP = BLOCK * LEVELS, 2 * REACH / LEVELS
UNDRAWN = 1 << 15

Summary = tuple[np.ndarray, float]  # features x points in order; rows that a point stands for


def _filled(c: pa.Array) -> np.ndarray:
    """A column with -1 for what is null, NaN or infinite."""
    x = c.to_numpy(zero_copy_only=False)
    return np.where(np.isfinite(x), x, -1.0)


# ── cut points ───────────────────────────────────────────────────────────────
def collapse(parts: list[Summary]) -> Summary:
    """One summary of at most POINTS points a feature."""
    values = np.concatenate([v for v, _ in parts], axis=1)
    weights = np.concatenate([np.full(v.shape[1], float(w)) for v, w in parts])
    total, even = weights.sum(), bool((weights == weights[0]).all())
    at = (np.arange(POINTS) + 0.5) * total / POINTS
    if even:
        values = np.sort(values, axis=1)
        if values.shape[1] <= POINTS:
            return values, weights[0]
        return values[:, np.minimum(at / weights[0], values.shape[1] - 1).astype(int)], total / POINTS
    order = np.argsort(values, axis=1, kind="stable")
    up = np.cumsum(weights[order], axis=1)
    pick = np.stack([np.minimum(np.searchsorted(u, at), len(u) - 1) for u in up])
    return np.take_along_axis(np.take_along_axis(values, order, 1), pick, 1), total / POINTS


def cuts_of(values: np.ndarray) -> list[np.ndarray]:
    """Per feature up to BINS - 1 limits between values: all of them where values are few, else quantiles."""
    out = []
    for v in values:
        distinct = np.unique(v)
        below = np.arange(len(distinct) - 1)
        if len(distinct) > BINS:
            below = np.unique(np.searchsorted(distinct, v[np.arange(1, BINS) * len(v) // BINS - 1]))
            below = below[below < len(distinct) - 1]
        a, b = distinct[below], distinct[below + 1]
        mid = a / 2 + b / 2
        out.append(np.where((mid >= a) & (mid < b), mid, a))
    return out


def summaries(rows: DataFrame, features: list[str], by: Column) -> dict[int, Summary]:
    """Quantile summaries of the features by a whole number, from one scan."""
    width, schema = len(features), "id long, g long, w double, v binary"

    def lines(no: int, parts: dict[int, list[Summary]]) -> pa.RecordBatch:
        done = [(g, *collapse(p)) for g, p in sorted(parts.items())]
        return pa.RecordBatch.from_pydict({"id": pa.array([no] * len(done), pa.int64()), "g": pa.array([g for g, _, _ in done], pa.int64()), "w": pa.array([w for _, _, w in done], pa.float64()), "v": pa.array([v.tobytes() for _, v, _ in done], pa.binary())})

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[Summary]] = defaultdict(list)
        for b in batches:
            group, x = b.column(0).to_numpy(), np.stack([_filled(c) for c in b.columns[1:]])
            for g in np.unique(group).tolist():
                parts[g].append(collapse([(x[:, group == g], 1.0)]))
                if len(parts[g]) == MERGED:
                    parts[g] = [collapse(parts[g])]
        if parts:
            yield lines(TaskContext.get().partitionId(), parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[Summary]] = defaultdict(list)
        found = sorted((r["id"], r["g"], r["w"], r["v"]) for b in batches for r in b.to_pylist())
        for _, g, w, v in found:
            parts[g].append((np.frombuffer(v).reshape(width, -1), w))
        if found:
            yield lines(found[0][0] // MERGED, parts)

    read = rows.select(by.cast("long").alias("_g"), *features)
    parts = read._jdf.queryExecution().toRdd().getNumPartitions()
    found = read.mapInArrow(summarise, schema)
    while parts > 1:
        parts = -(-parts // MERGED)
        found = found.repartitionById(parts, F.expr(f"cast(id div {MERGED} as int)")).mapInArrow(merge, schema)
    return {r.g: (np.frombuffer(r.v).reshape(width, -1), r.w) for r in found.collect()}


def find_cuts(found: dict[int, Summary], without: int | None = None) -> list[np.ndarray]:
    """Cut points from all groups, or all but one."""
    parts = [found[g] for g in sorted(found) if g != without]
    if not parts:
        raise ValueError("no labelled rows to learn from")
    return cuts_of(collapse(parts)[0])


# ── one model in one task ────────────────────────────────────────────────────
class _Block:
    """Rows in the task's file: pairs of bins by pair of features, label, hash, score so far, target, node."""

    def __init__(self, memory: mmap.mmap, at: int, rows: int, pairs: int) -> None:
        def view(dtype: type, *shape: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(memory, dtype, int(np.prod(shape)), at).reshape(shape)
            at += out.nbytes
            return out

        self.y, self.score = view(np.float64, rows), view(np.float64, rows)
        self.hash, self.target = view(np.uint32, rows), view(np.uint32, rows)
        self.node, self.pairs = view(np.uint16, rows), view(np.uint16, pairs, rows)

    def bins(self, feature: int, rows: np.ndarray) -> np.ndarray:
        both = self.pairs[feature // 2].take(rows)
        return both & (BINS - 1) if feature % 2 else both // BINS

    def begin(self, first: bool, odd: np.uint32, share: float) -> None:
        target = self.y if first else 2 * (self.y - self.score)
        self.target[:] = np.clip(np.rint((target + REACH) / STEP), 0, LEVELS - 1)
        self.node[:] = np.where((self.hash * odd) >> np.uint32(8) < share * (1 << 24), 1, 1 | UNDRAWN)

    def move(self, splits: dict[int, tuple[int, int]]) -> None:
        place = self.node & (UNDRAWN - 1)
        for n, (feature, cut) in splits.items():
            rows = np.flatnonzero(place == n)
            self.node[rows] += (n + (self.bins(feature, rows) > cut)).astype(np.uint16)

    def histogram(self, node: int, counts: np.ndarray, totals: np.ndarray) -> None:
        inside = self.node == node
        if node == 1:  # most rows: the others count as nothing
            weights = np.where(inside, self.target + float(UNIT), 0.0)
            both = np.stack([np.bincount(p, weights, BINS * BINS) for p in self.pairs])
        else:
            rows = np.flatnonzero(inside)
            weights = self.target.take(rows) + float(UNIT)
            both = np.stack([np.bincount(p.take(rows), weights, BINS * BINS) for p in self.pairs])
        both = both.reshape(-1, BINS, BINS)
        packed = np.stack([both.sum(2), both.sum(1)], axis=1).reshape(-1, BINS)[: len(counts)].astype(np.int64)
        counts += packed // UNIT
        totals += packed % UNIT


def read_blocks(batches: Iterator[pa.RecordBatch], width: int, folder: str | None) -> list[_Block]:
    """Rows (h, y, x: a byte per feature) as blocks in a nameless file."""
    pairs, starts, held, n = (width + 1) // 2, [], [], 0
    f = tempfile.TemporaryFile(dir=folder)

    def put() -> None:
        rows = min(n, BLOCK)
        h, y, x = (np.concatenate([p[i] for p in held]) for i in range(3))
        held[:] = [(h[rows:], y[rows:], x[rows:])]
        codes = np.zeros((pairs * 2, rows), np.uint16)
        codes[:width] = x[:rows].T
        starts.append((f.tell(), rows))
        for part in (y[:rows], np.zeros(rows), h[:rows], np.zeros(rows, np.uint32), np.zeros(rows, np.uint16), codes[::2] * BINS + codes[1::2]):
            f.write(np.ascontiguousarray(part).tobytes())
        f.write(b"\0" * (-f.tell() % 8))

    for b in batches:
        if b.num_rows:
            x = b.column("x")
            first = np.frombuffer(x.buffers()[1], np.int32)[x.offset]
            cells = np.frombuffer(x.buffers()[2], np.uint8)[first : first + b.num_rows * width].reshape(-1, width)
            held.append((b.column("h").to_numpy().astype(np.uint32), b.column("y").to_numpy(), cells))
            n += b.num_rows
        while n >= BLOCK:
            put()
            n -= BLOCK
    if n:
        put()
    f.flush()
    if not starts:
        return []
    memory = mmap.mmap(f.fileno(), 0)
    return [_Block(memory, at, rows, pairs) for at, rows in starts]


def _best(counts: np.ndarray, totals: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, int, tuple[float, float], bool] | None:
    """(gain, feature, cut, means of both sides, left is the smaller) of the best split, the first among equals."""
    n, s = counts.cumsum(1), (totals * STEP - counts * REACH).cumsum(1)
    right, rest = n[:, -1:] - n, s[:, -1:] - s
    open_ = (n > 0) & (right > 0) & (np.arange(BINS) < np.array([len(c) for c in cuts])[:, None])
    if not open_.any():
        return None
    whole = s[0, -1] ** 2 / n[0, -1]
    gain = np.where(open_, s**2 / np.maximum(n, 1) + rest**2 / np.maximum(right, 1) - whole, -1.0)
    f, c = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, c] <= 1e-12 * (abs(whole) + n[0, -1] * STEP):
        return None
    return float(gain[f, c]), int(f), int(c), (float(s[f, c] / n[f, c]), float(rest[f, c] / right[f, c])), bool(n[f, c] <= right[f, c])


def grow(blocks: list[_Block], cuts: list[np.ndarray], rounds: int, depth: int, seed: int, rate: float = 0.1, share: float = 0.8) -> dict[str, Any]:
    """Trees of nodes, and the shares that the features have in what they gain."""
    rng, width = np.random.default_rng(seed), len(cuts)
    trees, importances = [], np.zeros(width)
    for t in range(rounds):
        odd = np.uint32(rng.integers(0, 1 << 32) | 1)
        for b in blocks:
            b.begin(t == 0, odd, share)
        splits: dict[int, tuple[int, int]] = {}
        values, gains = {1: 0.0}, np.zeros(width)
        last: dict[int, tuple[int, int]] = {}
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        smaller: dict[int, bool] = {}
        for d in range(depth):
            wanted = {2 * n + (not left): n for n, left in smaller.items()} if d else {1: 0}
            fresh = {k: (np.zeros((width, BINS), np.int64), np.zeros((width, BINS), np.int64)) for k in wanted}
            for b in blocks:
                b.move(last)
                for k, (counts, totals) in fresh.items():
                    b.histogram(k, counts, totals)
            for k, parent in wanted.items() if d else ():
                fresh[k ^ 1] = (sums[parent][0] - fresh[k][0], sums[parent][1] - fresh[k][1])
            if not d and (n := fresh[1][0][0].sum()):
                values[1] = float((fresh[1][1][0].sum() * STEP - n * REACH) / n)
            sums, last, smaller = fresh, {}, {}
            for k in sorted(sums):
                if best := _best(*sums[k], cuts):
                    gain, f, c, (values[2 * k], values[2 * k + 1]), smaller[k] = best
                    last[k] = splits[k] = (f, c)
                    gains[f] += gain
            if not last:
                break
        weight = 1.0 if t == 0 else rate
        of = np.zeros(1 << (depth + 1))
        for k, v in values.items():
            of[k] = v * weight
        for b in blocks:
            b.move(last)
            b.score += of.take(b.node & (UNDRAWN - 1))

        def node(k: int) -> dict:
            if k not in splits:  # noqa: B023
                return {"leaf": float(of[k])}  # noqa: B023
            f, c = splits[k]  # noqa: B023
            limit = float(cuts[f][c])
            return {"split": f, "split_condition": limit, "missing": 0 if limit >= -1 else 1, "left": node(2 * k), "right": node(2 * k + 1)}  # noqa: B023

        trees.append([node(1)])
        importances += gains
    return {"trees": trees, "importances": (importances / max(importances.sum(), 1e-300)).tolist()}


def fit(rows: DataFrame, features: list[str], rounds: int, depth: int, seed: int, cuts: list[np.ndarray] | None = None) -> dict[str, Any]:
    """``grow`` on rows (_h, _y, features); a feature that is null, NaN or infinite enters as -1."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is from 1 to {MAX_DEPTH}")
    cuts, width = find_cuts(summaries(rows, features, F.lit(0))) if cuts is None else cuts, len(features)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.zeros((width, b.num_rows), np.uint8)
            for j, limits in enumerate(cuts):
                x = _filled(b.column(j + 2))
                for c in limits:
                    codes[j] += x > c
            codes = np.ascontiguousarray(codes.T)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(codes)])], names=["h", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        blocks = read_blocks(batches, width, folder if os.path.isdir(folder) else None)
        yield pa.RecordBatch.from_pydict({"model": pa.array([json.dumps(grow(blocks, cuts, rounds, depth, seed))], pa.string())})

    coded = rows.select("_h", "_y", *features).mapInArrow(encode, "h long, y double, x binary")
    return json.loads(coded.repartition(1).mapInArrow(learn, "model string").collect()[0].model)
