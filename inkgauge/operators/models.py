"""Tree ensembles: reading, validating, scoring, training, writing.

A model is {trees: [[node]], base_score, objective, feature_names}; a node is a
leaf {leaf} or a split {split, split_condition, left, right, missing}, value <=
condition goes left, a missing value right only when ``missing`` is 1.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FEATURES
from . import boosting

MAX_DEPTH = 64
#: Nodes up to which a model is compiled to one expression.
EXPRESSION_NODES = 200


def validate(raw: Any) -> dict[str, dict]:
    """A bundle {name: model}, or ValueError saying which part is wrong."""
    if not isinstance(raw, dict) or not raw:
        raise ValueError("a model bundle is an object that holds at least one model")
    for name, model in raw.items():
        if not isinstance(model, dict):
            raise ValueError(f"model {name}: not an object")
        if not isinstance(model.get("trees"), list):
            raise ValueError(f"model {name}: no list of trees")
        if isinstance(model.get("base_score"), bool) or not isinstance(model.get("base_score"), (int, float)):
            raise ValueError(f"model {name}: base_score is not a number")
    return raw


def load(path: str) -> dict[str, dict]:
    with open(path) as f:
        return validate(json.load(f))


def save(bundle: dict[str, dict], path: str) -> None:
    with open(path, "w") as f:
        json.dump(validate(bundle), f)


def _roots(model: dict) -> list[dict]:
    return [t[0] for t in model["trees"] if isinstance(t, list) and t and isinstance(t[0], dict)]


def _flat(root: dict) -> tuple[np.ndarray, ...]:
    """Arrays (feature, condition, left, right, missing goes right, value) of one
    tree; malformed parts become leaves of 0, as do nodes too deep."""
    rows: list[list[float]] = []

    def put(node: Any, depth: int) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, 0, 0.0])
        if not isinstance(node, dict):
            return at
        if node.get("leaf") is not None:
            rows[at][5] = float(node["leaf"])
        elif depth < MAX_DEPTH and node.get("split") is not None and node.get("split_condition") is not None:
            left, right = put(node.get("left"), depth + 1), put(node.get("right"), depth + 1)
            rows[at] = [int(node["split"]), float(node["split_condition"]), left, right, int(node.get("missing") == 1), 0.0]
        return at

    put(root, 0)
    a = np.array(rows, dtype=float)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4] == 1, a[:, 5]


def _ready(model: dict, width: int) -> list[tuple[np.ndarray, ...]]:
    """(feature, condition, missing goes right, children by twice the node plus right, value) of each tree for rows of ``width`` features."""
    out = []
    for root in _roots(model):
        feature, condition, left, right, away, value = _flat(root)
        lost = feature >= width
        left, right = np.where(lost & away, right, left), np.where(lost & ~away, left, right)
        out.append((np.where(lost, 0, feature), condition, away, np.column_stack([left, right]).ravel(), value))
    return out


def evaluate(model: dict, x: np.ndarray, ready: list | None = None) -> np.ndarray:
    """Scores of rows of features (NaN is missing), all rows through a level at a time, as many as a tree has."""
    if not isinstance(model, dict) or not isinstance(model.get("trees"), list):
        return np.full(len(x), 0.5)
    total = np.full(len(x), float(model.get("base_score", 0.5)))
    cells, first = np.ascontiguousarray(x, dtype=float).ravel(), np.arange(len(x)) * x.shape[1]
    for feature, condition, away, child, value in _ready(model, x.shape[1]) if ready is None else ready:
        at = np.zeros(len(x), dtype=int)
        for _ in range(MAX_DEPTH + 1):
            f = feature.take(at)
            if (f < 0).all():
                break
            v = cells.take(first + np.maximum(f, 0))
            at = child.take(2 * at + np.where(np.isnan(v), away.take(at), v > condition.take(at)))
        total += value[at]
    out = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if model.get("objective") == "binary:logistic" else np.clip(total, 0, 1)
    return np.where(np.isfinite(total), out, 0.5)


def expression(model: dict, features: list[str]) -> Column:
    """The same as one expression of nested CASEs, for small models."""

    def walk(node: Any, depth: int) -> Column:
        if not isinstance(node, dict):
            return F.lit(0.0)
        if node.get("leaf") is not None:
            return F.lit(float(node["leaf"]))
        if depth >= MAX_DEPTH or node.get("split") is None or node.get("split_condition") is None:
            return F.lit(0.0)
        left, right = walk(node.get("left"), depth + 1), walk(node.get("right"), depth + 1)
        lost = right if node.get("missing") == 1 else left
        if int(node["split"]) >= len(features):
            return lost
        c = F.col(features[int(node["split"])]).cast("double")
        return F.when(c.isNull() | F.isnan(c), lost).when(c <= float(node["split_condition"]), left).otherwise(right)

    total = F.lit(float(model.get("base_score", 0.5)))
    for root in _roots(model):
        total = total + walk(root, 0)
    if model.get("objective") == "binary:logistic":
        bounded = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))
        return F.when(F.isnan(total), 0.5).otherwise(1 / (1 + F.exp(-bounded)))
    return F.when(F.isnan(total) | (F.abs(total) == float("inf")), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def nodes(model: dict) -> int:
    return sum(len(_flat(r)[0]) for r in _roots(model))


def scorer(model: dict, features: list[str] = FEATURES) -> Column:
    """Score column: an expression for a small model, else a vectorised function."""
    if nodes(model) <= EXPRESSION_NODES:
        return expression(model, features)

    ready = _ready(model, len(features))

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(evaluate(model, np.column_stack([c.to_numpy(dtype=float) for c in cols]), ready))

    return run(*[F.col(c).cast("double") for c in features])


def select_scorer(bundle: dict[str, dict], features: list[str] = FEATURES) -> Column:
    """The thorough model where its first feature is present, else the fast one;
    the other, or any, where the wanted one is absent."""
    names = list(bundle)
    pick = lambda *wanted: scorer(bundle[next((w for w in wanted if w in bundle), names[0])], features)
    first = F.col(features[15]).cast("double")
    return F.when(first.isNotNull() & ~F.isnan(first), pick("thorough", "fast")).otherwise(pick("fast", "thorough"))


def train(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 20, depth: int = 4, seed: int = 42) -> dict:
    """Boosted trees on present labels; missing features enter as -1. Returns a model.

    The rows that a tree learns from are drawn by ``row_id`` where there is one, else by what is in them.
    """
    y = F.col(label)
    ids = ["row_id"] if "row_id" in rows.columns else [*features, label]
    good = rows.filter(y.isNotNull() & ~F.isnan(y) & y.between(0.0, 1.0)).select(F.xxhash64(*ids).bitwiseAND(F.lit(0xFFFFFFFF)).alias("_h"), y.cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features])
    fitted = boosting.fit(good, features, rounds, depth, seed, getattr(rows, "_cuts", None))
    return {"trees": fitted["trees"], "base_score": 0.0, "objective": "reg:squarederror", "feature_names": features, "importances": fitted["importances"]}


def cross_validate(rows: DataFrame, features: list[str], key: str, label: str = "label", folds: int = 5, **options: Any) -> DataFrame:
    """(fold, n, mae, rmse, r2): each fold of keys scored by a model of the others. The models are trained at the same time."""
    from .rollup import regression_metrics

    y = F.col(label)
    fold = rows.filter(y.isNotNull() & ~F.isnan(y) & y.between(0.0, 1.0)).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    # cut points from the same rows as the trees, but all folds in one scan
    found = boosting.summaries(fold.select("fold", *[F.col(c).cast("double").alias(c) for c in features]), features, F.col("fold"))
    with ThreadPoolExecutor(folds) as pool:
        runs = []
        for k in range(folds):
            others = fold.filter(F.col("fold") != k)
            others._cuts = boosting.find_cuts(found, without=k)
            runs.append(pool.submit(train, others, features, label, **options))
            wait(runs[-1:], timeout=0.2)  # begun in the order of the folds
        ready = [(m | {"trees": []}, _ready(m, len(features))) for m in (r.result() for r in runs)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no, x = b.column(0).to_numpy(), np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
            out = np.empty(b.num_rows)
            for k, (m, trees) in enumerate(ready):
                at = np.flatnonzero(no == k)
                out[at] = evaluate(m, x[at], trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["fold", label, "score"])

    scored = fold.select("fold", y.cast("double").alias(label), *[F.col(c).cast("double") for c in features]).mapInArrow(score, f"fold long, `{label}` double, score double")
    return regression_metrics(scored, label, by=["fold"])


def top_features(model: dict, k: int = 10) -> list[tuple[str, float]]:
    """The k features a trained model leans on most."""
    return sorted(zip(model["feature_names"], model["importances"], strict=True), key=lambda x: -x[1])[:k]
