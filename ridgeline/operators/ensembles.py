"""Forests (B1, B2, grown by ``forest``) and gradient boosting of regression trees (B5, B6, B11, grown by ``boost``)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from .boost import GridBoost, SetBoost, Spec, walk
from .forest import Forest, fit_forest
from .quantiles import kth_values


def bagged_trees(df: DataFrame, y: str, features: list[str], key: str, trees: int = 25, min_node: int = 5,
                 max_depth: int = 10_000, seed: int = 1) -> Forest:
    """B1: bootstrap-aggregated full trees = a forest that tries every feature at each split."""
    return fit_forest(df, y, features, key, trees=trees, min_node=min_node, max_depth=max_depth, seed=seed)


def random_forest(df: DataFrame, y: str, features: list[str], key: str, trees: int = 100, mtry: int | None = None,
                  min_node: int = 5, sample_frac: float = 1.0, max_depth: int = 10_000, max_bins: int = 64,
                  seed: int = 1) -> Forest:
    """B2: random forest; ``mtry`` features at a node (a third of them by default), hashed bootstrap draws by ``key``."""
    return fit_forest(df, y, features, key, trees=trees, mtry=mtry or max(1, len(features) // 3), min_node=min_node,
                      sample_frac=sample_frac, max_depth=max_depth, max_bins=max_bins, seed=seed)


def held_back(df: DataFrame, key: str, fraction: float, seed: int, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: false for exactly ``floor(fraction * n)`` rows, those with the smallest hashes of their key."""
    d = df.withColumn("_u", hash_uniform(seed, key))
    n = d.count()
    train = math.floor(fraction * n)
    if train >= n:
        return d.withColumn(out, F.lit(False)).drop("_u")
    edge, below = kth_values(d, "_u", {(): [train]})[((), train)]
    if below != train:
        raise ValueError(f"rows share a hash at the edge of the training share: {key} must be a key")
    return d.withColumn(out, F.col("_u") >= F.lit(float(edge))).drop("_u")


def gbm(df: DataFrame, y: str, features: list[str], key: str, trees: int = 100, depth: int = 3, shrinkage: float = 0.1,
        min_obs: int = 10, bag_fraction: float = 1.0, train_fraction: float = 1.0, max_bins: int = 64,
        seed: int = 1) -> tuple[SetBoost, list[float]]:
    """Squared-loss boosting; ``depth`` splits a tree, best first.

    Returns the model and, with ``train_fraction`` below 1, the error on the rows held back after every tree.
    """
    spec = Spec(depth + 1, -1, shrinkage, 0.0, 0.0, float(min_obs), bag_fraction)
    valid = "_held" if train_fraction < 1.0 else None
    d = held_back(df, key, train_fraction, seed, "_held") if valid else df
    model, curve, _ = GridBoost(d, y, features, key, [spec], seed, max_bins, valid).fit(trees)[0]
    return model, curve


def tree_boost(df: DataFrame, y: str, features: list[str], key: str, rounds: int = 100, maxdepth: int = 2, nu: float = 0.1,
               min_node: int = 7, max_bins: int = 64, seed: int = 1) -> SetBoost:
    """Boosting of regression trees of ``maxdepth`` levels."""
    spec = Spec(0, maxdepth, nu, 0.0, 0.0, float(min_node))
    return GridBoost(df, y, features, key, [spec], seed, max_bins).fit(rounds)[0][0]


def gbm_rounds(model: SetBoost, df: DataFrame, y: str) -> DataFrame:
    """RMSE of one fitted boosting model at every tree count, from one pass over ``df``."""
    from .boost import arrays
    coder, base, eta, flat = model.coder, model.base, model.eta, arrays(model.trees, model.coder)

    def fold(batches):
        sse, n = np.zeros(len(flat)), 0
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]
            x = np.stack([coder.code(i, c) for i, c in enumerate(cols[1:])])
            f = np.full(b.num_rows, base)
            for k, (feature, left, mask, value) in enumerate(flat):
                f = f + eta * value[walk(x, feature, left, mask)]
                sse[k] += ((cols[0] - f) ** 2).sum()
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(flat) + 1), pa.int32()), pa.array(sse), pa.array([n] * len(flat), pa.int64())],
                                         ["trees", "sse", "n"])

    d = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double"), *[F.col(f).cast("double") for f in coder.features])
    return (d.mapInArrow(fold, "trees int, sse double, n bigint").groupBy("trees")
            .agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse")))
