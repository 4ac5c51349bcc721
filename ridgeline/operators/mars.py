"""Bagged hinge-basis regression (B4, additive MARS of degree 1).

Candidate basis: a mirrored hinge pair ``max(0, x - t)``, ``max(0, t - x)``
at quantile knots of each numeric feature, plus 0/1 features as they are.
The Grams of all bootstrap draws (Poisson(1) weights) come from ONE pass that
reads a row once, whatever the number of draws.  Per draw, the forward pass adds
the pair with the largest RSS drop and the backward pass keeps the subset
with the smallest GCV, ``RSS/n / (1 - C/n)^2`` with ``C = terms + 2 (terms-1)/2``
(Friedman 1991).  Each draw is a linear model in the basis, so the bag is
the mean coefficient vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, poisson_thresholds
from .gram import Gram


class HingeModel:
    def __init__(self, basis: list[tuple[str, Column]], coef: np.ndarray):
        self.basis, self.coef = basis, coef

    def expr(self) -> Column:
        e = F.lit(float(self.coef[0]))
        for (_, c), b in zip(self.basis, self.coef[1:]):
            if b != 0.0:
                e = e + F.lit(float(b)) * c
        return e

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expr())


def _terms(df: DataFrame, numeric: list[str], binary: list[str], knots: int) -> list[tuple[str, float | None, int]]:
    """``(feature, knot, side)`` of every basis column; a 0/1 feature has no knot."""
    probs = [(i + 1) / (knots + 1) for i in range(knots)]
    qs = df.approxQuantile(numeric, probs, 1e-3) if numeric else []
    hinges = [(f, t, side) for f, q in zip(numeric, qs) for t in sorted(set(q)) for side in (1, -1)]
    return hinges + [(f, None, 0) for f in binary]


def _basis(terms: list) -> tuple[list, list]:
    basis, groups = [], []
    for f, t, side in terms:
        x = F.col(f).cast("double")
        if t is None:
            basis.append((f, x))
            groups.append([len(basis) - 1])
        elif side > 0:
            basis += [(f"{f}_gt_{t:g}", F.greatest(x - F.lit(t), F.lit(0.0))),
                      (f"{f}_lt_{t:g}", F.greatest(F.lit(t) - x, F.lit(0.0)))]
            groups.append([len(basis) - 2, len(basis) - 1])
    return basis, groups


def hinge_basis(df: DataFrame, numeric: list[str], binary: list[str], knots: int = 8):
    return _basis(_terms(df, numeric, binary, knots))


def _draw_grams(df: DataFrame, y: str, terms: list, names: list[str], key: str, draws: int, seed: int) -> Gram:
    """Gram of ``(1, basis, y)`` per bootstrap draw, from one pass.

    A row crosses to Python once, with its predictors and a uniform per draw; basis and weights are made there.
    A NULL numeric value adds nothing to its hinges; rows without a 0/1 feature or without the outcome are not used.
    """
    inputs = list(dict.fromkeys(f for f, _, _ in terms))
    d = df.dropna(subset=[*(f for f, t, _ in terms if t is None), y])
    d = d.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(inputs)], F.col(y).cast("double").alias("_y"),
                 *[hash_uniform(seed, key, F.lit(k)).alias(f"_u{k}") for k in range(1, draws + 1)])
    at, limits, q = {c: i for i, c in enumerate(inputs)}, np.array(poisson_thresholds()), len(terms) + 2
    iu = np.triu_indices(q)

    def design(b, shift):
        z = np.ones((b.num_rows, q))
        cols = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(inputs))]
        for j, (f, t, side) in enumerate(terms, 1):
            z[:, j] = cols[at[f]] if t is None else np.fmax(side * (cols[at[f]] - t), 0.0)
        z[:, -1] = b.column(len(inputs)).to_numpy(zero_copy_only=False)
        z[:, 1:] -= shift
        return z

    def weight(b, k):
        u = b.column(len(inputs) + 1 + k).to_numpy(zero_copy_only=False).astype(float)
        return np.searchsorted(limits, u, side="right") * ~np.isnan(u)  # a row without a key is in no draw

    def sums(batches):
        total, n = np.zeros(q - 1), 0
        for b in batches:
            drawn = sum((weight(b, k) > 0).astype(float) for k in range(draws))
            total += drawn @ design(b, 0.0)[:, 1:]
            n += drawn.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(q), pa.int32()), pa.array([*total, float(n)])], ["_j", "_v"])

    def fold(batches):
        acc = np.zeros((draws, q, q))
        for b in batches:
            z = design(b, shift)
            for k in range(draws):
                acc[k] += (z * weight(b, k)[:, None]).T @ z
        for k in range(draws):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(iu[0]), k + 1), pa.int32()), pa.array(iu[0], pa.int32()), pa.array(iu[1], pa.int32()),
                                              pa.array(acc[k][iu])], ["_draw", "_i", "_j", "_v"])

    # columns are taken about their means over all drawn rows
    got = {r["_j"]: r["v"] for r in d.mapInArrow(sums, "_j int, _v double").groupBy("_j").agg(F.sum("_v").alias("v")).collect()}
    n = got.get(q - 1, 0.0)
    shift = np.array([got[j] / n for j in range(q - 1)]) if n else np.zeros(q - 1)
    mats: dict = {}
    for r in d.mapInArrow(fold, "_draw int, _i int, _j int, _v double").groupBy("_draw", "_i", "_j").agg(F.sum("_v").alias("v")).collect():
        m = mats.setdefault((r["_draw"],), np.zeros((q, q)))
        m[r["_i"], r["_j"]] = m[r["_j"], r["_i"]] = r["v"]
    return Gram([*names, y], shift, {k: m for k, m in mats.items() if m[0, 0] > 0}, ["_draw"])


def _rss_subset(g: np.ndarray, xi: list[int], yi: int) -> float:
    """RSS of the outcome on the columns xi and the intercept, from a Gram (minimum norm where they are aliased)."""
    idx = [0] + xi
    a, b = g[np.ix_(idx, idx)], g[idx, yi]
    return float(g[yi, yi] - np.linalg.lstsq(a, b, rcond=None)[0] @ b)


def _gcv(rss, n, terms, penalty=2.0):
    c = terms + penalty * (terms - 1) / 2.0
    return (rss / n) / max(1.0 - c / n, 1e-12) ** 2


def _fit_draw(G, groups, yi, max_terms):
    n = G[0, 0]
    chosen: list[int] = []
    while len(chosen) + 1 < max_terms:
        best, best_rss = None, _rss_subset(G, [1 + j for j in chosen], yi) if chosen else G[yi, yi] - G[0, yi] ** 2 / n
        for gi, grp in enumerate(groups):
            if any(j in chosen for j in grp):
                continue
            r = _rss_subset(G, [1 + j for j in chosen + grp], yi)
            if r < best_rss - 1e-9 * abs(best_rss):
                best, best_rss = gi, r
        if best is None:
            break
        chosen += groups[best]
    cur = list(chosen)
    best_set, best_g = list(cur), _gcv(_rss_subset(G, [1 + j for j in cur], yi) if cur else G[yi, yi], n,
                                       len(cur) + 1)
    while cur:
        cand = min(cur, key=lambda j: _rss_subset(G, [1 + k for k in cur if k != j], yi))
        cur = [k for k in cur if k != cand]
        rss = _rss_subset(G, [1 + k for k in cur], yi) if cur else G[yi, yi] - G[0, yi] ** 2 / n
        g = _gcv(rss, n, len(cur) + 1)
        if g < best_g:
            best_set, best_g = list(cur), g
    return best_set


def bagged_mars(df: DataFrame, y: str, numeric: list[str], binary: list[str], key: str, draws: int = 10,
                knots: int = 8, max_terms: int = 21, seed: int = 1) -> HingeModel:
    terms = _terms(df, numeric, binary, knots)
    basis, groups = _basis(terms)
    names = [n for n, _ in basis]
    g = _draw_grams(df, y, terms, names, key, draws, seed)
    yi = g.index(y)
    total = np.zeros(len(names) + 1)
    for key_, G in g.mats.items():
        chosen = _fit_draw(G, groups, yi, max_terms)
        idx = [0] + [1 + j for j in chosen]
        a = G[np.ix_(idx, idx)]
        b = G[idx, yi]
        beta_c = np.linalg.lstsq(a, b, rcond=None)[0]
        coef = np.zeros(len(names) + 1)
        for pos, j in enumerate(chosen):
            coef[1 + j] = beta_c[1 + pos]
        coef[0] = beta_c[0] + g.shift[-1] - sum(coef[1 + j] * g.shift[j] for j in chosen)
        total += coef
    return HingeModel(basis, total / len(g.mats))
