"""Componentwise boosting of penalised splines (B14), from one pass over the rows.

Every numeric feature has a cubic B-spline basis on equidistant knots; a fit is penalised by second
differences, with the penalty at which the smoother has ``df`` degrees of freedom
(``tr(2S - S'S)``).  A feature of few values has one column per value instead.

All that a round needs is ``B'r`` per feature, and ``B'r`` changes by ``-nu * B_f' B_g b``
when term g is added.  So the cross products of all bases and the outcome are summed once
(each task folds its rows, Spark adds the blocks), and all rounds run on these
numbers: (features x basis columns) squared, whatever the rows.

A NULL adds nothing to its feature's term; values outside the range of the training rows are
taken at the nearest end.  Rows without an outcome are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hist import make_bins

DEGREE = 3
FEW_VALUES = 8
MAX_COLUMNS = 4000


@dataclass
class Basis:
    """Columns of one feature: B-splines on ``[lo, hi]`` with ``knots`` inner knots, or one indicator per value."""
    lo: float = 0.0
    hi: float = 0.0
    knots: int = 0
    values: tuple = ()

    @property
    def size(self) -> int:
        return len(self.values) or self.knots + DEGREE + 1

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Rows x columns; a NULL (NaN) gives a row of zeros."""
        known = ~np.isnan(x)
        if self.values:
            return (x[:, None] == np.array(self.values)[None, :]).astype(float)
        step = (self.hi - self.lo) / (self.knots + 1)
        at = np.clip(np.where(known, x, self.lo), self.lo, self.hi)
        cell = np.minimum(((at - self.lo) / step).astype(int), self.knots)
        u = (at - self.lo) / step - cell
        # the four cubic pieces that are not zero on a cell of equidistant knots
        pieces = np.stack([(1 - u) ** 3, 3 * u ** 3 - 6 * u ** 2 + 4, -3 * u ** 3 + 3 * u ** 2 + 3 * u + 1, u ** 3], 1) / 6
        out = np.zeros((len(x), self.size))
        np.put_along_axis(out, cell[:, None] + np.arange(DEGREE + 1)[None, :], pieces, 1)
        out[~known] = 0
        return out

    def penalty(self) -> np.ndarray:
        """Squared second differences of neighbouring coefficients."""
        if self.values:
            return np.eye(self.size)
        d = np.diff(np.eye(self.size), 2, axis=0)
        return d.T @ d


def make_bases(df: DataFrame, features: list[str], knots: int = 20) -> list[Basis]:
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    few = make_bins(df, features, FEW_VALUES).cuts
    out = []
    for i, c in enumerate(features):
        lo, hi = ends[f"a{i}"], ends[f"b{i}"]
        if lo is None or lo == hi:
            out.append(Basis(values=() if lo is None else (float(lo),), knots=0 if lo is not None else 1, lo=0.0, hi=1.0))
        elif len(few[c]) < FEW_VALUES - 1:
            out.append(Basis(values=(*map(float, few[c]), float(hi))))
        else:
            out.append(Basis(float(lo), float(hi), knots))
    return out


def cross_products(df: DataFrame, y: str, features: list[str], bases: list[Basis], center: float) -> tuple[np.ndarray, np.ndarray]:
    """``(Z'Z, Z'(y - center))`` of all basis columns Z: one pass, one block of rows per feature through the shuffle."""
    at = np.cumsum([0, *[b.size for b in bases]])
    width = int(at[-1])
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} basis columns; their products on the driver are bounded by {MAX_COLUMNS}")

    def fold(batches):
        total = np.zeros((width, width + 1))
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]
            for lo in range(0, b.num_rows, 4096):
                z = np.concatenate([q.columns(c[lo:lo + 4096]) for q, c in zip(bases, cols[1:])], 1)
                total[:, :width] += z.T @ z
                total[:, width] += z.T @ (cols[0][lo:lo + 4096] - center)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(bases)), pa.int32()),
                                          pa.array([total[p:q].tobytes() for p, q in zip(at, at[1:])], pa.binary())], ["f", "part"])

    def add(key, table):
        whole = sum(np.frombuffer(v) for v in table["part"].to_pylist())
        return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([whole.tobytes()], pa.binary())})

    d = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    rows = d.mapInArrow(fold, "f int, part binary").groupBy("f").applyInArrow(add, "f int, part binary").collect()
    out = np.zeros((width, width + 1))
    for r in rows:
        out[at[r["f"]]:at[r["f"] + 1]] = np.frombuffer(r["part"]).reshape(-1, width + 1)
    return out[:, :width], out[:, width]


def penalty_for(g: np.ndarray, pen: np.ndarray, df: float) -> float:
    """The factor of ``pen`` at which ``tr(2S - S'S)`` is ``df``; 0 where the basis has no more than that."""

    def freedom(lam):
        s = np.linalg.lstsq(g + lam * pen, g, rcond=None)[0]
        return 2 * np.trace(s) - np.trace(s @ s)

    scale = max(np.trace(g), 1e-12) / max(np.trace(pen), 1e-12)
    if freedom(0.0) <= df + 1e-9:
        return 0.0
    lo, hi = -12.0, 12.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if freedom(scale * 10 ** mid) > df else (lo, mid)
    return scale * 10 ** hi


@dataclass
class SmoothModel:
    base: float
    features: list
    bases: list
    coefs: list          # per feature
    path: list           # feature chosen in every round

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        base, used = self.base, [i for i, c in enumerate(self.coefs) if c.any()]
        if not used:
            return df.withColumn(out, F.lit(base))
        terms = [(self.bases[i], self.coefs[i]) for i in used]

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            f = np.full(len(cols[0]), base)
            for (q, c), v in zip(terms, cols):
                f = f + q.columns(v.to_numpy(dtype=float)) @ c
            return pd.Series(f)

        return df.withColumn(out, score(*[F.col(self.features[i]).cast("double") for i in used]))


def smooth_boost(df: DataFrame, y: str, features: list[str], mstop: int = 100, nu: float = 0.1, df_term: float = 4.0,
                 knots: int = 20) -> SmoothModel:
    """Each round adds ``nu`` times the single-feature smoother that takes most off the residual sum of squares."""
    center = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    if center is None:
        raise ValueError("no row with an outcome")
    bases = make_bases(df, features, knots)
    g, r = cross_products(df, y, features, bases, center)
    at = np.cumsum([0, *[b.size for b in bases]])
    parts = [slice(p, q) for p, q in zip(at, at[1:])]
    # the smoother of a feature as one matrix: coefficients from B'r
    solve = []
    for b, s in zip(bases, parts):
        lam = penalty_for(g[s, s], b.penalty(), df_term)
        solve.append(np.linalg.pinv(g[s, s] + lam * b.penalty(), rcond=1e-12))
    coefs, path = [np.zeros(b.size) for b in bases], []
    for _ in range(mstop):
        best = None
        for i, s in enumerate(parts):
            c = solve[i] @ r[s]
            drop = 2 * c @ r[s] - c @ g[s, s] @ c
            if best is None or drop > best[0] * (1 + 1e-12):
                best = (drop, i, c)
        _, i, c = best
        coefs[i] += nu * c
        r = r - nu * g[:, parts[i]] @ c
        path.append(features[i])
    return SmoothModel(float(center), list(features), bases, coefs, path)
