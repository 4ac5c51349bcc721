"""GRAM kernel: one-pass cross-product aggregate, optionally per group.

For z = (1, x_1 - m_1, ..., x_p - m_p) the kernel returns, per group,
``sum(w * z z')`` -- n, first moments and all cross products.  Each
partition folds its rows into a (p+1)^2 matrix with numpy (Arrow batches via
``mapInPandas``) and emits only the upper triangle per group; Spark then
sums those entries with an ordinary ``groupBy`` (map-side combined).  The
shuffle therefore carries ``partitions x groups x p^2/2`` numbers whatever
the row count, and the driver sees ``groups x p^2/2``.

Columns are centred by a first-pass mean (one global ``agg``) so the sums of
squares do not lose precision on large tables.  Everything derived from a
Gram (OLS with aliasing, ridge/lasso/elastic-net paths, stepwise search,
correlations, per-fold CV) is p x p linear algebra on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLS = 1500


@dataclass
class Gram:
    cols: list[str]               # variables after the leading intercept
    shift: np.ndarray             # centring values subtracted from each variable
    mats: dict = field(default_factory=dict)   # group key tuple -> (q, q) matrix
    by: list[str] = field(default_factory=list)

    def total(self) -> np.ndarray:
        return sum(self.mats.values())

    def index(self, name: str) -> int:
        return 1 + self.cols.index(name)

    def groups(self):
        return sorted(self.mats)


def _partials(by, cols, weight, shift):
    q = len(cols) + 1
    iu = np.triu_indices(q)

    def fn(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.empty((len(pdf), q))
            z[:, 0] = 1.0
            z[:, 1:] = pdf[cols].to_numpy(dtype=np.float64) - shift
            w = pdf[weight].to_numpy(dtype=np.float64) if weight else None
            if by:
                for key, idx in pdf.groupby(by, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    zg = z[idx]
                    g = (zg * w[idx, None]).T @ zg if w is not None else zg.T @ zg
                    acc[key] = acc.get(key, 0) + g
            else:
                g = (z * w[:, None]).T @ z if w is not None else z.T @ z
                acc[()] = acc.get((), 0) + g
        for key, g in acc.items():
            out = {b: [k] * len(iu[0]) for b, k in zip(by, key)}
            out.update({"_i": iu[0].astype(np.int32), "_j": iu[1].astype(np.int32), "_v": g[iu]})
            yield pd.DataFrame(out)
    return fn


def gram(df: DataFrame, cols: list[str], by: list[str] = (), weight: str | None = None,
         center: bool = True, max_groups: int = 100_000) -> Gram:
    """Build the Gram of ``(1, cols)`` per ``by`` group in one scan (plus a mean pass)."""
    by = list(by)
    if len(cols) > MAX_COLS:
        raise ValueError(f"GRAM supports at most {MAX_COLS} columns")
    need = by + cols + ([weight] if weight else [])
    d = df.select(*need).na.drop(subset=cols + ([weight] if weight else []))
    d = d.select(*by, *[F.col(c).cast("double").alias(c) for c in cols],
                 *([F.col(weight).cast("double").alias(weight)] if weight else []))
    if center:
        row = d.agg(*[F.avg(c).alias(c) for c in cols]).first()
        shift = np.array([row[c] if row[c] is not None else 0.0 for c in cols], dtype=np.float64)
    else:
        shift = np.zeros(len(cols))
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                       + ["_i int", "_j int", "_v double"])
    parts = d.mapInPandas(_partials(by, cols, weight, shift), schema)
    summed = parts.groupBy(*by, "_i", "_j").agg(F.sum("_v").alias("_v"))
    q = len(cols) + 1
    cap = max_groups * q * (q + 1) // 2
    rows = summed.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError("too many GRAM groups")
    mats: dict = {}
    for r in rows:
        key = tuple(r[b] for b in by)
        m = mats.setdefault(key, np.zeros((q, q)))
        m[r["_i"], r["_j"]] = r["_v"]
        m[r["_j"], r["_i"]] = r["_v"]
    return Gram(list(cols), shift, mats, by)


def correlations(g: np.ndarray) -> np.ndarray:
    """Pearson correlation matrix of the variables of one Gram matrix."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov / np.outer(sd, sd)


def _mapped_partials(by, inputs, y, fn, q, shift_y):
    iu = np.triu_indices(q)

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            H = fn(pdf[inputs].to_numpy(dtype=np.float64))
            z = np.empty((len(pdf), q))
            z[:, 0] = 1.0
            z[:, 1:q - 1] = H
            z[:, q - 1] = pdf[y].to_numpy(dtype=np.float64) - shift_y
            if by:
                for key, idx in pdf.groupby(by, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    acc[key] = acc.get(key, 0) + z[idx].T @ z[idx]
            else:
                acc[()] = acc.get((), 0) + z.T @ z
        for key, g in acc.items():
            out = {b: [k] * len(iu[0]) for b, k in zip(by, key)}
            out.update({"_i": iu[0].astype(np.int32), "_j": iu[1].astype(np.int32), "_v": g[iu]})
            yield pd.DataFrame(out)
    return run


def gram_mapped(df: DataFrame, inputs: list[str], fn, names: list[str], y: str,
                by: list[str] = ()) -> Gram:
    """GRAM of ``(1, fn(inputs), y)`` where ``fn`` is a numpy feature map.

    The map runs inside the partition pass (no wide intermediate frame);
    mapped features must be bounded (e.g. tanh units), the outcome is centred.
    """
    by = list(by)
    d = df.select(*by, *[F.col(c).cast("double").alias(c) for c in inputs],
                  F.col(y).cast("double").alias(y)).na.drop(subset=inputs + [y])
    my = d.agg(F.avg(y)).first()[0] or 0.0
    q = len(names) + 2
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                       + ["_i int", "_j int", "_v double"])
    summed = (d.mapInPandas(_mapped_partials(by, inputs, y, fn, q, my), schema)
              .groupBy(*by, "_i", "_j").agg(F.sum("_v").alias("_v")))
    mats: dict = {}
    for r in summed.collect():
        key = tuple(r[b] for b in by)
        m = mats.setdefault(key, np.zeros((q, q)))
        m[r["_i"], r["_j"]] = r["_v"]
        m[r["_j"], r["_i"]] = r["_v"]
    shift = np.concatenate([np.zeros(len(names)), [my]])
    return Gram(list(names) + [y], shift, mats, by)
