"""Neural regressors (K1-K3).

* K3 random-feature regression: a fixed random tanh layer written as Spark
  column expressions, then least squares from one GRAM pass.
* K1/K2 multilayer perceptron (linear output, weight decay): full-batch
  L-BFGS.  The driver holds only the weight vector; every loss/gradient
  evaluation is one Spark job -- each partition computes its partial
  loss and gradient with numpy on Arrow batches (``mapInPandas``) and Spark
  sums the packed vectors with a ``groupBy`` on the vector index, so the
  data never leaves the executors.  The standardised training frame is
  persisted once per fit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recode import Standardizer


class RandomFeatureModel:
    """Fixed random tanh layer + least-squares output layer."""

    def __init__(self, x: list[str], means: np.ndarray, sds: np.ndarray, W: np.ndarray, b: np.ndarray):
        self.x, self.means, self.sds, self.W, self.b = x, means, sds, W, b
        self.beta: np.ndarray | None = None
        self.fit = None

    def features(self, X: np.ndarray) -> np.ndarray:
        return np.tanh(((X - self.means) / self.sds) @ self.W.T + self.b)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Arrow-batched scoring: one pandas UDF call per batch, numpy inside."""
        feats, beta = self.features, np.nan_to_num(self.beta)

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            X = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
            return pd.Series(beta[0] + feats(X) @ beta[1:])

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.x]))


def random_feature_regression(df: DataFrame, y: str, x: list[str], n_hidden: int, seed: int = 1,
                              scale: float = 1.0) -> RandomFeatureModel:
    """K3: hidden weights drawn once from ``seed``; output layer by least squares.

    Inputs are standardised with moments from one aggregate; the hidden layer
    is evaluated inside the GRAM partition pass, so the n x n_hidden matrix
    is never materialised as a table.
    """
    from .gram import gram_mapped
    from .linear import ols_from_gram
    scaler = Standardizer(list(x)).fit(df)
    x = [c for c in x if scaler.sds[c] not in (None, 0.0)]
    means = np.array([scaler.means[c] for c in x])
    sds = np.array([scaler.sds[c] for c in x])
    rng = np.random.default_rng(seed)
    model = RandomFeatureModel(x, means, sds, rng.uniform(-scale, scale, size=(n_hidden, len(x))),
                               rng.uniform(-scale, scale, size=n_hidden))
    names = [f"h{k}" for k in range(n_hidden)]
    g = gram_mapped(df, x, model.features, names, y)
    fit = ols_from_gram(g.total(), g.shift, g.cols, names, y)
    model.beta, model.fit = fit.coef, fit
    return model


# ------------------------------------------------------------------ MLP ---

def _unpack(w: np.ndarray, sizes: list[int]):
    mats, pos = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        W = w[pos:pos + (a + 1) * b].reshape(a + 1, b)
        mats.append(W)
        pos += (a + 1) * b
    return mats


def n_weights(sizes: list[int]) -> int:
    return sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:]))


def forward(X: np.ndarray, mats) -> list[np.ndarray]:
    acts = [X]
    for i, W in enumerate(mats):
        z = acts[-1] @ W[1:] + W[0]
        acts.append(z if i == len(mats) - 1 else 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))
    return acts


def _loss_grad_partial(X, yv, mats):
    acts = forward(X, mats)
    err = acts[-1][:, 0] - yv
    loss = float(err @ err)
    grads = []
    delta = 2.0 * err[:, None]
    for i in range(len(mats) - 1, -1, -1):
        a = acts[i]
        gW = np.vstack([delta.sum(axis=0, keepdims=True), a.T @ delta])
        grads.append(gW)
        if i > 0:
            delta = (delta @ mats[i][1:].T) * a * (1 - a)
    grads.reverse()
    return loss, np.concatenate([g.ravel() for g in grads])


class MLPModel:
    def __init__(self, scaler: Standardizer, x: list[str], sizes: list[int], w: np.ndarray, y_mean: float,
                 y_sd: float):
        self.scaler, self.x, self.sizes, self.w = scaler, x, sizes, w
        self.y_mean, self.y_sd = y_mean, y_sd

    def prediction_expr(self) -> Column:
        """Forward pass as JVM column expressions (hidden layers are small)."""
        mats = _unpack(self.w, self.sizes)
        cur = [(F.col(c).cast("double") - F.lit(self.scaler.means[c])) / F.lit(self.scaler.sds[c])
               for c in self.x]
        for li, W in enumerate(mats):
            nxt = []
            for k in range(W.shape[1]):
                e = F.lit(float(W[0, k]))
                for j, c in enumerate(cur):
                    e = e + F.lit(float(W[j + 1, k])) * c
                nxt.append(e if li == len(mats) - 1 else F.lit(1.0) / (F.lit(1.0) + F.exp(-e)))
            cur = nxt
        return cur[0] * F.lit(self.y_sd) + F.lit(self.y_mean)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.prediction_expr())


def _lbfgs(fun, w0, maxit=100, m=10, tol=1e-6):
    """Plain L-BFGS with a backtracking (Armijo) line search."""
    w = w0.copy()
    f, g = fun(w)
    S, Yl = [], []
    for _ in range(maxit):
        q = g.copy()
        alphas = []
        for s, yv in reversed(list(zip(S, Yl))):
            a = (s @ q) / (yv @ s)
            alphas.append(a)
            q -= a * yv
        if S:
            q *= (S[-1] @ Yl[-1]) / (Yl[-1] @ Yl[-1])
        for (s, yv), a in zip(zip(S, Yl), reversed(alphas)):
            bta = (yv @ q) / (yv @ s)
            q += s * (a - bta)
        d = -q
        if g @ d >= 0:
            d = -g
        step, f_new = 1.0, None
        for _ls in range(30):
            w_new = w + step * d
            f_new, g_new = fun(w_new)
            if f_new <= f + 1e-4 * step * (g @ d):
                break
            step *= 0.5
        s, yv = w_new - w, g_new - g
        if yv @ s > 1e-12:
            S.append(s)
            Yl.append(yv)
            if len(S) > m:
                S.pop(0)
                Yl.pop(0)
        converged = abs(f - f_new) <= tol * max(1.0, abs(f))
        w, f, g = w_new, f_new, g_new
        if converged:
            break
    return w, f


def mlp(df: DataFrame, y: str, x: list[str], hidden: list[int], decay: float = 0.0, maxit: int = 100,
        seed: int = 1, rang: float = 0.5) -> MLPModel:
    """K1/K2: MLP regressor with logistic hidden units and a linear output.

    Objective ``sum((y - f(x))^2) + decay * |w|^2`` on standardised inputs
    and outcome; weights start uniform in ``[-rang, rang]`` from ``seed``.
    """
    scaler = Standardizer(list(x)).fit(df)
    x = [c for c in x if scaler.sds[c] not in (None, 0.0)]
    scaler = Standardizer(x + [y]).fit(df)
    z = scaler.transform(df.select(*x, y)).na.drop().persist()
    sizes = [len(x), *hidden, 1]
    nw = n_weights(sizes)

    def part_fn(w):
        def fn(batches):
            mats = _unpack(w, sizes)
            loss, grad = 0.0, np.zeros(nw)
            for pdf in batches:
                if pdf.empty:
                    continue
                lo, gr = _loss_grad_partial(pdf[x].to_numpy(np.float64), pdf[y].to_numpy(np.float64), mats)
                loss += lo
                grad += gr
            yield pd.DataFrame({"_i": np.arange(nw + 1, dtype=np.int32), "_v": np.concatenate([[loss], grad])})
        return fn

    def fun(w):
        rows = (z.mapInPandas(part_fn(w), "_i int, _v double")
                .groupBy("_i").agg(F.sum("_v").alias("_v")).collect())
        v = np.zeros(nw + 1)
        for r in rows:
            v[r["_i"]] = r["_v"]
        return v[0] + decay * (w @ w), v[1:] + 2 * decay * w

    rng = np.random.default_rng(seed)
    w0 = rng.uniform(-rang, rang, nw)
    try:
        w, _ = _lbfgs(fun, w0, maxit=maxit)
    finally:
        z.unpersist()
    inner = Standardizer(x).fit(df)
    return MLPModel(inner, x, sizes, w, scaler.means[y], scaler.sds[y])


def mlp_random_search(train: DataFrame, valid: DataFrame, y: str, x: list[str], n: int, seed: int,
                      max_units: int = 6, maxit: int = 30):
    """K2: random two-layer sizes, each scored on the validation rows."""
    from .tables import rmse
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        h = [int(rng.integers(1, max_units + 1)), int(rng.integers(1, max_units + 1))]
        m = mlp(train, y, x, h, decay=0.01, maxit=maxit, seed=seed)
        p = m.transform(valid)
        out.append((h[0], h[1], float(p.agg(rmse(p, "prediction", y)).first()[0])))
    return out


__all__ = ["random_feature_regression", "mlp", "mlp_random_search", "math"]
