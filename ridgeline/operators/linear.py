"""Linear models on the GRAM kernel.

One scan builds the Gram; fitting, summaries, penalty paths, per-fold CV
and subset search are p x p algebra on the driver.  Conventions:

* OLS aliases collinear columns in column order (R's pivoting rule):
  a column whose residual norm after the kept columns falls under
  ``ALIAS_TOL`` times its raw norm gets a NULL coefficient.
* Penalised fits minimise ``(1/2n) RSS + lambda * (alpha |b|_1 + (1-alpha)/2 |b|_2^2)``
  on predictors standardised with the population sd (divide by n), and
  report coefficients on the original scale.  The intercept is never
  penalised.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import ALIAS_TOL
from ..functions.stats import f_sf, t_sf2
from .gram import Gram, gram

INTERCEPT = "(Intercept)"


# ----------------------------------------------------------------- OLS ---

@dataclass
class LinearFit:
    terms: list[str]
    coef: np.ndarray          # original scale, NaN = aliased
    se: np.ndarray
    n: float
    rank: int
    rss: float
    tss: float

    @property
    def df_resid(self) -> float:
        return self.n - self.rank

    @property
    def sigma(self) -> float:
        return math.sqrt(self.rss / self.df_resid) if self.df_resid > 0 else float("nan")

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid

    @property
    def fstat(self) -> float:
        k = self.rank - 1
        return ((self.tss - self.rss) / k) / (self.rss / self.df_resid) if k > 0 else float("nan")

    @property
    def f_pvalue(self) -> float:
        return f_sf(self.fstat, self.rank - 1, self.df_resid)

    def t(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.coef / self.se

    def p(self) -> np.ndarray:
        return np.array([t_sf2(abs(v), self.df_resid) if np.isfinite(v) else np.nan for v in self.t()])


def _alias_order(a: np.ndarray, raw_ss: np.ndarray, tol: float = ALIAS_TOL) -> list[int]:
    """Indices kept by incremental Cholesky in column order."""
    kept: list[int] = []
    L = np.zeros((0, 0))
    for j in range(a.shape[0]):
        if kept:
            w = np.linalg.solve(L, a[kept, j]) if len(kept) else np.zeros(0)
            r = a[j, j] - w @ w
        else:
            w, r = np.zeros(0), a[j, j]
        if r > (tol ** 2) * max(raw_ss[j], 1e-300) and r > 0:
            m = len(kept)
            L2 = np.zeros((m + 1, m + 1))
            L2[:m, :m] = L
            L2[m, :m] = w
            L2[m, m] = math.sqrt(r)
            L = L2
            kept.append(j)
    return kept


def ols_from_gram(g: np.ndarray, shift: np.ndarray, cols: list[str], x: list[str], y: str) -> LinearFit:
    """OLS of y on (1, x) from one centred Gram matrix."""
    xi = [0] + [1 + cols.index(c) for c in x]
    yi = 1 + cols.index(y)
    a = g[np.ix_(xi, xi)]
    b = g[xi, yi]
    n = g[0, 0]
    m = np.concatenate([[0.0], shift[[cols.index(c) for c in x]]])
    # raw sums of squares for the aliasing rule: sum((xc + m)^2)
    raw_ss = np.array([a[k, k] + 2 * m[k] * a[0, k] + m[k] ** 2 * n if k else n for k in range(len(xi))])
    kept = _alias_order(a, raw_ss)
    ak = a[np.ix_(kept, kept)]
    inv = np.linalg.inv(ak)
    beta_c = inv @ b[kept]
    yy = g[yi, yi]
    rss = float(yy - beta_c @ b[kept])
    rss = max(rss, 0.0)
    ybar_c = g[0, yi] / n
    tss = float(yy - n * ybar_c ** 2)
    rank = len(kept)
    sigma2 = rss / (n - rank) if n > rank else float("nan")
    # back to the original scale: intercept = my + b0c - sum(b * m)
    full = np.full(len(xi), np.nan)
    full[kept] = beta_c
    T = np.eye(rank)
    for pos, k in enumerate(kept):
        if k != 0:
            T[0, pos] = -m[k]
    beta = T @ beta_c
    if 0 in kept:
        beta[kept.index(0)] += shift[cols.index(y)]
    cov = T @ inv @ T.T * sigma2
    coef = np.full(len(xi), np.nan)
    se = np.full(len(xi), np.nan)
    coef[kept] = beta
    se[kept] = np.sqrt(np.clip(np.diag(cov), 0, None))
    return LinearFit([INTERCEPT] + list(x), coef, se, float(n), rank, rss, tss)


class LinearModel:
    """A fitted linear predictor usable as a Column expression."""

    def __init__(self, terms: list[str], coef: np.ndarray, fit: LinearFit | None = None):
        self.terms, self.coef, self.fit = terms, coef, fit

    def prediction(self) -> Column:
        """L3: ``b0 + sum(b_j * x_j)``; aliased terms contribute nothing."""
        expr = F.lit(float(self.coef[0]) if np.isfinite(self.coef[0]) else 0.0)
        for t, b in zip(self.terms[1:], self.coef[1:]):
            if np.isfinite(b) and b != 0.0:
                expr = expr + F.lit(float(b)) * F.col(t).cast("double")
        return expr

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.prediction())

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(t, None if not np.isfinite(b) else float(b)) for t, b in zip(self.terms, self.coef)]
        return spark.createDataFrame(rows, "term string, estimate double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """L2: per-term estimate, se, t, p."""
        f = self.fit
        t, p = f.t(), f.p()
        rows = []
        for i, term in enumerate(f.terms):
            vals = [f.coef[i], f.se[i], t[i], p[i]]
            rows.append((term, *[None if not np.isfinite(v) else float(v) for v in vals]))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                           "t_value double, p_value double")

    def glance(self, spark: SparkSession) -> DataFrame:
        """L2: model-level statistics, one row."""
        f = self.fit
        return spark.createDataFrame([(int(f.n), int(f.rank), float(f.sigma), float(f.r2), float(f.adj_r2),
                                       float(f.fstat), float(f.f_pvalue), float(f.df_resid))],
                                     "n bigint, rank int, sigma double, r2 double, adj_r2 double, "
                                     "fstat double, f_pvalue double, df_resid double")


def ols(df: DataFrame, y: str, x: list[str], weight: str | None = None) -> LinearModel:
    """L1: least squares with an intercept from one GRAM pass."""
    g = gram(df, list(x) + [y], weight=weight)
    fit = ols_from_gram(g.total(), g.shift, g.cols, list(x), y)
    return LinearModel(fit.terms, fit.coef, fit)


def importance_t(model: LinearModel, spark: SparkSession) -> DataFrame:
    """Absolute t statistic per predictor (intercept excluded)."""
    t = model.fit.t()
    rows = [(term, float(abs(v))) for term, v in zip(model.terms[1:], t[1:]) if np.isfinite(v)]
    return spark.createDataFrame(rows, "term string, importance double")


# ------------------------------------------------------- penalised fits ---

@dataclass
class Standardized:
    C: np.ndarray       # (p, p) covariance of standardised x (divide by n)
    c: np.ndarray       # (p,) covariance of standardised x with y
    sx: np.ndarray      # population sd of x
    mx: np.ndarray      # mean of x (original scale)
    my: float
    n: float
    yy: float           # mean squared deviation of y


def standardized(g: np.ndarray, shift: np.ndarray, cols: list[str], x: list[str], y: str) -> Standardized:
    xi = [1 + cols.index(c) for c in x]
    yi = 1 + cols.index(y)
    n = g[0, 0]
    mean_c = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean_c, mean_c)
    xv = [i - 1 for i in xi]
    yv = yi - 1
    cxx = cov[np.ix_(xv, xv)]
    sx = np.sqrt(np.clip(np.diag(cxx), 0, None))
    safe = np.where(sx > 0, sx, 1.0)
    C = cxx / np.outer(safe, safe)
    c = cov[xv, yv] / safe
    mx = mean_c[xv] + shift[xv]
    my = mean_c[yv] + shift[yv]
    return Standardized(C, c, sx, mx, my, n, cov[yv, yv])


def lambda_max(s: Standardized, alpha: float) -> float:
    return float(np.max(np.abs(s.c)) / max(alpha, 1e-3))


def default_lambdas(s: Standardized, alpha: float, nlambda: int = 100) -> np.ndarray:
    ratio = 1e-4 if s.n > len(s.c) else 1e-2
    lmax = lambda_max(s, alpha)
    return np.exp(np.linspace(math.log(lmax), math.log(lmax * ratio), nlambda))


def _cd(s: Standardized, alpha: float, lam: float, b: np.ndarray, tol=1e-14, max_sweeps=100_000) -> np.ndarray:
    """Covariance-mode coordinate descent on the standardised problem.

    Keeps the gradient ``r = c - C b`` up to date with one vector update per
    coordinate move; stops when the largest weighted squared move
    ``C_jj * db^2`` of a sweep is below ``tol`` times the outcome variance
    (the glmnet rule).  Sweeps after the first only visit the active set
    until it settles, then one full sweep confirms.
    """
    C, c = s.C, s.c
    p = len(c)
    active = s.sx > 0
    if alpha == 0.0:
        idx = np.where(active)[0]
        out = np.zeros(p)
        A = C[np.ix_(idx, idx)] + lam * np.eye(len(idx))
        try:
            out[idx] = np.linalg.solve(A, c[idx]) if lam > 0 else np.linalg.lstsq(A, c[idx], rcond=None)[0]
        except np.linalg.LinAlgError:
            out[idx] = np.linalg.lstsq(A, c[idx], rcond=None)[0]
        return out
    l1, l2 = alpha * lam, (1 - alpha) * lam
    thresh = tol * max(s.yy, 1e-300)
    r = c - C @ b
    full = True
    for _ in range(max_sweeps):
        worst = 0.0
        coords = np.where(active)[0] if full else np.where(active & (b != 0))[0]
        for j in coords:
            cjj = C[j, j]
            z = r[j] + cjj * b[j]
            new = math.copysign(max(abs(z) - l1, 0.0), z) / (cjj + l2)
            d = new - b[j]
            if d != 0.0:
                r -= C[:, j] * d
                b[j] = new
                worst = max(worst, cjj * d * d)
        if worst < thresh:
            if full:
                break
            full = True
        else:
            full = False
    return b


def enet_path(s: Standardized, alpha: float, lambdas) -> np.ndarray:
    """Rows = lambdas, columns = (intercept, b_1..b_p) on the original scale."""
    p = len(s.c)
    b = np.zeros(p)
    out = np.zeros((len(lambdas), p + 1))
    for i, lam in enumerate(lambdas):
        b = _cd(s, alpha, float(lam), b.copy())
        safe = np.where(s.sx > 0, s.sx, 1.0)
        beta = np.where(s.sx > 0, b / safe, 0.0)
        out[i, 0] = s.my - beta @ s.mx
        out[i, 1:] = beta
    return out


class PenalizedPath:
    """One fit per lambda from a single Gram."""

    def __init__(self, df: DataFrame, y: str, x: list[str], alpha: float, lambdas=None,
                 nlambda: int = 100):
        self.y, self.x, self.alpha = y, list(x), alpha
        self.g = gram(df, self.x + [y])
        self.s = standardized(self.g.total(), self.g.shift, self.g.cols, self.x, y)
        self.lambdas = np.asarray(lambdas if lambdas is not None else default_lambdas(self.s, alpha, nlambda),
                                  dtype=float)
        self.coefs = enet_path(self.s, alpha, self.lambdas)

    def model(self, i: int) -> LinearModel:
        return LinearModel([INTERCEPT] + self.x, self.coefs[i])

    def path(self, spark: SparkSession) -> DataFrame:
        """Long ``(term, step, lambda, value)``."""
        terms = [INTERCEPT] + self.x
        rows = [(terms[j], i, float(lam), float(self.coefs[i, j]))
                for i, lam in enumerate(self.lambdas) for j in range(len(terms))]
        return spark.createDataFrame(rows, "term string, step int, lambda double, value double")


def ridge(df, y, x, lambdas=None) -> PenalizedPath:
    return PenalizedPath(df, y, x, 0.0, lambdas)


def lasso(df, y, x, lambdas=None) -> PenalizedPath:
    return PenalizedPath(df, y, x, 1.0, lambdas)


def coef_at(path: DataFrame, s: float) -> DataFrame:
    """Coefficients at ``lambda = s`` by linear interpolation on the grid.

    Outside the grid the nearest end is used.  Works on the long path table
    (one small window per term).
    """
    w = Window.partitionBy("term").orderBy(F.col("lambda").desc())
    d = path.withColumn("_next_l", F.lead("lambda").over(w)).withColumn("_next_v", F.lead("value").over(w))
    inside = d.filter((F.col("lambda") >= F.lit(s)) & (F.col("_next_l") < F.lit(s)))
    frac = (F.lit(s) - F.col("_next_l")) / (F.col("lambda") - F.col("_next_l"))
    interp = inside.select("term", (frac * F.col("value") + (F.lit(1.0) - frac) * F.col("_next_v")).alias("value"))
    ends = path.groupBy("term").agg(F.max("lambda").alias("lmax"), F.min("lambda").alias("lmin"))
    edge = (path.join(ends, "term")
            .filter(((F.lit(s) >= F.col("lmax")) & (F.col("lambda") == F.col("lmax")))
                    | ((F.lit(s) < F.col("lmin")) & (F.col("lambda") == F.col("lmin"))))
            .select("term", "value"))
    exact_bottom = (path.join(ends, "term").filter((F.lit(s) == F.col("lmin")) & (F.lit(s) < F.col("lmax"))
                                                    & (F.col("lambda") == F.col("lmin"))).select("term", "value"))
    return interp.unionByName(edge).unionByName(exact_bottom)


def fold_rss(g_fold: np.ndarray, coefs: np.ndarray, shift: np.ndarray, cols: list[str],
             x: list[str], y: str) -> np.ndarray:
    """Held-out RSS of each coefficient row on one fold's Gram, no rescan.

    With e = y - b0 - x b written in the centred coordinates z of the Gram,
    ``sum(e^2) = v' G v`` for ``v = (-(b0 + b.m - my), -b, 1)``.
    """
    xi = [0] + [1 + cols.index(c) for c in x] + [1 + cols.index(y)]
    G = g_fold[np.ix_(xi, xi)]
    mx = shift[[cols.index(c) for c in x]]
    my = shift[cols.index(y)]
    out = np.empty(len(coefs))
    for i, row in enumerate(coefs):
        b0, b = row[0], row[1:]
        v = np.concatenate([[my - b0 - b @ mx], -b, [1.0]])
        out[i] = float(v @ G @ v)
    return out


@dataclass
class CVResult:
    lambdas: np.ndarray
    cvm: np.ndarray
    cvsd: np.ndarray
    lambda_min: float
    lambda_1se: float
    fold_rmse: np.ndarray | None = None  # folds x lambdas


def cv_path(df: DataFrame, y: str, x: list[str], alpha: float, fold_col: str,
            lambdas=None, nlambda: int = 100) -> CVResult:
    """K-fold CV of a whole penalty path from ONE scan (per-fold Grams).

    Training Gram of fold f = total - Gram(f); the held-out error of every
    lambda is read off Gram(f) (``fold_rss``).  Fold error = MSE; the curve is
    the mean over folds with its standard error.
    """
    g = gram(df, list(x) + [y], by=[fold_col])
    total = g.total()
    s_all = standardized(total, g.shift, g.cols, list(x), y)
    lams = np.asarray(lambdas if lambdas is not None else default_lambdas(s_all, alpha, nlambda), dtype=float)
    errs = []
    for key in g.groups():
        gf = g.mats[key]
        s_tr = standardized(total - gf, g.shift, g.cols, list(x), y)
        coefs = enet_path(s_tr, alpha, lams)
        errs.append(fold_rss(gf, coefs, g.shift, g.cols, list(x), y) / gf[0, 0])
    E = np.array(errs)
    cvm = E.mean(axis=0)
    cvsd = E.std(axis=0, ddof=1) / math.sqrt(len(errs)) if len(errs) > 1 else np.zeros(len(lams))
    i = int(np.argmin(cvm))
    ok = np.where(cvm <= cvm[i] + cvsd[i])[0]
    return CVResult(lams, cvm, cvsd, float(lams[i]), float(lams[ok].max()), np.sqrt(E))


def lasso_knots(s: Standardized, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The exact lasso path: ``(penalties, coefficients of standardised predictors)`` at every knot, from zero to least squares.

    Between knots the coefficients are linear in the penalty.  At a knot a predictor joins the active
    set (its correlation with the residual has reached that of the others) or leaves it (its coefficient has reached zero).
    A predictor that is a combination of the active ones does not join.
    """
    p = len(s.c)
    b, r = np.zeros(p), s.c.astype(float).copy()
    usable = s.sx > 0
    lam = float(np.abs(np.where(usable, r, 0.0)).max(initial=0.0))
    start, knots = lam, [(lam, b.copy())]
    active: list[int] = []
    alias: set[int] = set()
    left = -1
    if lam <= 0:
        return np.array([0.0]), np.zeros((1, p))
    join = int(np.argmax(np.where(usable, np.abs(r), -1.0)))
    while lam > tol * start:
        if join >= 0:
            rest = s.C[join, join]
            if active:
                rest -= s.C[join, active] @ np.linalg.solve(s.C[np.ix_(active, active)], s.C[active, join])
            if rest < ALIAS_TOL:
                alias.add(join)
            else:
                active.append(join)
        d = np.zeros(p)
        d[active] = np.linalg.solve(s.C[np.ix_(active, active)], np.sign(r[active]))
        a = s.C @ d
        step, join, drop = lam, -1, -1
        for j in range(p):
            if not usable[j] or j in alias or j in active:
                continue
            for num, den in ((lam - r[j], 1 - a[j]), (lam + r[j], 1 + a[j])):
                # one that has just left moves inwards: its bound is met again only further on
                if den > tol and num / den < step and not (j == left and num / den < tol * start):
                    step, join, drop = max(0.0, num / den), j, -1
        for j in active:
            if d[j] * b[j] < 0 and -b[j] / d[j] < step:
                step, join, drop = -b[j] / d[j], -1, j
        b, r, lam = b + step * d, r - step * a, lam - step
        left = drop
        if drop >= 0:
            b[drop] = 0.0
            active.remove(drop)
            alias.clear()
        knots.append((max(lam, 0.0), b.copy()))
        if join < 0 and drop < 0:
            break
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def lasso_fraction(df: DataFrame, y: str, x: list[str], fractions) -> tuple[np.ndarray, np.ndarray]:
    """Lasso indexed by ``s = |b|_1 / max |b|_1`` (norm of the standardised coefficients), from the exact path.

    Returns the fractions and a row ``(intercept, b_1 .. b_p)`` on the original scale for each.
    """
    g = gram(df, list(x) + [y])
    s = standardized(g.total(), g.shift, g.cols, list(x), y)
    _, knots = lasso_knots(s)
    share = np.abs(knots).sum(axis=1)
    share = share / share[-1] if share[-1] > 0 else share
    f = np.clip(np.asarray(fractions, dtype=float), 0.0, 1.0)
    b = np.stack([np.interp(f, share, knots[:, j]) for j in range(len(x))], 1)
    beta = np.where(s.sx > 0, b / np.where(s.sx > 0, s.sx, 1.0), 0.0)
    return np.asarray(fractions, dtype=float), np.hstack([(s.my - beta @ s.mx)[:, None], beta])


# ------------------------------------------------------- subset search ---

def _sweep(a: np.ndarray, k: int) -> np.ndarray:
    """Goodnight's sweep on pivot k; sweeping the same pivot again takes it back."""
    d = a[k, k]
    row, col = a[k] / d, a[:, k].copy()
    out = a - np.outer(col, row)
    out[k], out[:, k], out[k, k] = row, -col / d, 1.0 / d
    return out


ALIAS_TOL = 1e-9  # a candidate with less than this share of its variance left is an alias of the chosen ones


def stepwise(g: Gram, x: list[str], y: str, method: str = "forward", nvmax: int | None = None):
    """Best subset of each size by forward, backward or sequential replacement.

    Returns ``[(size, [names], rss)]``.  One swept Gram holds the current model:
    the RSS of every one-column change is read off its last column, so a step costs one
    sweep and no solve.  Columns that are linear combinations of the chosen ones are
    never added, so the sizes end at the rank of the candidates.
    """
    g0 = g.total()
    cand, yi = [g.index(c) for c in x], g.index(y)
    nvmax = nvmax or len(x)
    name = {g.index(c): c for c in x}
    base = _sweep(g0, 0)
    var = {j: base[j, j] for j in cand}

    def free(a, cur):
        return [j for j in cand if j not in cur and var[j] > 0 and a[j, j] > ALIAS_TOL * var[j]]

    def gains(a, js):
        return [a[j, yi] ** 2 / a[j, j] for j in js]

    out, a, cur = [], base, []
    if method in ("forward", "seqrep"):
        while len(cur) < nvmax:
            js = free(a, cur)
            if not js:
                break
            v = gains(a, js)
            j = js[max(range(len(js)), key=lambda k: (v[k], -js[k]))]
            cur, a = cur + [j], _sweep(a, j)
            if method == "seqrep":
                improved = True
                while improved:
                    improved = False
                    for pos in range(len(cur)):
                        without = _sweep(a, cur[pos])
                        js = free(without, cur[:pos] + cur[pos + 1:])
                        v = gains(without, js)
                        k = max(range(len(js)), key=lambda q: (v[q], -js[q]))
                        r = without[yi, yi] - v[k]
                        if js[k] != cur[pos] and r < a[yi, yi] - 1e-9 * max(abs(a[yi, yi]), 1.0):
                            cur, a, improved = cur[:pos] + [js[k]] + cur[pos + 1:], _sweep(without, js[k]), True
            out.append((len(cur), [name[j] for j in cur], float(a[yi, yi])))
    elif method == "backward":
        for j in cand:  # the full model of full rank: later aliases of earlier columns stay out
            if j in free(a, cur):
                cur, a = cur + [j], _sweep(a, j)
        path = [(len(cur), list(cur), float(a[yi, yi]))]
        while len(cur) > 1:
            j = min(cur, key=lambda k: (a[k, yi] ** 2 / a[k, k], k))
            cur, a = [k for k in cur if k != j], _sweep(a, j)
            path.append((len(cur), list(cur), float(a[yi, yi])))
        out = [(s, [name[j] for j in c], r) for s, c, r in sorted(path) if s <= nvmax]
    else:
        raise ValueError(method)
    return out


def subset_criteria(spark: SparkSession, models, n: float, tss: float, x: list[str]) -> DataFrame:
    """BIC and adjusted R2 per subset size, the best size by each, and one 0/1 column ``in_<name>`` per candidate."""
    rows = []
    for size, names, rss in models:
        bic = n * math.log(rss / n) + (size + 1) * math.log(n)
        adj = 1.0 - (rss / (n - size - 1)) / (tss / (n - 1))
        rows.append((size, ",".join(names), float(rss), float(bic), float(adj), [int(c in names) for c in x]))
    top_bic = min(rows, key=lambda r: (r[3], r[0]))[0] if rows else None
    top_adj = max(rows, key=lambda r: (r[4], -r[0]))[0] if rows else None
    flat = [(*r[:5], r[0] == top_bic, r[0] == top_adj, *r[5]) for r in rows]
    return spark.createDataFrame(flat, "size int, variables string, rss double, bic double, adj_r2 double, best_bic boolean, "
                                       "best_adj_r2 boolean" + "".join(f", `in_{c}` int" for c in x))
