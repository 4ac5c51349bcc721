"""Registered queries: linear models on the GRAM kernel (L, G5, G12, G13, G19, M5, K3)."""

from __future__ import annotations

import math
import pickle
import time

import numpy as np
from pyspark.sql import functions as F

from ..operators import linear as lin
from ..operators import neural as nn
from ..operators import resampling as rs
from ..operators import tables as tb
from ..operators.gram import gram
from . import fixtures as fx
from .fixture_sql import HH, HH_RAW, with_ctes
from .flagship import features, model_frame
from .registry import r4, r4s, register

Y = fx.HH_Y
X2 = ["members", "rooms"]

# ---- two-predictor OLS by Cramer's rule in SQL -------------------------
_S2 = with_ctes(HH_RAW, HH) + (
    ", s AS (SELECT var_pop(members) AS v11, var_pop(rooms) AS v22, covar_pop(members, rooms) AS c12, "
    f"covar_pop(members, {Y}) AS c1y, covar_pop(rooms, {Y}) AS c2y, avg(members) AS m1, avg(rooms) AS m2, "
    f"avg({Y}) AS my, var_pop({Y}) AS vy, CAST(count(*) AS DOUBLE) AS n FROM hh), "
    "b AS (SELECT *, v11 * v22 - c12 * c12 AS det, (c1y * v22 - c2y * c12) / (v11 * v22 - c12 * c12) AS b1, "
    "(c2y * v11 - c1y * c12) / (v11 * v22 - c12 * c12) AS b2 FROM s), "
    "f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (vy - b1 * c1y - b2 * c2y) AS rss FROM b), "
    "g AS (SELECT *, rss / (n - 3) AS s2 FROM f), "
    "t AS (SELECT '(Intercept)' AS term, b0 AS est, sqrt(s2 * (1 / n + (v22 * m1 * m1 - 2 * c12 * m1 * m2 "
    "+ v11 * m2 * m2) / (n * det))) AS se, s2, rss, n, vy FROM g UNION ALL "
    "SELECT 'members', b1, sqrt(s2 * v22 / (n * det)), s2, rss, n, vy FROM g UNION ALL "
    "SELECT 'rooms', b2, sqrt(s2 * v11 / (n * det)), s2, rss, n, vy FROM g) ")


@register("l1_ols", _S2 + f"SELECT term, {r4s('est')} AS estimate FROM t")
def l1_ols(spark, sf_dir):
    return r4(lin.ols(fx.hh(spark, sf_dir), Y, X2).coefficients(spark))


@register("l2_ols_summary", _S2 + f"SELECT term, {r4s('est')} AS estimate, {r4s('se')} AS std_error, "
          f"{r4s('est / se')} AS t_value, {r4s('sqrt(s2)')} AS sigma, {r4s('1 - rss / (n * vy)')} AS r2, "
          f"{r4s('1 - (rss / (n - 3)) / (n * vy / (n - 1))')} AS adj_r2 FROM t")
def l2_ols_summary(spark, sf_dir):
    m = lin.ols(fx.hh(spark, sf_dir), Y, X2)
    s = m.summary(spark).drop("p_value")
    f = m.fit
    return r4(s.withColumns({"sigma": F.lit(f.sigma), "r2": F.lit(f.r2), "adj_r2": F.lit(f.adj_r2)}))


@register("l2_ols_glance")
def l2_ols_glance(spark, sf_dir):
    """Full OLS on the dummy model frame (collinear dummies aliased): n, rank, sigma, R2, adj R2, F and p."""
    d = model_frame(spark, sf_dir).filter("in_train")
    return lin.ols(d, Y, features(d)).glance(spark)


@register("l2_ols_terms")
def l2_ols_terms(spark, sf_dir):
    """Per-term estimate, se, t and p of the full model; aliased dummies are NULL."""
    d = model_frame(spark, sf_dir).filter("in_train")
    return lin.ols(d, Y, features(d)).summary(spark)


@register("l16_importance_t", _S2 + f"SELECT term, {r4s('abs(est / se)')} AS importance FROM t "
          "WHERE term <> '(Intercept)'")
def l16_importance_t(spark, sf_dir):
    return r4(lin.importance_t(lin.ols(fx.hh(spark, sf_dir), Y, X2), spark))


# ---- one-predictor penalised paths in closed form ----------------------
PEN_LAMBDAS = [0.0, 0.01, 0.05, 0.1, 0.2, 0.5]
_S1 = with_ctes(HH_RAW, HH) + (
    f", s AS (SELECT covar_pop(members, {Y}) AS c, var_pop(members) AS v, stddev_pop(members) AS sx, "
    f"avg(members) AS mx, avg({Y}) AS my FROM hh), lam AS (SELECT CAST(l AS DOUBLE) AS lam FROM (VALUES "
    + ", ".join(f"({v!r})" for v in PEN_LAMBDAS) + ") t(l)) ")


def _path_frame(path, spark):
    rows = [(float(lam), float(c[0]), float(c[1])) for lam, c in zip(path.lambdas, path.coefs)]
    return r4(spark.createDataFrame(rows, "lambda double, intercept double, slope double"))


@register("l4_ridge", _S1 + ", b AS (SELECT lam, c / (v * (1 + lam)) AS slope, mx, my FROM s, lam) "
          f'SELECT {r4s("lam")} AS "lambda", {r4s("my - slope * mx")} AS intercept, {r4s("slope")} AS slope FROM b')
def l4_ridge(spark, sf_dir):
    return _path_frame(lin.ridge(fx.hh(spark, sf_dir), Y, ["members"], PEN_LAMBDAS), spark)


_SOFT = "sign(c / sx) * greatest(abs(c / sx) - lam, 0) / sx"


@register("l5_lasso", _S1 + f", b AS (SELECT lam, {_SOFT} AS slope, mx, my FROM s, lam) "
          f'SELECT {r4s("lam")} AS "lambda", {r4s("my - slope * mx")} AS intercept, {r4s("slope")} AS slope FROM b')
def l5_lasso(spark, sf_dir):
    return _path_frame(lin.lasso(fx.hh(spark, sf_dir), Y, ["members"], PEN_LAMBDAS), spark)


@register("l8_coef_at", _S1 + f", b AS (SELECT lam, {_SOFT} AS slope, mx, my FROM s, lam) "
          "SELECT term, " + r4s("0.5 * v1 + 0.5 * v2") + " AS value FROM ("
          "SELECT 'members' AS term, (SELECT slope FROM b WHERE lam = 0.2) AS v1, "
          "(SELECT slope FROM b WHERE lam = 0.1) AS v2 UNION ALL "
          "SELECT '(Intercept)', (SELECT my - slope * mx FROM b WHERE lam = 0.2), "
          "(SELECT my - slope * mx FROM b WHERE lam = 0.1)) t")
def l8_coef_at(spark, sf_dir):
    """Lasso coefficients at lambda = 0.15, interpolated between grid points 0.1 and 0.2."""
    path = lin.lasso(fx.hh(spark, sf_dir), Y, ["members"], PEN_LAMBDAS).path(spark)
    return r4(lin.coef_at(path, 0.15))


# ---- multi-predictor penalised fits on the dummy frame (rows checks) ---

def _train(spark, sf_dir):
    d = model_frame(spark, sf_dir)
    return d.filter("in_train"), d.filter(~F.col("in_train")), features(d)


@register("l6_elastic_net")
def l6_elastic_net(spark, sf_dir):
    """Elastic net tuned over alpha x lambda by 10-fold CV from one per-fold Gram per alpha."""
    tr, _, x = _train(spark, sf_dir)
    d = rs.kfold(tr, 10, "hhid", seed=3)
    rows = []
    for a in [0.0, 0.25, 0.5, 0.75, 1.0]:
        cv = lin.cv_path(d, Y, x, a, "fold", nlambda=30)
        i = int(np.argmin(cv.cvm))
        rows.append((a, float(cv.lambdas[i]), float(cv.cvm[i]), float(cv.cvsd[i])))
    return spark.createDataFrame(rows, "alpha double, lambda double, cv_mse double, cv_se double")


@register("l7_coef_path")
def l7_coef_path(spark, sf_dir):
    """Lasso coefficient path of the dummy model: long (term, step, lambda, value)."""
    tr, _, x = _train(spark, sf_dir)
    return lin.lasso(tr, Y, x).path(spark)


@register("l9_cv_lambda")
def l9_cv_lambda(spark, sf_dir):
    """10-fold CV of the whole lasso path from ONE scan; lambda.min and lambda.1se flagged."""
    tr, _, x = _train(spark, sf_dir)
    cv = lin.cv_path(rs.kfold(tr, 10, "hhid", seed=3), Y, x, 1.0, "fold")
    rows = [(int(i), float(l), float(m), float(s), bool(l == cv.lambda_min), bool(l == cv.lambda_1se))
            for i, (l, m, s) in enumerate(zip(cv.lambdas, cv.cvm, cv.cvsd))]
    return spark.createDataFrame(rows, "step int, lambda double, cvm double, cvsd double, is_min boolean, "
                                       "is_1se boolean")


@register("l10_lasso_fraction")
def l10_lasso_fraction(spark, sf_dir):
    """Lasso indexed by share of the full L1 norm on a 100-point fraction grid."""
    tr, _, x = _train(spark, sf_dir)
    fr, coefs = lin.lasso_fraction(tr, Y, x, np.linspace(0, 1, 100))
    terms = [lin.INTERCEPT] + x
    rows = [(float(f), terms[j], float(coefs[i, j])) for i, f in enumerate(fr) for j in range(len(terms))]
    return spark.createDataFrame(rows, "fraction double, term string, value double")


_PRED9 = [*fx.HH_NUMERIC, *fx.HH_NOMINAL]


@register("l11_stepwise_forward", with_ctes(HH_RAW, HH) + "SELECT CAST(1 AS INT) AS size, variable, "
          + r4s("rss") + " AS rss FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS variable, count(*) * var_pop({Y}) * (1 - power(corr({c}, {Y}), 2)) AS rss FROM hh"
              for c in _PRED9) + ") t ORDER BY rss, variable LIMIT 1")
def l11_stepwise_forward(spark, sf_dir):
    """First forward step: the single predictor with the smallest RSS (all candidates from one Gram)."""
    g = gram(fx.hh(spark, sf_dir), _PRED9 + [Y])
    size, names, rss = lin.stepwise(g, _PRED9, Y, "forward", nvmax=1)[0]
    return r4(spark.createDataFrame([(size, names[0], float(rss))], "size int, variable string, rss double"))


def _subset_rows(spark, sf_dir, method):
    tr, _, x = _train(spark, sf_dir)
    g = gram(tr, x + [Y])
    res = lin.stepwise(g, x, Y, method)
    rows = [(s, ",".join(names), float(r)) for s, names, r in res]
    return spark.createDataFrame(rows, "size int, variables string, rss double"), g, res, x


@register("l11_stepwise_forward_path")
def l11_stepwise_forward_path(spark, sf_dir):
    """Best model of each size by forward selection on the dummy frame."""
    return _subset_rows(spark, sf_dir, "forward")[0]


@register("l12_stepwise_backward")
def l12_stepwise_backward(spark, sf_dir):
    return _subset_rows(spark, sf_dir, "backward")[0]


@register("l13_stepwise_seqrep")
def l13_stepwise_seqrep(spark, sf_dir):
    return _subset_rows(spark, sf_dir, "seqrep")[0]


@register("l14_subset_criteria")
def l14_subset_criteria(spark, sf_dir):
    """BIC, adjusted R2 and members per size of the forward path; best sizes flagged."""
    _, g, res, x = _subset_rows(spark, sf_dir, "forward")
    G = g.total()
    n = G[0, 0]
    yi = g.index(Y)
    tss = G[yi, yi] - G[0, yi] ** 2 / n
    return lin.subset_criteria(spark, res, n, tss, x)


@register("l15_subset_predict")
def l15_subset_predict(spark, sf_dir):
    """Refit the best-BIC forward subset and score it on the held-out rows."""
    tr, te, x = _train(spark, sf_dir)
    _, g, res, _ = _subset_rows(spark, sf_dir, "forward")
    G = g.total()
    n = G[0, 0]
    best = min(res, key=lambda r: n * math.log(r[2] / n) + (r[0] + 1) * math.log(n))
    m = lin.ols(tr, Y, best[1])
    p = m.transform(te)
    return p.agg(F.lit(best[0]).alias("size"), tb.rmse(p, "prediction", Y).alias("test_rmse"))


@register("m5_importance_filter", with_ctes(HH_RAW, HH) + "SELECT variable, " + r4s("abs(t)") + " AS importance FROM ("
          + " UNION ALL ".join(
              f"SELECT '{c}' AS variable, regr_slope({Y}, {c}) / sqrt((count(*) * var_pop({Y}) * (1 - regr_r2({Y}, {c})))"
              f" / (count(*) - 2) / (count(*) * var_pop({c}))) AS t FROM hh" for c in _PRED9) + ") s")
def m5_importance_filter(spark, sf_dir):
    """Model-free strength: |t| of the slope of y on each predictor alone, all from one Gram."""
    g = gram(fx.hh(spark, sf_dir), _PRED9 + [Y])
    G = g.total()
    rows = []
    for c in _PRED9:
        f = lin.ols_from_gram(G, g.shift, g.cols, [c], Y)
        rows.append((c, float(abs(f.t()[1]))))
    return r4(spark.createDataFrame(rows, "variable string, importance double"))


@register("g5_drop_correlated")
def g5_drop_correlated(spark, sf_dir):
    """Columns removed by the 0.75 correlation filter on the dummy model frame."""
    tr, _, x = _train(spark, sf_dir)
    drop = tb.drop_correlated(tb.corr_matrix(tr, x))
    return spark.createDataFrame([(c,) for c in drop], "variable string")


@register("g19_nonzero")
def g19_nonzero(spark, sf_dir):
    """Lasso coefficients that survive at the CV-chosen lambda.1se."""
    tr, _, x = _train(spark, sf_dir)
    cv = lin.cv_path(rs.kfold(tr, 10, "hhid", seed=3), Y, x, 1.0, "fold")
    p = lin.lasso(tr, Y, x, [cv.lambda_1se])
    return tb.nonzero(p.path(spark))


def linear_comparison_rows(spark, sf_dir):
    tr, te, x = _train(spark, sf_dir)
    trf = rs.kfold(tr, 10, "hhid", seed=3)
    out = []
    t0 = time.time()
    ols = lin.ols(tr, Y, x)
    sec = time.time() - t0
    cv0 = lin.cv_path(trf, Y, x, 0.0, "fold", lambdas=[0.0])
    def add(name, cv, i, m, seconds):
        fold = cv.fold_rmse[:, i]
        out.append(tb.compare_rmse(spark, name, float(fold.mean()), float(fold.std(ddof=1)), m.transform(tr), m.transform(te),
                                   Y, seconds=seconds, size_mb=len(pickle.dumps(m)) / 1e6))

    add("ols", cv0, 0, ols, sec)
    for name, a in (("ridge", 0.0), ("lasso", 1.0), ("elastic_net", 0.5)):
        t0 = time.time()
        cv = lin.cv_path(trf, Y, x, a, "fold", nlambda=30)
        m = lin.PenalizedPath(tr, Y, x, a, [cv.lambda_min]).model(0)
        sec = time.time() - t0
        i = int(np.argmin(cv.cvm))
        add(name, cv, i, m, sec)
    return out


@register("g12_compare_rmse")
def g12_compare_rmse(spark, sf_dir):
    """CV, training and test RMSE of the OLS model in one row."""
    return linear_comparison_rows(spark, sf_dir)[0]


@register("g13_compare_models")
def g13_compare_models(spark, sf_dir):
    """OLS, ridge, lasso and elastic net side by side (CV / train / test RMSE, fit seconds)."""
    return tb.compare_models(linear_comparison_rows(spark, sf_dir))


@register("k3_random_feature_regression")
def k3_random_feature_regression(spark, sf_dir):
    """Fixed random tanh hidden layer (36 units) + least-squares output from one Gram; test RMSE."""
    tr, te, x = _train(spark, sf_dir)
    m = nn.random_feature_regression(tr, Y, x, n_hidden=36, seed=1)
    p = m.transform(te)
    return p.agg(tb.rmse(p, "prediction", Y).alias("test_rmse"), F.count("*").alias("n"))


def ols_repeated_cv(spark, sf_dir, k: int = 10, repeats: int = 10):
    """Per (repeat, fold) held-out RMSE of the dummy-frame OLS from ONE grouped Gram pass."""
    tr, _, x = _train(spark, sf_dir)
    d = rs.repeated_kfold(tr, k, repeats, "hhid", seed=4)
    g = gram(d, x + [Y], by=["rep", "fold"])
    per_rep: dict = {}
    for (rep, fold), gf in g.mats.items():
        per_rep.setdefault(rep, []).append((fold, gf))
    rows = []
    for rep, items in per_rep.items():
        total = sum(gf for _, gf in items)
        for fold, gf in items:
            fit = lin.ols_from_gram(total - gf, g.shift, g.cols, x, Y)
            coefs = np.nan_to_num(fit.coef)[None, :]
            mse = lin.fold_rss(gf, coefs, g.shift, g.cols, x, Y)[0] / gf[0, 0]
            rows.append((int(rep), int(fold), float(math.sqrt(mse))))
    return spark.createDataFrame(rows, "rep int, fold int, rmse double")


@register("g12_ols_repeated_cv")
def g12_ols_repeated_cv(spark, sf_dir):
    """OLS CV RMSE and its sd over 10-fold x 10-repeat resampling (one pass), plus training RMSE."""
    res = ols_repeated_cv(spark, sf_dir)
    return tb.cv_summary(res.withColumn("model", F.lit("ols")), ["model"], "rmse")
