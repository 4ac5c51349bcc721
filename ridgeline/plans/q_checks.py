"""Queries of learners in settings that SQL can follow exactly.

A one-split tree, one boosting round, a one-predictor penalty path or a
cross-validated straight line runs through the same code as the tuned models; its
rows have a closed form, so DuckDB checks them value by value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform_sql
from ..operators import cart as ca
from ..operators import ensembles as en
from ..operators import hist as hs
from ..operators.forest import fit_forest
from ..operators import linear as lin
from ..operators import resampling as rs
from ..operators import tables as tb
from ..operators import trees as tr
from ..operators import tuning as tu
from . import fixtures as fx
from .fixture_sql import HH, HH_RAW, with_ctes
from .q_linear import PEN_LAMBDAS
from .q_trees import TREE_X, _T1
from .registry import r4, r4s, register

Y = fx.HH_Y
_ORDER = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(TREE_X)) + " END"
_ROOT = _T1 + (
    f", tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg({Y}) AS my, count(*) * var_pop({Y}) AS dev FROM hh), "
    f"one AS (SELECT sp.*, tot.*, s.sl FROM sp JOIN (SELECT feature, value, nl, sl FROM d) s ON s.feature = sp.feature AND s.value = sp.cut_value, tot "
    f"WHERE n_left >= 7 AND n_right >= 7 ORDER BY gain DESC, {_ORDER.replace('feature', 'sp.feature')}, cut_value LIMIT 1), "
    "side AS (SELECT one.feature, one.cut_value, one.gain, one.my, one.dev, one.n, n_left, n_right, sl / n_left AS ml, "
    "(one.n * one.my - sl) / n_right AS mr, "
    "(SELECT count(*) * var_pop(y) FROM st WHERE st.feature = one.feature AND st.value <= one.cut_value) AS dl, "
    "(SELECT count(*) * var_pop(y) FROM st WHERE st.feature = one.feature AND st.value > one.cut_value) AS dr FROM one) ")


def _stump(spark, sf_dir):
    hh = fx.hh(spark, sf_dir)
    return hh, ca.grow_cart(hh, Y, TREE_X, cp=1e-4, maxdepth=1)


@register("t9_root_split_nodes", _ROOT + "SELECT CAST(0 AS INT) AS node, CAST(0 AS INT) AS depth, feature AS split_feature, "
          f"{r4s('cut_value')} AS split_cut, {r4s('n')} AS n, {r4s('dev', 2)} AS deviance, {r4s('my')} AS value, false AS is_leaf FROM side "
          f"UNION ALL SELECT 1, 1, NULL, NULL, {r4s('n_left')}, {r4s('dl', 2)}, {r4s('ml')}, true FROM side "
          f"UNION ALL SELECT 2, 1, NULL, NULL, {r4s('n_right')}, {r4s('dr', 2)}, {r4s('mr')}, true FROM side")
def t9_root_split_nodes(spark, sf_dir):
    """Node table of the tree with one split, grown by the complexity rule."""
    _, t = _stump(spark, sf_dir)
    d = tr.tree_nodes(t, spark).drop("rule").withColumn("deviance", F.round("deviance", 2))
    return r4(d)


@register("t10_root_split_importance", _ROOT + f"SELECT feature, {r4s('gain', 2)} AS importance FROM side")
def t10_root_split_importance(spark, sf_dir):
    return r4(tr.importance_gain(_stump(spark, sf_dir)[1], spark), 2)


@register("t4_root_split_cp_table", _ROOT + f"SELECT {r4s('gain / dev', 6)} AS cp, CAST(0 AS INT) AS nsplit, {r4s('1')} AS rel_error FROM side "
          f"UNION ALL SELECT {r4s('0')}, 1, {r4s('1 - gain / dev', 6)} FROM side")
def t4_root_split_cp_table(spark, sf_dir):
    """Weakest-link table (T3, T4) of the tree with one split."""
    rows = [(float(c), int(s), float(e)) for c, s, e in tr.cp_table(_stump(spark, sf_dir)[1])]
    return r4(spark.createDataFrame(rows, "cp double, nsplit int, rel_error double"), 6)


@register("g2_root_split_predictions", _ROOT + f"SELECT {r4s('ml')} AS prediction, CAST(n_left AS BIGINT) AS n FROM side "
          f"UNION ALL SELECT {r4s('mr')}, CAST(n_right AS BIGINT) FROM side")
def g2_root_split_predictions(spark, sf_dir):
    hh, t = _stump(spark, sf_dir)
    return r4(tb.prediction_table(t.transform(hh)))


def _grown_sql(depth):
    """CTEs ``lab0`` to ``lab<depth>``: rows with the node of the tree that splits each node at its best cut."""
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in TREE_X)
    out = with_ctes(HH_RAW, HH) + f", lab0 AS (SELECT hhid, {Y} - (SELECT avg({Y}) FROM hh) AS y, {cols}, 1 AS node FROM hh)"
    for k in range(depth):
        stack = " UNION ALL ".join(f"SELECT node, '{c}' AS feature, {c} AS value, y FROM lab{k}" for c in TREE_X)
        w = "PARTITION BY node, feature"
        run = f"OVER ({w} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        side = " ".join(f"WHEN '{c}' THEN l.{c} > b.value" for c in TREE_X)
        out += (
            f", st{k} AS ({stack}), vs{k} AS (SELECT node, feature, value, count(*) AS n, sum(y) AS s FROM st{k} GROUP BY ALL), "
            f"run{k} AS (SELECT node, feature, value, sum(n) {run} AS nl, sum(s) {run} AS sl, sum(n) OVER ({w}) AS nt, "
            f"sum(s) OVER ({w}) AS st FROM vs{k}), "
            f"best{k} AS (SELECT node, feature, value FROM run{k} WHERE nl < nt QUALIFY row_number() OVER (PARTITION BY node ORDER BY "
            f"sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt DESC, {_ORDER}, value) = 1), "
            f"lab{k + 1} AS (SELECT l.* REPLACE (2 * l.node + CAST(CASE b.feature {side} END AS INT) AS node) FROM lab{k} l JOIN best{k} b USING (node)), "
            f"leaf{k + 1} AS (SELECT node, count(*) AS n, avg(y) + (SELECT avg({Y}) FROM hh) AS value FROM lab{k + 1} GROUP BY node)")
    return out


def _plain_forest(spark, sf_dir, trees, depth, **how):
    """Forest without resampling that tries every feature at every node."""
    hh = fx.hh(spark, sf_dir)
    return hh, fit_forest(hh, Y, TREE_X, "hhid", trees=trees, max_depth=depth, max_bins=256, bootstrap=False, min_node=1, **how)


@register("b1_one_tree_leaves", _grown_sql(3) + f" SELECT CAST(n AS BIGINT) AS n, {r4s('value')} AS value FROM leaf3")
def b1_one_tree_leaves(spark, sf_dir):
    """Leaves of one unweighted tree of three levels with every feature: two upper levels, the last one in tasks."""
    hh = fx.hh(spark, sf_dir)
    _, m = _plain_forest(spark, sf_dir, 1, 3, local_rows=max(1, hh.count() // 3))
    return r4(m.leaves().select("n", "value"))


@register("b2_forest_predictions", _grown_sql(2) + f" SELECT {r4s('value')} AS prediction, CAST(n AS BIGINT) AS n FROM leaf2")
def b2_forest_predictions(spark, sf_dir):
    """Predictions of a forest of three equal trees (no resampling, every feature tried), counted."""
    hh, m = _plain_forest(spark, sf_dir, 3, 2)
    return r4(m.transform(hh).select(F.round("prediction", 6).alias("prediction"))).groupBy("prediction").agg(F.count("*").alias("n"))


def _round_sql(lam, least):
    gain = f"0.5 * (c * c / (n_left + {lam}) + c * c / (n_right + {lam}))"
    return _T1 + (
        f", my AS (SELECT avg({Y}) AS my FROM hh), "
        f"s AS (SELECT sp.feature, sp.cut_value, sp.n_left, sp.n_right, d.sl - d.nl * my.my AS c FROM sp "
        f"JOIN d ON d.feature = sp.feature AND d.value = sp.cut_value, my WHERE n_left >= {least} AND n_right >= {least}), "
        f"one AS (SELECT *, {gain} AS gain FROM s ORDER BY gain DESC, {_ORDER}, cut_value LIMIT 1) "
        f"SELECT feature, {r4s('cut_value')} AS cut, {r4s('gain', 2)} AS gain, {r4s(f'c / (n_left + {lam})')} AS left_value, "
        f"{r4s(f'-c / (n_right + {lam})')} AS right_value FROM one")


def _rounds_sql(rounds, eta, lam, least):
    """Stumps of several boosting rounds, each on what the rounds before left over."""
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in TREE_X)
    out = with_ctes(HH_RAW, HH) + f", r0 AS (SELECT {Y} - (SELECT avg({Y}) FROM hh) AS r, {cols} FROM hh)"
    for k in range(1, rounds + 1):
        stack = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, r FROM r{k - 1}" for c in TREE_X)
        run = "OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        all_ = "OVER (PARTITION BY feature)"
        side = " ".join(f"WHEN '{c}' THEN {c} <= b.value" for c in TREE_X)
        out += (
            f", s{k} AS ({stack}), v{k} AS (SELECT feature, value, count(*) AS n, sum(r) AS s FROM s{k} GROUP BY ALL), "
            f"c{k} AS (SELECT feature, value, sum(n) {run} AS nl, sum(s) {run} AS sl, sum(n) {all_} AS nt, sum(s) {all_} AS st FROM v{k}), "
            f"b{k} AS (SELECT feature, value, sl / (nl + {lam}) AS lv, (st - sl) / (nt - nl + {lam}) AS rv FROM c{k} "
            f"WHERE nl >= {least} AND nt - nl >= {least} ORDER BY sl * sl / (nl + {lam}) + (st - sl) * (st - sl) / (nt - nl + {lam}) "
            f"- st * st / (nt + {lam}) DESC, {_ORDER}, value LIMIT 1), "
            f"r{k} AS (SELECT x.* REPLACE (r - {eta} * CASE WHEN (CASE b.feature {side} END) THEN b.lv ELSE b.rv END AS r) FROM r{k - 1} x, b{k} b)")
    return out + " " + " UNION ALL ".join(
        f"SELECT CAST({k} AS INT) AS round, feature, {r4s('value')} AS cut, {r4s('lv')} AS left_value, {r4s('rv')} AS right_value FROM b{k}"
        for k in range(1, rounds + 1))


def _stumps(spark, model):
    rows = [(k + 1, t.nodes[1].feature, float(t.nodes[1].cut), float(t.nodes[2].value), float(t.nodes[3].value)) for k, t in enumerate(model.trees)]
    return r4(spark.createDataFrame(rows, "round int, feature string, cut double, left_value double, right_value double"))


@register("b5_gbm_rounds_of_stumps", _rounds_sql(4, 0.1, 0, 10))
def b5_gbm_rounds_of_stumps(spark, sf_dir):
    """Four boosting rounds of one split each."""
    return _stumps(spark, en.gbm(fx.hh(spark, sf_dir), Y, TREE_X, "hhid", trees=4, depth=1, shrinkage=0.1, min_obs=10, max_bins=255)[0])


@register("b7_xgb_rounds_of_stumps", _rounds_sql(4, 0.3, 1, 1))
def b7_xgb_rounds_of_stumps(spark, sf_dir):
    """Four regularised second-order rounds of one split each."""
    m, _, _ = hs.xgb(fx.hh(spark, sf_dir), Y, TREE_X, "hhid", rounds=4, max_depth=1, eta=0.3, lam=1.0, max_bins=255)
    return _stumps(spark, m)


@register("b11_tree_boost_rounds_of_stumps", _rounds_sql(3, 0.1, 0, 7))
def b11_tree_boost_rounds_of_stumps(spark, sf_dir):
    """Three rounds of regression-tree boosting with one level."""
    return _stumps(spark, en.tree_boost(fx.hh(spark, sf_dir), Y, TREE_X, "hhid", rounds=3, maxdepth=1, max_bins=255))


_STAGES = _rounds_sql(4, 0.1, 0, 10).rsplit(" SELECT CAST(1 AS INT) AS round", 1)[0]


@register("b6_gbm_rounds_of_stumps", _STAGES + " " + " UNION ALL ".join(
    f"SELECT CAST({k} AS INT) AS trees, {r4s('sqrt(avg(r * r))')} AS rmse FROM r{k}" for k in range(1, 5)))
def b6_gbm_rounds_of_stumps(spark, sf_dir):
    """RMSE after each of four boosting rounds of one split, from one pass."""
    hh = fx.hh(spark, sf_dir)
    m, _ = en.gbm(hh, Y, TREE_X, "hhid", trees=4, depth=1, shrinkage=0.1, min_obs=10, max_bins=255)
    return r4(en.gbm_rounds(m, hh, Y))


_L10 = with_ctes(HH_RAW, HH) + (
    f", m AS (SELECT avg(members) AS m1, avg(rooms) AS m2, avg({Y}) AS my, stddev_pop(members) AS s1, stddev_pop(rooms) AS s2, "
    f"covar_pop(members, {Y}) / stddev_pop(members) AS c1, covar_pop(rooms, {Y}) / stddev_pop(rooms) AS c2, corr(members, rooms) AS q FROM hh), "
    "o AS (SELECT *, abs(c1) >= abs(c2) AS one, (c1 - q * c2) / (1 - q * q) AS e1, (c2 - q * c1) / (1 - q * q) AS e2 FROM m), "
    "k AS (SELECT *, CASE WHEN one THEN c1 ELSE c2 END AS ca, CASE WHEN one THEN c2 ELSE c1 END AS cb, abs(e1) + abs(e2) AS whole FROM o), "
    "g AS (SELECT *, least((abs(ca) - cb) / (1 - q * sign(ca)), (abs(ca) + cb) / (1 + q * sign(ca))) AS first FROM k), "
    "f AS (SELECT *, t.v AS fraction, greatest(0, (t.v * whole - first) / (whole - first)) AS u FROM g, (VALUES (0), (0.125), (0.25), (0.5), (0.75), (1)) AS t(v)), "
    # the first predictor alone up to the knot, then along a line to least squares
    "b AS (SELECT *, least(t.fraction * whole, first) * sign(ca) AS ba FROM f AS t), "
    "z AS (SELECT *, CASE WHEN one THEN ba + u * (e1 - first * sign(ca)) ELSE u * e1 END / s1 AS b1, "
    "CASE WHEN one THEN u * e2 ELSE ba + u * (e2 - first * sign(ca)) END / s2 AS b2 FROM b) "
    f"SELECT CAST(fraction AS DOUBLE) AS fraction, {r4s('my - b1 * m1 - b2 * m2')} AS intercept, {r4s('b1')} AS members, {r4s('b2')} AS rooms FROM z")


@register("l10_lasso_fraction_two_predictors", _L10)
def l10_lasso_fraction_two_predictors(spark, sf_dir):
    """The exact lasso path of two predictors at six shares of its norm."""
    fr, c = lin.lasso_fraction(fx.hh(spark, sf_dir), Y, ["members", "rooms"], [0, 0.125, 0.25, 0.5, 0.75, 1])
    return r4(spark.createDataFrame([(float(f), *map(float, row)) for f, row in zip(fr, c)], "fraction double, intercept double, members double, rooms double"))


def _first_tree(spark, model):
    t = model.trees[0]
    r = t.nodes[1]
    return r4(r4(spark.createDataFrame([(r.feature, float(r.cut), float(r.gain), float(t.nodes[r.left].value), float(t.nodes[r.right].value))],
                                       "feature string, cut double, gain double, left_value double, right_value double")
              ).withColumn("gain", F.round("gain", 2)))


@register("b7_xgb_one_round", _round_sql(1.0, 1))
def b7_xgb_one_round(spark, sf_dir):
    """One round of second-order boosting at depth 1, lambda 1: the split and its leaf weights."""
    m, _, _ = hs.xgb(fx.hh(spark, sf_dir), Y, TREE_X, "hhid", rounds=1, max_depth=1, eta=0.3, lam=1.0)
    return _first_tree(spark, m)


@register("b8_leafwise_one_round", _round_sql(0.0, 20))
def b8_leafwise_one_round(spark, sf_dir):
    """One round of best-leaf-first boosting with two leaves of at least 20 rows."""
    m, _, _ = hs.leafwise_boost(fx.hh(spark, sf_dir), Y, TREE_X, "hhid", rounds=1, num_leaves=2, max_bin=64)
    return _first_tree(spark, m)


@register("b14_componentwise_one_round", _T1 + (
    f", my AS (SELECT avg({Y}) AS my FROM hh), "
    "t AS (SELECT feature, value, n, sy - n * my AS r, (sy - n * my) / (n + 1) AS v FROM vs, my), "
    f"best AS (SELECT feature FROM t GROUP BY feature ORDER BY sum(2 * v * r - v * v * n) DESC, {_ORDER} LIMIT 1) "
    "SELECT t.feature, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS bin, " + r4s("v") + " AS value FROM t JOIN best ON best.feature = t.feature"))
def b14_componentwise_one_round(spark, sf_dir):
    """The first term of componentwise boosting: shrunken mean per bin of the best feature."""
    m = hs.componentwise_boost(fx.hh(spark, sf_dir), Y, TREE_X, "hhid", mstop=1, max_bins=64)
    f, table = m.steps[0]
    return r4(spark.createDataFrame([(f, int(b), float(v)) for b, v in table.items()], "feature string, bin int, value double"))


# ---- one predictor: penalties, cross-validation, comparison ----

_S = with_ctes(HH_RAW, HH) + (
    f", s AS (SELECT covar_pop(members, {Y}) AS c, var_pop(members) AS v, stddev_pop(members) AS sx, avg(members) AS mx, avg({Y}) AS my FROM hh), "
    "lam AS (SELECT CAST(l AS DOUBLE) AS lam, CAST(i AS INT) AS step FROM (VALUES "
    + ", ".join(f"({v!r}, {i})" for i, v in enumerate(PEN_LAMBDAS)) + ") t(l, i)) ")
_NET = "sign(c / sx) * greatest(abs(c / sx) - 0.5 * lam, 0) / (1 + 0.5 * lam) / sx"
_LASSO = "sign(c / sx) * greatest(abs(c / sx) - lam, 0) / sx"


@register("l6_elastic_net_one_predictor", _S + f", b AS (SELECT lam, {_NET} AS slope, mx, my FROM s, lam) "
          f'SELECT {r4s("lam")} AS "lambda", {r4s("my - slope * mx")} AS intercept, {r4s("slope")} AS slope FROM b')
def l6_elastic_net_one_predictor(spark, sf_dir):
    p = lin.PenalizedPath(fx.hh(spark, sf_dir), Y, ["members"], 0.5, PEN_LAMBDAS)
    rows = [(float(lam), float(c[0]), float(c[1])) for lam, c in zip(p.lambdas, p.coefs)]
    return r4(spark.createDataFrame(rows, "lambda double, intercept double, slope double"))


_PATH = _S + (f", b AS (SELECT step, lam, {_LASSO} AS slope, mx, my FROM s, lam), "
              "p AS (SELECT 'members' AS term, step, lam, slope AS value FROM b UNION ALL "
              "SELECT '(Intercept)', step, lam, my - slope * mx FROM b) ")


@register("l7_coef_path_one_predictor", _PATH + f'SELECT term, step, {r4s("lam")} AS "lambda", {r4s("value")} AS value FROM p')
def l7_coef_path_one_predictor(spark, sf_dir):
    return r4(lin.lasso(fx.hh(spark, sf_dir), Y, ["members"], PEN_LAMBDAS).path(spark))


@register("g19_nonzero_one_predictor", _PATH + f'SELECT term, step, {r4s("lam")} AS "lambda", {r4s("value")} AS value FROM p WHERE value <> 0')
def g19_nonzero_one_predictor(spark, sf_dir):
    return r4(tb.nonzero(lin.lasso(fx.hh(spark, sf_dir), Y, ["members"], PEN_LAMBDAS).path(spark)))


_FOLD = f"CAST(floor({hash_uniform_sql(3, 'hhid')} * 10) AS INT)"


def _folds_sql(x="members"):
    """Sums of every fold (f) and of the rows outside it (t)."""
    sums = f"count(*) AS n, sum({x}) AS sx, sum({Y}) AS sy, sum({x} * {x}) AS sxx, sum({x} * {Y}) AS sxy, sum({Y} * {Y}) AS syy"
    return (f"k AS (SELECT {_FOLD} AS fold, CAST({x} AS DOUBLE) - (SELECT avg({x}) FROM hh) AS {x}, {Y} - (SELECT avg({Y}) FROM hh) AS {Y} FROM hh), "
            f"f AS (SELECT fold, {sums} FROM k GROUP BY fold), a AS (SELECT {sums} FROM k), "
            "t AS (SELECT f.*, a.n - f.n AS tn, (a.sx - f.sx) / (a.n - f.n) AS mx, (a.sy - f.sy) / (a.n - f.n) AS my, "
            "(a.sxx - f.sxx) / (a.n - f.n) - power((a.sx - f.sx) / (a.n - f.n), 2) AS v, "
            "(a.sxy - f.sxy) / (a.n - f.n) - (a.sx - f.sx) * (a.sy - f.sy) / power(a.n - f.n, 2) AS c FROM f, a) ")


_MSE = "(syy - 2 * (b0 * sy + b1 * sxy) + n * b0 * b0 + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n"


@register("l9_cv_ridge_one_predictor", _S + ", " + _folds_sql() + (
    ", b AS (SELECT t.*, step, lam, c / (v * (1 + lam)) AS b1, t.my - c / (v * (1 + lam)) * t.mx AS b0 FROM t, lam), "
    f"e AS (SELECT step, lam, {_MSE} AS mse FROM b) "
    f'SELECT step, {r4s("any_value(lam)")} AS "lambda", {r4s("avg(mse)")} AS cvm, {r4s("stddev_samp(mse) / sqrt(count(*))")} AS cvsd '
    "FROM e GROUP BY step"))
def l9_cv_ridge_one_predictor(spark, sf_dir):
    """10-fold CV error of a ridge path with one predictor, from per-fold Grams."""
    d = rs.kfold(fx.hh(spark, sf_dir), 10, "hhid", seed=3)
    cv = lin.cv_path(d, Y, ["members"], 0.0, "fold", lambdas=PEN_LAMBDAS)
    rows = [(i, float(a), float(m), float(s)) for i, (a, m, s) in enumerate(zip(cv.lambdas, cv.cvm, cv.cvsd))]
    return r4(spark.createDataFrame(rows, "step int, lambda double, cvm double, cvsd double"))


def _cv_line(x):
    return ("(SELECT '" + x + "' AS var, avg(sqrt(mse)) AS rmse, stddev_samp(sqrt(mse)) AS rmse_sd FROM (WITH " + _folds_sql(x)
            + f", b AS (SELECT t.*, c / v AS b1, my - c / v * mx AS b0 FROM t) SELECT {_MSE} AS mse FROM b) q)")


@register("m1_cv_tune_lines", with_ctes(HH_RAW, HH) + f"SELECT var, {r4s('rmse')} AS rmse, {r4s('rmse_sd')} AS rmse_sd FROM ("
          + " UNION ALL ".join("SELECT * FROM " + _cv_line(x) for x in ("members", "head_educ", "prov")) + ") u")
def m1_cv_tune_lines(spark, sf_dir):
    """Tuning by 10-fold CV over which single predictor a straight line uses."""
    d = rs.kfold(fx.hh(spark, sf_dir), 10, "hhid", seed=3)
    rows, _, _ = tu.cv_tune(d, Y, lambda t, var: lin.ols(t, Y, [var]), [{"var": v} for v in ("members", "head_educ", "prov")], refit=False)
    return r4(spark.createDataFrame([(r["var"], r["rmse"], r["rmse_sd"]) for r in rows], "var string, rmse double, rmse_sd double"))


@register("g12_compare_line", with_ctes(HH_RAW, HH) + (
    ", p AS (SELECT *, " + _FOLD + " AS fold FROM hh), "
    f"m AS (SELECT regr_slope({Y}, members) AS b1, regr_intercept({Y}, members) AS b0 FROM p WHERE fold > 0), "
    f"cv AS {_cv_line('members')} "
    f"SELECT 'line' AS model, {r4s('any_value(cv.rmse)')} AS cv_rmse, {r4s('any_value(cv.rmse_sd)')} AS cv_rmse_sd, "
    f"{r4s(f'sqrt(avg(power({Y} - b0 - b1 * members, 2)) FILTER (fold > 0))')} AS train_rmse, "
    f"{r4s(f'sqrt(avg(power({Y} - b0 - b1 * members, 2)) FILTER (fold = 0))')} AS test_rmse FROM p, m, cv"))
def g12_compare_line(spark, sf_dir):
    """One comparison row: a straight line fitted outside fold 0, with its 10-fold CV error."""
    d = rs.kfold(fx.hh(spark, sf_dir), 10, "hhid", seed=3)
    m = lin.ols(d.filter("fold > 0"), Y, ["members"])
    cv = lin.cv_path(d, Y, ["members"], 0.0, "fold", lambdas=[0.0]).fold_rmse[:, 0]
    row = tb.compare_rmse(spark, "line", float(cv.mean()), float(cv.std(ddof=1)), m.transform(d.filter("fold > 0")), m.transform(d.filter("fold = 0")), Y)
    return r4(row.drop("seconds", "size_mb"))


_CAND = [*fx.HH_NUMERIC, *fx.HH_NOMINAL]


@register("l14_subset_criteria_first", with_ctes(HH_RAW, HH) + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS v, {i} AS o, CAST(count(*) AS DOUBLE) AS n, count(*) * var_pop({Y}) AS tss, "
    f"count(*) * var_pop({Y}) * (1 - power(corr({c}, {Y}), 2)) AS rss FROM hh" for i, c in enumerate(_CAND)) + "), "
    "one AS (SELECT * FROM c ORDER BY rss, o LIMIT 1) SELECT CAST(1 AS INT) AS size, v AS variables, "
    f"{r4s('rss', 2)} AS rss, {r4s('n * ln(rss / n) + 2 * ln(n)', 2)} AS bic, {r4s('1 - (rss / (n - 2)) / (tss / (n - 1))')} AS adj_r2, "
    "true AS best_bic, true AS best_adj_r2, " + ", ".join(f"CAST(v = '{c}' AS INT) AS in_{c}" for c in _CAND) + " FROM one")
def l14_subset_criteria_first(spark, sf_dir):
    """Criteria and members of the best one-predictor subset."""
    from ..operators.gram import gram
    g = gram(fx.hh(spark, sf_dir), _CAND + [Y])
    t, yi = g.total(), g.index(Y)
    tss = t[yi, yi] - t[0, yi] ** 2 / t[0, 0]
    d = lin.subset_criteria(spark, lin.stepwise(g, _CAND, Y, "forward", nvmax=1), t[0, 0], tss, _CAND)
    return r4(d.withColumns({"rss": F.round("rss", 2), "bic": F.round("bic", 2)}))


@register("b9_early_stop_curve", with_ctes(HH_RAW, HH) + (
    f", c AS (SELECT CAST(row_number() OVER (ORDER BY head_age) AS INT) AS r, avg({Y}) AS v FROM hh GROUP BY head_age), "
    "p AS (SELECT r, (SELECT arg_min(q.r, struct_pack(v := q.v, r := q.r)) FROM c q WHERE q.r <= c.r) AS b FROM c), "
    "s AS (SELECT coalesce(min(r) FILTER (r - b >= 4), max(r)) AS stop FROM p) "
    "SELECT CAST((SELECT b FROM p WHERE r = stop) AS INT) AS best_round, CAST(stop AS INT) AS stop_round FROM s"))
def b9_early_stop_curve(spark, sf_dir):
    """The stopping rule (patience 4) on a curve read from the data: mean outcome by age of head."""
    curve = [r["v"] for r in fx.hh(spark, sf_dir).groupBy("head_age").agg(F.avg(Y).alias("v")).orderBy("head_age").collect()]
    best, stop = hs.early_stop([float(np.float64(v)) for v in curve], 4)
    return spark.createDataFrame([(best, stop)], "best_round int, stop_round int")
