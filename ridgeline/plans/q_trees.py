"""Registered queries: single trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..operators import cart as ca
from ..operators import resampling as rs
from ..operators import tables as tb
from ..operators import trees as tr
from ..session import snapshot
from . import fixtures as fx
from .fixture_sql import HH, HH_RAW, with_ctes
from .flagship import features, model_frame
from .registry import r4, r4s, register

Y = fx.HH_Y
TREE_X = [*fx.HH_NUMERIC, *fx.HH_NOMINAL]


def _stack_sql(cols, src="hh"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {Y} AS y FROM {src}"
                              for c in cols)


_T1 = with_ctes(HH_RAW, HH) + (
    f", st AS ({_stack_sql(TREE_X)}), "
    "vs AS (SELECT feature, value, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy FROM st GROUP BY feature, value), "
    "d AS (SELECT feature, value, "
    "sum(n) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nl, "
    "sum(sy) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sl, "
    "sum(n) OVER (PARTITION BY feature) AS nt, sum(sy) OVER (PARTITION BY feature) AS st, "
    "lead(value) OVER (PARTITION BY feature ORDER BY value) AS next_value FROM vs), "
    "sp AS (SELECT feature, value AS cut_value, (value + next_value) / 2 AS cut, nl AS n_left, nt - nl AS n_right, "
    "sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain FROM d WHERE next_value IS NOT NULL) ")


@register("t1_split_search", _T1 + f"SELECT feature, {r4s('cut_value')} AS cut_value, {r4s('cut')} AS cut, "
          f"{r4s('n_left')} AS n_left, {r4s('n_right')} AS n_right, {r4s('gain')} AS gain FROM sp")
def t1_split_search(spark, sf_dir):
    return r4(tr.split_search(fx.hh(spark, sf_dir), Y, TREE_X))


_T7 = _T1 + (", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, "
             "cut_value) AS r FROM sp) WHERE r = 1) ")


@register("t7_competitor_splits", _T7 + f"SELECT feature, {r4s('gain')} AS gain, {r4s('cut_value')} AS cut_value, "
          f"{r4s('cut')} AS cut, {r4s('n_left')} AS n_left, {r4s('n_right')} AS n_right, "
          "CAST(row_number() OVER (ORDER BY gain DESC, feature) AS INT) AS rank FROM best "
          "ORDER BY gain DESC, feature LIMIT 4")
def t7_competitor_splits(spark, sf_dir):
    return r4(tr.competitor_splits(fx.hh(spark, sf_dir), Y, TREE_X, k=4))


def _goes_left_sql():
    cases = " ".join(f"WHEN '{c}' THEN h.{c} <= p.cut_value" for c in TREE_X)
    return f"CASE p.feature {cases} END"


_T8 = _T7 + (
    ", p AS (SELECT feature, cut_value FROM best ORDER BY gain DESC, feature LIMIT 1), "
    f"lab AS (SELECT h.*, CAST({_goes_left_sql()} AS INT) AS gl FROM hh h, p), "
    "st2 AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, gl FROM lab"
                                    for c in TREE_X) + "), "
    "vs2 AS (SELECT feature, value, sum(gl) AS nl, count(*) AS n FROM st2 WHERE feature <> (SELECT feature FROM p) "
    "GROUP BY feature, value), "
    "d2 AS (SELECT feature, value, "
    "sum(nl) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cl, "
    "sum(n) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn, "
    "sum(nl) OVER (PARTITION BY feature) AS tl, sum(n) OVER (PARTITION BY feature) AS tn, "
    "lead(value) OVER (PARTITION BY feature ORDER BY value) AS next_value FROM vs2), "
    "a AS (SELECT feature, value AS cut_value, (value + next_value) / 2 AS cut, "
    "cl + ((tn - tl) - (cn - cl)) AS a1, tn - (cl + ((tn - tl) - (cn - cl))) AS a2, tn, tl FROM d2 "
    "WHERE next_value IS NOT NULL), "
    "b AS (SELECT feature, cut_value, cut, CASE WHEN a1 >= a2 THEN '<=' ELSE '>' END AS direction, "
    "greatest(a1, a2) AS agree, (greatest(a1, a2) - greatest(tl, tn - tl)) / (tn - greatest(tl, tn - tl)) "
    "AS adj_agree FROM a), "
    "bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY agree DESC, cut_value) AS r "
    "FROM b) WHERE r = 1 AND adj_agree > 0) ")


@register("t8_surrogate_splits", _T8 + f"SELECT feature, CAST(agree AS BIGINT) AS agree, {r4s('cut_value')} AS "
          f"cut_value, {r4s('cut')} AS cut, direction, {r4s('adj_agree')} AS adj_agree FROM bb "
          "ORDER BY agree DESC, feature LIMIT 5")
def t8_surrogate_splits(spark, sf_dir):
    """Surrogates of the root's primary split (the best T1 cut)."""
    hh = fx.hh(spark, sf_dir)
    p = tr.competitor_splits(hh, Y, TREE_X, k=1).first()
    others = [c for c in TREE_X if c != p["feature"]]
    out = tr.surrogate_splits(hh, F.col(p["feature"]) <= F.lit(p["cut_value"]), others, k=5)
    return r4(out.withColumn("agree", F.col("agree").cast("bigint")))


# ---- CART on the dummy model frame (rows checks) -----------------------

def _frame(spark, sf_dir):
    d = model_frame(spark, sf_dir)
    return d.filter("in_train"), d.filter(~F.col("in_train")), features(d)


def _score(t, te, spark, label):
    p = t.transform(te)
    return p.agg(F.lit(label).alias("model"), tb.rmse(p, "prediction", Y).alias("test_rmse"),
                 F.lit(len(t.leaves())).alias("leaves"), F.lit(t.depth()).alias("depth"))


@register("t2_regression_tree")
def t2_regression_tree(spark, sf_dir):
    """rpart-style tree (cp 0.01, minsplit 20, minbucket 7): test RMSE, leaves, depth."""
    train, te, x = _frame(spark, sf_dir)
    t = tr.regression_tree(train, Y, x, cp=0.01, minsplit=20)
    return _score(t, te, spark, "tree_cp0.01")


@register("t3_cost_complexity_prune")
def t3_cost_complexity_prune(spark, sf_dir):
    """One tree grown at cp 0.001, pruned at cp 0.03 / 0.01 / 0.001 (no refit): size and test RMSE of each."""
    train, te, x = _frame(spark, sf_dir)
    full = ca.grow_cart(train, Y, x, cp=0.001)
    seq = tr.prune_sequence(full)
    rows = None
    for cp in (0.03, 0.01, 0.001):
        s = _score(tr.prune(full, cp, seq), te, spark, f"cp{cp}")
        rows = s if rows is None else rows.unionByName(s)
    return rows


@register("t9_tree_nodes")
def t9_tree_nodes(spark, sf_dir):
    """Node table of the cp 0.01 tree: rule, n, deviance, value, leaf flag."""
    train, _, x = _frame(spark, sf_dir)
    return tr.tree_nodes(tr.regression_tree(train, Y, x, cp=0.01, minsplit=20), spark)


@register("t10_importance_gain")
def t10_importance_gain(spark, sf_dir):
    train, _, x = _frame(spark, sf_dir)
    return tr.importance_gain(tr.regression_tree(train, Y, x, cp=0.001, minsplit=20), spark)


@register("g2_prediction_table")
def g2_prediction_table(spark, sf_dir):
    """Rows per distinct predicted value of the cp 0.01 tree (= leaf sizes) on training rows."""
    train, _, x = _frame(spark, sf_dir)
    t = tr.regression_tree(train, Y, x, cp=0.01, minsplit=20)
    return tb.prediction_table(t.transform(train))


CP_GRID = [0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.003, 0.002, 0.001]


@register("t4_cp_table")
def t4_cp_table(spark, sf_dir):
    """cp, splits, relative error of the pruning sequence, plus 10-fold xerror / xstd per cp."""
    train, _, x = _frame(spark, sf_dir)
    table = tr.cp_table(ca.grow_cart(train, Y, x, cp=0.001))
    cps = [r[0] for r in table]
    cv = tr.cv_cp(rs.kfold(train, 10, "hhid", seed=3), Y, x, "fold", cps)
    rows = [(float(c), int(s), float(re), cv[c][2], cv[c][3]) for c, s, re in table]
    return spark.createDataFrame(rows, "cp double, nsplit int, rel_error double, xerror double, xstd double")


@register("t5_tune_cp")
def t5_tune_cp(spark, sf_dir):
    """10-fold CV over a cp grid (one deep tree per fold, pruned per cp); best refit, test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    cv = tr.cv_cp(rs.kfold(train, 10, "hhid", seed=3), Y, x, "fold", CP_GRID)
    res = spark.createDataFrame([(c, v[0], v[1]) for c, v in cv.items()], "cp double, rmse double, rmse_sd double")
    best = tb.best_row(res, "rmse", ["cp"]).first()
    t = tr.regression_tree(train, Y, x, cp=best["cp"], minsplit=20)
    test_rmse = _score(t, te, spark, "tuned").first()["test_rmse"]
    return res.withColumn("chosen", F.col("cp") == F.lit(best["cp"])) \
        .withColumn("test_rmse", F.when(F.col("chosen"), F.lit(test_rmse)))


@register("t6_tune_maxdepth")
def t6_tune_maxdepth(spark, sf_dir):
    """10-fold CV of depth 1..8: one deep tree per fold truncated per depth, scored in one aggregate each."""
    train, _, x = _frame(spark, sf_dir)
    d = snapshot(rs.kfold(train, 10, "hhid", seed=3))
    depths = list(range(1, 9))

    def one(f):
        trn, held = d.filter(F.col("fold") != f), d.filter(F.col("fold") == f)
        t = tr.prune(ca.grow_cart(trn, Y, x, 0.001, maxdepth=8), 0.001)
        stats = tr.held_out_leaf_stats(t, held, Y)
        n = sum(v[0] for v in stats.values())
        return [np.sqrt(tr.variant_sse(t, t.truncate(k), stats) / n) for k in depths]

    errs = tr.parallel_map(one, list(range(10)))
    E = np.array(errs)
    rows = [(k, float(E[:, i].mean()), float(E[:, i].std(ddof=1))) for i, k in enumerate(depths)]
    return spark.createDataFrame(rows, "max_depth int, rmse double, rmse_sd double")


@register("t2_surrogate_tree")
def t2_surrogate_tree(spark, sf_dir):
    """Regression tree where a fifth of every predictor is missing: rows follow surrogate splits; test RMSE against sending them right."""
    d = rs.stratified_split(fx.hh(spark, sf_dir), Y, 0.75, "hhid", seed=7)
    d = d.withColumns({c: F.when(hash_uniform(31, "hhid", F.lit(c)) >= 0.2, F.col(c)) for c in TREE_X})
    d = snapshot(d)
    train, te = d.filter("in_train"), d.filter(~F.col("in_train"))
    rows = []
    for name, t in (("surrogates", ca.grow_surrogate_cart(train, Y, TREE_X, cp=0.01)), ("right", ca.grow_cart(train, Y, TREE_X, cp=0.01))):
        p = t.transform(te)
        rows.append((name, len(t.leaves()), float(p.agg(tb.rmse(p, "prediction", Y)).first()[0])))
    return spark.createDataFrame(rows, "nulls string, leaves int, test_rmse double")
