"""Registered queries: ensembles, HIST-kernel learners, tuning, neighbours, networks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform_sql
from ..operators import cart as ca
from ..operators import ensembles as en
from ..operators import hist as hs
from ..operators import linear as lin
from ..operators import mars
from ..operators import model_trees as mt
from ..operators import neighbors as nb
from ..operators import neural as nn
from ..operators import resampling as rs
from ..operators import smooth as sm
from ..operators import tables as tb
from ..operators import trees as tr
from ..operators import tuning as tu
from ..operators.boost import GridBoost, Spec
from ..functions.hashing import hash_uniform
from ..session import snapshot
from . import fixtures as fx
from .fixture_sql import HH, HH_RAW, with_ctes
from .flagship import features, model_frame
from .registry import r4, r4s, register

Y = fx.HH_Y


def _frame(spark, sf_dir):
    d = model_frame(spark, sf_dir)
    return d.filter("in_train"), d.filter(~F.col("in_train")), features(d)


def _test_rmse(model, te, label, extra=None):
    p = model.transform(te)
    cols = [F.lit(label).alias("model"), tb.rmse(p, "prediction", Y).alias("test_rmse"), F.count("*").alias("n")]
    for k, v in (extra or {}).items():
        cols.append(F.lit(v).alias(k))
    return p.agg(*cols)


# ------------------------------------------------ forests and boosting ---

@register("b1_bagged_trees")
def b1_bagged_trees(spark, sf_dir):
    """25 bootstrap trees, every feature tried at each split; test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(en.bagged_trees(train, Y, x, "hhid", trees=25), te, "bagged_trees")


@register("b2_random_forest")
def b2_random_forest(spark, sf_dir):
    """100-tree forest, mtry = p/3, min node 5; test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(en.random_forest(train, Y, x, "hhid", trees=100, mtry=max(1, len(x) // 3), min_node=5), te, "forest")


@register("b5_gbm")
def b5_gbm(spark, sf_dir):
    """Squared-loss boosting: 100 trees of 4 splits, shrinkage 0.1, min obs 10."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(en.gbm(train, Y, x, "hhid", trees=100, depth=4, shrinkage=0.1, min_obs=10)[0], te, "gbm")


@register("b5_gbm_train_fraction")
def b5_gbm_train_fraction(spark, sf_dir):
    """Boosting on a share of 0.736 of the rows: error on the rest after every one of 100 trees."""
    train, _, x = _frame(spark, sf_dir)
    _, curve = en.gbm(train, Y, x, "hhid", trees=100, depth=14, shrinkage=0.0243, min_obs=10, train_fraction=0.736)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(curve)], "trees int, held_rmse double")


@register("b6_gbm_rounds")
def b6_gbm_rounds(spark, sf_dir):
    """Held-out RMSE of one boosting fit at every tree count 1..100 (no refits)."""
    train, te, x = _frame(spark, sf_dir)
    m, _ = en.gbm(train, Y, x, "hhid", trees=100, depth=4, shrinkage=0.1, min_obs=10)
    return en.gbm_rounds(m, te, Y)


@register("b11_tree_boost")
def b11_tree_boost(spark, sf_dir):
    """Boosting of small regression trees: 100 rounds, depth 2, step 0.1."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(en.tree_boost(train, Y, x, "hhid", rounds=100, maxdepth=2, nu=0.1, min_node=7), te, "tree_boost")


# ------------------------------------------------ HIST-kernel learners ---

@register("t11_inference_tree")
def t11_inference_tree(spark, sf_dir):
    """Conditional inference tree (mincriterion 0.95): test RMSE, leaves, depth."""
    train, te, x = _frame(spark, sf_dir)
    t = hs.ctree(train, Y, x, mincriterion=0.95)
    return _test_rmse(t, te, "ctree", {"leaves": len(t.leaves()), "depth": t.depth()})


@register("t12_inference_tree_tuned")
def t12_inference_tree_tuned(spark, sf_dir):
    """5-fold CV over mincriterion x maxdepth for the inference tree."""
    train, _, x = _frame(spark, sf_dir)
    bins = hs.make_bins(train, x, 64)
    grid = tu.grid_points({"mincriterion": [0.5, 0.95], "maxdepth": [2, 4]})
    rows, best, _ = tu.cv_tune(rs.kfold(train, 5, "hhid", seed=3), Y,
                               lambda d, mincriterion, maxdepth: hs.ctree(d, Y, x, mincriterion=mincriterion,
                                                                          maxdepth=maxdepth, bins=bins),
                               grid, refit=False)
    return spark.createDataFrame(rows)


@register("b3_conditional_forest")
def b3_conditional_forest(spark, sf_dir):
    """10 inference trees on Poisson bootstrap weights and 5 random features each."""
    train, te, x = _frame(spark, sf_dir)
    trees = hs.conditional_forest(train, Y, x, "hhid", trees=10, mtry=5, maxdepth=4)
    p = te.withColumn("prediction", hs.forest_expr(trees))
    return p.agg(F.lit("cforest").alias("model"), tb.rmse(p, "prediction", Y).alias("test_rmse"),
                 F.count("*").alias("n"))


@register("b7_xgb")
def b7_xgb(spark, sf_dir):
    """Second-order boosting: 76 rounds, depth 3, eta 0.181, colsample 0.8, min child weight 1."""
    train, te, x = _frame(spark, sf_dir)
    m, _, _ = hs.xgb(train, Y, x, "hhid", rounds=76, max_depth=3, eta=0.181, colsample=0.8, min_child_weight=1.0)
    return _test_rmse(m, te, "xgb")


@register("b8_leafwise_boost")
def b8_leafwise_boost(spark, sf_dir):
    """Best-leaf-first boosting at the tuned setting: 100 rounds, 255 leaves, depth 8, 40 bins, rate 0.01, native categories."""
    d = snapshot(rs.stratified_split(fx.hh(spark, sf_dir), Y, 0.75, "hhid", seed=7))
    m, _, _ = hs.leafwise_boost(d.filter("in_train"), Y, [*fx.HH_NUMERIC, *fx.HH_NOMINAL], "hhid", rounds=100, num_leaves=255, max_depth=8,
                                learning_rate=0.01, colsample=0.9, max_bin=40, categorical=fx.HH_NOMINAL)
    return _test_rmse(m, d.filter(~F.col("in_train")), "leafwise")


@register("b9_early_stop")
def b9_early_stop(spark, sf_dir):
    """Second-order boosting scored on a validation share each round; stop after 10 rounds without gain."""
    d = model_frame(spark, sf_dir)
    x = features(d)
    train = d.filter("in_train").withColumn("_valid", hash_uniform(13, "hhid") < 0.2)
    _, curve, best = hs.xgb(train, Y, x, "hhid", rounds=40, max_depth=3, eta=0.3, valid_col="_valid", patience=10)
    best_r, stop_r = hs.early_stop(curve, 10)
    rows = [(i + 1, float(v), (i + 1) == best_r, (i + 1) == stop_r) for i, v in enumerate(curve)]
    return spark.createDataFrame(rows, "round int, valid_rmse double, is_best boolean, is_stop boolean")


#: fixed values: the grid of the reference's search
LEAF_GRID = {"num_leaves": [5, 7, 9, 255], "max_depth": [4, 6, 8, 48, 64], "subsample": [0.7, 0.9, 1.0], "colsample": [0.7, 0.9, 1.0],
             "min_child_weight": [0.0, 0.01, 0.1], "scale_pos_weight": [100, 200, 300, 400]}


@register("b10_grid_search_valid")
def b10_grid_search_valid(spark, sf_dir):
    """All 2,160 rows of the tuning grid on the training part, scored on the validation part after each of 100 rounds.

    Rows that no tree can tell apart are one model: a tree of L leaves is at most L - 1 deep, a child of
    20 rows has a hessian of 20, and the weight of positives is not used in regression.
    All models grow in the same passes.
    """
    d = snapshot(rs.train_valid_test(fx.hh(spark, sf_dir), Y, 0.75, 0.2, "hhid", seed=7).filter("in_train"))
    grid = tu.grid_points(LEAF_GRID)
    spec = lambda p: Spec(p["num_leaves"], min(p["max_depth"], p["num_leaves"] - 1), 0.01, 0.0, 0.0,
                          max(20.0, p["min_child_weight"]), p["subsample"], p["colsample"])
    specs = list(dict.fromkeys(map(spec, grid)))
    boost = GridBoost(d, Y, [*fx.HH_NUMERIC, *fx.HH_NOMINAL], "hhid", specs, 1, 40, "in_valid", fx.HH_NOMINAL)
    curves = {s: c for s, (_, c, _) in zip(specs, boost.fit(100, 10, models=False))}
    rows = [(*p.values(), min(curves[spec(p)]), max(curves[spec(p)]), len(curves[spec(p)])) for p in grid]
    res = spark.createDataFrame(rows, "num_leaves int, max_depth int, subsample double, colsample double, min_child_weight double, "
                                      "scale_pos_weight int, valid_rmse double, worst_rmse double, rounds int")
    best = tb.best_row(res, "valid_rmse", list(LEAF_GRID)).first()
    same = [F.col(c) == F.lit(best[c]) for c in LEAF_GRID]
    return res.withColumn("best", reduce(lambda a, b: a & b, same))


@register("b12_inference_boost")
def b12_inference_boost(spark, sf_dir):
    """Boosting with depth-2 inference trees on residuals: 15 rounds, nu 0.1."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(hs.inference_boost(train, Y, x, "hhid", mstop=15, nu=0.1, maxdepth=2), te, "inference_boost")


@register("b14_componentwise_boost")
def b14_componentwise_boost(spark, sf_dir):
    """Componentwise boosting of penalised splines with four degrees of freedom: 100 rounds, nu 0.1; test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(sm.smooth_boost(train, Y, x, mstop=100, nu=0.1), te, "componentwise_boost")


# --------------------------------------------------- composite models ---

@register("t13_model_tree")
def t13_model_tree(spark, sf_dir):
    """Model trees over the option grid pruned x smoothed x rules: test RMSE, number of models."""
    train, te, x = _frame(spark, sf_dir)
    train, te = snapshot(train), snapshot(te.select(*x, Y))
    growth = mt.Growth(train, Y, x, "hhid", 0.01, 7)
    rows = []
    for p in tu.grid_points({"pruned": [True, False], "smoothed": [True, False], "rules": [False, True]}):
        if p["rules"]:
            m = mt.model_rules(train, Y, x, "hhid", cp=0.01, smoothed=p["smoothed"], pruned=p["pruned"], growth=growth)
            size = len(m.rules)
        else:
            _, tree, grams = growth.at()
            m = mt.model_tree(train, Y, x, smoothed=p["smoothed"], pruned=p["pruned"], tree=tree, grams=grams)
            size = len(m.tree.leaves())
        rows.append((*p.values(), float(m.transform(te).agg(tb.rmse(te, "prediction", Y)).first()[0]), size))
    return spark.createDataFrame(rows, "pruned boolean, smoothed boolean, rules boolean, test_rmse double, models int")


@register("b13_rule_committee")
def b13_rule_committee(spark, sf_dir):
    """Committee of 98 sequential model trees with 0 to 9 neighbours: test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    train, te = snapshot(train), snapshot(te)
    m = mt.rule_committee(train, Y, x, committees=98, key="hhid")
    p = mt.neighbor_corrections(m, train, te, Y, "hhid", x, 9)
    got = p.agg(*[tb.rmse(p, f"prediction{k}", Y).alias(f"k{k}") for k in range(10)]).first()
    rows = [(k, float(got[k])) for k in range(10)]
    return spark.createDataFrame(rows, "neighbors int, test_rmse double")


@register("b4_bagged_mars")
def b4_bagged_mars(spark, sf_dir):
    """10 bootstrap hinge regressions (degree 1, GCV pruning) averaged; test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    numeric = [c for c in fx.HH_NUMERIC if c in x]
    binary = [c for c in x if c not in numeric]
    return _test_rmse(mars.bagged_mars(train, Y, numeric, binary, "hhid", draws=10), te, "bagged_mars")


# ------------------------------------------------ tuning & interpretation ---

@register("m1_cv_tune")
def m1_cv_tune(spark, sf_dir):
    """5-fold CV of a 100-tree forest over mtry; results per grid point."""
    train, _, x = _frame(spark, sf_dir)
    grid = [{"mtry": m} for m in (2, 5, 10)]
    rows, _, _ = tu.cv_tune(rs.kfold(train, 5, "hhid", seed=3), Y,
                            lambda d, mtry: en.random_forest(d, Y, x, "hhid", trees=100, mtry=mtry), grid, refit=False)
    return spark.createDataFrame(rows)


@register("m2_random_tune")
def m2_random_tune(spark, sf_dir):
    """A 6-point random design over (cp, minsplit) for the CART tree, 5-fold CV each; best refit."""
    train, te, x = _frame(spark, sf_dir)
    space = {"cp": ("num", 0.001, 0.05), "minsplit": ("int", 2, 100)}
    rows, best, model = tu.random_tune(rs.kfold(train, 5, "hhid", seed=3), Y,
                                       lambda d, cp, minsplit: tr.regression_tree(d, Y, x, cp=cp, minsplit=minsplit),
                                       space, 6, seed=21)
    res = spark.createDataFrame(rows)
    test = model.transform(te).agg(tb.rmse(te, "prediction", Y)).first()[0]
    return res.withColumn("best", (F.col("cp") == best["cp"]) & (F.col("minsplit") == best["minsplit"])) \
        .withColumn("best_test_rmse", F.when(F.col("best"), F.lit(test)))


@register("m3_default_grid")
def m3_default_grid(spark, sf_dir):
    """Automatic grids of length 5: tree cps from the data's pruning sequence, forest mtry from p."""
    train, _, x = _frame(spark, sf_dir)
    cps = [c for c, _, _ in tr.cp_table(ca.grow_cart(train, Y, x, cp=0.0005))]
    rows = []
    for method in ("tree", "forest", "gbm", "enet"):
        for p in tu.default_grid(method, 5, len(x), cps):
            rows.append((method, json.dumps({k: float(v) for k, v in p.items()}, sort_keys=True)))
    return spark.createDataFrame(rows, "method string, params string")


@register("m4_importance_permutation")
def m4_importance_permutation(spark, sf_dir):
    """RMSE increase on held-out rows when each feature is permuted (blocked hash permutation)."""
    train, te, x = _frame(spark, sf_dir)
    t = tr.regression_tree(train, Y, x, cp=0.005, minsplit=20)
    return tu.importance_permutation(t, te, Y, "hhid", x, seed=5)


@register("m6_partial_dependence", with_ctes(HH_RAW, HH) + (
    ", s AS (SELECT var_pop(members) AS v11, var_pop(rooms) AS v22, covar_pop(members, rooms) AS c12, "
    f"covar_pop(members, {Y}) AS c1y, covar_pop(rooms, {Y}) AS c2y, avg(members) AS m1, avg(rooms) AS m2, "
    f"avg({Y}) AS my FROM hh), "
    "b AS (SELECT *, (c1y * v22 - c2y * c12) / (v11 * v22 - c12 * c12) AS b1, "
    "(c2y * v11 - c1y * c12) / (v11 * v22 - c12 * c12) AS b2 FROM s), "
    "f AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b) "
    f"SELECT CAST(g.v AS DOUBLE) AS value, {r4s('avg(f.b0 + f.b1 * g.v + f.b2 * h.rooms)')} AS yhat "
    "FROM hh h, f, (VALUES (1), (2), (3), (4), (5), (6), (7)) AS g(v) GROUP BY g.v"))
def m6_partial_dependence(spark, sf_dir):
    """Partial dependence of the OLS fit on ``members`` over 1..7."""
    hh = fx.hh(spark, sf_dir)
    m = lin.ols(hh, Y, ["members", "rooms"])
    return r4(tu.partial_dependence(m, hh, "members", [1, 2, 3, 4, 5, 6, 7]))


@register("m6_partial_dependence_forest")
def m6_partial_dependence_forest(spark, sf_dir):
    """Partial dependence of a 50-tree forest on ``members`` over its observed range."""
    train, _, x = _frame(spark, sf_dir)
    m = en.random_forest(train, Y, x, "hhid", trees=50, mtry=5)
    lo, hi = train.agg(F.min("members"), F.max("members")).first()
    return tu.partial_dependence(m, train, "members", list(range(int(lo), int(hi) + 1)))


@register("m7_shadow_selection")
def m7_shadow_selection(spark, sf_dir):
    """Shadow-feature selection over 20 rounds: importances are RSS reductions of 30 forest trees a round."""
    train, _, x = _frame(spark, sf_dir)
    return tu.shadow_selection(train, Y, "hhid", x, rounds=20, trees=30, seed=9)


# ------------------------------------------------------------ neighbours ---

_KNN_U = hash_uniform_sql(17, "vec_id")


@register("n1_knn_regress", (
    f"WITH v AS (SELECT vec_id, embedding, label, {_KNN_U} AS u FROM embeddings), "
    "q AS (SELECT vec_id, embedding FROM v WHERE u < 0.2), "
    "t AS (SELECT vec_id, embedding, label FROM v WHERE u >= 0.2), "
    "d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, "
    "list_distance(list_transform(q.embedding, lambda e: CAST(e AS DOUBLE)), "
    "list_transform(t.embedding, lambda e: CAST(e AS DOUBLE))) AS dist FROM q, t), "
    "r AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d) "
    f"SELECT qid AS vec_id, {r4s('avg(CAST(label AS DOUBLE))')} AS prediction FROM r WHERE rn <= 5 GROUP BY qid"))
def n1_knn_regress(spark, sf_dir):
    """Exact 5-NN regression: query rows are a 20% hash share of ``embeddings``, the rest train."""
    v = fx.vec(spark, sf_dir).withColumn("_u", hash_uniform(17, "vec_id"))
    q = v.filter(F.col("_u") < 0.2)
    t = v.filter(F.col("_u") >= 0.2)
    return r4(nb.knn_regress(t, q, "vec_id", "embedding", "label", k=5))


# --------------------------------------------------------------- networks ---

@register("k1_mlp")
def k1_mlp(spark, sf_dir):
    """One hidden layer of 5 logistic units, decay 0.1, 30 L-BFGS iterations; test RMSE."""
    train, te, x = _frame(spark, sf_dir)
    return _test_rmse(nn.mlp(train, Y, x, [5], decay=0.1, maxit=30), te, "mlp")


@register("k2_mlp_two_layer")
def k2_mlp_two_layer(spark, sf_dir):
    """Random search over two hidden-layer sizes, each scored on a validation share."""
    train, _, x = _frame(spark, sf_dir)
    u = hash_uniform(23, "hhid")
    rows = nn.mlp_random_search(train.filter(u >= 0.2), train.filter(u < 0.2), Y, x, n=3, seed=4, maxit=15)
    return spark.createDataFrame(rows, "hidden1 int, hidden2 int, valid_rmse double")


_T11X = [*fx.HH_NUMERIC, *fx.HH_NOMINAL]


@register("t11_root_statistic", with_ctes(HH_RAW, HH) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r4s(f'(count(*) - 1) * power(corr({c}, {Y}), 2)')} AS statistic FROM hh"
    for c in _T11X))
def t11_root_statistic(spark, sf_dir):
    """Root-node association statistics of the inference tree, (n-1) r^2 per feature, from one HIST pass."""
    hh = fx.hh(spark, sf_dir)
    st = hs.association_statistics(hh, Y, _T11X)
    return r4(spark.createDataFrame([(f, float(v)) for f, v in st.items()], "feature string, statistic double"))


_T11N = "CAST((hhid * 7919) % 101 AS DOUBLE)"


def _t11_nominal_sql():
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT (count(*) - 1) FROM hh) * sum(n * (m - (SELECT avg({_T11N}) FROM hh)) * (m - (SELECT avg({_T11N}) FROM hh))) "
        f"/ (SELECT count(*) * var_pop({_T11N}) FROM hh) AS x, count(*) - 1 AS df "
        f"FROM (SELECT count(*) AS n, avg({_T11N}) AS m FROM hh GROUP BY {c})" for c in fx.HH_NOMINAL)
    # the upper tail of chi-square has a finite sum for an even number of degrees of freedom
    tail = "exp(-x / 2) * list_sum(list_transform(range(CAST(df // 2 AS BIGINT)), lambda k: power(x / 2, k) / factorial(CAST(k AS INT))))"
    return (with_ctes(HH_RAW, HH) + f", t AS ({parts}) SELECT feature, {r4s('x')} AS statistic, CAST(df AS INT) AS df, "
            f"CASE WHEN df % 2 = 0 THEN {r4s(tail)} END AS p FROM t")


@register("t11_nominal_tests", _t11_nominal_sql())
def t11_nominal_tests(spark, sf_dir):
    """Association of an unrelated outcome with the nominal columns: quadratic statistic, degrees of freedom, p (where SQL can tell it)."""
    hh = snapshot(fx.hh(spark, sf_dir).withColumn("_noise", F.expr("CAST((hhid * 7919) % 101 AS DOUBLE)")))
    got = hs.association_tests(hh, "_noise", list(fx.HH_NOMINAL), nominal=fx.HH_NOMINAL)
    rows = [(f, float(x), int(df), float(p) if df % 2 == 0 else None) for f, (x, df, p) in got.items()]
    return r4(spark.createDataFrame(rows, "feature string, statistic double, df int, p double"))


@register("t11_inference_tree_nominal")
def t11_inference_tree_nominal(spark, sf_dir):
    """Conditional inference tree on the columns as they are, nominal ones as sets of levels: test RMSE, leaves, depth."""
    d = snapshot(rs.stratified_split(fx.hh(spark, sf_dir), Y, 0.75, "hhid", seed=7))
    t = hs.ctree(d.filter("in_train"), Y, [*fx.HH_NUMERIC, *fx.HH_NOMINAL], mincriterion=0.95, nominal=fx.HH_NOMINAL)
    return _test_rmse(t, d.filter(~F.col("in_train")), "ctree", {"leaves": len(t.leaves()), "depth": t.depth()})
