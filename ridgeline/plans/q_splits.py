"""Registered queries: splits, resampling, grids and result tables (E, G, R14)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform_sql, poisson_weight_sql
from ..operators import linear as lin
from ..operators import recode as rc
from ..operators import resampling as rs
from ..operators import tables as tb
from ..operators.gram import gram
from . import fixtures as fx
from .fixture_sql import HH, HH_RAW, with_ctes
from .registry import r4, r4s, register

Y = fx.HH_Y
SPLIT_SEED, SPLIT_P = 7, 0.75


def split_cte(name: str, src: str, seed: int, p: float, y: str = Y, key: str = "hhid", breaks: int = 5) -> str:
    """SQL twin of ``stratified_split``: ``name(key, in_train)`` over CTE ``src``."""
    probs = [i / (breaks - 1) for i in range(1, breaks - 1)]
    qs = ", ".join(f"quantile_cont({y}, {pr!r}) AS q{i}" for i, pr in enumerate(probs))
    strat = " + ".join(f"(CASE WHEN {y} > q{i} THEN 1 ELSE 0 END)" for i in range(len(probs)))
    u = hash_uniform_sql(seed, key)
    return (f"{name} AS (SELECT {key}, rn <= ceil({p!r} * ns) AS in_train FROM ("
            f"SELECT {key}, row_number() OVER (PARTITION BY st ORDER BY u, {key}) AS rn, "
            f"count(*) OVER (PARTITION BY st) AS ns FROM ("
            f"SELECT s.{key}, CAST({strat} AS INT) AS st, {u} AS u FROM {src} s, "
            f"(SELECT {qs} FROM {src}) q) a) b)")


HH_SPLIT = with_ctes(HH_RAW, HH, split_cte("sp", "hh", SPLIT_SEED, SPLIT_P))


def hh_split(spark, sf_dir):
    return rs.stratified_split(fx.hh(spark, sf_dir), Y, SPLIT_P, "hhid", seed=SPLIT_SEED)


# ------------------------------------------------------------------ E ---

@register("e1_stratified_split", HH_SPLIT + "SELECT hhid FROM sp WHERE in_train")
def e1_stratified_split(spark, sf_dir):
    return hh_split(spark, sf_dir).filter("in_train").select("hhid")


@register("e2_complement", HH_SPLIT + "SELECT hhid FROM hh WHERE hhid NOT IN (SELECT hhid FROM sp WHERE in_train)")
def e2_complement(spark, sf_dir):
    d = hh_split(spark, sf_dir)
    train = d.filter("in_train")
    return rs.complement(d, train, "hhid").select("hhid")


_TVT = with_ctes(HH_RAW, HH, split_cte("sp", "hh", SPLIT_SEED, SPLIT_P),
                 "tr AS (SELECT hh.* FROM hh JOIN sp USING (hhid) WHERE sp.in_train)",
                 split_cte("sv", "tr", SPLIT_SEED + 1, 0.2).replace("in_train", "in_valid"))


@register("e3_train_valid_test", _TVT + "SELECT sp.hhid, sp.in_train, coalesce(sv.in_valid, false) AS in_valid "
          "FROM sp LEFT JOIN sv USING (hhid)")
def e3_train_valid_test(spark, sf_dir):
    d = rs.train_valid_test(fx.hh(spark, sf_dir), Y, SPLIT_P, 0.2, "hhid", seed=SPLIT_SEED)
    return d.select("hhid", "in_train", "in_valid")


@register("e4_kfold", with_ctes(HH_RAW, HH) + f"SELECT hhid, CAST(floor({hash_uniform_sql(3, 'hhid')} * 10) AS INT)"
          " AS fold FROM hh")
def e4_kfold(spark, sf_dir):
    return rs.kfold(fx.hh(spark, sf_dir), 10, "hhid", seed=3).select("hhid", "fold")


@register("e5_repeated_kfold", with_ctes(HH_RAW, HH) + "SELECT hhid, CAST(rep AS INT) AS rep, CAST(floor("
          + hash_uniform_sql(4, "hhid", "rep") + " * 5) AS INT) AS fold FROM hh, generate_series(1, 3) AS t(rep)")
def e5_repeated_kfold(spark, sf_dir):
    return rs.repeated_kfold(fx.hh(spark, sf_dir), 5, 3, "hhid", seed=4).select("hhid", "rep", "fold")


@register("e6_bootstrap", with_ctes(HH_RAW, HH) + "SELECT hhid, CAST(draw AS INT) AS draw, "
          + poisson_weight_sql(hash_uniform_sql(5, "hhid", "draw")) + " AS weight FROM hh, generate_series(1, 25) AS t(draw)")
def e6_bootstrap(spark, sf_dir):
    return rs.bootstrap(fx.hh(spark, sf_dir), "hhid", 25, seed=5).select("hhid", "draw", "weight")


@register("e7_grid", with_ctes(HH_RAW, HH) + "SELECT CAST(d AS INT) AS max_depth, CAST(m AS INT) AS min_node "
          "FROM (SELECT count(*) AS n FROM hh) s, generate_series(1, CAST(ceil(log2(s.n)) AS BIGINT)) AS t(d), "
          "(VALUES (5), (10), (20)) AS v(m)")
def e7_grid(spark, sf_dir):
    """Tree grid: depth 1..ceil(log2 n) (n from the data) x minimum node size."""
    n = fx.hh(spark, sf_dir).agg(F.count("*").alias("n"))
    axes = {"max_depth": F.sequence(F.lit(1), F.ceil(F.log2(F.col("n"))).cast("int")), "min_node": [5, 10, 20]}
    return rs.expand_grid(n, axes).select(F.col("max_depth").cast("int"), F.col("min_node").cast("int"))


def _lmax_sql():
    terms = [f"abs(covar_pop({c}, {Y}) / stddev_pop({c}))" for c in fx.HH_NUMERIC]
    return f"greatest({', '.join(terms)})"


@register("e8_log_grid", with_ctes(HH_RAW, HH) + "SELECT CAST(i AS INT) AS step, "
          + r4s("pow(10, log10(lmax * 0.0001) + i * (log10(lmax) - log10(lmax * 0.0001)) / 19.0)")
          + f" AS lambda FROM (SELECT {_lmax_sql()} AS lmax FROM hh) s, generate_series(0, 19) AS t(i)")
def e8_log_grid(spark, sf_dir):
    """Lasso lambda grid: 20 log-spaced values down from lambda_max of the data."""
    hh = fx.hh(spark, sf_dir)
    lmax = F.greatest(*[F.abs(F.covar_pop(c, Y) / F.stddev_pop(c)) for c in fx.HH_NUMERIC])
    s = hh.agg(lmax.alias("lmax"))
    grid = s.select(F.posexplode(rs.log_grid(F.log10(F.col("lmax") * 0.0001), F.log10(F.col("lmax")), 20)))
    return r4(grid.select(F.col("pos").cast("int").alias("step"), F.col("col").alias("lambda")))


def _design_sql():
    u = lambda name: hash_uniform_sql(11, f"'{name}'", "point")
    return ("SELECT CAST(point AS INT) AS point, "
            f"CAST(least(hi, floor(1 + {u('min_node')} * (hi - 1 + 1))) AS INT) AS min_node, "
            f"{r4s('0.5 + ' + u('sample_frac') + ' * 0.5')} AS sample_frac, "
            f"CAST(least(9, floor(1 + {u('mtry')} * (9 - 1 + 1))) AS INT) AS mtry "
            "FROM (SELECT CAST(ceil(sqrt(count(*))) AS INT) AS hi FROM hh) s, generate_series(1, 30) AS t(point)")


@register("e9_random_design", with_ctes(HH_RAW, HH) + _design_sql())
def e9_random_design(spark, sf_dir):
    """30 forest settings; the node-size bound sqrt(n) comes from the data."""
    bounds = fx.hh(spark, sf_dir).agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("hi"))
    space = {"min_node": ("int", 1, "hi"), "sample_frac": ("num", 0.5, 1.0), "mtry": ("int", 1, 9)}
    return r4(rs.random_design(bounds, space, 30, seed=11))


# ---------------------------------------------------------------- R14 ---

_STD = [*fx.HH_NUMERIC, Y]


@register("r14_standardize", HH_SPLIT + "SELECT t.hhid, " + ", ".join(
    r4s(f"(t.{c} - st.m_{c}) / st.s_{c}") + f" AS {c}" for c in _STD)
    + " FROM (SELECT hh.* FROM hh JOIN sp USING (hhid) WHERE NOT sp.in_train) t, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _STD)
    + " FROM hh JOIN sp USING (hhid) WHERE sp.in_train) st")
def r14_standardize(spark, sf_dir):
    d = hh_split(spark, sf_dir)
    st = rc.standardize(d.filter("in_train"), _STD)
    return r4(st.transform(d.filter(~F.col("in_train"))).select("hhid", *_STD))


# ------------------------------------------------------------------ G ---

@register("g1_freq_table", with_ctes(HH_RAW) + "SELECT h_dwltyp, count(*) AS n FROM hh_raw GROUP BY h_dwltyp")
def g1_freq_table(spark, sf_dir):
    return tb.freq_table(fx.hh_raw(spark, sf_dir), "h_dwltyp")


_NZV_COLS = ["hhsizer", "h_dwlrms", "head_age", "head_educ", "h_dwltyp", "hhprov", "h_owncom", "h_ownwsh",
             "head_gender", "const_flag"]


def _nzv_sql():
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM hh_raw"
                                 for c in _NZV_COLS)
    return (f"cnt AS (SELECT variable, value, count(*) AS c FROM ({stacked}) s WHERE value IS NOT NULL "
            "GROUP BY variable, value), "
            "rk AS (SELECT variable, c, row_number() OVER (PARTITION BY variable ORDER BY c DESC) AS r, "
            "count(*) OVER (PARTITION BY variable) AS nu FROM cnt), "
            "agg AS (SELECT variable, max(nu) AS nu, max(CASE WHEN r = 1 THEN c END) AS c1, "
            "max(CASE WHEN r = 2 THEN c END) AS c2 FROM rk GROUP BY variable), "
            "nzv AS (SELECT variable, CASE WHEN nu <= 1 THEN 0.0 ELSE CAST(c1 AS DOUBLE) / c2 END AS freq_ratio, "
            "100.0 * nu / (SELECT count(*) FROM hh_raw) AS percent_unique, nu <= 1 AS zero_var FROM agg)")


_NZV_SELECT = (f"SELECT variable, {r4s('freq_ratio')} AS freq_ratio, {r4s('percent_unique')} AS percent_unique, "
               "zero_var, (freq_ratio > 19.0 AND percent_unique <= 10) OR zero_var AS nzv FROM nzv")


@register("g3_near_zero_variance", with_ctes(HH_RAW) + ", " + _nzv_sql() + " " + _NZV_SELECT)
def g3_near_zero_variance(spark, sf_dir):
    return r4(tb.near_zero_variance(fx.hh_raw(spark, sf_dir), _NZV_COLS))


@register("g21_drop_near_zero", with_ctes(HH_RAW) + "SELECT hhid, hhincome, district_label, "
          + ", ".join(c for c in _NZV_COLS if c != "const_flag") + " FROM hh_raw")
def g21_drop_near_zero(spark, sf_dir):
    raw = fx.hh_raw(spark, sf_dir)
    screen = tb.near_zero_variance(raw, _NZV_COLS)
    return tb.drop_near_zero(raw, screen)


_CORR = [*fx.HH_NUMERIC, Y]


@register("g4_corr_matrix", with_ctes(HH_RAW, HH) + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {r4s(f'corr({a}, {b})')} AS r FROM hh" for a in _CORR for b in _CORR))
def g4_corr_matrix(spark, sf_dir):
    return r4(tb.corr_matrix(fx.hh(spark, sf_dir), _CORR))


# one-predictor OLS trained on the training rows, scored on the held-out rows
_OLS1 = HH_SPLIT + (", fit AS (SELECT regr_slope(log_income_pc, members) AS b, "
                    "regr_intercept(log_income_pc, members) AS a FROM hh JOIN sp USING (hhid) WHERE sp.in_train), "
                    "te AS (SELECT hh.* FROM hh JOIN sp USING (hhid) WHERE NOT sp.in_train) ")


def _ols1_pred(spark, sf_dir):
    d = hh_split(spark, sf_dir)
    model = lin.ols(d.filter("in_train"), Y, ["members"])
    return model.transform(d.filter(~F.col("in_train")))


@register("g6_rmse", _OLS1 + "SELECT " + r4s("sqrt(avg(power(te.log_income_pc - (fit.a + fit.b * te.members), 2)))")
          + " AS rmse FROM te, fit")
def g6_rmse(spark, sf_dir):
    p = _ols1_pred(spark, sf_dir)
    return r4(p.agg(tb.rmse(p, "prediction", Y).alias("rmse")))


@register("g7_r2_corr", _OLS1 + "SELECT " + r4s("power(corr(fit.a + fit.b * te.members, te.log_income_pc), 2)")
          + " AS rsquared FROM te, fit")
def g7_r2_corr(spark, sf_dir):
    p = _ols1_pred(spark, sf_dir)
    return r4(p.agg(tb.r2_corr("prediction", Y).alias("rsquared")))


@register("g20_pred_vs_actual", _OLS1 + "SELECT te.hhid, " + r4s("te.log_income_pc") + " AS actual, "
          + r4s("fit.a + fit.b * te.members") + " AS predicted FROM te, fit")
def g20_pred_vs_actual(spark, sf_dir):
    return r4(tb.pred_vs_actual(_ols1_pred(spark, sf_dir), Y, key="hhid"))


@register("l3_predict", _OLS1 + "SELECT te.hhid, " + r4s("fit.a + fit.b * te.members") + " AS prediction FROM te, fit")
def l3_predict(spark, sf_dir):
    return r4(_ols1_pred(spark, sf_dir).select("hhid", "prediction"))


# ---- ridge CV over a lambda grid, one predictor: G8 - G11 --------------

RIDGE_LAMBDAS = [0.0, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0]
CV_K, CV_SEED = 5, 3


def ridge_cv_metrics(spark, sf_dir):
    """Per (fold, lambda) held-out RMSE of ridge on ``members``, from one per-fold Gram."""
    d = rs.kfold(fx.hh(spark, sf_dir), CV_K, "hhid", seed=CV_SEED)
    g = gram(d, ["members", Y], by=["fold"])
    total = g.total()
    rows = []
    for key in g.groups():
        gf = g.mats[key]
        s_tr = lin.standardized(total - gf, g.shift, g.cols, ["members"], Y)
        coefs = lin.enet_path(s_tr, 0.0, RIDGE_LAMBDAS)
        mse = lin.fold_rss(gf, coefs, g.shift, g.cols, ["members"], Y) / gf[0, 0]
        rows += [(int(key[0]), float(lam), float(math.sqrt(m))) for lam, m in zip(RIDGE_LAMBDAS, mse)]
    return spark.createDataFrame(rows, "fold int, lambda double, rmse double")


def _ridge_cv_sql():
    lam = ", ".join(f"({v!r})" for v in RIDGE_LAMBDAS)
    u = hash_uniform_sql(CV_SEED, "hhid")
    return (with_ctes(HH_RAW, HH) + f", f AS (SELECT hhid, members AS x, log_income_pc AS y, "
            f"CAST(floor({u} * {CV_K}) AS INT) AS fold FROM hh), "
            "tr AS (SELECT k.fold, covar_pop(f.x, f.y) AS c, var_pop(f.x) AS v, avg(f.x) AS mx, avg(f.y) AS my "
            "FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY k.fold), "
            f"lam AS (SELECT CAST(l AS DOUBLE) AS \"lambda\" FROM (VALUES {lam}) t(l)), "
            "cf AS (SELECT tr.fold, lam.\"lambda\", tr.c / (tr.v * (1 + lam.\"lambda\")) AS b, tr.mx, tr.my FROM tr, lam), "
            "fm AS (SELECT cf.fold, cf.\"lambda\", sqrt(avg(power(f.y - (cf.my - cf.b * cf.mx) - cf.b * f.x, 2))) AS rmse "
            "FROM cf JOIN f ON f.fold = cf.fold GROUP BY cf.fold, cf.\"lambda\"), "
            "res AS (SELECT \"lambda\" AS lam, avg(rmse) AS rmse, stddev_samp(rmse) AS rmse_sd FROM fm GROUP BY \"lambda\") ")


def ridge_cv_results(spark, sf_dir):
    return tb.cv_summary(ridge_cv_metrics(spark, sf_dir), ["lambda"], "rmse")


@register("g8_cv_summary", _ridge_cv_sql() + f"SELECT {r4s('lam')} AS \"lambda\", {r4s('rmse')} AS rmse, "
          f"{r4s('rmse_sd')} AS rmse_sd FROM res")
def g8_cv_summary(spark, sf_dir):
    return r4(ridge_cv_results(spark, sf_dir))


@register("g9_best_row", _ridge_cv_sql() + f"SELECT {r4s('lam')} AS \"lambda\", {r4s('rmse')} AS rmse, "
          f"{r4s('rmse_sd')} AS rmse_sd FROM res ORDER BY rmse, lam LIMIT 1")
def g9_best_row(spark, sf_dir):
    return r4(tb.best_row(ridge_cv_results(spark, sf_dir), "rmse", ["lambda"]))


@register("g10_one_se_band", _ridge_cv_sql() + f"SELECT {r4s('lam')} AS \"lambda\", {r4s('rmse')} AS rmse, "
          f"{r4s('rmse_sd')} AS rmse_sd, {r4s(f'rmse - rmse_sd / sqrt({CV_K})')} AS lower, "
          f"{r4s(f'rmse + rmse_sd / sqrt({CV_K})')} AS upper FROM res")
def g10_one_se_band(spark, sf_dir):
    return r4(tb.one_se_band(ridge_cv_results(spark, sf_dir), CV_K, "rmse"))


@register("g11_one_se_choice", _ridge_cv_sql() + f"SELECT {r4s('lam')} AS \"lambda\", {r4s('rmse')} AS rmse, "
          f"{r4s('rmse_sd')} AS rmse_sd FROM res WHERE rmse <= (SELECT rmse + rmse_sd / sqrt({CV_K}) FROM res "
          "ORDER BY rmse, lam DESC LIMIT 1) ORDER BY lam DESC LIMIT 1")
def g11_one_se_choice(spark, sf_dir):
    return r4(tb.one_se_choice(ridge_cv_results(spark, sf_dir), "lambda", CV_K, "rmse"))


@register("g14_top_k", with_ctes(HH_RAW, HH) + f"SELECT hhid, {r4s('log_income_pc')} AS log_income_pc FROM hh "
          "ORDER BY log_income_pc DESC, hhid LIMIT 10")
def g14_top_k(spark, sf_dir):
    d = fx.hh(spark, sf_dir).select("hhid", Y)
    return r4(tb.top_k(d, Y, 10, ["hhid"]))


_RANKED = [*fx.HH_NUMERIC, *fx.HH_NOMINAL]


@register("g15_rank_first", with_ctes(HH_RAW, HH) + "SELECT variable, " + r4s("abs_r") + " AS abs_r, "
          "CAST(row_number() OVER (ORDER BY abs_r DESC, variable) AS INT) AS rank FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS variable, abs(corr({c}, {Y})) AS abs_r FROM hh" for c in _RANKED)
          + ") t ORDER BY abs_r DESC, variable LIMIT 5")
def g15_rank_first(spark, sf_dir):
    corr = tb.corr_matrix(fx.hh(spark, sf_dir), _RANKED + [Y])
    t = corr.filter((F.col("var2") == Y) & (F.col("var1") != Y)) \
        .select(F.col("var1").alias("variable"), F.abs("r").alias("abs_r"))
    return r4(tb.rank_first(t, "abs_r", "variable", k=5, ascending=False))


@register("g16_melt", with_ctes(HH_RAW, HH) + "SELECT hhid, variable, value FROM (SELECT hhid, "
          + ", ".join(fx.HH_NUMERIC) + " FROM hh) UNPIVOT (value FOR variable IN ("
          + ", ".join(fx.HH_NUMERIC) + "))")
def g16_melt(spark, sf_dir):
    return tb.melt(fx.hh(spark, sf_dir).select("hhid", *fx.HH_NUMERIC), ["hhid"])


LASSO_STEPS = [0.0, 0.02, 0.05, 0.1, 0.2]


@register("g17_parse_step", with_ctes(HH_RAW, HH) + ", z AS (SELECT covar_pop(members, log_income_pc) / "
          "stddev_pop(members) AS z, stddev_pop(members) AS sx FROM hh), "
          "lam AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(LASSO_STEPS))
          + ") t(step, lam)) SELECT CAST(lam.step AS INT) AS step, " + r4s("lam.lam") + ' AS "lambda", '
          + r4s("sign(z.z) * greatest(abs(z.z) - lam.lam, 0) / z.sx") + " AS value FROM lam, z")
def g17_parse_step(spark, sf_dir):
    """Lasso slope path on ``members`` stored wide (s0, s1, ...), melted, step parsed, lambda attached."""
    path = lin.lasso(fx.hh(spark, sf_dir), Y, ["members"], LASSO_STEPS)
    wide = spark.createDataFrame([tuple(float(v) for v in path.coefs[:, 1])],
                                 ", ".join(f"s{i} double" for i in range(len(LASSO_STEPS))))
    lambdas = spark.createDataFrame(list(enumerate(map(float, LASSO_STEPS))), "step int, lambda double")
    long = tb.melt(wide, [], var="name", val="value")
    return r4(tb.parse_step(long, "name", "s", lambdas).select("step", "lambda", "value"))


@register("g18_transpose_row", with_ctes(HH_RAW, HH) + ", s AS (SELECT CAST(count(*) AS DOUBLE) AS n, "
          f"avg({Y}) AS mean_y, stddev_samp({Y}) AS sd_y, min({Y}) AS min_y, max({Y}) AS max_y FROM hh) "
          + " UNION ALL ".join(f"SELECT '{c}' AS name, {r4s(c)} AS value FROM s"
                               for c in ["n", "mean_y", "sd_y", "min_y", "max_y"]))
def g18_transpose_row(spark, sf_dir):
    hh = fx.hh(spark, sf_dir)
    row = hh.agg(F.count("*").alias("n"), F.avg(Y).alias("mean_y"), F.stddev_samp(Y).alias("sd_y"),
                 F.min(Y).alias("min_y"), F.max(Y).alias("max_y"))
    return r4(tb.transpose_row(row))


__all__ = ["hh_split", "split_cte", "HH_SPLIT", "np"]
