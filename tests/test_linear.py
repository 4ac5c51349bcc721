import numpy as np
import pyspark.sql.functions as F
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from ridgeline.operators import linear as lin
from ridgeline.operators import resampling as rs
from ridgeline.operators.gram import gram

X = ["members", "rooms", "head_age", "head_educ"]
Y = "log_income_pc"


def test_ols_matches_numpy_and_mllib(spark, hh, hh_pd):
    m = lin.ols(hh, Y, X)
    A = np.column_stack([np.ones(len(hh_pd)), hh_pd[X].to_numpy(float)])
    beta = np.linalg.lstsq(A, hh_pd[Y].to_numpy(), rcond=None)[0]
    assert np.allclose(m.coef, beta, atol=1e-8)
    lr = LinearRegression(featuresCol="f", labelCol=Y, solver="normal", regParam=0.0).fit(
        VectorAssembler(inputCols=X, outputCol="f").transform(hh))
    assert np.allclose(m.coef[1:], lr.coefficients.toArray(), atol=1e-7)
    assert abs(m.coef[0] - lr.intercept) < 1e-7
    summ = lr.summary
    assert np.allclose(m.fit.se[1:], summ.coefficientStandardErrors[:-1], rtol=1e-6)
    assert np.allclose(m.fit.p()[1:], summ.pValues[:-1], atol=1e-6)
    assert abs(m.fit.r2 - summ.r2) < 1e-9 and abs(m.fit.adj_r2 - summ.r2adj) < 1e-9


def test_collinear_dummy_is_aliased(spark, hh):
    d = hh.withColumn("computer_1", (F.col("computer") == 1).cast("int")) \
          .withColumn("computer_2", (F.col("computer") == 2).cast("int"))
    m = lin.ols(d, Y, ["members", "computer_1", "computer_2"])
    assert np.isfinite(m.coef[2]) and np.isnan(m.coef[3])


def test_ridge_zero_is_ols_and_lasso_max_is_zero(spark, hh):
    m = lin.ols(hh, Y, X)
    r = lin.ridge(hh, Y, X, [0.0])
    assert np.allclose(r.coefs[0], m.coef, atol=1e-8)
    lp = lin.lasso(hh, Y, X)
    assert np.allclose(lp.coefs[0, 1:], 0.0)
    assert np.count_nonzero(lp.coefs[-1, 1:]) == len(X)


def test_lasso_kkt(spark, hh):
    p = lin.lasso(hh, Y, X, [0.01])
    s, b = p.s, p.coefs[0, 1:] * p.s.sx
    grad = s.c - s.C @ b
    for j in range(len(X)):
        if b[j] != 0:
            assert abs(grad[j] - 0.01 * np.sign(b[j])) < 1e-5
        else:
            assert abs(grad[j]) <= 0.01 + 1e-6


def test_per_fold_gram_error_equals_scored_error(spark, hh):
    d = rs.kfold(hh, 4, "hhid", seed=2)
    g = gram(d, X + [Y], by=["fold"])
    total = g.total()
    key = g.groups()[0]
    s_tr = lin.standardized(total - g.mats[key], g.shift, g.cols, X, Y)
    coefs = lin.enet_path(s_tr, 0.0, [0.0])
    rss = lin.fold_rss(g.mats[key], coefs, g.shift, g.cols, X, Y)[0]
    model = lin.LinearModel([lin.INTERCEPT] + X, coefs[0])
    held = model.transform(d.filter(F.col("fold") == key[0]))
    want = held.agg(F.sum(F.pow(F.col(Y) - F.col("prediction"), 2))).first()[0]
    assert abs(rss - want) < 1e-6 * max(1.0, want)


def test_stepwise_first_step_is_best_single(spark, hh, hh_pd):
    g = gram(hh, X + [Y])
    first = lin.stepwise(g, X, Y, "forward", nvmax=1)[0][1][0]
    r2 = {c: np.corrcoef(hh_pd[c], hh_pd[Y])[0, 1] ** 2 for c in X}
    assert first == max(r2, key=r2.get)
    back = lin.stepwise(g, X, Y, "backward")
    assert [s for s, _, _ in back] == [1, 2, 3, 4]


def test_gram_is_partition_invariant(spark, hh):
    a = lin.ols(hh.repartition(1), Y, X).coef
    b = lin.ols(hh.repartition(9, "prov"), Y, X).coef
    assert np.allclose(a, b, rtol=0, atol=1e-9)
