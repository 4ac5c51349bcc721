import numpy as np
import pyspark.sql.functions as F
import pytest

from ridgeline.operators import linear as lin
from ridgeline.operators import smooth as sm
from ridgeline.operators.gram import gram

Y = "log_income_pc"


def cox_de_boor(x, lo, hi, inner, degree=3):
    """B-spline columns from the recursion, on equidistant knots that go on outside the range."""
    step = (hi - lo) / (inner + 1)
    t = lo + step * np.arange(-degree, inner + 2 + degree)
    b = ((x[:, None] >= t[None, :-1]) & (x[:, None] < t[None, 1:])).astype(float)
    b[x == hi] = 0
    b[x == hi, degree + inner] = 1
    for d in range(1, degree + 1):
        b = ((x[:, None] - t[None, :-1 - d]) / (d * step) * b[:, :-1] + (t[None, d + 1:] - x[:, None]) / (d * step) * b[:, 1:])
    return b


def test_basis_equals_the_recursion():
    x = np.r_[np.linspace(-2, 7, 101), np.nan]
    b = sm.Basis(-2.0, 7.0, 6)
    assert np.allclose(b.columns(x[:-1]), cox_de_boor(x[:-1], -2, 7, 6), atol=1e-12) and not b.columns(x)[-1].any()
    assert np.allclose(b.columns(np.array([-9.0, 99.0])), b.columns(np.array([-2.0, 7.0])))


def row_boost(cols, y, rounds, nu, df, inner):
    """The same boosting on rows: smoothers as matrices over all rows."""
    f = np.full(len(y), y.mean())
    hats = []
    for x in cols:
        vals = np.unique(x)
        if len(vals) < sm.FEW_VALUES:
            z = (x[:, None] == vals[None, :]).astype(float)
            pen, few = np.eye(len(vals)), len(vals) <= df
        else:
            z = cox_de_boor(x, x.min(), x.max(), inner)
            d = np.diff(np.eye(z.shape[1]), 2, axis=0)
            pen, few = d.T @ d, False
        lo, hi = -8.0, 12.0
        for _ in range(80):
            mid = (lo + hi) / 2
            s = z @ np.linalg.lstsq(z.T @ z + (0.0 if few else 10 ** mid) * pen, z.T, rcond=None)[0]
            lo, hi = (mid, hi) if 2 * np.trace(s) - (s * s.T).sum() > df else (lo, mid)
        hats.append(s)
    path = []
    for _ in range(rounds):
        fits = [s @ (y - f) for s in hats]
        k = int(np.argmin([((y - f - h) ** 2).sum() for h in fits]))
        f = f + nu * fits[k]
        path.append(k)
    return f, path


@pytest.mark.parametrize("rounds", [1, 25])
def test_boosting_equals_rowwise_p_splines(spark, rounds):
    rnd = np.random.default_rng(6)
    n = 240
    a, b, c = rnd.uniform(0, 9, n), rnd.normal(size=n), rnd.integers(0, 3, n).astype(float)
    y = np.sin(a) * 2 + 0.4 * b ** 2 + (c == 1) + rnd.normal(size=n) * 0.2
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))], "id int, a double, b double, c double, y double")
    want, path = row_boost([a, b, c], y, rounds, 0.3, 4.0, 12)
    for d in (df.repartition(7), df.repartition(1)):
        m = sm.smooth_boost(d, "y", ["a", "b", "c"], mstop=rounds, nu=0.3, knots=12)
        got = [r["prediction"] for r in m.transform(df).orderBy("id").collect()]
        assert m.path == ["abc"[k] for k in path] and np.allclose(got, want, atol=1e-6)


def test_odd_rows_of_smooth_terms(spark):
    rows = [(float(i), None if i % 4 else float(i % 9), 1.0, float(i % 5)) for i in range(50)] + [(None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    m = sm.smooth_boost(df, "y", ["a", "b", "c"], mstop=10)
    assert m.transform(df).where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        sm.smooth_boost(df.where("y is null"), "y", ["a"])


def test_lasso_knots_meet_the_conditions(spark, hh):
    x = ["members", "rooms", "head_age", "head_educ", "prov", "washer", "twice"]
    d = hh.withColumn("twice", F.col("rooms") * 2.0 + 1)
    g = gram(d, [*x, Y])
    s = lin.standardized(g.total(), g.shift, g.cols, x, Y)
    lams, knots = lin.lasso_knots(s)
    assert len(lams) >= 7 and (np.diff(lams) < 0).all() and lams[-1] < 1e-9
    for lam, b in [*zip(lams, knots), *[((p + q) / 2, (u + v) / 2) for p, q, u, v in zip(lams, lams[1:], knots, knots[1:])]]:
        r = s.c - s.C @ b
        assert (np.abs(r) <= lam + 1e-9).all() and np.allclose(r[b != 0], lam * np.sign(b[b != 0]), atol=1e-9)
    cd = lin.enet_path(s, 1.0, lams[2:5])[:, 1:] * s.sx
    assert np.allclose(np.abs(cd).sum(1), np.abs(knots[2:5]).sum(1), rtol=1e-4)


def test_lasso_knots_where_predictors_leave():
    rnd = np.random.default_rng(0)
    leaves = 0
    for _ in range(60):
        z = rnd.normal(size=(30, 6)) @ rnd.normal(size=(6, 6))
        z = (z - z.mean(0)) / z.std(0)
        y = rnd.normal(size=30)
        s = lin.Standardized(z.T @ z / 30, z.T @ (y - y.mean()) / 30, np.ones(6), np.zeros(6), 0.0, 30, 1.0)
        lams, knots = lin.lasso_knots(s)
        leaves += sum(((u != 0) & (v == 0)).any() for u, v in zip(knots, knots[1:]))
        assert np.allclose(knots[-1], np.linalg.solve(s.C, s.c), atol=1e-7)
        for lam, b in zip(lams, knots):
            r = s.c - s.C @ b
            assert (np.abs(r) <= lam + 1e-8).all() and np.allclose(r[b != 0], lam * np.sign(b[b != 0]), atol=1e-8)
    assert leaves > 5
