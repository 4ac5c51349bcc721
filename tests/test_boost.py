import itertools

import numpy as np
import pyspark.sql.functions as F

from ridgeline.operators import boost as bo
from ridgeline.operators import ensembles as en

X = ["members", "rooms", "head_age", "head_educ", "prov"]
Y = "log_income_pc"


def shape(m):
    return [[(i, n.feature, n.cut, n.stat.get("left"), n.left, n.right, n.value) for i, n in sorted(t.nodes.items())] for t in m.trees]


def _coder(p, bins, cats=()):
    names = [f"f{i}" for i in range(p)]
    return bo.Coder(names, {n: list(range(bins - 1)) for n in names if n not in cats}, {n: list(range(bins)) for n in cats})


def test_category_split_equals_all_subsets():
    rnd = np.random.default_rng(5)
    coder, spec = _coder(3, 7, ("f1",)), bo.Spec(2, min_child=3, cat_smooth=0.0, cat_l2=0.0)
    for _ in range(25):
        x = rnd.integers(0, 7, (3, 90)).astype(np.uint8)
        g = rnd.integers(-1000, 1000, 90) + 400 * np.isin(x[1], [0, 3, 6])
        nodes = bo.grow_best_first(x, g, 0, spec, 1.0, coder, np.ones(3, bool))
        score = lambda a: g[a].sum() ** 2 / (2 * a.sum())
        best = 0.0
        for f, sets in ((0, [range(k) for k in range(1, 7)]), (1, itertools.chain(*[itertools.combinations(range(7), k) for k in range(1, 7)])),
                        (2, [range(k) for k in range(1, 7)])):
            for left in sets:
                a = np.isin(x[f], list(left))
                if a.sum() >= 3 and (~a).sum() >= 3:
                    best = max(best, score(a) + score(~a) - g.sum() ** 2 / 180)
        assert abs((nodes[0][0] or 0.0) - best) < 1e-6 * max(1.0, best)


def test_best_first_equals_plain_growth():
    rnd = np.random.default_rng(8)
    coder, spec = _coder(4, 9), bo.Spec(9, max_depth=4, min_child=5)
    x = rnd.integers(0, 9, (4, 400)).astype(np.uint8)
    g = (x[0].astype(int) - 4) * 90 * (x[2] > 3) + rnd.integers(-200, 200, 400)
    leaves = {0: (np.arange(400), 0)}
    for made in range(8):  # the largest gain next, every leaf searched anew
        found = []
        for k, (rows, d) in leaves.items():
            if d < 4:
                for f in range(4):
                    for c in range(8):
                        a, b = rows[x[f, rows] <= c], rows[x[f, rows] > c]
                        if len(a) >= 5 and len(b) >= 5:
                            gain = 0.5 * (g[a].sum() ** 2 / len(a) + g[b].sum() ** 2 / len(b) - g[rows].sum() ** 2 / len(rows))
                            found.append((gain, -k, -f, -c, a, b, d))
        gain, k, _, _, a, b, d = max(found, key=lambda t: t[:4])
        del leaves[-k]
        leaves[2 * made + 1], leaves[2 * made + 2] = (a, d + 1), (b, d + 1)
    nodes = bo.grow_best_first(x, g, 0, spec, 1.0, coder, np.ones(4, bool))
    assert sorted((n, s) for gain, _, _, n, s, *_ in nodes if gain is None) == sorted((len(r), int(g[r].sum())) for r, _ in leaves.values())


def test_partitions_local_rows_and_company_do_not_matter(spark, hh):
    specs = [bo.Spec(8, -1, 0.3, min_child=5, subsample=0.8), bo.Spec(0, 3, 0.2, 1.0, min_child=1, colsample=0.6), bo.Spec(20, 4, 0.5, min_child=10)]
    fit = lambda df, sp, **k: [shape(m) for m, _, _ in bo.GridBoost(df, Y, X, "hhid", sp, categorical=["prov"], **k).fit(5)]
    all_ = fit(hh, specs)
    assert fit(hh.repartition(7), specs) == all_
    assert fit(hh, specs, local_rows=60) == all_ and fit(hh.repartition(1), specs, local_rows=400) == all_
    assert [fit(hh, [s])[0] for s in specs] == all_
    assert [len(t) for t in all_[0]] == [15] * 5 and any(n[3] for t in all_[0] for n in t)


def test_transform_equals_expression_and_stages(spark, hh):
    m, _, _ = bo.GridBoost(hh, Y, X, "hhid", [bo.Spec(6, -1, 0.3, min_child=5)], categorical=["prov"]).fit(6)[0]
    both = m.transform(hh).withColumn("e", m.expr())
    assert both.where(F.abs(F.col("e") - F.col("prediction")) > 1e-9).count() == 0
    stages = {r["trees"]: r["rmse"] for r in en.gbm_rounds(m, hh, Y).collect()}
    last = both.agg(F.sqrt(F.avg(F.pow(F.col(Y) - F.col("prediction"), 2)))).first()[0]
    assert len(stages) == 6 and abs(stages[6] - last) < 1e-12 and sorted(stages.values(), reverse=True) == [stages[k] for k in range(1, 7)]


def test_models_stop_on_their_own(spark, hh):
    d = hh.withColumn("_v", F.pmod(F.xxhash64("hhid"), F.lit(4)) == 0)
    specs = [bo.Spec(30, -1, 0.9, min_child=2), bo.Spec(3, -1, 0.05, min_child=20)]
    fast, slow = bo.GridBoost(d, Y, X, "hhid", specs, valid_col="_v").fit(12, patience=2)
    assert len(fast[1]) < 12 == len(slow[1]) and len(fast[0].trees) == fast[2] == len(fast[1]) - 2
    got = fast[0].transform(d.where("_v")).agg(F.sqrt(F.avg(F.pow(F.col(Y) - F.col("prediction"), 2)))).first()[0]
    assert abs(got - min(fast[1])) < 1e-9


def test_train_fraction_holds_back_exactly(spark, hh):
    n = hh.count()
    h = en.held_back(hh, "hhid", 0.736, 3, "_held")
    assert h.where("not _held").count() == int(0.736 * n)
    m, curve = en.gbm(hh, Y, X, "hhid", trees=5, depth=3, train_fraction=0.736, seed=3)
    got = m.transform(h.where("_held")).agg(F.sqrt(F.avg(F.pow(F.col(Y) - F.col("prediction"), 2)))).first()[0]
    assert len(curve) == len(m.trees) == 5 and abs(got - curve[-1]) < 1e-9


def test_odd_rows(spark):
    rows = [(i, float(i % 5), None if i % 7 == 0 else float(i % 3), float(i % 5 == 2) * 3 + (i % 3)) for i in range(60)] + [(99, 1.0, 1.0, None), (None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "k int, a double, c double, y double")
    m, _, _ = bo.GridBoost(df, "y", ["a", "c"], "k", [bo.Spec(8, -1, 0.5, min_child=2)], categorical=["a", "c"]).fit(4)[0]
    new = spark.createDataFrame([(1, 77.0, None), (2, None, None)], "k int, a double, c double")  # an unseen category goes right, as NULL does
    p = m.transform(new).collect()
    assert p[0]["prediction"] == p[1]["prediction"] and m.transform(df).where("prediction is null").count() == 0
    flat, _, _ = bo.GridBoost(df.withColumn("y", F.lit(1.5)), "y", ["a"], "k", [bo.Spec()]).fit(2)[0]
    assert {r["prediction"] for r in flat.transform(df).collect()} == {1.5}
