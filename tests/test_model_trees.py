import numpy as np
import pyspark.sql.functions as F

from ridgeline.operators import cart as ca
from ridgeline.operators import linear as lin
from ridgeline.operators import model_trees as mt

X = ["members", "rooms", "head_age", "head_educ"]
Y = "log_income_pc"


def frame(spark, n=600):
    u = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(10_000)) / 10_000
    d = spark.range(n).withColumn("a", u(1)).withColumn("b", u(2)).withColumn("c", u(3))
    return d.withColumn("y", F.when(F.col("a") <= 0.5, 2 * F.col("b")).otherwise(9 - 3 * F.col("b")) + u(4) * 0.01)


def test_quick_tree_is_the_tree_of_the_complexity_rule(spark, hh):
    slow = ca.grow_cart(hh, Y, X, cp=0.01, minbucket=7, minsplit=14)
    quick = mt.quick_tree(hh, Y, X, "hhid", 0.01, 7)
    cuts = lambda t: sorted((n.depth, n.feature, n.cut, n.n) for n in t.nodes.values() if not n.is_leaf)
    assert cuts(quick) == cuts(slow)
    means = {round(v.value, 6) for v in quick.nodes.values() if v.is_leaf}
    assert means == {round(slow.nodes[i].value, 6) for i in slow.leaves()}


def test_dropped_terms_follow_the_adjusted_error():
    rnd = np.random.default_rng(2)
    for _ in range(10):
        z = np.c_[np.ones(60), rnd.normal(size=(60, 6))]
        y = z[:, 1] * 3 + rnd.normal(size=60)
        G = np.c_[z, y].T @ np.c_[z, y]
        b, err = mt.dropped_terms(G)
        cols, best = list(range(7)), None
        fit = lambda c: ((y - z[:, c] @ np.linalg.lstsq(z[:, c], y, rcond=None)[0]) ** 2).sum()
        while True:  # the same walk with a least-squares fit for every set
            now = mt.adjusted_error(fit(cols), 60, len(cols))
            options = [(mt.adjusted_error(fit([c for c in cols if c != j]), 60, len(cols) - 1), j) for j in cols[1:]]
            best = now
            if not options or min(options)[0] > now:
                break
            cols.remove(min(options)[1])
        assert set(np.flatnonzero(b)) <= set(cols) and abs(err - best) < 1e-9
        assert np.allclose(b[cols], np.linalg.lstsq(z[:, cols], y, rcond=None)[0])


def test_pruning_keeps_the_split_that_matters(spark):
    d = frame(spark)
    grown = mt.quick_tree(d, "y", ["a", "b", "c"], "id", 0.001, 7)
    m = mt.model_tree(d, "y", ["a", "b", "c"], smoothed=False, pruned=True, tree=grown)
    assert len(grown.leaves()) > len(m.tree.leaves()) >= 2 and m.tree.nodes[m.tree.root].feature == "a"
    r = m.transform(d).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
    assert r < 0.2
    flat = d.withColumn("y", F.col("b") * 2 + F.col("c") + F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)) / 1000)
    t = mt.quick_tree(flat, "y", ["a", "b", "c"], "id", 0.01, 7)
    one = mt.model_tree(flat, "y", ["a", "b", "c"], smoothed=False, pruned=True, tree=t)
    assert len(t.leaves()) > 1 == len(one.tree.leaves()) and np.allclose(one.coefs[one.tree.root], [0.05, 0, 2, 1], atol=0.01)


def test_rules_cover_every_row_in_order(spark):
    d = frame(spark)
    m = mt.model_rules(d, "y", ["a", "b", "c"], "id", cp=0.01, smoothed=False)
    assert len(m.rules) >= 2 and m.rules[-1][0] == [] and sum(n for *_, n in m.rules) == d.count()
    rest = d
    for conditions, b, n in m.rules:
        mine = rest.where(m.holds(conditions))
        assert mine.count() == n
        direct = mine.select(F.avg(mt.linear(m.features, b)).alias("p")).first()[0]
        assert abs(m.transform(mine).agg(F.avg("prediction")).first()[0] - direct) < 1e-9
        rest = rest.where(~m.holds(conditions))
    assert rest.count() == 0
    nulls = spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double")
    assert m.transform(nulls).first()["prediction"] is not None
    one = mt.model_rules(d, "y", ["a", "b", "c"], "id", max_rules=1, smoothed=False, pruned=False)
    ols = lin.ols(d, "y", ["a", "b", "c"])
    assert len(one.rules) == 1 and np.allclose(one.rules[0][1], ols.coef, atol=1e-6)


def test_neighbours_move_the_prediction_by_their_residuals(spark, hh):
    x = [*X, "z"]  # a fine feature, so that distances do not tie
    d = hh.withColumn("z", F.pmod(F.xxhash64("hhid"), F.lit(1_000_003)) / 1000.0).cache()
    m = mt.rule_committee(d, Y, x, committees=2, cp=0.05, key="hhid")
    train, query = d.where("hhid % 3 > 0"), d.where("hhid % 3 = 0")
    plain = {r["hhid"]: r["prediction"] for r in m.transform(query).collect()}
    assert plain == {r["hhid"]: r["prediction"] for r in mt.neighbor_correction(m, train, query, Y, "hhid", x, 0).collect()}
    got = {r["hhid"]: r["prediction"] for r in mt.neighbor_correction(m, train, query, Y, "hhid", x, 4).collect()}
    t = m.transform(train).toPandas()
    mean, sd = t[x].mean().to_numpy(), t[x].std(ddof=0).to_numpy()
    z, res = (t[x].to_numpy(float) - mean) / sd, (t[Y] - t["prediction"]).to_numpy()
    for r in query.collect():
        dist = np.sqrt(((z - (np.array([r[c] for c in x], float) - mean) / sd) ** 2).sum(1))
        assert abs(got[r["hhid"]] - plain[r["hhid"]] - res[np.argsort(dist)[:4]].mean()) < 1e-6


def test_committee_members_push_the_other_way(spark, hh):
    m = mt.rule_committee(hh, Y, X, committees=3, cp=0.02, key="hhid")
    first = m.members[0]
    again = mt.model_tree(hh.withColumn("_t", 2 * F.col(Y) - first.expr()), "_t", X, tree=m.members[1].tree)
    assert all(np.allclose(again.coefs[i], m.members[1].coefs[i], atol=1e-8) for i in again.coefs)
    mean = sum((q.expr() for q in m.members), F.lit(0.0)) / 3
    assert m.transform(hh).where(F.abs(mean - F.col("prediction")) > 1e-9).count() == 0


def test_node_grams_are_those_of_the_rows_on_the_path(spark, hh):
    t = mt.quick_tree(hh, Y, X, "hhid", 0.005, 7)
    g = mt.node_grams(t, hh, Y, X)
    assert {i for i, in g.mats} == set(t.nodes) and len(t.nodes) > 3
    d = hh.select(*X, Y, t.path_expr().alias("path")).toPandas().dropna()
    for (i,), G in g.mats.items():
        mine = d[[i in p for p in d["path"]]]
        z = np.c_[np.ones(len(mine)), mine[X + [Y]].to_numpy(float) - g.shift]
        assert np.allclose(G, z.T @ z)


def test_option_sets_share_trees_and_give_the_same_rules(spark, monkeypatch):
    d = frame(spark)
    grown = []
    plain = mt.quick_tree
    monkeypatch.setattr(mt, "quick_tree", lambda *a, **k: grown.append(a[0].count()) or plain(*a, **k))
    growth, alone, shared = mt.Growth(d, "y", ["a", "b", "c"], "id", 0.01, 7), [], []
    for pruned in (True, False):
        for smoothed in (True, False):
            opt = {"cp": 0.01, "pruned": pruned, "smoothed": smoothed}
            shared.append(mt.model_rules(d, "y", ["a", "b", "c"], "id", growth=growth, **opt))
    n, rests = len(grown), len(set(grown))
    assert n == len(growth.held) and rests <= n
    for pruned in (True, False):
        for smoothed in (True, False):
            alone.append(mt.model_rules(d, "y", ["a", "b", "c"], "id", cp=0.01, pruned=pruned, smoothed=smoothed))
    assert len(grown) - n == sum(len(m.rules) for m in alone) > n
    for a, b in zip(shared, alone):
        assert [list(c) for c, *_ in a.rules] == [list(c) for c, *_ in b.rules]
        assert all(np.allclose(p, q) and k == j for (_, p, k), (_, q, j) in zip(a.rules, b.rules))
