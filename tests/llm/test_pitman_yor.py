import math
import pathlib
import zlib
from collections import Counter

import numpy as np

from ridgeline.llm import pitman_yor as P
from ridgeline.session import checkpoint_dir


def toks(t):
    return [*(t or "").encode().lower().split(), None]


def test_base_scores(docs, rows, none):
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    c = Counter(w for r in train for w in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2, len(toks(r[1])), sum(c[w] > 0 for w in toks(r[1])), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(r[1])), 6)) for r in rows)
    out = P.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert P.score_texts(none).count() == 0


def test_probabilities_sum_to_one_and_rare_words_score_alike(docs, spark):
    state, samples, _ = P.train(docs.select("text"))
    model = P.predictive(state, samples)
    back = np.stack([np.where(s.customers > 0, s.back(), 1.0) for s in samples])
    known = P.Lookup(model.toArrow(), back, samples[-1].customers > 0)
    unknown = np.array([float(s.root(np.zeros(1), np.zeros(1))[0]) for s in samples])
    for ctx in (256, ord("."), ord("a"), 3):
        rows = np.arange(len(known.c))
        total = (10 ** known.log10(rows, np.full(len(rows), ctx)).astype(float)).sum() + (unknown * back[:, ctx]).mean()
        assert abs(total - 1) < 1e-5
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in P.score_texts(docs).collect()}
    old, P.FREQUENT = P.FREQUENT, 10
    try:
        P.frequent.__defaults__ = (10,)
        few = {(r["doc_id"], r["n_tokens"]): r["score"] for r in P.score_texts(docs).collect()}
    finally:
        P.FREQUENT, P.frequent.__defaults__ = old, (old,)
    assert whole.keys() == few.keys() and all(abs(whole[k] - few[k]) < 1e-5 * abs(whole[k]) for k in whole)


def exact(c, p, other, theta, d):
    """Distribution of the tables of a dish given all else, by summing over seatings."""
    ways = {(1, 1): 1.0}
    state = {1: 1.0}
    for j in range(1, c):
        nxt = Counter()
        for t, w in state.items():
            nxt[t] += w * (j - d * t)
            nxt[t + 1] += w * (theta + d * (other + t)) * p
        state = nxt
    assert ways
    z = sum(state.values())
    return {t: w / z for t, w in state.items()}


def test_seating_follows_the_conditional():
    n = 40_000
    for c, p, other in ((2, 0.05, 10), (5, 0.01, 50), (9, 0.2, 3)):
        key = np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        t = P.seat(np.full(n, c), np.full(n, p), np.full(n, other), 1.0, 0.7, key, 1, candidates=24)
        want = exact(c, p, other, 1.0, 0.7)
        for k, w in want.items():
            assert abs((t == k).mean() - w) < 0.02


def test_large_dishes_cost_few_steps():
    t = P.seat(np.array([10**12]), np.array([1e-6]), np.array([10**6]), 1.0, 0.7, np.array([5], np.uint64), 0)
    assert 1 <= t[0] <= 10**12


def test_model_beats_base_on_held_out_texts(spark):
    out = [r for r in P.op3_pitman_yor(spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_hash_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 62, 5000, np.uint64) >> np.uint64(20))
    index = P.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(1, 1 << 62, 5000, np.uint64), keys)
    assert (index.find(other) == -1).all() and (P.HashIndex(keys[:0]).find(other) == -1).all()


def test_the_word_before_is_the_context(spark):
    # both contexts end in the same byte: only the word before tells what follows
    texts = ["red cat", "sad dog"] * 40 + ["red dog", "sad cat"]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:80] + [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    score = lambda ts: {r["doc_id"]: r["score"] for r in P.score_texts(
        spark.createDataFrame(list(zip(ids, ts)), "doc_id long, text string")).collect()}
    got = score(texts)
    assert got[ids[0]] > got[ids[80]] + 1 and got[ids[1]] > got[ids[81]] + 1


def test_probabilities_after_every_word_sum_to_one(docs, spark):
    m = P.fit(docs.select("text"))
    model = P.predictive(m.state, m.samples).collect()
    weights = {r["u"]: (r["cu"], r["back"]) for r in m.weights().collect()}
    own = {}
    for r in m.counts().collect():
        own.setdefault(r["u"], []).append((r["c"] - m.d2 * r["m"], r["ctx"]))
    assert own.keys() == weights.keys() and sum(c for c, _ in weights.values()) == m.n_tokens == sum(r["c"] for r in model)
    back = np.stack([np.where(s.customers > 0, s.back(), 1.0) for s in m.samples])
    unknown = np.array([float(s.root(np.zeros(1), np.zeros(1))[0]) for s in m.samples])
    for u in sorted(own)[:20]:
        ctx, (cu, b) = own[u][0][1], weights[u]
        after = sum(dict(zip(r["ctx"], r["prob"])).get(ctx, float(np.dot(r["roots"], back[:, ctx])) / len(back)) for r in model) + (unknown * back[:, ctx]).mean()
        assert abs(after - 1) < 1e-9
        assert abs(sum(v for v, _ in own[u]) / (m.theta + cu) + b - 1) < 1e-9


def test_scores_do_not_depend_on_units_and_blocks(docs, monkeypatch):
    def scored():
        got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in P.score_texts(docs).collect()]
        return sorted(got)

    whole = scored()
    monkeypatch.setattr(P, "CHUNK", 300)
    monkeypatch.setattr(P, "BLOCK", 150)
    assert P.fit(docs.select("text")).blocks > 20
    some = scored()
    assert [r[:5] for r in some] == [r[:5] for r in whole]
    assert np.allclose([r[5:] for r in some], [r[5:] for r in whole], rtol=1e-9)


def test_a_row_holds_a_block_and_tables_go_when_they_are_done_with(docs, spark):
    m = P.fit(docs.select("text"))
    assert m.state.count() == m.blocks < 10
    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:")) / "ridgeline-tables"
    before = {p.parent.parent for p in folder.rglob("*.parquet")}
    assert P.score_texts(docs).count() == docs.count()
    # units, contexts and replies stay; dishes and words have done their work
    assert len({p.parent.parent for p in folder.rglob("*.parquet")} - before) <= 3
