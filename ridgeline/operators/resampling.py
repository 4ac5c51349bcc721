"""Splits, folds, bootstrap draws and parameter grids.

Every draw is a hash of ``(seed, row key[, repeat])`` (see
``functions.hashing``), so a split is a column expression: no RNG state, no
row positions, identical on any partitioning and on task retry.  The exact
stratified split needs per-stratum order statistics; those come from the
histogram-refinement selection in ``quantiles`` rather than a global sort.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import BOOTSTRAP_DRAWS, SPLIT_BREAKS
from ..functions.hashing import hash_uniform, poisson_weight
from ..session import snapshot
from .quantiles import group_stats, kth_values, quantiles


def _lookup(pairs, key: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))[key]


def strata_expr(df: DataFrame, y: str, breaks: int = SPLIT_BREAKS) -> Column:
    """Outcome-quantile group: ``breaks`` points incl. min and max.

    Intervals are right-closed with the lowest included, so the stratum is
    the number of interior cut points strictly below ``y``.
    """
    probs = [i / (breaks - 1) for i in range(1, breaks - 1)]
    cuts = sorted(set(quantiles(df, y, probs)[()]))
    s = F.lit(0)
    for c in cuts:
        s = s + (F.col(y) > F.lit(c)).cast("int")
    return s.cast("int")


def outcome_strata(df: DataFrame, y: str, breaks: int = SPLIT_BREAKS, out: str = "_stratum") -> DataFrame:
    return df.withColumn(out, strata_expr(df, y, breaks))


def stratified_split(df: DataFrame, y: str, p: float, key: str, seed: int = 1,
                     breaks: int = SPLIT_BREAKS, out: str = "in_train") -> DataFrame:
    """Exactly ``ceil(p * n_s)`` rows of each outcome stratum ``s``.

    Rows are taken in ``(hash_uniform(seed, key), key)`` order inside each
    stratum.  The cut is located by exact selection (a few aggregate passes
    over a persisted two-column projection); ties on the hash are resolved by
    a second selection on the key.  The result is one projection of ``df``
    (a boolean column from map literals) -- no join back.
    """
    narrow = df.select(key, y).filter(F.col(y).isNotNull()).persist()
    try:
        strat = strata_expr(narrow, y, breaks)
        u = hash_uniform(seed, key)
        d = narrow.select(key, strat.alias("_stratum"), u.alias("_u"))
        stats = group_stats(d, "_u", ["_stratum"])           # (min, max, n) per stratum, one job
        need = {g[0]: math.ceil(v[2] * p) for g, v in stats.items()}
        targets = {(g,): [k - 1] for g, k in need.items() if k > 0}
        cut = kth_values(d, "_u", targets, by=["_stratum"],
                         stats={(g,): stats[(g,)] for g in need if need[g] > 0}) if targets else {}
        t_u = {g: cut[((g,), need[g] - 1)][0] for g in need if need[g] > 0}
        m = {g: need[g] - cut[((g,), need[g] - 1)][1] for g in t_u}
        t_key = {}
        if t_u:
            tie_rows = d.filter(F.col("_u") == _lookup(t_u.items(), F.col("_stratum")))
            ties = {r["_stratum"]: (r["c"], r["k"]) for r in
                    tie_rows.groupBy("_stratum").agg(F.count("*").alias("c"), F.min(key).alias("k")).collect()}
            if all(ties[g][0] == 1 for g in t_u):   # the usual case: no hash collision at the cut
                t_key = {g: ties[g][1] for g in t_u}
            else:
                tk = kth_values(tie_rows, key, {(g,): [m[g] - 1] for g in t_u}, by=["_stratum"])
                t_key = {g: tk[((g,), m[g] - 1)][0] for g in t_u}
    finally:
        narrow.unpersist()
    if not t_u:
        return df.withColumn(out, F.lit(False))
    tu, tkey = _lookup(t_u.items(), strat), _lookup(t_key.items(), strat)
    chosen = (u < tu) | ((u == tu) & (F.col(key) <= tkey))
    return df.withColumn(out, F.coalesce(chosen, F.lit(False)))


def complement(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` not in ``part`` (anti join on the key)."""
    return df.join(part.select(key), on=key, how="left_anti")


def train_valid_test(df: DataFrame, y: str, p_train: float, p_valid: float, key: str,
                     seed: int = 1, breaks: int = SPLIT_BREAKS) -> DataFrame:
    """``in_train`` split, then ``in_valid`` carved from the training rows."""
    # written once: both selections and both sides of the join read it
    d = snapshot(stratified_split(snapshot(df), y, p_train, key, seed, breaks, "in_train"))
    train = d.filter("in_train")
    v = stratified_split(train, y, p_valid, key, seed + 1, breaks, "in_valid").select(key, "in_valid")
    return d.join(v, on=key, how="left").withColumn("in_valid", F.coalesce("in_valid", F.lit(False)))


def kfold(df: DataFrame, k: int, key: str, seed: int = 1, out: str = "fold") -> DataFrame:
    """Fold 0..k-1 from the hashed uniform."""
    return df.withColumn(out, F.floor(hash_uniform(seed, key) * F.lit(k)).cast("int"))


def repeated_kfold(df: DataFrame, k: int, repeats: int, key: str, seed: int = 1) -> DataFrame:
    """E5: long form ``(..., rep, fold)``; each repeat hashes the key again."""
    return (df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
            .withColumn("fold", F.floor(hash_uniform(seed, key, F.col("rep")) * F.lit(k)).cast("int")))


def bootstrap(df: DataFrame, key: str, draws: int = BOOTSTRAP_DRAWS, seed: int = 1) -> DataFrame:
    """Long form ``(..., draw, weight)``; weight ~ Poisson(1), 0 = out of bag.

    A Poisson(1) count per (row, draw) is the distributed form of drawing n
    rows with replacement; no row positions or global sample are needed.
    """
    return (df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
            .withColumn("weight", poisson_weight(hash_uniform(seed, key, F.col("draw")))))


def expand_grid(df: DataFrame, axes: dict[str, Column | list]) -> DataFrame:
    """Cartesian grid of array-valued axes on a (small) frame, by explode.

    ``axes`` values may be array Columns computed from data or Python lists.
    """
    out = df
    for name, values in axes.items():
        arr = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        out = out.withColumn(name, F.explode(arr))
    return out


def log_grid(lo: Column | float, hi: Column | float, n: int) -> Column:
    """``10^x`` for ``n`` evenly spaced x in [lo, hi] (array column)."""
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    step = (hi - lo) / F.lit(float(max(n - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), lo + i * step))


def random_design(bounds: DataFrame, space: dict[str, tuple], n: int, seed: int = 1) -> DataFrame:
    """``n`` uniform points in a typed box.

    ``space = {name: ("int"|"num", lo, hi)}``; bounds may be literals or
    column names of the one-row ``bounds`` frame (e.g. derived from data).
    Integer draws are uniform on ``lo..hi`` inclusive.
    """
    d = bounds.withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(n))))
    cols = {}
    for name, (kind, lo, hi) in space.items():
        lo_c = F.col(lo) if isinstance(lo, str) else F.lit(lo)
        hi_c = F.col(hi) if isinstance(hi, str) else F.lit(hi)
        u = hash_uniform(seed, F.lit(name), F.col("point"))
        if kind == "int":
            cols[name] = F.least(hi_c, F.floor(lo_c + u * (hi_c - lo_c + F.lit(1)))).cast("int")
        else:
            cols[name] = (lo_c + u * (hi_c - lo_c)).cast("double")
    return d.select("point", *[v.alias(k) for k, v in cols.items()])
