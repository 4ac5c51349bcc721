"""Exact order statistics without sorting or gathering a column.

``percentile`` in Spark keeps every distinct value of a group in one task,
which does not survive a 100 TB column.  Here the k-th smallest value is
found by histogram refinement: each pass is one ``groupBy(target, bin)``
aggregate (map-side combined, output = targets x bins rows) that narrows the
value interval holding rank k.  Once the interval holds at most
``max_collect`` rows, those few values are read and the rank is picked.
Work per pass is one scan; a handful of passes converge for any data, and
the driver never sees more than ``targets x bins`` counts or ``max_collect``
values.  Quantiles use the same interpolation as R's default type 7 and
SQL ``quantile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
MAX_COLLECT = 50_000
MAX_TARGETS = 10_000


def _key_tuple(row, by):
    return tuple(row[b] for b in by)


def group_stats(df: DataFrame, col: str, by: list[str] = ()) -> dict:
    """``{group: (min, max, n)}`` of the non-NULL values (one aggregate)."""
    by = list(by)
    rows = (df.filter(F.col(col).isNotNull()).groupBy(*by)
            .agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("n"))
            .limit(MAX_TARGETS + 1).collect())
    if len(rows) > MAX_TARGETS:
        raise ValueError("too many groups for order statistics")
    return {_key_tuple(r, by): (r["lo"], r["hi"], r["n"]) for r in rows}


def kth_values(df: DataFrame, col: str, targets: dict, by: list[str] = (),
               max_collect: int = MAX_COLLECT, bins: int = BINS, stats: dict | None = None) -> dict:
    """Value at 0-based rank ``k`` of ``col`` per group.

    ``targets`` maps a group-key tuple to a list of ranks.  Returns
    ``{(group, k): (value, n_less)}`` where ``n_less`` counts values strictly
    below the answer.  NULLs are ignored.
    """
    by = list(by)
    spark = df.sparkSession
    if not by:  # one global group: a constant key keeps the target join an equi-join
        df = df.withColumn("_g", F.lit(0))
        by = ["_g"]
        targets = {(0,): ks for ks in targets.values()}
        wrap = True
    else:
        wrap = False
    base = df.select(*by, F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    # state: target id -> [group, k, lo, hi, rank_in_interval, n_below_lo]
    state = {}
    items = [(g, k) for g, ks in targets.items() for k in ks]
    if len(items) > MAX_TARGETS:
        raise ValueError("too many order-statistic targets")
    if stats is not None:
        bounds = {((0,) if wrap else g): v for g, v in stats.items()}
    else:
        bounds = group_stats(base, "_v", by)
    result = {}
    for tid, (g, k) in enumerate(items):
        lo, hi, n = bounds[tuple(g)]
        if not 0 <= k < n:
            raise ValueError(f"rank {k} outside 0..{n - 1}")
        state[tid] = [tuple(g), k, lo, hi, k, 0, n]
    tschema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                        + ["_tid int", "_lo double", "_hi double"])
    while state:
        # targets whose interval is one value, or small enough to read, finish now
        small = {t: st for t, st in state.items() if st[2] == st[3] or st[6] <= max_collect}
        to_read = {t: st for t, st in small.items() if st[2] != st[3]}
        for t, st in small.items():
            if st[2] == st[3]:
                result[(st[0], st[1])] = (st[2], st[5])
        if to_read:
            rows = [(*st[0], t, float(st[2]), float(st[3])) for t, st in to_read.items()]
            tdf = F.broadcast(spark.createDataFrame(rows, tschema))
            got = (base.join(tdf, on=by, how="inner")
                   .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                   .select("_tid", "_v")
                   .limit(max_collect * len(to_read) + 1).collect())
            vals: dict = {}
            for r in got:
                vals.setdefault(r["_tid"], []).append(r["_v"])
            for t, st in to_read.items():
                v_sorted = sorted(vals[t])
                v = v_sorted[st[4]]
                result[(st[0], st[1])] = (v, st[5] + sum(1 for x in v_sorted if x < v))
        for t in small:
            del state[t]
        if not state:
            break
        trows = [(*st[0], t, float(st[2]), float(st[3])) for t, st in state.items()]
        tdf = F.broadcast(spark.createDataFrame(trows, tschema))
        joined = base.join(tdf, on=by, how="inner")
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
        binned = (joined.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                  .withColumn("_b", F.least(F.lit(bins - 1),
                                            F.floor((F.col("_v") - F.col("_lo")) / width).cast("int"))))
        hist = (binned.groupBy("_tid", "_b")
                .agg(F.count("*").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
                .collect())
        per = {}
        for h in hist:
            per.setdefault(h["_tid"], []).append((h["_b"], h["c"], h["mn"], h["mx"]))
        for t, st in list(state.items()):
            acc = 0
            for b, c, mn, mx in sorted(per[t]):
                if acc + c > st[4]:
                    st[2], st[3] = mn, mx
                    st[5] += acc
                    st[4] -= acc
                    st[6] = c
                    break
                acc += c
    if wrap:
        return {((), k): v for (g, k), v in result.items()}
    return result


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] = (),
              max_collect: int = MAX_COLLECT) -> dict:
    """``{group: [q(p) for p in probs]}`` with linear interpolation (type 7)."""
    by = list(by)
    stats = group_stats(df, col, by)
    counts = {g: v[2] for g, v in stats.items()}
    targets = {}
    plan = {}
    for g, n in counts.items():
        ks = set()
        for p in probs:
            h = (n - 1) * p
            lo = int(math.floor(h))
            hi = min(lo + 1, n - 1)
            ks.update([lo, hi])
            plan[(g, p)] = (lo, hi, h - lo)
        targets[g] = sorted(ks)
    vals = kth_values(df, col, targets, by, max_collect, stats=stats)
    out = {}
    for g in counts:
        qs = []
        for p in probs:
            lo, hi, frac = plan[(g, p)]
            a, b = vals[(g, lo)][0], vals[(g, hi)][0]
            qs.append(a + frac * (b - a))
        out[g] = qs
    return out
