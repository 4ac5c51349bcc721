"""Deterministic pseudo-random draws keyed by row content, not row position.

Every split, fold, bootstrap weight and random design in the library is a
function of ``(seed, key, ...)`` so that results do not depend on how the
data is partitioned, survive task retries unchanged, and can be reproduced
in plain SQL: ``('0x' || substr(md5('<seed>:<key>'), 1, 8))::bigint / 2^32``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_uniform(seed, *parts) -> Column:
    """Uniform in [0, 1) from md5 of ``seed:part1:part2...``."""
    pieces = [F.lit(f"{seed}")]
    for p in parts:
        pieces += [F.lit(":"), _as_col(p).cast("string")]
    h = F.md5(F.concat(*pieces))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def hash_uniform_sql(seed, *parts: str) -> str:
    """DuckDB text of :func:`hash_uniform` (used by the oracle strings)."""
    body = f"'{seed}'"
    for p in parts:
        body += f" || ':' || CAST({p} AS VARCHAR)"
    return f"(CAST(('0x' || substr(md5({body}), 1, 8)) AS BIGINT) / 4294967296.0)"


def poisson_thresholds(mean: float = 1.0, max_count: int = 12) -> list[float]:
    """Cumulative Poisson probabilities P(X <= k), k = 0..max_count-1."""
    out, term, acc = [], math.exp(-mean), 0.0
    for k in range(max_count):
        acc += term
        out.append(acc)
        term *= mean / (k + 1)
    return out


def poisson_weight(u: Column, mean: float = 1.0, max_count: int = 12) -> Column:
    """Inverse-CDF Poisson(mean) draw from a uniform column (bootstrap weight)."""
    th = poisson_thresholds(mean, max_count)
    expr = F.when(u < F.lit(th[0]), F.lit(0))
    for k, t in enumerate(th[1:], start=1):
        expr = expr.when(u < F.lit(t), F.lit(k))
    return expr.otherwise(F.lit(max_count)).cast("int")


def poisson_weight_sql(u_sql: str, mean: float = 1.0, max_count: int = 12) -> str:
    th = poisson_thresholds(mean, max_count)
    parts = [f"WHEN {u_sql} < {t!r} THEN {k}" for k, t in enumerate(th)]
    return f"CAST(CASE {' '.join(parts)} ELSE {max_count} END AS INTEGER)"
