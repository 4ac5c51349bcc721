"""Aggregation, profiling, ranking and reshaping.

Row-level work is always a Spark aggregate with map-side combine; windows
only ever run over result tables (one row per grid point, per variable or
per coefficient), never over data rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import CORRELATION_CUTOFF, NZV_FREQ_CUT, NZV_UNIQUE_CUT
from .gram import correlations, gram


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """G1: rows per value (NULL is its own value)."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def prediction_table(pred: DataFrame, col: str = "prediction") -> DataFrame:
    """Rows per distinct predicted value (for a tree: the leaf sizes)."""
    return pred.groupBy(col).agg(F.count("*").alias("n"))


def _stack(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("s")).select("s.*")


def near_zero_variance(df: DataFrame, cols: list[str], freq_cut: float = NZV_FREQ_CUT,
                       unique_cut: float = NZV_UNIQUE_CUT) -> DataFrame:
    """Frequency ratio, percent unique, zero-variance and nzv flags per column.

    Value counts come from one ``groupBy(variable, value)``, a second aggregate
    counts the counts, and the top two of these are read per variable (no window over values,
    so a high-cardinality column never lands in one task).
    """
    n = df.count()
    counts = _stack(df, cols).filter(F.col("value").isNotNull()) \
        .groupBy("variable", "value").agg(F.count("*").alias("c"))
    # how many values share a count: at most sqrt(2 n) rows per column, whatever its cardinality
    per = counts.groupBy("variable", "c").agg(F.count("*").alias("k"))
    whole = Window.partitionBy("variable")
    down = whole.orderBy(F.col("c").desc())
    r = per.select("variable", F.col("c").alias("top1"), F.col("k").alias("n_top"), F.lead("c").over(down).alias("below"),
                   F.sum("k").over(whole).alias("n_unique"), F.row_number().over(down).alias("_r")).filter("_r = 1")
    sec = F.when(F.col("n_top") > 1, F.col("top1")).otherwise(F.col("below"))
    freq_ratio = F.when(F.col("n_unique") <= 1, F.lit(0.0)).otherwise(F.col("top1").cast("double") / sec)
    pct = F.lit(100.0) * F.col("n_unique").cast("double") / F.lit(float(n))
    out = r.select("variable", freq_ratio.alias("freq_ratio"), pct.alias("percent_unique"),
                   (F.col("n_unique") <= 1).alias("zero_var"))
    return out.withColumn("nzv", ((F.col("freq_ratio") > F.lit(freq_cut))
                                  & (F.col("percent_unique") <= F.lit(unique_cut))) | F.col("zero_var"))


def drop_near_zero(df: DataFrame, screen: DataFrame) -> DataFrame:
    """Drop the columns flagged ``nzv`` (the screen has one row per column)."""
    flagged = [r["variable"] for r in screen.filter("nzv").select("variable").collect()]
    return df.drop(*flagged)


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long ``(var1, var2, r)`` Pearson correlations from one GRAM pass."""
    g = gram(df, cols)
    R = correlations(g.total())
    rows = [(a, b, None if not np.isfinite(R[i, j]) else float(R[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, r double")


def drop_correlated(corr: DataFrame, cutoff: float = CORRELATION_CUTOFF) -> list[str]:
    """For each pair over the cut-off drop the one with the larger mean |r|.

    Columns are visited by falling mean |r|; after every removal the means are
    taken again over the columns that are left.  Ties keep the column named first.
    Runs on the p x p correlation table (bounded by the GRAM column cap).
    """
    rows = corr.collect()
    names = sorted({r["var1"] for r in rows}, key=[r["var1"] for r in rows].index)
    idx = {v: i for i, v in enumerate(names)}
    R = np.zeros((len(names), len(names)))
    for r in rows:
        R[idx[r["var1"]], idx[r["var2"]]] = abs(r["r"]) if r["r"] is not None else 0.0
    np.fill_diagonal(R, 0.0)
    left = list(range(len(names)))

    def mean(i):
        return R[i, left].sum() / max(1, len(left) - 1)

    for i in sorted(left, key=lambda k: (-mean(k), k)):
        for j in [k for k in left if k != i]:
            if i not in left:
                break
            if R[i, j] > cutoff:
                left.remove(max(i, j, key=lambda k: (mean(k), k)))
    return [names[i] for i in range(len(names)) if i not in left]


def rmse(pred: DataFrame, p: str = "prediction", y: str = "label", weight: str | None = None) -> Column:
    """G6 aggregate expression: sqrt(mean((y - p)^2))."""
    if weight:
        return F.sqrt(F.sum(F.col(weight) * F.pow(F.col(y) - F.col(p), 2)) / F.sum(weight))
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def r2_corr(p: str = "prediction", y: str = "label") -> Column:
    """G7 aggregate expression: squared Pearson correlation of prediction and outcome."""
    return F.pow(F.corr(F.col(p), F.col(y)), 2)


def score(pred: DataFrame, p: str = "prediction", y: str = "label") -> DataFrame:
    """G6 + G7 in one aggregate: one row (rmse, rsquared, n)."""
    return pred.agg(rmse(pred, p, y).alias("rmse"), r2_corr(p, y).alias("rsquared"),
                    F.count("*").alias("n"))


def cv_summary(fold_metrics: DataFrame, params: list[str], metric: str = "rmse") -> DataFrame:
    """Mean and sample sd of the fold metric per grid point."""
    return fold_metrics.groupBy(*params).agg(F.avg(metric).alias(metric),
                                             F.stddev_samp(metric).alias(f"{metric}_sd"))


def best_row(df: DataFrame, metric: str, tiebreak: list[str] = ()) -> DataFrame:
    """The row with the smallest metric (ties by ``tiebreak``)."""
    return df.orderBy(F.col(metric).asc(), *[F.col(c).asc() for c in tiebreak]).limit(1)


def one_se_band(results: DataFrame, num: int, metric: str = "rmse") -> DataFrame:
    """Metric +/- sd / sqrt(num) per grid point (num = folds x repeats)."""
    half = F.col(f"{metric}_sd") / F.lit(math.sqrt(num))
    return results.withColumn("lower", F.col(metric) - half).withColumn("upper", F.col(metric) + half)


def one_se_choice(results: DataFrame, complexity: str, num: int, metric: str = "rmse",
                  simpler_is_larger: bool = True) -> DataFrame:
    """Simplest grid point whose metric is within one SE of the best.

    ``simpler_is_larger``: e.g. a larger cp is a smaller tree.
    """
    best = results.orderBy(F.col(metric).asc(), F.col(complexity).desc() if simpler_is_larger
                           else F.col(complexity).asc()).limit(1) \
        .select((F.col(metric) + F.col(f"{metric}_sd") / F.lit(math.sqrt(num))).alias("_limit"),
                F.lit(1).alias("_k"))
    ok = results.withColumn("_k", F.lit(1)).join(best, "_k").filter(F.col(metric) <= F.col("_limit"))
    order = F.col(complexity).desc() if simpler_is_larger else F.col(complexity).asc()
    return ok.orderBy(order).limit(1).drop("_k", "_limit")


def compare_rmse(spark: SparkSession, model: str, cv_rmse: float | None, cv_sd: float | None,
                 train_pred: DataFrame, test_pred: DataFrame, y: str, p: str = "prediction",
                 seconds: float | None = None, size_mb: float | None = None) -> DataFrame:
    """One comparison row (CV RMSE, its sd, training and test RMSE)."""
    tr = train_pred.agg(rmse(train_pred, p, y).alias("r")).first()["r"]
    te = test_pred.agg(rmse(test_pred, p, y).alias("r")).first()["r"]
    return spark.createDataFrame(
        [(model, cv_rmse, cv_sd, float(tr), float(te), seconds, size_mb)],
        "model string, cv_rmse double, cv_rmse_sd double, train_rmse double, test_rmse double, "
        "seconds double, size_mb double")


def compare_models(rows: list[DataFrame]) -> DataFrame:
    """Stack comparison rows."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def top_k(df: DataFrame, by: str, k: int, tiebreak: list[str] = ()) -> DataFrame:
    """Largest ``k`` by ``by`` (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tiebreak]).limit(k)


def rank_first(df: DataFrame, by: str, key: str, k: int = 20, ascending: bool = True) -> DataFrame:
    """Unique rank (ties by key) on a small result table, first ``k``.

    Only meant for result tables (one row per variable); the top-k is cut
    first so the ranking window sees at most ``k`` rows.
    """
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col(key).asc()]
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None,
         var: str = "variable", val: str = "value") -> DataFrame:
    """Wide to long."""
    values = values or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, values, var, val)


def parse_step(df: DataFrame, col: str, prefix: str, lambdas: DataFrame | None = None) -> DataFrame:
    """Strip a prefix (``s12`` -> 12), cast, attach lambda by step."""
    d = df.withColumn("step", F.regexp_replace(F.col(col), f"^{prefix}", "").cast("int"))
    if lambdas is not None:
        d = d.join(lambdas, on="step", how="left")
    return d


def transpose_row(df: DataFrame, cast: str = "double") -> DataFrame:
    """A one-row table to ``(name, value)`` rows."""
    d = df.select(*[F.col(c).cast(cast).alias(c) for c in df.columns])
    return d.unpivot([], d.columns, "name", "value")


def nonzero(coefs: DataFrame, value: str = "value") -> DataFrame:
    """Coefficients that survive shrinkage."""
    return coefs.filter((F.col(value) != 0) & F.col(value).isNotNull())


def pred_vs_actual(pred: DataFrame, y: str, p: str = "prediction", key: str | None = None) -> DataFrame:
    """(actual, predicted) pairs behind the scatter plot."""
    cols = ([key] if key else []) + [F.col(y).alias("actual"), F.col(p).alias("predicted")]
    return pred.select(*cols)
