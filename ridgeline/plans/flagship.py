"""Flagship: how well do household attributes predict log per-capita income
on held-out rows?

hh -> full dummies (R11) -> stratified 75/25 split (E1) -> OLS on the
training rows from one GRAM pass (L1, collinear dummies aliased) -> predict
the held-out rows (L3) -> RMSE and squared correlation (G6, G7).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as lin
from ..operators import recode as rc
from ..operators import resampling as rs
from ..operators import tables as tb
from ..session import snapshot
from . import fixtures as fx


def model_frame(spark, sf_dir):
    """hh with full dummies and the split column (the modelling input).

    The coded columns and the split are written once as parquet in the shared
    folder: every model below makes several passes over them, reads the columns it
    needs and pushes the split down.  The dummies are projections of that table.
    """
    coded = snapshot(rs.stratified_split(fx.hh(spark, sf_dir), fx.HH_Y, 0.75, "hhid", seed=7))
    return rc.dummies_full(coded, fx.HH_NOMINAL)


def features(df):
    return [c for c in df.columns if c not in ("hhid", fx.HH_Y, "in_train")]


def flagship(spark, sf_dir):
    d = model_frame(spark, sf_dir)
    x = features(d)
    model = lin.ols(d.filter("in_train"), fx.HH_Y, x)
    scored = model.transform(d)
    return scored.groupBy(F.when(F.col("in_train"), "train").otherwise("test").alias("sample")).agg(
        tb.rmse(scored, "prediction", fx.HH_Y).alias("rmse"),
        tb.r2_corr("prediction", fx.HH_Y).alias("rsquared"),
        F.count("*").alias("n"))
