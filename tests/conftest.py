import os
import sys

import pytest
from sf_dirs import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ridgeline.session import build_session
    s = build_session("local[4]", extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hh(spark):
    from ridgeline.plans import fixtures as fx
    return fx.hh(spark, SF_SMALL).cache()


@pytest.fixture(scope="session")
def hh_pd(hh):
    return hh.toPandas().sort_values("hhid").reset_index(drop=True)
