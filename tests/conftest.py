import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from larkspur.session import build_session
    return build_session("4", "tests")


@pytest.fixture(scope="session")
def t(spark):
    from larkspur.sources.tables import Tables
    return Tables(spark, SF)


@pytest.fixture
def small_groups(spark):
    """Force the split paths: no task may hold more than a handful of rows of one group."""
    spark.conf.set("spark.larkspur.maxGroupRows", "8")
    spark.conf.set("spark.larkspur.blockRows", "64")
    yield
    spark.conf.unset("spark.larkspur.maxGroupRows")
    spark.conf.unset("spark.larkspur.blockRows")
