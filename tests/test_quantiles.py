import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparktab.functions.quantiles import exact_quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def expected(values):
    return list(pd.Series([v for v in values if v is not None]).quantile(SHARES))


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 4.0, 4.0],
        [5.0],
        [0.0] * 60 + [1.0] * 60,
        [7.0] * 80 + np.random.default_rng(1).normal(size=160).tolist(),
        np.random.default_rng(2).exponential(size=500).tolist() + [None, float("nan")],
    ],
    ids=["even", "single", "two-values", "hot-value", "gaps"],
)
def test_narrowing_is_exact(spark, values):
    clean = [None if v is not None and v != v else v for v in values]
    got = exact_quantiles(frame(spark, values), ["x"], SHARES, direct_rows=8, accuracy=20)["x"]
    assert got == pytest.approx(expected(clean), rel=1e-12)


def test_direct_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.5])
    assert got == {"x": [2.0], "y": [None]}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=120))
def test_any_values(spark, values):
    values = [float(v) for v in values]
    got = exact_quantiles(frame(spark, values), ["x"], [0.5], direct_rows=5, accuracy=10)["x"]
    assert got[0] == pytest.approx(float(np.median(values)))
