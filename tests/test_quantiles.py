import re

import numpy as np
import pytest

from basketlens.functions.quantiles import exact_quantiles

QS = {"q0": 0.0, "q1": 0.1, "q37": 0.37, "q50": 0.5, "q9": 0.9, "q99": 0.99, "q100": 1.0}


def values(kind, rng):
    if kind == "fractions":
        return rng.lognormal(0, 2, 3000)
    if kind == "few":
        return rng.integers(0, 5, 1000).astype(float)
    if kind == "one":
        return np.array([3.25])
    if kind == "heavy":                      # one value holds most rows
        return np.concatenate([np.full(2000, 7.5), rng.normal(7.5, 3, 700)])
    return np.array([-1.5, 2.0])


@pytest.mark.parametrize("kind", ["fractions", "few", "one", "heavy", "two"])
@pytest.mark.parametrize("buckets", [2, 16, 128])
def test_bit_equal_to_numpy(spark, kind, buckets):
    x = values(kind, np.random.default_rng(len(kind)))
    row = exact_quantiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v", QS, buckets).first()
    assert [row[k] for k in QS] == [float(np.quantile(x, q)) for q in QS.values()]


def test_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", QS).first().asDict() == dict.fromkeys(QS)


def test_no_task_holds_all_distinct_values(spark):
    df = spark.range(20_000).selectExpr("cast(id as double) / 7 as v")
    out = exact_quantiles(df, "v", {"q": 0.5})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    over_values = [w for w in windows if re.search(r"windowspecdefinition\(bucket#\d+, v#", w)]
    assert over_values                                                   # the running count over values is per range
    assert not [w for w in windows if re.search(r"windowspecdefinition\(v#", w)]
