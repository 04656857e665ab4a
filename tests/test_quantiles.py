"""Percentiles by search against numpy, with a group that holds over a third of the rows."""

import random

import numpy as np
import pytest
from eventide.operators import quantiles

WANTED = {"a5": ("a", 0.05), "a50": ("a", 0.5), "a95": ("a", 0.95), "b75": ("b", 0.75), "b0": ("b", 0.0), "b100": ("b", 1.0)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    value = {"wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "ties": lambda: float(rng.randint(0, 3)), "one": lambda: 7.0, None: lambda: rng.gauss(0, 1), "gaps": lambda: rng.choice([0.0, 1e-9, 5.0, 1e9]) + rng.random() * 1e-12}
    made = [(k, value[k](), rng.choice([None, float("nan"), rng.random()])) for k in value for _ in range(900 if k == "wide" else 300)]
    return made + [("nulls", None, None)] * 150 + [("few", 1.0, 2.0), ("few", 4.0, None)]


@pytest.mark.parametrize("held", [10**6, 100, 1])
def test_against_numpy(spark, rows, held):
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(7)
    found = {r["k"]: r for r in quantiles.exact_percentiles(df, ["k"], WANTED, held).collect()}
    assert set(found) == {r[0] for r in rows}
    for key, r in found.items():
        for name, (column, share) in WANTED.items():
            v = [x[1] if column == "a" else x[2] for x in rows if x[0] == key]
            v = [x for x in v if x is not None and x == x]
            if not v:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(np.quantile(v, share), rel=1e-12, abs=1e-300), (key, name)


def test_empty(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "k string, a double"), ["k"], {"m": ("a", 0.5)}).collect() == []
