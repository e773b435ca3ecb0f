"""Selection of ranks against sorting, and distributions at the edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import selection
from barloom.quality import validators


def groups():
    draw = np.random.default_rng(6)
    return {
        "normal": draw.normal(0, 1, 3000), "wide": np.concatenate([10.0 ** draw.uniform(-300, 300, 500), -(10.0 ** draw.uniform(-300, 300, 500))]), "equal": np.full(40, 2.5), "one": np.array([7.0]),
        "zeros": np.array([0.0, -0.0, 0.0, -0.0, 1.0]), "near": 1.0 + np.arange(200) * 2**-52, "ends": np.array([-np.inf, np.inf, 1.0, 2.0, np.inf]), "ties": draw.integers(0, 3, 500).astype(float), "two": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize(("cell", "few"), [(1 << 17, 500_000), (10, 500_000), (0, 0)])
def test_quantiles_equal_sorting(spark, monkeypatch, cell, few):
    monkeypatch.setattr(selection, "CELL_VALUES", cell)
    monkeypatch.setattr(selection, "BROADCAST_RANKS", few)
    made = groups()
    df = spark.createDataFrame(pd.DataFrame([(g, float(x)) for g, v in made.items() for x in v], columns=["g", "value"])).repartition(5)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r for r in selection.quantiles(df, sizes, ["g"], {"low": 0.0, "a": 0.01, "b": 0.25, "c": 0.5, "high": 1.0}).collect()}
    assert got.keys() == made.keys()
    for g, v in made.items():
        with np.errstate(all="ignore"):
            s, at = np.sort(v), [(len(v) - 1) * p for p in (0.0, 0.01, 0.25, 0.5, 1.0)]
            want = [s[int(x)] if s[int(x)] == s[int(np.ceil(x))] else s[int(x)] + (s[int(np.ceil(x))] - s[int(x)]) * (x % 1) for x in at]
        assert np.allclose([got[g].low, got[g].a, got[g].b, got[g].c, got[g].high], want, rtol=1e-12, atol=0, equal_nan=True), g


def test_ranks_are_the_values_themselves(spark, monkeypatch):
    monkeypatch.setattr(selection, "CELL_VALUES", 0)
    v = groups()["wide"]
    df = spark.createDataFrame([(1, float(x)) for x in v], "g int, value double")
    ranks = spark.createDataFrame([(1, k) for k in (0, 1, 499, 500, 998, 999)], "g int, rank long")
    got = {r["rank"]: r["value"] for r in selection.select_ranks(df, ranks, ["g"]).collect()}
    assert got == {k: np.sort(v)[k] for k in got} and len(got) == 6
    assert selection.select_ranks(df, ranks.limit(0), ["g"]).count() == 0


def test_distributions_have_no_window_over_a_column(spark):
    df = spark.createDataFrame([("a", float(k % 7), None if k % 3 else 1.0) for k in range(50)], "pair string, x double, y double")
    made = validators.distributions(df, ["x", "y"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    rows = {r["column"]: r for r in made.collect()}
    assert (rows["x"].n, rows["x"].distinct, rows["x"].median, rows["y"].n, rows["y"].q1, rows["y"].iqr) == (50, 7, 3.0, 17, 1.0, 0.0)
    assert validators.distributions(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("cell", [1 << 17, 2, 0])
def test_distributions_hold_equal_values_once(spark, monkeypatch, cell):
    """What is stored and ordered is one row for each distinct value; figures are those of all rows."""
    monkeypatch.setattr(selection, "CELL_VALUES", cell)
    sizes = {}

    def counted(df, name, write=selection.written):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(selection, "written", counted)
    monkeypatch.setattr(validators, "written", counted)
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.integers(-3, 4, 900) / 7, np.full(100, 40.0), [-0.0, 0.0]])
    df = pd.DataFrame({"pair": "a", "x": x, "same": 1e9 + 0.1})
    rows = {r["column"]: r for r in validators.distributions(spark.createDataFrame(df).repartition(3), ["x", "same"]).collect()}
    got, s = rows["x"], df["x"]
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    want = [1002, s.mean(), s.median(), s.min(), 40.0, s.std(), q1, q3, q3 - q1, (s == 0).sum(), 8, s.skew(), s.kurt(), ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()]
    names = ("n", "mean", "median", "least", "most", "sd", "q1", "q3", "iqr", "zeros", "distinct", "skew", "kurt", "outliers")
    assert np.allclose([got[c] for c in names], want, rtol=1e-9) and got.outliers >= 100
    flat = rows["same"]
    assert (flat["mean"], flat.sd, flat.iqr, flat["distinct"], flat.skew, flat.kurt) == (1e9 + 0.1, 0.0, 0.0, 1, None, None)
    assert sizes["values"] == sizes["keys"] == 9
