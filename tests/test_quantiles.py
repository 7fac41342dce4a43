"""Exact quantiles against a sort of all values."""

import re

import duckdb
import numpy as np
import pytest

from tracewell.operators.quantiles import exact_quantiles

SHARES = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}


@pytest.mark.parametrize("ranges", [2, 8, 64])
def test_quantiles_match_a_sort(spark, ranges):
    rng = np.random.default_rng(ranges)
    groups = {
        "ties": np.where(rng.random(3000) < 0.6, 0.0, rng.integers(0, 50, 3000) / 8),
        "apart": rng.lognormal(size=2500),
        "two": np.array([1.0, 3.0]),
        "one": np.array([7.0]),
        "same": np.full(500, 2.5),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("nulls", None), ("one", None), (None, 1.0)]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", SHARES, ranges).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        for name, q in SHARES.items():
            assert got[g][name] == pytest.approx(float(np.quantile(v, q)), abs=1e-12)
            assert got[g][name] == pytest.approx(duckdb.execute("SELECT quantile_cont(x, ?) FROM (SELECT unnest(?) AS x)", [q, v.tolist()]).fetchone()[0], abs=1e-12)


def test_only_wanted_ranges_are_sorted(spark):
    """The window over values stands above the join with the ranges that hold a wanted rank, and is split by range."""
    df = spark.range(100_000).selectExpr("CAST(id % 2 AS string) AS g", "CAST(id DIV 2 AS double) AS x")
    out = exact_quantiles(df, "g", "x", {"p50": 0.5}, 16)
    assert [r["p50"] for r in out.collect()] == [24_999.5, 24_999.5]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window \[sum\(many#\d+L?\) windowspecdefinition\(g#\d+, range#\d+, x#\d+ ASC", plan)


def test_cost_distribution_is_the_same_beyond_one_buffer(spark, small, monkeypatch):
    from tracewell.plans import ask, registered, spend

    store = registered.open_store(spark, small)
    asked = registered.bindings("cost_distribution", store)
    want = ask(store, "cost_distribution", **asked).collect()
    monkeypatch.setattr(spend, "IN_ONE_BUFFER", 0)
    assert ask(store, "cost_distribution", **asked).collect() == want and len(want) == 2
