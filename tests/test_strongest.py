"""The bounded search for the strongest pairs against all pairs, and how little it computes."""

import numpy as np
import pandas as pd
import pytest

from sessionloom.operators import correlate


def series(rng, n, sessions, name, gappy):
    rows = []
    for i in range(n):
        days = np.arange(sessions - int(rng.integers(0, 2)))
        if rng.random() < gappy:
            days = np.delete(days, rng.integers(0, len(days), int(rng.integers(1, 4))))
        rows.append((f"{name}{i:04d}", days.astype(np.int32), rng.standard_t(4, size=len(days))))
    return pd.DataFrame(rows, columns=["series", "days", "values"])


@pytest.mark.parametrize("n,m,sessions,gappy,top,min_obs", [(200, 500, 82, 0.2, 5, 30), (90, 300, 40, 0.9, 20, 2), (70, 300, 13, 0.3, 3, 10), (20, 2, 82, 0.5, 5, 2)])
@pytest.mark.parametrize("lag", [0, 2])
def test_bounded_search_equals_all_pairs(n, m, sessions, gappy, top, min_obs, lag):
    rng = np.random.default_rng(n + lag)
    left, right = series(rng, n, sessions, "T", gappy), series(rng, m, sessions, "P", gappy)
    left.at[2, "values"] = np.ones(len(left.at[2, "values"]))  # no spread
    right.at[1, "values"] = np.ones(len(right.at[1, "values"]))
    if m > 10:  # a tie goes to the earlier name
        right.at[5, "days"], right.at[5, "values"] = right.at[6, "days"], right.at[6, "values"].copy()
    full = correlate._pair_stats(left, right, lag, None, min_obs)
    full = full[full["corr"].notna()].assign(a=lambda d: -d["corr"].astype(float).abs().round(12))
    want = full.sort_values(["target", "a", "predictor"]).groupby("target").head(top)
    got = correlate._pair_stats(left, right, lag, top, min_obs)
    got = got.assign(a=-got["corr"].astype(float).abs().round(12)).sort_values(["target", "a", "predictor"])
    assert got[["target", "predictor", "n"]].to_numpy().tolist() == want[["target", "predictor", "n"]].to_numpy().tolist()
    np.testing.assert_allclose(got[["corr", "slope", "intercept"]].astype(float), want[["corr", "slope", "intercept"]].astype(float), atol=1e-9)


def test_few_pairs_are_computed_in_full(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = series(rng, 512, 82, "T", 0.05), series(rng, 6000, 82, "P", 0.05)
    done = []
    for name, count in (("_sums", lambda n: n.size), ("_pair_sums", lambda n: len(n))):
        plain = getattr(correlate, name)
        monkeypatch.setattr(correlate, name, lambda *a, plain=plain, count=count: done.append(count((r := plain(*a))[0])) or r)
    correlate._pair_stats(left, right, 1, 5, 30)
    assert sum(done) < 0.2 * 512 * 6000


def test_large_inputs_make_few_blocks(spark):
    """Each series travels once per block of the other side: 40 blocks of 1,024 before, 8 now."""
    p = spark.range(40_000).selectExpr("concat('S', id) AS series", "array(1, 2) AS days", "array(1D, 2D) AS values")
    plan = correlate.packed_correlation(p, p, top=1)._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 7" in plan and "sequence(0, 39" not in plan


def test_a_block_of_targets_meets_all_predictors_and_copies_none(spark):
    """Before, both sides went to disk once for each block of the other, and every pair of blocks sent on its own lists."""
    rng = np.random.default_rng(17)
    left, right = series(rng, 70, 60, "T", 0.4), series(rng, 260, 60, "P", 0.4)
    for i in range(0, 120, 2):  # ties across blocks go to the earlier name
        right.at[i + 130, "days"], right.at[i + 130, "values"] = right.at[i, "days"], right.at[i, "values"].copy()
    full = correlate._pair_stats(left, right, 0, None, 10)
    full = full[full["corr"].notna()].assign(a=lambda d: -d["corr"].astype(float).abs().round(12))
    want = full.sort_values(["target", "a", "predictor"]).groupby("target").head(5)
    a, b = (spark.createDataFrame([(r.series, r.days.tolist(), r.values_.tolist()) for r in d.rename(columns={"values": "values_"}).itertuples()],
                                  "series string, days array<int>, values array<double>") for d in (left, right))
    got = correlate.strongest_packed(a, b, 5, min_obs=10, blocks=6).toPandas()
    assert len(got) == 70 * 5
    got = got.assign(a=-got["corr"].abs().round(12)).sort_values(["target", "a", "predictor"])
    assert got[["target", "predictor", "n"]].to_numpy().tolist() == want[["target", "predictor", "n"]].to_numpy().tolist()
    np.testing.assert_allclose(got[["corr", "slope", "intercept"]].astype(float), want[["corr", "slope", "intercept"]].astype(float), atol=1e-9)
