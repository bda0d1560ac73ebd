"""Full-pool ridge and stepwise against the plain forms on one matrix."""

import datetime as dt
import os

import numpy as np
import pytest

from sessionloom.operators import pool, solvers


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    n, t = 80, 7
    x = rng.normal(size=(n, t))
    x[1:, 0] += 0.8 * x[:-1, 1] - 0.6 * x[:-1, 2]
    x[1:, 3] += 0.7 * x[:-1, 3]  # its own lag must not be taken
    rows = [(f"T{j}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x[i, j])) for i in range(n) for j in range(t)]
    return spark.createDataFrame(rows, "ticker string, date date, value double"), x


def others(x, j):
    names = [k for k in range(x.shape[1]) if k != j]
    return names, x[:-1, names], x[1:, j]


@pytest.mark.parametrize("blocks", [None, 3])
def test_stepwise_takes_the_whole_pool(panel, blocks):
    df, x = panel
    got = {}
    for r in pool.stepwise_pool(df, blocks=blocks).orderBy("target", "step").collect():
        got.setdefault(r["target"], []).append((r["feature"], r["p_value"]))
    for j in range(x.shape[1]):
        names, a, y = others(x, j)
        want = [(f"T{names[k]}", p) for k, p in solvers.stepwise(a, y)]
        mine = got.get(f"T{j}", [])
        assert [f for f, _ in mine] == [f for f, _ in want]
        assert [p for _, p in mine] == pytest.approx([p for _, p in want], abs=1e-9)
    assert [f for f, _ in got["T0"]][:2] == ["T1", "T2"]


@pytest.mark.parametrize("blocks", [None, 2])
def test_ridge_in_session_space_equals_the_plain_form(panel, blocks):
    df, x = panel
    got = {(r["target"], r["model"]): r for r in pool.ridge_pool(df, top=3, blocks=blocks).collect()}
    assert len(got) == 2 * x.shape[1]
    for j in range(x.shape[1]):
        names, a, y = others(x, j)
        cut = int(len(y) * 0.8)
        p, q = solvers.standardise(a[:cut], a[cut:])
        w = solvers.ridge(p, y[:cut], 1.0)
        r = got[f"T{j}", "ridge"]
        for part, z, key in ((y[:cut], p, "train_r2"), (y[cut:], q, "test_r2")):
            e = part - (w[0] + z @ w[1:])
            assert r[key] == pytest.approx(1 - (e @ e) / ((part - part.mean()) ** 2).sum(), abs=1e-6)
        assert r["features"].split(",") == [f"T{names[k]}" for k in np.argsort(-np.abs(w[1:]))[:3]]


def evidence_of_one(s, uy, yy, n, steps=300):
    """Fixed point of one target from the spectrum of its own Gram matrix."""
    lam = 1.0
    for _ in range(steps):
        gamma, norm = (s / (s + lam)).sum(), (s * uy**2 / (s + lam) ** 2).sum()
        rss = ((lam / (s + lam)) ** 2 * uy**2).sum() + max(yy - (uy**2).sum(), 0.0)
        new = gamma / norm * rss / (n - gamma)
        if abs(new - lam) <= 1e-9 * lam:
            break
        lam = min(max(new, 1e-9), 1e12)
    return lam


def test_shared_spectrum_equals_one_decomposition_per_target():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 30))  # series by sessions
    y = x[3] * 2 + rng.normal(size=30)
    k = x.T @ x
    s, u = np.linalg.eigh(k)
    good = s > 1e-10 * s[-1]
    for j in range(12):
        o = x[j]
        own_s, own_u = np.linalg.eigh(k - np.outer(o, o))
        keep = own_s > 1e-10 * own_s[-1]
        uy = own_u[:, keep].T @ y
        lam = evidence_of_one(own_s[keep], uy, y @ y, 30)
        got = pool.evidence(s[good], (y @ u[:, good])[None], (o @ u[:, good])[None], np.array([y @ y]), 30)
        assert got[0] == pytest.approx(lam, rel=1e-6)
        a, trace = pool.without_own(s[good], (y @ u[:, good])[None], (o @ u[:, good])[None], got)
        fit = (k - np.outer(o, o)) @ (u[:, good] @ a[0])
        assert fit == pytest.approx(own_u[:, keep] @ (own_s[keep] * uy / (own_s[keep] + lam)), abs=1e-6)


def test_missing_returns_count_as_zero_and_cost_no_session(spark, panel):
    df, x = panel
    holes = df.filter("NOT (ticker = 'T1' AND day(date) % 5 = 0)")
    z = x.copy()
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(80)]
    z[[i for i, d in enumerate(days) if d.day % 5 == 0], 1] = 0.0
    got = {r["target"]: (r["feature"], r["r2"]) for r in pool.first_step(holes, blocks=2).collect()}
    assert {r["n"] for r in pool.ridge_pool(holes).collect()} == {79}
    for j in range(7):
        names, a, y = others(z, j)
        r2 = [np.corrcoef(a[:, i], y)[0, 1] ** 2 for i in range(6)]
        assert got[f"T{j}"] == (f"T{names[int(np.argmax(r2))]}", pytest.approx(max(r2)))


def test_more_predictors_than_sessions_and_no_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"T{j}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for j in range(40) for i, v in enumerate(rng.normal(size=25))]
    df = spark.createDataFrame(rows, "ticker string, date date, value double")
    assert pool.ridge_pool(df).count() == 80
    assert pool.stepwise_pool(df, cap=3).groupBy("target").count().filter("count > 3").count() == 0
    assert pool.stepwise_pool(df.limit(0)).count() == 0 and pool.ridge_pool(df.limit(0)).count() == 0


def test_batched_search_takes_the_plain_best_candidate():
    import pandas as pd
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 60))
    x[7] = x[6]  # a tie
    x[9] = 2.0  # no spread
    centred = x - x.mean(axis=1, keepdims=True)
    names = np.array([f"T{i:03d}" for i in range(400)])
    left = []
    for t in range(90):
        chosen, q, r = [], [], centred[t] + 0.3 * centred[6]
        for c in rng.choice(np.arange(100, 400), t % 9, replace=False):
            v = centred[c] - sum(((centred[c] @ u) * u for u in q), np.zeros(60))
            v /= np.sqrt(v @ v)
            q.append(v)
            r = r - (r @ v) * v
            chosen.append(names[c])
        left.append((names[t], r, q, chosen))
    got = pool._best_candidates(pd.DataFrame(left, columns=["target", "r", "q", "chosen"]), pd.DataFrame({"feature": names, "x": list(x)}))
    for (t, r, q, chosen), (_, feature, gain) in zip(left, got.itertuples(index=False)):
        room = (centred**2).sum(axis=1) - sum(((centred @ v) ** 2 for v in q), np.zeros(400))
        ok = (room > 1e-9) & ~np.isin(names, [t, *chosen])
        want = np.where(ok, (centred @ r) ** 2 / np.where(ok, room, 1), -1)
        assert feature == names[int(np.argmax(want.round(12)))] and gain == pytest.approx(want.max(), abs=1e-9)


def test_rounds_store_nothing_and_copies_are_taken_once(spark):
    """Each round stored its targets with residual and basis before, and sent them to every block again."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 24))
    x[1:, 0] += x[:-1, 5] - 0.8 * x[:-1, 9]
    x[:, 17] = x[:, 5]  # a copy: the first by name is taken, the other has nothing left over
    rows = [(f"T{j:02d}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x[i, j])) for i in range(60) for j in range(24)]
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), spark.sparkContext.applicationId)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = {}
    for r in pool.stepwise_pool(spark.createDataFrame(rows, "ticker string, date date, value double"), enter=0.9, cap=8, blocks=3).orderBy("target", "step").collect():
        got.setdefault(r["target"], []).append((r["feature"], r["p_value"]))
    assert len(set(os.listdir(folder)) - before) < 8
    for j in range(24):
        names, a, y = others(x, j)
        want = [(f"T{names[k]:02d}", p) for k, p in solvers.stepwise(a, y, 0.9, 8)]
        assert len(want) == 8 and [f for f, _ in got[f"T{j:02d}"]] == [f for f, _ in want]
        assert [p for _, p in got[f"T{j:02d}"]] == pytest.approx([p for _, p in want], abs=1e-9)


def test_all_rounds_at_once_take_the_plain_best_candidates(monkeypatch):
    rng = np.random.default_rng(15)
    x, y = rng.normal(size=(500, 70)) * rng.uniform(0.01, 100, size=(500, 1)), rng.normal(size=(9, 70))
    x[40] = 2.0  # no spread
    x[20], x[30] = x[20] / np.std(x[20]), x[30] / np.std(x[30])
    y[3] = x[20] + 0.1 * x[30] + 1e-2 * rng.normal(size=70)  # little is left over after two steps
    names = np.array([f"T{i:03d}" for i in range(500)], object)
    monkeypatch.setattr(pool, "CANDIDATES", 64)
    of = pool._Candidates((names[lo: lo + 90], x[lo: lo + 90]) for lo in range(0, 500, 90))
    got = pool._steps_of(names[:9], y, of, 0.05, 6)
    for i in range(9):
        rest = np.flatnonzero(np.arange(500) != i)
        want = [(step, names[rest[k]], p) for step, (k, p) in enumerate(solvers.stepwise(x[rest].T, y[i], 0.05, 6), 1)]
        mine = [(s, f, p) for t, s, f, p in sorted(got, key=lambda r: (r[0], r[1])) if t == names[i]]
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[2] for w in want], abs=1e-8)


def test_blocks_are_large(spark):
    """40 blocks a side before, so that every series travelled 40 times."""
    left = spark.range(40_000).selectExpr("concat('S', id) AS target")
    right = spark.range(40_000).selectExpr("concat('S', id) AS series", "array(1D) AS values")
    out = pool._dealt(left, right, 82, "target", None).applyInPandas(lambda a, b: a[["target"]].head(0), "target string")
    assert "sequence(0, 7" in out._jdf.queryExecution().analyzed().toString()
