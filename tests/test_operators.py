"""Operators against plain loops on seeded data, with hot keys and long histories."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.frames import ranged_running
from sessionloom.operators import backtest, correlate, ewm, joins, models, select, sizing, solvers, windows
from sessionloom.operators.aggregates import bars_from_ticks, packed_order, threshold_grid
from sessionloom.sources import maintain, readers


def days(n):
    return [d.date() for d in pd.bdate_range("2000-01-03", periods=n)]


def test_ewm_over_many_chunks(spark):
    rng = np.random.default_rng(1)
    n = 5000
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"ticker": "A", "date": days(n), "x": x})
    pdf.loc[:30, "x"] = np.nan
    pdf.loc[2100:2140, "x"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = ewm.ewm_adjusted(d, "x", 1 / 14, 14, "y").orderBy("date").toPandas()["y"].to_numpy(dtype=float)
    want = pdf["x"].ewm(com=13, min_periods=14).mean().to_numpy()
    assert len(got) == n
    np.testing.assert_allclose(got, want, atol=1e-9)
    clean = spark.createDataFrame(pdf.assign(x=x))
    got = ewm.ewm_recursive(clean, "x", 1 / 14, "y").orderBy("date").toPandas()["y"].to_numpy()
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean(), atol=1e-9)


def test_ranged_running_with_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.random(), i, float(rng.randrange(9))) for i in range(4000)]
    d = spark.createDataFrame(rows, "k string, o double, i long, v double")
    got = ranged_running(d, "k", [F.col("o").desc(), F.col("i")], {"run": F.col("v")}, slices=6).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "o", "i", "v"]).sort_values(["o", "i"], ascending=[False, True])
    pdf["run"] = pdf.groupby("k")["v"].cumsum()
    want = pdf.set_index("i")["run"]
    assert len(got) == 4000 and (got.set_index("i")["run"].sort_index() == want.sort_index()).all()


def test_rank_with_ties(spark):
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(3)}", i, None if i % 50 == 0 else float(rng.randrange(15))) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, i long, v double")
    got = windows.rank_within(d, "v", "k").toPandas().set_index("i")["rank"].sort_index()
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"])
    want = pdf.groupby("k")["v"].rank(method="min", ascending=False, na_option="bottom").astype(int)
    assert (got.to_numpy() == want.to_numpy()).all()


def fold(rows, cash):
    left, out = cash, {}
    for t, price, raw in rows:
        units = math.floor(min(raw, left) / price)
        if units > 0:
            out[t] = units
            left -= units * price
    return out


@pytest.mark.parametrize("seed", range(6))
def test_allocation_equals_sequential_fold(spark, seed):
    rng = random.Random(seed)
    data, want = [], {}
    for p in range(3):
        cash = rng.choice([50.0, 500.0, 5000.0])
        rows = []
        for i in range(rng.choice([3, 60, 150])):
            price = rng.choice([1.0, 7.0, 33.0, 49.0, cash * 0.98, cash * 1.1])
            rows.append((round(1 - i / 400, 6), f"t{i:03d}", price, rng.uniform(0.2, 1.3) * cash * rng.choice([0.02, 0.3, 1.0])))
        for prob, t, price, raw in rows:
            data.append((f"p{p}", -prob, t, price, raw, cash))
        want.update({(f"p{p}", t): u for t, u in fold([(t, price, raw) for _, t, price, raw in rows], cash).items()})
    d = spark.createDataFrame(data, "persona string, neg_p double, ticker string, price double, raw double, cash double")
    for fold_rows in (0, 5, 2048):  # rounds only, both ways by group size, folds only
        got = {(r["persona"], r["ticker"]): int(r["units"]) for r in sizing.allocate(d, keys=["persona"], fold_rows=fold_rows).collect()}
        assert got == want


def test_as_of_against_merge_asof(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")

    def make(n, hot):
        k = np.where(rng.random(n) < hot, "hot", "k" + pd.Series(rng.integers(0, 5, n)).astype(str))
        return pd.DataFrame({"k": k, "t": base + pd.to_timedelta(rng.integers(0, 20 * 86400, n), unit="s")})

    left, right = make(800, 0.5).drop_duplicates(), make(300, 0.5).drop_duplicates()
    left["id"], right["v"] = range(len(left)), rng.normal(size=len(right))
    for strict in (False, True):
        got = joins.as_of(spark.createDataFrame(left), spark.createDataFrame(right.rename(columns={"t": "rt"})), "v", keys="k",
                          left_time="t", right_time="rt", strict=strict).toPandas().set_index("id")["v"].sort_index()
        want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", allow_exact_matches=not strict).set_index("id")["v"].sort_index()
        np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float))


def test_block_correlation_with_gaps(spark):
    rng = np.random.default_rng(6)
    n, names = 90, [f"s{i}" for i in range(13)]
    wide = pd.DataFrame(rng.normal(size=(n, 13)) + 50, columns=names, index=days(n))
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide["s3"] = wide["s3"].where(wide["s3"].isna(), 7.0)  # constant series
    long = wide.rename_axis("date").reset_index().melt("date", var_name="ticker", value_name="value").dropna()
    d = spark.createDataFrame(long)
    full = {(r["target"], r["predictor"]): r for r in correlate.lagged_correlation(d, 1, blocks=3).collect()}
    lagged = {c: wide[c].dropna().shift(1) for c in names}
    for a in names:
        for b in names:
            j = pd.concat([wide[a], lagged[b]], axis=1, keys="xy").dropna()
            r = full[(a, b)]
            assert r["n"] == len(j)
            if "s3" in (a, b):
                assert r["corr"] is None
            else:
                assert r["corr"] == pytest.approx(j["x"].corr(j["y"]), abs=1e-10)
                assert r["slope"] == pytest.approx(np.polyfit(j["y"], j["x"], 1)[0], abs=1e-9)
    top = select.multi_lag(d, (1,), 2, blocks=3).toPandas()
    for a in names:
        if a == "s3":
            continue
        best = sorted(((-abs(full[(a, b)]["corr"]), b) for b in names if b not in (a, "s3")))[:2]
        assert list(top[top.target == a].sort_values("rank")["predictor"]) == [b for _, b in best]


def test_logistic_is_the_penalised_optimum():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3, 120, 4))
    y = (rng.random(120) < 0.5).astype(float)
    w, h = solvers.logistic(x, y, penalty=2.0, prior=[0.1, 0, -0.2, 0], intercept_penalty=1.0, intercept_prior=0.3)
    for i in range(3):
        xx = np.column_stack([np.ones(120), x[i]])
        p = solvers.sigmoid(xx @ w[i])
        grad = xx.T @ (p - y) + np.array([1.0, 2, 2, 2, 2]) * (w[i] - np.array([0.3, 0.1, 0, -0.2, 0]))
        assert np.abs(grad).max() < 1e-7
        assert np.all(np.linalg.eigvalsh(h[i]) > 0)


def test_logistic_on_separable_rows_converges():
    x = np.linspace(-3, 3, 40)[None, :, None] * 50
    w, _ = solvers.logistic(x, (x[0, :, 0] > 0).astype(float))
    assert np.isfinite(w).all() and ((solvers.predict_logistic(w, x)[0] > 0.5) == (x[0, :, 0] > 0)).all()


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.0733880), (1.0, 1, 0.5), (12.706, 1, 0.05), (2.5758, 1e6, 0.0100009), (0.0, 5, 1.0)])
def test_t_p_values(t, df, p):
    assert solvers.t_two_sided(t, df) == pytest.approx(p, abs=2e-5)


def test_stepwise_against_least_squares():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 8))
    y = 2 * x[:, 2] - x[:, 5] + rng.normal(size=150)
    got = solvers.stepwise(x, y)
    assert [j for j, _ in got][:2] == [2, 5]

    def p_of(inc, j):
        a = np.column_stack([np.ones(150), x[:, inc + [j]]])
        b, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
        s2 = rss[0] / (150 - a.shape[1])
        return solvers.t_two_sided(abs(b[-1]) / math.sqrt(s2 * np.linalg.inv(a.T @ a)[-1, -1]), 150 - a.shape[1])

    inc = []
    for j, p in got:
        best = min((p_of(inc, c), c) for c in range(8) if c not in inc)
        assert best[1] == j and best[0] == pytest.approx(p, abs=1e-8)
        inc.append(j)
    assert min(p_of(inc, c) for c in range(8) if c not in inc) >= 0.05


def test_triplets_against_brute_force(spark):
    from itertools import combinations
    rng = np.random.default_rng(9)
    n, names = 70, [f"f{i}" for i in range(9)]
    x, y = rng.normal(size=(n, 9)), rng.normal(size=n)
    rows = [("T", d, f, float(x[i, j])) for i, d in enumerate(days(n)) for j, f in enumerate(names)]
    long = spark.createDataFrame(rows, "target string, date date, feature string, value double")
    t = spark.createDataFrame([("T", d, float(v)) for d, v in zip(days(n), y)], "target string, date date, y double")
    got = models.best_triplets(long, t, 4, chunk=4).orderBy("rank").collect()
    all_ = sorted(((-np.corrcoef(x[:, c].sum(1), y)[0, 1] ** 2, c) for c in map(list, combinations(range(9), 3))))[:4]
    assert [[r["first"], r["second"], r["third"]] for r in got] == [[names[i] for i in c] for _, c in all_]
    assert got[0]["r2"] == pytest.approx(-all_[0][0])


@pytest.mark.parametrize("seed,k", [(1, 25), (2, 60)])
def test_triplet_bounds_lose_nothing_and_skip_pairs(seed, k):
    from itertools import combinations
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(k, 80)) + (seed - 1) * rng.normal(size=80)
    y = x[3] + x[10] + x[17] + 2 * rng.normal(size=80)
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean()
    x[5] = 0.0  # a feature without spread
    c, g, yy = x @ y, x @ x.T, float(y @ y)
    brute = sorted((-(c[i] + c[j] + c[m]) ** 2 / (g[i, i] + g[j, j] + g[m, m] + 2 * (g[i, j] + g[i, m] + g[j, m])) / yy, i, j, m) for i, j, m in combinations(range(k), 3))[:6]
    seeds = sorted((t for lo in range(0, k, 8) for t in solvers.seed_triplets(x, c, yy, range(lo, min(lo + 8, k)), 6)), reverse=True)
    parts = [solvers.best_triplets(x, c, yy, range(lo, min(lo + 8, k)), 6, bound=seeds[5][0], block=16) for lo in range(0, k, 8)]
    found = sorted((t for p in parts for t in p[0]), key=lambda t: (-t[0], *t[1:]))[:6]
    assert [t[1:] for t in found] == [t[1:] for t in brute] and found[0][0] == pytest.approx(-brute[0][0])
    assert sum(p[1] for p in parts) < 0.5 * sum(p[2] for p in parts)


def test_cash_fold_counts_purchases_without_a_list_that_grows(spark):
    n, left, bought = 3000, 1e5, 0
    for i in range(n):
        price, raw = 1.0 + i % 13, 2.0 + i % 97
        pay = math.floor(min(raw, left) / price) * price
        left, bought = left - pay, bought + (pay > 0)
    d = spark.range(n).selectExpr("'p' AS persona", "id AS neg_p", "1.0D + id % 13 AS price", "1e5D AS cash", "2.0D + id % 97 AS raw")
    folded = sizing.fold_cash(d, ["persona"], ["neg_p"], each=False)
    assert dict(folded.dtypes)["acc"] == "struct<left:double,bought:bigint>"
    got, whole = folded.first(), sizing.fold_cash(d, ["persona"], ["neg_p"]).first()
    assert (got["acc"]["left"], got["acc"]["bought"]) == (left, bought)
    assert whole["acc"]["left"] == left and sum(x > 0 for x in whole["acc"]["paid"]) == bought and len(got["rows"]) == n


def test_triplet_bounds_leave_few_pairs_among_weak_features():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(300, 82)), rng.normal(size=82)
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean()
    x[299] = x[7]  # a copy ties with its original
    c, g, yy = x @ y, x @ x.T, float(y @ y)
    seeds = sorted((s for lo in range(0, 300, 30) for s in solvers.seed_triplets(x, c, yy, range(lo, lo + 30), 5)), reverse=True)
    parts = [solvers.best_triplets(x, c, yy, range(lo, lo + 75), 5, bound=seeds[4][0]) for lo in range(0, 300, 75)]
    found = sorted((s for p in parts for s in p[0]), key=lambda s: (-round(s[0], 12), *s[1:]))[:5]
    norm, brute = (x**2).sum(axis=1), []
    for i in range(298):
        j, k = np.triu_indices(299 - i, 1)
        j, k = j + i + 1, k + i + 1
        r2 = (c[i] + c[j] + c[k]) ** 2 / (norm[i] + norm[j] + norm[k] + 2 * (g[i, j] + g[i, k] + g[j, k])) / yy
        brute += [(-round(float(r2[b]), 12), i, int(j[b]), int(k[b])) for b in np.argsort(-r2)[:12]]
    assert [s[1:] for s in found] == [s[1:] for s in sorted(brute)[:5]]
    assert sum(p[1] for p in parts) < 0.05 * sum(p[2] for p in parts)


def test_triplets_with_gaps_and_few_features(spark):
    d = days(40)
    long = [(f, d[i], float((i * p) % 7)) for f, p in (("a", 2), ("b", 3), ("c", 5)) for i in range(40) if (i + p) % 9]
    y = [("T", d[i], float(i % 5)) for i in range(40)] + [("U", d[0], 1.0)]
    t = spark.createDataFrame(y, "target string, date date, y double")
    frame = spark.createDataFrame(long, "feature string, date date, value double")
    got = models.best_triplets(frame, t, 3).collect()
    x = np.array([[dict(((f, dd), v) for f, dd, v in long).get((f, dd), np.nan) for dd in d] for f in "abc"])
    x = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True)).sum(axis=0)
    v = np.array([i % 5 for i in range(40)]) - 2.0
    assert [(r["target"], r["first"], r["second"], r["third"]) for r in got] == [("T", "a", "b", "c")]
    assert got[0]["r2"] == pytest.approx((x @ v) ** 2 / (x @ x) / (v @ v))
    assert models.best_triplets(frame.filter("feature <> 'a'"), t, 3).count() == 0 and models.best_triplets(frame, t.limit(0), 3).count() == 0


@pytest.mark.parametrize("model", ["ridge", "bayes"])
def test_packed_groups_fit_as_single_ones(spark, model):
    """One row a group in place of one row a session, many groups to a call."""
    rng, d, long, goal = np.random.default_rng(33), days(50), [], []
    for g in range(12):
        for f in range(1 + g % 5):
            long += [(f"g{g}", d[i], f"f{f}", float(rng.normal())) for i in range(g % 3, 50) if rng.random() > 0.03 * f]
        goal += [(f"g{g}", d[i], None if rng.random() < 0.05 else 1.0 if g == 7 and i >= 40 else float(rng.normal()), i >= (49 if g == 5 else 40), g)
                 for i in range(50 if g != 4 else 4)]
    x = spark.createDataFrame(long, "target string, date date, feature string, value double")
    y = spark.createDataFrame(goal, "target string, date date, value double, is_test boolean, fold int")
    plain = models.linear_per_group(models.design(x, y.withColumnRenamed("value", "y"), "target").filter("fold is not null"), ["target", "fold"], model=model, penalty=5.0, top=3)
    packed = select.gather(x, ["target", "feature"]).select("target", "feature", "days", "values")
    rows = models.design(packed, select.gather(y, ["target", "fold"], "is_test").withColumnRenamed("values", "y"), "target")
    got, want = (f.orderBy("target").collect() for f in (models.linear_per_group(rows, ["target", "fold"], model=model, penalty=5.0, top=3), plain))
    assert len(want) == 10 and rows.count() == 12
    for a, b in zip(got, want):
        assert (a["target"], a["fold"], a["n"], a["features"], a["accuracy"]) == (b["target"], b["fold"], b["n"], b["features"], b["accuracy"])
        assert a["weights"] == pytest.approx(b["weights"], abs=1e-6) and a["train_r2"] == pytest.approx(b["train_r2"], abs=1e-6)
        assert a["test_r2"] == (None if b["test_r2"] is None else pytest.approx(b["test_r2"], abs=1e-6))


def test_triplets_never_hold_the_pool_in_one_row(spark, monkeypatch):
    """One row of a target's whole pool went to sixteen tasks before; equal features tie by name across blocks."""
    rng = np.random.default_rng(31)
    n, d = 120, days(60)
    x, y = rng.normal(size=(n, 60)), rng.normal(size=60)
    x[60:] = x[:60]  # every feature has a copy
    x[5] = x[65] = 3.0  # flat
    names = [f"f{(i * 37) % n:03d}" for i in range(n)]
    rows = spark.createDataFrame([(f, day, float(v)) for f, r in zip(names, x) for day, v in zip(d, r)], "feature string, date date, value double")
    goal = spark.createDataFrame([("T", day, float(v)) for day, v in zip(d, y)], "target string, date date, y double")
    monkeypatch.setattr(correlate, "BLOCK_BYTES", 12 * 60 * 20)
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), spark.sparkContext.applicationId)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = models.best_triplets(rows, goal, 5).orderBy("rank").collect()
    for path in set(os.listdir(folder)) - before:
        f = spark.read.parquet(f"{folder}/{path}")
        held = [c for c, kind in f.dtypes if kind in ("array<string>", "array<int>")]
        assert all((v or 0) < n * 60 / 2 for v in (f.agg(*[F.max(F.size(c)) for c in held]).first() if held else ()))
        assert all((v or 0) < n for v in (f.agg(*[F.max(F.size(c)) for c, kind in f.dtypes if kind == "array<string>"]).first() if "array<string>" in dict(f.dtypes).values() else ()))
    z, v, order = x - x.mean(axis=1, keepdims=True), y - y.mean(), np.argsort(names)
    z, named = z[order], np.array(names)[order]
    brute = []
    for i in range(n - 2):
        j, k = np.triu_indices(n - 1 - i, 1)
        total = z[i] + z[j + i + 1] + z[k + i + 1]
        size = (total**2).sum(axis=1)
        r2 = np.where(size > 1e-9, (total @ v) ** 2 / np.maximum(size, 1e-9), -1) / (v @ v)
        brute += [(-round(float(r2[b]), 12), named[i], named[j[b] + i + 1], named[k[b] + i + 1]) for b in np.argsort(-r2)[:40]]
    assert [(r["first"], r["second"], r["third"]) for r in got] == [b[1:] for b in sorted(brute)[:5]]


def test_combo_screen_against_single_fits(spark):
    rng = np.random.default_rng(10)
    n, names = 140, ["a", "b", "c", "d", "e"]
    x, y = rng.normal(size=(n, 5)), rng.normal(size=n)
    data = spark.createDataFrame([("T", d, float(y[i]), f, float(x[i, j])) for i, d in enumerate(days(n)) for j, f in enumerate(names)],
                                 "target string, date date, y double, feature string, value double")
    combos = [("T", "a", "b", "c", "d"), ("T", "a", "b", "c", "e"), ("T", "a", "b", "d", "e")]
    cd = spark.createDataFrame(combos, "target string, macro_1 string, macro_2 string, micro_1 string, micro_2 string")
    got = {(r["micro_1"], r["micro_2"]): r["accuracy"] for r in models.screen_combos(data, cd, 40, -1.0, chunk_rows=3).collect()}
    for _, *c in combos:
        m = x[:, [names.index(f) for f in c]]
        a, b = solvers.standardise(m[:-40], m[-40:])
        w, _h = solvers.logistic(a[None], (y[:-40] > 0).astype(float))
        acc = ((solvers.predict_logistic(w, b[None])[0] > 0.5) == (y[-40:] > 0)).mean()
        assert got[(c[2], c[3])] == pytest.approx(acc)


def test_dual_head_beats_chance_and_keeps_the_future_row(spark):
    rng = np.random.default_rng(11)
    n = 260
    x = rng.normal(size=(n, 2))
    y = 0.02 * x[:, 0] + 0.01 * rng.normal(size=n)
    pdf = pd.DataFrame({"ticker": "A", "date": days(n), "x": x.tolist(), "names": [["p", "q"]] * n, "y": y,
                        "priors": [[0.0, 0.0]] * n, "intercept_prior": 0.0})
    pdf.loc[n - 1, "y"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    out = models.dual_head(d, 30).orderBy("date").toPandas()
    assert len(out) == 30 and out["actual_ret"].isna().sum() == 1 and out["date"].iloc[-1] == days(n)[-1]
    k = out.dropna()
    assert ((k.p_up > 0.5) == (k.actual_ret > 0)).mean() > 0.8 and np.corrcoef(k.exp_ret, k.actual_ret)[0, 1] > 0.7
    assert (out.exp_vol > 0).all() and out.p_up.between(0, 1).all()


def test_backtest_equals_sequential_loop(spark):
    rng = np.random.default_rng(12)
    n, tickers = 25, [f"t{i:02d}" for i in range(15)]
    ds = days(n)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, (n, 15)), 0))
    low = close * (1 - rng.random((n, 15)) * 0.05)
    pu, er, ev = rng.uniform(0.3, 0.95, (n, 15)), rng.normal(0.01, 0.02, (n, 15)), rng.uniform(0.005, 0.03, (n, 15))
    rows = [(t, d, *map(float, (close[i, j], low[i, j], pu[i, j], er[i, j], ev[i, j], 20.0))) for i, d in enumerate(ds) for j, t in enumerate(tickers)]
    s = spark.createDataFrame(rows, "ticker string, date date, close double, low double, p_up double, exp_ret double, exp_vol double, vix_next double")
    curve = backtest.equity_curve(backtest.backtest_positions(s), s).orderBy("date").toPandas()
    eq = 10000.0
    for i in range(n):
        cash, nxt = eq, 0.0
        if i + 1 < n:
            for j in sorted(range(15), key=lambda j: (-pu[i, j], tickers[j])):
                if pu[i, j] <= 0.5 or er[i, j] <= 0:
                    continue
                k = 0.0
                if er[i, j] > 1e-4 and ev[i, j] > 1e-4:
                    ratio = er[i, j] / ev[i, j]
                    k = pu[i, j] - (1 - pu[i, j]) / (ratio if ratio > 0.1 else 1.0)
                a = min(eq * min(max(0.0, min(1.0, k)), 0.2), cash)
                if a > 0:
                    cash -= a
                    r = close[i + 1, j] / close[i, j] - 1
                    nxt += a * (-0.06 if low[i + 1, j] / close[i, j] - 1 <= -0.06 else r)
            eq += nxt
        assert curve["equity"].iloc[i] == pytest.approx(eq, rel=1e-9)


def test_bars_use_event_order_not_file_order(spark):
    rows = [("A", 3, 1, 30.0), ("A", 1, 2, 12.0), ("A", 1, 1, 11.0), ("A", 3, 2, 31.0), ("A", 2, 9, 5.0)]
    t = spark.createDataFrame(rows, "ticker string, t long, seq long, price double").withColumns({"size": F.lit(2.0), "d": F.lit("x")})
    t = t.withColumn("ord", packed_order((F.col("t"), 19), (F.col("seq"), 19)))
    r = bars_from_ticks(t, ["ticker", "d"], "ord").first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (11.0, 31.0, 5.0, 31.0, 10.0)


def test_threshold_grid_counts(spark):
    rng = np.random.default_rng(13)
    p, a = rng.random(500), rng.normal(size=500)
    d = spark.createDataFrame(pd.DataFrame({"p_up": p, "actual_ret": a}))
    for r in threshold_grid(d, [0.5, 0.7, 0.9]).collect():
        t = r["threshold"]
        assert (r["longs"], r["shorts"]) == ((p > t).sum(), (p < 1 - t).sum())
        assert r["long_hit_rate"] == pytest.approx((a[p > t] > 0).mean()) and r["short_mean_ret"] == pytest.approx(-a[p < 1 - t].mean())


def test_upsert_keeps_untouched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "p string, k int, v double").select("k", "v", "p")
    readers.write_panel(d, path, ["p"])
    before = {str(f) for f in (tmp_path / "t" / "p=b").iterdir()}
    maintain.upsert_table(spark, path, spark.createDataFrame([(2, 9.0, "a"), (3, 4.0, "a")], d.schema), ["p", "k"], "p", "v")
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("p", "k", "v").collect())
    assert got == [("a", 1, 1.0), ("a", 2, 9.0), ("a", 3, 4.0), ("b", 1, 3.0)]
    assert {str(f) for f in (tmp_path / "t" / "p=b").iterdir()} == before


def test_pick_column_names_candidates(spark):
    with pytest.raises(ValueError, match="VIX_Close"):
        readers.pick_column(spark.range(1), ["VIX_Close", "VIX_Close_x"], "v")


def test_fold_rows_never_train_on_the_future(spark):
    d = spark.createDataFrame([(x,) for x in days(61)], "date date")
    got = joins.fold_rows(d, 5).toPandas()
    for _, g in got.groupby("fold"):
        assert g[~g.is_test].date.max() < g[g.is_test].date.min() and g.is_test.sum() == 10


def test_chains_end_at_a_cycle(spark):
    from sessionloom.operators import select
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("f", "x")], "target string, predictor string")
    got = sorted(tuple(r) for r in select.chain_steps(edges, 40).collect())
    assert [r for r in got if r[0] == "a"] == [("a", 1, "b", False), ("a", 2, "c", False), ("a", 3, "a", True)]
    assert [r for r in got if r[0] in "df"] == [("d", 1, "d", True), ("f", 1, "x", False)]
    assert [r[1:] for r in got if r[0] == "e"] == [(1, "a", False), (2, "b", False), (3, "c", False), (4, "a", True)]
    assert max(r[1] for r in select.chain_steps(edges, 2).collect()) == 2
