"""Stake sizing: Kelly fractions, risk tiers, cash-capped allocation, list building."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import by, cols, first_per, ranged_running
from ..session import pin
from .cleaning import min_history
from .windows import min_max_scale, ratio_change, top_k

# Persona rules (probability threshold, Kelly multiplier, cap, flat stake).
STOCK_RULES = {
    "conservative": (0.60, 0.25, 0.10, 0.05),
    "neutral": (0.60, 0.50, 0.10, 0.10),
    "aggressive": (0.55, 0.90, 0.15, 0.15),
}
ETF_RULES = {
    "conservative": (0.57, 0.25, 0.10, 0.0),
    "neutral": (0.54, 0.50, 0.10, 0.0),
    "aggressive": (0.51, 1.00, 0.10, 0.0),
}
# Fear multipliers as (volatility above, multiplier), highest first.
FEAR_TIERS = {
    "conservative": ((25.0, 0.0), (20.0, 0.3)),
    "neutral": ((30.0, 0.0), (20.0, 0.8)),
    "aggressive": ((45.0, 0.0), (35.0, 0.8)),
}
ETF_FEAR_TIERS = ((30.0, 0.0), (25.0, 0.5), (20.0, 0.8))
# Stop-loss returns for volatility above 35, above 25, otherwise.
STOCK_STOPS = {
    "conservative": (-0.010, -0.025, -0.040),
    "neutral": (-0.020, -0.035, -0.050),
    "aggressive": (-0.030, -0.045, -0.060),
}
ETF_STOPS = {
    "conservative": (-0.005, -0.015, -0.025),
    "neutral": (-0.010, -0.020, -0.030),
    "aggressive": (-0.020, -0.030, -0.040),
}


def kelly(prob, ret, vol, variant: str = "guarded") -> Column:
    """Kelly fraction. Variants: strict, guarded, etf, backtest, scorecard."""
    p, r, v = (F.col(x) if isinstance(x, str) else x for x in (prob, ret, vol))
    ratio = F.try_divide(r, v)
    guarded = F.when(ratio > 0.1, ratio).otherwise(1.0)
    positive = (r > 0) & (v > 0)

    def stake(odds):
        return F.greatest(F.lit(0.0), p - F.try_divide(1 - p, odds))

    if variant == "strict":
        return F.when(positive, stake(ratio)).otherwise(0.0)
    if variant == "guarded":
        return F.when(positive, stake(guarded)).otherwise(0.0)
    if variant == "etf":
        return stake(F.when(positive & (ratio > 0.1), ratio).otherwise(1.0))
    if variant == "backtest":
        return F.when((r > 1e-4) & (v > 1e-4), F.least(F.lit(1.0), stake(guarded))).otherwise(0.0)
    if variant == "scorecard":
        return F.when((p > 0.65) & (r > 0), F.least(F.lit(1.0), F.coalesce(stake(ratio), F.lit(0.0)))).otherwise(0.0)
    raise ValueError(f"unknown variant {variant}")


def recommendation(prob, asset: str = "stock", hold: Column | None = None) -> Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    c = (F.when(p > 0.65, "Buy").when(p < 0.35, "Sell") if asset == "stock"
         else F.when(p >= 0.51, "Buy").when(p <= 0.49, "Sell")).otherwise("Hold")
    return c if hold is None else F.when(hold, "Hold").otherwise(c)


def hit_label(rec: Column, actual: Column) -> Column:
    """A return of exactly zero is "not up": a hit for Sell, a miss for Buy."""
    return (F.when(actual.isNull(), "Pending").when(rec == "Hold", "Hold")
            .when(((rec == "Buy") & (actual > 0)) | ((rec == "Sell") & (actual <= 0)), "On target").otherwise("Miss"))


def override_note(rec: Column, vix: Column, stake: Column, prob: Column) -> Column:
    """Why a Buy was vetoed: market panic first, then a zero stake."""
    return (F.when((rec == "Buy") & (vix > 30), F.lit("VETO: volatility index above 30"))
            .when((rec == "Buy") & (stake == 0), F.format_string("VETO: zero stake at P(UP)=%.1f%%", F.round(prob * 100, 1)))
            .otherwise(""))


def _tier(vix: Column, tiers, default: float) -> Column:
    c = None
    for level, value in tiers:
        c = F.when(vix > level, value) if c is None else c.when(vix > level, value)
    return c.otherwise(default)


def _by_style(persona: Column, make, dynamic: str) -> Column:
    style = F.regexp_replace(persona, "^etf_", "")
    return (F.when(style == "conservative", make("conservative")).when(style == "aggressive", make("aggressive"))
            .when(style == "dynamic", make(dynamic)).otherwise(make("neutral")))


def fear_multiplier(persona: Column, vix: Column) -> Column:
    """Stock personas have own tiers (dynamic uses neutral's); ETF personas share one."""
    stock = _by_style(persona, lambda s: _tier(vix, FEAR_TIERS[s], 1.0), "neutral")
    return F.when(persona.startswith("etf_"), _tier(vix, ETF_FEAR_TIERS, 1.0)).otherwise(stock)


def stop_level(persona: Column, vix: Column) -> Column:
    """Stop-loss return; dynamic uses the aggressive tier here."""

    def make(table):
        return lambda s: F.when(vix > 35, table[s][0]).when(vix > 25, table[s][1]).otherwise(table[s][2])

    return F.when(persona.startswith("etf_"), _by_style(persona, make(ETF_STOPS), "aggressive")).otherwise(
        _by_style(persona, make(STOCK_STOPS), "aggressive"))


def with_personas(df: DataFrame, rules=None) -> DataFrame:
    """Each row once per persona, with that persona's rules."""
    rules = STOCK_RULES if rules is None else rules
    items = F.array(*[F.struct(F.lit(n).alias("persona"), F.lit(t).alias("threshold"), F.lit(m).alias("multiplier"),
                               F.lit(c).alias("max_alloc"), F.lit(f).alias("flat")) for n, (t, m, c, f) in rules.items()])
    return df.select("*", F.inline(items))


def stake_fraction(prob="p_up", ret="exp_ret", vol="exp_vol", vix="vix_close", variant: str = "guarded", ignore_kelly: bool = False) -> Column:
    """Share of capital for rows passing the persona's threshold; zero in a panic.

    With ``ignore_kelly`` the persona's flat share is staked whatever the odds.
    """
    m = fear_multiplier(F.col("persona"), F.col(vix))
    applied = kelly(prob, ret, vol, variant) * F.col("multiplier") * m
    applied = F.when((applied == 0) & (F.col("flat") > 0), F.col("flat") * m).otherwise(applied)
    if ignore_kelly:
        applied = F.col("flat") * m
    ok = (F.col(prob) > F.col("threshold")) & (m > 0)
    return F.when(ok, F.least(applied, F.col("max_alloc"))).otherwise(0.0)


def restrict(cands: DataFrame, held: DataFrame, barred: DataFrame, keys=("persona", "date"), item="ticker") -> DataFrame:
    """Candidates that may be bought, with the capital that is free.

    ``held`` (keys, item, value) are frozen or quarantined positions: they keep
    their value, which is taken off cash and capital, and are not bought.
    ``barred`` (any of the keys, item) are blacklisted or suspended items.
    """
    k = cols(keys)
    frozen = held.groupBy(*k).agg(F.sum("value").alias("_frozen"))
    on = [c for c in k if c in barred.columns] + [item]
    free = cands.join(held.select(*k, item), [*k, item], "left_anti").join(barred.select(*on), on, "left_anti").join(frozen, k, "left")
    left = F.greatest(F.lit(0.0), F.col("cash") - F.coalesce("_frozen", F.lit(0.0)))
    return free.withColumn("cash", left).withColumn("raw", F.col("pct") * F.col("cash")).drop("_frozen")


def allocate(cands: DataFrame, keys=("persona", "date"), order=("neg_p", "ticker"), raw="raw", price="price",
             cash="cash", fold_rows: int = 2048) -> DataFrame:
    """Whole-unit purchases in order, each limited by the cash still left.

    Needs one ``cash`` value per key. Groups of up to ``fold_rows`` rows that can
    buy at all are folded natively over one sorted array; larger ones are solved
    in rounds of distributed running sums (:func:`allocate_rounds`). Both give the
    sequential result. Runs jobs.
    """
    k, o = cols(keys), cols(order)
    todo = pin(_affordable(cands, raw, price, cash))
    many = todo.groupBy(*k).count().filter(F.col("count") > fold_rows).select(*k)
    if many.isEmpty():
        return _bought(fold_cash(todo, k, o, raw, price, cash), k, o, price)
    few = _bought(fold_cash(todo.join(many, k, "left_anti"), k, o, raw, price, cash), k, o, price)
    return few.unionByName(allocate_rounds(todo.join(many, k, "left_semi"), k, o, raw, price, cash))


def _affordable(cands: DataFrame, raw: str, price: str, cash: str) -> DataFrame:
    return cands.filter((F.col(price) > 0) & (F.col(raw) >= F.col(price)) & (F.col(cash) >= F.col(price)))


def ordered_fold(rows: DataFrame, keys, order, fields: dict[str, Column], start: Column, step) -> DataFrame:
    """(keys, rows, acc): ``step(acc, row)`` folded over each group's rows in order, from ``start`` (an aggregate or a literal).

    A group is one sorted array of (order, fields): only for groups whose size is
    bounded by what they stand for or by a check of the caller. Nulls come first.
    """
    k = cols(keys)
    entry = F.struct(*cols(order), *[c.cast("double").alias(n) for n, c in fields.items()])
    g = rows.groupBy(*k).agg(F.sort_array(F.collect_list(entry)).alias("rows"), start.alias("_start"))
    return g.select(*k, "rows", F.aggregate("rows", F.col("_start"), step).alias("acc"))


def fold_cash(todo: DataFrame, keys, order, raw="raw", price="price", cash="cash", each: bool = True) -> DataFrame:
    """(keys, rows, acc): acc.paid is what each row of ``rows`` costs in whole units, acc.left the cash that remains.

    Without ``each`` acc.bought counts the rows bought instead. A list that grows
    row by row is copied at every step, which only short groups can bear.
    """
    start = {"left": F.max(F.col(cash).cast("double"))} | ({"paid": F.array().cast("array<double>")} if each else {"bought": F.lit(0).cast("long")})

    def step(acc: Column, row: Column) -> Column:
        pay = F.coalesce(F.floor(F.least(row["_raw"], acc["left"]) / row["_price"]) * row["_price"], F.lit(0.0))
        after = F.array_append(acc["paid"], pay).alias("paid") if each else (acc["bought"] + (pay > 0).cast("long")).alias("bought")
        return F.struct((acc["left"] - pay).alias("left"), after)

    return ordered_fold(todo, keys, order, {"_raw": F.col(raw), "_price": F.col(price)}, F.struct(*[c.alias(n) for n, c in start.items()]), step)


def _bought(folded: DataFrame, k: list[str], o: list[str], price: str) -> DataFrame:
    each = folded.select(*k, F.explode(F.arrays_zip("rows", F.col("acc.paid").alias("paid"))).alias("z")).filter("z.paid > 0")
    out = each.select(*k, *[F.col("z.rows")[c].alias(c) for c in o if c not in k], F.col("z.rows._price").alias(price), F.col("z.paid").alias("dollars"))
    return out.withColumn("units", F.round(F.col("dollars") / F.col(price)))


def allocate_rounds(cands: DataFrame, keys=("persona", "date"), order=("neg_p", "ticker"), raw="raw", price="price",
                    cash="cash") -> DataFrame:
    """:func:`allocate` for groups of any size.

    Instead of folding a whole group in one task, every round takes the longest
    prefix the cash covers (a distributed running sum), settles the first row it
    does not cover with what is left, and repeats with the rows that can still buy
    a unit. The rounds go on until no such row exists. Runs jobs.
    """
    k, o = cols(keys), cols(order)
    unit = F.floor(F.col(raw) / F.col(price)) * F.col(price)
    todo = pin(_affordable(cands, raw, price, cash).withColumn("_want", unit))
    done = []
    while True:
        run = ranged_running(todo, k, [F.col(c) for c in o], {"_cum": F.col("_want")}, stored=True)
        done.append(run.filter(F.col("_cum") <= F.col(cash)).withColumn("dollars", F.col("_want")))
        over = run.filter(F.col("_cum") > F.col(cash))
        edge = first_per(over, k, o).withColumn("_left", F.col(cash) - (F.col("_cum") - F.col("_want")))
        edge = edge.withColumn("dollars", F.floor(F.least(F.col(raw), F.col("_left")) / F.col(price)) * F.col(price))
        done.append(edge.filter("dollars > 0"))
        after = edge.select(*k, F.struct(*o).alias("_edge"), (F.col("_left") - F.col("dollars")).alias("_cash2"))
        rest = (over.join(after, k).filter(F.struct(*o) > F.col("_edge"))
                .filter(F.col(price) <= F.col("_cash2")).withColumn(cash, F.col("_cash2")))
        rest = pin(rest.select(*todo.columns))
        if rest.isEmpty():
            break
        todo = rest
    out = [d.select(*k, *[c for c in o if c not in k], price, "dollars") for d in done]
    bought = reduce(DataFrame.unionByName, out)
    return bought.withColumn("units", F.round(F.col("dollars") / F.col(price)))


def best_persona(returns: DataFrame, default: str = "neutral", min_rows: int = 10, window: int = 30) -> DataFrame:
    """Persona with the best recent Sharpe ratio; the default when none qualifies."""
    from .aggregates import sharpe
    from .cleaning import tail
    enough = min_history(returns, min_rows, "persona")
    s = sharpe(tail(enough, window, "persona"), keys="persona").filter("sharpe is not null")
    return s.agg(F.coalesce(F.max_by("persona", F.struct("sharpe", "persona")), F.lit(default)).alias("winner"),
                 F.max("sharpe").alias("sharpe"))


# ---- lists -----------------------------------------------------------------

def liquidity_and_volatility(bars: DataFrame, by_cols=("ticker",), recent: int = 30, min_rows: int = 50) -> DataFrame:
    from .cleaning import tail
    k = cols(by_cols)
    d = min_history(bars.dropna(subset=["close", "volume"]), min_rows, k)
    liq = tail(d, recent, k).groupBy(*k).agg(F.avg(F.col("close") * F.col("volume")).alias("liquidity"))
    vol = d.withColumn("_r", ratio_change("close", 1, by(k))).groupBy(*k).agg(F.stddev_samp("_r").alias("volatility"))
    return liq.join(vol, k)


def rebalance_list(bars: DataFrame, sectors: DataFrame, k: int = 50) -> DataFrame:
    """Top tickers per sector by liquidity over volatility."""
    s = liquidity_and_volatility(bars).join(sectors, "ticker").withColumn(
        "score", F.when(F.col("volatility") > 0, F.col("liquidity") / F.col("volatility")).otherwise(0.0))
    return top_k(s, k, "sector", [F.col("score").desc(), F.col("ticker")], "place")


def composite_scores(stats: DataFrame, sector="sector") -> DataFrame:
    """0.7/0.3 and 0.3/0.7 blends of scaled liquidity and inverted scaled volatility."""
    d = min_max_scale(stats.filter("volatility > 0"), ["liquidity", "volatility"], sector, invert=())
    v = F.when(F.col("_flat_v"), 0.0).otherwise(1 - F.col("volatility_scaled"))
    flat = stats.filter("volatility > 0").groupBy(sector).agg((F.min("volatility") == F.max("volatility")).alias("_flat_v"))
    d = d.join(flat, sector).withColumn("_v", v)
    return d.withColumns({"cap_score": 0.7 * F.col("liquidity_scaled") + 0.3 * F.col("_v"),
                          "vol_score": 0.3 * F.col("liquidity_scaled") + 0.7 * F.col("_v")}).drop("_v", "_flat_v")


def list_churn(old: DataFrame, new: DataFrame, on="ticker") -> DataFrame:
    """Every ticker of either list labelled kept, added or dropped."""
    k = cols(on)
    o = old.select(*k).distinct().withColumn("_o", F.lit(1))
    n = new.select(*k).distinct().withColumn("_n", F.lit(1))
    return o.join(n, k, "full_outer").select(
        *k, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "dropped").otherwise("kept").alias("change"))


def universe(bars: DataFrame, core: DataFrame, floor: float, slots: int = 24, window: int = 10) -> DataFrame:
    """Core list plus the liquid tickers with the best momentum-times-volatility."""
    from .aggregates import dollar_volume
    from .indicators import opportunity
    pool = bars.join(dollar_volume(bars, floor), "ticker", "left_semi").join(core, "ticker", "left_anti")
    best = opportunity(pool, window, 5).filter("opportunity is not null").orderBy(
        F.col("opportunity").desc(), "ticker").limit(slots)
    return core.select("ticker", F.lit("core").alias("origin")).unionByName(best.select("ticker", F.lit("thematic").alias("origin")))


# Rules of the fundamental score, first match counts: (above or below, limit, points).
SCORE_RULES = {
    "margin": ((">", 0.20, 0.4), (">", 0.10, 0.2), ("<", 0.0, -0.4)),
    "debt": (("<", 50.0, 0.3), (">", 200.0, -0.3)),
    "eps": ((">", 5.0, 0.2), (">", 0.0, 0.1), ("<", 0.0, -0.2)),
    "rating": (("<=", 2.0, 0.2), (">=", 3.0, -0.2)),
    "upside": ((">", 0.20, 0.3), (">", 0.10, 0.1), ("<", 0.0, -0.3)),
}
_OPS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def fundamental_score(margin: Column, debt: Column, eps: Column, rating: Column, target: Column, price: Column) -> Column:
    """Rule table clipped to -1..1; missing margin and EPS count as 0, missing debt as 100."""
    m, d, e = F.coalesce(margin, F.lit(0.0)), F.coalesce(debt, F.lit(100.0)), F.coalesce(eps, F.lit(0.0))
    up = F.when(price > 0, F.try_divide(target, price) - 1)

    def points(value: Column, rules) -> Column:
        out = F
        for op, limit, score in rules:
            out = out.when(_OPS[op](value, limit), score)
        return out

    parts = [points(v, SCORE_RULES[n]) for n, v in (("margin", m), ("debt", d), ("eps", e), ("rating", rating), ("upside", up))]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))
