"""M9-M28: screens, models, scoring."""

from pyspark.sql import functions as F

from ..frames import by
from ..operators import models as m
from ..operators import pool
from ..operators import select as s
from ..operators import windows
from ..operators.cleaning import exclude_features
from ..operators.indicators import sector_regime
from ..operators.correlate import shifted, unpack
from ..operators.joins import combine_pairs, fold_rows
from ..operators.report import fold_summary
from ..operators.windows import top_k
from ..session import pin
from .registry import query
from .selection import FEATURES, returns
from .sqltext import sql
from .windows import W


def _targets(c, name="ticker"):
    return c.pred.select(F.col("ticker").alias(name), "date", F.col("ret").alias("y"))


def _weekly_returns(c):
    return c.weekly.select("ticker", "date", F.col("ret").alias("value"))


def _stage(c, features=None):
    """Returns of every ticker, and the packed technical features one session late."""
    f = s.gather(exclude_features(c.features if features is None else features), ["ticker", "feature"])
    ret = unpack(f.filter("feature = 'RET'").select("ticker", "days", "values")).select("ticker", "date", "value")
    return ret, shifted(s.pack_features(f), 1)


def _selected(c, k, min_obs=30, train_share=0.8, features=None):
    """Long design rows: each target's k strongest lagged technical features."""
    ret, lagged = _stage(c, features)
    t = ret.select(F.col("ticker").alias("series"), "date", "value")
    return s.selected_rows(s.top_k_packed(t, lagged, k, train_share=train_share, min_obs=min_obs), lagged)


@query("m9_screen_logistic", stage="weekly")
def _(c):
    r = _weekly_returns(c)
    chain = s.lag_chain(s.best_lag1(r), 5)
    lead = s.leader_values(r, chain, 5).select("ticker", "date", F.col("depth").alias("d"), F.concat(F.lit("chain"), F.col("depth").cast("string")).alias("feature"), F.col("x").alias("value"))
    deep = F.explode(F.filter(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda k: k >= F.col("d"))).alias("depth")
    chain_rows = lead.select("ticker", "date", deep, "feature", "value")
    tech = _selected(c, 3, features=c.weekly_features).select(F.col("target").alias("ticker"), "date", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("depth"), "feature", "value")
    reg = sector_regime(c.weekly).select("ticker", "date", F.lag("sector_momentum").over(by()).alias("value"))
    reg = reg.select("ticker", "date", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("depth"), F.lit("sector_momentum").alias("feature"), "value")
    rows = m.design(chain_rows.unionByName(tech).unionByName(reg), c.weekly.select("ticker", "date", F.col("ret").alias("y")), ["ticker", "depth"])
    return m.best_depth(m.screen_logistic(rows))


@query("m10_screen_combos", stage="weekly weekly_macro")
def _(c):
    etf = c.weekly.groupBy(F.col("sector").alias("target"), "date").agg(F.avg("ret").alias("y"))
    names = ["vix_close", "tnx_close", "irx", "hyg", "ief", "sphb", "splv", "oil", "copper", "usd"]
    mac = c.weekly_macro.select("date", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])))
    mac = mac.select("date", "feature", (F.col("v") - F.lag("v").over(by("feature"))).alias("value"))
    macro_rows = etf.join(mac, "date").select("target", "date", "y", "feature", "value")
    mic = c.weekly.select("date", F.col("ticker").alias("feature"), F.lag("ret").over(by()).alias("value"))
    micro_rows = mic.join(etf, "date").select("target", "date", "feature", "value", "y")
    from ..operators.aggregates import correlate

    def ranked(rows, k):
        g = correlate(rows, "y", "value", ["target", "feature"]).filter("corr is not null and n >= 60")
        return pin(top_k(g, k, "target", [F.abs("corr").desc(), F.col("feature")], "rank"))  # k rows per target

    mr, sr = ranked(macro_rows, 15), ranked(micro_rows, 15)
    combos = combine_pairs(mr, sr)
    data = macro_rows.join(mr.select("target", "feature"), ["target", "feature"], "left_semi").unionByName(
        micro_rows.join(sr.select("target", "feature"), ["target", "feature"], "left_semi"))
    return m.screen_combos(data, combos)


def _logistic_sql(rows: str, k: int, keys: str = "", sweeps: int = 60, free_intercept: bool = False) -> str:
    """Recursive CTE ``fit`` of penalised logistic coefficients (penalty 1): one Newton step of one coefficient at a time.

    ``rows`` has ``keys``, ``x`` (list of ``k`` values, the first one 1) and ``y`` (0 or 1).
    """
    same, named = (f"JOIN {rows} USING ({keys})", f"{keys}, ") if keys else (f"CROSS JOIN {rows}", "")
    lam = f"CASE WHEN j = 1 THEN {0 if free_intercept else 1} ELSE 1 END"
    return f""", fit AS (SELECT DISTINCT {named}0 AS step, list_transform(range({k}), lambda i: 0.0::DOUBLE) AS w FROM {rows} UNION ALL
  SELECT {named}step + 1, list_transform(w, lambda v, i: CASE WHEN i = j THEN v - g / h ELSE v END) FROM (
    SELECT {named}step, w, j, sum((p - y) * x[j]) + {lam} * w[j] AS g, sum(p * (1 - p) * x[j] * x[j]) + {lam} AS h FROM (
      SELECT {named}step, w, x, y, step % {k} + 1 AS j, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM fit {same} WHERE step < {k * sweeps}) GROUP BY {named}step, w, j))
"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("m11_nested_probability", _recursive(sql("weekly", ", o AS (SELECT ticker, date, ret, " + ", ".join(f"lag(ret, {i}) OVER ({W}) AS l{i}" for i in range(1, 6)) + """ FROM weekly),
q AS MATERIALIZED (SELECT ticker, date, [1.0::DOUBLE, l1, l2, l3, l4, l5] AS x, (ret > 0)::INT AS y FROM o WHERE ret IS NOT NULL AND l5 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ticker) > 100)
""" + _logistic_sql("q", 6, "ticker") + "SELECT ticker, date, round(1 / (1 + exp(-list_dot_product(x, w))), 6) AS nested_p_up FROM q JOIN fit USING (ticker) WHERE step = 360")))
def _(c):
    return m.nested_probability(m.own_lags(c.weekly))


_META = ("rsi", "adx", "atr", "plus_di", "minus_di")


@query("m12_meta_priors", _recursive(sql("bars", FEATURES + f""", mx AS (SELECT {", ".join(f"coalesce({n}, 0) AS {n}" for n in _META)}, nxt FROM (SELECT *, lead(ret) OVER ({W}) AS nxt FROM tr2) WHERE nxt IS NOT NULL),
ms AS (SELECT {", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in _META)} FROM mx), q AS MATERIALIZED (SELECT [1.0::DOUBLE, {", ".join(f"({n} - m_{n}) / s_{n}" for n in _META)}] AS x, (nxt > 0)::INT AS y FROM mx, ms)
""" + _logistic_sql("q", 6, sweeps=100, free_intercept=True) + "SELECT unnest([" + ", ".join(f"'{n.upper()}'" for n in _META) + "]) AS suffix, round(unnest(w[2:6]), 4) + 0 AS alpha FROM fit WHERE step = 600")))
def _(c):
    names = ["RSI", "ADX", "ATR", "PLUS_DI", "MINUS_DI"]
    f = c.features.groupBy("ticker", "date").agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in [*names, "RET"]])
    f = f.withColumn("next_ret", F.lead("RET").over(by()))
    return m.meta_priors(f, names, "next_ret")


AR = f""", x AS (SELECT ticker, date, ret, lag(ret) OVER ({W}) AS l FROM pred), a AS (SELECT ticker, regr_slope(ret, l) AS slope, regr_intercept(ret, l) AS intercept, regr_r2(ret, l) AS r2, count(*) AS n
  FROM x WHERE ret IS NOT NULL AND l IS NOT NULL GROUP BY 1)
"""


@query("m13_autoregression", sql("pred", AR + "SELECT ticker, round(slope, 6) + 0 AS slope, round(intercept, 6) + 0 AS intercept, round(r2, 6) AS r2, n FROM a"))
def _(c):
    return m.autoregression(c.pred)


@query("m13_ar_residuals", sql("pred", AR + f""", z AS (SELECT x.ticker, date, ret - intercept - slope * l AS residual FROM x LEFT JOIN a ON x.ticker = a.ticker)
SELECT ticker, date, round(residual, 6) + 0 AS residual, round(lag(residual) OVER ({W}), 6) + 0 AS residual_lag1 FROM z"""))
def _(c):
    return m.ar_residuals(c.pred).select("ticker", "date", "residual", "residual_lag1")


@query("m14_ridge_per_target")
def _(c):
    return pool.ridge_pool(returns(c))


_OLS = """, z AS (SELECT ticker, date, ret AS y, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS x FROM pred)
SELECT '(intercept)' AS feature, round(regr_intercept(y, x), 6) + 0 AS coefficient FROM z UNION ALL SELECT 'lag1', round(regr_slope(y, x), 6) + 0 FROM z"""


@query("m14_ridge_pooled", sql("pred", _OLS))
def _(c):
    return m.ridge_pooled(m.own_lags(c.pred, n=1), ["lag1"], "ret", 0.0)


@query("m15_forward_stepwise")
def _(c):
    return pool.stepwise_pool(returns(c))


_DENSE = f""", days AS (SELECT DISTINCT date FROM pred WHERE ret IS NOT NULL), who AS (SELECT DISTINCT ticker FROM pred WHERE ret IS NOT NULL),
grid AS (SELECT who.ticker, days.date, coalesce(p.ret, 0) AS y FROM who CROSS JOIN days LEFT JOIN pred p ON p.ticker = who.ticker AND p.date = days.date),
full_lag AS (SELECT *, lag(y) OVER ({W}) AS x FROM grid QUALIFY x IS NOT NULL)
"""


@query("m15_first_step", sql("pred", _DENSE + """, r AS (SELECT a.ticker AS target, b.ticker AS feature, corr(a.y, b.x) AS c FROM full_lag a JOIN full_lag b ON a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2)
SELECT target, feature, round(c * c, 6) AS r2 FROM r WHERE c IS NOT NULL AND NOT isnan(c) QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(c) DESC, feature) = 1"""))
def _(c):
    return pool.first_step(returns(c))


def _triplet_rows(c):
    """Sector means as targets; the previous three-session mean of every ticker as feature."""
    y = c.pred.groupBy(F.col("sector").alias("target"), "date").agg(F.avg("ret").alias("y"))
    n = c.pred.select(F.col("ticker").alias("feature"), "date", windows.mean_over("ret", 3).alias("_m"))
    return n.select("feature", "date", F.lag("_m").over(by("feature")).alias("value")), y


@query("m16_best_triplets", stage="pred", oracle=sql("pred", f""",
x0 AS (SELECT ticker, date, CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN avg(ret) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS v FROM pred),
xl AS (SELECT ticker, date, lag(v) OVER ({W}) AS v FROM x0), y0 AS (SELECT sector, date, avg(ret) AS y FROM pred GROUP BY 1, 2 HAVING avg(ret) IS NOT NULL),
ys AS (SELECT sector, date, y - avg(y) OVER (PARTITION BY sector) AS y FROM y0), n AS (SELECT sector, sum(y * y) AS yy FROM ys GROUP BY 1),
xs AS (SELECT ys.sector, ticker, xl.date, y, v - avg(v) OVER (PARTITION BY ys.sector, ticker) AS v FROM xl JOIN ys ON ys.date = xl.date WHERE v IS NOT NULL),
f AS (SELECT sector, ticker, sum(v * y) AS c, dense_rank() OVER (PARTITION BY sector ORDER BY ticker) AS id FROM xs GROUP BY 1, 2),
g AS (SELECT p.sector, p.ticker AS i, q.ticker AS j, coalesce(s, 0) AS g FROM f p JOIN f q ON p.sector = q.sector
  LEFT JOIN (SELECT a.sector, a.ticker AS i, b.ticker AS j, sum(a.v * b.v) AS s FROM xs a JOIN xs b ON a.sector = b.sector AND a.date = b.date GROUP BY 1, 2, 3) z ON z.sector = p.sector AND z.i = p.ticker AND z.j = q.ticker),
h AS (SELECT g.sector, g.i, g.j, ci.c + cj.c AS c, gi.g + gj.g + 2 * g.g AS g2 FROM g JOIN f ci ON ci.sector = g.sector AND ci.ticker = g.i JOIN f cj ON cj.sector = g.sector AND cj.ticker = g.j
  JOIN g gi ON gi.sector = g.sector AND gi.i = g.i AND gi.j = g.i JOIN g gj ON gj.sector = g.sector AND gj.i = g.j AND gj.j = g.j WHERE g.i < g.j),
t AS (SELECT h.sector AS target, h.i AS first, h.j AS second, ik.j AS third, power(h.c + ck.c, 2) / nullif(h.g2 + gk.g + 2 * (ik.g + jk.g), 0) / yy AS r2
  FROM h JOIN g ik ON ik.sector = h.sector AND ik.i = h.i AND ik.j > h.j JOIN g jk ON jk.sector = h.sector AND jk.i = h.j AND jk.j = ik.j
  JOIN g gk ON gk.sector = h.sector AND gk.i = ik.j AND gk.j = ik.j JOIN f ck ON ck.sector = h.sector AND ck.ticker = ik.j JOIN n ON n.sector = h.sector)
SELECT target, first, second, third, round(r2, 6) AS r2, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY r2 DESC, first, second, third) AS rank FROM t WHERE r2 IS NOT NULL) WHERE rank <= 5"""))
def _(c):
    return m.best_triplets(*_triplet_rows(c), 5)


PRIORS = {"_RSI": -0.05, "_ADX": 0.02, "_PLUS_DI": 0.04, "_MINUS_DI": -0.03, "_ATR": 0.01, "_RET": 0.0}


@query("m17_dual_head", stage="weekly")
def _(c):
    f = c.weekly_features
    rows = m.design(_selected(c, 5, features=f), c.weekly.select(F.col("ticker").alias("target"), "date", F.col("ret").alias("y")), "target").withColumnRenamed("target", "ticker")
    priors = F.transform("names", lambda n: m.prior_for(n, PRIORS))
    sc = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("ticker")).agg(
        (F.avg("s_acctbal") / 20000).alias("intercept_prior"))
    return m.dual_head(rows.withColumn("priors", priors).join(sc, "ticker"))


@query("m18_prior_lookup", sql("bars", FEATURES + """SELECT DISTINCT ticker || '_' || feature AS feature, CASE feature WHEN 'RSI' THEN -0.05 WHEN 'ADX' THEN 0.02 WHEN 'PLUS_DI' THEN 0.04 WHEN 'MINUS_DI' THEN -0.03 WHEN 'ATR' THEN 0.01 ELSE 0 END::DOUBLE AS prior FROM features"""))
def _(c):
    f = c.features.select(s.feature_key().alias("feature")).distinct()
    return f.select("feature", m.prior_for(F.col("feature"), PRIORS).alias("prior"))


@query("m19_ewma_volatility", sql("pred", f""", z AS (SELECT ticker, date, ret * ret AS q, CAST(row_number() OVER ({W}) - 1 AS DOUBLE) AS i FROM pred WHERE ret IS NOT NULL),
v AS (SELECT ticker, date, sqrt(sum(CASE WHEN i = 0 THEN q ELSE q * 0.06 END * power(1 / 0.94, i)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / power(1 / 0.94, i)) AS s FROM z)
SELECT ticker, date, round(lag(s) OVER ({W}), 6) AS next_vol FROM v"""))
def _(c):
    return m.ewma_volatility(c.pred).select("ticker", "date", "next_vol")


def _regime_rows(c):
    names = ["RSI", "ADX", "RET"]
    return c.features.groupBy("ticker", "date").agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])


_STATES = FEATURES + f""", f3 AS (SELECT ticker, date, max(value) FILTER (feature = 'RSI') AS x1, max(value) FILTER (feature = 'ADX') AS x2, max(value) FILTER (feature = 'RET') AS x3 FROM features GROUP BY 1, 2),
f4 AS (SELECT *, lead(x3) OVER ({W}) AS nxt FROM f3)"""
_SCALED = ", ".join(f"(x{i} - avg(x{i}) OVER ()) / stddev_samp(x{i}) OVER () AS z{i}" for i in (1, 2, 3))
_PAIRS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]


def _mixture_sql(rounds: int = 8) -> str:
    """Expectation-maximisation of three Gaussians, one pair of expressions per round."""
    out = [f", z AS MATERIALIZED (SELECT ticker, date, nxt, {_SCALED} FROM f4 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND nxt IS NOT NULL)"]
    start = [f"1.0::DOUBLE / 3 AS w{s}, " + ", ".join(f"{s - 1}::DOUBLE AS m{s}{i}" for i in (1, 2, 3)) + ", " + ", ".join(f"{int(i == j)}::DOUBLE AS c{s}{i}{j}" for i, j in _PAIRS) for s in range(3)]
    out.append(f"p0 AS MATERIALIZED (SELECT {', '.join(start)})")
    for t in range(rounds + 1):
        dets, inv = [], []
        for s in range(3):
            a, b, c, d, e, f = (f"c{s}{i}{j}" for i, j in _PAIRS)  # 11 12 13 22 23 33
            dets.append(f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c})) AS det{s}")
            inv.append(f"({d} * {f} - {e} * {e}) AS i{s}11, ({c} * {e} - {b} * {f}) AS i{s}12, ({b} * {e} - {c} * {d}) AS i{s}13, ({a} * {f} - {c} * {c}) AS i{s}22, ({b} * {c} - {a} * {e}) AS i{s}23, ({a} * {d} - {b} * {b}) AS i{s}33")
        out.append(f"v{t} AS MATERIALIZED (SELECT *, {', '.join(dets)}, {', '.join(inv)} FROM p{t})")
        dens = []
        for s in range(3):
            quad = " + ".join(f"{1 if i == j else 2} * i{s}{i}{j} / det{s} * (z{i} - m{s}{i}) * (z{j} - m{s}{j})" for i, j in _PAIRS)
            dens.append(f"-0.5 * ({quad}) + ln(w{s}) - 0.5 * ln(det{s}) AS l{s}")
        out.append(f"l{t} AS MATERIALIZED (SELECT ticker, date, nxt, z1, z2, z3, {', '.join(dens)} FROM z, v{t})")
        if t == rounds:
            break
        out.append(f"e{t} AS (SELECT *, " + ", ".join(f"exp(l{s} - greatest(l0, l1, l2)) AS e{s}" for s in range(3)) + f" FROM l{t})")
        sums = [f"sum(e{s} / (e0 + e1 + e2)) AS n{s}, " + ", ".join(f"sum(e{s} / (e0 + e1 + e2) * z{i}) AS a{s}{i}" for i in (1, 2, 3)) + ", "
                + ", ".join(f"sum(e{s} / (e0 + e1 + e2) * z{i} * z{j}) AS b{s}{i}{j}" for i, j in _PAIRS) for s in range(3)]
        out.append(f"q{t} AS (SELECT {', '.join(sums)} FROM e{t})")
        new = [f"n{s} / (n0 + n1 + n2) AS w{s}, " + ", ".join(f"a{s}{i} / n{s} AS m{s}{i}" for i in (1, 2, 3)) + ", "
               + ", ".join(f"b{s}{i}{j} / n{s} - a{s}{i} / n{s} * (a{s}{j} / n{s}) + {1e-6 if i == j else 0} AS c{s}{i}{j}" for i, j in _PAIRS) for s in range(3)]
        out.append(f"p{t + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM q{t})")
    return ", ".join(out) + f", lab AS (SELECT ticker, date, nxt, CASE WHEN l0 >= l1 AND l0 >= l2 THEN '0' WHEN l1 >= l2 THEN '1' ELSE '2' END AS state FROM l{rounds})"


@query("m20_regimes", sql("bars", _STATES + _mixture_sql() + f""", mn AS (SELECT state, avg(nxt) AS mean_ret, count(*) AS n FROM lab GROUP BY 1), mo AS (SELECT *, row_number() OVER (ORDER BY mean_ret, state) AS k FROM mn),
tr AS (SELECT lag(state) OVER ({W}) AS a, state AS b FROM lab), ct AS (SELECT a, b, count(*) AS n FROM tr WHERE a IS NOT NULL GROUP BY 1, 2),
gr AS (SELECT a, b FROM (SELECT unnest(['0', '1', '2']) AS a) x, (SELECT unnest(['0', '1', '2']) AS b) y), pr AS (SELECT gr.a, gr.b, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY gr.a) AS p FROM gr LEFT JOIN ct ON ct.a = gr.a AND ct.b = gr.b),
nx AS (SELECT a, sum(p * coalesce(mean_ret, 0)) AS e FROM pr LEFT JOIN mn ON mn.state = pr.b GROUP BY 1)
SELECT mo.state, round(mean_ret, 6) + 0 AS mean_ret, n, CASE k WHEN 1 THEN 'BEAR' WHEN 3 THEN 'BULL' ELSE 'NEUTRAL' END AS label, round(e, 6) + 0 AS expected_next FROM mo JOIN nx ON nx.a = mo.state"""))
def _(c):
    d = _regime_rows(c).withColumn("next_ret", F.lead("RET").over(by()))
    return m.regimes(d, ["RSI", "ADX", "RET"], "next_ret")[1]


def _ridge_sql(k: int, penalty: float) -> str:
    """Ridge per (ticker, fold) by a written-out factorisation of the normal equations of ``z`` (z1..zk, v, is_test): CTE ``sol`` with w1..wk."""
    one = range(1, k + 1)
    sums = [f"sum(z{i} * z{j}) + {penalty if i == j else 0} AS g{i}{j}" for i in one for j in range(1, i + 1)] + [f"sum(z{i} * v) AS c{i}" for i in one]
    out = [f"e0 AS (SELECT ticker, fold, {', '.join(sums)} FROM z WHERE NOT is_test GROUP BY 1, 2)"]
    for j in one:
        less = "".join(f" - l{j}{m} * l{j}{m} * d{m}" for m in range(1, j))
        out.append(f"f{j} AS (SELECT *, g{j}{j}{less} AS d{j} FROM e{j - 1})")
        below = [f"(g{i}{j}" + "".join(f" - l{i}{m} * l{j}{m} * d{m}" for m in range(1, j)) + f") / d{j} AS l{i}{j}" for i in range(j + 1, k + 1)]
        below.append(f"c{j}" + "".join(f" - l{j}{m} * u{m}" for m in range(1, j)) + f" AS u{j}")
        out.append(f"e{j} AS (SELECT *, {', '.join(below)} FROM f{j})")
    for j in reversed(one):
        back = "".join(f" - l{m}{j} * w{m}" for m in range(j + 1, k + 1))
        out.append(f"{'sol' if j == 1 else f'b{j}'} AS (SELECT *, u{j} / d{j}{back} AS w{j} FROM {f'e{k}' if j == k else f'b{j + 1}'})")
    return ", ".join(out)


_FIVE = range(1, 6)


@query("m21_walk_forward", stage="bars", oracle=sql("bars", FEATURES + """, ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
bk AS (SELECT date, CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END AS b FROM ds), ro AS (SELECT date, fold, fold = b AS is_test FROM (SELECT date, b, unnest(generate_series(greatest(b, 1), 5)) AS fold FROM bk)),
fl AS (SELECT ticker || '_' || feature AS predictor, date, lag(value) OVER (PARTITION BY ticker, feature ORDER BY date) AS x FROM features), rr AS (SELECT ticker, fold, is_test, tr2.date, ret FROM tr2 JOIN ro ON ro.date = tr2.date WHERE ret IS NOT NULL),
g AS (SELECT ticker, fold, predictor, corr(ret, x) AS c, count(*) AS n FROM rr JOIN fl ON fl.date = rr.date WHERE NOT is_test AND x IS NOT NULL GROUP BY 1, 2, 3),
tk AS (SELECT ticker, fold, predictor, row_number() OVER (PARTITION BY ticker, fold ORDER BY predictor) AS j, count(*) OVER (PARTITION BY ticker, fold) AS width
  FROM (SELECT * FROM g WHERE n >= 10 AND isfinite(c) QUALIFY row_number() OVER (PARTITION BY ticker, fold ORDER BY abs(c) DESC, predictor) <= 5)),
dm AS (SELECT ticker, fold, date, any_value(width) AS width, """ + ", ".join(f"coalesce(max(x) FILTER (j = {j}), 0) AS x{j}" for j in _FIVE) + """ FROM tk JOIN fl USING (predictor) WHERE x IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = any_value(width)),
d AS (SELECT dm.*, is_test, ret AS y FROM dm JOIN rr USING (ticker, fold, date)), st AS (SELECT ticker, fold, avg(y) FILTER (NOT is_test) AS my, """ + ", ".join(f"avg(x{j}) FILTER (NOT is_test) AS m{j}, stddev_pop(x{j}) FILTER (NOT is_test) + 1e-8 AS s{j}" for j in _FIVE) + """
  FROM d GROUP BY 1, 2 HAVING count(*) FILTER (NOT is_test) > any_value(width) + 2 AND count(*) FILTER (is_test) >= 2),
z AS (SELECT ticker, fold, is_test, y, y - my AS v, my, """ + ", ".join(f"(x{j} - m{j}) / s{j} AS z{j}" for j in _FIVE) + " FROM d JOIN st USING (ticker, fold)), " + _ridge_sql(5, 5.0) + """,
p AS (SELECT ticker, fold, y, my + """ + " + ".join(f"w{j} * z{j}" for j in _FIVE) + """ AS p FROM z JOIN sol USING (ticker, fold) WHERE is_test),
ev AS (SELECT ticker, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, avg((sign(p) = sign(y))::INT) AS accuracy FROM p GROUP BY 1, 2)
SELECT ticker, round(avg(r2), 6) + 0 AS mean_r2, round(stddev_samp(r2), 6) + 0 AS std_r2, round(avg(accuracy), 6) AS mean_accuracy, count(*) AS folds, CASE WHEN avg(r2) > 0 THEN 'GENERALISES' ELSE 'OVERFIT' END AS verdict FROM ev GROUP BY 1"""))
def _(c):
    ret, lagged = _stage(c)
    # one row, and one series, per target and fold, so a single correlation job selects for all folds
    roles = s.gather(fold_rows(ret, 5), ["ticker", "fold"], "is_test").withColumn("target", F.concat_ws("|", "ticker", F.col("fold").cast("string")))
    train = roles.select(F.col("target").alias("series"), *s.present("is_test")).filter("size(days) > 0")
    top = s.top_k_packed(train, lagged, 5, min_obs=10)
    rows = s.selected_rows(top, lagged, packed=True)
    d = m.design(rows, roles.withColumnRenamed("values", "y"), "target")
    res = m.linear_per_group(d.drop("target"), ["ticker", "fold"], penalty=5.0)
    return fold_summary(res.withColumnRenamed("test_r2", "r2"), "ticker")


def _clusters_sql(k: int = 5, rounds: int = 10) -> str:
    """Lloyd's rounds: the nearest centre of every row, then the mean of every centre's rows."""
    start = ", ".join(f"{1.5 * (2 * j / (k - 1) - 1)}::DOUBLE AS c{j}{i}" for j in range(k) for i in (1, 2, 3))
    out = [f", z AS MATERIALIZED (SELECT x1, {_SCALED} FROM f4 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)", f"c0 AS MATERIALIZED (SELECT {start})"]
    for t in range(rounds + 1):
        dist = ", ".join("[" * (j == 0) + " + ".join(f"(z{i} - c{j}{i}) * (z{i} - c{j}{i})" for i in (1, 2, 3)) + "]" * (j == k - 1) for j in range(k))
        out.append(f"d{t} AS MATERIALIZED (SELECT *, list_position(q, list_min(q)) - 1 AS cluster FROM (SELECT z.*, c{t}.*, {dist} AS q FROM z, c{t}))")
        if t < rounds:
            new = ", ".join(f"coalesce(avg(z{i}) FILTER (cluster = {j}), any_value(c{j}{i})) AS c{j}{i}" for j in range(k) for i in (1, 2, 3))
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT {new} FROM d{t})")
    return ", ".join(out)


@query("m22_clusters", sql("bars", _STATES + _clusters_sql() + " SELECT cluster, count(*) AS n, round(avg(x1), 6) AS mean_rsi FROM d10 GROUP BY 1"))
def _(c):
    d = m.clusters(_regime_rows(c), ["RSI", "ADX", "RET"], 5)
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("RSI").alias("mean_rsi"))


@query("m23_scorecard", sql("pred macro", f""", x AS (SELECT ticker, p.date, p_up, exp_ret, exp_vol, lead(ret) OVER (PARTITION BY ticker ORDER BY p.date) AS actual_ret, vix_close,
  CASE WHEN p_up > 0.65 THEN 'Buy' WHEN p_up < 0.35 THEN 'Sell' ELSE 'Hold' END AS rec, CASE WHEN p_up > 0.65 AND exp_ret > 0 THEN least(1, coalesce(greatest(0, p_up - (1 - p_up) / (exp_ret / nullif(exp_vol, 0))), 0)) ELSE 0 END AS k
  FROM pred p LEFT JOIN macro m ON p.date = m.date WHERE p_up IS NOT NULL AND exp_ret IS NOT NULL)
SELECT ticker, date, rec AS recommendation, round(k, 6) + 0 AS kelly, CASE WHEN p_up > 0.5 THEN 'Up' ELSE 'Down' END AS predicted_direction, CASE WHEN actual_ret IS NULL THEN 'Pending' WHEN actual_ret > 0 THEN 'Up' ELSE 'Down' END AS actual_direction,
  CASE WHEN actual_ret IS NULL THEN 'Pending' WHEN rec = 'Hold' THEN 'Hold' WHEN (rec = 'Buy' AND actual_ret > 0) OR (rec = 'Sell' AND actual_ret <= 0) THEN 'On target' ELSE 'Miss' END AS hit,
  CASE WHEN rec = 'Buy' AND vix_close > 30 THEN 'VETO: volatility index above 30' WHEN rec = 'Buy' AND k = 0 THEN 'VETO: zero stake at P(UP)=' || format('{{:.1f}}', round(p_up * 100, 1)) || '%' ELSE '' END AS note FROM x"""))
def _(c):
    d = c.pred.join(c.macro.select("date", "vix_close"), "date", "left").withColumn("actual_ret", F.lead("ret").over(by()))
    out = m.assemble_scorecard(d.filter("p_up is not null and exp_ret is not null"))
    return out.select("ticker", "date", "recommendation", "kelly", "predicted_direction", "actual_direction", "hit", "note")


@query("m24_lag_grid", sql("pred", f""", x AS (SELECT ticker, ret, lag(ret) OVER ({W}) AS l1, lag(ret, 2) OVER ({W}) AS l2, lag(ret, 3) OVER ({W}) AS l3 FROM pred)
""" + " UNION ALL ".join(f"SELECT ticker, '{t}' AS target_kind, {i} AS lag, count(*) AS n, round(regr_r2({y}, l{i}), 6) AS r2, round(avg((sign({y}) = sign(l{i}))::INT), 6) AS direction_accuracy FROM x WHERE ret IS NOT NULL AND l{i} IS NOT NULL GROUP BY 1"
                        for t, y in (("return", "ret"), ("size", "abs(ret)")) for i in (1, 2, 3))))
def _(c):
    return m.lag_grid(c.pred)


@query("m25_ordered_funds", sql("weights", "SELECT etf, round(sum(weight * s_acctbal) / sum(weight), 6) AS weighted_score, count(*) AS n FROM weights JOIN supplier ON ticker = 'S' || s_suppkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(c):
    sc = c.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_acctbal").alias("score"))
    return m.ordered_funds(c.weights, sc)


@query("m26_scale_on_train", stage="bars", oracle=sql("bars", f""", x AS (SELECT *, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY ticker) * 0.8) AS tr FROM bars), s AS (SELECT ticker, min(close) FILTER (tr) AS lo, max(close) FILTER (tr) AS hi FROM x GROUP BY 1)
SELECT x.ticker, date, round((close - lo) / nullif(hi - lo, 0), 6) + 0 AS close_scaled FROM x JOIN s ON x.ticker = s.ticker"""))
def _(c):
    return m.scale_on_train(windows.chronological_split(c.bars, train_share=0.8), "close", "is_train").select("ticker", "date", "close_scaled")


@query("m27_squash_and_shift", sql("pred", "SELECT ticker, date, round(1 / (1 + exp(-100 * exp_ret / 50)), 6) AS squashed, round((p_up - 0.5) * 4, 6) + 0 AS shift FROM pred"))
def _(c):
    from ..functions.scalars import prior_shift, squash
    return c.pred.select("ticker", "date", squash(F.col("exp_ret") / 50).alias("squashed"), prior_shift(F.col("p_up")).alias("shift"))


@query("m28_merge_signals", sql("pred", """, e AS (SELECT ticker, date, p_up AS score, 'momentum' AS engine FROM pred UNION ALL SELECT ticker, date, exp_ret, 'trend' FROM pred UNION ALL SELECT ticker, date, -exp_vol, 'calm' FROM pred)
SELECT engine, date, ticker, round(score, 6) + 0 AS score, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY engine, date ORDER BY score DESC, ticker) AS rn FROM e WHERE score IS NOT NULL) WHERE rn <= 3"""))
def _(c):
    p = c.pred
    return m.merge_signals({"momentum": p.withColumn("score", F.col("p_up")), "trend": p.withColumn("score", F.col("exp_ret")),
                            "calm": p.withColumn("score", -F.col("exp_vol"))}, 3).select("engine", "date", "ticker", "score", "place")
