"""SQL counterparts of the base frames, as chained common table expressions."""

from __future__ import annotations


def closed_days(first: int = 1990, last: int = 2035) -> str:
    """Date literals of the exchange's closed weekdays, from rules of their own."""
    from pandas.tseries import holiday as h

    from ..functions.dates import CLOSURES

    rules = [h.Holiday("new year", month=1, day=1, observance=h.sunday_to_monday), h.USPresidentsDay, h.GoodFriday, h.USMemorialDay,
             h.Holiday("king", month=1, day=1, offset=h.DateOffset(weekday=h.MO(3)), start_date="1998-01-01"),
             h.Holiday("june", month=6, day=19, observance=h.nearest_workday, start_date="2022-01-01"),
             h.Holiday("july", month=7, day=4, observance=h.nearest_workday), h.USLaborDay, h.USThanksgivingDay,
             h.Holiday("christmas", month=12, day=25, observance=h.nearest_workday)]
    found = h.AbstractHolidayCalendar("exchange", rules=rules).holidays(f"{first}-01-01", f"{last}-12-31")
    return ", ".join(f"DATE '{d}'" for d in sorted({*found.strftime("%Y-%m-%d"), *CLOSURES}))


def r(*names: str, places: int = 6) -> str:
    """Rounded select items; adding zero turns a negative zero into zero."""
    return ", ".join(f"round({n}, {places}) + 0 AS {n}" for n in names)


_TICKS = """ticks AS (SELECT event_type AS ticker, ts, event_id AS seq, value AS price, 1.0 AS size,
  CAST(ts AS DATE) AS date, 'U' || user_id AS "user", props FROM events)"""

_DENSE = """dense AS (SELECT ticker, date, arg_min(price, row(ts, seq)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, row(ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks GROUP BY ticker, date)"""

_GAPPY = """gappy AS (SELECT "user" AS ticker, date, arg_min(price, row(ts, seq)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY "user", date)"""

_BARS = """lt AS (SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  sqrt(l_extendedprice / l_quantity) AS price, l_quantity AS size,
  row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem),
bars AS (SELECT ticker, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, k) AS close, sum(size) AS volume FROM lt GROUP BY ticker, date)"""

_SECTORS = """sectors AS (SELECT 'S' || s_suppkey AS ticker, n_name AS industry, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_PANEL = "panel AS (SELECT b.*, s.industry, s.sector FROM bars b JOIN sectors s ON b.ticker = s.ticker)"

_MACRO = """macro AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  round(arg_min(o_totalprice, row(o_orderdate, o_orderkey)) / 9973, 4) AS vix_close,
  round(avg(o_totalprice) / 99991, 4) AS tnx_close,
  round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / 997, 4) AS irx,
  round(avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 997, 4) AS hyg,
  round(avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') / 997, 4) AS ief,
  round(avg(o_totalprice) FILTER (o_orderpriority = '4-NOT SPECIFIED') / 997, 4) AS sphb,
  round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') / 997, 4) AS splv,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'O') / 997, 4) AS oil,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'F') / 997, 4) AS copper,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'P') / 997, 4) AS usd
  FROM orders GROUP BY 1)"""

_PRED = """pr AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel),
pred AS (SELECT ticker, sector, date, open, high, low, close, volume, ret,
  round(1 / (1 + exp(-4 * lag(ret) OVER (PARTITION BY ticker ORDER BY date))), 6) AS p_up,
  round(avg(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS exp_ret,
  round(stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS exp_vol
  FROM pr)"""

_WEEKLY = """wt AS (SELECT n_name AS ticker, r_name AS sector, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sqrt(l_extendedprice / l_quantity) AS price,
  l_quantity AS size, row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
wb AS (SELECT ticker, sector, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume FROM wt GROUP BY 1, 2, 3),
weekly AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM wb)"""

_POSITIONS = """pm AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'aggressive' WHEN '2-HIGH' THEN 'dynamic'
  WHEN '3-MEDIUM' THEN 'neutral' WHEN '4-NOT SPECIFIED' THEN 'conservative' WHEN '5-LOW' THEN 'etf_neutral' END AS persona,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS date, c_mktsegment AS ticker,
  round(sum(o_totalprice) / 997, 2) AS dollars, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
positions AS (SELECT persona, date, ticker, dollars, CAST(n AS DOUBLE) AS units, round(dollars / n, 9) AS price,
  round(coalesce(dollars - lag(dollars) OVER (PARTITION BY persona, ticker ORDER BY date), 0), 2) AS pnl FROM pm)"""

_LEDGER = """lg AS (SELECT persona, date, round(sum(dollars), 2) AS held, round(sum(pnl), 2) AS pnl
  FROM positions GROUP BY 1, 2),
lg2 AS (SELECT *, round(10000 + sum(pnl) OVER (PARTITION BY persona ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total_equity FROM lg),
ledger AS (SELECT persona, date, round(total_equity - held + CASE WHEN month(date) = 6 THEN 5.0 ELSE 0.0 END, 2) AS cash,
  total_equity, held, pnl, CASE WHEN month(date) % 4 = 0 THEN 'CARRYOVER' ELSE 'SETTLED' END AS intraday_status FROM lg2)"""

_WEIGHTS = """wr AS (SELECT p_type AS etf, 'S' || l_suppkey AS ticker, sum(l_extendedprice) AS rev
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
weights AS (SELECT etf, ticker, round(100 * rev / sum(rev) OVER (PARTITION BY etf), 6) AS weight FROM wr)"""

_PARTS = {
    "ticks": ([], _TICKS),
    "dense": (["ticks"], _DENSE),
    "gappy": (["ticks"], _GAPPY),
    "bars": ([], _BARS),
    "sectors": ([], _SECTORS),
    "panel": (["bars", "sectors"], _PANEL),
    "macro": ([], _MACRO),
    "pred": (["panel"], _PRED),
    "weekly": ([], _WEEKLY),
    "positions": ([], _POSITIONS),
    "ledger": (["positions"], _LEDGER),
    "weights": ([], _WEIGHTS),
}


def sql(uses: str, tail: str) -> str:
    """``WITH`` the named base frames; ``tail`` starts with a select or further CTEs after a comma."""
    order: list[str] = []

    def add(name):
        for d in _PARTS[name][0]:
            add(d)
        if name not in order:
            order.append(name)

    for u in uses.split():
        add(u)
    head = ",\n".join(_PARTS[n][1] for n in order)
    return f"WITH {head}\n{tail.strip()}"
