"""F: scalar functions, exercised over the tables."""

from pyspark.sql import functions as F

from ..functions import dates as fd
from ..functions import scalars as s
from ..functions import variants
from ..session import scratch_path
from .registry import query
from .sqltext import closed_days, r, sql


@query("f1_arithmetic", f"""WITH x AS (SELECT event_id, abs(value - 50) AS a, sign(value - 50) AS sg, sqrt(value) AS rt, exp(-value / 100) AS ex, ln(value) AS lg,
  greatest(10, least(100, value)) AS cl, floor(value / 7) AS fd FROM events) SELECT event_id, {r('a', 'rt', 'ex', 'lg')}, sg::DOUBLE AS sg, cl, fd::BIGINT AS fd FROM x""")
def _(c):
    v = F.col("value")
    return c.table("events").select("event_id", F.abs(v - 50).alias("a"), F.signum(v - 50).alias("sg"), F.sqrt(v).alias("rt"), F.exp(-v / 100).alias("ex"),
                                    F.ln(v).alias("lg"), s.clip(v, 10.0, 100.0).alias("cl"), F.floor(v / 7).alias("fd"))


@query("f2_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS sig, round(1 / (1 + exp(-100 * (value - 50) / 1000)), 6) AS squash, round((value / 500 - 0.5) * 4, 6) + 0 AS shift FROM events")
def _(c):
    v = F.col("value")
    return c.table("events").select("event_id", s.sigmoid(v / 100).alias("sig"), s.squash((v - 50) / 1000).alias("squash"), s.prior_shift(v / 500).alias("shift"))


@query("f3_nested_when", "SELECT event_id, CASE WHEN value >= 100 THEN 'Extreme Panic' WHEN value >= 30 THEN 'High Volatility' ELSE 'Complacency / Calm' END AS level FROM events")
def _(c):
    v = F.col("value")
    return c.table("events").select("event_id", F.when(v >= 100, "Extreme Panic").when(v >= 30, "High Volatility").otherwise("Complacency / Calm").alias("level"))


@query("f4_null_handling", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE value END AS cleaned, event_id % 5 = 2 AS missing FROM events""")
def _(c):
    k = F.col("event_id") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value"))
    return c.table("events").select("event_id", s.clean_number(x).alias("cleaned"), x.isNull().alias("missing"))


@query("f5_strings", """SELECT p_partkey, replace(p_name, ' ', '-') AS rep, upper(trim(p_type)) AS up, contains(p_name, 'ring') AS has, starts_with(p_brand, 'Brand#1') AS pre, suffix(p_name, 't') AS suf,
  string_split(p_name, ' ')[1] AS word, regexp_extract(p_brand, '#([0-9]+)', 1) AS num, p_type || '|' || p_brand AS joined, p_brand || ' at ' || format('{:.2f}', p_retailprice) AS text FROM part""")
def _(c):
    n, b = F.col("p_name"), F.col("p_brand")
    return c.table("part").select(
        "p_partkey", F.replace(n, F.lit(" "), F.lit("-")).alias("rep"), F.upper(F.trim("p_type")).alias("up"), n.contains("ring").alias("has"),
        b.startswith("Brand#1").alias("pre"), n.endswith("t").alias("suf"), F.split(n, " ")[0].alias("word"), F.regexp_extract(b, "#([0-9]+)", 1).alias("num"),
        F.concat_ws("|", "p_type", b).alias("joined"), F.format_string("%s at %.2f", b, F.col("p_retailprice")).alias("text"))


@query("f6_feature_names", """SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN NULL ELSE 'S' || l_suppkey END AS ticker, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_linenumber END AS lag, count(*) AS n
  FROM lineitem GROUP BY 1, 2""")
def _(c):
    g = c.table("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") > 3, "_RSI").otherwise(
        F.concat(F.lit("_Lag"), F.col("l_linenumber").cast("string"))))
    return g.select("l_suppkey", "l_linenumber", s.feature_ticker(name).alias("ticker"), s.feature_lag(name).alias("lag"), "n")


@query("f7_number_text", """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(s_acctbal)) AS money, format('{:,.1f}', round(s_suppkey * 1.37, 1)) || '%' AS pct FROM supplier""")
def _(c):
    return c.table("supplier").select("s_suppkey", s.dollars_text(F.col("s_acctbal")).alias("money"), s.percent_text(F.round(F.col("s_suppkey") * 1.37, 1)).alias("pct"))


@query("f8_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, dayname(o_orderdate) AS name, isodow(o_orderdate) - 1 AS weekday, month(o_orderdate) AS month,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""")
def _(c):
    d = F.col("o_orderdate")
    return c.table("orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("day"), F.date_format(d, "EEEE").alias("name"), F.weekday(d).alias("weekday"),
                                    F.month(d).alias("month"), F.to_date(F.trunc(d, "month")).alias("month_start"))


@query("f9_date_arithmetic", """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, d + 30 AS plus_30, CAST(d - INTERVAL 14 MONTH AS DATE) AS minus_14_months, CAST(CASE WHEN isodow(d) < 6 THEN d ELSE d - CAST(isodow(d) - 5 AS INTEGER) END + 7 AS DATE) AS plus_5_business,
  CAST(CASE isodow(d) WHEN 6 THEN d - 3 WHEN 7 THEN d - 4 ELSE d - CASE WHEN isodow(d) <= 3 THEN 5 ELSE 3 END END AS DATE) AS minus_3_business FROM d""")
def _(c):
    d = F.to_date("o_orderdate")
    return c.table("orders").select("o_orderkey", F.date_add(d, 30).alias("plus_30"), F.add_months(d, -14).alias("minus_14_months"),
                                    fd.add_business_days(d, 5).alias("plus_5_business"), fd.add_business_days(d, -3).alias("minus_3_business"))


@query("f10_business_range", sql("gappy", """, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM gappy GROUP BY 1), d AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT ticker, date FROM d WHERE isodow(date) < 6"""))
def _(c):
    sp = c.gappy.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return sp.select("ticker", F.explode(fd.business_days(F.col("a"), F.col("b"))).alias("date"))


_HOL = closed_days()


@query("f11_session_calendar", f"""WITH s AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events), c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS session FROM s),
o AS (SELECT session, isodow(session) < 6 AND session NOT IN ({_HOL}) AS is_open FROM c)
SELECT session, is_open, CAST(count(*) FILTER (is_open) OVER (ORDER BY session) AS BIGINT) AS session_no, max(session) FILTER (is_open) OVER (ORDER BY session) AS last_session,
  max(session) FILTER (is_open) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_session,
  min(session) FILTER (is_open) OVER (ORDER BY session ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session FROM o""")
def _(c):
    return fd.session_calendar(c.ticks)


@query("f11_order_calendar", f"""WITH s AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders), c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS session FROM s)
SELECT session, isodow(session) < 6 AND session NOT IN ({_HOL}) AS is_open FROM c""")
def _(c):
    return fd.session_calendar(c.table("orders").select(F.to_date("o_orderdate").alias("date"))).select("session", "is_open")


@query("f11_missed_sessions", sql("gappy", f""", s AS (SELECT min(date) AS a, max(date) AS b FROM gappy), cal AS (SELECT CAST(unnest(generate_series(a - 7, b + 7, INTERVAL 1 DAY)) AS DATE) AS session FROM s),
o AS (SELECT session FROM cal WHERE isodow(session) < 6 AND session NOT IN ({_HOL})), e AS (SELECT (SELECT max(session) FROM o WHERE session <= b) AS last, (SELECT min(session) FROM o WHERE session > b) AS next FROM s),
w AS (SELECT ticker, max(date) AS done, max(date) + CAST(max(volume) AS INTEGER) AS staged FROM gappy GROUP BY 1)
SELECT ticker, session FROM w, e, o WHERE session <= last AND CASE WHEN done < last THEN session > done ELSE session = last AND staged <> next END"""))
def _(c):
    b = c.gappy
    span = b.agg(F.date_sub(F.min("date"), 7).alias("a"), F.date_add(F.max("date"), 7).alias("b"))
    cal = span.select(F.explode(F.sequence("a", "b")).alias("session")).withColumn("is_open", fd.is_open(F.col("session")))
    done = b.groupBy("ticker").agg(F.max("date").alias("last_completed_date"), F.max("volume").alias("v"))
    staged = done.select("ticker", F.date_add("last_completed_date", F.col("v").cast("int")).alias("date"))
    return fd.missed_sessions(done, cal, b.agg(F.max("date")).scalar(), staged, "ticker")


@query("f12_exchange_time", """SELECT event_id, ts - INTERVAL 5 HOUR AS local_ts, round(greatest(1, hour(ts - INTERVAL 5 HOUR) * 60.0 + minute(ts) + second(ts) / 60.0 - 570), 6) AS minutes,
  round(1000000.0 * (greatest(1, hour(ts - INTERVAL 5 HOUR) * 60.0 + minute(ts) + second(ts) / 60.0 - 570) / 390), 4) AS expected FROM events""")
def _(c):
    loc = fd.exchange_time(F.col("ts"))
    m = fd.minutes_since_open(loc)
    return c.table("events").select("event_id", loc.alias("local_ts"), m.alias("minutes"), F.round(fd.expected_volume(F.lit(1e6), m), 4).alias("expected"))


@query("f13_arrays", sql("gappy", """, a AS (SELECT ticker, list(CAST(day(date) AS BIGINT) ORDER BY date) AS l FROM gappy GROUP BY 1)
SELECT ticker, len(l) AS n, list_sum(l[1:3])::BIGINT AS first3, len(list_distinct(list_transform(l, lambda x: x % 7))) AS kinds, l[len(l)] AS top, list_sum(list_transform(l, lambda x: x % 7))::BIGINT AS total FROM a"""))
def _(c):
    # one array per ticker, as long as its sessions
    a = c.gappy.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", F.day("date").cast("bigint").alias("d")))).alias("s"))
    l_ = F.col("s")["d"]
    m = F.transform(l_, lambda x: x % 7)
    z = F.arrays_zip(l_.alias("a"), m.alias("b"))
    add = lambda acc, x: acc + x
    zero = F.lit(0).cast("bigint")
    return a.select("ticker", F.size(z).alias("n"), F.aggregate(F.slice(l_, 1, 3), zero, add).alias("first3"),
                    F.size(F.array_distinct(m)).alias("kinds"), F.element_at(l_, -1).alias("top"),
                    F.aggregate(F.flatten(F.array(m, F.array_repeat(zero, 2))), zero, add).alias("total"))


@query("f14_maps", sql("positions", """SELECT persona, date, count(*) AS n, round(sum(pnl), 2) + 0 AS total, round(coalesce(max(pnl) FILTER (ticker = 'MACHINERY'), 0), 2) + 0 AS machinery,
  count(*) FILTER (pnl > 0) AS winners, round(sum(dollars), 2) AS held FROM positions GROUP BY 1, 2"""))
def _(c):
    m = F.col("daily_pnl")
    return c.ledger.select("persona", "date", F.size(F.map_keys(m)).alias("n"), F.round(s.map_total(m), 2).alias("total"),
                           F.coalesce(F.try_element_at(m, F.lit("MACHINERY")), F.lit(0.0)).alias("machinery"),
                           F.size(F.map_filter(m, lambda _, v: v > 0)).alias("winners"), F.round(s.holdings_total(F.col("holdings")), 2).alias("held"))


@query("f15_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"v\":\"' || event_type || '\"}' AS out FROM events")
def _(c):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return c.table("events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("v"))).alias("out"))


@query("f16_tolerant_parse", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, CASE event_id % 3 WHEN 2 THEN 0 ELSE 1 END AS n FROM events""")
def _(c):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.replace("props", F.lit('"'), F.lit("'"))).otherwise("not a map")
    m = s.tolerant_map(raw)
    return c.table("events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(m).alias("n"))


@query("f17_flatten_nested", sql("sectors", "SELECT sector, ticker FROM sectors"))
def _(c):
    # each row carries a nested map of lists; members are never gathered per sector
    m = c.sectors.select("sector", F.create_map("industry", F.array("ticker", "ticker")).alias("m"))
    return m.select("sector", F.explode(s.flatten_lists(F.col("m"))).alias("ticker"))


@query("f18_mixed_values", sql("positions", """SELECT persona, date, ticker, round(dollars, 2) AS dollars, CASE WHEN ticker < 'F' THEN 0 ELSE units END AS units FROM positions"""))
def _(c):
    p = c.positions
    obj = F.to_json(F.struct("dollars", "units", "price"))
    entry = F.concat(F.lit('"'), F.col("ticker"), F.lit('":'), F.when(F.col("ticker") < "F", F.col("dollars").cast("decimal(18,2)").cast("string")).otherwise(obj))
    text = p.groupBy("persona", "date").agg(F.concat(F.lit("{"), F.concat_ws(",", F.sort_array(F.collect_list(entry))), F.lit("}")).alias("t"))
    return text.select("persona", "date", F.explode(s.mixed_holdings(F.col("t"))).alias("ticker", "h")).select(
        "persona", "date", "ticker", "h.dollars", "h.units")


@query("f18_variant_values", sql("positions", """SELECT persona, date, ticker, round(dollars, 2) AS dollars, CASE WHEN ticker < 'F' THEN 0 ELSE units END AS units FROM positions"""))
def _(c):
    p = c.positions
    obj = F.to_json(F.struct("dollars", "units", "price"))
    entry = F.concat(F.lit('"'), F.col("ticker"), F.lit('":'), F.when(F.col("ticker") < "F", F.col("dollars").cast("decimal(18,2)").cast("string")).otherwise(obj))
    text = p.groupBy("persona", "date").agg(F.concat(F.lit("{"), F.concat_ws(",", F.sort_array(F.collect_list(entry))), F.lit("}")).alias("t"))
    held = text.select("persona", "date", variants.parsed(F.col("t")).alias("v"))
    path = scratch_path(c.spark, "variants")
    variants.write_shredded(held, path)
    rows = variants.members(variants.read_shredded(c.spark, path, held.schema), "v", ["persona", "date"])
    return rows.select("persona", "date", F.col("key").alias("ticker"), *variants.holding(F.col("value"))[:2])


@query("f19_prefix_match", sql("ledger", "SELECT persona, date, persona LIKE 'etf\\_%' ESCAPE '\\' AS is_etf, CAST(date AS VARCHAR) LIKE '1996-%' AS in_1996 FROM ledger"))
def _(c):
    return c.ledger.select("persona", "date", F.col("persona").startswith("etf_").alias("is_etf"), F.col("date").cast("string").startswith("1996-").alias("in_1996"))
