"""S: sources, sinks and table maintenance, over files derived from the tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import by
from ..functions import variants
from ..functions.dates import session_calendar
from ..operators.joins import densify
from ..session import scratch_path
from ..sources import maintain as m
from ..sources import bucketed, payloads, readers
from ..sources.tables import PERSONAS
from .cleaning import SCORES, scores
from .registry import query
from .sqltext import closed_days, r, sql
from .windows import W

BARS6 = f"SELECT ticker, sector, date, {r('open', 'high', 'low', 'close')}, volume FROM panel"


def _stored(c, df, label, **kw):
    path = scratch_path(c.spark, label)
    readers.write_panel(df, path, **kw)
    return path


@query("s1_read_panel", sql("panel", BARS6))
def _(c):
    p = c.panel.select("ticker", "sector", "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")
    path = _stored(c, p, "panel-csv", fmt="csv")
    return readers.read_panel(c.spark, path, fmt="csv").drop("adj_close")


@query("s2_pick_column", sql("bars macro", "SELECT ticker, b.date, vix_close FROM bars b LEFT JOIN macro m ON b.date = m.date"))
def _(c):
    drifted = c.bars.join(c.macro.select("date", F.col("vix_close").alias("VIX_Close_x")), "date", "left")
    return readers.pick_column(drifted, ["VIX_Close", "VIX_Close_x"], "vix_close").select("ticker", "date", "vix_close")


@query("s3_normalize_headers", sql("bars", """SELECT ticker AS "Ticker_Name", date AS "Date", round(close, 6) AS "Adj_Close" FROM bars"""))
def _(c):
    raw = c.bars.select(F.col("ticker").alias(" Ticker Name"), F.col("date").alias("DATE "), F.col("close").alias("Adj.Close"))
    return readers.normalize_headers(raw)


def _payload(c):
    """One chart payload per ticker; short volume arrays, missing adjusted close, null closes."""
    g = c.gappy.withColumn("t", F.unix_date("date").cast("bigint") * 86400 + 3600)
    close = F.when(F.day("date") % 10 != 0, F.col("close"))
    s = g.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("t", "open", "high", "low", close.alias("close"), "volume"))).alias("r"))
    short = F.slice(F.col("r.volume"), F.lit(1), F.greatest(F.size("r") - 3, F.lit(1)))
    adj = F.when(F.col("ticker") < "U5", F.transform("r", lambda x: x["close"] * 0.5))
    quote = F.struct(F.col("r.open").alias("open"), F.col("r.high").alias("high"), F.col("r.low").alias("low"), F.col("r.close").alias("close"), short.alias("volume"))
    res = F.struct(F.col("r.t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(adj.alias("adjclose"))).alias("adjclose")).alias("indicators"))
    doc = F.struct(F.struct(F.array(res).alias("result")).alias("chart"))
    return s.select("ticker", F.to_json(doc, {"ignoreNullFields": "false"}).alias("raw"))


@query("s4_parse_chart_json", sql("gappy", """, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM gappy)
SELECT ticker, date, open, high, low, close, CASE WHEN i <= greatest(n - 3, 1) THEN volume END AS volume, CASE WHEN ticker < 'U5' THEN round(close * 0.5, 6) ELSE close END AS adj_close FROM x WHERE day(date) % 10 <> 0"""))
def _(c):
    return payloads.parse_chart_json(_payload(c))


@query("s5_parse_record_json", sql("gappy", "SELECT ticker, date, open, high, low, close, volume, close AS adj_close FROM gappy"))
def _(c):
    rec = F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), "open", "high", "low", "close", "volume", F.col("close").alias("adjClose"))
    raw = c.gappy.groupBy("ticker").agg(F.to_json(F.collect_list(rec)).alias("raw"))
    return payloads.parse_record_json(raw)


@query("s5_variant_records", sql("gappy", "SELECT ticker, date, open, high, low, close, CASE WHEN ticker < 'U3' THEN volume END AS volume, close AS adj_close FROM gappy"))
def _(c):
    volume = F.when(F.col("ticker") < "U3", F.col("volume").cast("string")).otherwise("n/a")  # a number as text, or no number
    rec = F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), "open", "high", "low", "close", volume.alias("volume"), F.col("close").alias("adjClose"))
    raw = c.gappy.groupBy("ticker").agg(F.to_json(F.collect_list(rec)).alias("raw"))
    return variants.records(raw.select("ticker", variants.parsed(F.col("raw")).alias("v")), "v")


_LED = T.StructType([T.StructField("date", T.DateType()), T.StructField("cash", T.DoubleType()), T.StructField("total_equity", T.DoubleType())])


@query("s6_read_by_file_name", sql("ledger", "SELECT persona, date, cash, total_equity FROM ledger"))
def _(c):
    path = _stored(c, c.ledger.select("persona", "date", "cash", "total_equity"), "ledgers", partition_by=["persona"], fmt="csv", files_by=["persona"])
    return readers.read_by_file_name(c.spark, path, _LED, r"persona=([^/]+)/", "persona")


@query("s7_symbol_directory", """SELECT replace(p_brand, 'Brand#', 'B') || '-' || p_partkey AS "Symbol", p_name AS "Name", 'Y' AS "ETF" FROM part WHERE p_type LIKE '%ECONOMY%' AND p_partkey % 5 NOT IN (0, 1)""")
def _(c):
    s = F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("B")), F.when(F.col("p_partkey") % 5 == 0, "$").when(F.col("p_partkey") % 5 == 1, ".").otherwise("-"), F.col("p_partkey").cast("string"))
    rows = c.table("part").select(s.alias("Symbol"), F.col("p_name").alias("Name"), F.when(F.col("p_type").contains("ECONOMY"), "Y").otherwise("N").alias("ETF"))
    path = scratch_path(c.spark, "symbols")
    rows.write.option("header", True).option("sep", "|").csv(path)
    return readers.read_symbol_directory(c.spark, path)


@query("s8_merge_sources", stage="gappy", oracle=sql("gappy", """SELECT ticker, date, CASE WHEN day(date) % 3 <> 0 THEN close WHEN day(date) % 2 <> 0 THEN round(close * 2, 6) ELSE round(close * 3, 6) END AS close,
  CASE WHEN day(date) % 3 <> 0 THEN 0 WHEN day(date) % 2 <> 0 THEN 1 ELSE 2 END AS source_rank FROM gappy WHERE NOT (day(date) % 6 = 0 AND ticker > 'U7')
UNION ALL SELECT DISTINCT 'LOST' || c_custkey, NULL::DATE, NULL::DOUBLE, -1 FROM customer WHERE 'U' || c_custkey NOT IN (SELECT ticker FROM gappy)"""))
def _(c):
    g = c.gappy.select("ticker", "date", "close")
    a = g.withColumn("close", F.when(F.day("date") % 3 != 0, F.col("close")))
    b = g.withColumn("close", F.when(F.day("date") % 2 != 0, F.col("close") * 2))
    d = g.filter("not (day(date) % 6 = 0 and ticker > 'U7')").withColumn("close", F.col("close") * 3)
    merged = m.merge_sources(a, b, d)
    lost = m.quarantined(c.table("customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("ticker")), merged)
    return merged.unionByName(lost.select(F.regexp_replace("ticker", "^U", "LOST").alias("ticker"), F.lit(None).cast("date").alias("date"),
                                          F.lit(None).cast("double").alias("close"), F.lit(-1).alias("source_rank")))


@query("s9_melt_vendor_frame", sql("dense", "SELECT date, ticker, open, high, low, close, volume FROM dense"))
def _(c):
    names = ["view", "click", "error", "purchase", "signup"]
    wide = c.dense.groupBy("date").agg(*[F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{f}_{t}")
                                        for t in names for f in ("open", "high", "low", "close", "volume")])
    return readers.melt(wide)


@query("s10_append_increment", stage="gappy", oracle=sql("gappy", """, c AS (SELECT ticker, DATE '2024-01-08' + CAST(length(ticker) AS INTEGER) AS cut FROM gappy GROUP BY 1), o AS (SELECT g.* FROM gappy g JOIN c ON g.ticker = c.ticker AND g.date <= cut), l AS (SELECT ticker, max(date) AS last FROM o GROUP BY 1)
SELECT ticker, date, close FROM o UNION ALL SELECT g.ticker, g.date, round(g.close + 0.5, 6) FROM gappy g LEFT JOIN l ON g.ticker = l.ticker WHERE last IS NULL OR g.date > last"""))
def _(c):
    g = c.gappy.select("ticker", "date", "close")
    cut = F.date_add(F.lit("2024-01-08").cast("date"), F.length("ticker"))
    new = g.withColumn("close", F.col("close") + 0.5)
    return m.append_increment(g.filter(F.col("date") <= cut), new.unionByName(new))


@query("s11_write_panel", sql("panel", BARS6))
def _(c):
    p = c.panel.select("ticker", "sector", "date", "open", "high", "low", "close", "volume")
    path = _stored(c, p, "panel", partition_by=["sector"], files_by=["sector"])
    return c.spark.read.schema(p.schema).parquet(path)


@query("s11_bucketed_panel", sql("panel", f""", x AS (SELECT ticker, sector, date, close, close / lag(close) OVER ({W}) - 1 AS ret, avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5 FROM panel)
SELECT ticker, sector, x.date, round(close, 6) AS close, round(ret, 6) + 0 AS ret, round(mean5, 6) AS mean5, round(peak, 6) AS peak FROM x JOIN (SELECT ticker, max(high) AS peak FROM panel GROUP BY 1) USING (ticker)"""))
def _(c):
    p = bucketed.write_bucketed(c.panel.select("ticker", "sector", "date", "high", "close"))
    w = by()
    peak = p.groupBy("ticker").agg(F.max("high").alias("peak"))
    x = p.select("ticker", "sector", "date", "close", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"), F.avg("close").over(w.rowsBetween(-4, 0)).alias("mean5"))
    return x.join(peak, "ticker")


@query("s12_upsert", sql("ledger", """SELECT persona, date, CASE WHEN year(date) = 1997 AND persona <> 'neutral' THEN round(cash + 2, 2) ELSE cash END AS cash FROM ledger"""))
def _(c):
    led = c.ledger.select("persona", "date", "cash")
    path = _stored(c, led.filter("persona <> 'aggressive'"), "upsert", partition_by=["persona"], files_by=["persona"])
    upd = led.filter("year(date) = 1997 and persona <> 'neutral'")
    first, second = upd.withColumn("cash", F.col("cash") + 1).withColumn("seq", F.lit(1)), upd.withColumn("cash", F.round(F.col("cash") + 2, 2)).withColumn("seq", F.lit(2))
    base = led.filter("persona = 'aggressive'").withColumn("seq", F.lit(0))
    m.upsert_table(c.spark, path, base.unionByName(first).unionByName(second), ["persona", "date"], "persona", "seq")
    return c.spark.read.schema(led.schema).parquet(path)


@query("s13_replace_latest_orders", sql("ledger", "SELECT persona, max(date) AS date, arg_max(cash, date) AS target_cash FROM ledger GROUP BY 1"))
def _(c):
    o = c.ledger.select("persona", "date", F.col("cash").alias("target_cash"))
    stored = m.last_per(o.filter("date < DATE'1998-01-01'"), "persona", "date")
    return m.upsert(stored, o, "persona", "date")


@query("s14_watermark", sql("ledger", "SELECT persona AS pipeline_name, max(date) AS last_completed_date FROM ledger WHERE persona <> 'neutral' GROUP BY 1 UNION ALL SELECT 'neutral', DATE '2030-01-01'"))
def _(c):
    import datetime
    t = c.ledger.groupBy(F.col("persona").alias("pipeline_name")).agg(F.max("date").alias("last_completed_date"))
    return m.advance_watermark(t, "neutral", datetime.date(2030, 1, 1))


@query("s14_read_watermark", sql("ledger", "SELECT max(date) AS last_completed_date FROM ledger WHERE persona = 'dynamic'"))
def _(c):
    t = c.ledger.groupBy(F.col("persona").alias("pipeline_name")).agg(F.max("date").alias("last_completed_date"))
    return m.read_watermark(t, "dynamic")


@query("s15_read_ledger", stage="ledger", oracle=sql("ledger", "SELECT date, cash, total_equity, date = max(date) OVER () AS is_latest FROM ledger WHERE persona = 'neutral'"))
def _(c):
    led = c.ledger.filter("persona = 'neutral'")
    latest = led.agg(F.max("date").alias("date")).withColumn("_l", F.lit(True))
    return led.join(latest, "date", "left").select("date", "cash", "total_equity", F.coalesce("_l", F.lit(False)).alias("is_latest")).orderBy("date")


@query("s16_compile_scorecards", sql("pred", SCORES + "SELECT ticker, date, p_up, CASE WHEN ticker < 'S5' THEN kelly END AS kelly FROM sc"))
def _(c):
    s = scores(c)
    one = s.filter("ticker < 'S5'").select("ticker", "date", "p_up", "kelly")
    two = s.filter("ticker >= 'S5'").select("ticker", "date", "p_up")
    base = scratch_path(c.spark, "scorecards")
    one.write.parquet(f"{base}/full")  # two vintages of sheets, the older one without a stake
    two.write.parquet(f"{base}/short")
    return m.compile_scorecards(c.spark, base).select("ticker", "date", "p_up", "kelly")


@query("s17_prediction_maps", sql("pred", "SELECT ticker, p_up AS prob, exp_ret, exp_vol FROM pred WHERE p_up IS NOT NULL AND exp_ret IS NOT NULL AND exp_vol IS NOT NULL"))
def _(c):
    p = c.pred.dropna(subset=["p_up", "exp_ret", "exp_vol"])
    v = F.struct(F.col("p_up").alias("prob"), "exp_ret", "exp_vol")
    lines = p.select(F.to_json(F.create_map("ticker", v)).alias("value"))
    path = scratch_path(c.spark, "maps")
    lines.write.text(path)
    return readers.read_prediction_maps(c.spark, path)


@query("s18_unpivot_tracking", sql("ledger", """, w AS (SELECT d.date, p.persona, l.total_equity AS te, l.cash AS ca FROM (SELECT DISTINCT date FROM ledger) d CROSS JOIN (SELECT DISTINCT persona FROM ledger) p LEFT JOIN ledger l ON l.date = d.date AND l.persona = p.persona),
x AS (SELECT persona, date, coalesce(te, 10000) AS total_equity, CASE WHEN persona = 'neutral' THEN coalesce(ca, te, 10000) ELSE coalesce(te, 10000) END AS cash FROM w)
SELECT persona, date, cash, total_equity, round(greatest(0, total_equity - cash), 2) + 0 AS held FROM x"""))
def _(c):
    sheet = [(p, "total_equity", "Total_Equity") for p in PERSONAS.values()] + [("neutral", "cash", "Cash")]  # one persona reports its cash
    wide = c.ledger.groupBy("date").agg(*[F.max(F.when(F.col("persona") == p, F.col(v))).alias(f"{p}_{n}") for p, v, n in sheet])
    from ..functions.scalars import holdings_total
    return readers.unpivot_tracking(wide).select("persona", "date", "cash", "total_equity", F.round(holdings_total(F.col("holdings")), 2).alias("held"))


@query("s19_backfill_defaults", sql("ledger", """SELECT persona, date, CASE WHEN month(date) = 2 THEN 10000 ELSE cash END AS cash, CASE WHEN month(date) = 3 THEN 10000 ELSE total_equity END AS total_equity, CASE WHEN month(date) = 4 THEN '{}' ELSE 'x' END AS holdings_json FROM ledger"""))
def _(c):
    mo = F.month("date")
    d = c.ledger.select("persona", "date", F.when(mo != 2, F.col("cash")).alias("cash"), F.when(mo != 3, F.col("total_equity")).alias("total_equity"), F.when(mo != 4, "x").alias("holdings_json"))
    return m.backfill_defaults(d, json=["holdings_json"])


@query("s20_carry_forward", stage="gappy", oracle=sql("gappy", """, s AS (SELECT min(date) AS a, max(date) AS b FROM gappy), cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s), op AS (SELECT date FROM cal WHERE isodow(date) < 6 AND date NOT IN (@CLOSED@)),
f AS (SELECT ticker, min(date) AS a FROM gappy GROUP BY 1), g AS (SELECT f.ticker, op.date FROM f JOIN op ON op.date >= f.a)
SELECT g.ticker AS persona, g.date, last_value(x.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cash, CASE WHEN x.close IS NULL THEN '@STATUS@' ELSE 'SETTLED' END AS intraday_status
FROM g LEFT JOIN gappy x ON g.ticker = x.ticker AND g.date = x.date""").replace("@CLOSED@", closed_days()).replace("@STATUS@", m.CARRIED))
def _(c):
    led = c.gappy.select(F.col("ticker").alias("persona"), "date", F.col("close").alias("cash"), F.lit("SETTLED").alias("intraday_status"))
    sess = session_calendar(c.gappy).filter("is_open").select("session")
    return m.carry_forward(led, sess)


@query("s21_heal_gaps", stage="gappy", oracle=sql("gappy", """, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM gappy GROUP BY 1), g AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s),
j AS (SELECT g.ticker, g.date, x.close, x.volume FROM g LEFT JOIN gappy x ON g.ticker = x.ticker AND g.date = x.date WHERE isodow(g.date) < 6),
k AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS a, first_value(close IGNORE NULLS) OVER n AS b, last_value(volume IGNORE NULLS) OVER p AS v FROM j WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticker, date, round(coalesce(close, (a + b) / 2, a), 6) AS close, v AS volume FROM k"""))
def _(c):
    d = densify(c.gappy.select("ticker", "date", "close", "volume"), fill=False, per_key_span=True)
    return m.heal_gaps(d, "close", "volume")


