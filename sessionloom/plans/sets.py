"""U: sorts, limits and set operations."""

from pyspark.sql import functions as F

from ..operators import sets as u
from .registry import query
from .sqltext import sql


@query("u1_sort_multi_key", sql("gappy", "SELECT ticker, date, close FROM gappy ORDER BY ticker, date DESC"))
def _(c):
    return u.sort_rows(c.gappy.select("ticker", "date", "close"), [("ticker", True), ("date", False)])


@query("u2_union_keep_last", stage="gappy", oracle=sql("gappy", """SELECT ticker, date, round(CASE WHEN date >= DATE '2024-01-15' THEN close + 1 ELSE close END, 6) AS close FROM gappy"""))
def _(c):
    g = c.gappy.select("ticker", "date", "close")
    newer = g.filter("date >= DATE'2024-01-15'").withColumn("close", F.col("close") + 1)
    return u.union_keep_last(g, newer, ["ticker", "date"])


@query("u3_intersect", "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(c):
    li = c.table("lineitem")
    a, b = (li.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("part")) for f in "AR")
    return u.common(a, b)


@query("u4_except_symmetric", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def _(c):
    o = c.table("orders")
    a, b = (o.filter(F.col("o_orderstatus") == f).select(F.col("o_custkey").alias("k")) for f in "FP")
    return u.symmetric_difference(a, b, "k")


@query("u5_global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(c):
    return u.first_k(c.table("orders").select("o_orderkey", "o_totalprice"), 25, [("o_totalprice", False), ("o_orderkey", True)])


@query("u6_distinct_from_lists", """SELECT DISTINCT c_mktsegment AS ticker FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(c):
    lists = c.ledger.select(F.map_keys("holdings").alias("tickers"))
    return u.distinct_members(lists, "tickers", "ticker")
