"""Data-quality checks. Each returns its violations as (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import KEYS, by, cols
from ..functions.dates import business_days
from ..functions.scalars import holdings_total
from .cleaning import tail
from .windows import gaps

FIELDS = ("check", "key", "detail")


def _out(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _flags(df: DataFrame, *rules) -> DataFrame:
    """Several (check, condition, key, detail) rules in one pass over the rows."""
    hits = [F.when(cond, F.struct(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")))
            for check, cond, key, detail in rules]
    return df.select(F.inline(F.array_compact(F.array(*hits))))


def _key(*names: str) -> Column:
    return F.concat_ws("|", *[F.col(n).cast("string") for n in names])


def _money(c: Column) -> Column:
    return F.format_string("%.2f", F.round(c, 2) + 0.0)


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def balance(ledger: DataFrame, tolerance: float = 0.05, skip=("RESTORED",)) -> DataFrame:
    """Cash plus holdings against equity, and equity that has gone."""
    d = ledger.filter(~F.coalesce(F.col("intraday_status"), F.lit("")).isin(*skip))
    diff = F.col("cash") + holdings_total(F.col("holdings")) - F.col("total_equity")
    d = d.withColumn("_d", diff)
    key = _key("persona", "date")
    return _flags(d, ("balance", F.abs("_d") > tolerance, key, _money(F.col("_d"))),
                  ("zero_equity", F.col("total_equity") < 0.05, key, _money(F.col("total_equity"))))


def missing_sessions(df: DataFrame, keys=("persona",), date="date", holidays=()) -> DataFrame:
    """Business days inside a key's span that have no row."""
    k = cols(keys)
    span = df.groupBy(*k).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    grid = span.select(*k, F.explode(business_days(F.col("_a"), F.col("_b"))).alias(date))
    if holidays:
        grid = grid.filter(~F.date_format(date, "yyyy-MM-dd").isin(*holidays))
    miss = grid.join(df.select(*k, date), [*k, date], "left_anti")
    return _out(miss, "missing_session", _key(*k), F.col(date))


def gaps_and_nulls(df: DataFrame, values, keys=("persona",), date="date", max_days: int = 4) -> DataFrame:
    k = cols(keys)
    g = gaps(df, max_days, k, date)
    n = df.groupBy(*k).agg(*[F.count_if(F.col(v).isNull()).alias(v) for v in cols(values)])
    rows = n.select(*k, F.inline(F.array(*[F.struct(F.lit(v).alias("col"), F.col(v).alias("n")) for v in cols(values)])))
    return together(_out(g, "gap", _key(*k, date), F.col("gap_days")),
                    _out(rows.filter("n > 0"), "nulls", _key(*k, "col"), F.col("n")))


def lagging(df: DataFrame, active: DataFrame | None = None, key="ticker", date="date") -> DataFrame:
    """Keys whose newest date is before the newest date of all."""
    d = df if active is None else df.join(active, key, "left_semi")
    last = d.groupBy(key).agg(F.max(date).alias("_l"))
    top = d.agg(F.max(date)).scalar()
    return _out(last.filter(F.col("_l") < top), "lagging", F.col(key), F.col("_l"))


def orphans(held: DataFrame, known: DataFrame, check: str = "orphan", keys=("persona",), on="ticker") -> DataFrame:
    miss = held.select(*cols(keys), on).distinct().join(known.select(on).distinct(), on, "left_anti")
    return _out(miss, check, _key(*cols(keys)), F.col(on))


def flatlined(df: DataFrame, n: int = 15, value="close", key="ticker") -> DataFrame:
    t = tail(df, n, key)
    g = t.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(value).alias("_k"))
    return _out(g.filter((F.col("_n") == n) & (F.col("_k") <= 1)), "flatline", F.col(key), F.col("_n"))


def return_mismatch(df: DataFrame, stored="ret", value="close", keys=KEYS, tolerance: float = 0.01) -> DataFrame:
    """Stored percent return against one recomputed from the prices."""
    again = 100 * (F.try_divide(F.col(value), F.lag(value).over(by(keys))) - 1)
    g = df.withColumn("_d", F.abs(again - F.col(stored))).groupBy(*cols(keys)).agg(F.max("_d").alias("_m"))
    return _out(g.filter(F.col("_m") > tolerance), "return_mismatch", _key(*cols(keys)), F.format_string("%.4f", F.round("_m", 4)))


def bounds(scores: DataFrame) -> DataFrame:
    p, r = F.col("p_up"), F.col("exp_ret")
    key = _key("ticker", "date")
    return _flags(scores, ("probability_bounds", (p < 0) | (p > 1), key, F.format_string("%.2f", p)),
                  ("return_bounds", F.abs(r) > 0.20, key, F.format_string("%.6f", r)))


def paradoxes(scores: DataFrame) -> DataFrame:
    real = scores.filter("p_up <> 0.5")
    key = _key("ticker", "date")
    return _flags(real, ("paradox", F.expr("p_up > 0.60 and exp_ret < -0.01"), key, F.format_string("%.6f", F.col("exp_ret"))),
                  ("zero_volatility", F.col("exp_vol") <= 0, key, F.format_string("%.6f", F.col("exp_vol"))))


def dummy_scorecards(scores: DataFrame) -> DataFrame:
    """Whole scorecards that look like placeholders."""
    g = scores.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("p_up") == 0.5).alias("p"), F.bool_and(F.col("exp_ret") == 0).alias("r"),
        F.count_if(F.contains("status", F.lit("QUARANTIN"))).alias("q"))
    t = F.col("ticker")
    return _flags(g, ("all_half", F.col("p"), t, F.col("n")), ("all_zero_return", F.col("r"), t, F.col("n")),
                  ("quarantined", F.col("q") > 0, t, F.col("q")), ("too_few_rows", F.col("n") < 2, t, F.col("n")))


def pending_wipeout(scores: DataFrame, label="hit", limit: int = 15) -> DataFrame:
    g = scores.groupBy("ticker").agg(F.count_if(F.col(label) == "Pending").alias("_n"))
    return _out(g.filter(F.col("_n") >= limit), "pending_wipeout", F.col("ticker"), F.col("_n"))


def stale_personas(ledger: DataFrame, expected, personas, date="date") -> DataFrame:
    """Expected personas that are missing or older than the expected date."""
    want = ledger.sparkSession.createDataFrame([(p,) for p in personas], "persona string")
    last = ledger.groupBy("persona").agg(F.max(date).alias("_l"))
    d = want.join(last, "persona", "left")
    bad = d.filter(F.col("_l").isNull() | (F.col("_l") < F.lit(expected).cast("date")))
    return _out(bad, "stale_persona", F.col("persona"), F.coalesce(F.col("_l").cast("string"), F.lit("MISSING")))


def freshness(df: DataFrame, target, date="date", name: str = "table") -> DataFrame:
    top = df.agg(F.max(date).alias("_m"))
    return _out(top.filter(F.col("_m").isNull() | (F.col("_m") < F.lit(target).cast("date"))), "stale_table", F.lit(name), F.col("_m"))


def schema_risks(spark, source: T.StructType, stored: T.StructType) -> list[tuple[str, str, str]]:
    """Columns whose stored type would cut or reject the incoming type."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    real = (T.FloatType, T.DoubleType, T.DecimalType)
    kinds = {f.name: f.dataType for f in stored.fields}
    out = []
    for f in source.fields:
        s = kinds.get(f.name)
        if s is None:
            continue
        if isinstance(f.dataType, real) and isinstance(s, whole):
            out.append(("truncation", f.name, f"{f.dataType.simpleString()} into {s.simpleString()}"))
        elif isinstance(f.dataType, T.StringType) and isinstance(s, whole + real):
            out.append(("type_mismatch", f.name, f"string into {s.simpleString()}"))
    return out


def schema_check(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Type risks, each with the number of stored values that would really be damaged."""
    spark = source.sparkSession
    found = schema_risks(spark, source.schema, stored.schema)
    if not found:
        return spark.createDataFrame([], "check string, key string, detail string")
    hurt = []
    for check, name, _ in found:
        c = F.col(name)
        bad = (c != F.floor(c)) if check == "truncation" else c.try_cast("double").isNull() & c.isNotNull()
        hurt.append(F.count_if(bad).alias(name))
    n = source.agg(*hurt)
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(c).alias("key"),
                              F.concat(F.lit(d + ": "), F.col(c).cast("string")).alias("detail")) for k, c, d in found])
    return n.select(F.inline(rows))


def future_row(df: DataFrame, target: str, keys=KEYS, date="date") -> DataFrame:
    """Every key ends in exactly one row without a target, and no date repeats."""
    k = cols(keys)
    dup = df.groupBy(*k, date).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    g = df.groupBy(*k).agg(F.max(date).alias("_l"), F.max(F.when(F.col(target).isNull(), F.col(date))).alias("_f"))
    bad = g.filter(F.col("_f").isNull() | (F.col("_f") < F.col("_l")))
    return together(_out(dup, "duplicate_date", _key(*k, date), F.col("_n")), _out(bad, "future_row", _key(*k), F.col("_l")))


def split_alignment(df: DataFrame, train: str, test_rows: int, keys=KEYS) -> DataFrame:
    """Test rows per key must equal the requested number, with no train row after a test row."""
    k = cols(keys)
    g = df.groupBy(*k).agg(F.count_if(~F.col(train)).alias("_t"), F.max(F.when(F.col(train), F.col("date"))).alias("_a"),
                           F.min(F.when(~F.col(train), F.col("date"))).alias("_b"))
    return _flags(g, ("split_length", F.col("_t") != test_rows, _key(*k), F.col("_t")),
                  ("split_order", F.col("_a") >= F.col("_b"), _key(*k), F.col("_a")))


def scaling_leak(df: DataFrame, scaled: str, train: str, keys=KEYS, tolerance: float = 1e-6) -> DataFrame:
    """Scaled train rows must have mean 0 and deviation 1 on their own."""
    k = cols(keys)
    g = df.filter(F.col(train)).groupBy(*k).agg(F.abs(F.avg(scaled)).alias("_m"), F.abs(F.stddev_pop(scaled) - 1).alias("_s"))
    return _out(g.filter((F.col("_m") > tolerance) | (F.col("_s") > tolerance)), "scaling_leak", _key(*k), F.lit("train statistics differ"))


def series_age(df: DataFrame, today, inception, keys=("persona",), date="date", max_age: int = 4) -> DataFrame:
    k = cols(keys)
    g = df.groupBy(*k).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    age = F.datediff(F.lit(today).cast("date"), F.col("_b"))
    late = F.col("_a") > F.lit(inception).cast("date")
    return _flags(g, ("stale_series", age > max_age, _key(*k), age), ("late_start", late, _key(*k), F.col("_a")))
