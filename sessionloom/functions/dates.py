"""Session calendar, business days and exchange-time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import END, UNB

# Days on which the exchange closed outside its holiday rules.
CLOSURES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02",
    "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (0 is Monday) of a month; n = -1 is the last one."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n < 0:
        end = F.last_day(first)
        return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar."""
    def whole(c: Column) -> Column:
        return F.floor(c).cast("int")

    golden, century = year % 19, whole(year / 100)
    skipped = century - whole(century / 4) - whole((century - whole((century - 17) / 25)) / 3)
    epact = F.pmod(skipped + 19 * golden + 15, F.lit(30))
    epact = epact - whole(epact / 28) * (1 - whole(epact / 28) * whole(29 / (epact + 1)) * whole((21 - golden) / 11))
    full = year + whole(year / 4) + epact + 2 - century + whole(century / 4)
    day = epact - F.pmod(full, F.lit(7))
    month = 3 + whole((day + 40) / 44)
    return F.make_date(year, month, day + 28 - 31 * whole(month / 4))


def observed(day: Column, saturday: bool = True) -> Column:
    """A fixed-date holiday moves from Sunday to Monday and (if ``saturday``) from Saturday to Friday."""
    moved = F.when(F.weekday(day) == 6, F.date_add(day, 1))
    return (moved.when(F.weekday(day) == 5, F.date_sub(day, 1)) if saturday else moved).otherwise(day)


def is_holiday(d: Column) -> Column:
    """Holidays of the exchange by rule, for any year since 1971 (later ones from their first year on)."""
    y = F.year(d)

    def on(month: int, day: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(day))

    return ((d == observed(on(1, 1), saturday=False)) | ((d == nth_weekday(y, 1, 0, 3)) & (y >= 1998)) | (d == nth_weekday(y, 2, 0, 3))
            | (d == F.date_sub(easter(y), 2)) | (d == nth_weekday(y, 5, 0, -1)) | ((d == observed(on(6, 19))) & (y >= 2022))
            | (d == observed(on(7, 4))) | (d == nth_weekday(y, 9, 0, 1)) | (d == nth_weekday(y, 11, 3, 4)) | (d == observed(on(12, 25))))


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def is_open(d: Column, closures=CLOSURES) -> Column:
    """A weekday that is no holiday and none of the ``closures`` (ISO dates)."""
    day = d.cast("date")
    return is_weekday(day) & ~is_holiday(day) & ~F.date_format(day, "yyyy-MM-dd").isin(*closures)


def next_business_day(d: Column) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))


def previous_business_day(d: Column) -> Column:
    return F.date_sub(d, F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1))


def business_days(start: Column, end: Column) -> Column:
    """Array of the weekdays from start to end."""
    return F.filter(F.sequence(start, end), lambda x: F.weekday(x) < 5)


def add_business_days(d: Column, n: int) -> Column:
    """Weekday ``n`` business days after a day (or before, if negative).

    From a weekend the first step forward is to Monday, back to Friday; zero rolls forward.
    """
    over = F.weekday(d) - 4  # 1 or 2 on a weekend
    start = F.when(over <= 0, d).otherwise(F.date_sub(d, over) if n > 0 else F.date_add(d, 3 - over))
    k = F.weekday(start) + n
    return F.date_add(start, (n + 2 * F.floor(k / 5)).cast("int"))


def calendar(spark: SparkSession, start: str, end: str, closures=CLOSURES) -> DataFrame:
    """One row per day; bounded by the span, so a single small frame."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    return days.withColumn("is_open", is_open(F.col("session"), closures))


def session_calendar(span: DataFrame, date="date", closures=CLOSURES) -> DataFrame:
    """Calendar of the dates a frame covers, with a session number on open days.

    The date range is found by one aggregate row; the calendar has one row per day.
    """
    days = span.agg(F.min(date).alias("a"), F.max(date).alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("session"))
    return number_sessions(days.withColumn("is_open", is_open(F.col("session"), closures)))


def number_sessions(cal: DataFrame) -> DataFrame:
    """Adds the session number, the session on or before, the next and the previous one."""
    o = Window.orderBy("session")  # one row per calendar day
    opened = F.when(F.col("is_open"), F.col("session"))
    return cal.select(
        "session", "is_open",
        F.sum(F.col("is_open").cast("bigint")).over(o.rowsBetween(UNB, 0)).alias("session_no"),
        F.last(opened, True).over(o.rowsBetween(UNB, 0)).alias("last_session"),
        F.last(opened, True).over(o.rowsBetween(UNB, -1)).alias("previous_session"),
        F.first(opened, True).over(o.rowsBetween(1, END)).alias("next_session"))


def missed_sessions(watermarks: DataFrame, cal: DataFrame, closed_until: Column, pending: DataFrame, key="pipeline_name") -> DataFrame:
    """(key, session): sessions each pipeline still has to run.

    ``watermarks`` (key, last_completed_date) are what it has done, ``cal``
    (session, is_open) is the calendar, ``closed_until`` the last day that is
    over, ``pending`` (key, date) the staged orders. Due are the open sessions
    after the watermark up to the last closed one (only that one without a
    watermark); the last closed one is also due when the orders staged are not
    for the session after it.
    """
    opened = cal.filter("is_open")
    last = opened.filter(F.col("session") <= closed_until).agg(F.max("session").alias("_last"))
    ahead = opened.filter(F.col("session") > closed_until).agg(F.min("session").alias("_next"))
    staged = pending.groupBy(key).agg(F.max("date").alias("_staged"))
    w = watermarks.select(key, F.col("last_completed_date").alias("_done")).withColumns(
        {"_last": last.select("_last").scalar(), "_next": ahead.select("_next").scalar()}).join(staged, key, "left")
    unstaged = ~F.coalesce(F.col("_staged") == F.coalesce("_next", F.date_add("_last", 1)), F.lit(False))
    first = (F.when(F.col("_done").isNull(), F.col("_last")).when(F.col("_done") < F.col("_last"), F.date_add("_done", 1))
             .when(unstaged, F.col("_last")))
    days = w.filter(first.isNotNull()).select(key, F.explode(F.sequence(first, F.col("_last"))).alias("session"))
    return days.join(opened.select("session"), "session", "left_semi").select(key, "session")


def third_friday(d: Column) -> Column:
    first = F.trunc(d, "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)


def is_triple_witching(d: Column, closures=CLOSURES) -> Column:
    """Third Friday of the quarter-end month, or the day before when that Friday is closed."""
    f = third_friday(d)
    day = F.when(is_open(f, closures), f).otherwise(F.date_sub(f, 1))
    return F.month(d).isin(3, 6, 9, 12) & (d == day)


def exchange_time(ts: Column, zone: str = "America/New_York") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def minutes_since_open(local_ts: Column) -> Column:
    """Minutes after 09:30 on an exchange-local time stamp, at least one."""
    mins = F.hour(local_ts) * 60.0 + F.minute(local_ts) + F.second(local_ts) / 60.0 - 570.0
    return F.greatest(F.lit(1.0), mins)


def expected_volume(avg_daily: Column, minutes: Column) -> Column:
    return avg_daily * (minutes / 390.0)
