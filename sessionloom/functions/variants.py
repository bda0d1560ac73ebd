"""Values without a fixed shape as VARIANT: parsed once, then read by path and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHREDDING = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema")


def parsed(text: Column) -> Column:
    """JSON or Python-literal text as VARIANT; anything else is null."""
    fixed = F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bNone\b", "null")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fixed))


def number(value: Column, *paths: str) -> Column:
    """The first of ``paths`` that holds a number (or the text of one), as double."""
    return F.coalesce(*[F.try_variant_get(value, p, "double") for p in paths])


def members(df: DataFrame, value: str, keep=()) -> DataFrame:
    """(keep, pos, key, value) per member of an object or element of an array (key null); null and bare values give no row."""
    tvf = df.sparkSession.tvf
    return df.lateralJoin(tvf.variant_explode(F.col(value).outer()).toDF("pos", "_key", "_member")).select(
        *keep, "pos", F.col("_key").alias("key"), F.col("_member").alias("value"))


def holding(value: Column) -> list[Column]:
    """dollars, units and price of a holding that is an object or, for cash-like entries, a bare number of dollars."""
    return [number(value, "$.dollars", "$").alias("dollars"), F.coalesce(number(value, "$.units"), F.lit(0.0)).alias("units"),
            F.coalesce(number(value, "$.price"), F.lit(0.0)).alias("price")]


def records(df: DataFrame, value: str, keep=("ticker",)) -> DataFrame:
    """An array of vendor records as bars; elements that are no object give no row, a field of another type is null."""
    rows = members(df, value, keep).filter(F.schema_of_variant("value").startswith("OBJECT"))
    fields = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "adj_close": "adjClose"}
    day = F.substring(F.try_variant_get("value", "$.date", "string"), 1, 10).try_cast("date")
    return rows.select(*keep, day.alias("date"), *[number(F.col("value"), f"$.{p}").alias(n) for n, p in fields.items()])


def write_shredded(df: DataFrame, path: str) -> None:
    """Parquet whose VARIANT columns have the fields that most rows share as typed columns of their own.

    A later read by path then touches those columns only; rows of another shape
    keep the rest in the binary part, so nothing is lost.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _SHREDDING}
    for k in _SHREDDING:
        conf.set(k, "true")
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def read_shredded(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
