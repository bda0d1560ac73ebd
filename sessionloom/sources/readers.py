"""Typed readers and writers. Reads name their schema, so nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_panel(spark: SparkSession, path: str, schema: T.StructType = schemas.PANEL, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    r = spark.read.schema(schema)
    return r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", files_by: Sequence[str] = ()) -> None:
    """Full rewrite; ``files_by`` clusters rows so each partition directory gets few files.

    The rebalance hint lets AQE split a directory that holds most of the rows.
    """
    w = (df.hint("rebalance", *files_by) if files_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def pick_column(df: DataFrame, candidates: Sequence[str], out: str) -> DataFrame:
    """First existing candidate renamed to ``out``; an error names the candidates if none exists."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, out)
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trimmed names with inner blanks and dots joined by ``_``; any case of date becomes ``Date``."""
    names = ["_".join(n.replace(".", " ").split()) for n in df.columns]
    return df.toDF(*["Date" if n.lower() == "date" else n for n in names])


def read_by_file_name(spark: SparkSession, paths, schema: T.StructType, pattern: str, out: str) -> DataFrame:
    """Union of many CSV files; ``out`` is the first group of ``pattern`` in each file's path."""
    d = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
         .csv([paths] if isinstance(paths, str) else list(paths)))
    return d.select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(out))


def read_symbol_directory(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated listing; keeps funds whose symbol has neither ``$`` nor ``.``."""
    d = spark.read.schema("Symbol string, Name string, ETF string").option("header", True).option("sep", "|").csv(path)
    return d.filter((F.col("ETF") == "Y") & ~F.col("Symbol").rlike(r"[$.]"))


def read_prediction_maps(spark: SparkSession, paths) -> DataFrame:
    """Many JSON files of {ticker: {prob, exp_ret, exp_vol}} as one long frame."""
    t = spark.read.text(paths)
    m = F.from_json("value", schemas.PREDICTION)
    return t.select(F.explode(m).alias("ticker", "_p")).select("ticker", "_p.prob", "_p.exp_ret", "_p.exp_vol")


def melt(df: DataFrame, pattern: str = r"^(\w+?)_(.+)$", keys=("date",), fields=("open", "high", "low", "close", "volume")) -> DataFrame:
    """Wide ``field_ticker`` columns -> (date, ticker, field columns); empty tickers are dropped per row."""
    import re
    tickers: dict[str, dict[str, str]] = {}
    for c in df.columns:
        hit = re.match(pattern, c)
        if c not in keys and hit and hit.group(1) in fields:
            tickers.setdefault(hit.group(2), {})[hit.group(1)] = c
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[
        (F.col(m[f]) if f in m else F.lit(None).cast("double")).alias(f) for f in fields]) for t, m in tickers.items()])
    long = df.select(*keys, F.inline(rows))
    return long.dropna(how="all", subset=list(fields))


# Readers of the ledger look for these.
PLACEHOLDER, RESTORED = "HISTORICAL_BASKET", "RESTORED"


def unpivot_tracking(df: DataFrame, start: float = 10000.0, date="date") -> DataFrame:
    """``{persona}_Total_Equity`` / ``{persona}_Cash`` columns -> ledger rows with one placeholder holding."""
    names = [c[: -len("_Total_Equity")] for c in df.columns if c.endswith("_Total_Equity")]
    rows = F.array(*[F.struct(
        F.lit(n).alias("persona"), F.coalesce(F.col(f"{n}_Total_Equity"), F.lit(start)).alias("total_equity"),
        (F.col(f"{n}_Cash") if f"{n}_Cash" in df.columns else F.lit(None).cast("double")).alias("_c")) for n in names])
    d = df.select(date, F.inline(rows)).withColumn("cash", F.coalesce("_c", "total_equity"))
    held = F.greatest(F.lit(0.0), F.col("total_equity") - F.col("cash"))
    h = F.when(held > 0, F.create_map(F.lit(PLACEHOLDER), F.struct(
        held.alias("dollars"), F.lit(1.0).alias("units"), held.alias("price")))).otherwise(
        F.from_json(F.lit("{}"), schemas.HOLDINGS))
    return d.select("persona", date, "cash", "total_equity", h.alias("holdings"), F.lit(RESTORED).alias("intraday_status"))
