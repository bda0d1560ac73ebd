"""Predictor selection on long feature tables: no wide pivot before a short list exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import UNB, by
from ..session import pin
from .correlate import block_correlation, lagged_correlation, lagged_packed, pack, shifted, strongest, strongest_packed, unpack


def feature_key() -> Column:
    return F.concat_ws("_", "ticker", "feature")


def feature_matrix(features: DataFrame, selected: list[str]) -> DataFrame:
    """Wide frame of a short list of ``TICKER_FEATURE`` names."""
    k = feature_key()
    f = features.withColumn("_k", k).filter(F.col("_k").isin(*selected))
    return f.groupBy("date").agg(*[F.max(F.when(F.col("_k") == s, F.col("value"))).alias(s) for s in selected])


def train_dates(df: DataFrame, share: float = 0.8) -> DataFrame:
    """First ``share`` of the distinct sessions (one row per session)."""
    d = df.select("date").distinct()
    i, n = F.row_number().over(Window.orderBy("date")), F.count(F.lit(1)).over(Window.partitionBy())
    return d.withColumn("_ok", i <= F.floor(n * share)).filter("_ok").drop("_ok")


def gather(df: DataFrame, keys, *more: str) -> DataFrame:
    """One stored row per key: ``days``, ``values`` (nulls too) and what else ``more`` names, by day.

    Rows that lie together by one of the keys already, as after a window, do not move again.
    """
    e = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("days"), F.col("value").alias("values"), *more)))
    g = df.groupBy(*keys).agg(e.alias("_e"))
    return pin(g.select(*keys, *[F.col("_e")[c].alias(c) for c in ("days", "values", *more)]))


def pack_features(features: DataFrame) -> DataFrame:
    """One stored row per TICKER_FEATURE series, or one row of each if they are gathered by ticker and feature."""
    if "days" in features.columns:
        return features.select(feature_key().alias("series"), *present()).filter("size(days) > 0")
    return pack(features.select(feature_key().alias("series"), "date", "value"))


def present(also=None) -> list[Column]:
    """``days`` and ``values`` of a gathered row without its nulls; ``also`` is one more condition on an entry."""
    kept = F.filter(F.arrays_zip("days", "values", *([also] if also else [])), lambda e: e["values"].isNotNull() & (~e[also] if also else F.lit(True)))
    return [kept["days"].alias("days"), kept["values"].alias("values")]


def top_k_features(targets: DataFrame, features: DataFrame, k: int, *, lag: int = 1, train_share: float | None = 0.8,
                   blocks: int | None = None, min_obs: int = 2) -> DataFrame:
    """Strongest lagged features of every target by |correlation|, on train sessions only, in one job."""
    t = targets.select(F.col("ticker").alias("series"), "date", "value")
    return top_k_packed(t, shifted(pack_features(features), lag), k, train_share=train_share, blocks=blocks, min_obs=min_obs)


def top_k_packed(targets: DataFrame, lagged: DataFrame, k: int, *, train_share: float | None = None,
                 blocks: int | None = None, min_obs: int = 2) -> DataFrame:
    """Same on (series, date, value) or packed targets and packed lagged features, e.g. one target series per fold."""
    if train_share is not None:
        targets = targets.join(train_dates(targets, train_share), "date", "left_semi")
    packed = targets if "days" in targets.columns else pack(targets)
    return strongest(strongest_packed(packed, lagged, k, min_obs=min_obs, blocks=blocks), k)


def selected_rows(top: DataFrame, lagged: DataFrame, packed: bool = False) -> DataFrame:
    """Long (target, date, feature, value) rows of the selected series only; ``packed``: a row a series, (target, feature, days, values)."""
    j = top.select("target", F.col("predictor").alias("series")).join(lagged, "series")
    if packed:
        return j.select("target", F.col("series").alias("feature"), "days", "values")
    return unpack(j).select("target", "date", F.col("series").alias("feature"), "value")


def complete_lagged(df: DataFrame, lag: int = 1) -> tuple[DataFrame, DataFrame]:
    """Targets and lagged predictors, both (series, date, value), on the sessions on which every ticker has both."""
    d = df.withColumn("_l", F.lag("value", lag).over(by()))
    ok = d.filter("value is not null and _l is not null")
    n = df.agg(F.count_distinct("ticker")).scalar()
    full = ok.groupBy("date").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == n)
    d = ok.join(full.select("date"), "date", "left_semi")
    return (d.select(F.col("ticker").alias("series"), "date", "value"),
            d.select(F.col("ticker").alias("series"), "date", F.col("_l").alias("value")))


def dense_lagged(df: DataFrame, lag: int = 1) -> tuple[DataFrame, DataFrame]:
    """Targets and lagged predictors of returns, both (series, date, value), on every session but the first ``lag``.

    A session on which a ticker has no return counts as a return of zero (no
    trade, no change of price), so one missing bar takes no session from the
    others, however many tickers there are. Lags count sessions of the calendar.
    """
    d = pin(df.filter("value is not null").select("ticker", "date", "value"))  # read several times below
    sessions = d.agg(F.sort_array(F.collect_set("date"))).scalar()  # bounded by the calendar
    grid = d.select("ticker").distinct().select("ticker", F.posexplode(sessions).alias("_i", "date"))
    full = grid.join(d, ["ticker", "date"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    both = full.withColumn("_l", F.lag("value", lag).over(by())).filter(F.col("_i") >= lag)
    return (both.select(F.col("ticker").alias("series"), "date", "value"),
            both.select(F.col("ticker").alias("series"), "date", F.col("_l").alias("value")))


def lagged_r2(df: DataFrame, lag: int = 1, *, top: int | None = 20, mode: str = "returns", blocks: int | None = None) -> DataFrame:
    """R-squared of each target with its ``top`` strongest predictors (None: with every one, a table of all pairs).

    ``returns`` keeps the sessions on which every ticker has both its value and
    its lagged value; ``prices`` fills levels forward over all sessions first.
    """
    if mode == "prices":
        days = df.select("date").distinct()
        span = df.groupBy("ticker").agg(F.min("date").alias("_a"))
        w = by().rowsBetween(UNB, 0)
        sessions = days.agg(F.sort_array(F.collect_list("date"))).scalar()  # bounded by the calendar
        grid = span.withColumn("_d", sessions).select("ticker", F.explode(F.filter("_d", lambda x: x >= F.col("_a"))).alias("date"))
        df = grid.join(df, ["ticker", "date"], "left").select("ticker", "date", F.last("value", True).over(w).alias("value"))
        c = lagged_correlation(df, lag, top=top, blocks=blocks)
    else:
        c = block_correlation(*complete_lagged(df, lag), top=top, blocks=blocks)
    c = c if top is None else strongest(c, top)
    return c.select("target", "predictor", "n", (F.col("corr") * F.col("corr")).alias("r2"))


def multi_lag(df: DataFrame, lags=(1, 2, 3, 4, 5), k: int = 3, blocks: int | None = None) -> DataFrame:
    """Strongest other tickers per target and lag."""
    p = pack(df.select(F.col("ticker").alias("series"), "date", "value"))
    out = strongest(lagged_packed(p, lags, blocks=blocks, top=k, exclude_self=True), k, ("target", "lag"))
    return out.withColumn("r2", F.col("corr") * F.col("corr"))


def best_over_lags(ranked: DataFrame) -> DataFrame:
    order = F.struct(-F.col("r2"), F.col("lag"), F.col("predictor"))
    return ranked.groupBy("target").agg(F.min_by(F.struct("predictor", "lag", "r2"), order).alias("b")).select("target", "b.*")


def best_lag1(df: DataFrame, min_obs: int = 50, blocks: int | None = None) -> DataFrame:
    """The one strongest lag-1 predictor of every ticker (itself included)."""
    return strongest(lagged_correlation(df, 1, blocks=blocks, top=1, min_obs=min_obs), 1).drop("rank")


def lag_chain(edges: DataFrame, depth: int = 5) -> DataFrame:
    """Follow best-predictor edges: lag1 of the ticker, lag1 of that one, and so on."""
    e = pin(edges.select(F.col("target").alias("_t"), F.col("predictor").alias("_p")))  # one row per ticker
    out = e.select(F.col("_t").alias("ticker"), F.col("_p").alias("lag1"))
    for d in range(2, depth + 1):
        out = out.join(e, F.col(f"lag{d - 1}") == F.col("_t"), "left").drop("_t").withColumnRenamed("_p", f"lag{d}")
    return out


def chain_steps(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(ticker, depth, leader, repeats) by a recursive query: every step of the chains of :func:`lag_chain`.

    A step that comes back to a ticker the chain has met already is its last one
    and has ``repeats`` true, so a cycle ends by itself at any ``depth``. Rows are
    stored: at most ``depth`` a ticker.
    """
    spark, name = edges.sparkSession, "spark.sql.cteRecursionRowLimit"
    e = pin(edges.select("target", "predictor"))  # one row per ticker
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # rows are bounded by the depth
    try:
        return pin(spark.sql("""
            WITH RECURSIVE steps(ticker, depth, leader, path, repeats) AS (
              SELECT target, 1, predictor, array(target, predictor), target = predictor FROM {e}
              UNION ALL
              SELECT s.ticker, s.depth + 1, n.predictor, array_append(s.path, n.predictor), array_contains(s.path, n.predictor)
              FROM steps s JOIN {e} n ON n.target = s.leader WHERE s.depth < {depth} AND NOT s.repeats)
            SELECT ticker, depth, leader, repeats FROM steps""", e=e, depth=depth))
    finally:
        spark.conf.set(name, before)


def chain_long(chain: DataFrame, depth: int) -> DataFrame:
    """(ticker, depth, leader) rows of a chain table."""
    return chain.select("ticker", F.inline(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.col(f"lag{d}").alias("leader")) for d in range(1, depth + 1)]))).filter("leader is not null")


def leader_values(returns: DataFrame, chain: DataFrame, depth: int) -> DataFrame:
    w = by()
    lags = returns.select(F.col("ticker").alias("leader"), "date",
                          *[F.lag("value", d).over(w).alias(f"_x{d}") for d in range(1, depth + 1)])
    shifted = lags.select("leader", "date", F.inline(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.col(f"_x{d}").alias("x")) for d in range(1, depth + 1)])))
    return chain_long(chain, depth).join(shifted, ["leader", "depth"])


def chain_features(returns: DataFrame, chain: DataFrame, depth: int = 3, extra: DataFrame | None = None) -> DataFrame:
    """Per ticker and date: leader returns at their lags, previous-session sector features, filled forward."""
    v = leader_values(returns, chain, depth)
    wide = v.groupBy("ticker", "date").agg(*[F.max(F.when(F.col("depth") == d, F.col("x"))).alias(f"chain{d}") for d in range(1, depth + 1)])
    d = returns.select("ticker", "date", F.col("value").alias("target")).join(wide, ["ticker", "date"], "left")
    names = [f"chain{i}" for i in range(1, depth + 1)]
    if extra is not None:
        more = [c for c in extra.columns if c not in ("ticker", "date")]
        e = extra.select("ticker", "date", *[F.lag(c).over(by()).alias(c) for c in more])
        d, names = d.join(e, ["ticker", "date"], "left"), names + more
    w = by().rowsBetween(UNB, 0)
    return d.select("ticker", "date", "target", *[F.last(c, True).over(w).alias(c) for c in names]).dropna(subset=names + ["target"])


def verify_chain(returns: DataFrame, chain: DataFrame, depth: int = 3) -> DataFrame:
    """Correlation of the ticker with each leader at its depth."""
    from .aggregates import correlate
    v = leader_values(returns, chain, depth)
    j = v.join(returns.select("ticker", "date", F.col("value").alias("y")), ["ticker", "date"])
    return correlate(j, "y", "x", ["ticker", "depth", "leader"])
