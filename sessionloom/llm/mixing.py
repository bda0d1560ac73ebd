"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every document has a fixed 60-bit hash of its id. A source's budget is met by
taking all documents below a hash threshold: sizes are summed by source and hash
bucket, the bucket in which the budget runs out is found, and only that bucket
is split further. Nothing is sorted, documents are filtered by comparison, and
a smaller budget always takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import ranged_running
from ..session import pin
from .textops import SPACE_CLASS, WORD_SPACE

HASH_BITS, STEP_BITS = 60, 12
WEIGHTS = (5, 2, 1)
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE.decode()))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS))).cast("long")


def mix_hash(id_col: str) -> Column:
    """60-bit number from the id; a null id hashes as the word null."""
    key = F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, h) per row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), mix_hash(id_col).alias("h"))


def _with_source(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    """Joins on source (null equals null); sent to all tasks only up to a checked number of sources, else AQE splits hot sources."""
    other = per_source.withColumnRenamed("source", "_source")
    other = F.broadcast(other) if n_sources <= BROADCAST_SOURCES else other
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, weight, target): ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    Sources by code point, null last, take the weights in turn. What a capped
    source leaves is dealt among the others by weight until none is above its cap.
    """
    totals = pin(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = ranged_running(totals.withColumn("_null", F.col("source").isNull()), [], [F.col("_null"), F.col("source")],
                          {"_turn": F.lit(1)}, stored=True).drop("_null")
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_turn") - 1) % len(weights)).cast("int"))
    rated = pin(turn.select("source", "source_size", pick.alias("weight")))
    cap = most * F.col("source_size")
    whole = rated.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:  # each round caps at least one source more
        before = level
        over = (F.col("weight") * level > cap) | (F.col("source_size") == 0)
        spent, rest = rated.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not rest:
            break
        level = (share * whole - spent) / rest
    return rated.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def thresholds(sizes: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """(source, source_size, target, passes, bound): every document is taken ``passes`` times, those with h < bound once more.

    The last unit taken (documents of one hash) is the one that brings the
    source nearest to its target. ``sizes`` should be stored: it is read once a level.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select("source", "source_size", "target", passes.alias("passes"))
    plan = plan.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    top = 1 << HASH_BITS
    open_ = pin(plan.select("source", F.col("need"), F.lit(0).cast("long").alias("prefix")))
    found = []
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = _with_source(sizes, open_, n_sources).filter(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.first("need").alias("need"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**12 buckets a source
        run = hist.withColumn("after", F.sum("s").over(upto))
        edge = run.filter("after > need").groupBy("source").agg(
            F.min_by(F.struct("bucket", "s", "h0", "h1", "need", (F.col("after") - F.col("s")).alias("before")), "bucket").alias("e"))
        edge = pin(edge.select("source", "e.*"))
        sole = edge.filter((F.col("h0") == F.col("h1")) | F.lit(shift == 0))
        take = 2 * (F.col("need") - F.col("before")) > F.col("s")
        found.append(sole.select("source", F.when(take, F.col("h0") + 1).otherwise(F.col("h0")).alias("bound")))
        open_ = pin(edge.filter("h0 <> h1").select("source", (F.col("need") - F.col("before")).alias("need"), F.col("bucket").alias("prefix")))
        if shift == 0 or open_.isEmpty():
            break
    bounds = found[0]
    for f in found[1:]:
        bounds = bounds.unionByName(f)
    b = bounds.withColumnRenamed("source", "_source")
    joined = plan.join(b, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return pin(joined.select("source", "source_size", "target", "passes", F.coalesce(
        "bound", F.when(F.col("need") > 0, F.lit(top)).otherwise(F.lit(0))).alias("bound")))


def mix_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = 3) -> tuple[DataFrame, int]:
    """Per source what :func:`thresholds` gives, and the number of sources; ``sizes`` as from :func:`sized`, stored."""
    targets = pin(source_targets(sizes, weights, share, most))
    n = targets.count()
    return thresholds(sizes, targets, n), n


def copies(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` (with source and h) with the plan's columns and ``copies``, the number of times the mix takes the row."""
    return _with_source(rows, plan, n_sources).withColumn("copies", F.col("passes") + (F.col("h") < F.col("bound")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken (= copies * size).

    Null text: size 0. A null source is a source of its own, last in order.
    Rows with equal ids share a hash and are taken together. Empty input: no
    rows. Other columns are ignored, so their names cannot clash.
    """
    sizes = pin(sized(docs, id_col, text_col, source_col))
    plan, n = mix_plan(sizes, weights, share, most)
    out = copies(sizes, plan, n)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))
