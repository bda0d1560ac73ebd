"""Connected components of a link table, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .joins import lookup

HELD = 1 << 20


def join_up(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after linking rows u and v: the smallest row number of each local component."""
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These links as stars: every node but the smallest of its component, with that one."""
    nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = join_up(np.arange(len(nodes)), number[: len(u)], number[len(u):])
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, at most HELD of them at a time."""
    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sides = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*sides)], ["u", "v"])
    held, size = [], 0
    for b in batches:
        held, size = [*held, b], size + b.num_rows
        if size >= HELD:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node of its component.

    Tasks first replace the links they hold by stars, which connect the same
    nodes. Then alternating large-star and small-star rounds: each round ties
    every node to the smallest node it knows, until no link moves (about
    log(diameter) rounds). Only links are kept, with a mark if the round moved
    them; every round is stored in the shared folder, and hubs are met by an
    aggregate plus a join that AQE may split.
    """
    some = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    kind = dict(some.dtypes)["u"]
    edges = pin(some.mapInArrow(_contract, f"u {kind}, v {kind}").distinct())
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        large = large.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = lookup(large, low, "u").withColumn("moved", F.col("moved") | (F.col("v") > F.col("m")))
        small = tied.select(F.inline(F.array(F.struct("u", "m", "moved"), F.struct(F.col("v").alias("u"), "m", "moved")))).filter("u <> m")
        edges = pin(small.groupBy("u", F.col("m").alias("v")).agg(F.max("moved").alias("moved")))
        if not edges.agg(F.max("moved")).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
