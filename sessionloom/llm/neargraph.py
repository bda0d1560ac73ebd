"""Near-duplicate vectors by NN-descent.

Every vector keeps a list of its ``k`` nearest neighbours, first from a few small
buckets of random hyperplanes, then refined in rounds: the neighbours of a
vector, and those that have it in their lists, are compared with each other, and
whoever finds a nearer neighbour puts it in its list. Rounds compare 256-bit
sketches (signs of random projections; differing bits grow with the angle), so a
round moves 32 bytes a neighbour, not vectors. Rounds end when few lists change.

Entries near enough by sketch are then verified by their cosine in double
precision, and what reaches the threshold is a link. A list that is full of
possible links is saturated: it may be too short for its vector. Such lists are
enlarged to their whole connected component, compared in blocks of vectors; only
the number of links is kept of it, so a group of n near copies never becomes n^2
rows. At the end a sample of vectors is audited against all rows; if too few of
its links were found, everything is repeated with lists twice as long and new
sketches.

Equal vectors are one node with a count. Nodes, not labels, are the keys of all
shuffles; lists that have one vector in common are dealt to bounded groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .components import connected
from .joins import lookup

WORDS = 4  # of 64 bits in a sketch
FAR = 64 * WORDS + 1  # more than any two sketches differ


def sketches(rows: DataFrame, seed: int) -> DataFrame:
    """(node, g, s0..s3): a sketch per row of (node, g, v); rows of equal length share projections."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lists = b.column("v")
            size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            out = np.zeros((len(size), WORDS), np.uint64)
            for n in np.unique(size):
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, int(n)]).standard_normal((n, 64 * WORDS))
                at = np.flatnonzero(size == n)
                x = flat[start[at][:, None] + np.arange(n)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                out[at] = np.packbits(x @ planes[n] > 0, axis=1).view(">u8")
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("g"), *[pa.array(out[:, i].view(np.int64)) for i in range(WORDS)]],
                                             ["node", "g", *[f"s{i}" for i in range(WORDS)]])
    return rows.select("node", "g", "v").mapInArrow(scan, "node long, g long, " + ", ".join(f"s{i} long" for i in range(WORDS)))


def _lists(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each row's array of structs ``all``."""
    entries = batch.column("all")
    flat, at = entries.flatten(), np.concatenate([[0], np.cumsum(entries.value_lengths().to_numpy())])
    cols = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    for lo, hi in zip(at[:-1], at[1:]):
        yield {c: x[lo:hi] for c, x in cols.items()}


def _bits_apart(rows: dict[str, np.ndarray]) -> np.ndarray:
    d = np.zeros((len(rows["node"]),) * 2, np.int32)
    for i in range(WORDS):
        s = rows[f"s{i}"].view(np.uint64)
        d += np.bitwise_count(s[:, None] ^ s[None, :])
    return d


def _edge_batches(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= 65536:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["u", "v", "d"])
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["u", "v", "d"])


def _gathered(rows: DataFrame, by: list[str], extra: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct("node", *[f"s{i}" for i in range(WORDS)], *extra)).alias("all")).select("all")


def first_lists(nodes: DataFrame, k: int, block: int) -> DataFrame:
    """(u, v, d): each node's nearest among the nodes that share a bucket, over one table of buckets per sketch word.

    A bucket holds the nodes with equal leading bits, about ``block`` of them; a
    larger one (near copies) is dealt out by hash.
    """
    counts = nodes.groupBy("g").agg(F.count("*").alias("ng"))
    sized = lookup(nodes, counts, "g").withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("ng") / F.lit(block / 2)))).cast("int"))
    words = F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"s{i}").alias("w")) for i in range(WORDS)])
    dealt = sized.withColumn("tw", F.explode(words)).withColumn("cell", F.xxhash64("g", "tw.t", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(tw.w, 64 - bits)")).otherwise(F.lit(0))))
    full = dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"))
    cells = lookup(dealt.drop("tw", "bits", "ng"), full, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for rows in _lists(batch):
                    n = len(rows["node"])
                    if n < 2:
                        continue
                    d = _bits_apart(rows)
                    d[rows["g"][:, None] != rows["g"][None, :]] = FAR
                    np.fill_diagonal(d, FAR)
                    top = np.argsort(d, axis=1, kind="stable")[:, :k]
                    best = np.take_along_axis(d, top, axis=1)
                    i, c = np.nonzero(best < FAR)
                    yield rows["node"][i], rows["node"][top[i, c]], best[i, c]
        return _edge_batches(found())

    return _gathered(cells, ["cell", "part"], ["g"]).mapInArrow(scan, "u long, v long, d int")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, d, fresh): the k nearest of each node; an edge that was there before is not fresh."""
    own = edges.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    place = Window.partitionBy("u").orderBy("d", "v")
    return own.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).drop("r")


def refined(nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """One round: candidates (u, v, d) that are nearer than the last entry of u's full list.

    Compared are, at every node, the entries of its list and the nodes that list
    it, if at least one of the two is fresh. A node that many list meets them in
    groups of at most about 2k, each with its whole list.
    """
    last = graph.groupBy("u").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    listed = graph.groupBy("v").agg(F.ceil(F.count("*") / F.lit(2 * k)).cast("long").alias("parts"))
    worst = last.select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("d")).otherwise(FAR).alias("worst"))
    known = pin(nodes.join(worst, "node", "left").select("node", "g", *[f"s{i}" for i in range(WORDS)], F.coalesce("worst", F.lit(FAR)).alias("worst")))
    out = graph.join(listed.select(F.col("v").alias("u"), "parts"), "u", "left").select(
        F.col("u").alias("at"), F.col("v").alias("node"), "fresh", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
    back = lookup(graph, listed, "v").select(F.col("v").alias("at"), F.col("u").alias("node"), "fresh", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    met = out.unionByName(back).groupBy("at", "part", "node").agg(F.max("fresh").alias("fresh"))
    rows = lookup(met, known, "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for rows in _lists(batch):
                    if len(rows["node"]) < 2 or not rows["fresh"].any():
                        continue
                    d = _bits_apart(rows)
                    d[~(rows["fresh"][:, None] | rows["fresh"][None, :]).astype(bool)] = FAR
                    np.fill_diagonal(d, FAR)
                    i, j = np.nonzero(d < rows["worst"][:, None])
                    if len(i):
                        yield rows["node"][i], rows["node"][j], d[i, j]
        return _edge_batches(found())

    return _gathered(rows, ["at", "part"], ["fresh", "worst"]).mapInArrow(scan, "u long, v long, d int")


def neighbour_graph(nodes: DataFrame, k: int = 12, block: int = 96, settled: float = 0.01, most_rounds: int = 12) -> DataFrame:
    """(u, v, d, fresh): NN-descent over (node, g, sketch); ends when a round changes less than ``settled`` of all entries."""
    graph = pin(_best(first_lists(nodes, k, block).withColumn("fresh", F.lit(1)), k))
    for _ in range(most_rounds):
        found = refined(nodes, graph, k).withColumn("fresh", F.lit(1))
        graph = pin(_best(graph.withColumn("fresh", F.lit(0)).unionByName(found), k))
        changed, total = graph.agg(F.sum("fresh"), F.count("*")).first()
        if not total or changed <= settled * total:
            break
    return graph


def bits_limit(least: float) -> int:
    """Differing sketch bits that a pair at cosine ``least`` exceeds with probability below 1e-8."""
    p = math.acos(min(max(least, -1.0), 1.0)) / math.pi
    return min(64 * WORDS, math.ceil(64 * WORDS * p + 6 * math.sqrt(64 * WORDS * p * (1 - p)) + 1))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs with equal labels, equal lengths and a cosine of at least ``least`` in double precision; unit vectors u."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"), F.col("unit").alias(f"u{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = (F.col("la") == F.col("lb")) & (F.size("ua") == F.size("ub"))
    return pin(both.filter(same).filter(_dot("ua", "ub") >= least).select("a", "b"))


def _counted(members: DataFrame, least: float, block: int) -> DataFrame:
    """(node, n): how many rows each member is linked to among all members (root, node, m, label, unit) of its component, by blocks."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts"))
    dealt = lookup(members, sizes, "root").withColumn("part", F.pmod(F.xxhash64("node", "root"), F.col("parts")))
    all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = dealt.withColumn("other", all_parts).select("root", "part", "other", "node", "label", "unit")
    right = dealt.select(F.col("root").alias("r"), all_parts.alias("p"), F.col("part").alias("o"), *[F.col(c).alias(f"{c}2") for c in ("node", "m", "label", "unit")])

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            (y, m, yl, yn), x = (np.stack(b["unit2"].to_list()), b["m2"].to_numpy(), b["label2"].to_numpy(), b["node2"].to_numpy()), np.stack(a["unit"].to_list())
            for lo in range(0, len(a), 512):
                near = x[lo: lo + 512] @ y.T >= least
                near &= a["label"].to_numpy()[lo: lo + 512, None] == yl[None, :]
                near &= a["node"].to_numpy()[lo: lo + 512, None] != yn[None, :]
                n[lo: lo + 512] = near @ m
        return pd.DataFrame({"node": a["node"], "n": n})

    parts = left.groupBy("root", "part", "other").cogroup(right.groupBy("r", "p", "o")).applyInPandas(count, "node long, n long")
    return parts.groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, links: DataFrame, least: float, rows: int = 256) -> tuple[int, float]:
    """(sampled nodes with links, mean share of their links found): about ``rows`` nodes against all by brute force."""
    total = nodes.count()
    pick = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) < F.lit(rows / max(total, 1) * (1 << 30))
    sample = [(r["node"], r["label"], np.array(r["unit"])) for r in nodes.filter(pick).select("node", "label", "unit").limit(4 * rows).collect()]
    if not sample:
        return 0, 1.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            true = np.zeros(len(sample), np.int64)
            size = b.column("unit").value_lengths().to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                part = b.take(pa.array(at))
                x, label, m, node = part.column("unit").flatten().to_numpy().reshape(-1, n), part.column("label").to_pylist(), part.column("m").to_numpy(), part.column("node").to_numpy()
                label = np.array(label, object)
                for i, (key, lab, u) in enumerate(sample):
                    if len(u) == n:
                        true[i] += int(m[(x @ u >= least) & (label == lab) & (node != key)].sum())
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sample], pa.int64()), pa.array(true)], ["node", "real_n"])

    real = nodes.select("node", "label", "unit", "m").mapInArrow(scan, "node long, real_n long").groupBy("node").agg(F.sum("real_n").alias("real_n")).filter("real_n > 0")
    share = F.least(F.coalesce("n", F.lit(0)) / F.col("real_n"), F.lit(1.0))
    n, found = real.join(links, "node", "left").agg(F.count("*"), F.avg(share)).first()
    return n, 1.0 if found is None else found


def takes_part(id_col: str, vector_col: str, label_col: str) -> Column:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that take part with a hash of label and vector, one node per distinct label and vector)."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zero
    rows = vectors.filter(takes_part(id_col, vector_col, label_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    used = pin(rows.withColumn("vh", F.xxhash64("label", "v")))
    same = used.groupBy("vh", "label", "v").agg(F.min("id").alias("lo"), F.count("*").alias("m"))
    scaled = same.withColumn("top", F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).withColumn("w", F.expr("transform(v, x -> x / top)"))
    norm = scaled.withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)))
    nodes = norm.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("label", F.size("v")).alias("g"), "vh", "label", "v", "lo", "m",
                        F.expr("transform(w, x -> x / norm)").alias("unit"))
    return used, pin(nodes)  # stored, so that node numbers stand


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
                  k: int = 12, goal: float = 0.95, tries: int = 3, seed: int = 5, block: int = 1024) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine of their
    vectors is ``least`` or more (double precision). n_links counts the other
    rows a row is linked to, equal vectors included; component_id is the
    smallest id that links reach, itself included; kept marks the row with that
    id. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null label or id, link with nothing (a null id has a null
    component and is not kept); vectors of different length never link. Rows may repeat ids: each counts
    as a vector. Other columns are ignored. Links may be missed, never invented:
    an audit of about 256 nodes has to find ``goal`` of their links, else lists
    are doubled and sketches drawn anew, up to ``tries`` times.
    """
    used, nodes = _prepared(vectors, id_col, vector_col, label_col)
    limit = bits_limit(least)
    pairs = None
    for turn in range(tries):
        short = pin(sketches(nodes.select("node", "g", F.col("unit").alias("v")), seed + turn))
        graph = neighbour_graph(short, k << turn)
        near = graph.filter(F.col("d") <= limit)
        met = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        pairs = verified(met, nodes, least) if pairs is None else pin(pairs.unionByName(verified(met, nodes, least)).distinct())
        full = near.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= k << turn).select(F.col("u").alias("node"))
        root = pin(connected(pairs))
        wide = lookup(root, full, "node").select("root").distinct()
        members = root.join(wide, "root", "left_semi").join(nodes.select("node", "m", "label", "unit"), "node")
        many = pin(_counted(members, least, block))
        ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
        few = ends.join(nodes.select(F.col("node").alias("other"), "m"), "other").groupBy("node").agg(F.sum("m").alias("n"))
        links = pin(many.unionByName(few.join(many, "node", "left_anti")))
        if audit(nodes, links, least)[1] >= goal:
            break
    named = nodes.select("node", "vh", "label", "v", "lo", "m").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("lo").alias("component"))
    named = pin(lookup(named, lowest, "root").join(links, "node", "left").select("vh", "label", "v", "component", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n")))
    part = used.alias("r").join(named.alias("t"), (F.col("r.vh") == F.col("t.vh")) & (F.col("r.label") == F.col("t.label")) & (F.col("r.v") == F.col("t.v")))
    linked = part.select(F.col("r.id").alias("id"), F.col("t.n").alias("n_links"), F.col("t.component").alias("component_id"))
    alone = vectors.filter(~takes_part(id_col, vector_col, label_col)).select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
