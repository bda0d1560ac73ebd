"""Approximate nearest neighbours by inner product: stable projections, a kd-tree and a chi-square stopping test.

Inner product becomes distance by one more coordinate: with M the longest
vector, |(q, 0) - (x, sqrt(M^2 - |x|^2))|^2 = |q|^2 + M^2 - 2 q.x. Vectors are
projected to ``dims`` coordinates with a fixed Gaussian (2-stable) matrix, so the
ratio of squared projected to squared true distance follows a chi-square law with
``dims`` degrees of freedom. A kd-tree over the projections gives leaves in order
of their projected distance from the query; the vectors of a leaf are verified
with the true measure. A search ends when the chi-square probability of
(projected distance of the next leaf)^2 / (k-th best true distance)^2 reaches
``surety``: a vector that belongs among the k best is then still unseen with
probability 1 - surety at most.

The top of the kd-tree is common to all rows: its splits are fitted on a bounded
sample of projections (``SAMPLE_PER_CELL`` a cell, ``cells`` cells at most), every
row is sent down to its cell, and the true box of each cell is measured. A cell's
own tree is built in the task that searches it; a cell of more than
``shard_rows`` rows is dealt to several tasks. A query first searches the cell
whose box is nearest to its projection. The k-th best score found there goes with
it, and the same stopping test decides which other cells it visits at all, and how
far it goes in them. Within a cell the leaves nearest to the query come first, one by one;
those its test still leaves open are verified together with the other queries that
want them. So a query travels to the cells it cannot rule out, not to
all, and an index row travels once for every ``block_rows`` queries of its cell.
Equal vectors are indexed once, with their k + 1 smallest ids: a larger id of the
same vector can never be among k results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .joins import lookup

SALT_ROWS = 1_000_000  # rows of one vector that a task may have to sort
SAMPLE_PER_CELL = 32  # projections a cell from which the common splits are fitted


def chi2_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_limit(p: float, dims: int) -> float:
    """Where the distribution function reaches p."""
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each leaf; splits at the median of the widest side, also where values are equal."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        p = points[rows]
        axis, half = int(np.argmax(p.max(axis=0) - p.min(axis=0))), len(rows) // 2
        order = np.argpartition(p[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


def fit_splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of each inner node of a complete tree of 2^depth cells; node i has the children 2i + 1 and 2i + 2."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    members = [np.arange(len(points))]
    for node in range(len(axis)):
        rows = members[node]
        p = points[rows]
        if len(p):
            axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
            value[node] = np.median(p[:, axis[node]])
        below = p[:, axis[node]] < value[node]
        members += [rows[below], rows[~below]]
    return axis, value


def cell_of(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The cell each point falls into."""
    node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    for _ in range(int(len(axis) + 1).bit_length() - 1):
        node = 2 * node + np.where(points[rows, axis[node]] < value[node], 1, 2)
    return node - len(axis)


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    gap2 = np.zeros((len(points), len(low)))
    for i in range(points.shape[1]):
        p = points[:, i, None]
        gap2 += np.maximum(np.maximum(low[:, i] - p, p - high[:, i]), 0) ** 2
    return gap2


def projection(size: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size + 1, dims))


def projected(vectors: np.ndarray, matrix: np.ndarray, longest2: float | None) -> np.ndarray:
    """Projections of indexed vectors; with ``longest2`` None of queries, whose last coordinate is 0."""
    points = vectors @ matrix[:-1]
    if longest2 is None:
        return points
    return points + np.sqrt(np.maximum(longest2 - (vectors**2).sum(axis=1), 0))[:, None] * matrix[-1]


class Tree:
    ahead = 8  # leaves searched in each query's own order before leaves are shared

    def __init__(self, vectors: np.ndarray, longest2: float, dims: int, leaf: int, seed: int):
        self.vectors = vectors
        self.longest2 = max(longest2, float((vectors**2).sum(axis=1).max()))
        self.matrix = projection(vectors.shape[1], dims, seed)
        points = projected(vectors, self.matrix, self.longest2)
        leaves = kd_leaves(points, leaf)
        self.rows = np.full((len(leaves), leaf), -1)
        for i, r in enumerate(leaves):
            self.rows[i, : len(r)] = r
        self.low = np.stack([points[r].min(axis=0) for r in leaves])
        self.high = np.stack([points[r].max(axis=0) for r in leaves])

    def search(self, queries: np.ndarray, k: int, limit: float, floor: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of the k best found for each query, -1 where there are fewer; ``floor``: k-th best score known before."""
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        parts = [self._search(queries[i: i + block], k, limit, floor[i: i + block]) for i in range(0, len(queries), block)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _search(self, q: np.ndarray, k: int, limit: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap2 = box_gaps(projected(q, self.matrix, None), self.low, self.high)
        best, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        base = (q**2).sum(axis=1) + self.longest2

        def open_(leaf: np.ndarray, at: np.ndarray) -> np.ndarray:
            far2 = np.maximum(base[at] - 2 * np.maximum(best[at, -1], floor[at]), 0)  # infinite until k are known
            return ~(gap2[at, leaf] >= limit * far2)

        def keep(at: np.ndarray, dots: np.ndarray, rows: np.ndarray) -> None:
            better = dots.max(axis=1) >= best[at, -1]
            at, dots, rows = at[better], dots[better], rows[better]
            score, row = np.concatenate([best[at], dots], axis=1), np.concatenate([found[at], rows], axis=1)
            top = np.lexsort((row, -score), axis=1)[:, :k]
            best[at], found[at] = np.take_along_axis(score, top, axis=1), np.take_along_axis(row, top, axis=1)

        every = np.arange(len(q))
        nearest = np.argsort(gap2, axis=1)[:, : self.ahead]
        for t in range(nearest.shape[1]):  # each query's own nearest leaves, until its test holds
            at = every[open_(nearest[:, t], every)]
            rows = self.rows[nearest[at, t]]
            dots = np.matmul(self.vectors[rows], q[at][:, :, None])[:, :, 0]
            dots[rows < 0] = -np.inf
            if len(at):
                keep(at, dots, rows)
            gap2[at, nearest[at, t]] = np.inf  # seen
        for leaf in np.argsort(gap2.min(axis=0, initial=np.inf)):  # what is open after that, one leaf for all its queries at once
            at = every[np.isfinite(gap2[:, leaf]) & open_(leaf, every)]
            if len(at):
                rows = self.rows[leaf][self.rows[leaf] >= 0]
                keep(at, q[at] @ self.vectors[rows].T, np.broadcast_to(rows, (len(at), len(rows))))
        found[np.isneginf(best)] = -1
        return found, best


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that can take part, one per id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(fine)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _indexed(rows: DataFrame, n: int, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k + 1 smallest ids."""
    salted = Window.partitionBy("v", "salt").orderBy("id")
    salts = max(64, n // SALT_ROWS)
    first = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    whole = Window.partitionBy("v").orderBy("id")  # at most salts * (k + 1) rows of a vector are left
    return first.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _points(matrix: np.ndarray, longest2: float | None):
    @F.pandas_udf("array<double>")
    def points(v: pd.Series) -> pd.Series:
        return pd.Series(list(projected(np.stack(v.to_list()), matrix, longest2)) if len(v) else [], dtype=object)
    return points


def _cells(index: DataFrame, n: int, cells: int, shard_rows: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(index rows with their cell, rows of (cell, parts), cell numbers, lower and upper corners of their boxes)."""
    depth = max(0, min(cells, -(-n // shard_rows)) - 1).bit_length()
    want = SAMPLE_PER_CELL << depth
    pick = F.pmod(F.xxhash64(F.lit("split"), "v"), F.lit(1 << 30)) < F.lit(min(1.0, want / n) * (1 << 30))
    sample = [r[0] for r in index.filter(pick).select("p").limit(2 * want).collect()] if depth else []
    axis, value = fit_splits(np.array(sample).reshape(len(sample), -1) if sample else np.zeros((0, 1)), depth)

    @F.pandas_udf("long")
    def cell(p: pd.Series) -> pd.Series:
        return pd.Series(cell_of(np.stack(p.to_list()), axis, value) if len(p) else [], dtype="int64")

    placed = pin(index.withColumn("cell", cell("p")))
    corner = placed.select("cell", F.posexplode("p").alias("i", "x")).groupBy("cell", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    boxes = corner.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("box"), F.max("n").alias("n")).orderBy("cell").collect()  # at most 2 * cells rows
    low, high = (np.array([[b[c] for b in r["box"]] for r in boxes]) for c in ("lo", "hi"))
    sizes = placed.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // shard_rows)) for r in boxes], "cell long, parts long")
    return placed, sizes, np.array([r["cell"] for r in boxes]), low, high


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 8,
            surety: float = 0.97, leaf: int = 32, shard_rows: int = 8192, block_rows: int = 4096, seed: int = 11, cells: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products found for each row of ``queries`` among ``vectors`` with another id.

    Nearest first, ties to the smaller id; all candidates, if there are fewer
    than k. Null, zero and non-finite vectors and null ids take no part. Nor do
    vectors and queries of another length than most of ``vectors`` have (ties:
    the shorter length). Of rows with equal ids the one with the smallest vector
    (array order) counts. ``dims`` has to be even. Other columns are ignored.
    """
    spark, limit = vectors.sparkSession, chi2_limit(surety, dims)
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows = pin(usable(vectors, id_col, vector_col))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not size:
        return empty
    size = size["n"]
    rows, asked = rows.filter(F.size("v") == size), usable(queries, id_col, vector_col).filter(F.size("v") == size)
    count, longest2 = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    matrix = projection(size, dims, seed)
    index = pin(_indexed(rows, count, k).withColumn("p", _points(matrix, longest2)("v")))
    index, sizes, names, low, high = _cells(index, index.count(), cells, shard_rows)
    asked = pin(asked.withColumn("p", _points(matrix, None)("v")).withColumn("base", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + F.lit(longest2)))

    @F.pandas_udf("long")
    def home(p: pd.Series) -> pd.Series:
        near = [box_gaps(np.stack(p.iloc[i: i + 256].to_list()), low, high).argmin(axis=1) for i in range(0, len(p), 256)]
        return pd.Series(names[np.concatenate(near)] if near else [], dtype="int64")

    @F.pandas_udf("array<long>")
    def others(p: pd.Series, far2: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(p), 256):
            gap2 = box_gaps(np.stack(p.iloc[i: i + 256].to_list()), low, high)
            open_ = ~(gap2 >= limit * far2.to_numpy()[i: i + 256, None]) & (names[None, :] != own.to_numpy()[i: i + 256, None])
            out += [names[row] for row in open_]
        return pd.Series(out, dtype=object)

    def search(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asks):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        points = points.iloc[np.argsort([i[0] for i in points["ids"]])]
        x, q, qid, floor = np.stack(points["v"].to_list()), np.stack(asks["v"].to_list()), asks["id"].to_numpy(), asks["floor"].to_numpy(float)
        found, _ = Tree(x, longest2, dims, leaf, seed).search(q, k + 1, limit, floor)
        a, c = np.nonzero(found >= 0)
        row = found[a, c]
        score = np.concatenate([np.zeros(0), *[(q[a[i: i + 4096]] * x[row[i: i + 4096]]).sum(axis=1) for i in range(0, len(a), 4096)]])
        slack = 1e-9 * np.sqrt((q**2).sum(axis=1) * longest2)
        good = score >= (floor - slack)[a]
        a, row, score = a[good], row[good], score[good]
        ids = points["ids"].to_list()
        many = np.array([len(ids[r]) for r in row], np.int64)
        near = np.concatenate([np.zeros(0, np.int64), *[ids[r] for r in row]])
        out = pd.DataFrame({"query_id": np.repeat(qid[a], many), "id": near, "score": np.repeat(score, many)})
        out = out[out["query_id"] != out["id"]].sort_values(["query_id", "score", "id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k)

    def searched(visits: DataFrame) -> DataFrame:
        """Stored results of the visits (id, cell, floor): at most k per visited part of a cell."""
        blocks = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("blocks"))
        plan = pin(sizes.join(blocks, "cell"))
        dealt = lookup(visits, plan, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = dealt.join(asked.select("id", "v"), "id").select("id", "v", "floor", "cell", "block", "part")
        left = lookup(index, plan, "cell").select("v", "ids", F.col("cell").alias("c"), F.pmod(F.xxhash64(F.lit("part"), "v"), F.col("parts")).alias("p"),
                                                  F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
        return pin(left.groupBy("c", "p", "b").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(search, "query_id long, id long, score double"))

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = pin(asked.select("id", home("p").alias("cell"), F.lit(float("-inf")).alias("floor")))
    near = searched(first)
    kth = near.withColumn("r", F.row_number().over(place)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asked.select("id", "p", "base").join(first.select("id", "cell"), "id").join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    far2 = F.greatest(F.col("base") - 2 * F.col("floor"), F.lit(0.0))
    onward = pin(known.select("id", "floor", F.explode(others("p", far2, "cell")).alias("cell")))
    both = near.unionByName(searched(onward))
    return both.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
