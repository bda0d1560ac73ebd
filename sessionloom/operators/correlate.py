"""Lagged cross-series correlation for every (target, predictor) pair.

A join of all pairs by date would create T*T rows per session. Instead each
series becomes one row holding its values, series are hashed to blocks, and a
task multiplies two blocks at a time: shuffle volume is series x blocks, and
every task sees at most (series per block) x sessions values on each side.

Where only the strongest predictors of a target are wanted, a task takes large
blocks and works in tiles: one product in single precision per tile bounds every
correlation of the tile from above, and only pairs whose bound reaches the
weakest one their target has kept so far are computed, in double precision over
their common sessions. No pair is lost by the bound.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin, pin_by_row

BLOCK_BYTES, BLOCK_SERIES = 8 << 20, 1024
LARGE_BYTES, LARGE_SERIES, LEAST_BLOCKS = 24 << 20, 32768, 8
TILE_ROWS, TILE_COLS, SEEDS, MOST_HOLES, LEAST_GROUP = 512, 4096, 64, 8, 64
_FIELDS = "target string, predictor string, lag int, n long, corr double, slope double, intercept double"


def matrix(sizes, days: np.ndarray, values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Series by sessions, NaN where a series has no value; ``days`` and ``values`` one series after the other."""
    m = np.full((len(sizes), len(index)), np.nan)
    m[np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(index, days)] = values
    return m


def _matrix(rows: pd.DataFrame, index: np.ndarray) -> np.ndarray:
    return matrix([len(d) for d in rows["days"]], np.concatenate(rows["days"].to_list()), np.concatenate(rows["values"].to_list()), index)


class _Side:
    """Series of one side of a block pair on a common calendar: values centred on the own mean, zero where missing."""

    def __init__(self, names: np.ndarray, values: np.ndarray):
        self.names, index = names, range(values.shape[1])
        self.ok = ~np.isnan(values)
        self.mean = np.where(self.ok.any(1), np.nansum(values, 1) / np.maximum(self.ok.sum(1), 1), 0.0)
        # centring on the own mean keeps the sums of squares well conditioned
        self.x = np.where(self.ok, values - self.mean[:, None], 0.0)
        some = self.ok.any(1)
        self.first = np.where(some, self.ok.argmax(1), len(index))
        self.last = np.where(some, len(index) - self.ok[:, ::-1].argmax(1), 0)


def _sums(a: _Side, b: _Side, li, ri, window=slice(None)):
    """Sums over the common sessions (all in ``window``) of every pair of ``li`` and ``ri`` (matrices)."""
    ma, mb, a0, b0 = a.ok[li, window].astype(float), b.ok[ri, window].astype(float), a.x[li, window], b.x[ri, window]
    return ma @ mb.T, a0 @ mb.T, ma @ b0.T, a0 @ b0.T, (a0**2) @ mb.T, ma @ (b0**2).T


def _pair_sums(a: _Side, b: _Side, li, ri):
    """The same of the pairs (li[0], ri[0]), (li[1], ri[1]), ... only; each pair is summed in the same order wherever it is met."""
    ma, mb = a.ok[li], b.ok[ri]
    both = ma & mb
    a0, b0 = np.where(both, a.x[li], 0.0), np.where(both, b.x[ri], 0.0)
    return both.sum(1).astype(float), a0.sum(1), b0.sum(1), (a0 * b0).sum(1), (a0**2).sum(1), (b0**2).sum(1)


def _stats(sums, a_mean, b_mean):
    n, sa, sb, ab, aa, bb = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        cov, va, vb = ab - sa * sb / n, aa - sa**2 / n, bb - sb**2 / n
        flat = (va <= 1e-12 * aa) | (vb <= 1e-12 * bb)
        corr = np.where(flat, np.nan, cov / np.sqrt(va * vb))
        slope = np.where(flat, np.nan, cov / vb)
        return corr, slope, (sa / n + a_mean) - slope * (sb / n + b_mean)


def _groups(side: _Side) -> list[tuple[int, int, np.ndarray]]:
    """(first, last, rows): rows that start and end alike; rows of rare spans are one group on the whole calendar."""
    spans, at, count = np.unique(np.stack([side.first, side.last], 1), axis=0, return_inverse=True, return_counts=True)
    at = at.ravel()
    out = [(int(f), int(l), np.flatnonzero(at == g)) for g, (f, l) in enumerate(spans) if l > f and count[g] >= LEAST_GROUP]
    rest = np.flatnonzero((count[at] < LEAST_GROUP) & (side.last > side.first))
    return out + [(int(side.first[rest].min()), int(side.last[rest].max()), rest)] if len(rest) else out


class _Unit:
    """Rows of one group within a window of sessions as unit vectors, with what their strongest ``d`` sessions carry."""

    def __init__(self, side: _Side, rows: np.ndarray, lo: int, hi: int):
        ok, x = side.ok[rows, lo:hi], side.x[rows, lo:hi]
        self.n = ok.sum(1)
        x = np.where(ok, x - (x.sum(1) / np.maximum(self.n, 1))[:, None], 0.0)
        size = np.sqrt((x**2).sum(1))
        self.holes = (hi - lo) - self.n
        self.good = (self.holes <= MOST_HOLES) & (size > 1e-6 * np.sqrt((side.x[rows] ** 2).sum(1)))
        self.unit = x / np.where(size > 0, size, 1.0)[:, None]
        self.energy = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(-np.sort(-(self.unit**2), axis=1)[:, :MOST_HOLES], axis=1)], axis=1)

    def without(self, d: int):
        """(least share of the variance, greatest sum) that can be left after any ``d`` sessions are taken away."""
        e = self.energy[:, min(d, self.energy.shape[1] - 1)]
        return np.where(self.n > d, 1 - e * (1 + d / np.maximum(self.n - d, 1)), 0.0), np.sqrt(d * e)


class _Best:
    """The ``top`` strongest pairs of each target met so far, earlier predictors first on ties; ``floor`` is the weakest of a full list."""

    def __init__(self, a: _Side, b: _Side, top: int, min_obs: int):
        self.a, self.b, self.top, self.min_obs = a, b, top, min_obs
        self.floor = np.zeros(len(a.x))
        self.column, self.value = np.full((len(a.x), top), -1), np.zeros((len(a.x), top, 4))

    def raise_floor(self, rows: np.ndarray, scores: np.ndarray) -> None:
        if scores.shape[1] >= self.top:
            self.floor[rows] = np.maximum(self.floor[rows], -np.partition(-scores, self.top - 1, axis=1)[:, self.top - 1])

    def add(self, li: np.ndarray, ri: np.ndarray) -> None:
        for s in range(0, len(li), 16384):
            l, r = li[s: s + 16384], ri[s: s + 16384]
            sums = _pair_sums(self.a, self.b, l, r)
            corr, slope, icpt = _stats(sums, self.a.mean[l], self.b.mean[r])
            use = (sums[0] >= max(self.min_obs, 1)) & ~np.isnan(corr)
            use &= np.abs(np.nan_to_num(corr)) >= self.floor[l] - 1e-9
            self._merge(l[use], r[use], np.stack([sums[0], corr, slope, icpt], 1)[use])

    def _merge(self, l: np.ndarray, r: np.ndarray, v: np.ndarray) -> None:
        rows = np.unique(l)
        i, j = np.nonzero(self.column[rows] >= 0)
        l, r, v = np.concatenate([rows[i], l]), np.concatenate([self.column[rows[i], j], r]), np.concatenate([self.value[rows[i], j], v])
        order = np.lexsort((r, -np.abs(v[:, 1]), l))
        l, r, v = l[order], r[order], v[order]
        place = np.arange(len(l)) - np.searchsorted(l, l)
        keep, last = place < self.top, place == self.top - 1
        self.column[l[keep], place[keep]], self.value[l[keep], place[keep]] = r[keep], v[keep]
        self.floor[l[last]] = np.maximum(self.floor[l[last]], np.abs(v[last, 1]))

    def pairs(self):
        i, j = np.nonzero(self.column >= 0)
        return (i, self.column[i, j], *self.value[i, j].T)


def _exact_scores(a: _Side, b: _Side, li, ri, min_obs: int, window=slice(None)) -> np.ndarray:
    """|corr| of every pair, -1 where there is none."""
    sums = _sums(a, b, li, ri, window)
    corr = _stats(sums, 0.0, 0.0)[0]
    return np.where((sums[0] >= max(min_obs, 1)) & ~np.isnan(corr), np.abs(np.nan_to_num(corr)), -1.0)


def _search_whole(best: _Best, rows: np.ndarray, columns: np.ndarray, window: slice) -> None:
    """Every pair by the general sums: for series with many gaps, for which no useful bound is known."""
    for r in range(0, len(rows), TILE_ROWS):
        for c in range(0, len(columns), 1024):
            li, ri = rows[r: r + TILE_ROWS], columns[c: c + 1024]
            scores = _exact_scores(best.a, best.b, li, ri, best.min_obs, window)
            best.raise_floor(li, scores)
            i, j = np.nonzero(scores >= np.maximum(best.floor[li] - 1e-9, 0.0)[:, None])
            best.add(li[i], ri[j])


def _search(best: _Best, rows: np.ndarray, columns: np.ndarray, lo: int, hi: int) -> None:
    """Pairs of two groups that have their common sessions from ``lo`` to ``hi``, through a bound of each.

    A pair whose series miss d of the other's sessions has |corr| of at most (|s| + |sa sb| / n) / sqrt(va vb), with s the product
    of the unit vectors, and va, vb, sa, sb the worst that :meth:`_Unit.without` allows.
    """
    ua, ub, window = _Unit(best.a, rows, lo, hi), _Unit(best.b, columns, lo, hi), slice(lo, hi)
    _search_whole(best, rows[~ua.good], columns, window)
    _search_whole(best, rows[ua.good], columns[~ub.good], window)
    for da, db in itertools.product(np.unique(ua.holes[ua.good]), np.unique(ub.holes[ub.good])):
        ia, ib = np.flatnonzero(ua.good & (ua.holes == da)), np.flatnonzero(ub.good & (ub.holes == db))
        (wa, ta), (wb, tb) = ua.without(db), ub.without(da)
        ka, kb = wa[ia] > 0.2, wb[ib] > 0.2  # for others the bound says too little
        _search_whole(best, rows[ia[~ka]], columns[ib], window)
        _search_whole(best, rows[ia[ka]], columns[ib[~kb]], window)
        ia, ib = ia[ka], ib[kb]
        if not len(ia) or not len(ib):
            continue
        wa, wb, ta, tb = np.sqrt(wa[ia]), np.sqrt(wb[ib]), ta[ia], tb[ib]
        left, right = (ua.unit[ia] / wa[:, None]).astype(np.float32), (ub.unit[ib] / wb[:, None]).astype(np.float32).T
        least = np.maximum(ua.n[ia] - db, 1)
        loss, sure = ta * float(tb.max()) / least, least >= max(best.min_obs, 1)
        slack = 2e-5 + 2e-7 * (hi - lo)  # more than single precision loses in a product of two unit vectors
        extra = ta / wa / least * float((tb / wb).max()) + slack / wa * float((1 / wb).max())
        room, over = np.empty(TILE_ROWS * TILE_COLS, np.float32), np.empty(TILE_ROWS * TILE_COLS, bool)  # one tile, used again and again, stays in the cache
        for r in range(0, len(ia), TILE_ROWS):
            li, c, wide = rows[ia[r: r + TILE_ROWS]], 0, 4 * SEEDS
            while c < len(ib):
                ri = columns[ib[c: c + wide]]
                s, above = (x[: len(li) * len(ri)].reshape(len(li), len(ri)) for x in (room, over))
                np.abs(np.matmul(left[r: r + TILE_ROWS], right[:, c: c + wide], out=s), out=s)
                np.greater_equal(s, (best.floor[li] - extra[r: r + TILE_ROWS]).astype(np.float32)[:, None], out=above)
                hit = np.flatnonzero(above)
                i, j, high = hit // len(ri), hit % len(ri), s.ravel()[hit]
                # va and vb are at most 1, so each hit is at least this strong: the floor rises before anything is computed in full
                low = high * wa[r + i] * wb[c + j] - loss[r + i] - slack
                order = np.lexsort((-low, i))
                last = order[(np.arange(len(order)) - np.searchsorted(i, i)) == best.top - 1]
                last = last[sure[r + i[last]]]
                best.floor[li[i[last]]] = np.maximum(best.floor[li[i[last]]], low[last])
                use = high >= (best.floor[li] - extra[r: r + TILE_ROWS]).astype(np.float32)[i]
                best.add(li[i[use]], ri[j[use]])
                c, wide = c + len(ri), min(4 * wide, TILE_COLS)


def _strongest_pairs(a: _Side, b: _Side, top: int, min_obs: int, floor: np.ndarray | None = None):
    """(target, predictor, n, corr, slope, intercept) of the ``top`` largest |corr| of every target, earlier predictors first on ties.

    ``floor``: what each target has already, weaker pairs are of no use.
    """
    best = _Best(a, b, top, min_obs)
    if floor is not None:
        best.floor = floor.copy()
    seeds = np.unique(np.linspace(0, len(b.x) - 1, min(len(b.x), max(SEEDS, 2 * top))).astype(int))
    for r in range(0, len(a.x), TILE_ROWS):  # any real pairs will do as a first floor
        rows = np.arange(r, min(r + TILE_ROWS, len(a.x)))
        best.raise_floor(rows, _exact_scores(a, b, rows, seeds, min_obs) - 1e-9)
    best.floor = np.maximum(best.floor, 0.0)
    ours, theirs = _groups(a), _groups(b)
    for f, l, rows in ours:
        for g, m, columns in theirs:
            if min(l, m) - max(f, g) >= max(min_obs, 1):
                _search(best, rows, columns, max(f, g), min(l, m))
    return best.pairs()


def _pair_stats(left: pd.DataFrame, right: pd.DataFrame, lag: int, top: int | None, min_obs: int) -> pd.DataFrame:
    right = right.sort_values("series", ignore_index=True)
    if lag:
        right = right.assign(days=[d[lag:] for d in right["days"]], values=[v[: max(0, len(v) - lag)] for v in right["values"]])
    index = np.unique(np.concatenate([*left["days"], *right["days"]]))
    a, b = (_Side(d["series"].to_numpy(), _matrix(d, index)) for d in (left, right))
    if top is None:
        every, all_of = np.arange(len(left)), np.arange(len(right))
        sums = _sums(a, b, every, all_of)
        li, ri = np.nonzero(sums[0] >= max(min_obs, 1))
        n, corr, slope, icpt = (v[li, ri] for v in (sums[0], *_stats(sums, a.mean[:, None], b.mean[None, :])))
    else:
        li, ri, n, corr, slope, icpt = _strongest_pairs(a, b, top, min_obs)
    out = pd.DataFrame({
        "target": a.names[li], "predictor": b.names[ri], "lag": np.full(len(li), lag, "int32"),
        "n": n.astype("int64"), "corr": corr, "slope": slope, "intercept": icpt})
    return out.astype(object).where(out.notna(), None) if out.isna().to_numpy().any() else out


class Block:
    """The columns of one side of a row of :func:`beside`."""

    def __init__(self, row, prefix: str = ""):
        for c in row._fields:
            if c.startswith(prefix):
                setattr(self, c.removeprefix(prefix), getattr(row, c))


class _Targets:
    """A block of targets that meets the blocks of predictors one after the other, and keeps the ``top`` strongest of all met so far."""

    def __init__(self, block: Block, top: int, min_obs: int):
        self.names, self.sizes = np.asarray(block.names, object), np.asarray(block.sizes)
        self.days, self.values = np.asarray(block.days), np.asarray(block.values, float)
        self.top, self.min_obs, self.index = top, min_obs, None
        self.floor = np.zeros(len(self.names))
        self.row, self.predictor, self.found = np.zeros(0, int), np.zeros(0, object), np.zeros((0, 4))

    def meet(self, block: Block) -> None:
        days = np.asarray(block.days)
        index = np.unique(np.concatenate([self.days, days]))
        if self.index is None or not np.array_equal(index, self.index):
            self.index, self.side = index, _Side(self.names, matrix(self.sizes, self.days, self.values, index))
        b = _Side(np.asarray(block.names, object), matrix(np.asarray(block.sizes), days, np.asarray(block.values, float), index))
        row, column, *stats = _strongest_pairs(self.side, b, self.top, self.min_obs, self.floor)
        if not len(row):
            return
        old = np.isin(self.row, row)  # the lists that change
        at, who = np.concatenate([self.row[old], row]), np.concatenate([self.predictor[old], b.names[column]])
        found = np.concatenate([self.found[old], np.stack(stats, axis=1)])
        order = np.lexsort((np.unique(who.astype(str), return_inverse=True)[1], -np.abs(found[:, 1]), at))
        at, who, found = at[order], who[order], found[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep, last = place < self.top, place == self.top - 1
        self.floor[at[last]] = np.maximum(self.floor[at[last]], np.abs(found[last, 1]))
        self.row, self.predictor = np.concatenate([self.row[~old], at[keep]]), np.concatenate([self.predictor[~old], who[keep]])
        self.found = np.concatenate([self.found[~old], found[keep]])

    def rows(self) -> pd.DataFrame:
        n, corr, slope, icpt = self.found.T
        return pd.DataFrame({"target": self.names[self.row], "predictor": self.predictor, "n": n.astype("int64"), "corr": corr, "slope": slope, "intercept": icpt})


def strongest_packed(a: DataFrame, b: DataFrame, top: int, *, min_obs: int = 2, blocks: int | None = None) -> DataFrame:
    """The ``top`` strongest predictors of ``b`` of every target of ``a``, both packed: target, predictor, n, corr, slope, intercept.

    A task holds one block of targets and reads all predictors block by block, so
    neither side is copied on disk for the blocks it meets, what it has found
    bounds what is still to come, and only ``top`` rows of a target leave it.
    """
    targets = series_blocks(a, BLOCK_SERIES // 4, 3 * LEAST_BLOCKS, blocks)
    predictors = series_blocks(b, blocks=blocks).coalesce(1)

    def search(batches):
        held: dict[int, _Targets] = {}
        for d in batches:
            for row in d.itertuples():
                if row.r_block not in held:
                    held[row.r_block] = _Targets(Block(row, "r_"), top, min_obs)
                held[row.r_block].meet(Block(row))
        for t in held.values():
            yield t.rows()

    return pin_by_row(beside(predictors, targets).mapInPandas(search, "target string, predictor string, n long, corr double, slope double, intercept double"))


def _packed(df: DataFrame, value: str) -> DataFrame:
    """One row per series; its length is bounded by the session calendar."""
    e = F.sort_array(F.collect_list(F.struct("_day", value)))
    return df.filter(F.col(value).isNotNull()).groupBy("series").agg(e.alias("_e")).select(
        "series", F.col("_e")["_day"].alias("days"), F.col("_e")[value].alias("values"))


def pack(df: DataFrame) -> DataFrame:
    """(series, date, value) -> stored rows of (series, days, values)."""
    return pin(_packed(df.select("series", F.unix_date("date").alias("_day"), "value"), "value"))


def shifted(packed: DataFrame, lag: int) -> DataFrame:
    """Each series moved ``lag`` of its own sessions ahead, without another window."""
    n = F.greatest(F.size("days") - lag, F.lit(0))
    return packed.select("series", F.slice("days", F.lit(lag + 1), n).alias("days"), F.slice("values", F.lit(1), n).alias("values"))


def series_blocks(packed: DataFrame, least: int = BLOCK_SERIES, parts: int = LEAST_BLOCKS, blocks: int | None = None) -> DataFrame:
    """Stored rows (block, names, sizes, days, values and what else ``packed`` has), one per block of series, sorted by name in it.

    Blocks of about ``least`` series, ``parts`` of them at most, or as many as it takes to keep a block at about ``BLOCK_BYTES``.
    """
    n, longest = packed.agg(F.count(F.lit(1)), F.max(F.size("days"))).first()
    size = max(1, min(LARGE_SERIES, BLOCK_BYTES // (12 * max(longest or 1, 1))))
    count = blocks or max(1, min(-(-n // least), parts), -(-n // size))
    more = [c for c in packed.columns if c not in ("series", "days", "values")]
    rows = packed.groupBy(F.pmod(F.xxhash64("series"), F.lit(count)).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("series", "days", "values", *more))).alias("_s"))
    return pin(rows.select("block", F.col("_s.series").alias("names"), F.transform("_s.days", F.size).alias("sizes"), F.flatten("_s.days").alias("days"),
                           F.flatten("_s.values").alias("values"), *[F.col(f"_s.{c}").alias(c) for c in more]), rows_a_file=1)


def beside(left: DataFrame, right: DataFrame, use=None) -> DataFrame:
    """Every row of ``left`` beside every row of ``right`` (its columns as ``r_...``); of both, one ``block`` is a row.

    A Cartesian product of large rows: each task reads its two sides from where they are stored, so no copy of a block goes to
    disk for each block it meets. ``use`` is a condition on the two block numbers. For :func:`pin_by_row`.
    """
    n = (right.agg(F.max("block")).first()[0] or 0) + 1
    hashed = left.sparkSession.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part"))  # a key for each partition, so that no two blocks share one
    keys = {r["part"]: r["id"] for r in hashed.groupBy("part").agg(F.min("id").alias("id")).collect()}
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    right = right.repartition(n, F.array(*[F.lit(keys.get(b, b)).cast("long") for b in range(n)])[F.col("r_block")])
    left = left.hint("shuffle_replicate_nl")
    return left.crossJoin(right) if use is None else left.join(right, use(F.col("block"), F.col("r_block")))


def unpack(packed: DataFrame) -> DataFrame:
    z = F.explode(F.arrays_zip("days", "values"))
    return packed.withColumn("_z", z).select(*[c for c in packed.columns if c not in ("days", "values")],
                                             F.date_from_unix_date("_z.days").alias("date"), F.col("_z.values").alias("value"))


def packed_correlation(a: DataFrame, b: DataFrame, *, lags=(0,), blocks: int | None = None, top: int | None = None,
                       min_obs: int = 2) -> DataFrame:
    """Pair statistics of packed targets ``a`` and packed predictors ``b`` moved ``lags`` of their own sessions ahead.

    A block holds as many series as fit its byte budget, so the size of one
    task's matrices grows neither with the universe nor with the history. All
    lags are done on the same blocks: the series travel once.
    """
    def block_count(x: DataFrame) -> int:
        n, longest = x.agg(F.count(F.lit(1)), F.max(F.size("days"))).first()

        def of(most: int, room: int) -> int:
            return max(1, -(-n // max(1, min(most, room // (8 * max(longest or 1, 1))))))

        small = of(BLOCK_SERIES, BLOCK_BYTES)
        # with ``top`` no matrix of all pairs is held, so blocks are as large as leaves work for every core
        return small if top is None else min(small, max(of(LARGE_SERIES, LARGE_BYTES), LEAST_BLOCKS))

    na = blocks or block_count(a)
    nb = na if b is a else blocks or block_count(b)

    def home(name, n):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = a.withColumn("_lb", home("series", na)).withColumn("_rb", spread(nb))
    # both sides may come from one frame, and cogroup needs distinct columns
    right = b.select(*[F.col(c).alias(f"r_{c}") for c in ("series", "days", "values")])
    right = right.withColumn("_rb", home("r_series", nb)).withColumn("_lb", spread(na))

    def work(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame(columns=["target", "predictor", "lag", "n", "corr", "slope", "intercept"])
        r = r.rename(columns=lambda c: c.removeprefix("r_"))
        return pd.concat([_pair_stats(l, r, lag, top, min_obs) for lag in lags])

    return left.groupBy("_lb", "_rb").cogroup(right.groupBy("_lb", "_rb")).applyInPandas(work, _FIELDS)


def block_correlation(targets: DataFrame, predictors: DataFrame, *, blocks: int | None = None, top: int | None = None,
                      min_obs: int = 2) -> DataFrame:
    """Pairwise-complete correlation, slope and intercept of two sets of series.

    Inputs have (series, date, value). With ``top`` each task keeps the strongest
    predictors of each of its targets, and the final ranking sees blocks * top
    rows per target.
    """
    return packed_correlation(pack(targets), pack(predictors), blocks=blocks, top=top, min_obs=min_obs).drop("lag")


def lagged_correlation(df: DataFrame, lag: int = 1, *, blocks: int | None = None, top: int | None = None,
                       min_obs: int = 2, exclude_self: bool = False) -> DataFrame:
    """corr(target_t, predictor_{t-lag}) over all ticker pairs; lags count sessions of the predictor.

    A lag counts rows that carry a value.
    """
    p = pack(df.select(F.col("ticker").alias("series"), "date", "value"))
    return lagged_packed(p, (lag,), blocks=blocks, top=top, min_obs=min_obs, exclude_self=exclude_self).drop("lag")


def lagged_packed(p: DataFrame, lags, *, blocks: int | None = None, top: int | None = None, min_obs: int = 2,
                  exclude_self: bool = False) -> DataFrame:
    out = packed_correlation(p, p, lags=tuple(lags), blocks=blocks, top=None if top is None else top + int(exclude_self), min_obs=min_obs)
    return out.filter("target <> predictor") if exclude_self else out


def strongest(pairs: DataFrame, k: int, by=("target",)) -> DataFrame:
    """The k largest |corr| of each target (and whatever else ``by`` names), ties by predictor, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.abs("corr").desc(), "predictor")  # at most blocks * k rows a target
    return pairs.filter("corr is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
