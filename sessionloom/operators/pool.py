"""Linear models of every target on all other tickers' lagged returns, with no cut of the pool.

A target and its candidates are never gathered in one place. All series lie on
the whole calendar, a missing return is zero; targets and predictors are dealt to
blocks, and a task meets one block of each. Session-by-session matrices are
bounded by the calendar; they are summed and decomposed in tasks, never on the
driver.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin, pin_by_row
from . import solvers
from .correlate import BLOCK_SERIES, LARGE_BYTES, LARGE_SERIES, LEAST_BLOCKS, beside, pack, series_blocks
from .select import dense_lagged


TILE, LEAST_ROOM = 64, 0.05
CANDIDATES, STATE_BYTES = 2048, 96 << 20


def _dealt(left: DataFrame, right: DataFrame, sessions: int, name: str, blocks: int | None, width: int = 1):
    """Both sides keyed by block pair; ``right`` has (series, values), a row of ``left`` holds ``width`` values per session.

    Blocks are as large as leaves work for every core; tasks work on them in tiles.
    """
    def count(x: DataFrame, held: int) -> int:
        n = x.count()
        size = max(1, min(LARGE_SERIES, LARGE_BYTES // (8 * held * max(sessions, 1))))
        return max(1, min(-(-n // BLOCK_SERIES), LEAST_BLOCKS), -(-n // size))

    na, nb = (blocks or count(x, held) for x, held in ((left, width), (right, 1)))

    def home(c, n):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    l = left.withColumn("_lb", home(name, na)).withColumn("_rb", spread(nb))
    r = right.select(F.col("series").alias("feature"), F.col("values").alias("x")).withColumn("_rb", home("feature", nb)).withColumn("_lb", spread(na))
    return l.groupBy("_lb", "_rb").cogroup(r.groupBy("_lb", "_rb"))


def _stack(col) -> np.ndarray:
    return np.stack(col.to_list()).astype(float)


def _start(targets: DataFrame) -> DataFrame:
    """Each target with its centred values as residual, and nothing chosen."""
    centre = F.transform("values", lambda v: v - F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / F.size("values"))
    return targets.select(F.col("series").alias("target"), centre.alias("r"), F.array().cast("array<array<double>>").alias("q"), F.array().cast("array<string>").alias("chosen"))


def _best_candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Each target's candidate of the largest gain, the first by name on ties.

    Products of unit vectors in single precision give every gain up to a known
    error; candidates that may be the best are computed in double precision.
    """
    rows = []
    if len(left) and len(right):
        right = right.sort_values("feature", ignore_index=True)
        x = _stack(right["x"])
        x = x - x.mean(axis=1, keepdims=True)
        scale, names = (x**2).sum(axis=1), right["feature"].to_numpy()
        unit = (x / np.sqrt(np.where(scale > 0, scale, 1.0))[:, None]).astype(np.float32).T
        slack = 8 * (2e-5 + 2e-7 * x.shape[1]) / LEAST_ROOM
        targets = list(left.itertuples())
        for lo in range(0, len(targets), TILE):
            some = targets[lo: lo + TILE]
            r = np.stack([t.r for t in some])
            share = (r / np.sqrt(np.maximum((r**2).sum(axis=1), 1e-300))[:, None]).astype(np.float32) @ unit
            share *= share
            taken = np.zeros_like(share)
            for k in range(max(len(t.q) for t in some)):
                with_k = [i for i, t in enumerate(some) if len(t.q) > k]
                part = np.stack([some[i].q[k] for i in with_k]).astype(np.float32) @ unit
                part *= part
                taken[with_k] += part
            room = np.subtract(1, taken, out=taken)
            unsure = room < LEAST_ROOM
            share /= np.maximum(room, LEAST_ROOM)
            share[unsure] = -1.0
            for i, t in enumerate(some):
                barred = [t.target, *t.chosen]
                at = np.searchsorted(names, barred)
                at = at[at < len(names)]
                share[i, at[np.isin(names[at], barred)]] = -1.0
                near = np.flatnonzero((share[i] >= max(share[i].max() - slack, 0.0)) | unsure[i])
                some_x = x[near]
                proj = some_x @ np.stack(t.q).T if len(t.q) else np.zeros((len(near), 0))
                left_over = scale[near] - (proj**2).sum(axis=1)
                ok = (left_over > 1e-10 * np.maximum(scale[near], 1e-300)) & ~np.isin(names[near], barred)
                gain = np.where(ok, (some_x @ t.r) ** 2 / np.where(ok, left_over, 1.0), -1.0)
                j = int(np.argmax(gain)) if len(near) else 0
                if len(near) and ok[j]:
                    rows.append((t.target, names[near[j]], gain[j]))
    return pd.DataFrame(rows, columns=["target", "feature", "gain"])


def _one_best(state: DataFrame, predictors: DataFrame, sessions: int, blocks: int | None, width: int = 1) -> DataFrame:
    pairs = _dealt(state, predictors, sessions, "target", blocks, width).applyInPandas(_best_candidates, "target string, feature string, gain double")
    return pairs.groupBy("target").agg(F.min_by(F.struct("feature", "gain"), F.struct(-F.col("gain"), "feature")).alias("b")).select("target", "b.*")


def first_step(returns: DataFrame, lag: int = 1, blocks: int | None = None) -> DataFrame:
    """What the first round of :func:`stepwise_pool` finds for every target, significant or not: target, feature, r2."""
    a, b = dense_lagged(returns, lag)
    state, predictors = pin(_start(pack(a))), pack(b)
    total = F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x)
    one = _one_best(state, predictors, predictors.agg(F.max(F.size("values"))).first()[0] or 0, blocks)
    return one.join(state.select("target", total.alias("_t")), "target").filter("_t > 0").select("target", "feature", (F.col("gain") / F.col("_t")).alias("r2"))


class _Candidates:
    """All predictors in a temporary file: centred values, and unit vectors in single precision by tiles of columns.

    What stays in memory are names and scales; pages of the file go when memory is short.
    """

    def __init__(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]):
        self.names, self.scale, exact, self.tiles, rest = [], [], tempfile.TemporaryFile(), [], None
        units, sessions = tempfile.TemporaryFile(), 0
        for names, x in blocks:
            sessions = x.shape[1]
            x = x - x.mean(axis=1, keepdims=True)
            scale = (x**2).sum(axis=1)
            exact.write(np.ascontiguousarray(x))
            unit = (x / np.sqrt(np.where(scale > 0, scale, 1.0))[:, None]).astype(np.float32)
            rest = unit if rest is None else np.concatenate([rest, unit])
            while len(rest) >= CANDIDATES:
                self._tile(units, rest[:CANDIDATES])
                rest = rest[CANDIDATES:]
            self.names.append(names)
            self.scale.append(scale)
        if rest is not None and len(rest):
            self._tile(units, rest)
        self.names = np.concatenate(self.names) if self.names else np.zeros(0, object)
        self.scale = np.concatenate(self.scale) if self.scale else np.zeros(0)
        self.place = {f: i for i, f in enumerate(self.names)}
        for f in (exact, units):
            f.flush()
        if len(self.names):
            self.x = np.memmap(exact, float, "r", shape=(len(self.names), sessions))
            self.unit = [np.memmap(units, np.float32, "r", at, (sessions, n)) for at, n in self.tiles]

    def _tile(self, units, rows: np.ndarray) -> None:
        self.tiles.append((units.tell(), len(rows)))
        units.write(np.ascontiguousarray(rows.T))


def _steps_of(names: np.ndarray, y: np.ndarray, all_of: _Candidates, enter: float, cap: int) -> list[tuple]:
    """(target, step, feature, p-value) of some targets, all rounds at once.

    A target keeps the products of its residual with every candidate and how much
    of each candidate its choices leave over, in single precision. A round adds
    the products with the newest basis vector only. Candidates that may be the
    best, with all that have little left over, are computed in double precision.
    """
    rows, r = [], y - y.mean(axis=1, keepdims=True)
    size = np.sqrt(np.maximum((r**2).sum(axis=1), 1e-300))
    live, basis, fresh, fit = np.arange(len(names)), [[] for _ in names], r / size[:, None], np.ones(len(names))
    share, room = ([np.full((len(names), u.shape[1]), v, np.float32) for u in all_of.unit] for v in (0, 1))  # one contiguous tile each
    for i, t in enumerate(names):
        if t in all_of.place:
            room[all_of.place[t] // CANDIDATES][i, all_of.place[t] % CANDIDATES] = np.inf
    loss = 2e-5 + 2e-7 * y.shape[1]
    for step in range(1, cap + 1):
        new, loss_of = fresh.astype(np.float32), fit.astype(np.float32)[:, None]
        most, least = (np.empty((len(live), len(share)), np.float32) for _ in range(2))
        spare = np.empty((2, len(live) * CANDIDATES), np.float32)
        for c, (unit, s, w) in enumerate(zip(all_of.unit, share, room)):
            g, h = (a[: s.size].reshape(s.shape) for a in spare)
            np.matmul(new, unit, out=g)
            if step == 1:
                s[:] = g
            else:
                s -= np.multiply(g, loss_of, out=h)
                w -= np.square(g, out=g)
            np.divide(np.square(s, out=g), np.maximum(w, LEAST_ROOM, out=h), out=g)
            g.max(axis=1, out=most[:, c])
            w.min(axis=1, out=least[:, c])
        kept, fresh, fit = [], [], []
        for i, t in enumerate(live):
            rel = r[t] / size[t]
            have = float(rel @ rel)
            slack = 4 * loss * (2 * math.sqrt(have) + loss + have) / LEAST_ROOM
            floor, near = max(float(most[i].max()) - slack, 0.0), []
            for c in np.flatnonzero((most[i] >= floor) | (least[i] < LEAST_ROOM)):
                s, w = share[c][i], room[c][i]
                near.append(c * CANDIDATES + np.flatnonzero((np.square(s) / np.maximum(w, LEAST_ROOM) >= floor) & np.isfinite(w) | (w < LEAST_ROOM)))
            near = np.concatenate(near) if near else np.zeros(0, int)
            x, q = np.asarray(all_of.x[near]), np.stack(basis[t]) if basis[t] else np.zeros((0, y.shape[1]))
            left_over = all_of.scale[near] - ((x @ q.T) ** 2).sum(axis=1)
            ok = left_over > 1e-10 * np.maximum(all_of.scale[near], 1e-300)
            for k in near[~ok]:
                room[k // CANDIDATES][i, k % CANDIDATES] = np.inf  # nothing is left over of it in later rounds either
            near, x, left_over = near[ok], x[ok], left_over[ok]
            if not len(near):
                continue
            gains = (x @ r[t]) ** 2 / left_over
            best = np.flatnonzero(gains >= gains.max() * (1 - 1e-12))
            j = min(best, key=lambda b: all_of.names[near[b]])
            df = y.shape[1] - len(basis[t]) - 2
            rss = float(r[t] @ r[t]) - float(gains[j])
            p = (0.0 if rss <= 0 else solvers.t_two_sided(math.sqrt(float(gains[j]) / (rss / df)), df)) if df > 0 else 1.0
            if p < enter:
                v = x[j] - x[j].mean()
                for _ in range(2):  # twice is enough
                    for u in basis[t]:
                        v = v - (v @ u) * u
                v = v / np.sqrt(v @ v)
                rows.append((names[t], step, all_of.names[near[j]], p))
                room[near[j] // CANDIDATES][i, near[j] % CANDIDATES] = np.inf
                kept.append(i)
                fresh.append(v)
                fit.append(float(rel @ v))
                basis[t].append(v)
                r[t] = r[t] - (r[t] @ v) * v
        if not kept:
            break
        if len(kept) < len(live):
            share, room, live = [a[kept] for a in share], [a[kept] for a in room], live[kept]
        fresh, fit = np.stack(fresh), np.array(fit)
    return rows


def stepwise_pool(returns: DataFrame, lag: int = 1, enter: float = 0.05, cap: int = 10, blocks: int | None = None) -> DataFrame:
    """Forward stepwise least squares per target over all other tickers: target, step, feature, entry p-value.

    A task holds a block of targets and meets every predictor, so a target's
    rounds need no exchange: see :func:`_steps_of`. Targets whose best p-value is
    not below ``enter`` drop out. At most ``cap`` rounds.
    """
    a, b = dense_lagged(returns, lag)
    targets = series_blocks(pack(a), TILE, 4 * LEAST_BLOCKS, blocks).drop("days", "sizes")
    predictors = series_blocks(pack(b), blocks=blocks).drop("days", "sizes").coalesce(1)  # a task reads them all, one after the other

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = {}

        def met():
            seen = set()
            for d in batches:
                for row in d.itertuples():
                    mine.setdefault(row.r_block, (np.asarray(row.r_names, object), np.asarray(row.r_values, float).reshape(len(row.r_names), -1)))
                    if row.block not in seen:
                        seen.add(row.block)
                        yield np.asarray(row.names, object), np.asarray(row.values, float).reshape(len(row.names), -1)

        all_of = _Candidates(met())
        tile = max(1, min(TILE, STATE_BYTES // (8 * max(len(all_of.names), 1))))
        for names, y in mine.values():
            for lo in range(0, len(names), tile):
                yield pd.DataFrame(_steps_of(names[lo: lo + tile], y[lo: lo + tile], all_of, enter, cap), columns=["target", "step", "feature", "p_value"])

    return pin_by_row(beside(predictors, targets).mapInPandas(search, "target string, step int, feature string, p_value double"))


def session_gram(packed: DataFrame) -> DataFrame:
    """Sum of x x' over all series, stored as one row (i, values) per session; one partial sum per task."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for d in batches:
            if len(d):
                x = _stack(d["values"])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "values": list(total)})

    def added(d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": d["i"].iloc[:1], "values": [_stack(d["values"]).sum(axis=0)]})

    kind = "i int, values array<double>"
    return pin(packed.select("values").mapInPandas(part, kind).groupBy("i").applyInPandas(added, kind))


def spectrum(gram: DataFrame, cut: int) -> DataFrame:
    """The Gram rows with the eigenvectors and eigenvalues of its first ``cut`` sessions: one decomposition for all targets.

    One task holds the sessions-by-sessions matrix (8 bytes times the square of the calendar's length).
    """
    def solve(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i", ignore_index=True)
        k = _stack(d["values"])
        s, u = np.linalg.eigh(k[:cut, :cut])
        good = s > 1e-10 * max(s[-1], 1e-300)
        return pd.DataFrame({"i": d["i"], "k": list(k[:, :cut]), "u": [*u[:, good], *[np.zeros(0)] * (len(k) - cut)], "s": [s[good]] + [np.zeros(0)] * (len(k) - 1)})

    return pin(gram.groupBy().applyInPandas(solve, "i int, k array<double>, u array<double>, s array<double>"))


def without_own(s: np.ndarray, y: np.ndarray, o: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions and traces of (diag(s) - o o' + lam)^-1 for rows of y, o and lam: the shared Gram without a target's own series.

    A correction of rank one (Sherman and Morrison) of the shared spectrum, so no target needs a decomposition of its own.
    """
    inv = 1 / (s[None, :] + lam[:, None])
    oy, oo = (o * inv * y).sum(axis=1), (o * inv * o).sum(axis=1)
    rest = np.maximum(1 - oo, 1e-12)
    return inv * (y + (oy / rest)[:, None] * o), inv.sum(axis=1) + (o * inv * inv * o).sum(axis=1) / rest


def evidence(s: np.ndarray, y: np.ndarray, o: np.ndarray, yy: np.ndarray, n: int, steps: int = 300) -> np.ndarray:
    """Penalty of each row that maximises the evidence (fixed point)."""
    lam, live = np.ones(len(y)), np.arange(len(y))
    beyond = np.maximum(yy - (y**2).sum(axis=1), 0.0)
    for _ in range(steps):
        if not len(live):
            break
        now = lam[live]
        a, trace = without_own(s, y[live], o[live], now)
        gamma = np.maximum(len(s) - now * trace, 0.0)
        norm = (a * a * s).sum(axis=1) - (a * o[live]).sum(axis=1) ** 2
        rss = now**2 * (a * a).sum(axis=1) + beyond[live]
        new = gamma / np.maximum(norm, 1e-300) * rss / np.maximum(n - gamma, 1e-9)
        settled = np.abs(new - now) <= 1e-9 * now
        lam[live] = np.where(settled, now, np.clip(new, 1e-9, 1e12))
        live = live[~settled]
    return lam


def ridge_pool(returns: DataFrame, lag: int = 1, penalty: float = 1.0, train_share: float = 0.8, top: int = 10, blocks: int | None = None) -> DataFrame:
    """Ridge and Bayesian ridge of each target on all other tickers: target, model, n, train_r2, test_r2, features.

    Predictors are standardised on the first ``train_share`` of the sessions. The
    fit is made in session space: it needs only the session-by-session Gram
    matrix of all predictors, decomposed once; a target's own series is taken out
    by a correction of rank one. ``features`` are the ``top`` strongest
    coefficients. A share without spread in the target has a null r2.
    """
    a, b = dense_lagged(returns, lag)
    targets, predictors = pack(a), pack(b)
    n = predictors.agg(F.max(F.size("values"))).first()[0] or 0
    cut = int(n * train_share)
    train = F.slice("values", 1, max(cut, 1))
    mean = F.aggregate(train, F.lit(0.0), lambda s, x: s + x) / cut
    std = F.sqrt(F.aggregate(train, F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / cut)
    scaled = predictors.withColumn("_m", mean).withColumn("_s", std).select("series", F.transform("values", lambda v: (v - F.col("_m")) / (F.col("_s") + 1e-8)).alias("values"))
    scaled = pin(scaled)
    if cut < 3 or n - cut < 2:
        return targets.select(F.col("series").alias("target")).limit(0).selectExpr("target", "'' AS model", "0L AS n", "0D AS train_r2", "0D AS test_r2", "'' AS features")
    shared = spectrum(session_gram(scaled), cut)
    sides = targets.select(F.col("series").alias("target"), F.col("values").alias("y")).join(
        scaled.select(F.col("series").alias("target"), F.col("values").alias("x")), "target")
    parts = max(1, -(-targets.count() // BLOCK_SERIES))
    dealt = sides.withColumn("part", F.pmod(F.xxhash64("target"), F.lit(parts)).cast("int"))
    given = shared.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def fit(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(d) and len(g):
            g = g.sort_values("i", ignore_index=True)
            k, u, s = _stack(g["k"]), _stack(g["u"][:cut]), np.asarray(g["s"][0], float)
            y, own = _stack(d["y"]), _stack(d["x"])
            middle = y[:, :cut].mean(axis=1, keepdims=True)
            uy, uo, yy = (y[:, :cut] - middle) @ u, own[:, :cut] @ u, ((y[:, :cut] - middle) ** 2).sum(axis=1)
            for model in ("ridge", "bayes"):
                lam = np.full(len(y), float(penalty)) if model == "ridge" else evidence(s, uy, uo, yy, cut)
                a, _ = without_own(s, uy, uo, lam)
                alpha = a @ u.T
                p = alpha @ k.T - own * (a * uo).sum(axis=1, keepdims=True) + middle
                with np.errstate(divide="ignore", invalid="ignore"):
                    r2 = [1 - ((y[:, w] - p[:, w]) ** 2).sum(axis=1) / ((y[:, w] - y[:, w].mean(axis=1, keepdims=True)) ** 2).sum(axis=1) for w in (slice(0, cut), slice(cut, n))]
                rows += [(t, model, n, *(float(v) if np.isfinite(v) else None for v in (b, c)), w) for t, b, c, w in zip(d["target"], *r2, alpha)]
        return pd.DataFrame(rows, columns=["target", "model", "n", "train_r2", "test_r2", "alpha"])

    fits = pin(dealt.groupBy("part").cogroup(given.groupBy("at")).applyInPandas(
        fit, "target string, model string, n long, train_r2 double, test_r2 double, alpha array<double>"))

    def strongest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            right = right.sort_values("feature", ignore_index=True)
            names, x = right["feature"].to_numpy(), _stack(right["x"])[:, :cut].T
            keys, alpha = list(zip(left["target"], left["model"])), _stack(left["alpha"])
            for lo in range(0, len(keys), TILE):
                w = np.abs(alpha[lo: lo + TILE] @ x)
                own = [t for t, _ in keys[lo: lo + TILE]]
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                mine = np.flatnonzero(names[at] == own)
                w[mine, at[mine]] = 0.0
                few = w[:, : 32 * top]
                floor = np.partition(few, -top, axis=1)[:, -top] if few.shape[1] > top else np.zeros(len(w))
                i, j = np.nonzero(w >= floor[:, None])
                order = np.lexsort((j, -w[i, j], i))
                i, j = i[order], j[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < top
                rows += [(*keys[lo + a], names[b], w[a, b]) for a, b in zip(i[best], j[best])]
        return pd.DataFrame(rows, columns=["target", "model", "feature", "w"])

    near = _dealt(fits.select("target", "model", "alpha"), scaled, n, "target", blocks).applyInPandas(strongest, "target string, model string, feature string, w double")
    named = near.groupBy("target", "model").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "feature"))), 1, top)["feature"].alias("f"))
    return fits.drop("alpha").join(named, ["target", "model"]).select("target", "model", "n", "train_r2", "test_r2", F.array_join("f", ",").alias("features"))
