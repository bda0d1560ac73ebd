"""Periodic runs of words, by Baier grouping.

A run is a stretch of words with smallest period q that no neighbouring word
extends, here of at least ``min_length`` words and ``min_periods`` periods. Every
run holds a Lyndon root that is the longest Lyndon word at its place, for one of
two opposite orders of the words. Both Lyndon arrays come from phase one of
Baier's suffix sorter alone: suffixes are grouped by first word, groups are taken
from the greatest down, and each hands its context on to the nearest smaller
suffix on the left; the length of a suffix's final context is its longest Lyndon
word. Each root is then extended by longest common extensions to both sides.
Extensions compare prefix hashes; every run is checked word by word before it
counts.

A run of L words and period q has L - q >= ``(min_periods - 1) / min_periods * L``
words that repeat q words later, so each of its words lies in a repeated window
of that many words. Only stretches covered by repeated windows are searched; a
stretch holds its runs whole, so nothing is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Rolling, mix64


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place: phase one of Baier's suffix sorter."""
    n = len(ranks)
    sa = sorted(range(n), key=ranks.__getitem__)
    isa, group, size, context = [0] * n, [0] * n, [0] * n, [1] * n
    start = 0
    for k, i in enumerate(sa):
        if ranks[i] != ranks[sa[start]]:
            start = k
        isa[i], group[i] = k, start
        size[start] += 1
    left = list(range(-1, n))  # left[i + 1]: nearest place <= i of a smaller group, found by path halving
    out = [1] * n
    end = n
    while end:
        at = group[sa[end - 1]]
        length = context[at]
        members = sa[at:end]
        end = at
        for i in members:
            left[i + 1] = left[i]
            out[i] = length
        pointed: dict[int, int] = {}
        for i in members:
            k = i
            while left[k] != k - 1:
                left[k] = left[left[k] + 1]
                k = left[k] + 1
            if k:
                pointed[k - 1] = pointed.get(k - 1, 0) + 1
        if not pointed:
            continue
        if max(pointed.values()) == 1:
            sets = [(1, pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, []).append(j)
            sets = sorted(by_count.items(), reverse=True)
        for times, places in sets:
            for j in places:  # to the back of its group
                old = group[j]
                size[old] -= 1
                back, k = old + size[old], isa[j]
                other = sa[back]
                sa[k], isa[other] = other, k
                sa[back], isa[j] = j, back
            fresh: dict[int, int] = {}
            for j in places:  # the moved ones are a group of their own, just above what is left of theirs
                old = group[j]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = old + size[old]
                    context[new], size[new] = context[old] + times * length, 0
                size[new] += 1
                group[j] = new
    return out


class Extensions:
    """Longest common extensions by binary search on prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.hash = Rolling(mix64(ids.astype(np.uint64) + np.uint64(1)), "word")

    def _longest(self, same, most: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = same(mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j > i on."""
        return self._longest(lambda m: self.hash.spans(i, i + m) == self.hash.spans(j, j + m), self.n - j)

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and before j > i."""
        return self._longest(lambda m: self.hash.spans(i - m, i) == self.hash.spans(j - m, j), i.copy())


def runs_of(ids: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch of word numbers, by start and period."""
    n = len(ids)
    if n < max(min_length, min_periods):
        return []
    lce, found = Extensions(ids), set()
    for ranks in (ids, ids.max() - ids):
        p = np.array(lyndon_array(ranks.tolist()), np.int64)
        i = np.flatnonzero(np.arange(n) + p < n)
        if min_periods >= 3:  # then some root of the run repeats at once
            i = i[i + 2 * p[i] <= n]
            i = i[lce.hash.spans(i, i + p[i]) == lce.hash.spans(i + p[i], i + 2 * p[i])]
        back, ahead = lce.left(i, i + p[i]), lce.right(i, i + p[i])
        total = back + ahead + p[i]
        good = (total >= min_length) & (total >= min_periods * p[i])
        found |= set(zip((i - back)[good].tolist(), total[good].tolist(), p[i][good].tolist()))
    for s, m, q in found:
        e = s + m
        if not np.array_equal(ids[s: e - q], ids[s + q: e]) or (s and ids[s - 1] == ids[s - 1 + q]) or (e < n and ids[e] == ids[e - q]):
            raise RuntimeError("two different stretches of words have one hash")
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal (start, end) covered by windows that occur twice or more; the whole text for window 0."""
    if not window:
        return [(0, len(ids))] if len(ids) else []
    codes = Rolling(mix64(ids.astype(np.uint64) + np.uint64(1)), "word").windows(window)
    if len(codes) < 2:
        return []
    order = np.argsort(codes, kind="stable")
    twin = np.concatenate([[False], codes[order][1:] == codes[order][:-1], [False]])
    many = np.zeros(len(ids) + 1, np.int64)
    hits = order[twin[1:] | twin[:-1]]
    if not len(hits):
        return []
    np.add.at(many, hits, 1)
    np.add.at(many, hits + window, -1)
    cover = np.concatenate([[0], (np.cumsum(many[:-1]) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(cover))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def text_runs(words: list[bytes], min_length: int = 24, min_periods: int = 3, search_all: bool = False) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    window = 0 if search_all else math.ceil(min_length * (min_periods - 1) / min_periods)
    out = []
    for lo, hi in stretches(ids, window) if len(known) < len(words) else []:
        if hi - lo >= min_length:
            _, part = np.unique(ids[lo:hi], return_inverse=True)
            out += [(lo + s, m, q) for s, m, q in runs_of(part, min_length, min_periods)]
    return out


RESULT = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs array<struct<start: long, length: long, period: long>>, n_dropped long, kept_text string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_periods: int = 3,
                  search_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: its runs, the one of greatest exponent and the text without repeats.

    Columns: id, n_words, n_runs, start, length, period, exponent_milli (the run
    of greatest length/period, ties by start, then period; null without a run),
    runs (all, by start, then period), n_dropped, kept_text (words joined by one
    space; a word that any run holds after its first period is dropped). Words
    are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null, empty and blank texts have no
    word. Null and repeated ids are rows like others; other columns are ignored.
    ``search_all`` searches whole texts instead of repeated windows; same result.
    ``min_periods`` is at least 2.
    """
    if min_periods < 2:
        raise ValueError("a run has at least two periods")
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # on bytes: the six ASCII space characters only
                found = text_runs(words, min_length, min_periods, search_all)
                drop = np.zeros(len(words) + 1, np.int64)
                for s, m, q in found:
                    drop[s + q] += 1
                    drop[s + m] -= 1
                drop = np.cumsum(drop[:-1]) > 0
                kept = [w for w, d in zip(words, drop.tolist()) if not d] if found else words
                best = None
                for s, m, q in found:
                    if best is None or m * best[2] > best[1] * q:
                        best = (s, m, q)
                s, m, q = best or (None, None, None)
                rows.append((len(words), len(found), s, m, q, 1000 * m // q if best else None,
                             [{"start": a, "length": b, "period": c} for a, b, c in found], int(drop.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])), pa.int64(), pa.string()]
            names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "n_dropped", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, {RESULT}")
    return rows.withColumnRenamed("id", id_col) if id_col not in RESULT.replace(",", " ").split() else rows


def runs_digest(runs: str = "runs"):
    """sha256 of every run's ``start,length,period`` and a line feed, in order."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")), 256)
