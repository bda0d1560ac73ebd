"""Spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced character turns one into
the other. For every word its neighbourhood is generated as hashes: all
deletions, and all replacements by a greater character (each near pair is met
from one side). The hashes are probed against blocked Bloom filters of the
vocabulary, one per word length, that every task holds. Only what a filter lets
through becomes a string, is shuffled and joined with the vocabulary, which
removes the false positives. An edit's hash follows from prefix sums of the
word's hash in constant time, so only positives are ever built.

A filter has blocks of 256 bits, one bit in each of its eight lanes per word.
All filters of a round together stay below ``filter_bytes``; a larger vocabulary
is probed in several rounds, each over one slice by hash, so that what is
broadcast never grows with the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .textops import mix64

SPILL_WORDS, CHUNK = 200_000, 1 << 18
LANES, BITS_PER_WORD, MOST_SHARDS = 8, 16, 48
_LETTERS = np.random.default_rng(97).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)  # fixed values: any odd numbers


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5,
                change: Callable[[bytes, bytes], bytes] | None = None) -> DataFrame:
    """(word, n): how often each word of at least ``least`` characters occurs in all texts.

    Words are maximal runs of Latin letters (``[A-Za-z\\u00C0-\\u00FF]``), with
    A-Z in lower case. ``change`` maps (id as text, word), both Latin-1 bytes, to
    the word that counts instead. A null text has no words, a null id is the
    empty text.
    """
    find = re.compile(rb"[a-z\xc0-\xff]+").findall

    def flush(total: Counter) -> pa.RecordBatch:
        keep = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= least]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], ["word", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = Counter(find((text or "").encode("latin-1", "replace").lower()))  # other characters become '?', which ends a word
                if change is None:
                    total.update(found)
                else:
                    name = (key or "").encode("latin-1", "replace")
                    for w, n in found.items():
                        total[change(name, w)] += n
                if len(total) >= SPILL_WORDS:
                    yield flush(total)
                    total = Counter()
        yield flush(total)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _finish(total: np.ndarray, length: int) -> np.ndarray:
    return mix64(total + np.uint64(length))


def word_hash(word: bytes) -> int:
    """The hash whose edits :func:`edit_hashes` gives."""
    v = _LETTERS[np.frombuffer(word, np.uint8)]
    return int(_finish((v * _powers(len(v))[: len(v)]).sum(dtype=np.uint64), len(v)))


def edit_hashes(word: bytes, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hashes, places, characters) of the deletions (character 0) and of the replacements by a greater character."""
    raw = np.frombuffer(word, np.uint8)
    n = len(raw)
    up = _powers(n)
    v = _LETTERS[raw]
    terms = v * up[:n]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    down = np.uint64(pow(_BASE, -1, 2**64))
    one = np.concatenate([[True], raw[1:] != raw[:-1]])  # deleting any letter of a double one gives the same word
    at = np.flatnonzero(one)
    if n > 1:
        yield n - 1, _finish(sums[at] + (sums[n] - sums[at + 1]) * down, n - 1), at, np.zeros(len(at), np.uint8)
    step = max(1, CHUNK // max(len(alphabet), 1))
    for lo in range(0, n, step):
        place, letter = np.nonzero(alphabet[None, :] > raw[lo: lo + step, None])
        place += lo
        code = alphabet[letter]
        yield n, _finish(sums[n] + (_LETTERS[code] - v[place]) * up[place], n), place, code


def _masks(h: np.ndarray) -> np.ndarray:
    """The bit of each lane, as a 32-bit mask, from the low half of the hashes."""
    low = h & np.uint64(0xFFFFFFFF)
    return np.uint32(1) << (((low[:, None] * _ODD[None, :]) >> np.uint64(27)) & np.uint64(31)).astype(np.uint32)


class Filters:
    """Blocked Bloom filters, one per shard of word lengths."""

    def __init__(self, blocks: dict[int, int]):
        self.start, at = {}, 0
        for shard in sorted(blocks):
            self.start[shard] = (at, blocks[shard])
            at += blocks[shard]
        self.bits = np.zeros((at, LANES), np.uint32)

    def place(self, shard: int, h: np.ndarray) -> np.ndarray:
        first, n = self.start[shard]
        return first + ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def holds(self, shard: int, h: np.ndarray) -> np.ndarray:
        if shard not in self.start:
            return np.zeros(len(h), bool)
        out = np.zeros(len(h), bool)
        for lo in range(0, len(h), CHUNK):
            part = h[lo: lo + CHUNK]
            block, mask = self.bits[self.place(shard, part)], _masks(part)
            out[lo: lo + CHUNK] = ((block & mask) == mask).all(axis=1)
        return out


def shard_of(length: int) -> int:
    """One shard per length; very long words share shards."""
    return length if length <= MOST_SHARDS else MOST_SHARDS + 1 + length % 8


def build_filters(words: DataFrame, rounds: int, turn: int) -> Filters:
    """Filters of the words whose hash is ``turn`` modulo ``rounds``; tasks set the bits, Spark joins the blocks."""
    spark = words.sparkSession
    mine = words.filter(F.pmod("h", F.lit(rounds)) == turn)
    sizes = {r["shard"]: max(1, -(-r["n"] * BITS_PER_WORD // (32 * LANES))) for r in mine.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    filters = Filters(sizes)
    layout = spark.sparkContext.broadcast(Filters(sizes).start)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Filters({})
        empty.start = layout.value
        for b in batches:
            shards, h = b.column("shard").to_numpy(), b.column("h").to_numpy().view(np.uint64)
            for shard in np.unique(shards):
                part = h[shards == shard]
                rows = [pa.array(empty.place(int(shard), part)), *[pa.array(m.astype(np.int64)) for m in _masks(part).T]]
                yield pa.RecordBatch.from_arrays(rows, ["block", *[f"m{i}" for i in range(LANES)]])

    masks = ", ".join(f"m{i} long" for i in range(LANES))
    got = mine.select("shard", "h").mapInArrow(scan, f"block long, {masks}").groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(LANES)])
    for r in got.toPandas().to_numpy(np.int64).reshape(-1, LANES + 1) if sizes else []:  # at most filter_bytes
        filters.bits[r[0]] = r[1:].astype(np.uint32)
    return filters


def hashed(words: DataFrame) -> DataFrame:
    """``words`` with h (hash) and shard (of its length)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            h = np.array([word_hash(w) for w in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h), pa.array([shard_of(len(w)) for w in raw], pa.int32())], [*b.schema.names, "h", "shard"])
    return words.select("word", "n").mapInArrow(scan, "word string, n long, h long, shard int")


def positives(words: DataFrame, filters: Filters, alphabet: bytes, rounds: int, turn: int) -> DataFrame:
    """(a, b): each word with every edit of it that the filters let through."""
    held = words.sparkSession.sparkContext.broadcast((filters.start, filters.bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Filters({})
        probe.start, probe.bits = held.value
        letters = np.frombuffer(alphabet, np.uint8)
        for batch in batches:
            a, b = [], []
            for word in batch.column("word").to_pylist():
                raw = word.encode("latin-1")
                for length, h, place, code in edit_hashes(raw, letters):
                    if rounds > 1:
                        mine = h.view(np.int64) % rounds == turn  # as pmod: the remainder is never negative
                        h, place, code = h[mine], place[mine], code[mine]
                    for i in np.flatnonzero(probe.holds(shard_of(length), h)).tolist():
                        p = int(place[i])
                        a.append(word)
                        b.append(word[:p] + (chr(code[i]) if code[i] else "") + word[p + 1:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])
    return words.select("word").mapInArrow(scan, "a string, b string")


def variants(words: DataFrame, factor: int = 2, filter_bytes: int = 32 << 20) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of ``words`` (word, n); words are distinct and Latin-1.

    form is the near word with the largest n (ties: the smallest by code point)
    if that is at least ``factor`` (2 or more) times the word's own n, else null;
    form_n its n. root follows forms to the last word (the word itself without
    a form); every step at least doubles n, so there is no cycle. n_near counts
    near words. An empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("forms need a factor of 2 or more to end")
    words = pin(hashed(words))
    total = words.count()
    found = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()  # at most 256
    alphabet = bytes(sorted(ord(r["c"]) for r in found))
    rounds = max(1, -(-total * BITS_PER_WORD // (8 * filter_bytes)))
    met = None
    for turn in range(rounds):
        part = pin(positives(words, build_filters(words, rounds, turn), alphabet, rounds, turn))
        met = part if met is None else met.unionByName(part)
    real = pin(met.join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
               .join(words.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").select("a", "b", "na", "nb"))
    both = real.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")).unionByName(
        real.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = words.select("word", "n").join(best, "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    out = pin(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"),
                          F.when(fits, -F.col("best.less")).alias("form_n")))
    step = pin(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # every round doubles the steps that a root stands for
        nxt = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = pin(step.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ahead.filter("moved").isEmpty():
            break
        step = ahead.select("word", "root")
    named = out.join(step, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
