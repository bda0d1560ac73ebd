"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``length`` consecutive words of one text. Each word covered by a
window whose word sequence also starts in a document with a smaller id is
removed; repeated windows merge into maximal removal intervals.

Windows reach Spark as *runs*. The anchor of a window is the smallest hash of
its ``gram``-word sequences, so equal windows have equal anchors, and successive
windows mostly share one. A run (successive windows with one anchor) carries the
Rabin-Karp hash of its whole span. Per anchor Spark counts who has it:

* one document only: none of its windows repeats across documents;
* several documents, one span hash: all windows of the run repeat together;
* several documents and spans: the windows of these runs are hashed and counted
  one by one (by anchor and window hash, 128 bits together).

Aggregates combine on the map side and both look-ups are joins that AQE may
split, so copies of one text cost no single task more. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import textops as T
from .joins import lookup

LAST = 2**63 - 1
RUNS = "ord long, th long, anchor long, start int, n int, span long"
WINDOWS = "ord long, th long, anchor long, start int, h long"


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"),
                       F.xxhash64(text).alias("th"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))


def _anchors(raw, off, length: int, gram: int):
    """Per chunk: word hashes, each text's word offsets, starts of whole windows and their anchors."""
    ws, we, wo = T.cut_words(raw, off)
    roll = T.Rolling(T.hash_words(raw, ws, we), "word")
    low = T.sliding_min(roll.windows(gram), length - gram + 1)
    first = np.arange(len(low))
    owner = np.searchsorted(wo, first, "right") - 1
    whole = first + length <= wo[owner + 1]
    return roll, wo, first[whole], owner[whole], low[whole]


def _runs(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column("ord").to_numpy(), b.column("th").to_numpy()
            for at, raw, off in T.chunks(b.column("text")):
                roll, wo, pos, owner, low = _anchors(raw, off, length, gram)
                if not len(pos):
                    continue
                cut = np.flatnonzero((np.diff(low) != 0) | (np.diff(pos) != 1)) + 1
                lo = np.concatenate([[0], cut])
                hi = np.concatenate([cut, [len(pos)]])
                doc = owner[lo]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at + doc]), pa.array(th[at + doc]), pa.array(low[lo].view(np.int64)),
                    pa.array((pos[lo] - wo[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                    pa.array(roll.spans(pos[lo], pos[hi - 1] + length).view(np.int64))],
                    ["ord", "th", "anchor", "start", "n", "span"])
    return scan


def _windows(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column("ord").to_numpy(), b.column("th").to_numpy()
            spots = b.column("open").to_pylist()
            for at, raw, off in T.chunks(b.column("text")):
                ws, we, wo = T.cut_words(raw, off)
                hashes = T.Rolling(T.hash_words(raw, ws, we), "word").windows(length)
                rows = []
                for i in range(len(off) - 1):
                    runs = {(r["start"], r["n"]): r["anchor"] for r in spots[at + i]}
                    rows += [(at + i, wo[i], s, n, a) for (s, n), a in runs.items()]
                if not rows:
                    continue
                doc, base, s, n, a = (np.array(x, np.int64) for x in zip(*rows))
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start, doc = np.repeat(s, n) + step, np.repeat(doc, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[doc]), pa.array(th[doc]), pa.array(np.repeat(a, n)), pa.array(start.astype(np.int32)),
                    pa.array(hashes[np.repeat(base, n) + start].view(np.int64))], ["ord", "th", "anchor", "start", "h"])
    return scan


def _covered(spots, length: int, n_words: int) -> np.ndarray:
    step = np.zeros(n_words + 1, np.int32)
    if spots:
        np.add.at(step, [r["start"] for r in spots], 1)
        np.add.at(step, [r["start"] + r["n"] + length - 1 for r in spots], -1)
    return np.cumsum(step[:-1]) > 0


def _cleaned(length: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots, out = b.column("cuts").to_pylist(), []
            for text, cuts in zip(b.column("text").to_pylist(), spots):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = _covered(cuts, length, len(words))
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                clean_text = b" ".join(kept)
                out.append((len(words), int(gone.sum()), hashlib.sha256(clean_text).hexdigest(),
                            [{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)], clean_text.decode("utf-8") if gone.any() else text))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)], b.column("rest")],
                ["id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text", "rest"])
    return clean


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 12,
                    carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, removed (intervals of word positions), kept_text, rest.

    ``kept_text`` is the text as it is (null too) where nothing goes, else the kept
    words joined by one space; kept_sha256 is always of the joined words.
    ``gram`` (at most ``length``) only steers how windows are grouped on their
    way, never the result. Null or empty text, or one without words: zero words,
    the hash of an empty text. A null id counts as larger than every other; rows
    with equal ids never remove from each other, equal rows get equal results.
    ``rest`` is a struct of the columns named in ``carry``; all others are left
    out, so names cannot clash.
    """
    keyed = _keyed(docs, id_col, text_col, carry)
    runs = pin(keyed.select("ord", "th", "text").mapInArrow(_runs(length, gram), RUNS))
    shared = runs.groupBy("anchor").agg(
        F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("span").alias("s0"), F.max("span").alias("s1"))
    shared = shared.filter("lo < hi").select("anchor", "lo", (F.col("s0") == F.col("s1")).alias("sole"))
    hits = pin(lookup(runs.drop("span"), shared, "anchor").filter("NOT sole OR ord > lo").drop("lo"))
    whole = hits.filter("sole").select("ord", "th", "start", "n")
    open_runs = hits.filter("NOT sole").groupBy("ord", "th").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("open"))
    # Both joins below shuffle the texts by the same key: Spark makes that exchange once and reuses it.
    windows = keyed.join(open_runs, ["ord", "th"]).select("ord", "th", "id", "text", "rest", "open").mapInArrow(_windows(length, gram), WINDOWS)
    firsts = windows.groupBy("anchor", "h").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").drop("hi")
    single = lookup(windows, firsts, ["anchor", "h"]).filter("ord > lo").select("ord", "th", "start", F.lit(1).alias("n"))
    cuts = whole.unionByName(single).groupBy("ord", "th").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    joined = keyed.join(cuts, ["ord", "th"], "left").select("ord", "th", "id", "text", "rest", "cuts")
    shape = joined.select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256"),
                          F.expr("cast(null as array<struct<start:long,stop:long>>)").alias("removed"), F.lit(None).cast("string").alias("kept_text"), "rest").schema
    return joined.mapInArrow(_cleaned(length), shape).withColumnRenamed("id", id_col)
