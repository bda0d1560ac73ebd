"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits: bit i is set if it is set in more than half of
the XXH64 values (seed 42) of its word shingles. Fingerprints link at ``radius``
or fewer differing bits; a group is what links connect.

BK-trees find the links: a child hangs below its parent under their integer
Hamming distance d, and a search within r follows only edges d-r..d+r. One tree
of all fingerprints, broadcast to every task, would grow with the input, and a
search of it is far from constant. Trees are therefore built per shard from
fingerprints that can be linked at all: of k blocks of the 64 bits at least
k-radius are equal in a linked pair, so a fingerprint goes to one bucket per
choice of k-radius blocks, and each bucket is a tree. k grows with the number of
distinct fingerprints. No link is lost.

A bucket of more than ``bucket_rows`` distinct fingerprints (a large family of
near copies) is not searched by tree but through the 65 values within one bit
of each fingerprint: two fingerprints are at most two bits apart exactly if they
share such a value, and at most 65 fingerprints share one. That is exact, linear
and free of hot keys (only for radius 2 or less; beyond it buckets are never
moved).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from ..session import pin
from .components import connected, join_up
from .joins import lookup

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # on bytes: A-Z and the six ASCII space characters only
    n = len(words) - shingle + 1
    if not words:
        return 0
    parts = [words] if n < 1 else zip(*[words[i:] for i in range(shingle)])
    return majority(np.frombuffer(b"".join([xxh64_digest(b" ".join(p), SEED) for p in parts]), np.uint8).reshape(-1, 8))


def majority(codes: np.ndarray) -> int:
    """The bits set in more than half of the 64-bit codes (rows of eight bytes, most significant first), as a signed number."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(codes), 65536):
        votes += np.unpackbits(codes[i: i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(codes)).tobytes(), "big", signed=True)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, th, fp) per row: the fingerprint as a signed 64-bit number, 0 for null, empty or blank text; th is a hash of the text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint((t or "").encode("utf-8", "surrogatepass"), shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fps, pa.int64())], ["id", "th", "fp"])
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text_hash(text).alias("th"), text.alias("text")).mapInArrow(scan, f"id {kind}, th long, fp long")


def build_trees(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all buckets at once, level by level: (root of each row, children by node and distance).

    Rows are sorted by bucket and distinct in it; row numbers are node numbers.
    """
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    root = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
    child = np.full((len(fp), 65), -1, np.int32)
    rows, at = np.flatnonzero(~first), root[~first]
    while len(rows):
        d = np.bitwise_count(fp[rows] ^ fp[at])
        _, lead = np.unique(at * 65 + d, return_index=True)
        child[at[lead], d[lead]] = rows[lead]
        below = child[at, d]
        go = below != rows
        rows, at = rows[go], below[go].astype(np.int64)
    return root, child


def search_trees(fp: np.ndarray, root: np.ndarray, child: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other row of its tree within radius), a block of query rows at a time."""
    for lo in range(0, len(fp), block):
        q = np.arange(lo, min(lo + block, len(fp)))
        node, found = root[q], []
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            found.append((q[near], node[near]))
            steps = []
            for e in range(-radius, radius + 1):
                k = d + e
                ok = np.flatnonzero((k >= 1) & (k <= 64))
                c = child[node[ok], k[ok]]
                steps.append((q[ok][c >= 0], c[c >= 0].astype(np.int64)))
            q, node = (np.concatenate(x) for x in zip(*steps))
        yield tuple(np.concatenate(x) for x in zip(*found))


def _shard_links(radius: int):
    def link(shard: pd.DataFrame) -> pd.DataFrame:
        bucket, fp = shard["bucket"].to_numpy(), shard["fp"].to_numpy()
        order = np.lexsort((fp, bucket))
        bucket, fp = bucket[order], fp[order].view(np.uint64)
        alike = np.concatenate([[False], bucket[1:] == bucket[:-1], [False]])
        use = alike[1:] | alike[:-1]
        bucket, fp = bucket[use], fp[use]
        if not len(fp):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        root, child = build_trees(bucket, fp)
        label = np.arange(len(fp))
        for u, v in search_trees(fp, root, child, radius):
            label = join_up(label, u, v)
        tied = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[tied].view(np.int64), "b": fp[label[tied]].view(np.int64)})
    return link


def _buckets(radius: int, blocks: int):
    """Column of the bucket keys of ``fp``: one per choice of blocks-radius blocks (their bits, and which choice)."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, pick in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in pick)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask))))
    return F.explode(F.array(*keys))


def fingerprint_links(fps: DataFrame, radius: int = 2, bucket_rows: int = 4096, shard_rows: int = 65536) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp``; their connected components are those of all pairs within radius.

    Two buckets that share a hashed key make one tree more than needed, nothing else.
    """
    n = fps.count()
    blocks = radius + 1
    while n > (bucket_rows // 4) * 2 ** (64 * (blocks - radius) // blocks) and blocks < 16:
        blocks += 1
    rows = fps.select("fp", _buckets(radius, blocks).alias("bucket")).distinct()
    if radius <= 2:
        full = pin(rows.groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket"))
        tree_rows = rows.join(full, "bucket", "left_anti")
    else:
        tree_rows = rows
    shards = max(1, -(-n * len(list(combinations(range(blocks), radius))) // shard_rows))
    by_tree = (tree_rows.withColumn("shard", F.pmod(F.col("bucket"), F.lit(shards)))
               .groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long"))
    if radius > 2 or full.isEmpty():
        return by_tree
    flips = F.array(F.lit(0), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)) for i in range(64)])
    hot = rows.join(full, "bucket", "left_semi").select("fp").distinct()
    near = hot.select("fp", F.explode(flips).alias("f")).select("fp", "f", F.col("fp").bitwiseXOR(F.col("f")).alias("k"))
    if radius < 2:  # links by the value itself: two neighbours of one value are two bits apart
        one_bit = near.filter(F.lit(radius == 1) & (F.col("f") != 0)).select(F.col("fp").alias("a"), F.col("k").alias("b"))
        return by_tree.unionByName(one_bit.join(hot.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    met = near.groupBy("k").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    by_flip = met.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).filter("a <> b").select("a", "b")
    return by_tree.unionByName(by_flip)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, bucket_rows: int) -> DataFrame:
    """(id, th, fp, root, component_id) per row; root is the same for all rows of a group."""
    fps = pin(fingerprints(docs, id_col, text_col, shingle))
    reps = pin(fps.groupBy("fp").agg(F.min("id").alias("lo")))
    label = connected(fingerprint_links(reps.select("fp"), radius, bucket_rows))
    rooted = pin(reps.join(label, F.col("fp") == F.col("node"), "left").select("fp", "lo", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = lookup(rooted, lowest, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                   bucket_rows: int = 4096) -> DataFrame:
    """One row per input row: id, fp, fingerprint (16 hex digits), component_id (smallest id of its group).

    Null, empty and blank texts have fingerprint zero and link like any other.
    Ids may repeat; null ids are never the smallest (a group of null ids only has
    a null component_id). Other columns are ignored, so their names cannot clash.
    """
    return _grouped(docs, id_col, text_col, shingle, radius, bucket_rows).select(
        F.col("id").alias(id_col), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                  bucket_rows: int = 4096) -> DataFrame:
    """``docs`` with one row of each group, all its columns as they are: the row with the smallest id (null ids last).

    Of rows that share that id the one with the smallest text hash stays, of
    equal rows one.
    """
    rows = _grouped(docs, id_col, text_col, shingle, radius, bucket_rows)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th")).alias("b")).select("b.id", "b.th")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_th"))
    kept = packed.join(best, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_semi")
    return kept.dropDuplicates(["_id", "_th"]).select("row.*")
