"""Near-dedup by SimHash and exact Jaccard similarity of word shingles.

Texts link if the sets of their shingles have Jaccard similarity ``least`` or
more; a group is what links connect. Texts meet first by the SimHash of their
sets: each is compared with one text of the fingerprints that BK-trees connect
to its own. Fingerprints miss pairs, so texts also meet by a prefix filter, which
loses none: with all shingles in one fixed order, two sets of n shingles that are
this similar share one of their first n - ceil(least * n) + 1. Every pair that
meets is compared whole.

The order is by hash, with shingles common in about 2,000 sampled rows last; the
sample decides how many pairs meet, never which are found. Where many texts
share a shingle, as few pairs as tie all that may be similar are compared first,
and then every pair that these links have not joined.

Two sizes and a similarity give the least number of shingles that two sets must
share, hence how many of those before a place in the order. Pairs whose
prefixes share fewer are dropped by 32 bits of each prefix shingle (equal bits
of different shingles only keep a pair); texts move for what is left. On long
lists that is done where the list is, with the prefixes of its texts beside it,
so only pairs that stay become rows. A text also brings one bit per place of a
bitmap: whether an odd number of its shingles fall there. What two sets share
cancels out, so they differ in at least as many shingles as their bitmaps do in
bits. Near copies that share most prefixes and still are less similar than asked
for are told apart by that, without a row for each pair of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from ..session import pin
from .components import connected
from .joins import lookup
from .simhash import SEED, fingerprint_links, majority, text_hash

SAMPLE_ROWS, SAMPLE_HITS, SMALL = 2000, 5, 4


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a blank one has none. Words as in SimHash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - size + 1
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words] if n < 1 else zip(*[words[i:] for i in range(size)])
    return np.unique(np.frombuffer(b"".join([xxh64_digest(b" ".join(p), SEED) for p in parts]), np.uint64))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of at least SAMPLE_HITS of about SAMPLE_ROWS rows."""
    n = docs.count()
    part = docs.filter(F.pmod(F.xxhash64(F.lit("common"), "id", "th"), F.lit(1 << 30)) < F.lit(SAMPLE_ROWS / max(n, 1) * (1 << 30)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], ["s"])
    often = part.mapInArrow(scan, "s long").groupBy("s").count().filter(F.col("count") >= SAMPLE_HITS).select("s").toPandas()
    return np.sort(often["s"].to_numpy(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, kind: str, shingle: int, least: float, common: np.ndarray) -> DataFrame:
    """(id, th, key, n, fp, bits, early, prefix) per row: key is a hash of the set, n its size, fp its SimHash, bits its parities; the first ``early`` of the prefix are not common."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, fps, bits, earlies, prefixes = [], [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, shingle)
                late = _member(s, common)
                keys.append(xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                fps.append(majority(s.astype(">u8").view(np.uint8).reshape(-1, 8)))
                bits.append(parity(s))
                prefixes.append(np.concatenate([s[~late], s[late]])[: prefix_size(len(s), least)].view(np.int64))
                earlies.append(min(int((~late).sum()), len(prefixes[-1])))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                                              pa.array(fps, pa.int64()), pa.array(bits, pa.binary()), pa.array(earlies, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                                             ["id", "th", "key", "n", "fp", "bits", "early", "prefix"])
    return docs.mapInArrow(scan, f"id {kind}, th long, key long, n int, fp long, bits binary, early int, prefix array<long>")


def parity(s: np.ndarray) -> bytes:
    """Bit p is set if an odd number of the hashes are p modulo the number of bits, a power of two of at least twice their number."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Bitmaps of :func:`parity`, met pair by pair at the length of the shorter one."""

    def __init__(self, bits: list[bytes]):
        words = np.array([len(b) // 8 for b in bits])
        self.words, self.row, self.at = words, np.zeros(len(bits), np.int64), {}
        for w in np.unique(words):
            mine = np.flatnonzero(words == w)
            self.row[mine] = np.arange(len(mine))
            self.at[int(w), int(w)] = np.frombuffer(b"".join(bits[k] for k in mine), np.uint64).reshape(len(mine), w)

    def _folded(self, words: int, to: int) -> np.ndarray:
        if (words, to) not in self.at:
            longer = self._folded(words, 2 * to)
            self.at[words, to] = longer[:, :to] ^ longer[:, to:]
        return self.at[words, to]

    def apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps of ``j`` differ from that of ``i``."""
        out = np.zeros(len(j), np.int64)
        for w in np.unique(self.words[j]):
            some, to = self.words[j] == w, int(min(w, self.words[i]))
            mine = self._folded(int(self.words[i]), to)[self.row[i]]
            out[some] = np.bitwise_count(self._folded(int(w), to)[self.row[j[some]]] ^ mine).sum(axis=1, dtype=np.int64)
        return out


def most_apart(na, nb, least: float):
    """In how many shingles two sets of na and nb may differ and still have the similarity."""
    return na + nb - 2 * np.ceil(least / (1 + least) * (na + nb) - 1e-9)


def prefix_size(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def _maybe(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """``rows`` with a flag ``maybe``: true for every hash in ``wanted`` (one column, th) and for about one in ten others.

    A bitmap of 8 bits per wanted hash, so that only flagged rows have to move.
    """
    wanted = pin(wanted.distinct())
    slots = max(8 * wanted.count(), 64)
    bits = pin(wanted.select(F.pmod("th", F.lit(slots)).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("_bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits")))
    slot = F.pmod(F.col(col), F.lit(slots))
    at = rows.withColumn("_slot", F.bitmap_bit_position(slot)).withColumn("_in", F.bitmap_bucket_number(slot))
    hit = F.expr("shiftright(int(conv(hex(substring(_bits, int(_slot div 8) + 1, 1)), 16, 10)), int(_slot % 8)) % 2 = 1")
    return at.join(bits, F.col("_in") == F.col("_bucket"), "left").select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def _pairs(lists: DataFrame, least: float) -> DataFrame:
    """(a, b) keys of texts on one list whose sizes allow the similarity."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            entries = batch.column("all")
            flat, at = entries.flatten(), np.concatenate([[0], np.cumsum(entries.value_lengths().to_numpy())])
            keys, sizes = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("key", "n"))
            for lo, hi in zip(at[:-1], at[1:]):
                key, n = keys[lo:hi], sizes[lo:hi]
                ends = np.searchsorted(n, n / least + 1e-6, "right")
                for i in range(len(key) - 1):
                    b = key[i + 1: ends[i]]
                    if len(b):
                        out.append((np.full(len(b), key[i]), b))
                        size += len(b)
                    if size >= 65536:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])
    made = lists.mapInArrow(scan, "a long, b long")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def list_pairs(n: np.ndarray, root: np.ndarray, flat: np.ndarray, at: np.ndarray, least: float, bits: list[bytes] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those after i) of one list in order of size: texts of other roots that :func:`may_be_similar` and their parities would keep.

    The ordered prefix of text i is ``flat[at[i]: at[i + 1]]``.
    """
    odd = None if bits is None else Parities(bits)
    values, number = np.unique(flat, return_inverse=True)
    last, mine = flat[at[1:] - 1], np.zeros(len(values), bool)
    ends = np.searchsorted(n, n / least + 1e-6, "right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[root[j] != root[i]]
        if odd is not None and len(j):
            j = j[odd.apart(i, j) <= most_apart(n[i], n[j], least)]
        if not len(j):
            continue
        size = at[j + 1] - at[j]
        starts = np.cumsum(size) - size
        theirs = np.repeat(at[j] - starts, size) + np.arange(size.sum())
        mine[number[at[i]: at[i + 1]]] = True
        both = np.add.reduceat(mine[number[theirs]], starts, dtype=np.int64)
        mine[number[at[i]: at[i + 1]]] = False
        below = np.add.reduceat(flat[theirs] < last[i], starts, dtype=np.int64)  # of b, where a ends first
        shared = np.ceil(least / (1 + least) * (n[i] + n[j]) - 1e-9).astype(np.int64)
        of_a = np.searchsorted(flat[at[i]: at[i + 1]], np.minimum(last[i], last[j]))
        of_b = np.where(last[j] <= last[i], at[j + 1] - at[j] - 1, below)
        good = (shared <= np.minimum(n[i], n[j])) & (both >= np.maximum(of_a - (n[i] - shared), of_b - (n[j] - shared)))
        if good.any():
            yield i, j[good]


def list_forest(n: np.ndarray, bits: list[bytes], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of one list in order of size that tie whatever the parities allow to be similar: fewer than there are texts.

    A tree grows by the text whose bitmap is nearest to one of its own, by the share of the bits in which they may differ.
    """
    odd, far, by = Parities(bits), np.full(len(n), np.inf), np.zeros(len(n), np.int64)
    open_ = np.ones(len(n), bool)
    starts, ends = np.searchsorted(n, n * least - 1e-6), np.searchsorted(n, n / least + 1e-6, "right")
    for _ in range(len(n)):
        i = int(np.argmin(far))
        if np.isinf(far[i]):
            i = int(np.argmax(open_))
        else:
            yield int(by[i]), i
        open_[i], far[i] = False, np.inf
        j = starts[i] + np.flatnonzero(open_[starts[i]: ends[i]])
        allowed = most_apart(n[i], n[j], least)
        share = odd.apart(i, j) / np.maximum(allowed, 0.5)
        nearer = (share * np.maximum(allowed, 0.5) <= allowed + 1e-6) & (share < far[j])
        far[j[nearer]], by[j[nearer]] = share[nearer], i


def _listed(entries: DataFrame, fields: list[str]) -> DataFrame:
    """(list, all) of entries ``fields`` in order; little data may be much work, so lists stay dealt to all tasks."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(parts, "list").groupBy("list").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))


def _tied(lists: DataFrame, least: float) -> DataFrame:
    """(a, b) keys of :func:`list_forest` of each list."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                e = batch.column("all").slice(r, 1).flatten()
                key, n = (e.field(f).to_numpy(zero_copy_only=False) for f in ("key", "n"))
                ties = np.array(list(list_forest(n.astype(np.int64), e.field("bits").to_pylist(), least)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(key[ties[:, 0]]), pa.array(key[ties[:, 1]])], ["a", "b"])
    made = lists.mapInArrow(scan, "a long, b long")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(lists: DataFrame, least: float) -> DataFrame:
    """(a, b) keys of texts on one list, of two roots, that the prefixes do not rule out."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                e = batch.column("all").slice(r, 1).flatten()
                key, n, root, early = (e.field(f).to_numpy(zero_copy_only=False) for f in ("key", "n", "root", "early"))
                prefix = e.field("prefix")
                size = prefix.value_lengths().to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(size)])
                flat = prefix.flatten().to_numpy().view(np.uint32).astype(np.int64)
                flat += (np.arange(len(flat)) - np.repeat(at[:-1], size) >= np.repeat(early, size)).astype(np.int64) << 32  # common ones come last
                out = [(np.full(len(j), key[i]), key[j]) for i, j in list_pairs(n.astype(np.int64), root, flat, at, least, e.field("bits").to_pylist())]
                for lo in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out[lo: lo + 1024])], ["a", "b"])
    made = lists.mapInArrow(scan, "a long, b long")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_fingerprint(sets: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): every set with the smallest one among the fingerprints that links within ``radius`` connect to its own."""
    root = connected(fingerprint_links(pin(sets.select("fp").distinct()), radius)).select(F.col("node").alias("fp"), F.col("root").alias("r"))
    rooted = sets.select("key", "fp").join(root, "fp", "left").select("key", F.coalesce("r", "fp").alias("r"))
    low = rooted.groupBy("r").agg(F.min("key").alias("a"))
    return lookup(rooted, low, "r").filter("key <> a").select("a", F.col("key").alias("b"))


def may_be_similar(na: int, nb: int, a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """False only if two sets of na and nb shingles with these ordered prefixes cannot have the similarity."""
    shared = math.ceil(least / (1 + least) * (na + nb) - 1e-9)
    if shared > min(na, nb):
        return False
    last = min(a[-1], b[-1])  # below it both sets are known whole
    need = max(np.searchsorted(a, last) - (na - shared), np.searchsorted(b, last) - (nb - shared))
    return int(_member(a, b).sum()) >= need


def _possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs that the prefixes do not rule out."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in "ab":
                lists = batch.column(f"p{c}")
                flat, at = lists.flatten().to_numpy().view(np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                sides.append((batch.column(f"n{c}").to_pylist(), batch.column(f"e{c}").to_pylist(), flat, at))
            (na, ea, fa, xa), (nb, eb, fb, xb) = sides
            good = []
            for i in range(batch.num_rows):
                a, b = fa[xa[i]: xa[i + 1]].copy(), fb[xb[i]: xb[i + 1]].copy()
                a[ea[i]:] += 1 << 32  # common ones come last
                b[eb[i]:] += 1 << 32
                good.append(may_be_similar(na[i], nb[i], a, b, least))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    short = F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int"))
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("early").alias(f"e{c}"), short.alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return pin(both.select("a", "b", "na", "nb", "ea", "eb", "pa", "pb").mapInArrow(scan, "a long, b long"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose whole shingle sets have the similarity."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for b in batches:
            good = []
            for k, ta, tb in zip(b.column("b").to_pylist(), b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                if k != last:
                    last, held = k, shingles(tb, shingle)
                s = shingles(ta, shingle)
                both = int(_member(s, held).sum())
                good.append(both >= least * (len(s) + len(held) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return pin(with_b.select("a", "b", "ta", "tb").mapInArrow(scan, "a long, b long"))


def _held(pairs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, text): one text for each set of the pairs."""
    named = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    place = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "th")).alias("p"))
    at = pin(named.join(place, "key").select("key", F.col("p.id").alias("_id"), F.col("p.th").alias("_th")))
    near = _maybe(texts, at.select(F.col("_th").alias("th")), "th").filter("maybe")
    held = near.join(at, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).dropDuplicates(["key"])
    return held.select("key", "text")


def _links(rows: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b) links between set keys; their connected components are those of all similar pairs."""
    sets = pin(rows.filter("n > 0").dropDuplicates(["key"]).select("key", "n", "fp", "bits", "early", "prefix"))
    met = (sets.select("key", "n", F.explode("prefix").alias("s")).groupBy("s")
           .agg(F.collect_list(F.struct("n", "key")).alias("all")).filter(F.size("all") > 1))
    met = pin(met.select(F.array_sort("all").alias("all")).distinct())
    few, many = met.filter(F.size("all") <= SMALL), met.filter(F.size("all") > SMALL)
    entries = pin(many.select(F.xxhash64("all").alias("list"), F.explode("all").alias("e")).select("list", "e.n", "e.key"))
    tied = _tied(_listed(entries.distinct().join(sets.select("key", "bits"), "key"), ["n", "key", "bits"]), least)
    first = pin(_by_fingerprint(sets).unionByName(_pairs(few, least)).unionByName(tied).distinct())
    likely = _possible(first, sets, least)
    links = _verified(likely, _held(likely, rows, texts), shingle, least)
    if many.isEmpty():
        return links
    root = connected(links).select("node", F.col("root").alias("r"))
    links = root.select(F.col("node").alias("a"), F.col("r").alias("b"))  # the same components, a link a node
    lists = entries.join(root, F.col("key") == F.col("node"), "left").select("list", "n", "key", F.coalesce("r", "key").alias("root"))
    split = lists.groupBy("list").agg((F.min("root") < F.max("root")).alias("split")).filter("split").select("list")
    lists = lists.join(split, "list", "left_semi").distinct()
    short = sets.select("key", "bits", "early", F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int")).alias("prefix"))
    lists = _listed(lists.join(short, "key"), ["n", "key", "root", "bits", "early", "prefix"])
    likely = pin(_apart(lists, least).join(likely, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(likely, _held(likely, rows, texts), shingle, least))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group, all its columns as they are: the row with the smallest id (null ids last).

    Null, empty and blank texts are one group. Of rows that share the smallest id
    the one with the smallest text hash stays, of equal rows one.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    rows = pin(shingle_sets(texts, kind, shingle, least, _common(texts, shingle)))
    root = connected(_links(rows, texts, shingle, least))
    labelled = pin(rows.select("id", "th", "key").join(root, F.col("key") == F.col("node"), "left").select("id", "th", F.coalesce("root", "key").alias("root")))
    best = labelled.groupBy("root").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th")).alias("b"))
    best = pin(best.filter("rows > 1").select("root", "b.id", "b.th"))
    shared = labelled.join(best.select("root"), "root", "left_semi").select("th")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_th"))
    packed = _maybe(packed, shared, "_th")
    alone = labelled.join(best.select("root"), "root", "left_anti").select("id", "th").unionByName(best.select("id", "th"))
    kept = packed.filter("maybe").join(alone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_semi")
    return packed.filter("NOT maybe").unionByName(kept.dropDuplicates(["_id", "_th"]), allowMissingColumns=True).select("row.*")
