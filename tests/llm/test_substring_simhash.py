"""Substring dedup and SimHash groups against brute force, with edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionloom.llm import components, simhash, substring
from sessionloom.llm.components import connected

DOC = "doc_id long, text string, ord string, th int, id double, rest string, h long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2.0, "r", 7) for i, t in rows], DOC)


def brute_windows(rows, length):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: 2**63 - 1 if i is None else i
    for i, w in split:
        for k in range(len(w) - length + 1):
            s = tuple(w[k:k + length])
            first[s] = min(first.get(s, 2**63 - 1), key(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < key(i):
                gone[k:k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n, vocab=6, most=40):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("abcdefghij"[:vocab]) for _ in range(rnd.randint(0, most))) for _ in range(n)]
    for k in range(0, n, 4):  # near copies with one word changed, and exact ones
        w = base[k].split()
        if w:
            w[rnd.randrange(len(w))] = "é"
        base.append("\n ".join(w) if k % 8 else base[k])
    return base


@pytest.mark.parametrize("seed,length,gram", [(1, 5, 2), (2, 8, 3), (3, 6, 6), (4, 4, 1)])
def test_windows_match_brute_force(spark, seed, length, gram):
    rows = list(enumerate(texts(seed, 40)))
    random.Random(seed).shuffle(rows)
    got = substring.substring_dedup(frame(spark, rows), length=length, gram=gram).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_windows(rows, length)


def test_windows_edge_rows(spark):
    run = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"z{i % 977}" for i in range(200_000))
    rows = [(1, run), (2, "lead " + run + " tail"), (2, run), (None, run), (None, run), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, long), (8, long), (8, long)]
    got = substring.substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_windows(rows, 50)


def test_intervals_and_carried_columns(spark):
    run = " ".join(f"w{i}" for i in range(52))
    out = {r["doc_id"]: r for r in substring.substring_dedup(frame(spark, [(1, run), (2, "a " + run + " b")]), carry=["h", "ord"]).collect()}
    assert [tuple(x) for x in out[2]["removed"]] == [(1, 53)] and out[2]["kept_text"] == "a b"
    assert out[1]["removed"] == [] and out[2]["rest"].asDict() == {"h": 7, "ord": "x"}


def test_windows_empty_table(spark):
    assert substring.substring_dedup(frame(spark, [])).count() == 0


def brute_fp(text, k):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if sh and 2 * votes[b] > len(sh))


def brute_groups(ids, fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, k in zip(ids, range(len(fps))):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [4096, 4])
def test_groups_match_brute_force(spark, bucket_rows):
    rows = list(enumerate(texts(9, 60, vocab=3, most=12))) + [(None, "a b c"), (None, None), (500, ""), (501, "ÀB Cd"), (501, "Àb cD")]
    got = simhash.simhash_groups(frame(spark, rows), bucket_rows=bucket_rows).select("doc_id", "fingerprint", "component_id").collect()
    fps = [brute_fp(t, 3) for _, t in rows]
    want = [(i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, brute_groups([i for i, _ in rows], fps, 2))]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_radius_one_keeps_links_of_hot_buckets(spark, bucket_rows):
    df = spark.createDataFrame([(x,) for x in (6, 2, 7, 5, 1 << 62, 64)], "fp long")
    got = {r["node"]: r["root"] for r in connected(simhash.fingerprint_links(df, 1, bucket_rows)).collect()}
    assert len({got[x] for x in (6, 2, 7, 5)}) == 1 and 64 not in got and 1 << 62 not in got
    assert connected(simhash.fingerprint_links(df, 0, bucket_rows)).count() == 0


@pytest.mark.parametrize("radius,bucket_rows", [(1, 4096), (1, 2), (2, 4096), (2, 2), (3, 4096), (5, 8)])
def test_links_of_dense_fingerprints(spark, radius, bucket_rows):
    rnd = random.Random(radius)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for c in centres for _ in range(25)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in connected(simhash.fingerprint_links(df, radius, bucket_rows)).collect()}
    want = brute_groups(fps, [f % (1 << 64) for f in fps], radius)
    assert [got.get(f, f) for f in fps] == want


def test_tree_search_finds_all_within_radius():
    rnd = np.random.default_rng(3)
    fp = np.unique(rnd.integers(0, 2**64, 400, dtype=np.uint64) & np.uint64(0xFFFF))
    bucket = np.sort(rnd.integers(0, 5, len(fp)))
    root, child = simhash.build_trees(bucket, fp)
    got = {(int(a), int(b)) for u, v in simhash.search_trees(fp, root, child, 2, block=37) for a, b in zip(u, v)}
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if a != b and bucket[a] == bucket[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= 2}
    assert got == want


def test_one_row_of_each_group(spark):
    same = "the same words in each of these rows"
    rows = [(3, same), (3, same), (5, same.upper()), (None, same), (9, "quite another text about other things"), (10, None), (11, "")]
    got = sorted((r["doc_id"], r["text"]) for r in simhash.one_per_group(frame(spark, rows)).collect())
    assert got == [(3, same), (9, "quite another text about other things"), (10, None)]
    assert simhash.one_per_group(frame(spark, [])).count() == 0
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected(links).collect()
    assert len(got) == n and {r["root"] for r in got} == {0}


def test_components_need_few_rounds(spark, monkeypatch):
    """Every round is jobs, plans and memory of the driver: links of one task are joined there, and no round only confirms the last."""
    rounds = []
    monkeypatch.setattr(components, "pin", lambda df, plain=components.pin: rounds.append(1) or plain(df))
    hub = spark.range(1, 300).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert {r["root"] for r in connected(hub).collect()} == {0} and len(rounds) <= 2
    rounds.clear()
    chain = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in connected(chain).collect()} == {0} and len(rounds) <= 4


@pytest.mark.parametrize("held", [1, 7, 1 << 20])
def test_components_match_brute_force(spark, monkeypatch, held):
    rnd = random.Random(held)
    pairs = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(260)]
    low = {x: x for p in pairs for x in p if p[0] != p[1]}
    while True:
        new = dict(low)
        for a, b in pairs:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r["node"]: r["root"] for r in connected(links.repartition(8)).collect()} == low
    parts = [np.array(pairs[i: i + held + 1]) for i in range(0, len(pairs), held + 1)]
    batches = [components.pa.RecordBatch.from_arrays([components.pa.array(p[:, 0]), components.pa.array(p[:, 1])], ["u", "v"]) for p in parts]
    monkeypatch.setattr(components, "HELD", held)
    left = spark.createDataFrame([tuple(r.values()) for b in components._contract(iter(batches)) for r in b.to_pylist()], "a long, b long")
    assert {r["node"]: r["root"] for r in connected(left).collect()} == low
