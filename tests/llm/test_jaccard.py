"""Near-dedup by exact Jaccard similarity against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sessionloom.llm import jaccard
from test_substring_simhash import brute_fp


def similarity(a, b):
    x, y = (set(zip(*[t.split()[i:] for i in range(5)])) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rnd, words, edits):
    words = list(words)
    for k in rnd.sample(range(len(words)), edits):
        words[k] = f"new{rnd.random()}"
    return " ".join(words)


def family(seed, bases=12, copies=8, most=9):
    rnd = random.Random(seed)
    out = []
    for b in range(bases):
        base = [f"w{b}x{rnd.randrange(400)}" for _ in range(200)]
        out += [" ".join(base)] + [edited(rnd, base, rnd.randint(1, most)) for _ in range(copies)]
    rnd.shuffle(out)
    return out


def survivors(texts):
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    return [i for i, r in enumerate(root) if i == r]


@pytest.mark.parametrize("small,hits", [(4, 5), (1, 10**9), (100, 1)])
def test_groups_match_brute_force(spark, monkeypatch, small, hits):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SAMPLE_HITS", hits)
    texts = family(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.one_per_group(docs).collect()) == survivors(texts)


def test_stage_takes_pairs_near_the_threshold_that_fingerprints_miss(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    near = edited(rnd, base, 4)
    assert 0.8 <= similarity(" ".join(base), near) < 0.9
    assert (brute_fp(" ".join(base), 5) ^ brute_fp(near, 5)).bit_count() > 2
    far = edited(rnd, base, 9)
    assert similarity(" ".join(base), far) < 0.8
    docs = spark.createDataFrame([(1, " ".join(base)), (2, near), (3, far)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_odd_rows(spark):
    same = "the same words in each of these rows"
    rows = [(3, same), (3, same), (5, same.upper()), (None, same), (9, "two words"), (12, "two  WORDS"), (10, None), (11, "")]
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, same), (9, "two words"), (10, None)]
    assert jaccard.one_per_group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_never_rule_out_a_similar_pair():
    rnd = random.Random(8)
    kept = dropped = 0
    for _ in range(4000):
        n = rnd.randint(1, 60)
        a = {rnd.randrange(2**34) for _ in range(n)}
        b = {x for x in a if rnd.random() < rnd.choice([0.7, 0.9, 0.95])} | {rnd.randrange(2**34) for _ in range(rnd.randint(0, n // 4 + 1))} or {1}
        both = len(a & b)
        similar = both >= 0.8 * (len(a) + len(b) - both) - 1e-9
        cut = [np.sort(np.array(sorted(x)))[: jaccard.prefix_size(len(x), 0.8)] >> 4 for x in (a, b)]  # ties after the cut, as of 32 bits
        maybe = jaccard.may_be_similar(len(a), len(b), *cut, 0.8)
        assert maybe or not similar
        kept, dropped = kept + maybe, dropped + (not maybe)
    assert dropped > 300 and kept > 500


def test_long_lists_keep_what_prefixes_allow_and_no_more():
    rng = np.random.default_rng(3)
    common, base = rng.integers(0, 2**32, 12), rng.integers(0, 2**32, 400)
    sets = [(np.unique(rng.choice(base, rng.integers(150, 260), replace=False)) if i % 3 else np.unique(np.concatenate([base[:190], rng.integers(0, 2**32, 10)]))) for i in range(60)]
    sets = sorted([np.unique(np.concatenate([s, common[:6]])) for s in sets], key=len)
    n, root = np.array([len(s) for s in sets]), np.arange(60) // 2
    prefixes = []
    for s in sets:  # common ones come last
        late = np.isin(s, common)
        whole = np.concatenate([s[~late], s[late] + (1 << 32)])
        prefixes.append(whole[: jaccard.prefix_size(len(s), 0.8)])
    flat, at = np.concatenate(prefixes), np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
    got = {(i, int(k)) for i, j in jaccard.list_pairs(n, root, flat, at, 0.8) for k in j}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if root[i] != root[j] and n[j] <= n[i] / 0.8 + 1e-6
            and jaccard.may_be_similar(int(n[i]), int(n[j]), prefixes[i], prefixes[j], 0.8)}
    assert got == want and 0 < len(want) < 60 * 59 / 4


def test_copies_meet_by_fingerprint(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "xxhash64(text) AS th", "text")
    sets = jaccard.shingle_sets(docs, "long", 5, 0.8, np.zeros(0, np.uint64)).cache()
    near = {r["key"] for r in sets.filter("id < 2").collect()}
    assert [{r["a"], r["b"]} for r in jaccard._by_fingerprint(sets).collect()] == [near]


def test_parities_never_differ_in_more_bits_than_sets_in_shingles():
    rnd = random.Random(4)
    sets = [np.array(sorted(rnd.getrandbits(64) for _ in range(rnd.randint(1, 900))), np.uint64)]
    while len(sets) < 60:
        old = rnd.choice(sets)
        new = set(old[np.array([rnd.random() < 0.9 for _ in old])].tolist()) | {rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))}
        sets.append(np.array(sorted(new), np.uint64))
    odd, every = jaccard.Parities([jaccard.parity(s) for s in sets]), np.arange(len(sets))
    for i, s in enumerate(sets):
        apart = odd.apart(i, every)
        real = np.array([len(np.setxor1d(s, x)) for x in sets])
        assert (apart <= real).all() and apart[i] == 0
        assert (apart[real > 100] > 40).all()


def test_near_copies_below_the_similarity_become_few_pairs():
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(240)]
    sets = [jaccard.shingles(edited(rnd, base, 7 if k % 2 else 2), 5) for k in range(120)]
    sets = sorted(sets, key=len)
    n, root, bits = np.array([len(s) for s in sets]), np.arange(120), [jaccard.parity(s) for s in sets]
    prefixes = [(s >> np.uint64(32)).astype(np.int64)[: jaccard.prefix_size(len(s), 0.8)] for s in sets]
    flat, at = np.concatenate(prefixes), np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
    links = set()
    for a in range(120):
        for b in range(a + 1, 120):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (n[a] + n[b] - both) - 1e-9:
                links.add((a, b))
    met = {(i, int(k)) for i, j in jaccard.list_pairs(n, root, flat, at, 0.8, bits) for k in j}
    assert links <= met and len(met) <= 1.3 * len(links) + 20 < 120 * 119 / 4
    ties = list(jaccard.list_forest(n, bits, 0.8))
    group = list(range(120))
    for a, b in ties:
        group = [group[a] if g == group[b] else g for g in group]
    assert len(ties) < 120 and all(group[a] == group[b] for a, b in links)
