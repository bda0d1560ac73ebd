"""Periodic runs and spelling variants against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import periodic, queries, spelling

ROOT = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, id int, n long, word string, runs string, start double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "w", "r", 0.5) for i, t in rows], DOC)


def naive_lyndon(s):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))
    return [max(j - i for j in range(i + 1, len(s) + 1) if is_lyndon(s[i:j])) for i in range(len(s))]


def naive_runs(w, least, times):
    """Every stretch with w[i] = w[i + q], by its smallest period."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= 2 * q:
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted(((s, m, q) for (s, m), q in found.items() if m >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def loops(rnd, most):
    s = []
    while len(s) < rnd.randint(0, most):
        s += [rnd.choice("ab" if rnd.random() < 0.6 else "abcd") for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 8)
        s += [rnd.choice("xyz")] * (rnd.random() < 0.3)
    return s


def test_lyndon_arrays_match_the_definition():
    rnd = random.Random(4)
    for t in range(400):
        n = rnd.randint(1, 24)
        s = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(n)]
        if t % 2:
            s = (s[: rnd.randint(1, 5)] * n)[:n]
        assert periodic.lyndon_array(s) == naive_lyndon(s)


@pytest.mark.parametrize("least,times", [(24, 3), (4, 3), (6, 2), (2, 2)])
def test_runs_match_brute_force(least, times):
    rnd = random.Random(least)
    for _ in range(150):
        w = [x.encode() for x in loops(rnd, 110)]
        got = periodic.text_runs(w, least, times)
        assert sorted(got, key=lambda r: (r[0], r[2])) == naive_runs(w, least, times)
        assert periodic.text_runs(w, least, times, search_all=True) == sorted(got, key=lambda r: (r[0], r[2]))


def test_run_rows_of_edge_texts(spark):
    line = "a b c "
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line * 8), (4, line * 8), (None, "x " * 30), (5, "one two three"),
            (6, "p q " + line * 8 + "z " + "k " * 24), (7, " ".join(f"w{i}" for i in range(5000)) + " é" * 25)]
    got = {(r["doc_id"], r["n_words"]): r for r in periodic.periodic_runs(frame(spark, rows)).collect()}
    assert len(got) == 8 and periodic.periodic_runs(frame(spark, rows)).count() == 9
    assert [got[(i, 0)]["n_runs"] for i in (1, 2, 3)] == [0, 0, 0] and got[(1, 0)]["kept_text"] == "" and got[(1, 0)]["start"] is None
    assert (got[(4, 24)]["start"], got[(4, 24)]["length"], got[(4, 24)]["period"], got[(4, 24)]["kept_text"]) == (0, 24, 3, "a b c")
    assert got[(None, 30)]["exponent_milli"] == 30000 and got[(None, 30)]["n_dropped"] == 29
    two = got[(6, 51)]
    assert [tuple(r) for r in two["runs"]] == [(2, 24, 3), (27, 24, 1)] and (two["start"], two["kept_text"]) == (27, "p q a b c z k")
    assert (got[(7, 5025)]["start"], got[(7, 5025)]["length"]) == (5000, 25)
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def brute_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = naive_runs(w, 24, 3)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    text = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op11_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, ROOT, "documents").collect() if len(r["text"] or "") < 6000]
    looped = periodic.periodic_runs(queries.looped(spark.createDataFrame(docs + [(10**9, None)], "doc_id long, text string")))
    got = looped.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", periodic.runs_digest("runs").alias("r"), F.sha2("kept_text", 256).alias("c"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([brute_op11(*d) for d in docs] + [brute_op11(10**9, None)])
    assert queries.op11(spark, ROOT).count() == queries.table(spark, ROOT, "documents").count()


def naive_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def naive_variants(counts):
    out, form = [], {}
    near = {w: [x for x in counts if naive_near(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,filter_bytes", [(1, 32 << 20), (2, 64), (3, 400)])
def test_variants_match_brute_force(spark, seed, filter_bytes):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))): rnd.randint(3, 60) for _ in range(220)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), filter_bytes=filter_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == naive_variants(words)


def test_variants_edge_words(spark):
    long = "ab" * 40000
    words = {long: 3, long[:-1]: 9, "aaaaa": 10, "aaaa": 20, "zzzzzz": 5, "zzzzzy": 10, "zzzzyy": 20, "zzzyyy": 20}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert (got[long]["form"], got[long]["n_near"], got["aaaaa"]["form"]) == (long[:-1], 1, "aaaa")
    assert (got["zzzzzz"]["root"], got["zzzzyy"]["form"], got["zzzzyy"]["n_near"]) == ("zzzzyy", None, 2)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    counts = spelling.word_counts(frame(spark, [(1, None), (2, ""), (None, "Été ETE aéB 漢aéb×ñandú-ñANDÚ"), (3, "aéb aeb\U0001f600aéb")]), least=1)
    assert {tuple(r) for r in counts.collect()} == {("Été", 1), ("ete", 1), ("aéb", 3), ("aéb×ñandú", 1), ("ñandÚ", 1), ("aeb", 1)}


def test_op12_matches_brute_force(spark):
    total = Counter()
    for r in queries.table(spark, ROOT, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    words = {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}
    assert sorted((tuple(r) for r in queries.op12(spark, ROOT).collect()), key=str) == naive_variants(words)
