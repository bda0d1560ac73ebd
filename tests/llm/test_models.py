"""Classifier, language identification and nearest neighbours: held-out accuracy, recall, edge cases."""

import os
import zlib

import numpy as np
import pytest

from sessionloom.llm import ann, classifier, langid, queries, sampling
from sessionloom.llm import textops as T

ROOT = os.environ.get("TEXT_SF_DIR", "/root/testdata/sf0.01")
DOC = "doc_id long, text string, lang string, label string, id int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2.0) for i, t, g in rows], DOC)


def test_held_out_quality(spark):
    got = queries.QUERIES["op3_quality_classifier"](spark, ROOT)
    rows = got.join(queries.table(spark, ROOT, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert got.count() == queries.table(spark, ROOT, "documents").count()


def test_classifier_edge_rows(spark):
    docs = frame(spark, [(i, "fine words here" if i % 2 else "### *** ###", None) for i in range(40)] + [
        (None, "fine words", None), (50, None, None), (51, "", None), (52, " \n ", None), (53, "fine words here " * 60_000, None), (53, "é", None)])
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(30)] + [(31, None, "t"), (None, 1, "t"), (33, 7, "t"), (1, 1, "t")], "doc_id long, quality int, text string")
    everything = sampling.remainder("doc_id", 1) == 0
    got = {r["doc_id"]: r["score"] for r in classifier.classify(docs, labels, everything).collect()}
    assert got[35] > 0.8 and got[36] < 0.2 and got[53] is not None and got[50] == got[51] == got[52]
    none = classifier.classify(docs, labels.limit(0), everything)
    assert {r["score"] for r in none.collect()} == {0.5} and none.count() == docs.count()
    one = classifier.classify(docs, labels.filter("quality = 1"), everything)
    assert all(r["score"] > 0.5 for r in one.collect())
    assert classifier.classify(docs.limit(0), labels, everything).count() == 0


def test_score_is_the_average_of_all_vectors():
    model = classifier.Model(np.random.default_rng(1).normal(size=classifier.BUCKETS), 0.1)
    texts = ["ab cde ab", "", "x", "one two three one two three", "été " * 5]
    raw = b"".join(t.encode() for t in texts)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    whole = model.logits(np.frombuffer(raw, np.uint8), off)
    for t, z in zip(texts, whole):
        data = np.frombuffer(t.encode(), np.uint8)
        (ids, share), = classifier.features(data, np.array([0, len(data)]))
        assert z == pytest.approx(float(model.bucket_logit[ids] @ share) + 0.1, abs=1e-5)


def test_word_features_hash_word_and_ngrams():
    raw = np.frombuffer(b"abc de", np.uint8)
    starts, ends, _ = T.cut_words(raw, np.array([0, 6]))
    ids, at = classifier.word_features(raw, starts, ends)
    assert np.diff(at).tolist() == [1 + 3 + 2 + 1, 1 + 2 + 1]  # <abc>: 3 of 3, 2 of 4, 1 of 5; <de>: 2 of 3, 1 of 4
    alone, _ = classifier.word_features(np.frombuffer(b"de", np.uint8), np.array([0]), np.array([2]))
    assert alone.tolist() == ids[at[1]:].tolist()


def test_held_out_languages(spark):
    got = queries.QUERIES["op7_language_id"](spark, ROOT)
    rows = got.join(queries.table(spark, ROOT, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held if langid.has_letter(r["text"])]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == got.count()


def test_language_edge_rows(spark):
    docs = frame(spark, [(i, ["the weather and the sea", "la mer et le temps est bon"][i % 2], ["en", "fr"][i % 2]) for i in range(40)] + [
        (None, "the sea", None), (60, None, "en"), (61, "", "en"), (62, "12 34 _ ! ² Ⅷ", "en"), (63, "the weather " * 50_000, None), (63, "le temps", None), (64, "Ω", None)])
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.identify(docs, sampling.remainder("doc_id", 1) == 0).collect()}
    assert got[0][0] == "en" and got[1][0] == "fr" and got[None][0] == "en"
    assert got[60] == got[61] == got[62] == ("und", 0.0) and got[64][0] in ("en", "fr")
    empty = langid.identify(docs, sampling.remainder("doc_id", 1) == 1)  # nothing to learn from
    assert {(r["lang_pred"], r["score"]) for r in empty.collect()} == {("und", 0.0)} and empty.count() == docs.count()
    assert langid.identify(docs.limit(0), sampling.remainder("doc_id", 1) == 0).count() == 0


def test_kernel_scores_equal_the_unfolded_form():
    texts, labels = ["aaa bbb", "aab abb", "xyz zyx", "xxy zzz", "bab aba"], ["a", "a", "x", "x", "a"]
    seen = np.zeros(langid.STARTS[-1], bool)
    found = [langid.grams(t, seen) for t in texts]
    model = langid.fit(found, labels, landmarks=2)
    kernel = lambda f, g: float(sum(
        len(np.intersect1d(*[x[(x >= lo) & (x < hi)] for x in (f, g)])) / np.sqrt(((f >= lo) & (f < hi)).sum() * ((g >= lo) & (g < hi)).sum())
        for lo, hi in zip(langid.STARTS, langid.STARTS[1:]))) / 3
    y = np.array([0, 0, 1, 1, 0])
    rng = np.random.default_rng(7)
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:2] for k in range(2)])
    kmm = np.array([[kernel(found[i], found[j]) for j in marks] for i in marks])
    assert np.allclose(np.diag(kmm), 1)
    assert not seen.any() and [model.labels[k] for k in model.scores(texts, seen).argmax(axis=1)] == labels


def test_sample_is_bounded_and_stratified(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 50 = 0, 'rare', 'common') AS label")
    got = {r[0]: r[1] for r in sampling.labelled_sample(rows, "label", "id", 200).groupBy("label").count().collect()}
    assert 140 < got["common"] < 270 and got["rare"] == 100


def brute_nearest(rows, asked, k):
    out = []
    for q, v in asked:
        near = sorted((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def test_recall_against_brute_force(spark):
    vectors = queries.table(spark, ROOT, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = [tuple(r) for r in ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), shard_rows=200, leaf=16).collect()]
    assert len(got) == len(want)
    by = {(q, i): s for q, _, i, s in got}
    assert sum((q, i) in by for q, _, i, _ in want) / len(want) >= 0.9
    assert all(by[q, i] == pytest.approx(s, abs=1e-9) for q, _, i, s in want if (q, i) in by)


def test_nearest_edge_rows(spark):
    rnd = np.random.default_rng(2)
    base = [(i, rnd.normal(size=4).astype("f4").tolist()) for i in range(30)]
    same = [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 0.0]),
           (205, [1.0, 2.0]), (206, []), (None, [1.0, 1.0, 1.0, 1.0]), (100, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "s", 1, "b") for i, v in base + same + bad], "vec_id long, embedding array<float>, shard string, id int, block string")
    got = [tuple(r) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=5, surety=1 - 1e-12, shard_rows=16, block_rows=2).collect()]
    good = base + same
    want = brute_nearest(good, [r for r in good if r[0] % 20 == 0], 5)
    assert [(q, n, i) for q, n, i, _ in sorted(got)] == [(q, n, i) for q, n, i, _ in sorted(want)]
    few = df.filter("vec_id IN (0, 1, 2)")
    assert sorted(r["rank"] for r in ann.nearest(few, few.filter("vec_id = 0"), k=5).collect()) == [1, 2]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_nearest_takes_its_length_from_the_vectors(spark):
    long, short = [(i, [1.0, float(i), 2.0]) for i in range(20)], [(100 + i, [1.0, float(i)]) for i in range(9)]
    df = spark.createDataFrame(long + short, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.filter("vec_id >= 100 OR vec_id = 3"), k=3, surety=1 - 1e-12, shard_rows=4).collect()]
    assert sorted(got) == sorted(brute_nearest(long, [long[3]], 3))
    assert ann.nearest(df, df.filter("vec_id >= 100"), k=3).count() == 0


def test_a_query_visits_only_cells_that_it_cannot_rule_out(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16)) * 8
    unit = np.stack([centres[i % 40] + rnd.normal(size=16) for i in range(4000)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(unit)]
    points = ann.projected(unit, ann.projection(16, 8, 11), 1.0)
    axis, value = ann.fit_splits(points[rnd.permutation(4000)[:1024]], 5)
    cell = ann.cell_of(points, axis, value)
    assert set(cell) <= set(range(32)) and np.bincount(cell).max() < 4000 / 8
    low, high = (np.stack([f(points[cell == c], axis=0) for c in np.unique(cell)]) for f in (np.min, np.max))
    gaps = ann.box_gaps(points, low, high)
    assert (gaps[np.arange(4000), np.searchsorted(np.unique(cell), cell)] == 0).all()
    asked = np.array([v for i, v in rows if i % 20 == 0])
    kth = np.sort(asked @ np.array([v for _, v in rows]).T, axis=1)[:, -21]
    far2 = (asked**2).sum(axis=1) + 1.0 - 2 * kth
    gaps = ann.box_gaps(ann.projected(asked, ann.projection(16, 8, 11), None), low, high)
    assert (gaps < ann.chi2_limit(0.97, 8) * far2[:, None]).mean() < 0.8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=100, block_rows=16).collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {(q, i) for q, _, i, _ in got}
    assert len(got) == len(want) and sum((q, i) in found for q, _, i, _ in want) / len(want) >= 0.9


def test_chi_square_and_leaves():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    for p in (0.1, 0.5, 0.97):
        assert (x <= ann.chi2_limit(p, 8)).mean() == pytest.approx(p, abs=0.005)
    leaves = ann.kd_leaves(np.zeros((1000, 2)), 32)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 32


def test_every_label_is_learned(spark):
    rows = [(3 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * (j + 5), f"l{k:02}") for k in range(70) for j in range(3 if k < 64 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, "doc_id", "text", "lang").labels == tuple(f"l{k:02}" for k in range(70))
    got = langid.identify(docs, docs["doc_id"] >= 0).join(docs, "doc_id")
    assert got.filter("lang_pred <> lang").count() == 0


def test_landmarks_are_bounded_in_all():
    labels = [f"l{i % 40}" for i in range(400)]
    found = [np.concatenate([np.arange(50 * (i % 40), 50 * (i % 40) + 50), [2000 + i]]).astype(np.int32) for i in range(400)]  # the last one is the text's own
    few, many = langid.fit(found, labels, in_all=90), langid.fit(found, labels, in_all=1024)
    assert [int((m.column[2000:2400] >= 0).sum()) for m in (few, many)] == [80, 400]  # landmarks
    hit = [few.labels[int((few.weights[few.column[f][few.column[f] >= 0]].sum(0) / np.sqrt(len(f)) + few.bias).argmax())] == x for f, x in zip(found, labels)]
    assert np.mean(hit) > 0.95
    assert int((langid.fit(found, labels, in_all=1).column[2000:2400] >= 0).sum()) == 40  # one of each at least
