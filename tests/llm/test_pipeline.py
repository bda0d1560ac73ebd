"""The pipeline against a brute-force version, and stage by stage on odd rows."""

import os
import re

import numpy as np

import corpus_pipeline
from sessionloom.llm import packing, queries
from test_rules_mixing import brute_counts, brute_mix

ROOT = os.environ.get("TEXT_PIPELINE_DIR", "/root/testdata/sf0.001")


def passes(text):
    n, chars, symbols, dup, rep = brute_counts(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    upper, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
    return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or not 2 * n <= chars <= 12 * n or 2 * dup > lines or 2 * upper > letters or 10 * text.count("!") > 3 * n)


def brute_similar(ids, texts, size=5, least=0.8):
    """The smallest id that links reach; texts link if their word shingles have this Jaccard similarity. ``ids`` ascend."""
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in words]
    sets = [{tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} for w in words]
    root = list(ids)
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    return root


def brute(rows):
    rows = sorted((i, t, s) for i, t, s in rows if passes(t or ""))
    group = brute_similar([r[0] for r in rows], [t for _, t, _ in rows])
    rows = [r for r, g in zip(rows, group) if r[0] == g]
    first, left = {}, []
    split = [(i, t.encode().split(), t, s) for i, t, s in rows]
    for i, w, _, _ in split:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    for i, w, t, s in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = True
        if not gone.all():
            left.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode() if gone.any() else t, s))
    taken = {i: round(k / z) for i, _, z, _, _, k in brute_mix(left)}
    encode, out = packing.encoder(queries.tokenizer_file()), []
    for i, t, _ in left:
        n = len(encode(t)) + 1
        lengths = [n % 2048] * (n % 2048 > 0) + [2048] * (n // 2048)
        out += [(i, k, length) for _ in range(taken[i]) for k, length in enumerate(lengths)]
    return sorted(out)


def test_run_matches_brute_force(spark):
    docs = queries.table(spark, ROOT, "documents").select("doc_id", "text", "source").collect()
    got = corpus_pipeline.run(spark, ROOT).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == brute([tuple(r) for r in docs])
    size = {}
    for r in got:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 2048 and len(size) <= 1.02 * sum(size.values()) / 2048 + 2


def test_stages_keep_columns_on_odd_rows(spark):
    clean = [" ".join(f"word{k}{c}" for k in range(80)) for c in "abc"]
    rows = [(1, clean[0], None, "s", 1, "x"), (1, clean[0], None, "s", 1, "x"), (None, clean[1], "en", None, None, None), (2, None, None, None, None, None),
            (3, "", "en", "s", 0, "y"), (4, clean[0] + " tail", "en", "s", 9, "z"), (5, clean[2] * 500, "en", "t", 9, "z"), (6, clean[0] + " " + clean[1] + " more", "en", "s", 9, "z")]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, h string, _text string, row int, _id int, doc string, rest int, "
              "copies long, bucket int, id string, th int, rejected_by string, col long")
    rows = [(*r, "t", 1, 2, "d", 3, 4, 5, "i", 6, "r", 7) for r in rows]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, ROOT)
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            docs = spark.createDataFrame(out.collect(), schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT)
        assert (last.count() > 0) == (n > 0)


def test_stage_names_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mix_sources", "best_fit_packing"]
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
