"""Quality rules and mixing against brute force, with edge cases."""

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import mixing, rules

DOC = "doc_id long, text string, source string, h long, size string, row int, rejected_by int, _rule_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "s", 2, 3, 4) for i, t, s in rows], DOC)


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\x0b\n", "a", "a b", "a a a", "a b c a b c", "x y z\nx y z\r\n\n x y z\nx y z", "ü#ß *é* <|> 100%", "a b c d",
         "w " * 300, " ".join(f"w{i % 40}" for i in range(900)), " ".join(f"u{i}" for i in range(80)), "A B! C! " * 30,
         " ".join(f"long{i}" for i in range(120_000)) + " long1 long2 long3", "the same line here\n" * 60]


@pytest.mark.parametrize("bits", [24, 61])
def test_counts_match_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(rules, "SPOT_BITS", bits)  # 61: nearly all hashes share their upper bits, whole hashes are sorted
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "a", "s"), (None, "a b c a b c", None)]
    got = rules.rule_report(frame(spark, rows)).collect()
    want = [(i, *brute_counts(t)) for i, t, _ in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] is base and not (base and r["kept"])


def test_order_changes_work_not_verdict(spark):
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    kept = {r[0] for r in rules.rejected_by(docs).filter("rejected_by IS NULL").select("doc_id").collect()}
    t = F.coalesce("text", F.lit(""))
    plain = {r[0] for r in docs.filter(rules.cascade(rules.RULES[::-1], rules.words_of(t), t).isNull()).select("doc_id").collect()}
    assert kept == plain == {12, 14}
    assert rules.rejected_by(docs).drop("rejected_by").columns == [c for c in docs.columns if c != "rejected_by"]


def test_rules_are_ordered_by_rejection_per_cost(spark):
    order = rules.measured(frame(spark, [(i, "short", "s") for i in range(50)]))
    worth = [r.rate / r.cost for r in order]
    assert worth == sorted(worth, reverse=True) and {r.name for r in order} == {r.name for r in rules.RULES}
    assert rules.measured(frame(spark, [])) == list(rules.RULES)
    assert rules.rule_report(frame(spark, [])).count() == 0


def brute_mix(rows, weights=(5, 2, 1), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    hash_ = lambda i: int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted([s for s in total if s is not None], key=lambda s: s.encode()) + [None] * (None in total)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, capped, whole = {}, set(), sum(total.values())
    while True:  # deal what is left among the sources that are not capped, until none is above its cap
        rest = whole - sum(most * total[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        target = {s: most * total[s] if s in capped else rest * w[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > most * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        mine = [(hash_(i), size(t), i) for i, t, x in rows if x == s]
        passes = math.floor(target[s] / total[s]) if total[s] else 0
        need, run, bound = target[s] - passes * total[s], 0, 0
        for h in sorted({h for h, _, _ in mine}):
            unit = sum(z for g, z, _ in mine if g == h)
            if run + unit > need:
                bound = h + 1 if 2 * (need - run) > unit else h
                break
            run += unit
        else:
            bound = 2**60 if need > 0 else 0
        out += [(i, s, z, total[s], target[s], (passes + (h < bound)) * z) for h, z, i in mine]
    return out


def mixed(spark, rows):
    got = mixing.mix(frame(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    return [tuple(r) for r in got]


@pytest.mark.parametrize("case", range(4))
def test_mix_matches_brute_force(spark, case):
    n = [(400, 3), (60, 7), (2000, 2), (30, 30)][case]
    rows = [(i, " ".join("w" * (1 + (i * 7 + k) % 5) for k in range((i * 37) % 50)), f"s{(i * i) % n[1]}") for i in range(n[0])]
    rows += [(1, "x y z", None), (None, "x y", None), (None, None, "s0"), (7, "a b c", "s0"), (7, "a b c", "s0"), (9, "ä", "é"), (10, None, "zero")]
    got, want = mixed(spark, rows), brute_mix(rows)
    fix = lambda x: sorted(((i, s, z, t, round(g, 6), k) for i, s, z, t, g, k in x), key=str)
    assert fix(got) == fix(want)
    assert all(k <= 3 * z for _, _, z, _, _, k in got)


def test_mix_edge_tables(spark):
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, "a"), (2, "", None)]) == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
    assert mixed(spark, [(1, "one two", "a")]) == [(1, "a", 2, 2, 2.0, 2)]


def test_budgets_are_nested(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 30), f"s{i % 3}") for i in range(600)])
    taken = [{r[0] for r in mixing.mix(docs, share=s, most=1).filter("copies > 0").select("doc_id").collect()} for s in (0.1, 0.3, 0.6)]
    assert taken[0] < taken[1] < taken[2]


def test_many_sources_join_without_broadcast(spark, monkeypatch):
    rows = [(i, "a b c", f"s{i % 5}") for i in range(100)]
    want = sorted(mixed(spark, rows), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixed(spark, rows), key=str) == want
