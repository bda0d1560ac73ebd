"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and rejection rate are measured on a sample; rules then run in
order of rejection per cost inside one CASE, so a document stops at the first
rule that rejects it. A verdict is the conjunction of all rules, so the order
changes the work, never the result. All counts are exact and over whole texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import SPACE_CLASS, WORD_CLASS, WORD_SPACE

SPOT_BITS = 24


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE.decode()))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_matching(text: Column, letters: str) -> Column:
    """Characters of the text in a regular expression's class."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{letters}+", ""))).cast("long")


def n_symbols(text: Column) -> Column:
    return n_matching(text, "[#*$%&|<>]")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = 3) -> Column:
    """Words in word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Repeats are found by
    sorting numbers made of the hash's upper bits and the window's position; if
    two different hashes share those bits, or the text has more than 2**24
    words, whole hashes are sorted instead.
    """
    low = F.lit((1 << SPOT_BITS) - 1)

    def spots_of(order: Column, same: Callable[[Column, Column], Column], spot: Callable[[Column], Column]) -> Column:
        last = F.size(order) - 1
        marked = F.transform(order, lambda x, k: F.when(
            ((k > 0) & same(x, F.get(order, k - 1))) | ((k < last) & same(x, F.get(order, k + 1))), spot(x)))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def covered(spots: Column) -> Column:
        gaps = F.transform(spots, lambda p, k: F.least(F.coalesce(F.get(spots, k + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_hash(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return let(pairs, lambda o: let(spots_of(o, lambda x, y: x["h"] == y["h"], lambda x: x["i"]), covered))

    def by_number(hashes: Column) -> Column:
        numbers = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(~((1 << SPOT_BITS) - 1)).bitwiseOR(i.cast("long"))))
        alike = lambda x, y: x.bitwiseXOR(y) <= low
        same = lambda x, y: (x.bitwiseXOR(y) >= 0) & alike(x, y)

        def solve(o: Column) -> Column:
            mixed = F.exists(F.transform(o, lambda x, k: (k > 0) & same(x, F.get(o, k - 1)) & (
                F.get(hashes, x.bitwiseAND(low).cast("int")) != F.get(hashes, F.get(o, k - 1).bitwiseAND(low).cast("int")))), lambda x: x)
            return F.when(mixed, by_hash(hashes)).otherwise(
                let(spots_of(o, same, lambda x: x.bitwiseAND(low)), covered))
        return let(numbers, solve)

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                   .when(F.size(h) >= 1 << SPOT_BITS, by_hash(h)).otherwise(by_number(h)))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(words, count))


@dataclass(frozen=True)
class Rule:
    """A rule that rejects where ``rejects(words, text)`` is true."""

    name: str
    rejects: Callable[[Column, Column], Column]
    cost: float = field(default=0.0, compare=False)
    rate: float = field(default=0.0, compare=False)


BASE = (
    Rule("short", lambda w, t: n_words(w) < 50),
    Rule("repetitive", lambda w, t: 100 * n_repeat_words(w) > 50 * n_words(w)),
)
RULES = (
    *BASE,
    Rule("symbols", lambda w, t: 10 * n_symbols(t) > n_words(w)),
    Rule("word_length", lambda w, t: ~word_chars(w).between(2 * n_words(w), 12 * n_words(w))),
    Rule("duplicate_lines", lambda w, t: 2 * n_dup_lines(t) > F.size(lines(t))),
    Rule("shouting", lambda w, t: 2 * n_matching(t, r"\p{Lu}") > n_matching(t, r"\p{L}")),
    Rule("exclaiming", lambda w, t: 10 * n_matching(t, "!") > 3 * n_words(w)),
)


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with its words beside it; a null text counts as empty."""
    return docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("words", words_of(F.col("text")))


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """The rules with seconds per sampled row and rejection rate, best rejection per cost first (ties by name).

    About ``sample_rows`` rows are drawn over the whole table. An empty sample leaves the given order.
    """
    rows = docs.count()
    if not rows:
        return list(rules)
    picked = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / rows), seed=17)
    sample = _cut(picked).select("text", "words").persist()
    n = sample.count()
    out = []
    for r in rules if n else ():
        began = time.perf_counter()
        hit = sample.agg(F.sum(r.rejects(F.col("words"), F.col("text")).cast("int"))).first()[0] or 0
        out.append(Rule(r.name, r.rejects, (time.perf_counter() - began) / n, hit / n))
    sample.unpersist()
    return sorted(out, key=lambda r: (-r.rate / max(r.cost, 1e-12), r.name)) if out else list(rules)


def cascade(rules: Sequence[Rule], words: Column, text: Column) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    chain = None
    for r in rules:
        chain = (F if chain is None else chain).when(F.coalesce(r.rejects(words, text), F.lit(False)), F.lit(r.name))
    return F.lit(None).cast("string") if chain is None else chain


def rejected_by(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with ``rejected_by``: a rule that rejects the row, or null where it is kept.

    Every row comes back with its own columns (``rejected_by`` of the input is
    replaced). Null, empty and blank texts have no words and fail ``short``.
    """
    order = measured(docs, rules, text_col, sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One expression cuts the words once, also where a filter on the verdict is pushed to the scan.
    verdict = let(text, lambda t: let(words_of(t), lambda w: cascade(order, w, t)))
    marked = docs.select(F.struct("*").alias("row"), verdict.alias("verdict"))
    return marked.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "rejected_by"], F.col("verdict").alias("rejected_by"))


def rule_report(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
                sample_rows: int = 2000) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept`` is false where a base rule fails, else the verdict of the cascade of the other rules.
    """
    others = [r for r in rules if r not in BASE]
    order = measured(docs, others, text_col, sample_rows)
    w, t = F.col("words"), F.col("text")
    counts = _cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(
        "id", t, w, n_words(w).alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(cascade(order, w, t).isNull())
    return counts.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), kept.alias("kept"))
