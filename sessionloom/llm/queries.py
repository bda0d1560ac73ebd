"""Registered queries of the text operators: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, classifier, langid, licenses, mixing, neargraph, packing, periodic, rules, sampling, simhash, spelling, substring, warczip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words of a text in DuckDB.
SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def tokenizer_file() -> str:
    """Place of the tokenizer that the packing query uses; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return add


@query("op1_substring_dedup", rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (s) WHERE doc_id > lo),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
agg AS (SELECT doc_id, count(*) AS n_words, count(h.p) AS n_removed,
               coalesce(string_agg(x, ' ' ORDER BY p) FILTER (h.p IS NULL), '') AS kept
        FROM word LEFT JOIN hit h USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_simhash_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {SQL_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT d.doc_id, text, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 2 * n_dup_lines > len(l)
            OR 2 * (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))
                 > length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g'))
            OR 10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words) AS kept
FROM f""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(table(spark, sf_dir, "documents"))


@query("op4_mix_sources", rf"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
r AS (SELECT source, z, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, 3 * z AS cap, sum(3 * z) OVER (ORDER BY 3 * z / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
             sum(w) OVER (ORDER BY 3 * z / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r WHERE z > 0),
lev AS (SELECT ((SELECT sum(z) FROM s) - coalesce(spent, 0))::DOUBLE / rest AS lvl FROM o
        WHERE ((SELECT sum(z) FROM s) - coalesce(spent, 0))::DOUBLE / rest * w <= cap ORDER BY cap / w LIMIT 1),
t AS (SELECT source, z, least((3 * z)::DOUBLE, w * coalesce((SELECT lvl FROM lev), 0)) AS target FROM r),
p AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END::BIGINT AS passes FROM t),
c AS (SELECT d.*, z, target, passes, target - passes * z AS need,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
             sum(size) OVER (PARTITION BY d.source, h) AS unit
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, z AS source_size, target,
       (size * (passes + CASE WHEN after <= need AND need > 0 OR after - unit <= need AND 2 * (need - (after - unit)) > unit THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classifier.classify(docs, table(spark, sf_dir, "labels"), sampling.remainder("doc_id", 5) != 0)
    return out.select("doc_id", (sampling.remainder("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents"), sampling.remainder("doc_id", 4) != 2)
    return out.select("doc_id", (sampling.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file()).withColumn("piece", F.col("piece").cast("int"))


@query("op5_nearest_vectors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op8_archive_records", """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warczip.write_packages(table(spark, sf_dir, "pages"))
    records = warczip.read_records(warczip.places(packages), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the loops of the contract: for one id in ten the words from place a on repeat the first p of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"), F.when(F.expr("h % 10 = 0"), words).alias("w"))
    at = rows.withColumn("n", F.expr("CASE WHEN size(w) > 0 THEN size(w) END")).withColumn("a", F.expr("int(g % n)"))
    part = at.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))")).withColumn("loop", F.expr("slice(w, a + 1, p)"))
    text = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(loop, int(ceil((n - a) / p)))), 1, n - a)), ' ')")
    return part.select("doc_id", F.coalesce(text, "text").alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(looped(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", periodic.runs_digest("runs").alias("runs_sha256"),
                      F.sha2("kept_text", 256).alias("collapsed_sha256"))


def mistyped(doc_id: bytes, word: bytes) -> bytes:
    """The word without one letter, if 97 divides the crc32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(doc_id + b":" + (word if word.isascii() else word.decode("latin-1").encode()))
    if h % 97:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), change=mistyped)
    return spelling.variants(counts.filter("n >= 3"))


@query("op13_vector_groups")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.vector_groups(table(spark, sf_dir, "embeddings"))
