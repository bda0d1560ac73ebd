"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing and packing, in this order.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``, extra ones included.
Between stages the rows are stored in the shared folder, so a lost executor
costs no more than the running stage. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import jaccard, mixing, packing, rules, substring
from sessionloom.llm.queries import table, tokenizer_file
from sessionloom.session import pin, ship_package


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows carry whole texts here: Arrow batches of fewer rows keep Python workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects. Null, empty and blank texts are rejected as too short."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return rules.rejected_by(packed).filter("rejected_by IS NULL").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity 0.8 or more of five-word shingles: the one with the smallest id.

    Texts meet by SimHash first. 64-bit fingerprints miss such pairs at any radius that can be searched (README), so a
    prefix filter meets the rest; every pair that meets is compared exactly.
    """
    text_batches(spark)
    return jaccard.one_per_group(docs, shingle=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that also start in a document with a smaller id.

    Untouched texts stay as they are, others become their kept words joined by
    one space; a document of which nothing is left goes. n_chars follows the text.
    """
    text_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("doc"), F.col("doc_id"), F.col("text"))
    left = substring.substring_dedup(packed, carry=["doc"]).filter("n_removed = 0 OR n_removed < n_words")
    old = {c: F.col("rest.doc")[c] for c in others} | {"text": F.col("kept_text")}
    old["n_chars"] = F.when(F.col("n_removed") == 0, old["n_chars"]).otherwise(F.char_length("kept_text").cast("long"))
    return left.select(*[old[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    sizes = pin(mixing.sized(docs))
    plan, n = mixing.mix_plan(sizes)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), mixing.mix_hash("doc_id").alias("h"))
    taken = mixing.copies(rows, plan, n).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 2048 tokens."""
    text_batches(spark)
    return packing.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokens, fingerprints and packing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = pin(docs)
    return docs
