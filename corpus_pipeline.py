"""From raw documents to packed sequences: five stages, each written before the next one reads it.

Quality rules, one document of each group of similar texts, removal of repeated strings, benchmark
decontamination, packing. Every stage judges all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import Query, table
from calorix.llm.contamination import decontaminate
from calorix.llm.jaccard_join import JoinRules, similar_documents
from calorix.llm.packing import pack_documents, public_vocabulary
from calorix.llm.quality_rules import quality_verdicts
from calorix.llm.substring_dedup import StringRules, remove_strings
from calorix.session import durable, few

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    judged = quality_verdicts(docs)
    return judged.where("kept").select("row.*")


#: Shingles that a task gathers: workers keep their memory for the later stages.
SIMILAR = JoinRules(flush=1_000_000)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts; texts without words all stay.

    It is the one with the smallest id (a null id comes last), among rows of one id that of the
    smallest hash. Rows are told apart by a 64-bit hash of id and text, so rows that share an id but not
    a text are judged each for itself, and of rows equal in both one stays.
    """
    key = F.xxhash64("doc_id", "text")
    found = similar_documents(docs.select(key.alias("doc_id"), "text"), rules=SIMILAR).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("k"), "component_id").agg(F.count("*").alias("rows"))
    found = durable(found, "near-duplicate-keys")
    named = found.join(docs.select(key.alias("k"), "doc_id").distinct(), "k")
    first = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k")
    least = named.groupBy("component_id").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    least = few(least.where("n > 1").select("component_id", F.col("first.k").alias("stays")), "near-duplicate-firsts")
    go = found.join(least, "component_id").where("k != stays").select("k")
    held = docs.select(F.struct("*").alias("row"), key.alias("k"))
    left = held.join(few(go, "near-duplicates"), "k", "left_anti")
    repeated = few(found.where("rows > 1").select("k"), "repeated-rows")
    if not repeated.limit(1).count():
        return left.select("row.*")
    one = left.join(repeated, "k", "left_semi").groupBy("k").agg(F.first("row").alias("row"))
    others = left.join(repeated, "k", "left_anti")
    return others.select("row").unionByName(one.select("row")).select("row.*")


#: A passage of 50 words rarely has fewer bytes; the query ``op5`` keeps the contract's 400.
REPEATED = StringRules(size=200)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur elsewhere; ``n_chars`` follows the text.

    In running text 200 bytes are some 35 words, so every passage of over 50 words that repeats goes,
    unless its words are shorter than three bytes. A cut inside a character drops the rest of that
    character; null texts stay null.
    """
    own = [c for c in docs.columns if c != "text"]
    # the columns of the documents inside one struct, so none of them can clash with the flag
    marked = docs.select(
        "doc_id", "text", F.struct(*own).alias("own"), F.col("text").isNull().alias("was_null")
    )
    cut = remove_strings(marked, rules=REPEATED, carry=["own", "was_null"], as_text=True)
    text = F.when(~F.col("row.was_null"), F.col("kept"))
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(text.alias("text"))
        elif name == "n_chars":
            n = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.own.n_chars"))
            columns.append(n.cast(kind).alias("n_chars"))
        else:
            columns.append(F.col("row.own")[name].alias(name))
    return cut.select(*columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's tokens in sequences."""
    return pack_documents(docs, public_vocabulary()).drop("token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", clean_of_benchmark),
    ("packing", packing),
]

#: The robust estimates of the first stage and the packing have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
