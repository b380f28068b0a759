"""A corpus pipeline of five stages over documents (part of gridloom.llm).

quality rules -> line dedup -> near-dedup (SimHash, verified shingles) -> decontamination -> packing.
Every stage reads all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import quality_crf
from gridloom.llm.common import materialise, table
from gridloom.llm.line_chunks import line_dedup
from gridloom.llm.packing import pack
from gridloom.llm.shingle_links import shingle_links
from gridloom.llm.simhash_trie import simhash_groups
from gridloom.llm.spaced_seeds import decontaminate
from gridloom.llm.tokens import vocabulary

HAS_WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line CRF accept; null and empty texts go. Columns may have any names."""
    chain = quality_crf.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("__document"), F.col("text").alias("__body"))
    judged = quality_crf.quality(rows, chain, keep_columns=["__document"], text_col="__body")
    return judged.where("kept").select("__document.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; those that lose every word go.

    Null and empty texts stay. Rows are told apart by id and text, so ids may
    repeat or be null. All columns keep their names and, but for the text and its
    length, their values.
    """
    names = docs.columns
    others = F.struct(*[c for c in names if c != "text"])
    out = line_dedup(docs.select(others.alias("__document"), "doc_id", "text"))
    shorter = F.col("n_removed_lines") > 0
    kept = out.where(~shorter | F.col("text").rlike(HAS_WORD))
    fresh = {"text": F.col("text"), "n_chars": F.when(shorter, F.char_length("text")).otherwise(F.col("__document.n_chars")).cast("long")}
    return kept.select(*[fresh.get(c, F.col(f"__document.`{c}`")).alias(c) for c in names])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one whose id and text name the class.

    Links are op9's (four-word fingerprints within 4 bits) and all pairs whose
    five-word shingles have a verified Jaccard similarity of 0.8 or more. Rows
    are told apart by id and text, so unlike texts of one id, or of no id, are
    documents of their own; of rows that repeat both, one stays. Null texts and
    texts without words are one class.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text"))
    keyed = docs.withColumn("__row", row)
    classes = materialise(simhash_groups(keyed, "__row", links=shingle_links(docs)).select("__row", (F.col("__row") == F.col("component_id")).alias("__first")))
    # what goes, and rows that are there twice, are few: the texts stay where they are, by the tables' sizes
    gone = materialise(classes.where("not __first").select(F.col("__row").alias("__gone")).distinct())
    twice = materialise(classes.where("__first").groupBy(F.col("__row").alias("__twice")).agg(F.count("*").alias("n")).where("n > 1").select("__twice"))
    kept = keyed.join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    order = Window.partitionBy("__row").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"])
    again = kept.join(twice, F.col("__row") == F.col("__twice"), "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return kept.join(twice, F.col("__row") == F.col("__twice"), "left_anti").select(*docs.columns).union(again.select(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; null and empty texts stay, and ids may repeat or be null."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), least_words=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    out = pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: No stage after the base rules can be said in SQL (trained model, content-defined chunks, fingerprints, tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
