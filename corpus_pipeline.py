"""A training-corpus pipeline made of the operators in lexforge.llm.

Stages: reject poor documents, drop exact copies, keep one document of each group of near copies,
cut passages that repeat, and pack what is left into training sequences.  Each stage takes the
documents that the one before kept (columns doc_id, text, lang, source, n_chars); the last returns
where each piece of each document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import exact_dedup, near_dedup, packing, quality, repeated_spans
from lexforge.llm._labels import fold
from lexforge.llm._store import materialise
from lexforge.llm.queries import table, tokenizer_file
from lexforge.shipping import ship

#: Bytes from which a passage that repeats is cut: fifty words of the shorter kind.
PASSAGE_BYTES = 200
#: Tokens of a training sequence.
SEQUENCE_TOKENS = 4096


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    ship(spark)
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"), usable=fold(F.col("id"), 4) != 2, least=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    ship(spark)
    return exact_dedup.drop_exact(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    ship(spark)
    return near_dedup.drop_near(docs, words=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat."""
    ship(spark)
    cut = repeated_spans.drop_repeats(docs, length=PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most SEQUENCE_TOKENS ids and their places in training sequences."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=SEQUENCE_TOKENS)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: The classifier, the sketches and the packing aren't SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
