"""Documents to token ids in five stages; each reads what the one before wrote.

Stages: drop documents without a language, keep one document of each near-duplicate group, cut passages that an earlier
document holds too, repeat sources towards target weights, encode. Rows with null ids are kept by the second and third
stage; null texts have no language and are dropped by the first. Rows that share an id but not a text are documents of
their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, jaccard, langid, mixing, substring
from paperloom.llm.common import table, written
from paperloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a document that its main language must hold.
LEAST_SCORE = 0.4
PASSAGE_WORDS = 50
MOST_REPEATS = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown or holds under LEAST_SCORE of the text. Labels train, texts decide."""
    model = langid.train(docs)
    return langid.keep(docs.select(*COLUMNS), model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents that links at a similarity of 0.8 join (five-word shingles)."""
    return jaccard.one_of_each(docs.select(*COLUMNS), words=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of PASSAGE_WORDS words or more that a document with a smaller id holds too."""
    out = substring.cleaned(docs.select(*COLUMNS), window=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources up to MOST_REPEATS times as often as those of the largest; none is lost.

    A row for each time that the block permutations take a document. Each partition, and so each file, holds a part of
    all sources' streams in their order: sources advance alike, by their rows' places in the quota.
    """
    taken = mixing.mix(docs, target="repeats", goal=MOST_REPEATS, with_key=True)
    place = (F.col("start") / F.greatest(F.col("quota"), F.lit(1))).alias("_place")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_key").alias("_key"), "pass", place)
    taken = taken.groupBy("_id", "_source", "_key", "pass").agg(F.min("_place").alias("_place"))  # repeated rows
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_key"))
    return docs.select(*COLUMNS).join(taken, same).sortWithinPartitions("_place", "doc_id", "pass").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("encoding", encoding),
]
#: SQL cannot express the fitted model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
