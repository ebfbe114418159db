"""A training-corpus pipeline out of the numbered operators.

``STAGES`` are (name, function) pairs.  Each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.

Defined results: null and empty texts have no letter, so the first stage
rejects them; a text that loses all its lines stays as an empty one; rows that
repeat a doc_id are treated alike in every stage; rows without a doc_id are
never near-duplicates.  Columns of documents beside doc_id and text pass
through untouched, except lang where it was null and n_chars where the text
changed; they may have any names but ones with a dot or a backtick, which PySpark's
mapInArrow does not take.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecotally.llm import decontaminate, language, linededup, pieces, similarity
from ecotally.llm.common import free_names, same_columns, table, written

#: Texts whose nearest profile is farther than this are in no known language.
LEAST_LANGUAGE_SCORE = 0.15


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in no known language go; an unknown lang is filled in."""
    lang, score = free_names(docs.columns, "found_lang", "found_score")
    found = language.identify(docs, language.train(docs), names=(lang, score))
    kept = found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return same_columns(kept.withColumn("lang", F.coalesce("lang", lang)), docs)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines found in many documents go from all of them."""
    text, before, dropped = free_names(docs.columns, "kept_text", "lines_before", "lines_dropped")
    found = linededup.drop_lines(docs, names=(text, before, dropped))
    changed = F.col(dropped) > 0
    return same_columns(found.withColumns({
        "text": F.when(changed, F.col(text)).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars")),
    }), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the one with the smallest doc_id stays."""
    gone = similarity.similarity_classes(docs).filter("component_id != doc_id").select("doc_id").distinct()
    return same_columns(docs.join(gone, "doc_id", "left_anti"), docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that contain a benchmark item go."""
    [items] = free_names(docs.columns, "benchmark_items")
    found = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"), name=items)
    return same_columns(found.filter(F.size(items) == 0), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, lang, source, the piece ids, their number, and whether decoding gives the text back."""
    rows = docs.select("doc_id", "lang", "source", "text")
    both = pieces.encode_decode(rows)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("sentencepiece", encoded),
]

#: Profiles, and pieces of a BPE model, are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
