"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token files. Each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.checkpoints import shared_path
from factloom.llm.decontaminate import decontaminate
from factloom.llm.jaccard import keep_one
from factloom.llm.mixing import mix, quality_weights
from factloom.llm.quality import accepted, train
from factloom.llm.registry import vocabulary
from factloom.llm.shared import table, written
from factloom.llm.token_files import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts go; without labels all others stay; of ties good ones stay and toxic ones go; repeated rows are judged each, rows
    without doc_id too; an empty table stays empty; all columns stay, whatever their names."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    A row without doc_id stays only where its group has no other; of rows that share the smallest doc_id the one with the least hash of its
    text; texts without words are no duplicates, but rows that repeat doc_id and text stay once (those without doc_id and words all stay);
    an empty table stays empty; all columns stay, whatever their names."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts stay; rows are judged by doc_id (null too) and text, so repeated rows stay or go together; a benchmark without
    words leaves all; an empty table stays empty; all columns stay, whatever their names."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's edge with its first words.

    Texts without words are never taken; a null source is a source, last in order; rows without doc_id are ordered by their texts; ties of
    keys go by doc_id, then size; repeated rows are documents of their own; an empty table stays empty; all columns stay."""
    return mix(docs, quality_weights(table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all texts, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; rows without doc_id come first; rows that share a doc_id go by length and text, so repeated
    rows stand together; an empty table gives no rows; other columns are left out."""
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has no co-training, so the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
