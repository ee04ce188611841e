"""Queries of this folder and the SQL that some of them equal. The operators are imported where they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.checkpoints import shared_path
from factloom.llm.shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.token_files import read_tokens, write_tokens

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.decontaminate import scan

    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.mixing import mix_counts, quality_weights

    counts = mix_counts(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return counts.select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.secrets import scan, train

    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.language import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.hamming import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.merkle import check

    return check(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_files, op3_mixing, op4_decontamination, op5_token_counts, op6_jaccard, op7_quality, op8_secrets, op9_language, op10_hamming, op11_merkle, op12_spelling, op13_licenses)}


def oracle_sql() -> dict[str, str]:
    from factloom.llm.decontaminate import OP4_SQL
    from factloom.llm.hamming import OP10_SQL
    from factloom.llm.licenses import OP13_SQL
    from factloom.llm.merkle import OP11_SQL
    from factloom.llm.mixing import OP3_SQL

    return {"op3_mixing": OP3_SQL, "op4_decontamination": OP4_SQL, "op10_hamming": OP10_SQL, "op11_merkle": OP11_SQL, "op13_licenses": OP13_SQL}
