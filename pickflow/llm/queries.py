"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pickflow.llm import decontaminate, fill_middle, fingerprints, lexical_search, license_scan, mixing, near_vectors, parity_join, quality, repeats, token_files, url_rules, warc_audit
from pickflow.llm.common import table


#: Chunks of text that a worker remembers where the executor does nothing else; twelve times as many as in the pipeline.
REMEMBER = 1_200_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenized(table(spark, sf_dir, "documents"), tokenizer_path(), remember=REMEMBER)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.audit_of_pages(table(spark, sf_dir, "pages"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_token_files, op2_mixing, op3_license_scan, op4_fingerprints, op5_quality, op6_warc_audit, op7_parity_join, op8_decontamination, op9_url_rules, op10_repeats,
        op11_lexical_search, op12_fill_middle, op13_near_vectors,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.MIX_SQL.format(docs="documents"),
        "op6_warc_audit": warc_audit.AUDIT_SQL,
        "op11_lexical_search": lexical_search.RANK_SQL,
        "op12_fill_middle": fill_middle.DIGESTS_SQL,
    }
