"""One named query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.llm import chat, lexical, licences
from peergauge.llm.bpe_words import decode_documents, encode_documents
from peergauge.llm.common import read_table
from peergauge.llm.lexical import search_items
from peergauge.llm.mih import nearest
from peergauge.llm.near_dups import near_duplicates
from peergauge.llm.packing import pack_documents
from peergauge.llm.rules import count_text, fit_cutoffs, judge
from peergauge.llm.secrets import STRONG, as_text, find_secrets
from peergauge.llm.spelling import group_variants
from peergauge.llm.token_counts import count_tokens
from peergauge.llm.token_files import read_token_files, with_ids_crc32, write_token_files
from peergauge.llm.weak_labels import fit_quality, read_documents, score_documents
from peergauge.session import new_shared_path, write_shared


def vocabulary(name: str) -> str:
    """Place of a public vocabulary; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    return nearest(embeddings, F.col("vec_id") % 20 == 0, k=20)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = licences.known_licences(spark)
    return licences.scan_licences(read_table(spark, sf_dir, "documents"), known)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    encoded = encode_documents(docs, ranks, public_tokenizers.PATTERN)
    return decode_documents(encoded, ranks).select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "token-files")
    docs = read_table(spark, sf_dir, "documents")
    write_token_files(docs, path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return with_ids_crc32(read_token_files(spark, path, "ids"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counted = write_shared(count_text(docs).drop("text"), "word-counts")
    cutoffs = fit_cutoffs(counted, read_table(spark, sf_dir, "labels"))
    return judge(counted, cutoffs).drop("lang")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs)

    def count(kind: str) -> Column:
        of_kind = F.filter("strong", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, STRONG),
        F.sha2(as_text(F.col("strong")), 256).alias("base_sha256"),
        as_text(F.sort_array(F.concat("strong", "linked"))).alias("spans"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_documents(read_table(spark, sf_dir, "documents"))
    return score_documents(read, fit_quality(read))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(read_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json"), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mih": op1_mih,
    "op2_licences": op2_licences,
    "op3_chat": op3_chat,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_minhash": op6_minhash,
    "op7_token_files": op7_token_files,
    "op8_rules": op8_rules,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_search": op11_search,
    "op12_spelling": op12_spelling,
    "op13_token_counts": op13_token_counts,
}
ORACLE: dict[str, str] = {
    "op2_licences": licences.oracle_sql(),
    "op3_chat": chat.ORACLE_SQL,
    "op11_search": lexical.ORACLE_SQL,
}
