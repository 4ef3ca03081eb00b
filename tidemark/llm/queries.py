"""Queries that apply the operators to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bands, bpe, chat, decontaminate, divergence, extraction, golay, jaccard, licenses, records, secrets, sql, urls, variants
from tidemark.llm.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few fixed rows, as expressions of the plan."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op7_token_records(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "records")
    docs = table(spark, folder, "documents")
    records.write_records(docs, public_tokenizers.path(VOCABULARY), f"{out}/shards", end_id=2)
    # the separate index is written once from the files and then read by whoever shuffles
    records.read_records(spark, f"{out}/shards").write.parquet(f"{out}/index")
    index = records.offset_index(spark.read.parquet(f"{out}/index"))
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "offset", "length")


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.recode(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)).select(
        "doc_id", bpe.token_count("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = golay.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", golay.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op2_decontamination"] = sql.DECONTAMINATION


@query
def op1_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    judged = bands.judged(table(spark, folder, "documents").select("doc_id", "text"))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_low_chunks", "n_high_chunks"]
    return judged.select("doc_id", *[F.col(f"quality.{c}") for c in shown])


@query
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < secrets.KINDS.index("owner"))
    rows = secrets.scan(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", *[secrets.of_kind(found, k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(found).alias("spans"),
        F.size(F.filter(found, lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter(found, lambda s: ~s["live"])).cast("bigint").alias("n_examples"))


ORACLE["op4_secrets"] = sql.SECRETS


#: Rules of the query: host, start of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = literal_rows(spark, "host string, path string, verdict string", RULES)
    return urls.judged(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op8_url_rules"] = sql.URL_RULES


@query
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = literal_rows(spark, "conv_id bigint, turn bigint, role string, text string", [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat.formatted(rows)
    read = made.select(
        "conv_id", F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


ORACLE["op6_chat_format"] = sql.CHAT_FORMAT


@query
def op5_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def document_path() -> F.Column:
    """The documents table has no paths: thousands, hundreds and tens of the id are taken as
    directories below the source, and the first document of each as its licence file."""
    n = F.col("doc_id")
    level = lambda size: F.floor(n / size).cast("string")
    return (
        F.when(n % 1000 == 0, F.concat_ws("/", "source", level(1000), F.lit("LICENSE")))
        .when(n % 100 == 0, F.concat_ws("/", "source", level(1000), level(100), F.lit("LICENSE")))
        .when(n % 10 == 0, F.concat_ws("/", "source", level(1000), level(100), level(10), F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", level(1000), level(100), level(10), n.cast("string"))))


@query
def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), document_path())


ORACLE["op3_licences"] = sql.LICENCES


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLE["op13_source_divergence"] = sql.DIVERGENCE


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


ORACLE["op12_spelling_variants"] = sql.VARIANTS


@query
def op11_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similarity_join(table(spark, folder, "documents"))


ORACLE["op11_ngram_jaccard"] = sql.JACCARD
