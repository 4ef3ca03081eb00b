"""Documents to token ids: the stages of a training-data pipeline.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last
return the columns of its input. ``run`` applies them in order and writes each stage's rows to the
shared folder before the next one starts.

Rows are told apart by id and text, so ids may repeat or be null. Of rows that are equal in both
one stays when near-duplicates are dropped. Further columns are carried along."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bands, bpe, decontaminate, secrets, similar
from tidemark.llm.shared import stored

VOCABULARY = "byte_bpe_50k.json"
#: Rows that a task hands to its Python worker at once. Texts are long: by the default of 10,000 rows, all
#: texts of a task would be held together, in Arrow buffers on both sides.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Compression ratios, fingerprints and ids have no SQL.
ORACLE_SQL = None


def row_key() -> Column:
    """Tells rows apart by id and text; its smallest value has the smallest id."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))


def in_small_batches(spark: SparkSession) -> None:
    """From now on at most ``BATCH_ROWS`` rows a batch; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule and the compression bands keep."""
    in_small_batches(spark)
    judged = bands.judged(docs, into="__quality")
    return judged.where("__quality.kept").drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles with
    a Jaccard similarity of 0.8 or more."""
    in_small_batches(spark)
    found = similar.near_duplicates(docs.select(row_key().alias("key"), "text"), id_col="key")
    kept = found.where(F.col("key") == F.col("component_id")).groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__copies"))
    rows = docs.withColumn("__key", row_key()).join(stored(kept, "kept"), "__key")
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = rows.where("__copies = 1").select(*names)
    # rows that are equal in id and text: partial aggregation leaves one per task before any move
    several = rows.where("__copies > 1").groupBy("__key").agg(F.first(F.struct(*names)).alias("__row"))
    return single.unionByName(several.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    in_small_batches(spark)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.contamination(docs.select(row_key().alias("__key"), "text"), benchmark, id_col="__key")
    bad = stored(found.where("contaminated").select("__key").distinct(), "contaminated")
    return docs.withColumn("__key", row_key()).join(bad, "__key", "left_anti").drop("__key")


def secret_scan(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with secrets of a single owner or two masked; widely copied examples stay."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every kept text and what they decode to: doc_id, n_tokens, the ids, packed little-endian
    unsigned 32-bit, and the SHA-256 of the decoded text."""
    in_small_batches(spark)
    coded = bpe.recode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", bpe.token_count("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
