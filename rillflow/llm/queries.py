"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import aq, decontam, html, lines, lm, neardup, packing, quality, sql, suffix, warc
from rillflow.llm.common import fold, table


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), into="hits")
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.archived(pages, when=F.timestamp_seconds(F.lit(946684800) + F.coalesce(F.col("page_id"), F.lit(0)) % 86400))
    kind = pages.schema["page_id"].dataType
    return index.select(
        F.col("id").cast(kind).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_bytes(table(spark, sf_dir, "documents"))
    odd, even = F.filter("spans", lambda x, i: i % 2 == 1), F.filter("spans", lambda x, i: i % 2 == 0)
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", (total(odd) - total(even)).alias("n_removed"), (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return aq.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a non-blank line with the line of its class that stays."""
    found = lines.line_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("no").alias("line_no"), F.col("class.doc").alias("class_doc_id"), F.col("class.no").alias("class_line_no"), "kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.document_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = quality.scored(docs.select("doc_id", "text"), quality.learn(docs, labels))
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= quality.CUTOFF).cast("int").alias("predicted"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extracted(table(spark, sf_dir, "pages"), into="text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    model = lm.train(docs.where(~held))
    return lm.scored(docs, model, into="lm").select("doc_id", held.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "lm.base_score", "lm.score")


QUERIES = {"op1_lm": op1_lm, "op2_suffix_dedup": op2_suffix_dedup, "op10_html": op10_html, "op8_quality": op8_quality, "op4_packing": op4_packing, "op5_line_dedup": op5_line_dedup, "op6_near_dedup": op6_near_dedup, "op3_nearest": op3_nearest, "op7_warc": op7_warc, "op9_decontamination": op9_decontamination}
ORACLES = {"op7_warc": sql.OP7, "op9_decontamination": sql.OP9}
