"""The registered queries of the corpus operators, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlefold.llm import conversations, htmltext, jaccard, linededup, mtree, oracles, packing, quality, resample, secrets, simhash, toxicity, triebpe, warc
from candlefold.llm.common import documents, ship_package


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir)).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"), "n_live_looking", "n_copied",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triebpe.encode(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null id is in neither part
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_word")


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    archives = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.page_records(warc.read(archives, with_data=False))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pages = htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(documents(spark, sf_dir))
    spans = F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["last"]))
    return done.select("row.doc_id", "text", "n_lines", "n_removed", F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed_lines"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return conversations.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_trie_bpe": op4_trie_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_mtree": op6_mtree,
    "op7_warc": op7_warc,
    "op8_html_text": op8_html_text,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_conversations": op11_conversations,
    "op12_resample": op12_resample,
    "op13_jaccard": op13_jaccard,
}
ORACLE_SQL: dict[str, str] = {"op2_secrets": oracles.SECRETS, "op3_quality": oracles.QUALITY, "op6_mtree": oracles.TOP_K, "op7_warc": oracles.WARC, "op9_line_dedup": oracles.LINES}
