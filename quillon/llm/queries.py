"""The registered queries of the training-data operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import inner_product_search
from .chat import repair_chats
from .common import fresh_path, remainder
from .langid import identify_language, train_language_model
from .licenses import known_licenses, known_notices, oracle_sql, scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .periodic import periodic_runs, planted
from .records import token_files
from .spelling import document_words, variant_groups
from .threshold_search import threshold_search
from .toxicity import score_toxicity, train_toxicity
from .viterbi import encode_texts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(remainder("doc_id", 4) != 2))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0).select("doc_id", "toxic")
    found = score_toxicity(docs, train_toxicity(docs, labels))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "toxic_spans")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), window=2048)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(document_words(_table(spark, sf_dir, "documents"), shortest=6, occurrences=5, misspelt=199), times=5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, shortest=6, exponent=4).drop("text")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    length = (-longest["less"]).alias("length")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length,
        longest["period"].alias("period"),
        F.floor(1000 * -longest["less"] / longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), fresh_path(spark), end_id=2)
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, xxhash64 of the ids, and whether decoding them gives the
    text back."""
    model = tokenizer_file("piece_bpe_32k.model")
    coded = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    ids = F.coalesce("piece_ids", F.array().cast("array<int>"))
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.xxhash64(ids).alias("ids_hash"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op2_inner_product_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(_table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), known_licenses(spark), known_notices(spark))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op10_toxicity": op10_toxicity,
    "op3_packing": op3_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op2_inner_product_ann": op2_inner_product_ann,
    "op7_threshold_topk": op7_threshold_topk,
    "op4_chat_repair": op4_chat_repair,
    "op5_line_dedup": op5_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {"op8_license_scan": oracle_sql()}
