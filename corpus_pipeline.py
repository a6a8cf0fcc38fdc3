"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import free_name, matching, stored, unstore
from quillon.llm.langid import UNKNOWN, identify_language, train_language_model
from quillon.llm.line_dedup import dedup_lines
from quillon.llm.ngram_join import ngram_jaccard_join
from quillon.llm.packing import pack
from quillon.llm.queries import tokenizer_file
from quillon.llm.toxicity import score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Trained on a hash sample of the labelled
    documents, bounded by max_docs and max_chars of train_toxicity. Null, empty and blank texts
    have no sentence, score 0 and stay; rows that repeat a text stay or go together; without
    labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, train_toxicity(docs, labels), locate=False).where("predicted = 0").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or with a calibrated probability
    under one half for every language, go. `lang` itself is left as it is. Rows that repeat a text
    stay or go together; without a single row of known language all go."""
    model = train_language_model(docs)
    return identify_language(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


def dedup_document_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first of the corpus stays, rows of null doc_id last; every document
    stays, also those of null or empty text and those whose every line occurs earlier (their text
    becomes empty). Rows that repeat a doc_id, or have none, are each judged by their own lines;
    of rows that repeat doc_id and text the equal places stay or go together."""
    return dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents alike in their five-word shingles (Jaccard 0.8 or more) one
    row stays, of the least doc_id (nulls last). Rows are told apart by doc_id and text, so of rows
    that repeat both one stays, and of rows that repeat a doc_id only with other texts each is
    judged by its own. Null, empty and blank texts are alike nothing and all stay."""
    key = F.xxhash64("doc_id", "text")
    joined = ngram_jaccard_join(docs.select(key.alias("doc_id"), "text"), n=5, num=80, den=100)
    rows = joined.where("n_shingles > 0").groupBy(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).agg(F.count("*").alias("times"))
    named = stored(rows.join(docs.select(key.alias("row"), "doc_id").distinct(), "row"))
    best = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("best"))
    marked = stored(named.join(best, "group").select("row", (F.col("row") == F.col("best.row")).alias("stays"), "times"))
    unstore(named)
    at = free_name(docs, "_row")
    kept = matching(docs.withColumn(at, key), marked.where("not stays").select(F.col("row").alias(at)), at, "left_anti")
    repeated = marked.where("stays and times > 1").select(F.col("row").alias(at))
    single = matching(kept, repeated, at, "left_anti")
    return single.unionByName(matching(kept, repeated, at, "left_semi").dropDuplicates([at])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048. Every row is packed, null and empty texts as the end
    token alone, repeated rows each."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"), window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("line_dedup", dedup_document_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage's result but the last is written to the shared
    folder and read back."""
    given = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if before is not given:
            unstore(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained stages can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None
