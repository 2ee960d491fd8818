"""From raw documents to training ids: five stages, each one operator of millrace.llm.

A stage takes all documents its predecessor kept, as (spark, docs, sf_dir), and its decisions take
effect: language ID and decontamination drop documents, near-dedup keeps one of each group,
suffix dedup cuts repeated bytes out of the texts, and the last stage turns texts into piece ids.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.order import in_order
from millrace.llm import decontaminate, language, minhash, pieces, suffixes
from millrace.llm.queries import tokenizer_file
from millrace.session import materialized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, empty, no letter). Without any labelled
    document nothing can be learned, and only these are dropped as well."""
    labelled = docs.filter("lang is not null and text is not null")
    if labelled.isEmpty():
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs.select(*COLUMNS), language.train(labelled))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that with the least id (null ids last).

    Rows are judged by themselves, whatever id they have: rows that share an id stay if their texts
    differ, and go if they repeat. Ids that are all there and distinct are the rows' keys; else a
    row's key is its position in the order of ids, for which the texts are moved once more. Rows
    without words stay."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        rows = docs.withColumn("row", F.col("doc_id"))
    else:
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars")]
        rows = in_order(docs, order, "row")
    dropped = minhash.near_duplicates(rows, doc_id="row").filter("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte that the operator removes. A character that is cut in half goes; a null
    text stays null; a text of which nothing is left stays as an empty text."""
    cut = suffixes.remove_repeats(
        docs.withColumn("__null", F.col("text").isNull()), keep=["doc_id", "lang", "source", "n_chars", "__null"]
    )
    left = F.col("kept_bytes").cast("string")
    text = F.when(F.col("n_removed") == 0, left).otherwise(F.replace(F.make_valid_utf8(left), F.lit("\ufffd"), F.lit("")))
    return cut.select(
        "doc_id",
        F.when(~F.col("__null"), text).alias("text"),
        "lang",
        "source",
        F.when(F.col("__null"), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"),
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents, leaves the others as they are."""
    marked = decontaminate.mark_contaminated(
        docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding: `exact` says whether they give it back."""
    model = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode_pieces(
        docs.select("doc_id", "lang", "source", "text"), model, keep=["doc_id", "lang", "source"], check=True
    )
    n_pieces = F.size("piece_ids").cast("long").alias("n_pieces")
    return coded.select("doc_id", "lang", "source", n_pieces, "piece_ids", "exact")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]

#: No SQL can express the learned language model or the piece encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again, as a job would."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialized(docs, name)
    return docs
