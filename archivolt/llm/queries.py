"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_id
from archivolt.llm import block_join, chosen_path, history, mixing, pieces, subjects, tokenizer
from archivolt.sources.tables import entries, table

#: Characters of a range: previews have one or two, documents many.
STEP = 2_400


def _top_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without parent, ids in their normal form."""
    return entries(spark, sf_dir).where(clean_id("parent_id").isNull()).withColumn("id", clean_id("id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.check_batches(entries(spark, sf_dir), table(spark, sf_dir, "batch_items")).where("case").select("item_id")


def p1_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.verdicts(entries(spark, sf_dir), table(spark, sf_dir, "batch_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.resplit(entries(spark, sf_dir), step=STEP).where("chunk_no = 0").select(F.col("parent_id").alias("entry_id"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.resplit(entries(spark, sf_dir), step=STEP)


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole documents, up to many ranges long."""
    return pieces.split(table(spark, sf_dir, "documents"), "doc_id", "text", step=STEP, unique=True)


def p2_document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces of each document begin and end, and how many break a rule."""
    found = pieces.faults(p2_documents(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("parent_id").alias("doc_id"), "total", "first", "last", "faults")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = chosen_path.near_duplicates(_top_entries(spark, sf_dir), "id", "preview", threshold=0.6)
    return chosen_path.record_pairs(members, links)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = block_join.most_similar(table(spark, sf_dir, "semantic_cache"), k=10, least=0.9)
    return near.select(F.least("key", "other").alias("qkey_a"), F.greatest("key", "other").alias("qkey_b")).distinct()


def p5_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every 20th key (by its hash), whatever their cosine, against all keys."""
    near = block_join.most_similar(table(spark, sf_dir, "semantic_cache"), k=10, queries="pmod(xxhash64(key), 20) = 0")
    return near.select(F.col("key").alias("qkey"), F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    counted = mixing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.mix(counted, targets), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(*[table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("doc_id", "area")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_areas(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_verdicts": p1_verdicts, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_documents": p2_documents, "p2_document_faults": p2_document_faults, "p4_found": p4_found, "p5_found": p5_found, "p5_top10": p5_top10, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {
    "p2_document_faults": """SELECT doc_id, CAST(length(text) AS INT) AS total, 0::BIGINT AS first, length(text) AS last, 0::BIGINT AS faults FROM documents WHERE length(text) > 1200""",
}
