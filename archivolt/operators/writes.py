"""Writes to the store as merges of snapshots: each returns the new rows, nothing is changed in place.

All take a catalog with one row per id in normal form. Defined results: unknown
ids change nothing, repeated changes of one id count once (the last in their
order), nulls in a change leave what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_hash, clean_id, clean_path


def with_pieces(cat: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, reason): the entries of ``ids`` (id) and the pieces of them."""
    ids = ids.select("id").distinct()
    own = cat.join(ids, "id", "left_semi").select("id", F.lit("own").alias("reason"))
    pieces = cat.select("id", clean_id("parent_id").alias("above")).join(ids.withColumnRenamed("id", "above"), "above", "left_semi")
    both = own.unionByName(pieces.select("id", F.lit("piece").alias("reason")))
    return both.groupBy("id").agg(F.min("reason").alias("reason"))


def deleted(cat: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalog without the entries of ``ids`` and their pieces."""
    return cat.join(with_pieces(cat, ids), "id", "left_anti")


def without_entries(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Dependent rows (tags, vectors, claims) whose entry isn't in ``gone`` (id)."""
    return rows.withColumn("_id", clean_id(key)).join(gone.select(F.col("id").alias("_id")), "_id", "left_anti").drop("_id")


def approved(cat: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalog with the pending entries of ``ids`` and all their pieces active."""
    pending = cat.where("status = 'pending'").join(ids, "id", "left_semi").select("id")
    hit = with_pieces(cat, pending).select("id", F.lit("active").alias("_status"))
    return cat.join(hit, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def merged(cat: DataFrame, changes: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The catalog after ``changes`` (id, columns): updates of known ids, new entries for the rest; ``version`` counts the changes."""
    newest = F.struct(*order)
    last = changes.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *[F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(f"_{c}") for c in columns])
    out = cat.join(last, "id", "full_outer")
    kept = [c for c in cat.columns if c not in columns and c not in ("id", "version")]
    version = F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return out.select("id", *kept, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], version.alias("version"))


def retagged(tags: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(entry_id, tag) in normal form after adding and removing rows (entry_id, tag); what is in both is removed."""

    def clean(df: DataFrame) -> DataFrame:
        return df.select(clean_id("entry_id").alias("entry_id"), F.lower(F.trim("tag")).alias("tag")).where("entry_id is not null and tag <> ''")

    return clean(tags).unionByName(clean(added)).distinct().join(clean(removed), ["entry_id", "tag"], "left_anti")


def asserted(cat: DataFrame, claims: DataFrame) -> DataFrame:
    """The catalog with the newest claim of each entry as its state; sources are kept where the claim names none."""
    at = F.struct("created_at", "claim_id")
    columns = ("authority", "confidence", "epistemic_status", "created_by")
    last = claims.select(clean_id("entry_id").alias("id"), "claim_id", "created_at", *columns, clean_id("derived_from").alias("derived_from")).where("id is not null")
    source = F.max_by("derived_from", F.when(F.col("derived_from").isNotNull(), at)).alias("_derived_from")
    last = last.groupBy("id").agg(F.lit(True).alias("_hit"), *[F.max_by(c, at).alias(f"_{c}") for c in columns], source)
    out = cat.join(last, "id", "left")
    new: list[Column] = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    kept = [c for c in cat.columns if c not in (*columns, "derived_from")]
    return out.select(*kept, *new, F.coalesce("_derived_from", "derived_from").alias("derived_from"))


def claim_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(child_id, parent_id) of the derivations in claims that have no edge yet."""
    new = claims.select(clean_id("entry_id").alias("child_id"), clean_id("derived_from").alias("parent_id")).dropna().distinct()
    held = edges.where("relation = 'derived_from'").select(clean_id("child_id").alias("child_id"), clean_id("parent_id").alias("parent_id"))
    return new.join(held, ["child_id", "parent_id"], "left_anti")


def exported(cat: DataFrame, tags: DataFrame, folder: str, collection: str | None = None) -> None:
    """One JSON line for each entry, with its tags; nulls are written."""
    held = tags.select(clean_id("entry_id").alias("id"), F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").distinct()
    held = held.groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    rows = cat if collection is None else cat.where(F.col("collection") == collection)
    rows.join(held, "id", "left").write.option("ignoreNullFields", "false").json(folder)


def imported(spark, folder: str, cat: DataFrame, blobs: DataFrame) -> DataFrame:
    """(id, entry_id, matched) of the JSON lines in ``folder``: by id, else by hash and path, else new; without their blob (digest) they are skipped.

    A line that is no JSON or has neither id nor hash is matched ``failed``.
    """
    shape = "id string, content_hash string, source_path string, blob string, in_place boolean, _bad string"
    lines = spark.read.schema(shape).option("columnNameOfCorruptRecord", "_bad").json(folder)
    rows = lines.select(
        clean_id("id").alias("id"), clean_hash("content_hash").alias("hash"), clean_path("source_path").alias("path"), clean_hash("blob").alias("blob"), "in_place", "_bad"
    )
    known = cat.select("id", F.lit(True).alias("_known"))
    alike = cat.select(clean_hash("content_hash").alias("hash"), clean_path("source_path").alias("path"), F.col("id").alias("_same")).dropna()
    alike = alike.groupBy("hash", "path").agg(F.min("_same").alias("_same"))
    held = blobs.select(clean_hash("digest").alias("blob")).dropna().distinct().withColumn("_held", F.lit(True))
    out = rows.join(known, "id", "left").join(alike, ["hash", "path"], "left").join(held, "blob", "left")
    skipped = F.col("blob").isNotNull() & ~F.coalesce("in_place", F.lit(False)) & F.col("_held").isNull()
    matched = (
        F.when(F.col("_bad").isNotNull() | (F.col("id").isNull() & F.col("hash").isNull()), "failed")
        .when(skipped, "skipped")
        .when(F.col("_known") | F.col("_same").isNotNull(), "updated")
        .otherwise("imported")
    )
    return out.select("id", F.when(F.col("_known"), F.col("id")).otherwise(F.coalesce("_same", "id")).alias("entry_id"), matched.alias("matched"))


def ordered_log(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` records of each ``by`` with the time of the one before."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("nth", F.row_number().over(w)).withColumn("before", F.lead(order[0]).over(w)).where(F.col("nth") <= n)
