"""Catalog operators: one row per entry, policy scope, browsing, cascades, merges, retention."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_hash, clean_id, clean_path
from archivolt.session import anti_join_sized, materialize, scratch_dir, semi_join_sized

#: What each access level may see (None: everything), and the order of visibilities.
LEVELS: dict[str, tuple[str, ...] | None] = {"admin": None, "operator": ("public", "internal"), "viewer": ("public",)}
VISIBILITIES = ("public", "internal", "private")
#: Retention classes that protect an entry.
PROTECTED = ("IMPORTANT", "CORE", "LEGAL", "SYSTEM_PROTECTED")


#: Columns that are too wide to be shuffled for every entry.
WIDE = {"preview", "summary", "title", "keywords", "meta_json"}


def catalog(entries: DataFrame, *columns: str) -> DataFrame:
    """One row per entry id (normal form): the one updated last, ties by status. Only ``columns`` travel.

    Where wide columns are asked for, ids that occur once stay where they are.
    """
    keep = list(dict.fromkeys([*columns, "updated_at", "status"]))
    rows = entries.select(clean_id("id").alias("id"), *[c for c in keep if c != "id"]).where("id is not null")
    newest = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("status").desc_nulls_last())
    if not WIDE & set(columns):
        return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
    again = materialize(rows.groupBy("id").count().where("count > 1").select("id"), f"{scratch_dir(entries.sparkSession)}/again")
    several = semi_join_sized(rows, again, "id").withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
    return anti_join_sized(rows, again, "id").unionByName(several)


def scope(level: str = "viewer", include_pending: bool = False, include_pieces: bool = True) -> Column:
    """The access predicate of a level; an unknown level is a viewer. Pending shows active and pending, never retired."""
    seen = LEVELS.get(level, LEVELS["viewer"])
    out = F.col("status").isin("active", "pending") if include_pending else F.col("status") == "active"
    if seen is not None:
        out = out & F.col("visibility").isin(*seen)
    return out if include_pieces else out & clean_id("parent_id").isNull()


def glob(col: Column | str, pattern: str) -> Column:
    """Case-sensitive shell pattern with *, ? and [..]."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += ch if ch.isalnum() or ch in "/_ " else "\\" + ch
        i += 1
    return F.expr("true") & (col if isinstance(col, Column) else F.col(col)).rlike(f"(?s)^{out}$")


def with_tag(entries: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Entries (id in normal form) that carry a tag, in any spelling."""
    held = tags.where(F.lower(F.trim("tag")) == tag.strip().lower()).select(clean_id("entry_id").alias("id"))
    return entries.join(held, "id", "left_semi")


def clean_tags(tags: DataFrame) -> DataFrame:
    """(entry_id, tags): trimmed, lower case, distinct, sorted."""
    t = tags.select(clean_id("entry_id").alias("entry_id"), F.lower(F.trim("tag")).alias("tag")).where("entry_id is not null and tag <> ''")
    return t.distinct().groupBy("entry_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def duplicate_groups(cat: DataFrame) -> DataFrame:
    """Content hashes of more than one top entry, with their number and spread."""
    h = cat.where(clean_id("parent_id").isNull()).select("id", clean_hash("content_hash").alias("hash"), "collection", "size").where("hash is not null")
    return (
        h.groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count_distinct("collection").alias("collections"),
            F.min("id").alias("first_id"),
            (F.sum("size") - F.max("size")).alias("spare_bytes"),
        )
        .where("copies > 1")
        .withColumn("cross_collection", F.col("collections") > 1)
    )


def rank_of(col: str) -> Column:
    out = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(VISIBILITIES))):
        out = F.when(F.col(col) == v, i).otherwise(out)
    return out


def name_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VISIBILITIES]), rank + 1)


def cascade(cat: DataFrame, column: str) -> DataFrame:
    """(id, parent_id, own, effective): pieces take ``column`` from their parent where it exists."""
    parents = cat.select(F.col("id").alias("parent_id"), F.col(column).alias("_above"))
    rows = cat.select("id", clean_id("parent_id").alias("parent_id"), F.col(column).alias("own"))
    return rows.join(parents, "parent_id", "left").select("id", "parent_id", "own", F.coalesce("_above", "own").alias("effective"))


def tighten(cat: DataFrame) -> DataFrame:
    """(id, source, visibility): the stricter of internal and what the entry derives from."""
    rows = cat.select("id", clean_id("derived_from").alias("source")).where("source is not null")
    above = cat.select(F.col("id").alias("source"), rank_of("visibility").alias("rank"))
    return rows.join(above, "source", "left").select("id", "source", name_of(F.greatest(F.lit(1), F.coalesce("rank", F.lit(1)))).alias("visibility"))


def import_match(cat: DataFrame, incoming: DataFrame) -> DataFrame:
    """(item_id, entry_id, matched): incoming rows matched by hash and path, else by path, else new."""
    top = cat.where(clean_id("parent_id").isNull()).select("id", clean_path("source_path").alias("path"), clean_hash("content_hash").alias("hash"))
    both = top.where("path is not null and hash is not null").groupBy("path", "hash").agg(F.min("id").alias("same"))
    path = top.where("path is not null").groupBy("path").agg(F.min("id").alias("older"))
    rows = incoming.select("item_id", clean_path("source_path").alias("path"), clean_hash("content_hash").alias("hash")).dropDuplicates(["item_id"])
    out = rows.join(both, ["path", "hash"], "left").join(path, "path", "left")
    return out.select(
        "item_id",
        F.coalesce("same", "older").alias("entry_id"),
        F.when(F.col("same").isNotNull(), "skip").when(F.col("older").isNotNull(), "update").otherwise("add").alias("matched"),
    )


def upsert_versions(cat: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_path, items, version): the version each path reaches when all incoming changes are applied in order."""
    top = cat.where(clean_id("parent_id").isNull()).select(clean_path("source_path").alias("source_path"), "version", clean_hash("content_hash").alias("hash"))
    last = top.where("source_path is not null").groupBy("source_path").agg(F.max("version").alias("last"), F.max_by("hash", F.struct("version", "hash")).alias("h0"))
    rows = incoming.dropDuplicates(["item_id"]).select("batch_no", "item_id", clean_path("source_path").alias("source_path"), clean_hash("content_hash").alias("hash"))
    order = Window.partitionBy("source_path").orderBy("batch_no", "item_id")
    rows = rows.where("source_path is not null").join(last, "source_path", "left").withColumn("before", F.coalesce(F.lag("hash").over(order), "h0"))
    changed = F.col("hash").isNull() | F.col("before").isNull() | (F.col("hash") != F.col("before"))
    return rows.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("items"), (F.coalesce(F.max("last"), F.lit(0)) + F.sum(changed.cast("int"))).alias("version")
    )


def newest(df: DataFrame, by: Iterable[str], order: str, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last(), F.col(tie))
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
