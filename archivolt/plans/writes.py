"""Queries of merges, claims, import and export with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_hash, clean_id
from archivolt.operators import catalog as C
from archivolt.operators import writes as W
from archivolt.plans.reference import _CAT, _HASH, _PARENT
from archivolt.session import materialize, scratch_dir
from archivolt.sources.tables import entries, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _cat(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return C.catalog(entries(spark, sf), *columns)


_PIECES = f"pieces AS (SELECT id, {_PARENT} AS above, status, kind FROM cat)"


@query(f"""WITH {_CAT}, {_PIECES}, gone AS (SELECT id FROM cat WHERE status = 'retired' AND retention_class IN ('TEMPORARY', 'REBUILDABLE')),
all_gone AS (SELECT id FROM gone UNION SELECT id FROM pieces WHERE above IN (SELECT id FROM gone))
SELECT kind, count(*) AS n FROM cat WHERE id NOT IN (SELECT id FROM all_gone) GROUP BY 1""")
def delete_cascade(spark, sf):
    """What is left by kind when retired entries that nothing protects are deleted with their pieces."""
    cat = _cat(spark, sf, "parent_id", "kind", "retention_class")
    gone = cat.where("status = 'retired' and retention_class in ('TEMPORARY', 'REBUILDABLE')")
    return W.deleted(cat, gone).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CAT}, {_PIECES}, gone AS (SELECT id FROM cat WHERE status = 'retired'),
all_gone AS (SELECT id FROM gone UNION SELECT id FROM pieces WHERE above IN (SELECT id FROM gone))
SELECT tag, count(*) AS n FROM (SELECT trim(tag) AS tag, lower(trim(entry_id)) AS id FROM tags) WHERE id IS NULL OR id NOT IN (SELECT id FROM all_gone) GROUP BY 1""")
def tags_after_delete(spark, sf):
    """Tag rows that stay when retired entries are deleted."""
    cat = _cat(spark, sf, "parent_id")
    left = W.without_entries(table(spark, sf, "tags"), "entry_id", W.with_pieces(cat, cat.where("status = 'retired'")))
    return left.groupBy(F.trim("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CAT}, {_PIECES}, ok AS (SELECT id FROM cat WHERE status = 'pending' AND {_PARENT} IS NULL AND origin <> 'external')
SELECT id, 'active' AS status FROM cat WHERE id IN (SELECT id FROM ok) OR {_PARENT} IN (SELECT id FROM ok)
UNION ALL SELECT id, status FROM cat WHERE NOT (id IN (SELECT id FROM ok) OR coalesce({_PARENT} IN (SELECT id FROM ok), false))""")
def approve_cascade(spark, sf):
    """The status of every entry when the pending ones of our own are approved with their pieces."""
    cat = _cat(spark, sf, "parent_id", "origin")
    ok = cat.where((F.col("status") == "pending") & clean_id("parent_id").isNull() & (F.col("origin") != "external")).select("id")
    return W.approved(cat, ok).select("id", "status")


@query(f"""WITH {_CAT}, i AS (SELECT item_id, any_value(batch_no) AS batch_no, any_value({_HASH.format('content_hash')}) AS hash, any_value(size) AS size, any_value(nullif(trim(source_path), '')) AS path FROM batch_items GROUP BY 1),
tops AS (SELECT min(id) AS id, nullif(trim(source_path), '') AS path FROM cat WHERE {_PARENT} IS NULL GROUP BY 2),
c AS (SELECT coalesce(t.id, substr(md5(coalesce(i.path, 'item ' || item_id)), 1, 16)) AS id, batch_no, item_id, hash, i.size FROM i LEFT JOIN tops t ON t.path = i.path),
l AS (SELECT id, count(*) AS n, arg_max(hash, (batch_no, item_id)) FILTER (hash IS NOT NULL) AS hash, arg_max(size, (batch_no, item_id)) FILTER (size IS NOT NULL) AS size FROM c GROUP BY 1)
SELECT id, coalesce(l.hash, {_HASH.format('content_hash')}) AS content_hash, coalesce(l.size, cat.size) AS size, CAST(coalesce(version, 0) + coalesce(n, 0) AS BIGINT) AS version FROM cat FULL JOIN l USING (id)""")
def entry_merge(spark, sf):
    """The catalog after all batches: items update the entry of their path or are added."""
    cat = _cat(spark, sf, "content_hash", "size", "version", "source_path", "parent_id")
    tops = cat.where(clean_id("parent_id").isNull()).groupBy(F.when(F.trim("source_path") != "", F.trim("source_path")).alias("path")).agg(F.min("id").alias("known"))
    items = table(spark, sf, "batch_items").dropDuplicates(["item_id"])
    path = F.when(F.trim("source_path") != "", F.trim("source_path"))
    items = items.select("batch_no", "item_id", clean_hash("content_hash").alias("content_hash"), "size", path.alias("path")).join(tops.where("path is not null"), "path", "left")
    named = F.substring(F.md5(F.coalesce("path", F.concat(F.lit("item "), F.col("item_id").cast("string")))), 1, 16)
    changes = items.select(F.coalesce("known", named).alias("id"), "batch_no", "item_id", "content_hash", "size")
    held = cat.select("id", clean_hash("content_hash").alias("content_hash"), "size", "version")
    out = W.merged(held, changes, ["batch_no", "item_id"], ["content_hash", "size"])
    return out.select("id", "content_hash", "size", F.col("version").cast("bigint").alias("version"))


@query("""WITH t AS (SELECT lower(trim(entry_id)) AS entry_id, lower(trim(tag)) AS tag FROM tags WHERE trim(tag) <> '' AND nullif(trim(entry_id), '') IS NOT NULL),
added AS (SELECT lower(trim(entry_id)) AS entry_id, epistemic_status AS tag FROM knowledge_claims WHERE nullif(trim(entry_id), '') IS NOT NULL AND epistemic_status <> ''),
removed AS (SELECT lower(trim(entry_id)) AS entry_id, 'disputed' AS tag FROM knowledge_claims WHERE confidence >= 0.9)
SELECT entry_id, tag FROM (SELECT * FROM t UNION SELECT * FROM added) EXCEPT SELECT * FROM removed""")
def tags_merge(spark, sf):
    """Tags after adding the standing of each claim and taking 'disputed' from entries with a sure one."""
    claims = table(spark, sf, "knowledge_claims")
    added = claims.select("entry_id", F.col("epistemic_status").alias("tag"))
    return W.retagged(table(spark, sf, "tags"), added, claims.where("confidence >= 0.9").select("entry_id", F.lit("disputed").alias("tag")))


@query(f"""WITH {_CAT}, k AS (SELECT lower(trim(entry_id)) AS id, *  EXCLUDE (entry_id, derived_from), nullif(lower(trim(derived_from)), '') AS derived_from FROM knowledge_claims),
l AS (SELECT id, arg_max(struct_pack(a := authority, c := confidence, e := epistemic_status, b := created_by), (created_at, claim_id)) AS s,
  arg_max(derived_from, (created_at, claim_id)) FILTER (derived_from IS NOT NULL) AS source FROM k WHERE id <> '' GROUP BY 1)
SELECT id, CASE WHEN l.id IS NOT NULL THEN s.a ELSE authority END AS authority, CASE WHEN l.id IS NOT NULL THEN s.c ELSE confidence END AS confidence,
  CASE WHEN l.id IS NOT NULL THEN s.e ELSE epistemic_status END AS epistemic_status, coalesce(source, nullif(lower(trim(derived_from)), '')) AS derived_from FROM cat LEFT JOIN l USING (id)""")
def claims_assert(spark, sf):
    """The state of every entry after all claims."""
    cat = _cat(spark, sf, "authority", "confidence", "epistemic_status", "created_by", "derived_from").withColumn("derived_from", clean_id("derived_from"))
    out = W.asserted(cat, table(spark, sf, "knowledge_claims"))
    return out.select("id", "authority", "confidence", "epistemic_status", "derived_from")


@query("""SELECT DISTINCT lower(trim(entry_id)) AS child_id, lower(trim(derived_from)) AS parent_id FROM knowledge_claims
WHERE nullif(trim(entry_id), '') IS NOT NULL AND nullif(trim(derived_from), '') IS NOT NULL
EXCEPT SELECT lower(trim(child_id)), lower(trim(parent_id)) FROM provenance_edges WHERE relation = 'derived_from'""")
def claim_edges(spark, sf):
    """Derivations that claims name and that have no edge yet."""
    return W.claim_edges(table(spark, sf, "knowledge_claims"), table(spark, sf, "provenance_edges"))


@query(f"""WITH {_CAT}, old AS (SELECT DISTINCT lower(trim(parent_id)) AS id FROM provenance_edges WHERE relation = 'supersedes')
SELECT id, CASE WHEN id IN (SELECT id FROM old WHERE id IS NOT NULL) THEN 'obsolete' ELSE epistemic_status END AS epistemic_status, status FROM cat""")
def knowledge_retire(spark, sf):
    """Superseded entries become obsolete; their status stays."""
    old = table(spark, sf, "provenance_edges").where("relation = 'supersedes'").select(clean_id("parent_id").alias("id")).distinct().withColumn("old", F.lit(True))
    cat = _cat(spark, sf, "epistemic_status").join(old, "id", "left")
    return cat.select("id", F.when(F.col("old"), "obsolete").otherwise(F.col("epistemic_status")).alias("epistemic_status"), "status")


@query(f"""WITH {_CAT}, into_cat AS (SELECT * FROM cat WHERE status <> 'retired'),
held AS (SELECT {_HASH.format('content_hash')} AS digest FROM cat WHERE status = 'active' UNION SELECT {_HASH.format('content_hash')} FROM batch_items),
alike AS (SELECT {_HASH.format('content_hash')} AS hash, nullif(trim(source_path), '') AS path, min(id) AS same FROM into_cat WHERE {_HASH.format('content_hash')} IS NOT NULL AND nullif(trim(source_path), '') IS NOT NULL GROUP BY 1, 2),
x AS (SELECT c.id, k.id IS NOT NULL AS known, same, {_HASH.format('c.blob')} AS blob, coalesce(c.in_place, false) AS in_place FROM cat c LEFT JOIN into_cat k ON k.id = c.id
  LEFT JOIN alike a ON a.hash = {_HASH.format('c.content_hash')} AND a.path = nullif(trim(c.source_path), ''))
SELECT id, CASE WHEN known THEN id ELSE coalesce(same, id) END AS entry_id, CASE WHEN blob IS NOT NULL AND NOT in_place AND blob NOT IN (SELECT digest FROM held WHERE digest IS NOT NULL) THEN 'skipped'
  WHEN known OR same IS NOT NULL THEN 'updated' ELSE 'imported' END AS matched FROM x""")
def jsonl_roundtrip(spark, sf):
    """The catalog written as JSON lines and matched on its way into a store without the retired entries."""
    cat = _cat(spark, sf, "content_hash", "source_path", "blob", "in_place", "collection", "parent_id")
    folder = f"{scratch_dir(spark)}/export"
    W.exported(cat, table(spark, sf, "tags"), folder)
    digest = F.col("content_hash").alias("digest")
    blobs = cat.where("status = 'active'").select(digest).unionByName(table(spark, sf, "batch_items").select(digest))
    return W.imported(spark, folder, cat.where("status <> 'retired'"), blobs)


@query(f"""WITH {_CAT} SELECT id, {_HASH.format('blob')} AS blob FROM cat WHERE NOT coalesce(in_place, false) AND {_HASH.format('blob')} IS NOT NULL
AND {_HASH.format('blob')} NOT IN (SELECT {_HASH.format('content_hash')} FROM batch_items WHERE {_HASH.format('content_hash')} IS NOT NULL)""")
def missing_blobs(spark, sf):
    """Entries whose blob no delivered file has."""
    cat = _cat(spark, sf, "blob", "in_place").where("not coalesce(in_place, false)").select("id", clean_hash("blob").alias("blob")).where("blob is not null")
    held = table(spark, sf, "batch_items").select(clean_hash("content_hash").alias("blob"))
    return cat.join(held, "blob", "left_anti").select("id", "blob")


@query(f"""WITH {_CAT}, m AS (SELECT id, {_PARENT} AS above, chunk_no, CAST(json_extract(meta_json, '$.chunk.size') AS BIGINT) AS size, CAST(json_extract(meta_json, '$.chunk.overlap') AS BIGINT) AS overlap,
  json_extract_string(meta_json, '$.chunk.hash') AS hash, CAST(json_extract(meta_json, '$.chunk.text_len') AS BIGINT) AS text_len FROM cat WHERE {_PARENT} IS NOT NULL)
SELECT m.above AS id, count(*) AS pieces, count(DISTINCT (m.size, overlap, hash, text_len)) AS prints,
  bool_and(coalesce(hash = {_HASH.format('p.content_hash')} AND text_len = length(p.preview), false)) AND count(DISTINCT (m.size, overlap, hash, text_len)) = 1 AS current
FROM m JOIN cat p ON p.id = m.above GROUP BY 1""")
def chunk_fingerprints(spark, sf):
    """Whether the pieces of an entry were all cut from its present text in one way."""
    cat = _cat(spark, sf, "parent_id", "meta_json", "content_hash", "preview")
    shape = "chunk struct<size: bigint, overlap: bigint, hash: string, text_len: bigint>"
    pieces = cat.select(clean_id("parent_id").alias("above"), F.from_json("meta_json", shape)["chunk"].alias("c")).where("above is not null")
    parents = cat.select(F.col("id").alias("above"), clean_hash("content_hash").alias("own"), F.length("preview").alias("len"))
    both = pieces.join(parents, "above").select(F.col("above").alias("id"), F.struct("c.size", "c.overlap", "c.hash", "c.text_len").alias("c"), "own", "len")
    same = F.bool_and(F.coalesce((F.col("c.hash") == F.col("own")) & (F.col("c.text_len") == F.col("len")), F.lit(False)))
    prints = F.count_distinct("c")
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), prints.alias("prints"), (same & (prints == 1)).alias("current"))


@query("""SELECT query, ts, before, nth FROM (SELECT trim(query) AS query, ts, lead(ts) OVER w AS before, row_number() OVER w AS nth FROM (SELECT DISTINCT ts, trim(query) AS query FROM query_log WHERE trim(query) <> '')
WINDOW w AS (PARTITION BY query ORDER BY ts DESC NULLS LAST)) WHERE nth <= 3""")
def last_searches(spark, sf):
    """The last three times of each query, with the time before."""
    log = table(spark, sf, "query_log").where(F.trim("query") != "").select(F.trim("query").alias("query"), "ts").distinct()
    return W.ordered_log(log, "query", ["ts"], 3).select("query", "ts", "before", "nth")


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed vectors of all documents in full (blake2b, which SQL engines lack)."""
    from archivolt.operators import search as R

    rows = R.hashed_vectors(table(spark, sf, "documents"), "doc_id", "text", cap=1 << 30)
    rows = materialize(rows, f"{scratch_dir(spark)}/vectors")
    return rows.select(F.col("id").alias("doc_id"), F.size(F.filter("embedding", lambda x: x != 0)).alias("used"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


QUERIES["hash_embed"] = hash_embed
