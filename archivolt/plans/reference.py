"""Queries of catalog, search, governance, feedback and text operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.functions.ids import clean_hash, clean_id
from archivolt.functions.kinds import EXTENSIONS, extension, kind_of
from archivolt.operators import catalog as C
from archivolt.operators import hierarchy as H
from archivolt.operators import search as R
from archivolt.session import materialize, scratch_dir
from archivolt.sources.tables import entries, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_CAT = """cat AS (SELECT * EXCLUDE (id, _nth), _id AS id FROM (
  SELECT *, lower(trim(id)) AS _id, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST) AS _nth
  FROM entries WHERE nullif(trim(id), '') IS NOT NULL) WHERE _nth = 1)"""
_PARENT = "nullif(lower(trim(parent_id)), '')"
_HASH = "CASE WHEN regexp_full_match(regexp_replace(lower({0}), '^\\s*sha-?256\\s*[:=]?|[\\s:\\-]', '', 'g'), '[0-9a-f]{{64}}') THEN regexp_replace(lower({0}), '^\\s*sha-?256\\s*[:=]?|[\\s:\\-]', '', 'g') END"
_CJK = r"([\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}])"


def _tokens(c: str) -> str:
    spaced = f"regexp_replace(lower(translate(coalesce({c}, ''), 'İ', 'i')), '{_CJK}', ' \\1 ', 'g')"
    return f"list_filter(string_split(regexp_replace({spaced}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cat(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return C.catalog(entries(spark, sf), *columns)


# --- counts --------------------------------------------------------------------


@query(f"WITH {_CAT} SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM cat GROUP BY kind")
def count_by_kind(spark, sf):
    return _cat(spark, sf, "kind", "size").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {_CAT} SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM cat WHERE {_PARENT} IS NULL GROUP BY kind")
def count_parents_by_kind(spark, sf):
    top = _cat(spark, sf, "kind", "size", "parent_id").where(clean_id("parent_id").isNull())
    return top.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {_CAT} SELECT collection, kind, count(*) AS n FROM cat GROUP BY ROLLUP (collection, kind)")
def count_by_collection_rollup(spark, sf):
    return _cat(spark, sf, "collection", "kind").rollup("collection", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CAT} SELECT status, visibility, count(*) AS n FROM cat GROUP BY ALL")
def count_by_status(spark, sf):
    return _cat(spark, sf, "visibility").groupBy("status", "visibility").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(trim(tag)) AS tag, count(DISTINCT lower(trim(entry_id))) AS n FROM tags WHERE trim(tag) <> '' AND nullif(trim(entry_id), '') IS NOT NULL GROUP BY 1")
def tag_usage(spark, sf):
    tags = C.clean_tags(table(spark, sf, "tags"))
    return tags.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lower(trim(entry_id)) AS entry_id, list_sort(list(DISTINCT lower(trim(tag)))) AS tags FROM tags
WHERE trim(tag) <> '' AND nullif(trim(entry_id), '') IS NOT NULL GROUP BY 1""")
def tags_of_entries(spark, sf):
    return C.clean_tags(table(spark, sf, "tags"))


@query(f"""WITH {_CAT} SELECT count(*) AS rows_total, count(*) FILTER ({_PARENT} IS NULL) AS entries_total, count({_PARENT}) AS pieces,
  CAST(sum(size) FILTER ({_PARENT} IS NULL) AS BIGINT) AS bytes, count(DISTINCT nullif(blob, '')) AS blobs, count(DISTINCT collection) AS collections FROM cat""")
def stats_rollup(spark, sf):
    c = _cat(spark, sf, "size", "parent_id", "blob", "collection").withColumn("p", clean_id("parent_id"))
    return c.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("entries_total"),
        F.count("p").alias("pieces"),
        F.sum(F.when(F.col("p").isNull(), F.col("size"))).alias("bytes"),
        F.count_distinct(F.when(F.col("blob") != "", F.col("blob"))).alias("blobs"),
        F.count_distinct("collection").alias("collections"),
    )


# --- scope and browsing -----------------------------------------------------------


@query(f"WITH {_CAT} SELECT id, visibility FROM cat WHERE status = 'active' AND visibility = 'public'")
def policy_scope_viewer(spark, sf):
    return _cat(spark, sf, "visibility").where(C.scope("viewer")).select("id", "visibility")


@query(f"WITH {_CAT} SELECT id, status FROM cat WHERE status IN ('active', 'pending') AND visibility IN ('public', 'internal') AND {_PARENT} IS NULL")
def policy_scope_operator(spark, sf):
    return _cat(spark, sf, "visibility", "parent_id").where(C.scope("operator", include_pending=True, include_pieces=False)).select("id", "status")


@query(f"""WITH {_CAT} SELECT id, kind, updated_at FROM cat WHERE status = 'active' AND visibility IN ('public', 'internal') AND {_PARENT} IS NULL
ORDER BY updated_at DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def browse_page(spark, sf):
    c = _cat(spark, sf, "kind", "visibility", "parent_id").where(C.scope("operator", include_pieces=False))
    return c.orderBy(F.col("updated_at").desc_nulls_last(), "id").offset(20).limit(20).select("id", "kind", "updated_at")


@query(f"""WITH {_CAT} SELECT id, kind FROM cat WHERE id IN (SELECT lower(trim(entry_id)) FROM tags
  WHERE lower(trim(tag)) = (SELECT min(t) FROM (SELECT lower(trim(tag)) AS t, count(*) AS n FROM tags GROUP BY 1 ORDER BY n DESC, t LIMIT 1)))""")
def tag_semi_join(spark, sf):
    tags = table(spark, sf, "tags")
    spelled = tags.select(clean_id("entry_id").alias("id"), F.lower(F.trim("tag")).alias("t"))
    common = spelled.groupBy("t").count().orderBy(F.col("count").desc(), "t").limit(1).select("t")
    held = spelled.join(F.broadcast(common), "t", "left_semi")
    return _cat(spark, sf, "kind").join(held, "id", "left_semi").select("id", "kind")


@query(f"WITH {_CAT} SELECT id, source_path FROM cat WHERE source_path GLOB '/srv/kb/*/d00?/*.md'")
def path_glob(spark, sf):
    c = _cat(spark, sf, "source_path")
    return c.where(C.glob("source_path", "/srv/kb/*/d00?/*.md")).select("id", "source_path")


@query(f"WITH {_CAT} SELECT substr(id, 1, 3) AS prefix, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM cat GROUP BY 1")
def id_prefixes(spark, sf):
    c = _cat(spark, sf).groupBy(F.substring("id", 1, 3).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return c.select("prefix", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"))


# --- integrity ------------------------------------------------------------------------


@query(f"""WITH {_CAT}, h AS (SELECT id, {_HASH.format('content_hash')} AS hash, collection, size FROM cat WHERE {_PARENT} IS NULL)
SELECT hash, count(*) AS copies, count(DISTINCT collection) AS collections, min(id) AS first_id, CAST(sum(size) - max(size) AS BIGINT) AS spare_bytes,
  count(DISTINCT collection) > 1 AS cross_collection FROM h WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1""")
def duplicate_groups(spark, sf):
    return C.duplicate_groups(_cat(spark, sf, "parent_id", "content_hash", "collection", "size"))


@query(f"""WITH {_CAT}, r AS (
  SELECT id, 'parent_id' AS field, {_PARENT} AS ref FROM cat UNION ALL SELECT id, 'derived_from', nullif(lower(trim(derived_from)), '') FROM cat)
SELECT id, field, ref FROM r WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM cat)""")
def missing_references(spark, sf):
    c = _cat(spark, sf, "parent_id", "derived_from")
    refs = c.select("id", F.explode(F.map_from_arrays(F.array(F.lit("parent_id"), F.lit("derived_from")), F.array(clean_id("parent_id"), clean_id("derived_from")))).alias("field", "ref"))
    return refs.where("ref is not null").join(c.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "field", "ref")


@query(f"""WITH {_CAT} SELECT DISTINCT {_HASH.format('content_hash')} AS digest FROM batch_items
WHERE {_HASH.format('content_hash')} IS NOT NULL AND {_HASH.format('content_hash')} NOT IN (SELECT {_HASH.format('blob')} FROM cat WHERE {_HASH.format('blob')} IS NOT NULL)""")
def orphan_blobs(spark, sf):
    held = table(spark, sf, "batch_items").select(clean_hash("content_hash").alias("digest")).where("digest is not null").distinct()
    return held.join(_cat(spark, sf, "blob").select(clean_hash("blob").alias("digest")), "digest", "left_anti")


@query(f"""WITH {_CAT} SELECT id, kind FROM cat WHERE id NOT IN (SELECT json_extract_string(r, '$.id') FROM (
  SELECT unnest(from_json(json_extract(result_json, '$.results'), '["JSON"]')) AS r FROM semantic_cache WHERE json_valid(result_json)) WHERE json_extract_string(r, '$.id') IS NOT NULL)""")
def never_retrieved(spark, sf):
    shape = "struct<results: array<struct<id: string, score: double>>, degraded: boolean>"
    hits = table(spark, sf, "semantic_cache").select(F.explode(F.from_json("result_json", shape)["results"]).alias("r")).select(F.col("r.id").alias("id"))
    return _cat(spark, sf, "kind").join(hits.where("id is not null").distinct(), "id", "left_anti").select("id", "kind")


@query(f"""WITH {_CAT} SELECT count(*) AS scanned, count(*) FILTER (coalesce(trim(summary), '') = '') AS no_summary, count(*) FILTER (coalesce(trim(keywords), '') = '') AS no_keywords,
  count(*) FILTER (coalesce(preview, '') = '') AS no_preview, count(*) FILTER (content_hash IS NULL) AS no_hash, count(*) FILTER (updated_at < created_at) AS clock_back FROM cat""")
def curate_report(spark, sf):
    c = _cat(spark, sf, "summary", "keywords", "preview", "content_hash", "created_at")
    empty = lambda x: F.count(F.when(F.trim(F.coalesce(x, F.lit(""))) == "", 1))
    return c.agg(
        F.count(F.lit(1)).alias("scanned"),
        empty("summary").alias("no_summary"),
        empty("keywords").alias("no_keywords"),
        F.count(F.when(F.coalesce("preview", F.lit("")) == "", 1)).alias("no_preview"),
        F.count(F.when(F.col("content_hash").isNull(), 1)).alias("no_hash"),
        F.count(F.when(F.col("updated_at") < F.col("created_at"), 1)).alias("clock_back"),
    )


# --- search ----------------------------------------------------------------------------


def _docs(spark, sf):
    return _cat(spark, sf, "title", "summary", "keywords", "preview", "visibility", "parent_id")


def _queries(spark, sf):
    q = table(spark, sf, "query_log").where(F.trim("query") != "").select("query").distinct()
    return q.select(F.sha2("query", 256).alias("qid"), "query")


def _is_cjk(c: str) -> str:
    return f"regexp_full_match({c}, '{_CJK[1:-1]}')"


_FIELDS = "UNION ALL ".join(f"SELECT id, {w} AS weight, {_tokens(f)} AS t FROM cat " for f, w in R.WEIGHTS.items())
_SEGMENTS = f"list_filter(string_split(regexp_replace(regexp_replace(lower(translate(query, 'İ', 'i')), '({_CJK[1:-1]}+)', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _run(k: int) -> str:
    """SQL for the terms of k + 1 neighbouring CJK tokens of a list t."""
    all_cjk = " AND ".join(_is_cjk(f"t[i + {j}]") for j in range(k + 1))
    return f"list_transform(list_filter(range(1, len(t) - {k - 1}), lambda i: {all_cjk}), lambda i: array_to_string(t[i : i + {k}], ' '))"


_BM25 = f"""{_CAT.replace("cat AS (", "cat AS MATERIALIZED (")}, q AS (SELECT DISTINCT sha256(query) AS qid, query FROM query_log WHERE trim(query) <> ''),
seg AS (SELECT *, {_is_cjk("substr(segment, 1, 1)")} AS cjk, length(segment) AS n FROM (
  SELECT qid, unnest(range(1, len(s) + 1)) AS run, unnest(s) AS segment FROM (SELECT qid, {_SEGMENTS} AS s FROM q))),
asked AS MATERIALIZED (SELECT DISTINCT qid, CASE WHEN cjk THEN array_to_string(string_split(segment, ''), ' ') ELSE segment END AS term, -1 AS pos, false AS pair
  FROM seg WHERE NOT cjk OR n <= 3
  UNION ALL SELECT qid, substr(segment, i, 1) || ' ' || substr(segment, i + 1, 1), start + i - 1, true FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM seg WHERE cjk AND n > 3),
    unnest(range(1, n)) AS g(i)),
field_tokens AS MATERIALIZED ({_FIELDS}),
lengths AS MATERIALIZED (SELECT id, sum(len(t)) AS length FROM field_tokens GROUP BY 1), stats AS (SELECT count(*) AS n, avg(length) AS avg_length FROM lengths),
tf AS MATERIALIZED (SELECT id, term, sum(weight) AS tf FROM (SELECT id, weight, unnest(list_concat(t, {_run(1)}, {_run(2)})) AS term FROM field_tokens)
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, avg_length FROM df, stats),
scope AS MATERIALIZED (SELECT id FROM cat WHERE status = 'active' AND visibility IN ('public', 'internal')),
weighed AS (SELECT id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) AS part FROM tf JOIN idf USING (term) JOIN lengths USING (id) JOIN scope USING (id)),
hits AS (SELECT qid, id, score FROM (SELECT qid, id, round(sum(part), 6) AS score, bool_or(NOT pair) AS whole, list(pos) FILTER (WHERE pair) AS places
  FROM asked JOIN weighed USING (term) GROUP BY 1, 2) WHERE whole OR len(list_intersect(places, list_transform(places, lambda p: p + 1))) > 0),
keyword AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 200)"""


def _keyword(spark, sf, k=10):
    docs = _docs(spark, sf)
    return R.bm25(docs, _queries(spark, sf), k, docs.where(C.scope("operator")))


@query(f"WITH {_BM25} SELECT qid, id, rank FROM keyword WHERE rank <= 10")
def kw_bm25_top10(spark, sf):
    return _keyword(spark, sf).select("qid", "id", "rank")


@query(f"WITH {_BM25} SELECT DISTINCT qid, term, pos, pair FROM asked")
def query_compiled(spark, sf):
    """What each logged query asks for: terms, phrases and pairs of neighbours."""
    return R.compiled(_queries(spark, sf))


_GRAMS = """SELECT key, CAST(CAST('0x' || substr(m, 1, 8) AS BIGINT) % 512 AS INT) AS bucket, CAST(sum(CASE WHEN substr(m, 9, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END) AS DOUBLE) AS w
  FROM (SELECT key, md5(unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS m FROM (
    SELECT key, substr(trim(regexp_replace(lower(translate(text, 'İ', 'i')), '\\s+', ' ', 'g')), 1, 8192) AS t FROM ({0}))) GROUP BY 1, 2"""
_VECTOR = f"""dv AS MATERIALIZED ({_GRAMS.format("SELECT id AS key, concat_ws(chr(10), title, summary, replace(keywords, ',', ' ')) AS text FROM cat JOIN scope USING (id)")}),
qv AS MATERIALIZED ({_GRAMS.format("SELECT qid AS key, query AS text FROM q")}),
dn AS (SELECT key, sqrt(sum(w * w)) AS norm FROM dv GROUP BY 1), qn AS (SELECT key, sqrt(sum(w * w)) AS norm FROM qv GROUP BY 1),
alike AS (SELECT qid, id, round(dot / (qn.norm * dn.norm), 6) AS score FROM (SELECT qv.key AS qid, dv.key AS id, sum(qv.w * dv.w) AS dot FROM qv JOIN dv USING (bucket) GROUP BY 1, 2)
  JOIN qn ON qid = qn.key JOIN dn ON id = dn.key WHERE dot > 0),
vector AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM alike WHERE score > 0 QUALIFY rank <= 200),
fused AS MATERIALIZED (SELECT qid, id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT qid, id, rank FROM keyword UNION ALL SELECT qid, id, rank FROM vector) GROUP BY 1, 2),
best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10)"""


def _hybrid(spark, sf):
    """Both lanes see the scope only and bring 200 candidates."""
    docs = _docs(spark, sf)
    inside = docs.where(C.scope("operator"))
    queries = _queries(spark, sf)
    keyword = R.bm25(docs, queries, 200, inside)
    about = inside.select("id", F.concat_ws("\n", "title", "summary", F.translate("keywords", ",", " ")).alias("text"))
    mine = R.hashed_vectors(queries, "qid", "query", digest="md5", unit=False)
    theirs = R.hashed_vectors(about, "id", "text", digest="md5", unit=False)
    vector = R.cosine_top(mine, theirs, 200, least=0.0)
    return R.fuse([keyword, vector])


@query(f"WITH {_BM25}, {_VECTOR} SELECT qid, id, score, rank FROM best")
def rrf_fusion(spark, sf):
    return _hybrid(spark, sf)


@query(f"""WITH {_BM25}, {_VECTOR}, above AS (SELECT DISTINCT qid, {_PARENT} AS id FROM best JOIN cat USING (id) WHERE {_PARENT} IS NOT NULL)
SELECT qid, id, rank FROM best ANTI JOIN above USING (qid, id)""")
def hybrid_search(spark, sf):
    parents = _cat(spark, sf, "parent_id").select("id", clean_id("parent_id").alias("parent_id"))
    return R.suppress_parents(_hybrid(spark, sf), parents).select("qid", "id", "rank")


@query(f"""WITH {_BM25}, top10 AS MATERIALIZED (SELECT * FROM keyword WHERE rank <= 10),
above AS (SELECT DISTINCT qid, {_PARENT} AS id FROM top10 JOIN cat USING (id) WHERE {_PARENT} IS NOT NULL)
SELECT qid, id, rank FROM top10 ANTI JOIN above USING (qid, id)""")
def parent_suppression(spark, sf):
    parents = _cat(spark, sf, "parent_id").select("id", clean_id("parent_id").alias("parent_id"))
    return R.suppress_parents(_keyword(spark, sf), parents).select("qid", "id", "rank")


@query(f"""WITH {_BM25}, golden AS (SELECT DISTINCT sha256(query) AS qid, lower(trim(top_id)) AS id FROM query_log WHERE trim(query) <> '' AND top_id IS NOT NULL),
found AS (SELECT qid, g.id, rank FROM golden g LEFT JOIN (SELECT * FROM keyword WHERE rank <= 10) USING (qid, id))
SELECT count(DISTINCT qid) AS queries, round(avg((rank IS NOT NULL)::INT), 6) AS recall_at_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM found""")
def recall_mrr(spark, sf):
    log = table(spark, sf, "query_log").where((F.trim("query") != "") & F.col("top_id").isNotNull())
    golden = log.select(F.sha2("query", 256).alias("qid"), clean_id("top_id").alias("id")).distinct()
    found = golden.join(_keyword(spark, sf), ["qid", "id"], "left")
    return found.agg(
        F.count_distinct("qid").alias("queries"),
        F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall_at_10"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


@query(f"WITH {_CAT} SELECT id FROM cat WHERE contains(' ' || array_to_string({_tokens('preview')}, ' ') || ' ', ' for now ')")
def kw_phrase_match(spark, sf):
    return R.phrase(_cat(spark, sf, "preview"), "for now").select("id")


@query(f"""WITH {_CAT} SELECT id FROM cat WHERE contains(lower(title), 'memory') OR contains(lower(summary), 'memory') OR contains(lower(preview), 'memory')
  OR contains(lower(title), '星云') OR contains(lower(summary), '星云') OR contains(lower(preview), '星云')""")
def kw_like_fallback(spark, sf):
    return R.like(_cat(spark, sf, "title", "summary", "preview"), R.like_terms("Memory: 星云?")).select("id")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vec_cosine_top10(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.cosine_top(v.where("id % 20 = 0 and embedding is not null"), v).select("qid", "id", "rank")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND v.label = 3)
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vec_scoped_topk(spark, sf):
    v = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return R.cosine_top(v.where("id % 20 = 0 and embedding is not null"), v.where("label = 3")).select("qid", "id", "rank")


# --- text --------------------------------------------------------------------------------


_STOP = ", ".join(f"'{w}'" for w in T.EN_STOP)
_LOW = "lower(translate(coalesce(text, ''), 'İ', 'i'))"
_KEYWORDS = f"""list_concat(list_filter(regexp_extract_all({_LOW}, '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+')),
  list_filter(flatten(list_transform(regexp_extract_all({_LOW}, '{_CJK[1:-1]}+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))),
    lambda p: NOT regexp_matches(p, '[{T.ZH_STOP}]')))"""
_COUNTED = f"""t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_KEYWORDS} AS w FROM documents)),
counted AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2)"""


@query(f"WITH {_COUNTED} SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM counted GROUP BY 1 HAVING sum(n) >= 5")
def term_freq(spark, sf):
    counted = T.keyword_counts(table(spark, sf, "documents"), "doc_id", "text")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n >= 5")


@query(f"WITH {_COUNTED} SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM counted QUALIFY rank <= 8")
def keywords_top8(spark, sf):
    """The most frequent terms of each document, of equal ones the first in the text."""
    best = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first")
    counted = T.keyword_counts(table(spark, sf, "documents"), "doc_id", "text")
    return counted.withColumn("rank", F.row_number().over(best)).where("rank <= 8").select("doc_id", "term", "n", "rank")


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(list_distinct_in_order, lambda x: x <> '')[1:12], lambda x: substr(x, 1, 120)), '；') AS outline FROM (
  SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (
    SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: regexp_matches(x, '^\\s*((async\\s+)?def\\s+\\w+|class\\s+\\w+|(export\\s+)?(async\\s+)?function\\s+\\w+|(pub\\s+)?fn\\s+\\w+|func\\s+\\w+|type\\s+\\w+|interface\\s+\\w+|(public|private|protected)[\\w\\s<>\\[\\]]*\\s+\\w+\\s*\\()')),
      lambda x: regexp_replace(trim(x, ' '), '[:{\\s]+$', '')) AS l FROM documents WHERE kind = 'code'))""")
def code_outline(spark, sf):
    d = table(spark, sf, "documents").where("kind = 'code' and text is not null")
    return d.select("doc_id", T.code_outline("text").alias("outline"))


@query("""SELECT doc_id, substr(CASE WHEN head <> '' THEN head ELSE stem END, 1, 100) AS title FROM (SELECT doc_id,
  trim(regexp_extract(coalesce(text, ''), '^\\s*#+([^\\n\\r]*)', 1), ' ') AS head,
  regexp_replace(regexp_extract(coalesce(source_path, ''), '([^/]*)$', 1), '([^.])\\.[^.]*$', '\\1') AS stem FROM documents)""")
def titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title("source_path", "text").alias("title"))


@query("""WITH RECURSIVE paras AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS p
  FROM documents WHERE text IS NOT NULL),
fold AS (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS buf, len(p) AS n FROM paras
  UNION ALL SELECT f.doc_id, f.i + 1,
    CASE WHEN length(p[i + 1]) > 1200 THEN list_concat(done, CASE WHEN buf <> '' THEN [buf] ELSE [] END, [p[i + 1]])
      WHEN buf = '' OR length(buf) + length(p[i + 1]) + 1 <= 1200 THEN done ELSE list_append(done, buf) END,
    CASE WHEN length(p[i + 1]) > 1200 THEN '' WHEN buf = '' THEN p[i + 1] WHEN length(buf) + length(p[i + 1]) + 1 <= 1200 THEN buf || chr(10) || p[i + 1] ELSE p[i + 1] END, n
  FROM fold f JOIN paras USING (doc_id) WHERE f.i < n),
pieces AS (SELECT doc_id, unnest(d) AS piece, unnest(range(len(d))) AS place FROM (SELECT doc_id, CASE WHEN buf <> '' THEN list_append(done, buf) ELSE done END AS d FROM fold WHERE i = n)),
cut AS (SELECT doc_id, place, i AS sub, substr(piece, CAST(i * 1000 + 1 AS BIGINT), 1200) AS piece FROM pieces, unnest(generate_series(0,
  CASE WHEN length(piece) <= 1200 THEN 0 ELSE CAST(ceil((length(piece) - 1200) / 1000) AS BIGINT) END)) AS g(i))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, sub) - 1 AS no, piece FROM cut""")
def chunk_paragraphs(spark, sf):
    return T.merged_paragraphs(table(spark, sf, "documents"), "doc_id", "text")


@query("""SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM (
  SELECT doc_id, trim(unnest(regexp_extract_all(text, '([^.!?。！？；;\\n]+[.!?。！？；;]*)', 1)), ' ') AS s FROM documents) WHERE s <> '' GROUP BY 1""")
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("s")).alias("longest"))


@query("""SELECT doc_id, i AS no, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS piece FROM documents, unnest(generate_series(0,
  CASE WHEN length(text) <= 1200 THEN 0 ELSE CAST(ceil((length(text) - 1200) / 1000) AS BIGINT) END)) AS g(i) WHERE length(text) > 0""")
def chunk_windows(spark, sf):
    d = table(spark, sf, "documents").where("length(text) > 0")
    return d.select("doc_id", F.posexplode(T.windows("text", 1200, 200)).alias("no", "piece"))


@query("""SELECT doc_id, CASE WHEN p > 0 THEN (CASE WHEN greatest(1, p - 40) > 1 THEN '…' ELSE '' END) || substr(text, greatest(1, p - 40), 160)
  || (CASE WHEN greatest(1, p - 40) + 159 < length(text) THEN '…' ELSE '' END) END AS snippet
FROM (SELECT doc_id, text, strpos(lower(text), 'notes') AS p FROM documents WHERE text IS NOT NULL)""")
def snippet(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", T.snippet("text", F.lit("notes")).alias("snippet"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_meta(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- feedback ------------------------------------------------------------------------------


@query("""SELECT trim(query) AS query, count(*) AS asked, count(*) FILTER (n = 0) AS empty, round(max(top_score), 6) AS best, count(*) FILTER (degraded) AS degraded
FROM query_log WHERE trim(query) <> '' AND (n = 0 OR top_score < 0.012) GROUP BY 1 ORDER BY asked DESC, query LIMIT 50""")
def gap_report(spark, sf):
    log = table(spark, sf, "query_log").where((F.trim("query") != "") & ((F.col("n") == 0) | (F.col("top_score") < 0.012)))
    g = log.groupBy(F.trim("query").alias("query")).agg(
        F.count(F.lit(1)).alias("asked"),
        F.count(F.when(F.col("n") == 0, 1)).alias("empty"),
        F.round(F.max("top_score"), 6).alias("best"),
        F.count(F.when(F.col("degraded"), 1)).alias("degraded"),
    )
    return g.orderBy(F.col("asked").desc(), "query").limit(50)


@query("""SELECT v.event_id AS search_id, c.event_id AS get_id, CAST(epoch(c.ts) - epoch(v.ts) AS BIGINT) AS seconds FROM events v JOIN events c
ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 300 SECOND""")
def goldens_interval_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    # slots of the interval's length make the range an equality: a get lies in the search's slot or the next
    slot = F.floor(F.unix_micros("ts") / 300_000_000)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("search_id"), F.col("ts").alias("at"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    gets = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("get_id"), "ts", slot.alias("slot"))
    near = views.join(gets, ["user_id", "slot"]).where((F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 300 SECOND")))
    # both sides are rounded to whole seconds by the cast in SQL, too
    return near.select("search_id", "get_id", F.rint((F.unix_micros("ts") - F.unix_micros("at")) / 1e6).cast("bigint").alias("seconds"))


@query("""SELECT DISTINCT arg_max(query, (ts, query)) OVER (PARTITION BY lower(trim(top_id))) AS query, lower(trim(top_id)) AS target,
  count(*) OVER (PARTITION BY lower(trim(top_id))) AS times FROM query_log WHERE nullif(trim(top_id), '') IS NOT NULL AND trim(query) <> ''""")
def goldens_last_query(spark, sf):
    log = table(spark, sf, "query_log").where(F.trim("query") != "").withColumn("target", clean_id("top_id")).where("target is not null")
    return log.groupBy("target").agg(F.max_by("query", F.struct("ts", "query")).alias("query"), F.count(F.lit(1)).alias("times"))


# --- governance -----------------------------------------------------------------------------


@query(f"""WITH {_CAT} SELECT c.id, {_PARENT.replace('parent_id', 'c.parent_id')} AS parent_id, c.visibility AS own, coalesce(p.visibility, c.visibility) AS effective
FROM cat c LEFT JOIN cat p ON p.id = {_PARENT.replace('parent_id', 'c.parent_id')}""")
def visibility_cascade(spark, sf):
    return C.cascade(_cat(spark, sf, "parent_id", "visibility"), "visibility")


@query(f"""WITH {_CAT} SELECT c.id, {_PARENT.replace('parent_id', 'c.parent_id')} AS parent_id, c.status AS own, coalesce(p.status, c.status) AS effective
FROM cat c LEFT JOIN cat p ON p.id = {_PARENT.replace('parent_id', 'c.parent_id')}""")
def status_cascade(spark, sf):
    return C.cascade(_cat(spark, sf, "parent_id"), "status")


@query(f"""WITH {_CAT}, r AS (SELECT id, nullif(lower(trim(derived_from)), '') AS source FROM cat)
SELECT r.id, r.source, ['public', 'internal', 'private'][greatest(1, coalesce(list_position(['public', 'internal', 'private'], c.visibility) - 1, 1)) + 1] AS visibility
FROM r LEFT JOIN cat c ON c.id = r.source WHERE r.source IS NOT NULL""")
def disclosure_tighten(spark, sf):
    return C.tighten(_cat(spark, sf, "visibility", "derived_from"))


@query("""SELECT lower(trim(entry_id)) AS entry_id, count(DISTINCT claim_id) AS claims, arg_max(epistemic_status, (created_at, claim_id)) AS epistemic_status,
  arg_max(claim_id, (created_at, claim_id)) AS claim_id, max(confidence) AS best FROM knowledge_claims WHERE nullif(trim(entry_id), '') IS NOT NULL GROUP BY 1""")
def claims_latest(spark, sf):
    c = table(spark, sf, "knowledge_claims").withColumn("entry_id", clean_id("entry_id")).where("entry_id is not null")
    at = F.struct("created_at", "claim_id")
    return c.groupBy("entry_id").agg(
        F.count_distinct("claim_id").alias("claims"),
        F.max_by("epistemic_status", at).alias("epistemic_status"),
        F.max_by("claim_id", at).alias("claim_id"),
        F.max("confidence").alias("best"),
    )


@query("""WITH e AS (SELECT DISTINCT lower(trim(child_id)) AS child, lower(trim(parent_id)) AS parent FROM provenance_edges
  WHERE nullif(trim(child_id), '') IS NOT NULL AND nullif(trim(parent_id), '') IS NOT NULL)
SELECT id, sum(up) AS parents, sum(down) AS children FROM (SELECT child AS id, 1 AS up, 0 AS down FROM e UNION ALL SELECT parent, 0, 1 FROM e) GROUP BY 1""")
def provenance_degrees(spark, sf):
    e = table(spark, sf, "provenance_edges").select(clean_id("child_id").alias("child"), clean_id("parent_id").alias("parent")).dropna().distinct()
    both = e.select(F.col("child").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("parent").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return both.groupBy("id").agg(F.sum("up").alias("parents"), F.sum("down").alias("children"))


@query(f"""WITH RECURSIVE {_CAT}, e AS (SELECT id, nullif(lower(trim(derived_from)), '') AS source FROM cat),
walk AS (SELECT id AS start, source AS node, 1 AS hop, [id] AS seen FROM e WHERE source IS NOT NULL AND source <> id
  UNION ALL SELECT w.start, e.source, w.hop + 1, list_append(w.seen, w.node) FROM walk w JOIN e ON e.id = w.node
  WHERE e.source IS NOT NULL AND NOT list_contains(list_append(w.seen, w.node), e.source))
SELECT start AS id, node AS source, CAST(hop AS BIGINT) AS hop FROM walk""")
def provenance_chain(spark, sf):
    """All sources of each entry, nearest first, also the last one that is unknown; chains stop where they would repeat."""
    c = materialize(_cat(spark, sf, "derived_from").select("id", clean_id("derived_from").alias("source")), f"{scratch_dir(spark)}/sources")
    pairs = H.all_descendants(H.hierarchy(c, superiors=("source",)))
    pairs = pairs.select(F.col("descendant").alias("id"), F.col("ancestor").alias("source"), F.col("distance").alias("hop"))
    known = c.select(F.col("id").alias("source"))
    unknown = c.where("source is not null").join(known, "source", "left_anti").select(F.col("id").alias("last"), F.col("source").alias("unknown"))
    beyond = pairs.join(unknown, pairs.source == unknown.last).select("id", F.col("unknown").alias("source"), (F.col("hop") + 1).alias("hop"))
    own = unknown.select(F.col("last").alias("id"), F.col("unknown").alias("source"), F.lit(1).cast("bigint").alias("hop"))
    return pairs.unionByName(beyond).unionByName(own)


@query(f"WITH {_CAT} SELECT id, retention_class, status FROM cat WHERE status = 'active' AND retention_class NOT IN ('IMPORTANT', 'CORE', 'LEGAL', 'SYSTEM_PROTECTED')")
def retirable(spark, sf):
    c = _cat(spark, sf, "retention_class")
    return c.where((F.col("status") == "active") & ~F.col("retention_class").isin(*C.PROTECTED)).select("id", "retention_class", "status")


# --- merges ---------------------------------------------------------------------------------


_ITEMS = f"""items AS (SELECT DISTINCT item_id, batch_no, nullif(trim(source_path), '') AS path, {_HASH.format('content_hash')} AS hash FROM batch_items),
tops AS (SELECT id, nullif(trim(source_path), '') AS path, {_HASH.format('content_hash')} AS hash, version FROM cat WHERE {_PARENT} IS NULL)"""


@query(f"""WITH {_CAT}, {_ITEMS}, m AS (SELECT item_id, (SELECT min(id) FROM tops t WHERE t.path = i.path AND t.hash = i.hash) AS same, (SELECT min(id) FROM tops t WHERE t.path = i.path) AS older FROM items i)
SELECT item_id, coalesce(same, older) AS entry_id, CASE WHEN same IS NOT NULL THEN 'skip' WHEN older IS NOT NULL THEN 'update' ELSE 'add' END AS matched FROM m""")
def import_merge(spark, sf):
    return C.import_match(_cat(spark, sf, "parent_id", "source_path", "content_hash"), table(spark, sf, "batch_items"))


@query(f"""WITH {_CAT}, {_ITEMS}, last AS (SELECT path, max(version) AS last, arg_max(hash, (version, coalesce(hash, ''))) AS h0 FROM tops WHERE path IS NOT NULL GROUP BY 1),
steps AS (SELECT i.*, last, coalesce(lag(i.hash) OVER (PARTITION BY i.path ORDER BY batch_no, item_id), h0) AS before FROM items i LEFT JOIN last USING (path) WHERE path IS NOT NULL)
SELECT path AS source_path, count(*) AS items, CAST(coalesce(max(last), 0) + sum((hash IS NULL OR before IS NULL OR hash <> before)::INT) AS BIGINT) AS version FROM steps GROUP BY 1""")
def versioned_upsert(spark, sf):
    return C.upsert_versions(_cat(spark, sf, "parent_id", "source_path", "version", "content_hash"), table(spark, sf, "batch_items"))


@query("""SELECT qkey, created_at, data_version FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC NULLS LAST, qkey, data_version) AS nth
  FROM (SELECT DISTINCT qkey, scope, created_at, data_version FROM semantic_cache)) WHERE nth <= 5""")
def newest_per_scope(spark, sf):
    c = table(spark, sf, "semantic_cache").select("qkey", "scope", "created_at", "data_version").distinct()
    w = Window.partitionBy("scope").orderBy(F.col("created_at").desc_nulls_last(), "qkey", "data_version")
    return c.withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("qkey", "created_at", "data_version")


@query("""WITH k AS (SELECT qkey, max(created_at) AS seen FROM semantic_cache GROUP BY 1), c AS (SELECT *, count(*) OVER () AS n FROM k)
SELECT qkey FROM c QUALIFY row_number() OVER (ORDER BY seen NULLS FIRST, qkey) <= n // 10""")
def cache_eviction(spark, sf):
    """The tenth of the keys seen longest ago: whole hours by their counts, then the rest of one hour."""
    k = table(spark, sf, "semantic_cache").groupBy("qkey").agg(F.max("created_at").alias("at")).withColumn("hour", F.coalesce(F.substring("at", 1, 13), F.lit("")))
    hours = k.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # of hours, not of keys
    hours = hours.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    hours = hours.join(F.broadcast(hours.agg(F.expr("sum(n) div 10").alias("most")))).where("before < most")
    whole = hours.where("before + n <= most").select("hour")
    cut = hours.where("before + n > most").select("hour", (F.col("most") - F.col("before")).alias("left"))
    order = Window.partitionBy("hour").orderBy(F.col("at").asc_nulls_first(), "qkey")
    some = k.join(F.broadcast(cut), "hour").withColumn("nth", F.row_number().over(order)).where("nth <= left")
    return k.join(whole, "hour", "left_semi").select("qkey").unionByName(some.select("qkey"))


# --- kinds, hashed vectors, summaries -----------------------------------------------------------

_KIND = " ".join(
    "WHEN ext IN ({}) THEN '{}'".format(", ".join(f"'{e}'" for e in names), "text" if kind == "office" else kind) for kind, names in EXTENSIONS.items()
)


@query(f"""WITH {_CAT}, e AS (SELECT id, lower(regexp_extract(coalesce(source_path, ''), '[^/.][^/]*?\\.([^./]*)$', 1)) AS ext FROM cat)
SELECT id, ext, CASE {_KIND} ELSE 'binary' END AS kind FROM e""")
def kind_by_extension(spark, sf):
    ext = extension(F.coalesce("source_path", F.lit("")))
    return _cat(spark, sf, "source_path").select("id", ext.alias("ext"), kind_of(ext).alias("kind"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(translate(coalesce(text, ''), 'İ', 'i')), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3))) AS gram FROM f WHERE length(t) >= 3),
h AS (SELECT doc_id, md5(gram) AS m, count(*) AS k FROM g GROUP BY 1, 2),
b AS (SELECT doc_id, CAST(CAST('0x' || substr(m, 1, 8) AS BIGINT) % 512 AS INT) AS bucket,
  sum(k * CASE WHEN substr(m, 9, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END) AS w FROM h GROUP BY 1, 2)
SELECT doc_id, bucket, CAST(w AS BIGINT) AS weight FROM b WHERE w <> 0""")
def hash_embed_md5(spark, sf):
    g = T.gram_rows(table(spark, sf, "documents"), ["doc_id"], "text")
    counted = g.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("k"))
    signed = counted.select("doc_id", T.gram_bucket(F.col("gram"), 512).alias("bucket"), (F.col("k") * T.gram_sign(F.col("gram"))).alias("w"))
    return signed.groupBy("doc_id", "bucket").agg(F.sum("w").alias("weight")).where("weight <> 0")


@query(f"""WITH s AS (SELECT doc_id, unnest(list_zip(parts, range(len(parts)))) AS p FROM (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text, '([^.!?。！？；;\\n]+[.!?。！？；;]*)', 1), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents)),
parts AS (SELECT doc_id, p[2] AS pos, p[1] AS s FROM s),
t AS (SELECT doc_id, pos, unnest({_tokens('s')}) AS term FROM parts), f AS (SELECT doc_id, term, count(*) AS k FROM t GROUP BY 1, 2),
scored AS (SELECT doc_id, pos, round(sum(k) / (sqrt(count(*)) + 1), 4) AS score FROM t JOIN f USING (doc_id, term) GROUP BY 1, 2),
best AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) AS nth FROM scored) WHERE nth <= 4),
run AS (SELECT doc_id, pos, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
  FROM best JOIN parts USING (doc_id, pos))
SELECT doc_id, string_agg(s, '' ORDER BY pos) AS summary FROM run WHERE upto <= 400 OR nth = 1 GROUP BY 1""")
def extractive_summary(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "s"))
    t = parts.select("doc_id", "pos", F.explode(T.tokens("s")).alias("term")).groupBy("doc_id", "pos", "term").agg(F.count(F.lit(1)).alias("n"))
    f = t.groupBy("doc_id", "term").agg(F.sum("n").alias("k"))
    score = F.round(F.sum(F.col("k") * F.col("n")) / (F.sqrt(F.sum("n")) + 1), 4)
    scored = t.join(f, ["doc_id", "term"]).groupBy("doc_id", "pos").agg(score.alias("score"))
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("pos").desc())
    chosen = scored.withColumn("nth", F.row_number().over(best)).where("nth <= 4").select("doc_id", "pos").join(parts, ["doc_id", "pos"])
    order = Window.partitionBy("doc_id").orderBy("pos")
    run = chosen.withColumn("upto", F.sum(F.length("s")).over(order)).withColumn("nth", F.row_number().over(order)).where("upto <= 400 or nth = 1")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
    return run.groupBy("doc_id").agg(F.array_join(joined, "").alias("summary"))
