"""Queries of the hierarchy operator (problem 3) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import hierarchy as H
from archivolt.sources.tables import entries


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(entries(spark, sf_dir), paths=False)
    return tree.where("sup is not null").select(F.col("id").alias("entry_id"), F.col("root").alias("root_id"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(entries(spark, sf_dir))
    return tree.select(F.col("id").alias("entry_id"), F.col("root").alias("root_id"), "depth", "path", "in_loop")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs outside loops, as its SQL has them."""
    return H.descendants(H.hierarchy(entries(spark, sf_dir)))


def p3_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.all_descendants(H.hierarchy(entries(spark, sf_dir)))


_NODES = """
WITH RECURSIVE nodes AS (
  SELECT lower(trim(id)) AS id, max(coalesce(nullif(lower(trim(parent_id)), ''), nullif(lower(trim(derived_from)), ''))) AS sup
  FROM entries WHERE nullif(trim(id), '') IS NOT NULL GROUP BY 1),
linked AS (SELECT n.id, n.sup FROM nodes n JOIN nodes m ON n.sup = m.id),
down AS (
  SELECT id AS root, id, 0::BIGINT AS depth, id AS path FROM nodes WHERE id NOT IN (SELECT id FROM linked)
  UNION ALL
  SELECT d.root, l.id, d.depth + 1, d.path || '/' || l.id FROM down d JOIN linked l ON l.sup = d.id),
up AS (
  SELECT id AS start, id AS node FROM linked WHERE id NOT IN (SELECT id FROM down)
  UNION
  SELECT u.start, l.sup FROM up u JOIN linked l ON l.id = u.node),
ring AS (SELECT DISTINCT u.start FROM up u JOIN linked l ON l.id = u.node WHERE l.sup = u.start),
loops AS (SELECT u.start AS id, min(u.node) AS root FROM up u JOIN ring r ON r.start = u.node GROUP BY 1)
"""

SQL = {
    "p3_found": _NODES
    + "SELECT id AS entry_id, root AS root_id FROM down WHERE depth > 0 UNION ALL SELECT id, root FROM loops",
    "p3_paths": _NODES
    + """SELECT id AS entry_id, root AS root_id, depth, path, false AS in_loop FROM down
UNION ALL SELECT id, root, NULL, NULL, true FROM loops""",
    "p3_descendants": _NODES
    + """, pairs AS (
  SELECT id AS descendant, depth, unnest(string_split(path, '/')) AS ancestor, generate_subscripts(string_split(path, '/'), 1) - 1 AS pos
  FROM down WHERE depth > 0)
SELECT ancestor, descendant, depth - pos AS distance FROM pairs WHERE pos < depth""",
    "p3_all_descendants": _NODES
    + """, walk AS (
  SELECT sup AS ancestor, id AS descendant, 1::BIGINT AS distance, [id, sup] AS way FROM linked WHERE sup <> id
  UNION ALL
  SELECT l.sup, w.descendant, w.distance + 1, list_append(w.way, l.sup) FROM walk w JOIN linked l ON l.id = w.ancestor
  WHERE NOT list_contains(w.way, l.sup))
SELECT ancestor, descendant, distance FROM walk""",
}
QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_all_descendants": p3_all_descendants}
