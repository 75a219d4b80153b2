"""Parent-child links to full hierarchies, by pointer doubling.

Every node with an existing superior holds a pointer to an ancestor and the
distance to it. A round joins each unresolved pointer with the pointer of the
node it names, which doubles the distance; a pointer that names a root is
final. Depth D takes ceil(log2 D) rounds. Every acyclic chain of unresolved
nodes has a member that resolves in the next round, so a round that resolves
nothing leaves exactly the nodes that hang on a loop. Those go on doubling,
with the smallest id seen on the way, until the jump exceeds their number; the
pointer then lies on the loop and the smallest id after it is the loop's.

Defined results: null or empty ids are dropped; repeated rows are one node (of
several superiors for one id the largest counts); a reference to an unknown id
makes a root; a node that names itself is a loop of one; an empty table gives
an empty result; other columns are ignored. Nodes on or below a loop have null
path and depth, ``in_loop`` true and the loop's smallest id as root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_id
from archivolt.session import materialize, scratch_dir

SEPARATOR = "/"


def superior_links(df: DataFrame, id_col: str, superiors: list[str], clean=clean_id) -> DataFrame:
    """(id, sup) of every node; sup is the first non-empty of ``superiors``."""
    sup: Column = F.coalesce(*[clean(F.col(c)) for c in superiors])
    return (
        df.select(clean(F.col(id_col)).alias("id"), sup.alias("sup"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("sup").alias("sup"))
    )


def _observed_write(df: DataFrame, path: str, *metrics: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    out = materialize(df.observe(seen, *metrics), path)
    return out, seen.get


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hierarchy(
    df: DataFrame,
    id_col: str = "id",
    superiors: tuple[str, ...] = ("parent_id", "derived_from"),
    paths: bool = True,
) -> DataFrame:
    """One row per node: id, sup, root, depth, path, in_loop.

    ``path`` is root/.../id (null with ``paths=False``); ``sup`` is null where
    the superior is missing or unknown.
    """
    spark = df.sparkSession
    base = scratch_dir(spark)
    nodes = materialize(superior_links(df, id_col, list(superiors)), f"{base}/nodes")
    known = nodes.select(F.col("id").alias("sup"))
    linked = nodes.where(F.col("sup").isNotNull()).join(known, "sup", "left_semi")
    linked = materialize(linked.select("id", "sup"), f"{base}/linked")

    above = linked.select(F.col("id").alias("sup"), F.lit(True).alias("more"))
    segment = F.col("sup") if paths else F.lit(None).cast("string")
    first = linked.join(above, "sup", "left").select(
        "id",
        F.col("sup").alias("ptr"),
        F.lit(1).cast("long").alias("dist"),
        segment.alias("seg"),
        F.col("more").isNull().alias("done"),
    )
    counts = (F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("done").cast("long")), F.lit(0)).alias("done"))
    state, seen = _observed_write(first, f"{base}/round0", *counts)
    resolved = [state.where("done")]
    active, left = state.where("not done"), seen["n"] - seen["done"]
    k = 0
    while left:
        k += 1
        target = _union([*resolved, active]).select(
            F.col("id").alias("ptr"),
            F.col("ptr").alias("t_ptr"),
            F.col("dist").alias("t_dist"),
            F.col("seg").alias("t_seg"),
            F.col("done").alias("t_done"),
        )
        joined = active.drop("done").join(target, "ptr")
        seg = F.concat_ws(SEPARATOR, "t_seg", "seg") if paths else F.col("seg")
        joined = joined.select(
            "id", F.col("t_ptr").alias("ptr"), (F.col("dist") + F.col("t_dist")).alias("dist"), seg.alias("seg"), F.col("t_done").alias("done")
        )
        state, seen = _observed_write(joined, f"{base}/round{k}", *counts)
        if not seen["done"]:
            break
        resolved.append(state.where("done"))
        active, left = state.where("not done"), seen["n"] - seen["done"]

    path = F.concat_ws(SEPARATOR, "seg", "id") if paths else F.lit(None).cast("string")
    done = _union(resolved).select(
        "id", F.col("ptr").alias("root"), F.col("dist").alias("depth"), path.alias("path"), F.lit(False).alias("in_loop")
    )
    if left:
        done = done.unionByName(_loop_roots(active.select("id"), linked, left, base))
    rest = nodes.join(linked, "id", "left_anti").select(
        "id",
        F.lit(None).cast("string").alias("sup"),
        F.col("id").alias("root"),
        F.lit(0).cast("long").alias("depth"),
        (F.col("id") if paths else F.lit(None).cast("string")).alias("path"),
        F.lit(False).alias("in_loop"),
    )
    return linked.join(done, "id").select(*rest.columns).unionByName(rest)


def _loop_roots(ids: DataFrame, linked: DataFrame, n: int, base: str) -> DataFrame:
    """Smallest id of the loop that each of ``ids`` leads into; ``n`` is their number."""
    step = linked.join(ids, "id", "left_semi").select("id", F.col("sup").alias("ptr"), F.col("id").alias("low"))
    state = materialize(step, f"{base}/loop0")
    span, k = 1, 0
    while span < n:
        k += 1
        span *= 2
        target = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"))
        state = materialize(
            state.join(target, "ptr").select("id", F.col("t_ptr").alias("ptr"), F.least("low", "t_low").alias("low")),
            f"{base}/loop{k}",
        )
    on_loop = state.select(F.col("id").alias("ptr"), F.col("low").alias("root"))
    return state.join(on_loop, "ptr").select(
        "id", "root", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("in_loop")
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on one path, from ``hierarchy(..., paths=True)``.

    Nodes on or below loops have no pairs here; ``all_descendants`` has theirs too.
    """
    steps = F.split("path", SEPARATOR)
    return (
        tree.where("depth > 0")
        .select(F.col("id").alias("descendant"), "depth", F.posexplode(steps).alias("at", "ancestor"))
        .where("at < depth")
        .select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    )


def all_descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on any way up, also on and below loops, from ``hierarchy(...)``.

    A loop is cut above its smallest id, so that its nodes and their branches
    hang below that id; the nodes of the loop that a way up passes only after
    the cut are added. No node is its own descendant; ``distance`` is the
    smallest number of steps.
    """
    looped = tree.where("in_loop")
    cut = materialize(hierarchy(looped.select("id", F.when(F.col("id") != F.col("root"), F.col("sup")).alias("sup")), superiors=("sup",)), f"{scratch_dir(tree.sparkSession)}/cut")
    last = looped.where("id = root").select(F.col("sup").alias("id"))
    rings = cut.join(last, "id").select("root", F.split("path", SEPARATOR).alias("ring"))
    passed = cut.join(rings, "root").select(F.col("id").alias("descendant"), "depth", "path", F.size("ring").alias("n"), F.posexplode("ring").alias("at", "ancestor"))
    passed = passed.where(~F.array_contains(F.split("path", SEPARATOR), F.col("ancestor")))
    passed = passed.select("ancestor", "descendant", (F.col("depth") + F.col("n") - F.col("at")).alias("distance"))
    return descendants(tree).unionByName(descendants(cut)).unionByName(passed)
