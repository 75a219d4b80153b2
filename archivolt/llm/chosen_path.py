"""Near-duplicate records with small edits: a chosen-path similarity join.

Every text is a set of tokens (its MinHash values by coordinate, so that the
share of common tokens estimates the Jaccard similarity of the texts' runs).
A run starts with all sets in one node. A node samples GROWTH/threshold
coordinates on average, the same for all its members, and every sampled
coordinate sends a member to the child named by its token; pairs at the
threshold share GROWTH children on average at every level, dissimilar pairs
part soon. As GROWTH is above one, the probability that a pair at the threshold
still shares a node doesn't fall to zero with depth, so that the number of runs
that reaches the target recall is the same at every depth and every size.
Nodes of at most ``bucket`` members are compared in full, larger ones split
again. A node that a split hardly shrinks holds sets that are alike: it is
compared in full in tiles of bounded size, as is what ``max_depth`` leaves, so
nothing is capped.

Only the nodes above ``bucket`` are listed by level; the members of a level are
derived from the sets again where they are needed, without an exchange. One
exchange brings the members of small nodes and tiles together, whose sizes are
bounded, so a node that holds a third of all sets never meets in one task. The
join compares half of the packed sketch in generated code, the whole sketch
follows, and survivors are compared exactly on whole texts. Copies (equal
folded texts) form one class first, so a group of copies costs one member.

``near_duplicates`` returns pairs of class representatives and the membership;
``record_pairs`` expands them where all pairs of records are asked for.

Defined results: null, empty and short texts (fewer than 200 letters and
digits) are in no pair; rows of one id are one record, a record without id
none; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from archivolt.llm import shingles as S
from archivolt.session import anti_join_sized, join_sized, materialize, scratch_dir, semi_join_sized

SEED = 77
#: Children that a pair at the threshold shares on average.
GROWTH = 1.25


def _branches(threshold: float) -> tuple[int, float]:
    """Children of a node: the whole number and the probability of one more."""
    mean = GROWTH / threshold
    return math.floor(mean), mean - math.floor(mean)


def survival(threshold: float, depth: int) -> float:
    """Probability that a pair at the threshold still shares a node after ``depth`` levels of one run."""
    least, more = _branches(threshold)
    gone = 0.0
    for _ in range(depth):
        part = 1 - threshold + threshold * gone
        gone = (1 - more) * part**least + more * part ** (least + 1)
    return 1 - gone


def runs_for(threshold: float, recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def _children(path: Column, threshold: float) -> Column:
    """The coordinates that a node samples."""
    least, more = _branches(threshold)
    first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(S.COORDS)).cast("int")
    picks = [first]
    for j in range(least):  # a stride of odd length visits distinct coordinates
        stride = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(S.COORDS // 2)).cast("int") * 2 + 1
        picks.append(F.pmod(first + stride * (j + 1), F.lit(S.COORDS)).cast("int"))
    extra = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(10_000)) < int(more * 10_000)
    return F.when(extra, F.array(*picks)).otherwise(F.array(*picks[:least]))


def _split(df: DataFrame, threshold: float, keep: list[str]) -> DataFrame:
    """One level: rows (path, sig, ...) to a row for each child."""
    out = df.select(*keep, "sig", "path", F.explode(_children(F.col("path"), threshold)).alias("c"))
    return out.select(*keep, "sig", F.xxhash64("path", "c", F.expr("sig[c]")).alias("path"))


def _large(rows: DataFrame, path: str, bucket: int, last: bool) -> tuple[DataFrame, dict]:
    """(path, n, fate) of the nodes above ``bucket``: fate 1 is compared in tiles, 2 split again."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("up")).where(F.col("n") > bucket)
    dense = F.lit(True) if last else F.col("n") * 2 > F.col("up")
    sizes = sizes.select("path", "n", F.when(dense, 1).otherwise(2).alias("fate"))
    seen = Observation()
    out = materialize(sizes.observe(seen, F.count(F.when(F.col("fate") == 1, 1)).alias("dense"), F.count(F.when(F.col("fate") == 2, 1)).alias("big")), path)
    return out, seen.get


def start_level(n: int) -> int:
    """Levels before sizes are looked at: one more for every hundredfold of the sets."""
    return max(2, round((math.log10(max(n, 1)) - 1) / 2))


def candidate_pairs(
    reps: DataFrame,
    base: str,
    threshold: float,
    recall: float = 0.995,
    bucket: int = 64,
    tile: int = 1024,
    max_depth: int = 8,
) -> DataFrame:
    """Pairs (k_a, k_b) of ``reps`` (k, sig, s*) whose half sketches are near enough to be compared."""
    depth = min(start_level(reps.count()), max_depth)
    own = ["k", "s0", "s1"]
    runs = runs_for(threshold, recall, max_depth)
    rows = reps.select(*own, "sig", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    rows = rows.select(*own, "sig", F.xxhash64(F.lit(SEED), "run").alias("path"))
    for _ in range(depth):
        rows = _split(rows, threshold, own)
    rows = rows.withColumn("up", F.lit(1 << 62))
    ended, tiles = [], []
    while True:
        large, seen = _large(rows, f"{base}/level{depth}", bucket, depth >= max_depth)
        ended.append(anti_join_sized(rows, large, "path").select("path", *own))
        if seen["dense"]:
            tiles.append(join_sized(rows, large.where("fate = 1").select("path", "n"), "path").select("path", *own, "n"))
        if not seen["big"]:
            break
        big = join_sized(rows.drop("up"), large.where("fate = 2").select("path", F.col("n").alias("up")), "path")
        rows = _split(big, threshold, [*own, "up"])
        depth += 1

    members = _union(ended).withColumn("part", F.lit(0)).withColumn("half", F.lit(False))
    if tiles:
        parts = F.ceil(F.col("n") / tile).cast("int")
        cut = _union(tiles).withColumn("m", parts).withColumn("mine", F.pmod(F.xxhash64("k", "path"), parts).cast("int"))
        cut = cut.select("path", *own, "mine", F.explode(F.expr("sequence(0, m - 1)")).alias("other"))
        members = members.unionByName(
            cut.select(
                F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"),
                *own,
                F.col("mine").alias("part"),
                (F.col("mine") != F.col("other")).alias("half"),
            )
        )
    return _within(members, S.sketch_limit(threshold, longs=2))


def _within(rows: DataFrame, limit: int) -> DataFrame:
    """Distinct pairs (k_a, k_b) of rows (path, k, part, half, s*) in one node, within the sketch distance.

    ``part`` is a row's side of a tile; in a tile of two parts only pairs across count.
    """
    rows = rows.repartition("path")  # both sides read one exchange
    a, b = rows.alias("a"), rows.alias("b")
    across = ~F.col("a.half") | (F.col("a.part") != F.col("b.part"))
    on = (F.col("a.path") == F.col("b.path")) & (F.col("a.k") < F.col("b.k")) & across & (S.sketch_distance("a", "b", 2) <= limit)
    return a.join(b, on).select(F.col("a.k").alias("k_a"), F.col("b.k").alias("k_b")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, recall: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: id, k - every record that can resemble another and its class of copies.
    links: k_a, k_b, similarity - pairs of different classes at or above the threshold.
    """
    base = scratch_dir(df.sparkSession)
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    # rows are numbered as they are written; a class is known by its first row
    sketched = materialize(S.sketch(named, ["id"], "text").drop("runs").withColumn("row", F.monotonically_increasing_id()), f"{base}/sketch")
    again = sketched.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("k")).where("n > 1").select("cls", "k")
    again = materialize(again, f"{base}/again")
    once = anti_join_sized(sketched, again, "cls").withColumn("k", F.col("row"))
    more = join_sized(sketched, again, "cls")
    members = once.select("id", "k").unionByName(more.select("id", "k")).groupBy("id").agg(F.min("k").alias("k"))
    longs = [f"s{i}" for i in range(S.SKETCH_LONGS)]
    reps = once.unionByName(more.where("k = row")).select("k", "id", "sig", *longs)

    pairs = materialize(candidate_pairs(reps, base, threshold, recall), f"{base}/pairs")
    sides = [reps.select(F.col("k").alias(f"k_{x}"), F.col("id").alias(f"id_{x}"), *[F.col(s).alias(f"{s}_{x}") for s in longs]) for x in "ab"]
    near = pairs.join(sides[0], "k_a").join(sides[1], "k_b")
    near = near.where(S.sketch_distance(None, None, S.SKETCH_LONGS, ("_a", "_b")) <= S.sketch_limit(threshold))
    near = materialize(near.select("k_a", "k_b", "id_a", "id_b"), f"{base}/near")
    # the first text of a pair comes to the listed pairs within the scan, both meet in one exchange
    first = join_sized(named.withColumnRenamed("id", "id_a").withColumnRenamed("text", "text_a"), near, "id_a")
    second = semi_join_sized(named.withColumnRenamed("id", "id_b").withColumnRenamed("text", "text_b"), near.select("id_b").distinct(), "id_b")
    both = first.select("k_a", "k_b", "id_b", "text_a").join(second, "id_b")
    scored = both.select("k_a", "k_b", S.similarity_udf("text_a", "text_b").alias("similarity")).where(F.col("similarity") >= threshold)
    return members, materialize(scored.groupBy("k_a", "k_b").agg(F.max("similarity").alias("similarity")), f"{base}/links")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records (id_a < id_b): across linked classes and within each class."""
    a = members.select(F.col("k").alias("k_a"), F.col("id").alias("x"))
    b = members.select(F.col("k").alias("k_b"), F.col("id").alias("y"))
    across = links.select("k_a", "k_b").join(a, "k_a").join(b, "k_b").select("x", "y")
    inside = a.join(b.withColumnRenamed("k_b", "k_a"), "k_a").where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
