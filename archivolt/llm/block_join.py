"""Most similar vectors for every vector: a block matrix join with int8 tiles.

Vectors of one length are laid out in cells (spherical k-means on a bounded
hash sample of ``sample_size`` vectors per length; every vector gets a cell). A
vector is data in its own cell and a query there and in every cell whose border
is within ``margin`` of it, so the work grows as n^1.5 instead of n^2. Cells
are cut in blocks of bounded size; a tile is one block of data and one of
queries. A tile multiplies int8 codes, which gives every cosine with a bound on
its error; pairs that may still be among the k best are recomputed from the
floats, and the tiles' k best are merged. ``margin`` trades work for recall
(0.15: above 0.99 of the true 10 nearest on the test tables, all above a
cosine of 0.9); infinity compares everything.

Equal vectors are one member of the join and get their keys back at the end,
so a group of copies never meets itself pair by pair.

Defined results: for a repeated key the row with the latest ``created_at``
counts (null is the earliest; ties: the larger data version, then the larger
bytes); a blob that is null, empty, no whole number of floats, zero or not
finite is no vector; a null key is dropped; ties in cosine go to the smaller
key; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.session import anti_join_sized, materialize, scratch_dir

SAMPLE = 16_384
DATA_BLOCK, QUERY_BLOCK = 8_192, 32_768
ROUNDS = 12


def latest_vectors(df: DataFrame, key: str = "qkey", blob: str = "qvec_blob", at: str = "created_at", version: str = "data_version") -> DataFrame:
    """(key, blob) of the counting row of every key. Only keys that occur more than once are shuffled with their blobs."""
    rows = df.select(F.col(key).alias("key"), F.col(blob).alias("blob"), F.struct(F.col(at), F.col(version), F.col(blob)).alias("age")).where("key is not null")
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    repeated = materialize(repeated, f"{scratch_dir(df.sparkSession)}/repeated")
    once = anti_join_sized(rows.select("key", "blob"), repeated, "key")
    many = rows.join(repeated, "key").groupBy("key").agg(F.max_by("blob", "age").alias("blob"))
    return once.unionByName(many)


def vector(blob: bytes | None) -> np.ndarray | None:
    """The unit vector that a blob of little-endian float32 holds, or None."""
    if not blob or len(blob) % 4:
        return None
    v = np.frombuffer(blob, "<f4").astype(np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return (v / np.sqrt(v @ v)).astype(np.float32)


def unit_vectors(latest: DataFrame) -> DataFrame:
    """(key, dim, vec) of the keys that hold a vector; vec is float32 of length one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [vector(x) for x in b.column(1).to_pylist()]
            keep = [i for i, v in enumerate(found) if v is not None]
            dims = pa.array([len(found[i]) for i in keep], pa.int32())
            vecs = pa.array([found[i].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), dims, vecs], names=["key", "dim", "vec"])

    kind = latest.schema["key"].dataType.simpleString()
    return latest.select("key", "blob").mapInArrow(work, f"key {kind}, dim int, vec binary")


def fit_cells(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centres of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres).astype(np.float32)
    return centres


def cell_count(n: int) -> int:
    return max(1, round((n / 25) ** 0.5))


def sample_size(n: int) -> int:
    """Vectors that the cells are fitted on: SAMPLE, or eight for each cell where that is more."""
    return max(SAMPLE, 8 * cell_count(n))


def probed(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of every row, and which cells it visits as a query."""
    near = x @ centres.T
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
    visits = (near[np.arange(len(x)), own][:, None] - near) / apart[own] <= margin
    visits[np.arange(len(x)), own] = True
    return own, visits


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and the norm of what they leave out."""
    scale = np.abs(x).max(axis=1) / 127
    c = np.rint(x / scale[:, None]).astype(np.int8)
    return c, scale, np.linalg.norm(x - c * scale[:, None], axis=1)


def _products(a: np.ndarray, b: np.ndarray, exact: int = 1_000) -> np.ndarray:
    """Products of int8 codes held as float32: sums of up to 1,000 of them are exact, longer ones are added up from such parts."""
    if a.shape[1] <= exact:
        return a @ b
    return sum((a[:, i : i + exact] @ b[i : i + exact]).astype(np.float64) for i in range(0, a.shape[1], exact))


def tile_best(data: np.ndarray, queries: np.ndarray, same: np.ndarray, k: int, least: float, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data, cosine) of the k best at or above ``least``; ``same[q]`` is the query's own data row or -1."""
    dc, ds, de = codes(data)
    qc, qs, qe = codes(queries)
    dc = dc.astype(np.float32).T
    out = ([], [], [])
    for at in range(0, len(queries), rows):
        q = slice(at, at + rows)
        near = _products(qc[q].astype(np.float32), dc) * qs[q, None] * ds[None]
        slack = (qe[q, None] + de[None]) * 1.0001 + qe[q, None] * de[None] + 1e-6
        own = same[q]
        i = np.flatnonzero(own >= 0)
        near[i, own[i]] = -9
        floor = np.full(len(near), least)
        if near.shape[1] > k:
            floor = np.maximum(floor, np.partition(near - slack, -k, axis=1)[:, -k])
        i, j = np.nonzero(near + slack >= floor[:, None])
        keep = j != own[i]
        i, j = i[keep], j[keep]
        cos = np.empty(len(i), np.float64)
        for s in range(0, len(i), 50_000):
            e = slice(s, s + 50_000)
            cos[e] = np.einsum("ij,ij->i", queries[at + i[e]].astype(np.float64), data[j[e]].astype(np.float64))
        good = cos >= least
        i, j, cos = i[good], j[good], cos[good]
        order = np.lexsort((j, -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        first = np.searchsorted(i, i, side="left")
        top = np.arange(len(i)) - first < k
        for o, v in zip(out, (i[top] + at, j[top], cos[top]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.empty(0) for o in out)


def neighbours(vectors: DataFrame, k: int = 10, least: float = -1.0, margin: float = 0.15, queries: str | None = None) -> DataFrame:
    """(key, other, cosine): the k most similar other vectors of each of ``vectors`` (key, dim, vec), keys unique.

    ``queries``: a condition on the columns; only rows that meet it are searched for, against all.
    """
    spark = vectors.sparkSession
    base = scratch_dir(spark)
    kind = vectors.schema["key"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()}
    share = F.lit(0.0)
    for dim, n in counts.items():
        share = F.when(F.col("dim") == dim, F.lit(sample_size(n) / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(draw < share).select("dim", "vec").collect() if counts else []
    centres = {}
    for dim, n in counts.items():
        own = [np.frombuffer(r.vec, np.float32) for r in sample if r.dim == dim]
        centres[dim] = fit_cells(np.stack(own), cell_count(n)) if own else np.eye(1, dim, dtype=np.float32)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                if dim not in shared.value:
                    continue
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                x = np.stack([np.frombuffer(v, np.float32) for v in part.column(2).to_pylist()])
                own, visits = probed(x, shared.value[dim], margin)
                row, cell = np.nonzero(visits)
                asks = part.column(3).to_numpy(zero_copy_only=False)[row]
                data = cell == own[row]
                keep = data | asks
                row, cell, data, asks = row[keep], cell[keep], data[keep], asks[keep]
                got = part.select(["key", "dim", "vec"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*got.columns, pa.array(cell.astype(np.int32)), pa.array(data), pa.array(asks)], names=["key", "dim", "vec", "cell", "data", "asks"]
                )

    asked = vectors.select("key", "dim", "vec", (F.expr(queries) if queries else F.lit(True)).alias("asks"))
    # placing twice is cheaper than writing every visit with its vector
    placed = asked.mapInArrow(place, f"key {kind}, dim int, vec binary, cell int, data boolean, asks boolean")
    sizes = placed.groupBy("dim", "cell").agg(
        F.ceil(F.sum(F.col("data").cast("long")) / DATA_BLOCK).cast("int").alias("n_data"),
        F.ceil(F.sum(F.col("asks").cast("long")) / QUERY_BLOCK).cast("int").alias("n_asks"),
    )
    sizes = materialize(sizes, f"{base}/sizes")
    # one row for each cell: their number grows with the root of the vectors'
    sized = placed.join(F.broadcast(sizes), ["dim", "cell"]).where("n_data > 0 and n_asks > 0")
    h = F.xxhash64("key", F.lit(1))
    mine = sized.withColumn("i", F.when(F.col("data"), F.pmod(h, F.col("n_data")))).withColumn("j", F.when(F.col("asks"), F.pmod(h, F.col("n_asks"))))
    as_query = F.when(F.col("asks"), F.transform(F.expr("sequence(0, n_data - 1)"), lambda i: F.struct(i.alias("i"), F.col("j").cast("int").alias("j"))))
    as_data = F.when(F.col("data"), F.transform(F.expr("sequence(0, n_asks - 1)"), lambda j: F.struct(F.col("i").cast("int").alias("i"), j.alias("j"))))
    empty = F.array().cast("array<struct<i:int,j:int>>")
    tiles = F.explode(F.array_union(F.coalesce(as_query, empty), F.coalesce(as_data, empty)))
    rows = mine.withColumn("tile", tiles).select(
        "dim",
        "cell",
        F.col("tile.i").alias("ti"),
        F.col("tile.j").alias("tj"),
        "key",
        "vec",
        (F.col("data") & (F.col("i") == F.col("tile.i"))).alias("is_data"),
        (F.col("asks") & (F.col("j") == F.col("tile.j"))).alias("is_query"),
    )
    schema = pa.schema([("key", arrow), ("other", arrow), ("cosine", pa.float64())])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(group.num_rows, -1)
        is_data = group.column("is_data").to_numpy(zero_copy_only=False).astype(bool)
        is_query = group.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        if not is_data.any() or not is_query.any():
            return schema.empty_table()
        d, q = np.flatnonzero(is_data), np.flatnonzero(is_query)
        place_of = np.full(len(x), -1)
        place_of[d] = np.arange(len(d))
        i, j, cos = tile_best(x[d], x[q], place_of[q], k, least)
        keys = group.column("key").combine_chunks()
        return pa.table([keys.take(pa.array(q[i.astype(np.int64)])), keys.take(pa.array(d[j.astype(np.int64)])), pa.array(cos)], schema=schema)

    found = rows.groupBy("dim", "cell", "ti", "tj").applyInArrow(compare, f"key {kind}, other {kind}, cosine double")
    best = Window.partitionBy("key").orderBy(F.col("cosine").desc(), "other")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")


def most_similar(df: DataFrame, k: int = 10, least: float = -1.0, margin: float = 0.15, queries: str | None = None) -> DataFrame:
    """(key, other, cosine) over the rows of a vector cache (qkey, qvec_blob, created_at, data_version).

    Copies enter ``neighbours`` once. A key's neighbours are then the keys of
    its own class and of the classes near it, best first; of any class its k + 1
    smallest keys are enough.
    """
    base = scratch_dir(df.sparkSession)
    vectors = materialize(unit_vectors(latest_vectors(df)).withColumn("cls", F.unhex(F.md5("vec"))), f"{base}/vectors")
    members = vectors.select("cls", "key", F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    some = Window.partitionBy("cls", "salt").orderBy("key")
    few = members.withColumn("nth", F.row_number().over(some)).where(F.col("nth") <= k + 1)
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("key"))).where(F.col("nth") <= k + 1)
    few = materialize(few.select("cls", "key", "nth"), f"{base}/few")
    reps = few.where("nth = 1").select("cls", F.col("key").alias("rep"))
    others = materialize(members.join(reps, "cls").where("key <> rep").select("key"), f"{base}/others")
    unique = anti_join_sized(vectors.select("key", "dim", "vec"), others, "key")

    asks = None
    if queries:  # a class is searched for when any of its keys is
        wanted = vectors.where(queries).select("cls").distinct().join(reps, "cls").select(F.col("rep").alias("key"), F.lit(True).alias("wanted"))
        unique, asks = unique.join(wanted, "key", "left"), "coalesce(wanted, false)"
    near = neighbours(unique, k, least, margin, asks)
    by_class = near.join(reps.withColumnRenamed("rep", "key"), "key").select("cls", "other", "cosine")
    by_class = by_class.join(reps.select(F.col("cls").alias("c2"), F.col("rep").alias("other")), "other").select("cls", "c2", "cosine")
    own = few.where("nth = 2").select("cls", F.col("cls").alias("c2"), F.lit(1.0).alias("cosine"))
    near = by_class.unionByName(own).join(few.select(F.col("cls").alias("c2"), F.col("key").alias("other")), "c2").select("cls", "other", "cosine")
    # k + 1 are kept: a key skips itself
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy(F.col("cosine").desc(), "other"))).where(F.col("nth") <= k + 1)
    keys = vectors.select("cls", "key") if not queries else vectors.where(queries).select("cls", "key")
    out = keys.join(near.select("cls", "other", "cosine"), "cls").where("key <> other").where(F.col("cosine") >= least)
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.col("cosine").desc(), "other")))
    return out.where(F.col("nth") <= k).select("key", "other", "cosine")

