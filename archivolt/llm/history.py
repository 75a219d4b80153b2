"""Deduplicating new batches against all history: multi-key sorted-neighbourhood runs.

A history is a folder of persisted runs and a manifest; ``History.open`` goes on
with it in any later session. Every class of equal folded texts stands in a run
under KEYS likeness keys. A key is the number of its sort order and four MinHash
values, so that texts that resemble each other are neighbours in some order. A
run is cut by sampled bounds into key ranges of even size, whatever is hot, and
sorted within them; every BLOCK rows a row is a fence. Class rows (paths, whole
sketch, text) and content hashes lie in ranges of their own.

Checking a batch: its sorted keys are merged with the fences of the ranges that
they fall into, which places every key in the sorted run, and are compared with
the rows of the window around that place: its block and the two beside it.
Survivors of the sketches are compared exactly on whole texts. Where more rows
than the window share three MinHash values with a key (hot keys), the window
stays bounded; only items that it doesn't show to be cases go on to the rest of
the rows with these values. The items of a batch are compared with each other in
the same way and settled in their order. Accepted items become a run of their
own; after COMPACT_EVERY of them all runs but the first are merged into one.
History is scanned by ranges but neither shuffled nor sorted again, and only
ranges that the batch touches are read.

Copies are settled by class, never by pairs: of each class the earliest live
item and the earliest under another path say whether an item has a predecessor.
Rounds accept items without live predecessors and reject items with accepted
ones until none is open.

A batch of more than SLICE items is checked in slices, in order; the result is
the same for any number. Defined results: rows of one item id are one item, an
item without id is dropped; null, empty and short previews (fewer than 200
letters and digits) resemble nothing; a hash that isn't 64 hexadecimal digits in
some notation is none; an empty or null path differs from every path; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_hash, clean_id, clean_path
from archivolt.llm import shingles as S
from archivolt.session import BROADCAST_ROWS, join_sized, list_folder, load_text, materialize, release, save_text, scratch_dir

KEYS = 20
BLOCK = 16
THRESHOLD = 0.6
COMPACT_EVERY = 4
SLICE = 50_000
#: Placed keys that may be broadcast: 80 bytes each.
PLACED_ROWS = 1_000_000
#: Links between classes of a slice with which one task settles it.
GREEDY_LINKS = 1_000_000

_HALF = ["s0", "s1"]
_LONGS = [f"s{i}" for i in range(S.SKETCH_LONGS)]
_KEY_RUN = "key bigint, cls binary, runs int, s0 bigint, s1 bigint, block bigint, run int, zone int, fence boolean"
_CLASS_RUN = "cls binary, low string, high string, loose boolean, s0 bigint, s1 bigint, s2 bigint, s3 bigint, text string, hash string, run int, kind string, range int"
#: The sort orders use disjoint triples of MinHash values; a fourth value only orders.
_KEY = (
    "shiftleft(cast(j as bigint), 58) | shiftleft(cast(sig[3 * j] & 65535 as bigint), 42) | shiftleft(cast(sig[3 * j + 1] & 65535 as bigint), 26)"
    " | shiftleft(cast(sig[3 * j + 2] & 65535 as bigint), 10) | cast(shiftrightunsigned(sig[60 + j] & 65535, 6) as bigint)"
)


def key_rows(df: DataFrame, *keep: str) -> DataFrame:
    """A row (key, *keep) for each sort order of rows with ``sig``."""
    return df.select(*keep, "sig", F.explode(F.sequence(F.lit(0), F.lit(KEYS - 1))).alias("j")).select(*keep, F.expr(_KEY).alias("key"))


def _prefix(key: str | Column) -> Column:
    """Sort order and three MinHash values of a key."""
    return F.shiftrightunsigned(key, 10)


def _near(a: Column, b: Column) -> Column:
    return (a >= b * THRESHOLD) & (b >= a * THRESHOLD)


def _alike_sketches(longs: int = 2) -> Column:
    return _near(F.col("a.runs"), F.col("b.runs")) & (S.sketch_distance("a", "b", longs) <= S.sketch_limit(THRESHOLD, longs=longs))


def described(df: DataFrame, keys: list[str], path: str, digest: str, text: str) -> DataFrame:
    """(keys, path, hash, text, cls, runs, sig, s*, row) of every row; rows that resemble nothing have no class. To be written at once: ``row`` numbers them."""
    base = df.select(*keys, clean_path(path).alias("path"), clean_hash(digest).alias("hash"), F.col(text).alias("text"))
    return S.sketch(base, [*keys, "path", "hash", "text"], "text", all_rows=True).withColumn("row", F.monotonically_increasing_id())


@dataclass
class Run:
    number: int
    #: Smallest key of each range.
    lows: list[int]


@dataclass
class History:
    """Persisted runs of everything accepted so far; ``runs`` is what the newest manifest lists."""

    spark: SparkSession
    folder: str
    runs: list[Run] = field(default_factory=list)
    written: int = 0
    version: int = 0
    #: Rows of a key range, and ranges of classes and hashes.
    zone_rows: int = 100_000
    ranges: int = 16

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> History:
        """The history that earlier sessions left in ``folder``."""
        newest = max((n for n in list_folder(spark, folder) if n.startswith("manifest-")), key=lambda n: int(n[9:-5]))
        held = json.loads(load_text(spark, f"{folder}/{newest}"))
        return cls(spark, folder, [Run(**r) for r in held.pop("runs")], **held)

    def _commit(self, runs: list[Run]) -> None:
        self.runs, self.version = runs, self.version + 1
        held = {"runs": [asdict(r) for r in runs], "written": self.written, "version": self.version, "zone_rows": self.zone_rows, "ranges": self.ranges}
        save_text(self.spark, f"{self.folder}/manifest-{self.version}.json", json.dumps(held))

    def _paths(self, kind: str, runs: list[Run]) -> DataFrame:
        schema = _KEY_RUN if kind == "keys" else _CLASS_RUN
        if not runs:
            return self.spark.createDataFrame([], schema)
        base = f"{self.folder}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/run={r.number}" for r in runs])

    def keys(self) -> DataFrame:
        return self._paths("keys", self.runs)

    def rows(self, kind: str, touched: list[int] | None = None) -> DataFrame:
        """Rows of ``class`` or ``hash``, of the touched ranges."""
        out = self._paths("rows", self.runs).where(F.col("kind") == kind)
        return out if touched is None else out.where(F.col("range").isin(touched))

    def range_of(self, col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.ranges)).cast("int")

    def touched(self, keys: DataFrame, col: str, n: int) -> list[int] | None:
        """The ranges that ``n`` keys fall into; None (all) where there are many keys for each range."""
        if n > 8 * self.ranges:
            return None
        return [r[0] for r in keys.select(self.range_of(col)).distinct().collect()]

    def _write(self, classes: DataFrame, hashes: DataFrame, keyed: DataFrame) -> Run:
        """A run of classes (cls, low, high, loose, s*, text), hashes (hash) and key rows (key, cls, runs, s0, s1)."""
        number = self.written
        self.written += 1
        both = classes.withColumn("kind", F.lit("class")).withColumn("range", self.range_of("cls")).unionByName(
            hashes.withColumn("kind", F.lit("hash")).withColumn("range", self.range_of("hash")), allowMissingColumns=True
        )
        seen = Observation()
        both = both.observe(seen, F.count("cls").alias("classes")).repartition("kind", "range")
        both.write.option("compression", "zstd").partitionBy("kind", "range").parquet(f"{self.folder}/rows/run={number}")
        zones = max(1, -(-seen.get["classes"] * KEYS // self.zone_rows))
        row = F.monotonically_increasing_id()
        placed = keyed.repartitionByRange(zones, "key", "cls").sortWithinPartitions("key", "cls")
        placed = placed.select(*keyed.columns, F.spark_partition_id().alias("zone"), row.alias("row"))
        placed = placed.select(*keyed.columns, F.shiftrightunsigned("row", 4).alias("block"), "zone", (F.col("row") % BLOCK == 0).alias("fence"))
        path = f"{self.folder}/keys/run={number}"
        placed.write.option("compression", "zstd").partitionBy("zone", "fence").parquet(path)
        lows = [-(1 << 63)]
        if zones > 1:
            fences = self.spark.read.schema(_KEY_RUN.replace(", run int", "")).parquet(path).where("fence")
            found = dict(fences.groupBy("zone").agg(F.min("key")).collect())
            for z in range(1, zones):
                lows.append(found.get(z, lows[-1]))
        return Run(number, lows)

    def append(self, rows: DataFrame, bounded: bool = False) -> None:
        """Add a run of described rows, of a slice if ``bounded``. Of each class one row stays; only the list of these rows is shuffled."""
        paths = F.when(F.col("path").isNotNull(), F.col("path"))
        chosen = rows.where("cls is not null").groupBy("cls").agg(
            F.min("row").alias("row"), F.min(paths).alias("low"), F.max(paths).alias("high"), F.max(F.col("path").isNull()).alias("loose")
        )
        chosen = chosen.drop("cls")
        if bounded:
            held = rows.drop("path").join(F.broadcast(chosen), "row")
        else:
            held = join_sized(rows.drop("path"), materialize(chosen, f"{self.folder}/chosen{self.version}"), "row")
        hashes = rows.where("hash is not null").select("hash").distinct()
        classes = held.select("cls", "low", "high", "loose", *_LONGS, "text")
        self._commit([*self.runs, self._write(classes, hashes, key_rows(held, "cls", "runs", *_HALF))])
        if len(self.runs) > COMPACT_EVERY:
            self.compact()

    def compact(self) -> None:
        """Merge all runs but the first into one."""
        first, *rest = self.runs
        if len(rest) > 1:
            held = self._paths("rows", rest)
            same = [F.first(c).alias(c) for c in (*_LONGS, "text")]
            classes = held.where("kind = 'class'").groupBy("cls").agg(
                F.min("low").alias("low"), F.max("high").alias("high"), F.max("loose").alias("loose"), *same
            )
            hashes = held.where("kind = 'hash'").select("hash").distinct()
            keyed = self._paths("keys", rest).select("cls", "runs", *_HALF, "key").distinct()
            self._commit([first, self._write(classes, hashes, keyed)])

    def place(self, keyed: DataFrame) -> DataFrame:
        """(run, block, wide, *columns) for keyed rows and every run: where a key stands in the sorted run.

        ``wide``: rows beyond the window may share three MinHash values with the key.
        """
        runs = F.array(*[F.struct(F.lit(r.number).alias("run"), F.array(*[F.lit(x) for x in r.lows]).alias("lows")) for r in self.runs])
        spread = keyed.select("*", F.explode(runs).alias("r"))
        spread = spread.withColumn("zone", F.greatest(F.lit(0), F.size(F.filter("r.lows", lambda x: x <= F.col("key"))) - 1))
        at = _prefix("key")
        crosses = ((F.col("zone") > 0) & (_prefix(F.expr("get(r.lows, zone)")) == at)) | F.coalesce(_prefix(F.expr("get(r.lows, zone + 1)")) == at, F.lit(False))
        probes = spread.select(*keyed.columns, F.col("r.run").alias("run"), "zone", crosses.alias("crosses"), F.lit(True).alias("probe"))
        fences = self.keys().where("fence").select("run", "zone", "key", "block", F.col("key").alias("edge"), F.lit(False).alias("probe"))
        both = probes.unionByName(fences, allowMissingColumns=True)
        w = "over (partition by run, zone order by key, probe"
        both = both.select(
            *keyed.columns, "run", "probe", "crosses",
            F.expr(f"coalesce(last(block) ignore nulls {w} rows between unbounded preceding and current row), lead(block) ignore nulls {w}))").alias("block"),
            F.expr(f"lag(edge, 2) ignore nulls {w})").alias("below"),
            F.expr(f"lead(edge, 2) ignore nulls {w})").alias("above"),
        )
        wide = F.col("crosses") | F.coalesce(_prefix("below") == at, F.lit(False)) | F.coalesce(_prefix("above") == at, F.lit(False))
        return both.where("probe").select(*keyed.columns, "run", "block", wide.alias("wide"))

    def zones(self, keyed: DataFrame, n: int) -> Column:
        """A condition on key rows: the ranges that ``n`` keys may have in their windows."""
        if n > 4 * sum(len(r.lows) for r in self.runs):
            return F.lit(True)
        runs = F.array(*[F.struct(F.lit(r.number).alias("run"), F.array(*[F.lit(x) for x in r.lows]).alias("lows")) for r in self.runs])
        below = F.size(F.filter("r.lows", lambda x: _prefix(x) < _prefix("key"))) - 1
        upto = F.size(F.filter("r.lows", lambda x: x <= F.col("key"))) - 1
        spread = keyed.select("key", F.explode(runs).alias("r")).select("r.run", F.explode(F.sequence(F.greatest(F.lit(0), below), F.greatest(F.lit(0), upto))).alias("zone"))
        hit: dict[int, list[int]] = {}
        for r in spread.distinct().collect():
            hit.setdefault(r.run, []).append(r.zone)
        out = F.lit(False)
        for run, zones in hit.items():
            out = out | ((F.col("run") == run) & F.col("zone").isin(zones))
        return out


def _exact(pairs: DataFrame, n: int, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """The ``n`` pairs (x, y, old, s*) whose texts reach the threshold, with low, high, loose of y; ys: (cls, old, text, s*, low, high, loose).

    ``s*`` is the sketch of x: whole sketches are compared where y's rows are, before any text moves.
    """
    pairs = pairs.select("x", "y", "old", *[F.col(s).alias(f"{s}_x") for s in _LONGS])
    pairs = F.broadcast(pairs) if n <= BROADCAST_ROWS else pairs
    met = ys.select(F.col("cls").alias("y"), "old", F.col("text").alias("text_y"), *[F.col(s).alias(f"{s}_y") for s in _LONGS], "low", "high", "loose")
    met = met.join(pairs, ["y", "old"]).where(S.sketch_distance(None, None, S.SKETCH_LONGS, ("_x", "_y")) <= S.sketch_limit(THRESHOLD))
    both = met.select("x", "y", "old", "text_y", "low", "high", "loose").join(xs.select(F.col("cls").alias("x"), F.col("text").alias("text_x")), "x")
    return both.where(S.similarity_udf("text_x", "text_y") >= THRESHOLD).select("x", "y", "old", "low", "high", "loose")


def _counted(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    out = materialize(df.observe(seen, *[F.count(F.when(c, 1)).alias(n) for n, c in metrics.items()]), path)
    return out, seen.get


def _greedy(group: pa.Table) -> pa.Table:
    """(item_id, case) of one slice's items (item_id, cls, path, hash, old, near), in the order of ids."""
    kept: dict[bytes, set] = {}
    hashes, case = set(), {}
    for r in sorted(group.to_pylist(), key=lambda r: r["item_id"]):
        mine = r["path"]
        found = r["old"] or (r["hash"] is not None and r["hash"] in hashes)
        if not found and r["cls"] is not None:
            found = any(mine is None or p is None or p != mine for y in (r["cls"], *(r["near"] or ())) for p in kept.get(y, ()))
        case[r["item_id"]] = found
        if not found:
            hashes.add(r["hash"])
            paths = kept.setdefault(r["cls"], set())
            if len(paths) < 2 or None not in paths:  # two paths, or none, show another one to any path
                paths.add(mine)
    return pa.table({"item_id": pa.array(case.keys(), pa.int64()), "case": pa.array(case.values(), pa.bool_())})


def _settle(items: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(item_id, case) of open items (item_id, cls, path, hash), in the order of ids; links are (x, y) of classes, both ways and to themselves."""
    own = F.coalesce("path", F.concat(F.lit("\0"), F.col("item_id").cast("string")))
    state = items.select("item_id", "cls", own.alias("path"), "hash", F.lit("open").alias("status"))
    live, kept = F.when(F.col("status") != "case", F.col("item_id")), F.when(F.col("status") == "kept", F.col("item_id"))
    k = 0
    while True:
        by_path = state.where("cls is not null and status <> 'case'").groupBy("cls", "path").agg(F.min(live).alias("live"), F.min(kept).alias("kept"))
        seen = links.join(by_path, links.y == by_path.cls).groupBy("x", "path").agg(F.min("live").alias("live"), F.min("kept").alias("kept"))
        first = seen.groupBy("x").agg(
            F.min(F.struct("live", "path")).alias("live1"), F.min(F.when(F.col("kept").isNotNull(), F.struct("kept", "path"))).alias("kept1")
        )
        second = (
            seen.join(first, "x")
            .groupBy("x")
            .agg(
                F.first("live1").alias("live1"),
                F.first("kept1").alias("kept1"),
                F.min(F.when(F.col("path") != F.col("live1.path"), F.col("live"))).alias("live2"),
                F.min(F.when(F.col("path") != F.col("kept1.path"), F.col("kept"))).alias("kept2"),
            )
        )
        by_hash = state.where("hash is not null and status <> 'case'").groupBy("hash").agg(F.min(live).alias("h_live"), F.min(kept).alias("h_kept"))
        near = state.join(second.withColumnRenamed("x", "cls"), "cls", "left").join(by_hash, "hash", "left")
        near_live = F.when(F.col("live1.path") != F.col("path"), F.col("live1.live")).otherwise(F.col("live2"))
        near_kept = F.when(F.col("kept1.path") != F.col("path"), F.col("kept1.kept")).otherwise(F.col("kept2"))
        me = F.col("item_id")
        status = (
            F.when(F.col("status") != "open", F.col("status"))
            .when(F.coalesce(near_kept < me, F.lit(False)) | F.coalesce(F.col("h_kept") < me, F.lit(False)), "case")
            .when(F.coalesce(near_live >= me, F.lit(True)) & F.coalesce(F.col("h_live") >= me, F.lit(True)), "kept")
            .otherwise("open")
        )
        state, left = _counted(near.select("item_id", "cls", "path", "hash", status.alias("status")), f"{folder}/settle{k}", open=F.col("status") == "open")
        if not left["open"]:
            return state.select("item_id", (F.col("status") == "case").alias("case"))
        k += 1


def _in_batch(keyed: DataFrame) -> DataFrame:
    """(x, y, s* of x) of classes of a slice that meet: in windows of the sorted keys, or under equal MinHash triples."""
    order = Window.partitionBy(F.shiftright("key", 58)).orderBy("key", "cls").rowsBetween(-BLOCK // 2, -1)
    record = F.struct("cls", "runs", *_LONGS)
    beside = keyed.withColumn("b", F.collect_list(record).over(order)).select(record.alias("a"), F.explode("b").alias("b"))
    by_place = beside.where(_alike_sketches(4) & (F.col("a.cls") != F.col("b.cls")))
    a, b = keyed.withColumn("key", _prefix("key")).alias("a"), keyed.withColumn("key", _prefix("key")).alias("b")
    by_key = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & _alike_sketches(4))
    first = F.col("a.cls") < F.col("b.cls")
    longs = [F.when(first, F.col(f"a.{s}")).otherwise(F.col(f"b.{s}")).alias(s) for s in _LONGS]
    x, y = F.least("a.cls", "b.cls").alias("x"), F.greatest("a.cls", "b.cls").alias("y")
    return by_place.select(x, y, *longs).unionByName(by_key.select(x, y, *longs))


def check(history: History, items: DataFrame, classes: int | None = None, greedy_links: int = GREEDY_LINKS) -> DataFrame:
    """(item_id, case) of a slice of ``arrivals`` with ``classes`` classes, in the order of ids; accepted items are added to the history.

    Up to ``greedy_links`` links between the classes of a slice its items are settled one after the other in one
    task (a slice is bounded), beyond that in rounds; the result is the same.
    """
    folder = f"{history.folder}/check{history.version}"
    xs = items.where("lead").select("row", "cls", "runs", "sig", *_LONGS, "text")
    n = xs.count() if classes is None else classes
    x, y, longs = F.col("a.cls").alias("x"), F.col("b.cls").alias("y"), [F.col(f"a.{s}") for s in _LONGS]
    met = _in_batch(key_rows(xs, "cls", "runs", *_LONGS)).withColumn("old", F.lit(False))
    wide = 0
    if history.runs and n:
        keyed = key_rows(xs, "row")
        rows = history.keys().where(history.zones(keyed.select("key"), n * KEYS))
        placed, count = _counted(history.place(keyed).drop("key"), f"{folder}/placed", wide=F.col("wide"))
        wide = count["wide"]
        blocks = rows.select("cls", "runs", *_HALF, "run", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])).alias("block")).alias("b")
        around = placed.select("row", "run", "block").join(F.broadcast(xs.select("row", "cls", "runs", *_LONGS)), "row")  # rows of one slice
        around = (F.broadcast(around) if n * KEYS * len(history.runs) <= PLACED_ROWS else around).alias("a")
        seen = blocks.join(around, (F.col("a.run") == F.col("b.run")) & (F.col("a.block") == F.col("b.block")) & _alike_sketches())
        met = met.unionByName(seen.select(x, y, *longs).withColumn("old", F.lit(True)))

    def linked(pairs: DataFrame, name: str) -> tuple[DataFrame, dict]:
        pairs, got = _counted(pairs.distinct(), f"{folder}/{name}", n=F.lit(True), old=F.col("old"))
        held = history.rows("class", history.touched(pairs.where("old"), "y", got["old"])).select("cls", F.lit(True).alias("old"), "text", *_LONGS, "low", "high", "loose")
        none = F.lit(None).cast("string")
        own = xs.select("cls", F.lit(False).alias("old"), "text", *_LONGS, none.alias("low"), none.alias("high"), F.lit(None).cast("boolean").alias("loose"))
        return _counted(_exact(pairs, got["n"], xs, held.unionByName(own)), f"{folder}/{name}_links", new=~F.col("old"))

    links, got = linked(met, "met")
    if wide:  # hot keys: the rest of the rows beyond the window, for classes that the window doesn't show to be cases
        shown = links.where("old").groupBy("x").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("loose").alias("loose"))
        shown = shown.where("loose or low <> high").select(F.col("x").alias("cls"))
        asking = key_rows(xs.join(placed.where("wide").select("row").distinct(), "row").join(shown, "cls", "left_anti"), "cls", "runs", *_LONGS)
        asking = asking.withColumn("key", _prefix("key"))
        asking = (F.broadcast(asking) if n * KEYS <= PLACED_ROWS else asking).alias("a")
        rest = rows.select("cls", "runs", *_HALF, _prefix("key").alias("key")).alias("b").join(asking, (F.col("a.key") == F.col("b.key")) & _alike_sketches())
        more, _ = linked(rest.select(x, y, *longs).withColumn("old", F.lit(True)), "rest")
        links = links.unionByName(more)

    base = items.select("item_id", "cls", "path", "hash")
    shown = links.where("old").groupBy(F.col("x").alias("cls")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("loose").alias("loose"))
    other = F.col("loose") | F.col("path").isNull() | (F.col("low") != F.col("path")) | (F.col("high") != F.col("path"))
    asked = items.where("hash is not null").select("hash")  # of one slice: a bounded number
    known = history.rows("hash").select("hash").join(F.broadcast(asked), "hash", "left_semi").distinct().withColumn("known", F.lit(True))
    old = F.col("known").isNotNull() | F.coalesce(F.col("loose").isNotNull() & other, F.lit(False))
    state = base.join(shown, "cls", "left").join(known, "hash", "left").select(*base.columns, old.alias("old"))
    new = links.where("not old").select("x", "y")
    both = new.unionByName(new.select(F.col("y").alias("x"), F.col("x").alias("y")))
    if got["new"] <= greedy_links:
        near = both.groupBy(F.col("x").alias("cls")).agg(F.collect_list("y").alias("near"))
        out = state.join(near, "cls", "left").withColumn("slice", F.lit(0)).groupBy("slice").applyInArrow(_greedy, "item_id bigint, case boolean")
    else:
        state = materialize(state, f"{folder}/state")
        still = state.where("not old").select(*base.columns)
        own = still.where("cls is not null").select(F.col("cls").alias("x"), F.col("cls").alias("y")).distinct()
        out = _settle(still, both.unionByName(own), folder).unionByName(state.where("old").select("item_id", F.lit(True).alias("case")))
    out = materialize(out, f"{history.folder}/results/check={history.version}")
    history.append(items.join(F.broadcast(out.where("not case").select("item_id")), "item_id"), bounded=True)
    release(history.spark)
    return out


def base_history(entries: DataFrame, folder: str) -> History:
    """The history of a catalog: its entries without parent."""
    tops = entries.where(clean_id("parent_id").isNull() & clean_id("id").isNotNull())
    rows = materialize(described(tops, [], "source_path", "content_hash", "preview"), f"{folder}/entries")
    n = rows.count()
    history = History(entries.sparkSession, folder, zone_rows=max(100_000, n * KEYS // 2_000), ranges=max(4, n // 50_000))
    history.append(rows)
    return history


def arrivals(batches: DataFrame, slice_rows: int = SLICE) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Described items with their batch, slice and ``lead`` (one item of each class of a slice); the slices in order with their classes."""
    items = batches.where("item_id is not null").withColumn("batch", F.coalesce("batch_no", F.lit(-(1 << 31))))
    first = items.groupBy("item_id").agg(F.min("batch").alias("batch"))
    part = F.lit(0)
    for batch, n in first.groupBy("batch").count().where(F.col("count") > slice_rows).collect():
        parts = -(-n // slice_rows)
        for cut in first.where(F.col("batch") == batch).approxQuantile("item_id", [i / parts for i in range(1, parts)], 0.001):
            part = part + F.when((F.col("batch") == batch) & (F.col("item_id") > int(cut)), 1).otherwise(0)
    folder = scratch_dir(batches.sparkSession)
    rows = materialize(described(items, ["item_id", "batch"], "source_path", "content_hash", "preview"), f"{folder}/described")
    # which row stands for an item, and which item for a class, is found on narrow rows
    narrow = rows.groupBy("item_id").agg(F.min(F.struct("batch", "row", "cls")).alias("m")).select("item_id", "m.*").withColumn("slice", part)
    same = Window.partitionBy("batch", "slice", "cls")
    narrow = narrow.withColumn("lead", F.col("cls").isNotNull() & (F.min("item_id").over(same) == F.col("item_id")))
    narrow = materialize(narrow.select("row", "slice", "lead"), f"{folder}/narrow")
    rows = join_sized(rows, narrow, "row")
    rows = materialize(rows.repartition("batch", "slice"), f"{folder}/items", ["batch", "slice"])  # a file for each slice
    sizes = rows.groupBy("batch", "slice").agg(F.count(F.when(F.col("lead"), 1)).alias("classes"))
    return rows, sorted((r.batch, r.slice, r.classes) for r in sizes.collect())


def check_batches(entries: DataFrame, batches: DataFrame, slice_rows: int = SLICE, greedy_links: int = GREEDY_LINKS) -> DataFrame:
    """(item_id, case, path, batch) of every item of ``batches``, checked batch by batch in the order (batch_no, item_id)."""
    spark = entries.sparkSession
    folder = scratch_dir(spark)
    history = base_history(entries, folder)
    items, slices = arrivals(batches, slice_rows)
    for batch, part, classes in slices:
        check(history, items.where((F.col("batch") == batch) & (F.col("slice") == part)), classes, greedy_links)
    if not slices:
        return spark.createDataFrame([], "item_id bigint, case boolean, path string, batch int")
    results = spark.read.schema("item_id bigint, case boolean").option("recursiveFileLookup", "true").parquet(f"{folder}/results")
    return items.select("item_id", "path", "batch").join(results, "item_id").select("item_id", "case", "path", "batch")


def verdicts(entries: DataFrame, batches: DataFrame) -> DataFrame:
    """(item_id, is_case, version): accepted items get the version after the last one known for their path."""
    out = check_batches(entries, batches)
    tops = entries.where(clean_id("parent_id").isNull()).select(clean_path("source_path").alias("path"), "version")
    last = tops.where("path is not null").groupBy("path").agg(F.max("version").alias("last"))
    kept = out.where("not case").withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("batch", "item_id")))
    kept = kept.join(last, "path", "left").withColumn(
        "version", F.when(F.col("path").isNull(), 1).otherwise(F.coalesce("last", F.lit(0)) + F.col("nth"))
    )
    return out.join(kept.select("item_id", "version"), "item_id", "left").select("item_id", F.col("case").alias("is_case"), "version")
