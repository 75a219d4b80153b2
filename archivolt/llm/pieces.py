"""Splitting oversized items at natural boundaries, by ranges with halos.

An item is read in ranges of ``step`` characters. The worker of range r sees
the range, a left halo of ``overlap`` and a right halo of ``size`` characters,
finds the boundaries in its window, and settles two anchors: the best boundary
in the first ``size - overlap`` characters of its range and of the next one.
Both depend only on characters that both neighbours see, so the boundary tables
of adjacent ranges fit without communication. Between its anchors a worker cuts
greedily at the best boundary that keeps a piece within ``size``; a piece begins
up to ``overlap`` characters before the cut in front of it. The tables are then
stitched: piece numbers are prefix sums of the ranges' piece counts, offsets are
absolute, and text is emitted from the window that holds the piece. No task
holds a whole item, and an item of any length is spread over many tasks.

Boundaries, best first: the end of a paragraph, of a line, of a sentence, white
space, any place not between two ASCII letters or digits, anywhere.

Defined results: null texts and texts within ``size`` have no pieces; rows of
one id are one item; an item without id is dropped; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.ids import clean_id
from archivolt.session import materialize, scratch_dir, semi_join_sized

SIZE, OVERLAP, STEP = 1200, 200, 65_536
_STOPS = np.array([ord(c) for c in ".!?;。！？；"], np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _space(codes: np.ndarray) -> np.ndarray:
    known = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
    return np.isin(codes, known)


def _ascii_word(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))


def boundary_ranks(codes: np.ndarray) -> np.ndarray:
    """Rank of a cut before each position: 5 paragraph, 4 line, 3 sentence, 2 white space, 1 no ASCII word broken, 0."""
    n = len(codes)
    rank = np.zeros(n + 1, np.int8)
    if n < 2:
        return rank
    before, after = codes[:-1], codes[1:]
    word = _ascii_word(codes)
    space = _space(codes)
    own = rank[1:n]
    own[~(word[:-1] & word[1:])] = 1
    own[space[:-1] & ~space[1:]] = 2
    stop = np.isin(before, _STOPS)
    own[stop & ((before > 127) | space[1:])] = 3
    own[2:][np.isin(codes[1:-2], _STOPS[:4]) & space[2:-1] & ~space[3:]] = 3
    own[before == 10] = 4
    own[1:][(codes[:-2] == 10) & (before[1:] == 10) & (after[1:] != 10)] = 5
    return rank


def _best(rank: np.ndarray, lo: int, hi: int) -> int:
    """The last place of the highest rank in (lo, hi]; at least 1 past ``lo``."""
    part = rank[lo + 1 : hi + 1]
    return lo + 1 + len(part) - 1 - int(np.argmax(part[::-1]))


def _anchor(rank: np.ndarray, at: int, size: int, overlap: int) -> int:
    """The cut that the range starting at ``at`` settles."""
    return _best(rank, at, min(len(rank) - 1, at + size - overlap - 1))


def cut_window(text: str, first: int, start: int, step: int, total: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Absolute (begin, end) of the pieces of the range at ``start``; ``text`` is the window from ``first`` on."""
    codes = _codes(text)
    rank = boundary_ranks(codes)
    if first + len(codes) >= total:
        rank = rank.copy()
        rank[-1] = 5
    cut = 0 if start == 0 else _anchor(rank, start - first, size, overlap)
    nxt = start + step
    end = total - first if nxt >= total else _anchor(rank, nxt - first, size, overlap)
    out = []
    while cut < end:
        begin = cut
        if first + cut > 0:  # step back to a boundary within the overlap
            low = max(cut - overlap, 0)
            words = np.flatnonzero(rank[low:cut] >= 1)
            strong = np.flatnonzero(rank[low:cut] >= 2)
            begin = low + int((strong if len(strong) else words if len(words) else np.array([0]))[0])
        if begin + size >= end:
            to = end
        else:  # what is left stays longer than the overlap, so that pieces keep advancing
            to = _best(rank, max(cut, begin + size // 2), min(begin + size, end - overlap - 1))
        out.append((first + begin, first + to))
        cut = to
    return out


def _check(size: int, overlap: int, step: int) -> None:
    if not 0 < overlap < size // 2 - 1 or step < 2 * size:
        raise ValueError("0 < overlap < size / 2 - 1 and step >= 2 * size are needed")


def split(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP, step: int = STEP, unique: bool = False) -> DataFrame:
    """(parent_id, chunk_no, start, stop, preview) of every text longer than ``size``.

    ``unique``: ids don't repeat, so nothing has to be looked up. Texts are cut
    where they lie; what travels are windows of at most step + size + overlap
    characters, spread by item and range.
    """
    _check(size, overlap, step)
    items = df.select(F.col(id_col).alias("parent_id"), F.col(text_col).alias("text")).where("parent_id is not null")
    items = items.withColumn("total", F.length("text")).where(F.col("total") > size)
    if not unique:
        numbered = items.withColumn("row", F.monotonically_increasing_id())
        items = materialize(numbered, f"{scratch_dir(df.sparkSession)}/items")
        first = items.groupBy("parent_id").agg(F.min("row").alias("row")).select("row")
        items = semi_join_sized(items, first, "row")
    ranges = items.select("parent_id", "total", "text", F.explode(F.expr(f"sequence(0, CAST((total - 1) / {step} AS INT))")).alias("part"))
    first = F.greatest(F.lit(0), F.col("part") * step - overlap)
    width = F.col("part") * step + step + size - first
    windows = ranges.select("parent_id", "total", "part", first.alias("first"), F.expr("text").substr(first + 1, width).alias("window"))
    return _emit(windows.repartition("parent_id", "part"), size, overlap, step)


def _emit(windows: DataFrame, size: int, overlap: int, step: int) -> DataFrame:
    """Pieces from (parent_id, total, part, first, window), numbered by prefix sums over each item's ranges."""
    key = windows.schema["parent_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, total, part, first, text in b.itertuples(index=False):
                for no, (lo, hi) in enumerate(cut_window(text, first, part * step, step, total, size, overlap)):
                    rows.append((pid, part, no, lo, hi, text[lo - first : hi - first]))
            yield pd.DataFrame(rows, columns=["parent_id", "part", "no", "start", "stop", "preview"])

    found = windows.mapInPandas(work, f"parent_id {key}, part bigint, no bigint, start bigint, stop bigint, preview string")
    found = materialize(found, f"{scratch_dir(windows.sparkSession)}/pieces")
    counts = found.groupBy("parent_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("parent_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("parent_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(offset, ["parent_id", "part"]).select(
        "parent_id", (F.col("before") + F.col("no")).cast("int").alias("chunk_no"), "start", "stop", "preview"
    )


def split_files(df: DataFrame, path_col: str, size: int = SIZE, overlap: int = OVERLAP, step: int = 1 << 20) -> DataFrame:
    """Pieces of UTF-8 files on any file system that Arrow knows (local, HDFS, S3, GCS), read by byte ranges; offsets and limits count bytes.

    A range's worker reads its bytes and halos only. Cuts never fall inside a
    character. Missing files have no pieces. Paths without a scheme are local.
    """
    _check(size, overlap, step)
    paths = df.select(F.col(path_col).alias("parent_id")).where("parent_id is not null").distinct()

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["parent_id"]:
                info = _opened(p)[0].get_file_info(_opened(p)[1])
                if info.is_file:
                    rows.append((p, info.size))
            yield pd.DataFrame(rows, columns=["parent_id", "total"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, total, part in b.itertuples(index=False):
                first = max(0, part * step - overlap)
                files, at = _opened(path)
                with files.open_input_file(at) as f:
                    f.seek(first)
                    data = f.read(part * step + step + size - first)
                # bytes as characters: halves of a character get the lowest rank
                cuts = cut_window(data.decode("latin-1"), first, part * step, step, total, size, overlap)
                for no, (lo, hi) in enumerate(cuts):
                    lo, hi = _whole(data, lo - first), _whole(data, hi - first)
                    rows.append((path, part, no, first + lo, first + hi, data[lo:hi].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["parent_id", "part", "no", "start", "stop", "preview"])

    found = paths.mapInPandas(sizes, "parent_id string, total bigint").where(F.col("total") > size)
    parts = found.select("parent_id", "total", F.explode(F.expr(f"sequence(0L, CAST((total - 1) DIV {step} AS BIGINT))")).alias("part"))
    spread = parts.repartition("parent_id", "part")
    pieces = spread.mapInPandas(work, "parent_id string, part bigint, no bigint, start bigint, stop bigint, preview string")
    pieces = materialize(pieces, f"{scratch_dir(df.sparkSession)}/pieces")
    counts = pieces.groupBy("parent_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("parent_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("parent_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pieces.join(offset, ["parent_id", "part"]).select(
        "parent_id", (F.col("before") + F.col("no")).cast("int").alias("chunk_no"), "start", "stop", "preview"
    )


def _opened(path: str) -> tuple[pa_fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pa_fs.LocalFileSystem(), path
    return pa_fs.FileSystem.from_uri(path)


def _whole(data: bytes, at: int) -> int:
    """The start of the character that the byte at ``at`` belongs to."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


# --- pieces that exist already ---------------------------------------------


def valid_pieces(text: str, pieces: list[str], size: int = SIZE, overlap: int = OVERLAP) -> bool:
    """Whether ``pieces``, in order, cover ``text`` as verbatim stretches that overlap by 1 to ``overlap`` characters."""

    def broken(end: int, piece: str) -> bool:
        pair = text[end - 1 : end + 1]
        return len(pair) == 2 and pair.isascii() and pair.isalnum() and any(c.isspace() for c in piece[-200:])

    starts = {0}
    for i, piece in enumerate(pieces):
        if not piece or len(piece) > size:
            return False
        starts = {s for s in starts if text.startswith(piece, s)}
        ends = {s + len(piece): s for s in starts}
        if i == len(pieces) - 1:
            return len(text) in ends
        starts = {p for e, s in ends.items() if not broken(e, piece) for p in range(max(s + 1, e - overlap), e)}
    return False


def unsplit(entries: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, preview) of the oversized entries without parent whose pieces in ``entries`` are missing or wrong.

    Counts come first: pieces are gathered only where their numbers run from 0
    without gap and there are no more of them than characters, so no group is
    larger than its parent's text.
    """
    e = entries.select(clean_id("id").alias("id"), clean_id("parent_id").alias("parent_id"), "chunk_no", "preview")
    tops = e.where((F.length("preview") > size) & F.col("parent_id").isNull() & F.col("id").isNotNull())
    tops = tops.select("id", "preview").dropDuplicates(["id"])
    large = materialize(tops, f"{scratch_dir(entries.sparkSession)}/large")
    held = e.where("parent_id is not null and id is not null").select("parent_id", "id", "chunk_no", "preview")
    mine = held.join(large.select(F.col("id").alias("parent_id"), F.length("preview").alias("most")), "parent_id")
    mine = mine.dropDuplicates(["parent_id", "id"])
    counted = mine.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("chunk_no").alias("lo"),
        F.max("chunk_no").alias("hi"),
        F.count(F.when(F.length("preview").between(1, size), 1)).alias("sized"),
        F.max("most").alias("most"),
    )
    whole = counted.where("lo = 0 and hi = n - 1 and sized = n and n <= most").select("parent_id")
    gathered = mine.join(whole, "parent_id").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "preview"))).alias("p"))
    numbered = gathered.where("forall(p, x -> x.chunk_no is not null) and size(array_distinct(p.chunk_no)) = size(p)")
    checked = numbered.select(F.col("parent_id").alias("id"), F.col("p.preview").alias("pieces")).join(large, "id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [valid_pieces(t, list(p), size, overlap) for t, p in zip(b["preview"], b["pieces"], strict=True)]
            yield b.loc[good, ["id"]]

    kind = large.schema["id"].dataType.simpleString()
    valid = checked.select("id", "preview", "pieces").mapInPandas(work, f"id {kind}")
    return large.join(valid, "id", "left_anti")


def resplit(entries: DataFrame, size: int = SIZE, overlap: int = OVERLAP, step: int = STEP) -> DataFrame:
    """New pieces of every oversized entry without parent that lacks valid ones."""
    return split(unsplit(entries, size, overlap), "id", "preview", size, overlap, step, unique=True)


def faults(pieces: DataFrame, texts: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(parent_id, total, first, last, faults): where an item's pieces begin and end, and how many break a rule of problem 2.

    The rules are stated on the pieces and the text itself, independent of how they were cut.
    """
    order = Window.partitionBy("parent_id").orderBy("chunk_no")
    p = pieces.withColumn("no", F.row_number().over(order) - 1).withColumn("s0", F.lag("start").over(order)).withColumn("e0", F.lag("stop").over(order))
    p = p.withColumn("next", F.lead("start").over(order))
    t = texts.select(F.col(id_col).alias("parent_id"), F.col(text_col).alias("text"), F.length(text_col).alias("total")).where(F.col("total") > size).dropDuplicates(["parent_id"])
    j = p.join(t, "parent_id")
    own = F.expr("substring(text, CAST(start AS INT) + 1, CAST(stop - start AS INT))")
    word = F.expr("substring(text, CAST(stop AS INT), 2)").rlike("^[A-Za-z0-9]{2}$") & F.expr("right(preview, 200)").rlike(r"\s") & F.col("next").isNotNull()
    bad = (F.col("no") != F.col("chunk_no")) | (own != F.col("preview")) | ~F.length("preview").between(1, size) | word
    bad = bad | F.coalesce((F.col("start") <= F.col("s0")) | ~(F.col("e0") - F.col("start")).between(1, overlap), F.lit(False))
    return j.groupBy("parent_id", "total").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.count(F.when(bad, 1)).alias("faults"))
