"""Character runs of texts, their MinHash signatures and the exact similarity of two texts.

A text is folded (lower case, letters and digits only) and seen as the set of
its distinct runs of ``RUN`` characters. Texts of fewer than ``MIN_CHARS``
folded characters, and null, resemble nothing and get no signature.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RUN = 5
MIN_CHARS = 200
#: Signature length; two bits of every coordinate are packed into SKETCH_LONGS longs.
COORDS = 128
SKETCH_LONGS = 4
#: Runs hashed at once: the arrays of a block stay in the processor's cache.
_BLOCK = 1 << 17

_DROP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    return _DROP.sub("", text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def run_hashes(folded: str) -> np.ndarray:
    """64-bit hashes of all runs, in order, with repeats."""
    a = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(a) - RUN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = a[:n].astype(np.uint64)
    for k in range(1, RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : k + n]
    return _mix(h)


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(0, 2**32, COORDS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, COORDS, dtype=np.uint32)


def signatures(hashes: list[np.ndarray]) -> np.ndarray:
    """MinHash values (uint32, one row per non-empty hash array)."""
    mult, add = _family()
    out = np.empty((len(hashes), COORDS), np.uint32)
    i = 0
    while i < len(hashes):
        j, total = i, 0
        while j < len(hashes) and (j == i or total + len(hashes[j]) <= _BLOCK):
            total += len(hashes[j])
            j += 1
        x = (np.concatenate(hashes[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(h) for h in hashes[i : j - 1]], dtype=np.int64)))
        for c in range(COORDS):
            out[i:j, c] = np.minimum.reduceat(x * mult[c] + add[c], starts)
        i = j
    return out


def _pack(sig: np.ndarray) -> np.ndarray:
    """Two mixed bits of every coordinate in SKETCH_LONGS signed longs per row."""
    bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64).reshape(len(sig), SKETCH_LONGS, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


SKETCH_SCHEMA = "cls binary, runs int, sig array<smallint>, " + ", ".join(f"s{i} bigint" for i in range(SKETCH_LONGS))


def sketch(df: DataFrame, keys: list[str], text: str, all_rows: bool = False) -> DataFrame:
    """keys + (cls, runs, sig, s0..) for every text that can resemble another; with nulls for the rest if ``all_rows``.

    ``cls`` is the digest of the folded text (equal for copies), ``runs`` the
    number of its distinct runs, ``sig`` 16 bits of each MinHash value, ``s*``
    the packed sketch. ``text`` may be among the keys.
    """
    if not all_rows:
        df = df.where(F.col(text).isNotNull())
    df = df.select(*dict.fromkeys([*keys, text]))
    at_text = df.columns.index(text)
    names = [*keys, *(f.split()[0] for f in SKETCH_SCHEMA.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                folded = [fold(t) if t else "" for t in b.column(at_text).to_pylist()]
                keep = [i for i, t in enumerate(folded) if len(t) >= MIN_CHARS]
                if not keep and not all_rows:
                    continue
                hashes = [run_hashes(folded[i]) for i in keep]
                sig = signatures(hashes)
                longs = _pack(sig)
                low = (sig & np.uint32(0xFFFF)).astype(np.uint16).view(np.int16)
                cls = pa.array([hashlib.blake2b(folded[i].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in keep], pa.binary())
                runs = pa.array(np.array([len(np.unique(h)) for h in hashes], np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, COORDS, dtype=np.int32)), pa.array(low.ravel()))
                cols = [b.column(i) for i in range(len(keys))]
                made = [cls, runs, lists, *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(SKETCH_LONGS))]
                if all_rows:
                    place = np.full(b.num_rows, -1)
                    place[keep] = np.arange(len(keep))
                    take = pa.array(place, mask=place < 0)
                    made = [m.take(take) for m in made]
                else:
                    cols = [c.take(pa.array(keep)) for c in cols]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=names)

    key_schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.mapInArrow(work, f"{key_schema}{SKETCH_SCHEMA}")


def sketch_distance(a: str | None, b: str | None, longs: int = SKETCH_LONGS, ends: tuple[str, str] = ("", "")) -> Column:
    """Coordinates whose two sketch bits differ, of ``a.s*`` and ``b.s*`` (or of ``s*`` with two endings)."""
    total = None
    odd = F.lit(0x5555555555555555)
    names = [f"{side}." if side else "" for side in (a, b)]
    for i in range(longs):
        x = F.col(f"{names[0]}s{i}{ends[0]}").bitwiseXOR(F.col(f"{names[1]}s{i}{ends[1]}"))
        d = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        total = d if total is None else total + d
    return total


def sketch_limit(threshold: float, deviations: float = 4.0, longs: int = SKETCH_LONGS) -> int:
    """Largest sketch distance of pairs at ``threshold``, but for ``deviations`` standard deviations."""
    n = COORDS * longs // SKETCH_LONGS
    p = (1 - threshold) * 0.75
    return int(n * p + deviations * (n * p * (1 - p)) ** 0.5)


def similarity(a: str, b: str) -> float:
    """Exact similarity of two texts, null or short ones resemble nothing."""
    if a is None or b is None:
        return 0.0
    x, y = fold(a), fold(b)
    if min(len(x), len(y)) < MIN_CHARS:
        return 0.0
    if x == y:
        return 1.0
    s, t = np.unique(run_hashes(x)), np.unique(run_hashes(y))
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both / (len(s) + len(t) - both)


@F.pandas_udf(DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, np.ndarray] = {}

    def runs(t: str) -> np.ndarray:
        if t not in known:
            f = fold(t)
            known[t] = np.unique(run_hashes(f)) if len(f) >= MIN_CHARS else np.empty(0, np.uint64)
        return known[t]

    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        s, t = runs(x), runs(y)
        if len(s) and len(t):
            both = len(np.intersect1d(s, t, assume_unique=True))
            out[i] = both / (len(s) + len(t) - both)
        if len(known) > 4000:
            known.clear()
    return pd.Series(out)
