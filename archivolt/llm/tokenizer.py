"""Encoding of texts with a public byte-level BPE, contracted by DuckDB inside the tasks.

A text is cut into words by the tokenizer's pattern. A word is cut further
wherever no entry of the vocabulary holds the two bytes that meet there: no
merge can cross such a place, so the units encode independently. The units a
task has not seen yet go to DuckDB as token-position rows: a recursive query
joins neighbours with the merge table, contracts the pair of smallest rank of
each unit (the leftmost; in units over LONG bytes all its occurrences from the
left, which need fewer rounds) until none is left, and an ordered aggregation
lists the ids. Known units and words are kept in bounded caches.

The vocabulary file (under 1 MB, fixed) is read on the driver and broadcast.

Defined results: null and empty texts have the empty list; strings that look
like special tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public tokenizers.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG = 48
CACHED_UNITS = 400_000
CACHED_WORDS = 150_000
#: Characters handled at once by a task.
SLICE_CHARS = 3_000_000

_ROUNDS = """
WITH RECURSIVE step(unit, pos, tok, round) AS (
  SELECT unit, pos, tok, 0 FROM start
  UNION ALL
  SELECT unit, pos, CASE WHEN take THEN rank ELSE tok END, round + 1
  FROM (SELECT *, lag(take, 1, false) OVER (PARTITION BY unit ORDER BY pos) AS gone FROM ({take}))
  WHERE NOT gone)
SELECT unit, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(round) OVER (PARTITION BY unit) AS last FROM step) WHERE round = last GROUP BY unit ORDER BY unit
"""
_PAIRS = """
SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY unit) AS best
FROM (SELECT *, lead(tok) OVER (PARTITION BY unit ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY unit ORDER BY pos) AS nth FROM step) p
LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
"""
_LEFTMOST = f"""
SELECT *, rank = best AND pos = min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY unit) AS take
FROM ({_PAIRS}) WHERE best IS NOT NULL
"""
#: In a row of equal tokens every other pair is taken.
_EVERY = f"""
SELECT *, rank = best AND (nth - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN nth END) OVER (PARTITION BY unit ORDER BY pos), 0)) % 2 = 1 AS take
FROM ({_PAIRS}) WHERE best IS NOT NULL
"""


class Contractor:
    """The merge table in an in-memory DuckDB, and the caches of one Python worker."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import duckdb
        import regex

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.meets = np.zeros((256, 256), bool)
        merges = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                self.meets[token[i - 1], token[i]] = True
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    merges.append((a, b, rank))
        table = np.array(merges, np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        rows = pa.table({"a": table[:, 0], "b": table[:, 1], "rank": table[:, 2]})
        self.con.register("rows", rows)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM rows")
        self.con.unregister("rows")
        self.units: dict[bytes, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def _contract(self, units: list[bytes], take: str) -> None:
        for at in range(0, len(units), 50_000):
            part = units[at : at + 50_000]
            lengths = np.array([len(u) for u in part])
            ends = np.cumsum(lengths)
            unit = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            pos = (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32)
            start = pa.table({"unit": unit, "pos": pos, "tok": self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]})
            self.con.register("start", start)
            found = self.con.sql(_ROUNDS.format(take=take)).to_arrow_table()
            self.con.unregister("start")
            self.units.update(zip(part, found.column("ids").to_pylist(), strict=True))

    def learn(self, words: set[str]) -> None:
        """Fill the caches for words not known yet."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        new = [w for w in words if w not in self.words]
        if not new:
            return
        coded = [w.encode() for w in new]
        data = b"".join(coded)
        a = np.frombuffer(data, np.uint8)
        cut = np.ones(len(a) + 1, bool)
        cut[1:-1] = ~self.meets[a[:-1], a[1:]]
        ends = np.cumsum([len(c) for c in coded])
        cut[ends] = True
        places = np.flatnonzero(cut)
        last = np.searchsorted(places, ends).tolist()
        places = places.tolist()
        pieces = [data[places[i] : places[i + 1]] for i in range(len(places) - 1)]
        missing = [u for u in set(pieces) if u not in self.units]
        short, long = [u for u in missing if len(u) <= LONG], [u for u in missing if len(u) > LONG]
        if short:
            self._contract(short, _LEFTMOST)
        if long:
            self._contract(long, _EVERY)
        at = 0
        for w, to in zip(new, last, strict=True):
            ids = self.units[pieces[at]]
            for u in pieces[at + 1 : to]:
                ids = ids + self.units[u]
            self.words[w] = ids
            at = to

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.split(t) if t else [] for t in texts]
        seen: set[str] = set()
        seen.update(*cut)
        self.learn(seen)
        out, known = [], self.words
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


_worker: dict[tuple[int, str], Contractor] = {}


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(
    df: DataFrame,
    keys: list[str],
    text: str,
    ids: str = "ids",
    count_only: bool = False,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """keys + the list of token ids of ``text`` (or, with ``count_only``, their number)."""
    with open(f"{folder}/{vocabulary}", "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.select(*keys, text)
    names = [*keys, ids]
    kind = pa.int32() if count_only else pa.list_(pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (hash(shared.value), pattern)
        coder = _worker.get(own) or _worker.setdefault(own, Contractor(shared.value, pattern))
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            for lo, hi in _slices(texts):
                found = coder.encode(texts[lo:hi])
                col = pa.array([len(x) for x in found] if count_only else found, kind)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keys))), col], names=names)

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInArrow(work, f"{schema}, `{ids}` {'int' if count_only else 'array<int>'}")
