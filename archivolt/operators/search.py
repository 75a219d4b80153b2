"""Batch retrieval: BM25 over weighted fields, phrases, LIKE fallback, cosine, fusion, suppression.

Queries are a DataFrame (qid, query). Postings are held for terms of queries only:
the corpus is scanned once, tokens that no query asks for never leave their task,
and each block of queries keeps its best hits while it reads the postings.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from archivolt.functions import text as T
from archivolt.functions.text import index_text
from archivolt.session import list_folder, materialize, scratch_dir

_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"

#: Field weights and the constants of BM25 and of rank fusion.
WEIGHTS = {"title": 6, "summary": 3, "keywords": 2, "preview": 1}
K1, B, RRF_K = 1.2, 0.75, 60


def compiled(queries: DataFrame) -> DataFrame:
    """(qid, term, pos, pair) of queries (qid, query): what each asks for.

    A query matches where any of its parts does. A run of letters and digits is
    one term; up to three CJK characters are a phrase; of a longer run every two
    neighbours are a term, and two terms that follow each other must both occur
    (``pair``; ``pos`` counts on, with a gap between runs).
    """
    runs = queries.select("qid", F.posexplode(T.segments("query")).alias("run", "segment"))
    runs = runs.withColumn("cjk", F.col("segment").rlike(f"^[{T.CJK}]")).withColumn("n", F.length("segment"))
    spaced = F.trim(F.regexp_replace("segment", "(.)", "$1 "))
    whole = runs.where("not cjk or n <= 3").select("qid", F.when(F.col("cjk"), spaced).otherwise(F.col("segment")).alias("term"), F.lit(-1).alias("pos"), F.lit(False).alias("pair"))
    long = runs.where("cjk and n > 3").select("qid", "run", "n", "segment")
    before = Window.partitionBy("qid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pairs = long.select("qid", "start", F.posexplode(F.expr("transform(sequence(1, n - 1), i -> concat(substring(segment, i, 1), ' ', substring(segment, i + 1, 1)))")).alias("at", "term"))
    return whole.distinct().unionByName(pairs.select("qid", "term", (F.col("start") + F.col("at")).cast("int").alias("pos"), F.lit(True).alias("pair")))


class _Asked:
    """Numbers of the terms that queries ask for, found in folded texts.

    Runs of up to three CJK characters are numbers as they stand; other terms are
    found by a hash and compared character by character.
    """

    def __init__(self, terms: list[str]):
        self.cjk = np.zeros(0x110000, bool)
        for low, high in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", T.CJK):
            self.cjk[int(low, 16) : int(high, 16) + 1] = True
        codes = [np.array([ord(x) for x in t if x != " "], np.uint32) for t in terms]
        run = np.array([self.cjk[c].all() and len(c) <= 3 for c in codes], bool)
        self.run_of = np.flatnonzero(run)
        keys = np.array([sum(int(x) << 21 * i for i, x in enumerate(codes[j])) for j in self.run_of], np.uint64)
        self.runs = self._index(keys)
        self.word_of = np.flatnonzero(~run)
        words = [codes[j] for j in self.word_of]
        self.size = np.array([len(c) for c in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.codes = np.concatenate([np.empty(0, np.uint32), *words])
        self.factor = 0x9E3779B97F4A7C15
        while len(np.unique(hashes := self.hashed(self.codes, self.first, self.size))) < len(words):
            self.factor += 2
        self.words = self._index(hashes)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)

    def _index(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        some = np.zeros(1 << 20, bool)
        some[self._slot(keys)] = True
        return keys[order], order, some

    def _found(self, index: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are in the index, and at which place."""
        held, order, some = index
        at = np.flatnonzero(some[self._slot(keys)])
        if not len(at):
            return at, at
        near = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
        same = held[near] == keys[at]
        return at[same], order[near[same]]

    def hashed(self, c: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.empty(0, np.uint64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        powers = np.full(size.max(), self.factor, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        return np.add.reduceat(c[np.repeat(first, size) + place].astype(np.uint64) * powers[place], np.cumsum(size) - size)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term) of every asked term that occurs, as often as it does; the number of tokens of each text."""
        c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        gap = (c == 32) | (c == 10)
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
        first, size = edge[::2], edge[1::2] - edge[::2]
        text = np.searchsorted(np.flatnonzero(c == 10), first)
        cjk = self.cjk[c[first]] & (size == 1)
        own, terms = [], []
        at = np.flatnonzero(cjk)
        key = c[first[at]].astype(np.uint64)
        for k in range(3):
            if k:  # the token k places on goes on with the run
                on = at + k < len(first)
                on[on] = cjk[at[on] + k] & (text[at[on] + k] == text[at[on]])
                at, key = at[on], key[on]
                key = key | c[first[at + k]].astype(np.uint64) << np.uint64(21 * k)
            i, j = self._found(self.runs, key)
            own.append(text[at[i]])
            terms.append(self.run_of[j])
        at = np.flatnonzero(~cjk)
        i, j = self._found(self.words, self.hashed(c, first[at], size[at]))
        at = at[i]
        same = size[at] == self.size[j]
        at, j = at[same], j[same]
        if len(at):
            n = self.size[j]
            ends = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(ends, n)
            same = np.logical_and.reduceat(c[np.repeat(first[at], n) + place] == self.codes[np.repeat(self.first[j], n) + place], ends)
            own.append(text[at[same]])
            terms.append(self.word_of[j[same]])
        return np.concatenate(own), np.concatenate(terms), np.bincount(text, minlength=len(texts))


def _tables(files: list[str], columns: list[str]):
    """The Parquet files of a shared folder, read within a task."""
    for name in files:
        system, at = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
        with system.open_input_file(at) as f:
            yield pq.ParquetFile(f).read(columns=columns)


def _files(spark, path: str) -> list[str]:
    return sorted(f"{path}/{n}" for n in list_folder(spark, path) if n.endswith(".parquet"))


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each part of ``values``."""
    return pa.array([values[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())


def postings(docs: DataFrame, numbered: DataFrame, terms: list[str], blocks: int) -> DataFrame:
    """(t, df, size, docs, tf): the postings of each asked term in each block of documents; t -1 for the documents themselves.

    ``numbered`` is (id, d, seen), ``terms`` the files of (term, t). A partition is a block; its visible documents are
    numbered in the order of ``d``. ``docs`` and ``tf`` hold four-byte numbers of the visible ones and weighted counts,
    ``df`` counts all. Of t -1 they hold d (eight bytes) and the tokens of each; ``size`` is the number of all tokens.
    Only asked terms leave a task, as one row for each term.
    """
    weights = np.array(list(WEIGHTS.values()), np.int64)

    def work(batches):
        names = pa.concat_tables(_tables(terms, ["term", "t"]))
        asked = _Asked(names.take(pc.sort_indices(names.column("t"))).column("term").to_pylist())
        d, seen, length, at, of, tf = [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        before = 0
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                fields = [b.column(2 + i).to_pylist() for i in range(len(weights))]
                text, term, n = asked([t for row in zip(*fields) for t in row])
                key, inverse = np.unique((text // len(weights)) << 32 | term, return_inverse=True)
                d.append(b.column(0).to_numpy())
                seen.append(b.column(1).to_numpy(zero_copy_only=False))
                length.append(n.reshape(-1, len(weights)).sum(axis=1))
                at.append((key >> 32) + before)
                of.append(key & 0xFFFFFFFF)
                tf.append(np.bincount(inverse, weights[text % len(weights)], len(key)).astype(np.int64))
                before += b.num_rows
        d, seen, length, at, of, tf = (np.concatenate(x) for x in (d, seen, length, at, of, tf))
        if not len(d):
            return
        # rows of one id are one document
        d, first, inverse = np.unique(d, return_index=True, return_inverse=True)
        seen, length = seen[first], np.bincount(inverse, length).astype(np.int32)
        key, place = np.unique(of << 32 | inverse[at], return_inverse=True)
        tf = np.bincount(place, tf, len(key)).astype(np.int32)
        of, at = key >> 32, key & 0xFFFFFFFF
        t, start = np.unique(of, return_index=True)
        df = np.diff(start, append=len(of))
        shown = seen[at]
        ends = np.concatenate(([0], np.cumsum(shown)))[start + df]
        at, tf = (np.cumsum(seen) - 1)[at[shown]].astype(np.int32), tf[shown]
        names = ["t", "df", "size", "docs", "tf"]
        own = [[-1], [len(d)], [int(length.sum())], [d[seen].tobytes()], [length[seen].tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(own, kinds)], names=names)
        for i in range(0, len(t), 4096):
            j = slice(i, i + 4096)
            low = ends[i - 1] if i else 0
            parts = [pa.array(t[j].astype(np.int32)), pa.array(df[j].astype(np.int32)), pa.nulls(len(t[j]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*parts, _packed(at[low:], ends[j] - low), _packed(tf[low:], ends[j] - low)], names=names)

    folded = [index_text(f).alias(f) for f in WEIGHTS]
    rows = docs.select("id", *WEIGHTS).repartition(blocks, "id").join(numbered.repartition(blocks, "id"), "id")
    return rows.select("d", "seen", *folded).mapInArrow(work, "t int, df int, size bigint, docs binary, tf binary")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, visible: DataFrame | None = None, query_block: int = 8192, doc_block: int = 65536) -> DataFrame:
    """(qid, id, score, rank): the k best matches of each query by BM25.

    Statistics cover all of ``docs``; ``visible`` (id) limits the hits only. A term
    that more than half of the documents have keeps the small weight 1e-6.

    Queries, terms and documents are numbered (documents in the order of their ids,
    by which ties are broken). The postings are written once, a file for each block
    of documents; each block of queries is one group, which reads them file by file
    and keeps the k best of each query. So matches, whose number grows with queries
    times documents, are neither shuffled nor sorted nor written.
    """
    spark = docs.sparkSession
    base = scratch_dir(spark)
    named = materialize(queries.select("qid", "query").withColumn("q", F.monotonically_increasing_id()), f"{base}/queries")
    asked = materialize(compiled(named.select(F.col("q").alias("qid"), "query")), f"{base}/asked")
    terms = materialize(asked.select("term").distinct().coalesce(1).withColumn("t", F.monotonically_increasing_id().cast("int")), f"{base}/terms")
    ids = docs.select("id").distinct()
    if visible is not None:
        ids = ids.join(visible.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left")
    seen = F.lit(True) if visible is None else F.col("seen").isNotNull()
    ids = ids.select("id", seen.alias("seen")).repartitionByRange("id").sortWithinPartitions("id").withColumn("d", F.monotonically_increasing_id())
    ids = materialize(ids, f"{base}/ids")
    parallel = spark.sparkContext.defaultParallelism
    held = f"{base}/postings"
    every = materialize(postings(docs, ids, _files(spark, f"{base}/terms"), max(parallel, -(-ids.count() // doc_block))), held)
    files = _files(spark, held)
    stats = every.where("t = -1").agg(F.sum("df").alias("n"), (F.sum("size") / F.sum("df")).alias("avg_length"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = every.where("t >= 0").groupBy("t").agg(F.sum("df").alias("df")).join(F.broadcast(stats))
    idf = idf.select("t", "avg_length", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"))
    n_q = named.count()
    groups = max(1, -(-n_q // query_block), min(n_q // 64, 2 * parallel))
    wanted = asked.join(terms, "term").join(idf, "t").select(F.col("qid").alias("q"), "t", "pos", "pair", "idf", "avg_length")
    wanted = wanted.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))

    def search(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("q", "ascending"), ("pos", "ascending")])
        q, t, pos, pair, idf, average = (group.column(c).take(order).to_numpy() for c in ("q", "t", "pos", "pair", "idf", "avg_length"))
        q, begin, query = np.unique(q, return_index=True, return_inverse=True)
        end = np.append(begin[1:], len(t)).tolist()
        begin = begin.tolist()
        paired = np.logical_or.reduceat(pair, begin)
        t, one, term = np.unique(t, return_index=True, return_inverse=True)
        idf, average, pos_of, pair_of, term_of = idf[one], average[0], pos.tolist(), pair.tolist(), term.tolist()
        floor = np.full(len(q), -1.0)  # what a match must reach
        rows, scores, where = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for b in _tables(files, ["t", "docs", "tf"]):
            if not b.num_rows:
                continue
            number = b.column("t").to_numpy()
            own = int(np.flatnonzero(number == -1)[0])
            d = np.frombuffer(b.column("docs")[own].as_py(), np.int64)
            norm = K1 * (1 - B + B * np.frombuffer(b.column("tf")[own].as_py(), np.int32) / average)
            mine = np.flatnonzero(np.isin(number, t))
            place = np.searchsorted(t, number[mine])
            b = b.take(pa.array(mine))
            held = b.column("docs").to_pylist()
            docs_in = np.frombuffer(b"".join(held), np.int32)
            tf = np.frombuffer(b"".join(b.column("tf").to_pylist()), np.int32)
            n = np.array([len(x) // 4 for x in held], np.int64)
            part = np.repeat(idf[place], n) * tf * (K1 + 1) / (tf + norm[docs_in])
            low, high, most = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64), np.zeros(len(t))
            low[place], high[place] = np.cumsum(n) - n, np.cumsum(n)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            most[place[some]] = np.maximum.reduceat(part, (np.cumsum(n) - n)[some])
            found = []
            low, high = low.tolist(), high.tolist()
            total, met, last = np.zeros(len(d)), np.zeros(len(d), bool), np.full(len(d), -9, np.int64)
            reach = np.bincount(query, most[term], len(q))
            for i in np.flatnonzero((reach > 0) & (reach + 1e-5 >= floor)).tolist():
                if end[i] - begin[i] == 1 and not paired[i]:
                    j = term_of[begin[i]]
                    at, s = docs_in[low[j] : high[j]], part[low[j] : high[j]]
                else:
                    for r in range(begin[i], end[i]):
                        j = term_of[r]
                        at = docs_in[low[j] : high[j]]
                        total[at] += part[low[j] : high[j]]
                        if paired[i]:  # a place that follows another one, or a term that stands for itself
                            met[at[last[at] == pos_of[r] - 1] if pair_of[r] else at] = True
                            if pair_of[r]:
                                last[at] = pos_of[r]
                    at = np.flatnonzero(total > max(floor[i] - 1e-5, 0))
                    if paired[i]:
                        at = at[met[at]]
                        met[:], last[:] = False, -9
                    s = total[at]
                    total[:] = 0
                s = np.round(s, 6)
                least = floor[i] if len(s) <= k else max(floor[i], np.partition(s, -k)[-k])
                keep = np.flatnonzero(s >= least)
                if len(keep) > 2 * k:  # many equal scores: places follow the ids
                    keep = keep[np.lexsort((keep, -s[keep]))[:k]]
                if len(keep):
                    found.append((np.full(len(keep), i), s[keep], d[at[keep]]))
            if not found:
                continue
            i, s, at = (np.concatenate(x) for x in zip(*found))
            rows, scores, where = np.concatenate((rows, i)), np.concatenate((scores, s)), np.concatenate((where, at))
            order = np.lexsort((where, -scores, rows))
            rows, scores, where = rows[order], scores[order], where[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            full = np.flatnonzero(rank == k - 1)
            floor[rows[full]] = scores[full]
            rows, scores, where = (x[rank < k] for x in (rows, scores, where))
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        return pa.table({"q": pa.array(q[rows]), "d": pa.array(where), "score": pa.array(scores), "rank": pa.array(rank.astype(np.int32))})

    best = wanted.repartition(2 * groups, "i").groupBy("i").applyInArrow(search, "q bigint, d bigint, score double, rank int")
    best = materialize(best, f"{base}/best")  # suppression and fusion read it more than once
    return best.join(named.select("q", "qid"), "q").join(ids.select("d", "id"), "d").select("qid", "id", "score", "rank")


def top(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def phrase(docs: DataFrame, words: str, field: str = "preview") -> DataFrame:
    """Documents whose tokens hold the words side by side."""
    wanted = F.concat(F.lit(" "), index_text(F.lit(words)), F.lit(" "))
    padded = F.concat(F.lit(" "), F.regexp_replace(index_text(field), " +", " "), F.lit(" "))
    return docs.where(F.contains(padded, F.regexp_replace(wanted, " +", " ")))


def like_terms(query: str) -> list[str]:
    """Runs of two or more letters, digits or CJK characters of a query."""
    return [t for t in re.findall(rf"[{_CJK}]+|(?:(?![{_CJK}])[^\W_])+", query.lower()) if len(t) >= 2]


def like(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with any of the terms in title, summary or preview, regardless of case; all without terms."""
    tests = [F.contains(F.lower(F.col(f)), F.lit(t.lower())) for t in terms for f in ("title", "summary", "preview")]
    return docs.where(reduce(lambda a, b: a | b, tests)) if tests else docs


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = -2.0, query_block: int = 2048, vector_block: int = 8192) -> DataFrame:
    """(qid, id, score, rank): the k most similar other rows of ``vectors`` (id, embedding) for each of ``queries`` (id, embedding), above ``least``.

    The vectors are written once to the shared folder, in the order of their ids;
    each block of queries is one group, which reads them block by block and keeps
    the k best of each query. So neither vectors nor candidates are repeated in a
    shuffle, and no block passes through the driver.
    """
    spark = queries.sparkSession
    n_q = queries.count()
    blocks = max(1, -(-n_q // query_block), min(n_q // 64, 2 * spark.sparkContext.defaultParallelism))
    path = f"{scratch_dir(spark)}/vectors"
    held = vectors.where("embedding is not null").select("id", "embedding")
    materialize(held.repartitionByRange("id").sortWithinPartitions("id"), path)
    files = _files(spark, path)  # numbered in the order of ids
    q = queries.where("embedding is not null").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i"))
    qid, vid = queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def unit(column):
        x = column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def stored():
        for name in files:
            system, at = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
            with system.open_input_file(at) as f:
                for b in pq.ParquetFile(f).iter_batches(vector_block, columns=["id", "embedding"]):
                    yield pa.Table.from_batches([b])

    def search(group: pa.Table) -> pa.Table:
        ids = group.column("id").combine_chunks()
        qs = unit(group.column("embedding"))
        n = len(qs)
        low = qs.astype(np.float32)
        full = np.zeros(n, bool)
        floor = np.full(n, least)  # what a later row must exceed: of equal scores the smaller id comes first
        rows, scores, names = np.empty(0, np.int64), np.empty(0), pa.array([], held_kind)
        for b in stored():
            vs = unit(b.column("embedding"))
            low_v = vs.astype(np.float32).T
            other = b.column("id").combine_chunks()
            own = pc.index_in(ids.cast(pa.string()), other.cast(pa.string())).to_numpy(zero_copy_only=False).astype(float)
            found = []
            for at in range(0, n, 256):
                s = low[at : at + 256] @ low_v
                me = own[at : at + 256]
                mine = np.flatnonzero(~np.isnan(me))
                s[mine, me[mine].astype(int)] = -9
                edge = floor[at : at + 256] - 1e-4  # beyond the error of single precision
                if s.shape[1] > k and not full[at : at + 256].all():
                    edge = np.maximum(edge, np.partition(s, -k, axis=1)[:, -k] - 2e-4)
                i, j = np.nonzero((s > edge[:, None]) & (s > -8))
                exact = np.empty(len(i))
                for c in range(0, len(i), 8192):
                    exact[c : c + 8192] = np.einsum("ij,ij->i", qs[at + i[c : c + 8192]], vs[j[c : c + 8192]])
                exact = np.round(exact, 6)
                keep = exact > floor[at + i]
                found.append((at + i[keep], exact[keep], j[keep]))
            i, s, j = (np.concatenate(x) for x in zip(*found))
            if not len(i):
                continue
            rows, scores = np.concatenate((rows, i)), np.concatenate((scores, s))
            names = pa.concat_arrays([names, other.take(pa.array(j))])
            order = np.lexsort((np.arange(len(rows)), -scores, rows))  # places follow the ids
            ranked = rows[order]
            place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
            last = order[place == k - 1]
            floor[rows[last]], full[rows[last]] = scores[last], True
            order = np.sort(order[place < k])
            rows, scores, names = rows[order], scores[order], names.take(pa.array(order))
        order = np.lexsort((np.arange(len(rows)), -scores, rows))
        ranked = rows[order]
        place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked) + 1
        return pa.table({"qid": ids.take(pa.array(ranked)), "id": names.take(pa.array(order)), "score": pa.array(scores[order]), "rank": pa.array(place.astype(np.int32))})

    held_kind = to_arrow_type(vectors.schema["id"].dataType)
    return q.repartition(2 * blocks, "i").groupBy("i").applyInArrow(search, f"qid {qid}, id {vid}, score double, rank int")


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 512, cap: int = 8192, digest: str = "blake2b", unit: bool = True) -> DataFrame:
    """(id, embedding): signed counts of hashed runs of three characters, of length one (``unit``); texts without any have zeros.

    ``cap`` is the model's input limit in characters. ``digest``: blake2b, or md5
    where SQL engines must give the same.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        known: dict[str, tuple[int, float]] = {}

        def slot(gram: str) -> tuple[int, float]:
            if digest == "md5":
                h = hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()
                return int(h[:8], 16) % dim, 1.0 if int(h[8], 16) & 1 else -1.0
            h = hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            return int.from_bytes(h[:4], "little") % dim, 1.0 if h[4] & 1 else -1.0

        for b in batches:
            rows = np.zeros((b.num_rows, dim))
            for i, text in enumerate(b.column(1).to_pylist()):
                t = re.sub(r"\s+", " ", (text or "").replace("İ", "i").lower()).strip()[:cap]
                for j in range(len(t) - 2):
                    g = t[j : j + 3]
                    if g not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[g] = slot(g)
                    at, sign = known[g]
                    rows[i, at] += sign
            if unit:
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            flat = pa.array(rows.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "embedding"])

    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(work, f"id {kind}, embedding array<float>")


def fuse(lanes: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of lanes (qid, id, rank)."""
    parts = reduce(DataFrame.unionByName, [x.select("qid", "id", (1 / (RRF_K + F.col("rank"))).alias("part")) for x in lanes])
    return top(parts.groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def suppress_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Drops hits whose own piece is among the query's hits; ``parents`` is (id, parent_id)."""
    above = hits.join(parents.where("parent_id is not null"), "id").select("qid", F.col("parent_id").alias("id")).distinct()
    return hits.join(above, ["qid", "id"], "left_anti")
