import datetime as dt

from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.functions.ids import clean_hash, clean_id
from archivolt.operators import catalog as C
from archivolt.operators import search as R
from archivolt.session import anti_join_sized, one_per_key, scratch_dir, semi_join_sized

ENTRY = "id string, parent_id string, derived_from string, status string, visibility string, updated_at string, source_path string, content_hash string, version int, title string, summary string, keywords string, preview string, collection string, size bigint"


def entry(i, **kw):
    base = dict(parent_id=None, derived_from=None, status="active", visibility="internal", updated_at="2025-01-01", source_path=None, content_hash=None,
                version=1, title="", summary="", keywords="", preview="", collection="c", size=1)
    base.update(kw)
    return (i, *[base[c.split()[0]] for c in ENTRY.split(", ")[1:]])


def test_keys(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(f" SHA256:{h.upper()} ",), (h,), ("ff",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(clean_hash("h")).collect()] == [h, h, None, None, None]
    ids = spark.createDataFrame([(" Ab\t",), ("",), (None,)], "i string")
    assert [r[0] for r in ids.select(clean_id("i")).collect()] == ["ab", None, None]


def test_catalog_scope_and_cascade(spark):
    rows = [
        entry("P", visibility="private"), entry("c1", parent_id=" p "), entry("c2", parent_id="gone", visibility="public"),
        entry("p", visibility="private", updated_at="2024-01-01", status="pending"), entry("r", status="retired"), entry("q", status="pending"), entry(None),
        entry("d", derived_from="P"),
    ]
    cat = C.catalog(spark.createDataFrame(rows, ENTRY), "parent_id", "derived_from", "visibility")
    assert cat.count() == 7 - 0 - 1
    shown = lambda s: sorted(r.id for r in cat.where(s).collect())
    assert shown(C.scope("viewer")) == ["c2"] and shown(C.scope("nobody")) == ["c2"]
    assert shown(C.scope("operator")) == ["c1", "c2", "d"]
    assert shown(C.scope("admin", include_pending=True)) == ["c1", "c2", "d", "p", "q"]
    assert shown(C.scope("admin", include_pieces=False)) == ["d", "p"]
    seen = {r.id: r.effective for r in C.cascade(cat, "visibility").collect()}
    assert seen["c1"] == "private" and seen["c2"] == "public"
    assert [tuple(r) for r in C.tighten(cat).collect()] == [("d", "p", "private")]


def test_glob_tags_and_duplicates(spark):
    df = spark.createDataFrame([("/a/b.md",), ("/a/B.md",), ("/a/bb.md",), (None,)], "p string")
    match = lambda g: [r.p for r in df.where(C.glob("p", g)).collect()]
    assert match("/a/?.md") == ["/a/b.md", "/a/B.md"] and match("/a/[a-z]*.md") == ["/a/b.md", "/a/bb.md"] and match("*.m") == []
    tags = spark.createDataFrame([("X", " Foo "), ("x", "foo"), ("x", "bar"), (None, "a"), ("x", ""), ("x", None)], "entry_id string, tag string")
    assert [tuple(r) for r in C.clean_tags(tags).collect()] == [("x", ["bar", "foo"])]
    h = "0" * 64
    cat = C.catalog(spark.createDataFrame([entry("a", content_hash=h), entry("b", content_hash=h.upper(), collection="d"), entry("c", content_hash="1" * 64)], ENTRY),
                    "parent_id", "content_hash", "collection", "size")
    (r,) = C.duplicate_groups(cat).collect()
    assert (r.copies, r.first_id, r.cross_collection, r.spare_bytes) == (2, "a", True, 1)


def test_import_and_versions(spark):
    h = [c * 64 for c in "0123"]
    cat = C.catalog(spark.createDataFrame([entry("a", source_path="/p", content_hash=h[0], version=3)], ENTRY), "parent_id", "source_path", "content_hash", "version")
    items = spark.createDataFrame(
        [(1, 1, "/p", h[0]), (1, 2, "/p", h[1]), (1, 2, "/p", h[1]), (2, 3, "/p", h[1]), (2, 4, "/new", None), (2, 5, None, h[2])],
        "batch_no int, item_id bigint, source_path string, content_hash string",
    )
    assert {r.item_id: (r.entry_id, r.matched) for r in C.import_match(cat, items).collect()} == {
        1: ("a", "skip"), 2: ("a", "update"), 3: ("a", "update"), 4: (None, "add"), 5: (None, "add")}
    assert {r.source_path: (r["items"], r.version) for r in C.upsert_versions(cat, items).collect()} == {"/p": (3, 4), "/new": (1, 1)}


def test_text(spark):
    df = spark.createDataFrame([("红烧肉 Hello, wörld-2!",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens("t")).collect()] == [["红", "烧", "肉", "hello", "wörld", "2"], [], []]
    s = spark.createDataFrame([("One. Two！三。\n\nlast",)], "t string").select(T.sentences("t")).first()[0]
    assert s == ["One.", "Two！", "三。", "last"]
    w = spark.createDataFrame([("a" * 3000,), ("b",)], "t string").select(T.windows("t", 1200, 200)).collect()
    assert [len(x) for x in w[0][0]] == [1200, 1200, 1000] and w[1][0] == ["b"]


def test_search(spark):
    rows = [entry("a", title="quick fox", preview="the fox"), entry("b", preview="the dog"), entry("c", parent_id="a", preview="fox fox fox"), entry("e", title=None, preview=None)]
    docs = C.catalog(spark.createDataFrame(rows, ENTRY), "title", "summary", "keywords", "preview", "parent_id")
    queries = spark.createDataFrame([("q1", "FOX!"), ("q2", "nothing"), ("q3", "*"), ("q4", '") OR 1=1--')], "qid string, query string")
    hits = R.bm25(docs, queries)
    assert [(r.id, r.rank) for r in hits.where("qid = 'q1'").orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert {r.qid for r in hits.collect()} == {"q1"}
    parents = docs.select("id", clean_id("parent_id").alias("parent_id"))
    assert [r.id for r in R.suppress_parents(hits, parents).collect()] == ["c"]
    assert [r.id for r in R.phrase(docs, "The Dog").collect()] == ["b"]
    assert R.like(docs, []).count() == 4 and [r.id for r in R.like(docs, ["QUICK"]).collect()] == ["a"]
    fused = R.fuse([hits, hits.where("id = 'c'").withColumn("rank", F.lit(1))])
    assert [r.id for r in fused.orderBy("rank").collect()] == ["c", "a"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id bigint, embedding array<float>")
    got = R.cosine_top(v.where("id = 1"), v, 2).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(2, 1.0), (3, 0.0)]


def test_sized_joins(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    keys = spark.createDataFrame([(1,), (9,)], "k int")
    for limit in (0, 10):
        assert semi_join_sized(df, keys, "k", limit).count() == 2 and anti_join_sized(df, keys, "k", limit).count() == 2
    assert sorted(r.k for r in one_per_key(df, "k", scratch_dir(spark)).collect()) == [1, 2, 3]


def test_streams_resume_where_they_stopped(spark, tmp_path):
    """Two files, then a third one for a second run from the same checkpoint."""
    from archivolt import streaming as Z

    rows = [(f"2025-01-0{d}T0{h}:00:00Z", q) for d in (1, 2, 3) for h in (1, 1, 2) for q in ("a", "b")]
    log = spark.createDataFrame([*rows, (None, "c"), ("never", "c")], "ts string, query string")
    source = str(tmp_path / "in")
    for day in ("01", "02"):
        log.where(f"ts like '2025-01-{day}%'").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = Z.event_time(Z.read_folder(spark, log.schema, source), "ts", "2 days")
        counted = stream.groupBy(F.window("at", "3 days").alias("w"), "query").agg(F.count(F.lit(1)).alias("n")).select("query", F.col("w.start").cast("string").alias("w"), "n")
        return {(r.query, r.w): r.n for r in Z.drain_updates(counted, str(tmp_path / "out"), ["query", "w"]).collect()}

    first = run()
    assert sum(first.values()) == 12
    log.where("ts like '2025-01-03%'").coalesce(1).write.mode("append").parquet(source)
    assert sum(run().values()) == 18 and run() == run()
    arrived = Z.arriving(log, "ts", str(tmp_path / "again"), parts=3)
    once = Z.event_time(arrived, "ts", "1 hour").dropDuplicatesWithinWatermark(["ts", "query"]).select("ts", "query")
    assert Z.drain(once, str(tmp_path / "again")).count() == 12


def test_stream_totals_of_each_user(spark, tmp_path):
    from archivolt.plans.streams import stream_each_user_totals

    at = dt.datetime(2025, 1, 8)
    rows = [(1, at, 1, "view", 2.0), (2, at, 1, "view", 3.0), (3, at, 2, "view", 10.0), (4, at, 2, "click", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "t" / "events.parquet"))
    got = {(r.user_id, r.event_type): (r.n, r.total) for r in stream_each_user_totals(spark, str(tmp_path / "t")).where("from_day = '2025-01-08'").collect()}
    assert got == {(1, "view"): (2, 5.0), (2, "view"): (1, 10.0), (2, "click"): (1, 1.0)}


def test_kinds_and_files(spark, tmp_path):
    from archivolt.functions.kinds import extension, kind_of
    from archivolt.sources import files

    names = spark.createDataFrame([("/a/x.PY",), ("/a/x.ts",), ("/a/.hidden",), ("/a/none",), ("/a/b.tar/y.docx",), ("/a/z.gguf",)], "p string")
    assert [r[0] for r in names.select(kind_of(extension("p"))).collect()] == ["code", "video", "binary", "binary", "text", "model"]
    for name, data in {
        "n.md": "# 标题\n".encode(), "g.txt": ("汉字内容" * 50).encode("gb18030"), "t.ts": b"let x: number = 1;", "c.png": b"\x89PNG\r\n\x1a\n\0\0", "b.bin": b"\0\1\2" * 9,
        ".git/config": b"x", "long.bin": ("汉" * 3000).encode("gb18030")[:4999], "cut.xyz": b"\xff" * 50, "sub/p.pdf": b"%PDF-1.4 x", "sub/w.wav": b"RIFF\0\0\0\0WAVEfmt",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in found.collect()}
    assert kinds == {"n.md": "text", "g.txt": "text", "t.ts": "code", "c.png": "image", "b.bin": "binary", "p.pdf": "pdf", "w.wav": "audio", "long.bin": "text", "cut.xyz": "binary"}
    text = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_text(found).collect()}
    assert text["n.md"] == "# 标题\n" and text["g.txt"].startswith("汉字") and text["c.png"] is None
    short = {r.path.rsplit("/", 1)[1]: (r.text, r.truncated) for r in files.read_text(found, 7).collect()}
    assert short["n.md"] == ("# 标", True) and short["g.txt"] == ("汉字内", True) and short["c.png"] == (None, None)
    assert files.changed(found, found.select("path", "size", "mtime")).count() == 0


def test_notebooks_office_files_and_logs(spark, tmp_path):
    import io
    import json
    import zipfile

    from archivolt.sources import files

    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": ["print(1)"], "outputs": [{"data": "AAAA"}]}, {"cell_type": "code", "source": []}]}
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Eins &amp; </w:t><w:t>zwei</w:t></w:p><w:p></w:p><w:p><w:t>drei</w:t></w:p>")
        z.writestr("word/styles.xml", "<x>no</x>")
    rows = [("a.ipynb", bytearray(json.dumps(book).encode())), ("b.docx", bytearray(zipped.getvalue())), ("c.docx", bytearray(b"PK broken"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert df.where("path = 'a.ipynb'").select(files.notebook_text()).first()[0] == "# T\nx\n\nprint(1)"
    assert {r.path: r.text for r in files.office_text(df.where("path <> 'a.ipynb'")).collect()} == {"b.docx": "Eins & zwei\ndrei", "c.docx": None}
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "n": 2}\nnot json\n\n{"ts": "3"}\n')
    assert [tuple(r) for r in files.log_lines(spark, str(tmp_path / "log.jsonl"), "ts string, n int").orderBy("ts").collect()] == [("1", 2), ("3", None)]


def reference_keywords(text):
    import re

    low, out = text.lower(), {}
    for w in re.findall("[a-z0-9]{2,}", low):
        if w not in T.EN_STOP and not w.isdigit():
            out[w] = out.get(w, 0) + 1
    for run in re.findall("[\u4e00-\u9fff]+", low):
        for i in range(len(run) - 1):
            if not set(run[i : i + 2]) & set(T.ZH_STOP):
                out[run[i : i + 2]] = out.get(run[i : i + 2], 0) + 1
    return out


def test_keywords_outlines_titles_paragraphs(spark):
    texts = ["The cache and the cache of 42 caches", "红烧肉的做法，红烧肉好吃", "", None, "mixed 中文混排 mixed text 中文"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in T.keyword_counts(df, "id", "t").collect():
        got.setdefault(r.id, {})[r.term] = r.n
    assert got == {i: w for i, t in enumerate(texts) if t and (w := reference_keywords(t))}
    code = "import x\n\nclass A:\n    def f(self):\n        pass\n    async def g(self): pass\nfunc main() {\nclass A:\n"
    titled = spark.createDataFrame([("/a/b.c.md", "\n\n## Head #1 \nx"), ("/a/b.c.md", "text\n# late"), (".env", None), (None, "#"), ("noext", code)], "p string, t string")
    assert [r[0] for r in titled.select(T.title("p", "t")).collect()] == ["Head #1", "b.c", ".env", "", "noext"]
    assert titled.where("p = 'noext'").select(T.code_outline("t")).first()[0] == "class A；def f(self)；async def g(self): pass；func main()"
    long = "x" * 3000
    docs = spark.createDataFrame([(1, "aa\n\nbb\n \ncc"), (2, f"aa\n\n{long}\n\ncc"), (3, ""), (4, None), (5, "y" * 700 + "\n\n" + "z" * 600)], "id int, t string")
    pieces = {}
    for r in T.merged_paragraphs(docs, "id", "t").orderBy("id", "no").collect():
        pieces.setdefault(r.id, []).append(r.piece)
    assert pieces == {1: ["aa\nbb\ncc"], 2: ["aa", "x" * 1200, "x" * 1200, "x" * 1000, "cc"], 5: ["y" * 700, "z" * 600]}


def test_grams_are_all_there(spark):
    texts = ["ab", "abc", "A  b\nC", None, "日本語x" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    flat = [" ".join((t or "").lower().split()) for t in texts]
    want = sorted((i, f[k : k + 3]) for i, f in enumerate(flat) for k in range(len(f) - 2))
    assert sorted((r.id, r.gram) for r in T.gram_rows(df, ["id"], "t").collect()) == want


def test_queries_are_compiled(spark):
    q = spark.createDataFrame([("a", "红烧肉 Fox2"), ("b", "自注意力机制x面对行刑队"), ("c", "*?!"), ("d", None)], "qid string, query string")
    rows = {(r.qid, r.term, r.pos, r.pair) for r in R.compiled(q).collect()}
    assert {r for r in rows if r[0] == "a"} == {("a", "红 烧 肉", -1, False), ("a", "fox2", -1, False)}
    b = sorted((p, t) for i, t, p, pair in rows if i == "b" and pair)
    assert [t for _, t in b] == ["自 注", "注 意", "意 力", "力 机", "机 制", "面 对", "对 行", "行 刑", "刑 队"] and b[5][0] - b[4][0] == 2
    assert {r[0] for r in rows} == {"a", "b"}


def test_long_cjk_queries_need_neighbouring_pairs(spark):
    """Three characters in a row are enough, two pairs apart aren't; also beyond the 62 places of a mask."""
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    query = "".join(alphabet[:150])
    texts = {"run": "x".join(["".join(alphabet[60:63])]), "apart": alphabet[3] + alphabet[4] + " y " + alphabet[9] + alphabet[10], "late": "".join(alphabet[123:126]), "none": "".join(alphabet[200:220])}
    docs = C.catalog(spark.createDataFrame([entry(i, preview=t) for i, t in texts.items()], ENTRY), "title", "summary", "keywords", "preview", "parent_id")
    got = {r.id for r in R.bm25(docs, spark.createDataFrame([("q", query)], "qid string, query string")).collect()}
    assert got == {"run", "late"}


def test_vector_tiles_and_hashed_vectors(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).round(3)
    x[7] = x[8]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<float>")
    u = (x.astype(np.float32).astype(float) / np.linalg.norm(x.astype(np.float32).astype(float), axis=1)[:, None])
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {i: [int(j) for j in sorted(range(300), key=lambda j: (-s[i, j], j))[:5]] for i in range(0, 300, 20)}
    for blocks in ((2048, 8192), (4, 40)):
        got = {}
        for r in R.cosine_top(v.where("id % 20 = 0"), v, 5, query_block=blocks[0], vector_block=blocks[1]).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want
    t = spark.createDataFrame([(1, "Ab  cd"), (2, None), (3, "ab cd")], "id int, t string")
    rows = {r.id: r.embedding for r in R.hashed_vectors(t, "id", "t", dim=64).collect()}
    own = np.zeros(64)
    for g in ("ab ", "b c", " cd"):
        h = hashlib.blake2b(g.encode(), digest_size=8).digest()
        own[int.from_bytes(h[:4], "little") % 64] += 1 if h[4] & 1 else -1
    assert np.allclose(rows[1], own / np.linalg.norm(own)) and rows[1] == rows[3] and not any(rows[2])


def test_writes(spark, tmp_path):
    from archivolt.operators import writes as W

    rows = [entry("a"), entry("a1", parent_id="A "), entry("b", status="pending", version=3, size=5), entry("b1", parent_id="b", status="pending"), entry("c", content_hash="1" * 64, source_path="/c")]
    cat = C.catalog(spark.createDataFrame(rows, ENTRY), "parent_id", "version", "size", "content_hash", "source_path", "collection", "preview")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.id for r in W.deleted(cat, ids("a", "a", "zz")).collect()} == {"b", "b1", "c"}
    assert {r.id for r in W.approved(cat, ids("b", "a")).where("status = 'active'").collect()} == {"a", "a1", "b", "b1", "c"}
    changes = spark.createDataFrame([("b", 1, 9, None), ("b", 2, 7, None), ("n", 1, 1, "x")], "id string, at int, size bigint, collection string")
    got = {r.id: (r.size, r.collection, r.version) for r in W.merged(cat, changes, ["at"], ["size", "collection"]).collect()}
    assert got["b"] == (7, "c", 5) and got["n"] == (1, "x", 1) and got["a"] == (1, "c", 1)
    tags = spark.createDataFrame([("A", " X "), ("a", "y"), (None, "z")], "entry_id string, tag string")
    new = spark.createDataFrame([("a", "w"), ("b", "y")], tags.schema)
    assert {tuple(r) for r in W.retagged(tags, new, spark.createDataFrame([("a", "Y")], tags.schema)).collect()} == {("a", "x"), ("a", "w"), ("b", "y")}
    W.exported(cat, tags, str(tmp_path / "out"), collection="c")
    (tmp_path / "out" / "part-bad.json").write_text('no json\n{"title": "no id"}\n{"id": "N1", "blob": "' + "2" * 64 + '"}\n')
    known = cat.where("id in ('a', 'b')").unionByName(cat.where("id = 'c'").withColumn("id", F.lit("c0")))
    blobs = spark.createDataFrame([("3" * 64,)], "digest string")
    got = sorted((r.id or "", r.entry_id or "", r.matched) for r in W.imported(spark, str(tmp_path / "out"), known, blobs).collect())
    assert got == [("", "", "failed"), ("", "", "failed"), ("a", "a", "updated"), ("a1", "a1", "imported"), ("b", "b", "updated"), ("b1", "b1", "imported"), ("c", "c0", "updated"), ("n1", "n1", "skipped")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import pytest

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError):
        scratch_dir(Session)


def test_vectors_and_candidates_are_not_repeated(spark):
    """Many blocks repeat neither vectors nor candidates in a shuffle; ties at the k-th place go to the smaller id in any block."""
    v = spark.createDataFrame([(i, [1.0, float(i % 3), 0.0]) for i in range(200)] + [(900, None)], "id bigint, embedding array<float>")
    got = R.cosine_top(v.where("id < 30"), v, 4, query_block=7, vector_block=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    for r in got.groupBy("qid").agg({"id": "collect_list"}).collect():
        assert sorted(r[1]) == [i for i in range(r.qid % 3, 200, 3) if i != r.qid][:4]
    assert R.cosine_top(v.where("id < 3"), v.where("id > 900"), 4).count() == 0


def test_bm25_over_blocks(spark):
    """Every query matches every document, and all scores of a query are equal: the best are the smallest visible ids, whatever the blocks (F3)."""
    words = [f"w{i:02d}" for i in range(40)]
    docs = spark.createDataFrame([(f"d{i:04d}", "", "", "", " ".join(words)) for i in range(1500)], "id string, title string, summary string, keywords string, preview string")
    queries = spark.createDataFrame([(f"{a}-{b}", f"{a} {b}") for a in words for b in words], "qid string, query string")
    hidden = docs.where("id >= 'd0002'").select("id")
    plain = R.bm25(docs, queries, 3, hidden, query_block=100, doc_block=200)
    got = plain.collect()
    assert len(got) == 3 * 1600 and {(r.id, r["rank"]) for r in got} == {("d0002", 1), ("d0003", 2), ("d0004", 3)}


def test_bm25_terms(spark):
    """Terms are found by hash and compared; runs of CJK characters across fields or words are none; duplicate rows of an id are one document."""
    docs = spark.createDataFrame(
        [("a", "星", "云", "", "x"), ("b", "", "", "", "星云图"), ("c", "", "", "", "星 云"), ("d", "Straße", None, "", "straße É"), ("d", "", "", "", "é"), ("e", "", "", "", "")],
        "id string, title string, summary string, keywords string, preview string",
    )
    queries = spark.createDataFrame([("1", "星云"), ("2", "STRASSE straße"), ("3", "é"), ("4", "星云图谱"), ("5", "!"), ("6", "图")], "qid string, query string")
    got = {}
    for r in R.bm25(docs, queries).collect():
        got.setdefault(r.qid, set()).add(r.id)
    assert got == {"1": {"b", "c"}, "2": {"d"}, "3": {"d"}, "4": {"b"}, "6": {"b"}}
    assert R.bm25(docs, queries.limit(0)).count() == 0 and R.bm25(docs.limit(0), queries).count() == 0


def test_release_returns_freed_native_memory(spark):
    """What the driver freed outside the heap goes back to the system, although memory beside it is still in use."""
    from archivolt.session import release

    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"

    def resident():
        with open(status) as f:
            return next(int(line.split()[1]) for line in f if line.startswith("VmRSS")) // 1024

    held = [jvm.java.util.zip.Deflater() for _ in range(600)]  # about 260 KB each, in pieces of 64 KB
    for _ in range(2):
        jvm.System.gc()
    for d in held[:-1]:
        d.end()
    before = resident()
    release(spark)
    assert resident() < before - 30
    held[-1].end()
