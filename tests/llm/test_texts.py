import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from archivolt.llm import block_join, mixing, pieces, subjects, tokenizer


def checked(text, cuts, size, overlap):
    """The rules for pieces, stated independently of the operator."""
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for n, (lo, hi) in enumerate(cuts):
        assert 1 <= hi - lo <= size
        if n:
            before = cuts[n - 1]
            assert lo > before[0] and 1 <= before[1] - lo <= overlap
        if n < len(cuts) - 1 and (text[hi - 1] + text[hi]).isascii() and text[hi - 1].isalnum() and text[hi].isalnum():
            assert not any(c.isspace() for c in text[max(lo, hi - 200) : hi])


def test_split_rules_across_ranges(spark):
    rng = random.Random(7)
    kinds = ["ab", " \n.", "x。字", "aaaaaaaaaaaa", "word word. ", "\n\n"]
    rows = [(f"d{i}", "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1201, 20_000)))) for i in range(25)]
    rows += [("null", None), ("empty", ""), ("fits", "a" * 1200), ("run", "a" * 5000), (None, "b" * 3000), ("d0", rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, window string")
    for step in (2400, 65_536):
        got = {}
        for r in pieces.split(df, "id", "text", step=step).collect():
            got.setdefault(r.parent_id, {})[r.chunk_no] = (r.start, r.stop, r.preview)
        own = {i: t for i, t in rows if i and t and len(t) > 1200}
        assert set(got) == set(own)
        for i, found in got.items():
            assert sorted(found) == list(range(len(found)))
            cuts = [found[k][:2] for k in range(len(found))]
            assert all(own[i][lo:hi] == found[k][2] for k, (lo, hi) in enumerate(cuts))
            checked(own[i], cuts, 1200, 200)
            assert pieces.valid_pieces(own[i], [found[k][2] for k in range(len(found))])


def test_split_files_by_byte_ranges(spark, tmp_path):
    text = "".join(random.Random(1).choice(["字", "ab ", "é", "x.\n", "🙂"]) for _ in range(20_000))
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    df = spark.createDataFrame([(str(path),), (str(tmp_path / "none"),), (None,)], "p string")
    got = sorted(pieces.split_files(df, "p", step=4096).collect(), key=lambda r: r.chunk_no)
    data = text.encode()
    assert got[0].start == 0 and got[-1].stop == len(data) and [r.chunk_no for r in got] == list(range(len(got)))
    assert all(r.preview.encode() == data[r.start : r.stop] and r.stop - r.start <= 1203 for r in got)
    assert all(b.start < a.stop for a, b in zip(got, got[1:], strict=False))


def test_unsplit_finds_missing_and_wrong_pieces(spark):
    text = "some words and more. " * 150
    good = [text[:1050], text[945:2100], text[1995:]]
    rows = [(f"p{i}", None, None, text) for i in range(7)] + [("short", None, None, "x" * 1200), ("n", None, None, None)]
    for n, part in enumerate(good):
        rows += [(f"g{n}", " P0 ", n, part), (f"g{n}", "p0", n, part), (f"a{n}", "p1", n + 1, part), (f"w{n}", "p2", n, part.upper() if n == 1 else part)]
        rows += [(f"t{n}", "p3", min(n, 1), part), (f"v{n}", "p4", n if n < 2 else None, part)]
    rows += [(f"many{i}", "p5", i, "s") for i in range(5000)]
    df = spark.createDataFrame(rows, "id string, parent_id string, chunk_no int, preview string")
    assert sorted(r.id for r in pieces.unsplit(df).collect()) == ["p1", "p2", "p3", "p4", "p5", "p6"]
    assert {r.parent_id for r in pieces.resplit(df).collect()} == {"p1", "p2", "p3", "p4", "p5", "p6"}
    assert not pieces.valid_pieces("ab cd" * 400, ["ab cd" * 200 + "ab c", ("ab cd" * 400)[1000:]]) and not pieces.valid_pieces(text, [])


def reference_encoder():
    import base64

    import tiktoken

    with open(f"{tokenizer.TOKENIZERS}/{tokenizer.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_tokenizer_matches_and_round_trips(spark):
    rng = random.Random(3)
    texts = ["", None, "Hello  world's <|endoftext|>\n\n", "红烧肉很好吃，" * 60, "a" * 30_000, "".join(rng.choice("acgt") for _ in range(20_000)), "İſ🙂\x00�", " ", "straße 12,345"]
    texts += ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(300)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[2]])], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenizer.encode(df, ["doc_id"], "text").collect()}
    encode = reference_encoder()
    assert got == {i: encode(t) if t else [] for i, t in enumerate([*texts, texts[2]])}
    counts = {r.doc_id: r.n for r in tokenizer.encode(df, ["doc_id"], "text", ids="n", count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokenizer.encode(df.limit(0), ["doc_id"], "text").count() == 0


def test_rates():
    totals = {"a": 1000, "b": 100, "c": 0, "d": 50}
    targets = {"a": (0.5, 1), "b": (0.25, 2), "c": (0.1, 3), "e": (0.05, 2), "d": (0.1, 10)}
    r = mixing.rates(totals, targets)
    sizes = {s: r[s] * totals[s] for s in r}
    assert set(r) == {"a", "b", "d"} and r["b"] == pytest.approx(2)
    assert sizes["a"] / sizes["b"] == pytest.approx(2) and sizes["d"] / sizes["b"] == pytest.approx(0.4)
    big = mixing.rates(totals, targets, 5000)
    assert big["a"] == 1 and big["b"] == 2 and big["d"] == 10
    assert sum(mixing.rates(totals, targets, 300)[s] * totals[s] for s in r) == pytest.approx(300)
    assert mixing.rates({}, targets) == {}


def test_mix_shares_and_caps(spark):
    rows = [(i, "word " * (1 + i % 7), ["Web-Clips ", "diary", "WIKI_EXPORT", None, "unwanted"][i % 5]) for i in range(4000)] + [(9001, None, "diary"), (9002, "", "diary")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("web_clips", 0.6, 2), ("diary", 0.3, 1), ("wiki_export", 0.1, 3), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    counted = mixing.token_counts(docs, "doc_id", "text", "source")
    mixed = mixing.mix(counted, targets)
    share = {r.source: r.actual_share for r in mixing.shares(mixed, targets).collect()}
    assert share["gone"] == 0 and all(abs(share[s] - t) < 0.02 for s, t in (("web_clips", 0.6), ("diary", 0.3), ("wiki_export", 0.1)))
    uses = Counter((r.source, r.doc_id) for r in mixed.collect())
    assert max(n for (s, _), n in uses.items() if s == "web_clips") <= 2 and max(n for (s, _), n in uses.items() if s == "diary") == 1
    assert sorted(map(tuple, mixing.mix(counted, targets).collect())) == sorted(map(tuple, mixed.collect()))
    assert mixing.mix(counted.limit(0), targets).count() == 0


def vectors(n=900, dim=24):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, dim))
    near = x[:150] + 0.03 * rng.normal(size=(150, dim))
    return [*x, *near, *[x[0]] * 25, *[3 * x[1]] * 3]


def test_most_similar_against_brute_force(spark):
    x = vectors()
    rows = [(f"k{i:04d}", bytearray(np.asarray(v, "<f4").tobytes()), "2025-01-01", 1) for i, v in enumerate(x)]
    rows += [("k0003", bytearray(np.ones(24, "<f4").tobytes()), None, 9), ("k0004", rows[4][1], "2025-01-01", 1)]
    bad = [None, b"", b"abc", np.zeros(24, "<f4").tobytes(), np.array([np.nan] * 24, "<f4").tobytes(), np.array([np.inf] * 24, "<f4").tobytes()]
    rows += [(f"bad{i}", None if b is None else bytearray(b), "2025", 1) for i, b in enumerate(bad)] + [(None, rows[0][1], "2025", 1)]
    rows += [(f"other{i}", bytearray(np.asarray(v[:7], "<f4").tobytes()), "2025", 1) for i, v in enumerate(x[:3])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "qkey string, qvec_blob binary, created_at string, data_version bigint, vec string")
    m = np.stack([np.frombuffer(bytes(r[1]), "<f4") for r in rows[: len(x)]]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    g = m @ m.T
    np.fill_diagonal(g, -2)
    want = {}
    for i in range(len(m)):
        best = np.sort(g[i])[::-1][9]
        want[f"k{i:04d}"] = (best, g[i])
    exact = block_join.most_similar(df, 10, margin=float("inf")).collect()
    found = Counter(r.key for r in exact)
    assert all(found[k] == 10 for k in want) and found["other0"] == 2 and not any(k.startswith("bad") for k in found)
    for r in exact:
        if r.key in want:
            assert r.cosine >= want[r.key][0] - 1e-6 and abs(want[r.key][1][int(r.other[1:])] - r.cosine) < 1e-5
    near = {(r.key, r.other) for r in block_join.most_similar(df, 10).collect()}
    assert len(near & {(r.key, r.other) for r in exact}) >= 0.9 * len(exact)
    some = block_join.most_similar(df, 10, margin=float("inf"), queries="key like 'k00%'").collect()
    assert {r.key for r in some} == {k for k in want if k.startswith("k00")} and len(some) == 1000
    assert all(r.cosine >= 0.99 for r in block_join.most_similar(df, 10, least=0.99).collect())
    assert block_join.most_similar(df.limit(0)).count() == 0


def test_cells_and_products_have_no_limit():
    assert block_join.cell_count(10**9) > 6000 and block_join.sample_size(10**9) == 8 * block_join.cell_count(10**9)
    rng = np.random.default_rng(3)
    a, b = rng.integers(-127, 128, (3, 4097)), rng.integers(-127, 128, (4097, 5))
    b[:, 0], a[0] = 127, 127
    assert (block_join._products(a.astype(np.float32), b.astype(np.float32)) == a @ b).all()


def test_tiles_lose_nothing(spark, monkeypatch):
    x = np.stack(vectors(300)).astype(np.float32)
    df = spark.createDataFrame([(i, x.shape[1], bytearray((v / np.linalg.norm(v)).tobytes())) for i, v in enumerate(x)], "key bigint, dim int, vec binary")
    whole = {(r.key, round(r.cosine, 9)) for r in block_join.neighbours(df, 5, margin=float("inf")).collect()}
    monkeypatch.setattr(block_join, "DATA_BLOCK", 40)
    monkeypatch.setattr(block_join, "QUERY_BLOCK", 30)
    assert {(r.key, round(r.cosine, 9)) for r in block_join.neighbours(df, 5, margin=float("inf")).collect()} == whole


TERMS = {a: [f"{a}{s}{t}" for s in "bcdfghjklmnp" for t in ("ab", "er", "io", "um", "el", "us")] for a in ("ster", "koch", "kont", "gart")}
AREA = {"ster": "astronomy", "koch": "cooking", "kont": "finance", "gart": "gardening"}


def test_subjects_held_out(spark):
    rng = random.Random(6)
    filler = ["today", "about", "maybe", "again", "never", "under"]

    def sentence(a):
        return " ".join([rng.choice(filler), *(rng.sample(TERMS[a], 3) if a else rng.sample(filler, 3)), rng.choice(filler)]) + "."

    docs, truth = [], {}
    for i in range(900):
        own = rng.sample(list(TERMS), rng.choice([1, 1, 1, 2]))
        plan = [own[k % len(own)] for k in range(8)] if i % 9 else [None] * 8
        docs.append((i, " ".join(sentence(a) for a in plan), "en"))
        truth[i] = {AREA[a] for a in plan if a}
    for i in range(60):  # program code is known by its words and signs, from labelled code
        names = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(6)) for _ in range(4)]
        docs.append((1000 + i, "def {0}(x):\n    return {1}[x]\n\nfor i in range(3):\n    if not {2}.get(i):\n        continue\n    print({3}, i)\n".format(*names), "en"))
    docs += [(1100 + i, f"2024-01-{i % 28 + 1:02d} INFO job {i} done\n2024-01-{i % 28 + 1:02d} WARN disk {i * 7} full", None) for i in range(60)]
    docs += [(2000, "def f(x):\n    return y[x]\nfor i in range(3):\n    print(i)", "en"), (2001, None, None), (2002, "", "en"), (2003, "2024-01-01,12,3\n2024-01-02,4,5", None), (2001, None, None)]
    labels = [(i, a) for i in range(0, 900, 8) for a in truth[i]] + [(5, "nothing"), (99_999, "cooking")] + [(1000 + i, "software") for i in range(0, 60, 4)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, lang string, terms string")
    areas = spark.createDataFrame([(a,) for a in [*AREA.values(), "software", None]], "area string")
    given = spark.createDataFrame(labels, "doc_id bigint, area string")
    rows = subjects.subjects(d, given, areas).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.area)
    assert got.get(2000) == {"software"} and not {2001, 2002, 2003, *range(1100, 1160)} & set(got)
    assert all(got.get(1000 + i) == {"software"} for i in range(60))
    held = [i for i in range(900) if i % 8]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right >= 0.9 * len(held)
    assert subjects.subjects(d.limit(0), given, areas).count() == 0
    assert subjects.subjects(d, given.limit(0), areas).count() == 0
    by_area = {r.area: r.docs for r in subjects.composition(subjects.subjects(d, given, areas), d).collect()}
    assert by_area["software"] == 61


def test_terms_of_every_script():
    """Words, pairs and signs by sentence; headings and lines without letters are no sentences."""
    count = lambda t: [int(x) for x in subjects.tokenize([t])[1]]
    assert count("One two. Three four five!\n\n# Heading\n12 ; 34\n") == [2, 3]
    assert count("한국어 문장 하나. جملة عربية قصيرة هنا") == [3, 4] and count("Ελληνικά και Кириллица हिन्दी में") == [5]
    assert count("中文句子。かな文字です。") == [3, 5] and count("ภาษาไทย") == [6] and count("𠀀𠀁") == [1]
    terms, counts, n = subjects.tokenize([None, "", "a b", "x = y[0]", "same same", "same"])
    assert n.tolist() == [0, 0, 1, 1, 1, 1] and counts.tolist() == [0, 3, 2, 1] and len(set(terms[-3:])) == 1
    spaced = " ".join("eine lange zeile mit vielen buchstaben")
    assert subjects.plain(spaced.replace("   ", "  ")) == "eine lange zeile mit vielen buchstaben"


def test_subjects_of_a_small_language_beside_a_large_vocabulary(spark):
    """More than 8,192 terms of the large language are more frequent than any of the small one."""
    rng = random.Random(8)
    word = lambda p, i: p + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    many = [word("en", i) for i in range(9000)] * 30
    rng.shuffle(many)
    docs = [(i, ". ".join(" ".join(many[i * 675 + k : i * 675 + k + 9]) for k in range(0, 675, 9)), "en") for i in range(400)]
    for i in range(80):
        own = [word("kw"[i % 2] * 2, k) for k in range(60)]
        docs.append((1000 + i, ". ".join(" ".join(rng.sample(own, 3)) for _ in range(8)), "de"))
    areas = spark.createDataFrame([("cooking",), ("weather",)], "area string")
    labels = spark.createDataFrame([(1000 + i, ("cooking", "weather")[i % 2]) for i in range(40)], "doc_id bigint, area string")
    got = subjects.subjects(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), labels, areas)
    found = {(r.doc_id, r.area) for r in got.where("doc_id >= 1040").collect()}
    assert found == {(1000 + i, ("cooking", "weather")[i % 2]) for i in range(40, 80)}


def test_subjects_against_given_labels(spark):
    """Neighbours of a leaf must not outweigh its own labels."""
    docs, labels, areas = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "subject_labels", "subject_areas"))
    given = {(r.doc_id, r.area) for r in labels.collect()}
    mine = labels.select("doc_id").distinct()
    found = {(r.doc_id, r.area) for r in subjects.subjects(docs, labels, areas).join(mine, "doc_id").collect()}
    assert len(found & given) >= 0.85 * len(given) and len(found & given) >= 0.9 * len(found)


def test_no_document_is_left_out_of_the_leaves(spark, monkeypatch):
    """Term vectors and k-means get every document, alone or in a weighted mean."""
    x = np.repeat(np.eye(8, dtype=np.float32), [1, 1, 1, 37, 40, 50, 60, 70], axis=0)
    means, weight = subjects._means(x, 4)
    assert weight.sum() == len(x) and np.allclose((means * weight[:, None]).sum(axis=0), x.sum(axis=0)) and len(means) <= len(x) // 4
    assert sum(len(b) for b in subjects._blocks(iter([x] * 5), 300)) == 5 * len(x)
    seen = []
    fit = subjects.BisectingKMeans.fit
    monkeypatch.setattr(subjects.BisectingKMeans, "fit", lambda self, df: (seen.append(df.agg({"weight": "sum"}).first()[0]), fit(self, df))[1])
    monkeypatch.setattr(subjects, "WHOLE_DOCS", 100)
    docs = spark.createDataFrame([(i, " ".join(f"word{chr(97 + i % 7)}{chr(97 + k)}" for k in range(9)) + ".", "en") for i in range(400)], "doc_id bigint, text string, lang string")
    areas, labels = spark.createDataFrame([("law",)], "area string"), spark.createDataFrame([(0, "law")], "doc_id bigint, area string")
    subjects.subjects(docs, labels, areas).count()
    assert seen == [400]


def test_tokenizing_looks_every_character_up_once(monkeypatch):
    """Ends of sentences come from the table of code points: no further pass over the characters for each end sign."""
    monkeypatch.delattr(subjects.np, "isin")
    terms, counts, sentences = subjects.tokenize(["# Head line\nOne two. Three four!five\n", None, "星云。图 (x)?\tab cd", "v1.2 works; fine"])
    assert counts.tolist() == [2, 3, 1, 3, 2, 1, 1] and sentences.tolist() == [2, 0, 3, 2] and counts.sum() == len(terms)


def test_kmeans_gets_partitions_by_rows(spark, monkeypatch):
    """Each of its many jobs costs every partition a task, so few rows go in few partitions."""
    seen = []
    fit = subjects.BisectingKMeans.fit
    monkeypatch.setattr(subjects.BisectingKMeans, "fit", lambda self, df: (seen.append((df.rdd.getNumPartitions(), df.count())), fit(self, df))[1])
    text = "concat('word', char(97 + id % 13), ' thing', char(97 + id % 11), ' other', char(97 + id % 17), '.') as text"
    docs = spark.range(400, numPartitions=7).selectExpr("id as doc_id", text, "'en' as lang")
    areas, labels = spark.createDataFrame([("law",)], "area string"), spark.createDataFrame([(0, "law")], "doc_id bigint, area string")
    subjects.subjects(docs, labels, areas).count()
    monkeypatch.setattr(subjects, "FIT_ROWS", 200, raising=False)
    subjects.subjects(docs, labels, areas).count()
    assert seen == [(1, 400), (2, 400)]


def test_normal_form_without_the_slow_way(monkeypatch):
    """Texts whose only other forms are compatibility forms are made plain character by character; the result is NFKC's."""
    rng = random.Random(4)
    pool = "ab <=.\nṇ̸́가가，＜Ａｶﾞ　…\xbdﬁ二が\U0001f600\U0002f800"
    for _ in range(2000):
        text = "".join(rng.choices(pool, k=rng.randrange(1, 40)))
        assert subjects.plain(text) == unicodedata.normalize("NFKC", text).lower()
    sizes, normalize = [], unicodedata.normalize
    monkeypatch.setattr(unicodedata, "normalize", lambda form, text: (sizes.append(len(text)), normalize(form, text))[1])
    assert subjects.plain("星云，图！ﬁ" * 50) == "星云,图!fi" * 50 and max(sizes) == 1


def test_hashes_of_runs():
    """A run has the same hash wherever it stands, also far into a long text; distinct numbers come as np.unique has them."""
    h = 0
    for k, char in enumerate("kelvin"):
        h += ord(char) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
    own = subjects._mixed(np.array([h & (1 << 64) - 1], np.uint64))[0]
    terms, counts, n = subjects.tokenize(["Kelvin", "x a kelvin", "ab " * 400_000 + "kelvin"])
    assert n.tolist() == [1, 1, 1] and counts.tolist() == [1, 1, 400_001] and (terms[[0, 1, -1]] == own).all() and len(set(terms[2:-1].tolist())) == 1
    for x in ([], [5], [3, 1, 3, 2**63, 0, 2**63]):
        assert np.array_equal(subjects._distinct(np.array(x, np.uint64)), np.unique(np.array(x, np.uint64)))
