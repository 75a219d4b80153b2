import random

import pytest

from archivolt.llm import chosen_path, history, shingles
from archivolt.llm.shingles import fold, run_hashes, similarity

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "ne", "tu", "so") for c in ("l", "n", "x", "q")]


def text(rng, n=90):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    w = t.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def brute_similarity(a, b):
    a, b = [{f[i : i + 5] for i in range(len(f) - 4)} if len(f := "".join(c for c in (t or "").lower() if c.isalnum())) >= 200 else set() for t in (a, b)]
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similarity_is_exact():
    rng = random.Random(1)
    for _ in range(50):
        a = text(rng)
        b = edited(rng, a, rng.random() / 2)
        assert similarity(a, b) == pytest.approx(brute_similarity(a, b))
    assert similarity(None, "a") == 0 and similarity("a", "a") == 0 and similarity(a, a.upper() + "!?") == 1
    assert fold("Ä-b_1 字") == "äb1字" and len(run_hashes("abcd")) == 0


def test_runs_follow_recall():
    assert chosen_path.runs_for(0.6, 0.99, 3) < chosen_path.runs_for(0.6, 0.999, 3)
    assert 0.4 < chosen_path.survival(0.6, 3) < chosen_path.survival(0.6, 2) < chosen_path.survival(0.9, 2) <= 1
    assert shingles.sketch_limit(0.6) > 128 * 0.4 * 0.75


def corpus(rng):
    rows = [(f"b{i}", text(rng)) for i in range(150)]
    for i in range(60):
        rows.append((f"e{i}", edited(rng, rows[i][1], rng.choice([0.02, 0.05, 0.1, 0.2]))))
    hot = text(rng)
    rows += [(f"h{i}", hot if i % 2 else edited(rng, hot, 0.03)) for i in range(70)]  # a dense group of a quarter of the rows
    rows += [("n", None), ("s", "short"), ("z", ""), ("b1", rows[1][1]), (None, hot), ("l", text(rng, 6000))]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id string, text string, k int, sig string")
    members, links = chosen_path.near_duplicates(df, "id", "text", 0.6)
    got = {tuple(r) for r in chosen_path.record_pairs(members, links).collect()}
    own = {i: t for i, t in rows if i}
    ids = sorted(own)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if brute_similarity(own[a], own[b]) >= 0.6}
    assert got <= want and len(got) >= 0.99 * len(want)
    empty = chosen_path.near_duplicates(df.limit(0), "id", "text")
    assert chosen_path.record_pairs(*empty).count() == 0


def test_dense_nodes_are_compared_in_tiles(spark):
    """Small limits force splitting, dense nodes and tiles; nothing is lost."""
    from archivolt.session import materialize, scratch_dir

    rng = random.Random(3)
    hot = text(rng)
    rows = [(str(i), edited(rng, hot, 0.02)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string")
    base = scratch_dir(spark)
    reps = materialize(shingles.sketch(df, ["id"], "text").selectExpr("cast(id as bigint) k", "sig", "s0", "s1", "s2", "s3"), f"{base}/r")
    got = chosen_path.candidate_pairs(reps, base, 0.6, bucket=4, tile=16, max_depth=4).count()
    assert got == 60 * 59 // 2


def test_recall_holds_where_nodes_are_split_deep(spark):
    """Pairs at the threshold among sets that share many tokens, so that nodes are split to the deepest levels."""
    import numpy as np

    from archivolt.session import materialize, scratch_dir

    rng = np.random.default_rng(6)
    sig = rng.integers(0, 3, (4000, shingles.COORDS))
    same = rng.random((2000, shingles.COORDS)).argsort(axis=1) < round(0.6 * shingles.COORDS)
    sig[1::2] = np.where(same, sig[::2], (sig[::2] + rng.integers(1, 3, same.shape)) % 3)  # neighbours share 0.6 of their tokens
    df = spark.createDataFrame([(k, s, 0, 0, 0, 0) for k, s in enumerate(sig.tolist())], "k bigint, sig array<smallint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    base = scratch_dir(spark)
    got = chosen_path.candidate_pairs(materialize(df, f"{base}/r"), base, 0.6, bucket=8)
    assert got.where("k_a % 2 = 0 and k_b = k_a + 1").count() >= 0.995 * 2000


H = ["%064x" % i for i in range(400)]


def brute_cases(entries, items):
    """Item by item, as the problem states it."""
    known, hashes, cases = [], set(), set()

    def accept(path, digest, preview):
        known.append((path, preview))
        if digest:
            hashes.add(digest)

    for i, parent, path, digest, preview in entries:
        if not parent:
            accept(path, digest, preview)
    seen = set()
    for batch, item, path, digest, preview in sorted(items, key=lambda r: (r[0], r[1])):
        if item in seen:
            continue
        seen.add(item)
        digest = digest and digest.lower().replace("sha256:", "").strip()
        like = any(brute_similarity(preview, p) >= 0.6 and (path is None or q is None or path != q) for q, p in known)
        if digest in hashes or like:
            cases.add(item)
        else:
            accept(path, digest, preview)
    return cases


def test_history_against_item_by_item(spark):
    rng = random.Random(5)
    texts = [text(rng) for _ in range(25)]
    entries = [(f"e{i}", None if i % 4 else "p", f"/e/{i}", H[i], texts[i]) for i in range(12)] + [("e99", "", None, None, None)]
    items, n = [], 0
    for batch in range(1, 6):
        for _ in range(16):
            n += 1
            base = rng.choice(texts)
            t = rng.choice([base, edited(rng, base, 0.03), edited(rng, base, 0.12), text(rng), None, "short"])
            path = rng.choice([f"/e/{rng.randrange(12)}", f"/i/{rng.randrange(9)}", f"/n/{n}", None])
            digest = rng.choice([H[rng.randrange(12)], H[50 + rng.randrange(20)].upper(), "sha256:" + H[100 + n], H[200 + n], None, "junk"])
            items.append((batch, n, path, digest if digest != "junk" else None, t))
    hot = text(rng)
    items += [(3, 500 + i, f"/hot/{i % 3}", None, hot) for i in range(30)]
    items += [items[0], items[5]]
    e = spark.createDataFrame([(*r, 1) for r in entries], "id string, parent_id string, source_path string, content_hash string, preview string, version int")
    b = spark.createDataFrame([(*r, "x") for r in items], "batch_no int, item_id bigint, source_path string, content_hash string, preview string, cls string")
    want = brute_cases(entries, items)
    for slice_rows, greedy_links in ((1000, 1000), (30, 1000), (1000, -1)):  # whole batches, slices, rounds instead of one task
        got = history.check_batches(e, b, slice_rows=slice_rows, greedy_links=greedy_links).collect()
        assert {r.item_id for r in got if r.case} == want
        assert len(got) == len({r[1] for r in items})
    versions = {r.item_id: (r.is_case, r.version) for r in history.verdicts(e, b).collect()}
    assert all((v is None) == case for case, v in versions.values())


def described(spark, rows):
    df = spark.createDataFrame(rows, "batch_no int, item_id bigint, source_path string, content_hash string, preview string")
    items, slices = history.arrivals(df)
    assert len(slices) == 1
    return items


def test_a_second_session_continues_a_history(spark):
    """What an earlier session accepted is found through the folder alone; small batches read only ranges that they touch."""
    from archivolt.session import materialize, scratch_dir

    rng = random.Random(9)
    texts = [text(rng) for _ in range(120)]
    folder = scratch_dir(spark)
    first = history.History(spark, folder, zone_rows=20, ranges=32)
    base = spark.createDataFrame([(f"/e/{i}", H[i], texts[i]) for i in range(80)], "source_path string, content_hash string, preview string")
    first.append(materialize(history.described(base, [], "source_path", "content_hash", "preview"), f"{folder}/base"))
    out = history.check(first, described(spark, [(1, i, f"/i/{i}", None, texts[70 + i]) for i in range(20)]))
    assert {r.item_id for r in out.collect() if r.case} == set(range(10))

    again = history.History.open(spark, folder)
    assert [r.number for r in again.runs] == [r.number for r in first.runs] and len(again.runs[0].lows) > 10
    new = described(spark, [(2, 1, "/x", None, edited(rng, texts[85], 0.02)), (2, 2, "/y", H[3].upper(), None), (2, 3, "/z", None, text(rng)), (2, 4, "/i/12", H[300], texts[82])])
    one = history.key_rows(new.where("item_id = 1"), "item_id")
    wanted = again.keys().where(again.zones(one.select("key"), 20)).select("run", "zone").distinct().count()
    assert wanted < again.keys().select("run", "zone").distinct().count()
    assert len(again.touched(new.where("item_id = 1").select("cls"), "cls", 1)) == 1
    assert {r.item_id: r.case for r in history.check(again, new).collect()} == {1: True, 2: True, 3: False, 4: False}
    for n in range(3, 8):  # runs are merged on the way, and what they hold stays
        again = history.History.open(spark, folder)
        out = history.check(again, described(spark, [(n, 1, f"/b/{n}", H[200 + n], texts[100 + n]), (n, 2, "/q", None, texts[99 + n])]))
        assert {r.item_id: r.case for r in out.collect()} == {1: False, 2: n > 3}
    assert len(again.runs) <= history.COMPACT_EVERY + 1


def test_hot_keys_go_beyond_the_window(spark):
    """More texts share MinHash values with a new one than its window holds; the one that it resembles is found all the same."""
    rng = random.Random(11)
    common = text(rng, 200)
    rows = [(f"/h/{i}", None, common + " " + text(rng, 150)) for i in range(150)]
    entries = spark.createDataFrame([(f"e{i}", None, *r, 1) for i, r in enumerate(rows)], "id string, parent_id string, source_path string, content_hash string, preview string, version int")
    items = [(1, 1, "/n/1", None, edited(rng, rows[77][2], 0.04)), (1, 2, "/n/2", None, common + " " + text(rng, 170)), (1, 3, "/h/5", None, edited(rng, rows[5][2], 0.02))]
    items += [(1, 10 + i, f"/m/{i}", None, common + " " + text(rng, 150)) for i in range(30)]
    b = spark.createDataFrame(items, "batch_no int, item_id bigint, source_path string, content_hash string, preview string")
    want = brute_cases([(f"e{i}", None, *r) for i, r in enumerate(rows)], [(x[0], x[1], *x[2:]) for x in items])
    assert {r.item_id for r in history.check_batches(entries, b).collect() if r.case} == want


def test_history_without_rows(spark):
    e = spark.createDataFrame([], "id string, parent_id string, source_path string, content_hash string, preview string, version int")
    b = spark.createDataFrame([], "batch_no int, item_id bigint, source_path string, content_hash string, preview string")
    assert history.check_batches(e, b).count() == 0
    one = spark.createDataFrame([(1, 1, None, None, None)], b.schema)
    assert [r.case for r in history.check_batches(e, one).collect()] == [False]
