import random

from archivolt.operators.hierarchy import all_descendants, descendants, hierarchy

SCHEMA = "id string, parent_id string, derived_from string, path string, root int"


def brute(rows):
    clean = lambda x: (x or "").strip().lower() or None
    sup = {}
    for i, p, d in rows:
        if clean(i):
            sup[clean(i)] = max(filter(None, [sup.get(clean(i)), clean(p) or clean(d)]), default=None)
    out = {}
    for i in sup:
        way, at = [i], i
        while sup[at] in sup and sup[at] not in way:
            at = sup[at]
            way.append(at)
        if sup[at] in way:
            out[i] = (min(way[way.index(sup[at]) :]), None, None, True)
        else:
            out[i] = (at, len(way) - 1, "/".join(reversed(way)), False)
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return hierarchy(df, **kw)


def as_dict(tree):
    return {r.id: (r.root, r.depth, r.path, r.in_loop) for r in tree.collect()}


def test_small_cases(spark):
    rows = [
        ("A", None, ""), ("b", " a ", None), ("c", "B", "zz"), ("c", "B", "zz"), ("d", None, "c"),
        ("x", "y", None), ("y", "z", None), ("z", "y", None), ("s", "s", None), ("o", "missing", "a"), (None, "a", None), (" ", "a", None),
    ]
    tree = run(spark, rows)
    assert as_dict(tree) == brute(rows)
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(tree).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 3), ("b", "d", 2), ("c", "d", 1)}


def test_random_forest_with_loops_and_a_hot_parent(spark):
    rng = random.Random(4)
    rows = [(f"n{i}", f"n{rng.randrange(60)}" if rng.random() < 0.8 else None, None) for i in range(60)]
    rows += [(f"h{i}", "n1", None) for i in range(40)] + [(f"k{i}", f"k{i - 1}" if i else None, None) for i in range(70)]
    assert as_dict(run(spark, rows)) == brute(rows)
    assert {k: v[0] for k, v in as_dict(run(spark, rows, paths=False)).items()} == {k: v[0] for k, v in brute(rows).items()}


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_all_descendants_on_and_below_loops(spark):
    rng = random.Random(4)
    rows = [("a", None, None), ("b", "a", None), ("s", "s", None), ("t", "s", None), ("y", "x", None), ("z", "y", None), ("x", "z", None), ("p", "z", None), ("q", "p", None)]
    rows += [(f"n{i}", f"n{rng.randrange(60)}" if rng.random() < 0.8 else None, None) for i in range(60)]
    sup, want = {i: p for i, p, _ in rows}, set()
    for i in sup:
        at, way = sup[i], []
        while at in sup and at != i and at not in way:
            way.append(at)
            want.add((at, i, len(way)))
            at = sup[at]
    got = [(r.ancestor, r.descendant, r.distance) for r in all_descendants(run(spark, rows)).collect()]
    assert {("s", "t", 1), ("p", "q", 1), ("z", "q", 2), ("x", "q", 4), ("x", "z", 2), ("z", "x", 1)} <= want
    assert set(got) == want and len(got) == len(want)
    assert all_descendants(run(spark, [])).count() == 0
