import random

from papyrine.operators import hierarchy as op

SCHEMA = "document_id string, section_id string, parent_id string, ord int, tree string, id string"


def brute(rows):
    parent = {(d, s): p for d, s, p, *_ in rows}
    out = {}
    for k in parent:
        seen, chain, x = [], [], k
        while True:
            if x in seen:
                ring = seen[seen.index(x):]
                out[k] = (min(s for _, s in ring), None)
                break
            seen.append(x)
            p = parent[x]
            if not p or not p.strip() or (x[0], p) not in parent:
                out[k] = (x[1], len(seen))
                break
            x = (x[0], p)
    return out


def random_forest(seed, n):
    r = random.Random(seed)
    ids = [f"s{i:03d}" for i in range(n)]
    rows = []
    for i, s in enumerate(ids):
        p = r.choice([None, "", " ", "unknown", *([ids[i - 1]] * 6 if i else []), *r.sample(ids, 3)])
        rows.append((r.choice(["d1"]), s, p, r.choice([None, i]), "x", "y"))
    return rows


def test_against_brute_force(spark):
    for seed, n in ((1, 60), (2, 150)):
        rows = random_forest(seed, n)
        h = op.hierarchy(spark.createDataFrame(rows, SCHEMA), "document_id", "section_id", "parent_id", "ord").collect()
        want = brute(rows)
        assert {(x.tree, x.id): (x.root, x.depth) for x in h} == want
        by = {(x.tree, x.id): x for x in h}
        parent = {(d, s): p for d, s, p, *_ in rows}
        for k, x in by.items():  # intervals say who is below whom
            if x.cyclic:
                assert x.entry is None
                continue
            below = sum(1 for o, y in by.items() if not y.cyclic and o != k and (y.tree, y.root) == (x.tree, x.root) and x.entry < y.entry < x.exit)
            assert below == x.n_descendants
            p = parent[k]
            if x.depth > 1:
                q = by[(k[0], p)]
                assert q.entry < x.entry < x.exit < q.exit


def test_deep_chain_paths_and_descendants(spark):
    rows = [("d", f"n{i:04d}", f"n{i - 1:04d}" if i else None, i, "", "") for i in range(700)]
    h = op.cut(op.hierarchy(spark.createDataFrame(rows, SCHEMA), "document_id", "section_id", "parent_id", "ord"))
    assert h.where("depth = 700").collect()[0].id == "n0699"
    short = op.cut(op.hierarchy(spark.createDataFrame(rows[:9], SCHEMA), "document_id", "section_id", "parent_id", "ord"))
    paths = {x.id: x.path for x in op.paths(short).collect()}
    assert paths["n0003"] == "n0000 / n0001 / n0002 / n0003"
    assert op.descendants(short).count() == 36


def test_pairs_and_paths_are_those_of_the_links(spark):
    for seed, n in ((3, 40), (4, 130)):
        rows = [(r[0] if i % 7 else None, *r[1:]) for i, r in enumerate(random_forest(seed, n))]
        h = op.cut(op.hierarchy(spark.createDataFrame(rows, SCHEMA), "document_id", "section_id", "parent_id", "ord"))
        rooted = {(x.tree, x.id): x.parent for x in h.collect() if not x.cyclic}
        pairs, paths = set(), {}
        for (t, i), p in rooted.items():
            chain = [i]
            while p is not None:
                pairs.add((t, p, i))
                chain.append(p)
                p = rooted[(t, p)]
            paths[(t, i)] = " / ".join(reversed(chain))
        got = [(x.tree, x.ancestor, x.id) for x in op.descendants(h).collect()]
        assert len(got) == len(pairs) and set(got) == pairs
        assert {(x.tree, x.id): x.path for x in op.paths(h).collect()} == paths


def test_null_and_empty_tree_stay_apart(spark):
    rows = [(t, s, p, i, "", "") for t in (None, "") for i, (s, p) in enumerate([("a", None), ("b", "a"), ("c", "b")] if t is None else [("a", None), ("c", "a")])]
    h = {(x.tree, x.id): (x.root, x.depth, x.n_descendants) for x in op.hierarchy(spark.createDataFrame(rows, SCHEMA), "document_id", "section_id", "parent_id", "ord").collect()}
    assert h == {(None, "a"): ("a", 1, 2), (None, "b"): ("a", 2, 1), (None, "c"): ("a", 3, 0), ("", "a"): ("a", 1, 1), ("", "c"): ("a", 2, 0)}


def test_null_ids_empty_and_latest(spark):
    assert op.hierarchy(spark.createDataFrame([], SCHEMA), "document_id", "section_id", "parent_id", "ord").count() == 0
    rows = [(None, None, None, None, "", ""), ("d", "a", "a", 1, "", ""), (None, "b", None, 2, "", "")]
    h = {(x.tree, x.id): x for x in op.hierarchy(spark.createDataFrame(rows, SCHEMA), "document_id", "section_id", "parent_id", "ord").collect()}
    assert h[(None, None)].depth == 1 and h[("d", "a")].cyclic and h[("d", "a")].root == "a" and h[(None, "b")].root == "b"
    late = spark.createDataFrame([("d", "a", "2024-01-01", "old"), ("d", "a", "2024-02-01", "new"), ("d", "a", "2024-02-01", "new")], "d string, s string, t string, v string")
    assert [x.v for x in op.latest(late, ["d", "s"], "t", ["v"]).collect()] == ["new"]
