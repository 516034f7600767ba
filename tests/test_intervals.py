import random

from papyrine.operators import intervals as op


def test_merged_against_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), *sorted((r.randint(0, 60), r.randint(0, 60)))) for _ in range(60)] + [("a", None, 3), ("a", 9, 2), ("c", 1, 1), ("c", 1, 1)]
    got = sorted((x.g, x.start, x.end, x.n) for x in op.merged(spark.createDataFrame(rows, "g string, s int, e int"), ["g"], "s", "e").collect())
    want = []
    for g in "abc":
        cur = None
        for a, b in sorted((a, b) for k, a, b in rows if k == g and a is not None and a <= b):
            if cur and a <= cur[1]:
                cur = [cur[0], max(cur[1], b), cur[2] + 1]
            else:
                if cur:
                    want.append((g, *cur))
                cur = [a, b, 1]
        want.append((g, *cur))
    assert got == sorted(tuple(x) for x in want)
    assert op.merged(spark.createDataFrame([], "g string, s int, e int"), ["g"], "s", "e").count() == 0


def test_overlaps_come_once(spark):
    r = random.Random(5)
    make = lambda n, p: [("g", f"{p}{i}", *sorted((r.uniform(0, 100), r.uniform(0, 100)))) for i in range(n)]
    left, right = make(30, "l"), make(30, "r")
    schema = "g string, {0} string, s double, e double"
    got = sorted((x.lid, x.rid) for x in op.overlapping(spark.createDataFrame(left, schema.format("lid")), spark.createDataFrame(right, schema.format("rid")), ["g"], "s", "e", 7.0, "lid", "rid").collect())
    assert got == sorted((a, b) for _, a, s, e in left for _, b, t, f in right if s <= f and t <= e)


def test_as_of(spark):
    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 9, "c"), ("z", 5, "d")], "k string, t int, id string")
    right = spark.createDataFrame([("k", 5, "x"), ("k", 7, "y"), ("q", 1, "w")], "k string, t int, v string")
    assert {r.id: r.v for r in op.as_of(left, right, ["k"], "t", "v").collect()} == {"a": None, "b": "x", "c": "y", "d": None}
