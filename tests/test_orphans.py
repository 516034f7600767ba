import datetime as dt
import random

from papyrine.operators import orphans as op

T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
REFS = "document_id string, edge_id string, target_id string, loaded_at timestamp, ref_table string"
PARENTS = "document_id string, node_id string, loaded_at timestamp, deleted_at timestamp, at string"


def brute(refs, parents):
    record = lambda d, e, x: (d, e, x if e is None else "")  # noqa: E731  rows without an id: one record for each content
    first = {}
    for d, e, x, t, _ in refs:
        first.setdefault(record(d, e, x), []).append(t)
    first = {k: min((t for t in v if t is not None), default=None) for k, v in first.items()}
    out = set()
    for d, e, x, _, _ in refs:
        t = first[record(d, e, x)]
        x = (x or "").strip()
        if not x:
            continue
        doc, key = x.split("::", 1) if "::" in x else (d, x)
        live = t is not None and doc is not None and any(pd == doc and pk == key and a is not None and a <= t and (b is None or b > t) for pd, pk, a, b, _ in parents)
        if not live:
            out.add((d, e, x))
    return out


def case(seed):
    r = random.Random(seed)
    refs = [(r.choice(["a", "b", None]), r.choice(["e1", "e2", "e3", "e4", None]), r.choice(["x", " y\t", "b::x", "", None, "zz"]), r.choice([None, *map(T, range(0, 120, 7))]), "clash") for _ in range(60)]
    parents = [(r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.choice([None, *map(T, range(0, 100, 9))]), r.choice([None, None, *map(T, range(0, 130, 11))]), "clash") for _ in range(12)]
    return refs, parents


def test_against_brute_force(spark):
    for seed in range(3):
        refs, parents = case(seed)
        r = op.references(spark.createDataFrame(refs, REFS), "t", "edge_id", "target_id")
        got = {(x.document_id, x.record_id, x.ref_key) for x in op.orphans(r, op.parents(spark.createDataFrame(parents, PARENTS), "node_id")).collect()}
        assert got == brute(refs, parents)


def test_batches_give_the_same_as_one_run(spark):
    refs, parents = case(7)
    refs = [x for x in refs if x[3] is not None]
    r = op.references(spark.createDataFrame(refs, REFS), "t", "edge_id", "target_id").cache()
    p = op.parents(spark.createDataFrame(parents, PARENTS), "node_id").where("loaded_at is not null").cache()
    key = lambda df: sorted((str(x.document_id), str(x.record_id), x.ref_key) for x in df.collect())
    whole = key(op.orphans(r, p))
    state, got, kept = op.OrphanState.empty(spark), [], r.where("false")
    bounds = [T(0), T(40), T(80), T(400)]
    for lo, hi in zip(bounds, bounds[1:]):
        own = f" >= '{lo}' and {{0}} < '{hi}'"
        new = r.where("at" + own.format("at"))
        state, batch = op.advance(state, kept, new, p.where("loaded_at" + own.format("loaded_at")), str(hi))
        state = op.OrphanState(state.live.cache(), state.due.cache(), state.waiting.cache())
        got += key(batch.found)
        waiting = state.waiting
        kept = kept.unionByName(new).join(waiting, list(op.REF), "left_anti").select(*r.columns).cache() if waiting.count() else kept.unionByName(new)
    assert sorted(got) == whole


def test_fold_over_periods_is_one_run(spark):
    for seed in (5, 6):
        refs, parents = case(seed)
        r = op.references(spark.createDataFrame(refs, REFS), "t", "edge_id", "target_id")
        p = op.parents(spark.createDataFrame(parents, PARENTS), "node_id")
        got = set()
        for _, state, batch in op.fold(r, p, months=1):
            got |= {(x.document_id, x.record_id, x.ref_key) for x in batch.found.collect()}
        assert got == brute(refs, parents)
        live = {(x.target_document, x.target_key) for x in state.live.collect()}
        # What waits at the end are the references, each once, whose key has no live row.
        name = lambda x: (str(x.document_id), str(x.record_id), x.ref_key, str(x.at))
        assert sorted(map(name, state.waiting.collect())) == sorted(name(x) for x in r.collect() if (x.target_document, x.target_key) not in live)


def test_pending_at_the_end_of_months(spark):
    rows = [("a", "e1", "x", T(1), ""), ("a", "e2", "x", T(40), ""), ("a", "e3", "y", T(2), ""), ("a", "e4", "x", T(70), "")]
    r = op.references(spark.createDataFrame(rows, REFS), "t", "edge_id", "target_id")
    p = op.parents(spark.createDataFrame([("a", "x", T(5), T(50), "")], PARENTS), "node_id")
    got = sorted((x.period.month, x.n_pending) for x in op.pending(r, p).collect())
    # January: y waits; February: x was deleted on day 50, so its two references and y; March: one more.
    assert got == [(1, 1), (2, 3), (3, 4)]


def test_arrivals_resolve_and_deletions_reopen(spark):
    r = op.references(spark.createDataFrame([("a", "e", "x", T(1), "")], REFS), "t", "edge_id", "target_id").cache()
    p = op.parents(spark.createDataFrame([("a", "x", T(5), T(15), "")], PARENTS), "node_id")
    none = r.where("false")
    state, one = op.advance(op.OrphanState.empty(spark), none, r, p.where("false"), str(T(3)))
    assert one.found.count() == 1 and state.waiting.count() == 1
    state, two = op.advance(state, none, none, p, str(T(10)))
    assert two.resolved.count() == 1 and state.waiting.count() == 0 and state.due.count() == 1
    state, three = op.advance(state, r, none, p.where("false"), str(T(20)))
    assert three.reopened.count() == 1 and state.waiting.count() == 1 and state.live.count() == 0


def test_tokens_ignore_brackets_and_zeros(spark):
    rows = [("d", "b1", ["[FORMULA_001]", "FORMULA_7", None, " [FORMULA_0010] ", "[FORMULA_9]"], T(5))]
    refs = op.references(spark.createDataFrame(rows, "document_id string, block_id string, formula_tokens array<string>, loaded_at timestamp"), "b", "block_id", "formula_tokens", "token")
    parents = op.parents(spark.createDataFrame([("d", "[FORMULA_1]", T(1), None), ("d", "[FORMULA_007]", T(1), None), ("d", "[FORMULA_010]", T(9), None)], "document_id string, token string, loaded_at timestamp, deleted_at timestamp"), "token", "token")
    assert sorted(x.ref_key for x in op.orphans(refs, parents).collect()) == ["[FORMULA_0010]", "[FORMULA_9]"]


def test_empty_and_resolution(spark):
    none = spark.createDataFrame([], REFS)
    nop = spark.createDataFrame([], PARENTS)
    assert op.orphans(op.references(none, "t", "edge_id", "target_id"), op.parents(nop, "node_id")).count() == 0
    r = op.references(spark.createDataFrame([("a", "e", "x", T(1), "")], REFS), "t", "edge_id", "target_id")
    p = op.parents(spark.createDataFrame([("a", "x", T(3), None, "")], PARENTS), "node_id")
    row = op.orphans(r, p).collect()[0]
    assert row.resolved_at == T(3)
    assert op.orphan_counts(op.orphans(r, p)).collect()[0].n_orphans == 1
