import duckdb
import pytest

import __spark_entry__ as entry
from papyrine.plans import registry

NAMES = sorted(n for n in registry.queries() if n in registry.oracle_sql())


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def db(data):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


#: Columns that identify a row of the queries without SQL; what they hold is tested by hand elsewhere.
KEYS = {
    "context": ["document_id", "block_id", "token"], "corpus": ["symbol", "meaning"], "def": ["document_id", "formula_id", "symbol", "definition"], "p3": None, "geo": ["document_id", "block_id"], "merge": ["document_id", "block_id"],
    "symbol": ["document_id", "formula_id", "symbol"], "rich": ["document_id", "id"], "proj_metavertex_rank": ["document_id", "metavertex_id"], "proj_serialized_nodes": ["document_id", "node_id"], "text_mentions_per_document": ["doc_id", "symbol"],
    "text_cleaned": None, "text_normalized_lines": ["document_id", "block_id", "line_pos"], "text_normalized_blocks": ["document_id", "block_id"], "text_tex_paragraphs": ["document_id", "block_id", "pos"], "sem_limited_edges": ["document_id", "source_id", "target_id", "relation", "variable"],
    "latex_align_sources": ["document_id", "read_id"], "latex_best_row": ["document_id", "formula_id"], "latex_detect_in_documents": ["doc_id", "start"], "latex_detect_in_text": ["document_id", "block_id", "start"], "latex_from_text": ["document_id", "block_id"],
    "latex_fragments": ["document_id", "formula_id", "fragment_id"], "latex_detected": ["document_id", "block_id", "latex"], "latex_standalone_lines": ["document_id", "block_id", "line_pos"], "latex": ["document_id", "formula_id"], "tex_events": None,
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_query_has_one_row_a_key(spark, data, name):
    df = entry.queries()[name](spark, data).cache()
    n = df.count()
    assert n > 0 or name == "latex_standalone_lines"  # the smallest table may hold none
    keys = KEYS.get(name, KEYS.get(name.split("_")[0]))
    if keys:
        assert df.select(*keys).distinct().count() == n
        assert df.where(f"{keys[0]} is null").count() == 0


def test_spans_and_definitions_are_those_of_their_tables(spark, data):
    """p3_found against p3_spans, which has SQL, and against p3_members, which goes another way."""
    found = entry.queries()["p3_found"](spark, data).cache()
    spans = entry.queries()["p3_spans"](spark, data).selectExpr("document_id", "block_id as record_id", "line_pos as outer_pos", "span_pos as inner_pos").distinct()
    own = found.where("record_table = 'text_blocks'").select("document_id", "record_id", "outer_pos", "inner_pos")
    assert own.count() == spans.count() > 0 and own.exceptAll(spans).isEmpty()
    members = entry.queries()["p3_members"](spark, data).where("member = 'evidence.definitions' and not exists(columns, c -> c.name = '$')").selectExpr("document_id", "metavertex_id as record_id", "positions[0] as outer_pos", "positions[1] as inner_pos").distinct()
    defs = found.where("record_table = 'mg_metavertices'").select("document_id", "record_id", "outer_pos", "inner_pos")
    assert defs.count() == members.count() > 0 and defs.exceptAll(members).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "document_id", "record_id", "ref_key"]


def test_limited_edges_are_those_of_one_pass(spark):
    import random

    from papyrine.operators.graph import limited_edges

    r = random.Random(5)
    rows = sorted({("d", r.randint(0, 3), f"n{r.randint(0, 14):02d}", f"n{r.randint(0, 14):02d}") for _ in range(260)}, key=lambda x: x[1:])
    want, degree = [], {}
    for d, p, a, b in rows:
        if a != b and degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            want.append((d, p, a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame(rows, "document_id string, priority int, source_id string, target_id string")
    got = limited_edges(df, "document_id", ["priority", "source_id", "target_id"], 3).collect()
    assert sorted((x.document_id, x.priority, x.source_id, x.target_id) for x in got) == sorted(want)
    assert limited_edges(df.where("false"), "document_id", ["priority", "source_id", "target_id"], 3).count() == 0


def test_mass_of_containers_of_any_depth(spark):
    from papyrine.operators.graph import rolled_up

    chain = [("d", f"m{i:02d}", f"m{i + 1:02d}") for i in range(14)] + [("d", "m14", "a"), ("d", "m14", "b"), ("d", "m03", "a"), ("d", "x", "y"), ("d", "y", "x"), ("d", "z", "gone")]
    own = spark.createDataFrame([("d", "a", 2.5), ("d", "b", 1.0)], "document_id string, id string, mass double")
    got = {x.id: x.mass for x in rolled_up(spark.createDataFrame(chain, "document_id string, parent string, child string"), own).collect()}
    assert got["m14"] == 3.5 and got["m04"] == 3.5 and got["m03"] == 6.0 and got["m00"] == 6.0 and got["x"] == got["y"] == got["z"] == 1.0


def test_components_of_a_long_path(spark):
    from papyrine.operators.graph import components

    nodes = spark.createDataFrame([("d", f"n{i:03d}") for i in range(120)] + [("e", "n000")], "document_id string, node_id string")
    edges = spark.createDataFrame([("d", f"n{i:03d}", f"n{i + 1:03d}") for i in range(119)] + [("d", "n005", None), ("e", "n000", "nope")], "document_id string, source_id string, target_id string")
    got = {(x.document_id, x.component) for x in components(nodes, edges, "document_id", "node_id").collect()}
    assert got == {("d", "n000"), ("e", "n000")}
