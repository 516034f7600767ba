import json

from papyrine.operators import nested as op


def flat(spark, texts):
    df = spark.createDataFrame([("d", str(i), t, "clash") for i, t in enumerate(texts)], "document_id string, record_id string, attributes string, outer_pos string")
    cols = {"symbol": lambda e, x: x.get("symbol"), "block": lambda e, x: e.get("block_id")}
    got = op.flat_json(df, ["document_id", "record_id"], "attributes", "evidence", "definitions", cols, "symbol string, block string").collect()
    return sorted((x.record_id, x.outer_pos, x.inner_pos, x.symbol, x.block) for x in got)


def test_shapes_of_json(spark):
    texts = [
        json.dumps({"evidence": [{"block_id": "t1", "definitions": [{"symbol": "a"}, None, {"symbol": "b"}]}, None, {"definitions": {"symbol": "c"}}]}),
        json.dumps({"payload": {"attributes": {"evidence": {"definitions": [{"symbol": "d"}]}}}}),
        json.dumps({"payload": json.dumps({"evidence": json.dumps([{"definitions": [{"symbol": "e"}]}])})}),
        '{"evidence": [{"definitions": [{"symbol": "x"',
        None, "", "null", "[]", "3", json.dumps({"evidence": None}), json.dumps({"evidence": [{"definitions": None}]}),
    ]
    assert flat(spark, texts) == [("0", 0, 0, "a", "t1"), ("0", 0, 2, "b", "t1"), ("0", 2, 0, "c", None), ("1", 0, 0, "d", None), ("2", 0, 0, "e", None)]


def test_spans_keep_positions(spark):
    schema = "document_id string, block_id string, text_lines array<struct<text: string, spans: array<struct<text: string>>>>, line string"
    rows = [("d", "b", [{"text": "l0", "spans": [{"text": "s"}, None]}, None, {"text": None, "spans": None}, {"text": "l3", "spans": [None, {"text": None}]}], ""), ("d", "c", None, ""), ("d", "e", [], "")]
    got = op.flat_spans(spark.createDataFrame(rows, schema), ["document_id", "block_id"], "text_lines", "spans").collect()
    assert sorted((x.block_id, x.outer_pos, x.inner_pos) for x in got) == [("b", 0, 0), ("b", 3, 1)]


def test_schema_graph_and_mapping(spark):
    texts = [json.dumps({"a": {"b": 1}, "list": [{"c": {"d": 1}}], "tree": {"tree": {"x": {"y": 1}}}}), json.dumps({"p": {"shared": {"k": 1}}, "q": {"shared": {"k": 2}}}), None, "broken{"]
    g = op.cut_schema(spark.createDataFrame([(t,) for t in texts], "j string"), "j")
    place = {x.member: x.place for x in op.mapping(g).collect()}
    assert place["list"] == place["tree"] == place["shared"] == "table"
    assert place["a"] == place["c"] == "inlined"
    s = op.SchemaGraph()
    s.add("$", "tree", False, True)
    s.add("tree", "tree", False, True)
    s.add("$", "one", False, True)
    assert s.tables() == ["tree"]
    assert op.mapping(op.cut_schema(spark.createDataFrame([], "j string"), "j")).count() == 0


def test_lines_without_spans(spark):
    from papyrine.plans import p3

    schema = "document_id string, block_id string, text_lines array<struct<text: string, bbox: struct<x0: double>, spans: array<struct<text: string>>>>"
    rows = [("d", "b", [{"text": "l0", "bbox": {"x0": 1.0}, "spans": None}, None, {"text": " ", "bbox": None, "spans": []}, {"text": None, "bbox": None, "spans": [None]}]), ("d", "c", None), ("d", "e", [])]
    got = op.flat_lines(spark.createDataFrame(rows, schema), ["document_id", "block_id"], "text_lines").collect()
    assert sorted((x.block_id, x.line_pos) for x in got) == [("b", 0), ("b", 2), ("b", 3)]
    assert {"p3_lines", "p3_evidence", "p3_members"} <= set(p3.QUERIES)


def test_tables_below_evidence_lose_nothing(spark):
    texts = [
        json.dumps({"evidence": [{"block_id": "t1", "marker": "where"}, None, "plain", {"definitions": {"symbol": "a", "scope": {"section": {"id": "s"}, "page": 3}, "rules": [{"rule": "r", "confidence": 0.5}, None, {"rule": "q"}]}}]}),
        json.dumps({"p": json.dumps({"evidence": {"definitions": [None, {"symbol": "b", "rules": "one", "roles": ["x", "y"]}]}})}),
        "broken evidence{", None, json.dumps({"evidence": None}),
    ]
    df = spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)], "document_id string, record_id string, attributes string")
    tables = [x.member for x in op.mapping(op.cut_schema(df, "attributes")).where("place = 'table'").collect()]
    assert set(tables) >= {"evidence", "definitions", "rules"}
    got = {(x.record_id, x.member, tuple(x.positions)): {c.name: c.value for c in x.columns} for x in op.flat_tables(df, ["document_id", "record_id"], "attributes", "evidence", tables).collect()}
    d = "evidence.definitions"
    assert got == {
        ("0", "evidence", (0,)): {"block_id": "t1", "marker": "where"}, ("0", "evidence", (2,)): {"$": "plain"}, ("0", "evidence", (3,)): {},
        ("0", d, (3, 0)): {"symbol": "a", "scope.section.id": "s", "scope.page": "3"}, ("0", f"{d}.rules", (3, 0, 0)): {"rule": "r", "confidence": "0.5"}, ("0", f"{d}.rules", (3, 0, 2)): {"rule": "q"},
        ("1", "evidence", (0,)): {}, ("1", d, (0, 1)): {"symbol": "b", "rules": "one", "roles": '["x", "y"]'},
    }


def test_escaped_names_and_elements_inside_themselves(spark):
    texts = [
        '{"\\u0065vidence": [{"definitions": [{"symbol": "a"}]}]}',
        json.dumps({"evidence": [{"definitions": [{"symbol": "b"}], "evidence": [{"definitions": {"symbol": "c"}}]}, {"definitions": [{"symbol": "d"}]}]}),
        json.dumps({"evidence": [{"note": {"definitions": [{"symbol": "no"}]}}]}),
    ]
    assert flat(spark, texts) == [("0", 0, 0, "a", None), ("1", 0, 0, "b", None), ("1", 1, 0, "d", None), ("1", 2, 0, "c", None)]


def test_rows_of_tables_against_brute_force(spark):
    import random

    r = random.Random(4)

    def value(depth):
        if depth == 0:
            return r.choice([None, 1, "x"])
        kind = r.random()
        if kind < 0.25:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        out = {k: value(depth - 1) for k in r.sample(["evidence", "definitions", "other", "more"], r.randint(0, 3))}
        return json.dumps(out) if r.random() < 0.1 else out

    def brute(v):
        found, count = [], [0]

        def walk(x):
            x = op.opened(x)
            if isinstance(x, list):
                for y in x:
                    walk(y)
            elif isinstance(x, dict):
                later = []
                for k, y in x.items():
                    y = op.opened(y)
                    if k == "evidence":
                        for e in op.elements(y):
                            e, n = op.opened(e), count[0]
                            count[0] += 1
                            if isinstance(e, dict):
                                found.extend((n, j) for j, d in enumerate(op.elements(e.get("definitions"))) if isinstance(op.opened(d), dict))
                            later.append(e)
                    elif k == "definitions":
                        later += [op.opened(e) for e in op.elements(y)]
                    else:
                        later.append(y)
                for y in later:
                    walk(y)

        walk(v)
        return sorted(found)

    values = [value(5) for _ in range(300)]
    df = spark.createDataFrame([("d", str(i), json.dumps(v)) for i, v in enumerate(values)], "document_id string, record_id string, attributes string")
    got = {}
    for x in op.flat_json(df, ["document_id", "record_id"], "attributes", "evidence", "definitions", {}, "").collect():
        got.setdefault(int(x.record_id), []).append((x.outer_pos, x.inner_pos))
    assert {k: sorted(v) for k, v in got.items()} == {i: b for i, v in enumerate(values) if (b := brute(op.parsed(json.dumps(v))))}
