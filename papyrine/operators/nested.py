"""Deeply nested records to related flat tables, by shared inlining.

The schema is a graph: an object or array is a node, a member an edge, marked as repeated below an array. Elements that
occur once below their owner are inlined into the owner's table as columns; elements that are repeated, that several
owners share (the same member name with object values below different owners) or that contain themselves get a table of
their own, whose rows carry the key of the record, the keys of the owning rows and their positions.

Defined results
* null arrays and null elements give no rows; a null element still takes its position
* text that is no JSON, null text and JSON without objects give no rows
* a string that itself holds a JSON object or array is opened like any other value
* a single object where other records have an array of them counts as an array of one
* members are looked up by name, so further members and columns change nothing
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(value: object) -> object:
    """value, or what it holds if it is a string with a JSON object or array."""
    if isinstance(value, str):
        s = value.strip()
        if s[:1] in ("{", "["):
            try:
                return json.loads(s)
            except (ValueError, RecursionError):
                return value
    return value


def parsed(text: str | None) -> object:
    """The JSON of a text, None if it cannot be read."""
    if text is None:
        return None
    try:
        return opened(json.loads(text))
    except (ValueError, RecursionError):
        return None


@dataclass
class SchemaGraph:
    """Edges owner -> member of a set of JSON values: how often, and whether the member was ever repeated."""

    edges: dict[tuple[str, str], list] = field(default_factory=dict)

    def add(self, owner: str, member: str, repeated: bool, nested: bool, count: int = 1) -> None:
        e = self.edges.setdefault((owner, member), [0, False, False])
        e[0] += count
        e[1] |= repeated
        e[2] |= nested

    def owners(self) -> dict[str, set[str]]:
        by: dict[str, set[str]] = defaultdict(set)
        for (owner, member), (_, _, nested) in self.edges.items():
            if nested:
                by[member].add(owner)
        return by

    def recursive(self) -> set[str]:
        """Elements that can contain themselves: they reach themselves over edges of nested members."""
        out: dict[str, set[str]] = defaultdict(set)
        for (owner, member), (_, _, nested) in self.edges.items():
            if nested:
                out[owner].add(member)
        found = set()
        for start in list(out):
            seen, todo = set(), list(out[start])
            while todo:
                x = todo.pop()
                if x == start:
                    found.add(start)
                    break
                if x not in seen:
                    seen.add(x)
                    todo += out.get(x, ())
        return found

    def tables(self) -> list[str]:
        """Elements that need a table of their own: repeated, shared or recursive; the root always has one."""
        own = {m for (_, m), (_, repeated, nested) in self.edges.items() if nested and repeated}
        own |= {m for m, o in self.owners().items() if len(o) > 1}
        return sorted(own | self.recursive())


def _schema_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    graph = SchemaGraph()

    def walk(value: object, owner: str) -> None:
        stack = [(value, owner)]
        while stack:
            v, o = stack.pop()
            v = opened(v)
            if isinstance(v, list):
                stack += [(x, o) for x in v]
            elif isinstance(v, dict):
                for k, x in v.items():
                    x = opened(x)
                    graph.add(o, k, isinstance(x, list), isinstance(x, dict) or isinstance(x, list) and any(isinstance(opened(y), dict | list) for y in x))
                    stack.append((x, k))

    for b in batches:
        for text in b.column(0).to_pylist():
            walk(parsed(text), "$")
    rows = [(o, m, c, r, n) for (o, m), (c, r, n) in graph.edges.items()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.bool_())], names=["owner", "member", "n", "repeated", "nested"])


def schema_graph(df: DataFrame, column: str) -> DataFrame:
    """(owner, member, n, repeated, nested) over all rows: one partial graph per task, then a small aggregation."""
    parts = df.select(F.col(column).cast("string")).mapInArrow(_schema_rows, "owner string, member string, n long, repeated boolean, nested boolean")
    return parts.groupBy("owner", "member").agg(F.sum("n").alias("n"), F.max("repeated").alias("repeated"), F.max("nested").alias("nested"))


def mapping(graph: DataFrame) -> DataFrame:
    """What shared inlining makes of a schema graph: (member, place) with place ``table`` or ``inlined``.

    Sharing and repetition are aggregates over the edges; recursion closes the (small) graph of member names by a loop of joins.
    """
    nested = graph.where("nested")
    own = nested.groupBy("member").agg(F.max("repeated").alias("repeated"), F.countDistinct("owner").alias("owners"))
    reach = nested.select("owner", "member").distinct()
    edges = reach.select(F.col("owner").alias("member"), F.col("member").alias("next"))
    n = -1
    while (m := reach.count()) != n:
        n = m
        reach = reach.union(reach.join(edges, "member").select("owner", F.col("next").alias("member"))).distinct()
    loops = reach.where("owner = member").select("member", F.lit(True).alias("recursive"))
    return own.join(loops, "member", "left").select("member", F.when(F.col("repeated") | (F.col("owners") > 1) | F.coalesce("recursive", F.lit(False)), "table").otherwise("inlined").alias("place"))


def members(value: object, name: str) -> Iterator[object]:
    """Every value of a member called name, wherever it stands, also inside another of that name, outer ones first."""
    stack = [value]
    while stack:
        v = opened(stack.pop())
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k == name:
                    yield opened(x)
            stack += reversed(list(v.values()))


def elements(value: object) -> list:
    """The elements of an array; one object is an array of one; nothing else has any."""
    v = opened(value)
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


@dataclass
class TableRow:
    """A row that the mapping makes: its table, its number there within the record, its position in the array it stands
    in, the path of inlined members from the row that owns it, that row, and the element itself."""

    table: str
    number: int
    position: int
    path: str
    owner: "TableRow | None"
    element: object


def table_rows(value: object, tables: frozenset[str]) -> Iterator[TableRow]:
    """The rows of all tables in a JSON value, with the row that owns each; null elements are numbered, but give no row.

    The members of an object are numbered before what is further inside; an element may hold others of its own table.
    """
    numbers: dict[str, int] = defaultdict(int)
    stack: list[tuple[object, TableRow | None, str]] = [(value, None, "")]
    while stack:
        v, owner, path = stack.pop()
        v = opened(v)
        inner: list[tuple[object, TableRow | None, str]] = []
        if isinstance(v, list):
            inner = [(x, owner, path) for x in v]
        elif isinstance(v, dict):
            for k, x in v.items():
                x = opened(x)
                name = f"{path}.{k}" if path else k
                if k not in tables:
                    if isinstance(x, dict | list):
                        inner.append((x, owner, name))
                    continue
                for position, e in enumerate(elements(x)):
                    e = opened(e)
                    number = numbers[k]
                    numbers[k] += 1
                    if e is not None:
                        row = TableRow(k, number, position, name, owner, e)
                        yield row
                        if isinstance(e, dict | list):
                            inner.append((e, row, "" if isinstance(e, dict) else "$"))
        stack += reversed(inner)


def flat_json(df: DataFrame, keys: list[str], column: str, outer: str, inner: str, columns: dict[str, Callable[[dict, dict], object]], schema: str, tables: list[str] | None = None) -> DataFrame:
    """The table of ``inner`` objects that are members of ``outer`` objects: keys, positions of both, and inlined columns.

    tables are the members that the mapping gives a table; outer and inner have one in any case, also where the data show
    them only once. schema gives the types of the inlined columns; outer_pos is the number of the owning row in its
    record, inner_pos the position in its array.
    """
    own = frozenset((*(tables or ()), outer, inner))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, outs, ins, vals = [], [], [], {c: [] for c in columns}
            for i, text in enumerate(b[column]):
                if text is None or (outer not in text or inner not in text) and "\\u" not in text:
                    continue  # neither member is there, however it is written
                for r in table_rows(parsed(text), own):
                    if r.table == inner and r.path == inner and r.owner is not None and r.owner.table == outer and isinstance(r.element, dict):
                        at.append(i)
                        outs.append(r.owner.number)
                        ins.append(r.position)
                        for c, get in columns.items():
                            vals[c].append(get(r.owner.element, r.element))
            out = b.iloc[at][keys].reset_index(drop=True)
            out["outer_pos"], out["inner_pos"] = pd.Series(outs, dtype="int32"), pd.Series(ins, dtype="int32")
            for c in columns:
                out[c] = pd.Series(vals[c], dtype=object)
            yield out

    types = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}
    full = ", ".join([f"{k} {t}" for k, t in types.items()] + ["outer_pos int, inner_pos int"] + ([schema] if schema else []))
    return df.select(*keys, column).where(F.col(column).isNotNull()).mapInPandas(rows, full)


def tables_of(df: DataFrame, column: str) -> list[str]:
    """The members of a JSON column that the mapping gives a table; there are as many as the schema has names."""
    return sorted(x.member for x in mapping(cut_schema(df, column)).where("place = 'table'").collect())


def flat_tables(df: DataFrame, keys: list[str], column: str, root: str, tables: list[str]) -> DataFrame:
    """Rows of ``root`` members, wherever they stand, and of every member below them that is one of ``tables``.

    (keys, member, positions, columns): member is the path of names from root, positions the place at each table on that
    path, columns (name, value) what is inlined, as text. Nothing is dropped: what has no table of its own is inlined
    under its dotted path, arrays of plain values as JSON; an element that is no object has its value as column ``$``.
    """
    own = frozenset(tables) | {root}
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, places, inlined = [], [], [], []
            for i, j in enumerate(b.column(column).to_pylist()):
                if root not in j and "\\u" not in j:
                    continue
                todo, o = [], 0
                for member in members(parsed(j), root):
                    found = elements(member)
                    todo += [(root, (o + k,), x) for k, x in enumerate(found)]
                    o += len(found)
                todo.reverse()
                while todo:
                    path, pos, e = todo.pop()
                    e = opened(e)
                    if e is None:
                        continue
                    columns, inner = [], []
                    stack = [("", e)]
                    while stack:
                        name, v = stack.pop()
                        v = opened(v)
                        last = name.rsplit(".", 1)[-1]
                        if name and last in own and (isinstance(v, dict) or isinstance(v, list) and any(isinstance(opened(x), dict | list) for x in v)):
                            inner += [(f"{path}.{name}", (*pos, k), x) for k, x in enumerate(elements(v))]
                        elif isinstance(v, dict):
                            stack += reversed([(f"{name}.{k}" if name else k, x) for k, x in v.items()])
                        elif v is not None:
                            columns.append((name or "$", text(v)))
                    todo += reversed(inner)
                    at.append(i)
                    paths.append(path)
                    places.append(pos)
                    inlined.append([{"name": n, "value": v} for n, v in columns])
            kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
            own_rows = [b.column(k).take(pa.array(at, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own_rows, pa.array(paths, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(inlined, kind)], names=[*keys, "member", "positions", "columns"])

    types = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}
    full = ", ".join([f"{k} {t}" for k, t in types.items()] + ["member string, positions array<int>, columns array<struct<name: string, value: string>>"])
    return df.select(*keys, column).where(F.col(column).isNotNull()).mapInArrow(rows, full)


def flat_lines(df: DataFrame, keys: list[str], lines: str) -> DataFrame:
    """Lines with their positions, those without spans included; the line stays as a struct."""
    return df.select(*keys, F.posexplode(lines).alias("line_pos", "line")).where("line is not null")


def flat_spans(df: DataFrame, keys: list[str], lines: str, spans: str) -> DataFrame:
    """Spans below lines with the positions of both, from typed arrays; line and span stay as structs."""
    a = df.select(*keys, F.posexplode(lines).alias("outer_pos", "line")).where("line is not null")
    return a.select(*keys, "outer_pos", "line", F.posexplode(f"line.{spans}").alias("inner_pos", "span")).where("span is not null")


def cut_schema(df: DataFrame, column: str) -> DataFrame:
    """The schema graph, written once, as the mapping reads it several times."""
    from papyrine.operators.common import cut

    return cut(schema_graph(df, column))
