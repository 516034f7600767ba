"""Formulas in text and TeX: detection, splitting, plain reading, alignment. Arrow functions where an order of matching
or a stack decides; everything else is in ``functions.latex``.

Defined results: null and empty text gives no formulas; text of any length is read whole; ties go to what comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.graph import limited_edges
from papyrine.operators.reading import plain

#: Environments whose body is displayed mathematics; fixed names.
ENVIRONMENTS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath")
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(%s)\*?\}(.+?)\\end\{\3\*?\}" % "|".join(ENVIRONMENTS), re.S)
_INLINE = re.compile(r"\\\((.+?)\\\)|(?<![\\$])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\$])\$(?![\d$])", re.S)
_SIDE = r"[A-Za-zα-ωΑ-Ω0-9_.()√/·+\- ]"
_RELATION = re.compile(rf"(?<![\w.])((?:[A-Za-zα-ω](?:_\d+)?)(?:\([A-Za-zα-ω_\d]+\))?)\s*(=|<|>|≤|≥)\s*((?:[A-Za-zα-ω](?:_\d+)?|\d+(?:\.\d+)?|√\([^()]{{1,40}}\))(?:\s*[-+·/]\s*|\s+)?(?:(?:[A-Za-zα-ω](?:_\d+)?|\d+(?:\.\d+)?)(?![A-Za-zα-ω]))?(?:\s*[-+·/]\s*(?:[A-Za-zα-ω](?:_\d+)?|\d+(?:\.\d+)?)(?![A-Za-zα-ω]))?)")
#: Confidence of each stage of detection; fixed values.
STAGES = {"block": 0.82, "inline": 0.78, "prose": 0.72}


def detect(text: str | None) -> list[tuple[int, str, str, float]]:
    """(start, stage, latex, confidence) of the formulas of a text: displayed, inline, then relations in prose."""
    if not text:
        return []
    found, taken = [], []

    def add(m: re.Match, stage: str) -> None:
        if any(m.start() < e and s < m.end() for s, e in taken):
            return
        body = next((g for g in reversed(m.groups()) if g), "") if stage != "prose" else m.group()
        body = body.strip()
        if body:
            taken.append(m.span())
            found.append((m.start(), stage, body, STAGES[stage]))

    for m in _DISPLAY.finditer(text):
        add(m, "block")
    for m in _INLINE.finditer(text):
        add(m, "inline")
    for m in _RELATION.finditer(text):
        add(m, "prose")
    return sorted(found)


def detected(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, start, stage, latex, confidence), each formula of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                own = detect(t)
                at += [i] * len(own)
                rows += own
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(len(keys))], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=[*keys, "start", "stage", "latex", "confidence"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, F.col(text).cast("string")).mapInArrow(run, f"{types}, start int, stage string, latex string, confidence double")


def split_top(latex: str, at: str) -> list[str]:
    """Parts between characters of ``at`` that stand outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(latex):
        if c in "({[":
            depth += 1
        elif c in ")}]":
            depth = max(0, depth - 1)
        elif depth == 0 and c in at:
            out.append(latex[start:i].strip())
            start = i + 1
    out.append(latex[start:].strip())
    return [x for x in out if x]


#: Commands that stand between operands; fixed values.
BETWEEN = ("\\cdot", "\\times", "\\circ", "\\cdots", "\\dots", "\\ldots")


def operands(latex: str) -> list[str]:
    """Operands of an expression: parts between plus, minus and the commands of ``BETWEEN`` outside all brackets."""
    x = re.sub(r"\\(?:quad|qquad|,|;|:|!)\s*", " ", re.sub(r"\\(?:left|right)(?![A-Za-z])", "", latex))
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\\[A-Za-z]+|\\.|[{}()\[\]]|[+-]", x, re.S):
        c = m.group()
        if c in "{[(":
            depth += 1
        elif c in "}])":
            depth = max(0, depth - 1)
        elif depth == 0 and (c in ("+", "-") or c in BETWEEN):
            out.append(x[start : m.start()].strip())
            start = m.end()
    out.append(x[start:].strip())
    return [p for p in out if p]


def rows_of(latex: str) -> list[str]:
    """Rows of a formula of several lines, without the environment around them."""
    x = re.sub(r"\\(?:begin|end)\{(?:cases|aligned|array)\}", "", latex)
    return [r.strip() for r in re.split(r"(?<!\\)\\\\", x) if r.strip()]


def fragments(latex: str | None) -> list[tuple[str, str, str, str]]:
    """(id, parent, role, text) of a formula's tree: its rows, the sides of each, their operands (twelve at most)."""
    out: list[tuple[str, str, str, str]] = []
    rows = rows_of(latex or "")
    for i, row in enumerate(rows):
        parent = ""
        if len(rows) > 1:
            parent = f"row_{i + 1}"
            out.append((parent, "", "row", row))
        sides = split_top(row, "=")
        named = [("lhs", sides[0]), *[(f"rhs_{k}" if k > 1 else "rhs", s) for k, s in enumerate(sides[1:], 1)]] if len(sides) > 1 else [("", row)]
        for side, text in named:
            owner = f"{parent}.{side}".strip(".")
            if side:
                out.append((owner, parent, side[:3], text))
            parts = operands(text)
            if len(parts) > 1:
                out += [(f"{owner}.op_{k}".strip("."), owner, "operand", p) for k, p in enumerate(parts[:12], 1)]
    return out


def balanced(latex: str) -> bool:
    """Whether braces close in order, escaped ones aside."""
    depth = 0
    for m in re.finditer(r"\\.|[{}]", latex, re.S):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth < 0:
                return False
    return depth == 0


def described(df: DataFrame, keys: list[str], latex: str) -> DataFrame:
    """(keys, plain, left_side, right_side, operands, balanced, sanity) of each formula."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b[latex]:
                x = x or ""
                sides = split_top(x, "=")
                ok = balanced(x)
                warnings = (not ok) + (not x.strip()) + (len(x) > 700)
                rows.append((plain(x), sides[0] if len(sides) == 2 else None, sides[1] if len(sides) == 2 else None, operands(sides[-1])[:12] if sides else [], ok, max(0.0, round(1 - 0.18 * warnings, 2))))
            out = b[keys].reset_index(drop=True)
            out[["plain", "left_side", "right_side", "operands", "balanced", "sanity"]] = pd.DataFrame(rows, index=out.index, columns=range(6))
            yield out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, latex).mapInPandas(run, f"{types}, plain string, left_side string, right_side string, operands array<string>, balanced boolean, sanity double")


#: Commands that are spelled out, or dropped, before formulas are compared; fixed values.
SPELLED = {
    "\\varphi": "phi", "\\phi": "phi", "\\psi": "psi", "\\omega": "omega", "\\xi": "xi", "\\alpha": "alpha", "\\theta": "theta", "\\mathbb": "", "\\mathbf": "", "\\mathrm": "", "\\left": "", "\\right": "",
    "\\cdots": "...", "\\dots": "...", "\\cup": "cup", "\\cap": "cap", "\\in": "in",
}


def match_key(latex: str) -> str:
    """What two formulas are compared by: lower case, some commands spelled out, others and all but plain signs dropped."""
    x = latex.lower()
    for command, word in SPELLED.items():
        x = x.replace(command, word)
    return re.sub(r"[^a-z0-9=<>+\-*/_^{}().,]+", "", re.sub(r"\\[a-z]+", "", x))


def similarity(a: str, b: str) -> float:
    """0.65 of the matching share of characters and 0.35 of the shared share of words, numbers and signs; 0 if either is empty."""
    a, b = match_key(a), match_key(b)
    if not a or not b:
        return 0.0
    wa, wb = (set(re.findall(r"[a-z]+|\d+|[=<>+\-*/_^]", x)) for x in (a, b))
    return 0.65 * SequenceMatcher(None, a, b).ratio() + 0.35 * len(wa & wb) / max(1, len(wa | wb))


#: Least similarity of formulas of one kind that are taken for the same; fixed values.
LEAST_INLINE, LEAST_DISPLAY = 0.42, 0.28


def aligned(read: DataFrame, tex: DataFrame) -> DataFrame:
    """(document_id, section_id, read_id, tex_id, score): greedy one-to-one match of recognised formulas to TeX ones.

    read and tex have document_id, section_id, id, kind, latex. Candidates are of one kind and section and share a word;
    each pair is scored where it lies, and who is taken, best score first, is decided in rounds by single formulas, never
    by whole sections. Formulas without a partner are left out.
    """
    words = lambda df, name: df.where("latex is not null").select("document_id", "section_id", "kind", F.col("id").alias(f"{name}_id"), F.col("latex").alias(f"{name}_latex"), F.explode(F.array_distinct(F.regexp_extract_all("latex", F.lit(r"(\\[A-Za-z]+|[A-Za-z0-9_]+)"), 1))).alias("w"))
    pairs = words(read, "read").join(words(tex, "tex"), ["document_id", "section_id", "kind", "w"]).drop("w").distinct()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p["score"] = [round(similarity(a, b), 6) for a, b in zip(p["read_latex"], p["tex_latex"], strict=True)]
            yield p[["document_id", "section_id", "kind", "read_id", "tex_id", "score"]]

    own = pairs.mapInPandas(scored, "document_id string, section_id string, kind string, read_id string, tex_id string, score double")
    own = own.where(F.col("score") >= F.when(F.col("kind") == "display_math", LEAST_DISPLAY).otherwise(LEAST_INLINE))
    edges = own.select("document_id", F.concat(F.lit("read:"), "read_id").alias("source_id"), F.concat(F.lit("tex:"), "tex_id").alias("target_id"), (-F.col("score")).alias("place"), "section_id", "read_id", "tex_id", "score")
    return limited_edges(edges, "document_id", ["place", "source_id", "target_id"], 1).select("document_id", "section_id", "read_id", "tex_id", "score")


def tex_events(df: DataFrame, key: str, tex: str) -> DataFrame:
    """(key, pos, kind, level, text) of a TeX source in order: sections, displayed and inline formulas, text between.

    Comments are dropped; an event inside one that began before it is skipped.
    """

    def events(source: str) -> list[tuple[int, str, int, str]]:
        t = re.sub(r"(?m)(?<!\\)%.*$", "", source)
        m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", t, re.S)
        t = m.group(1) if m else t
        levels = {"part": 0, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
        marks = [(m.start(), m.end(), "section", levels[m.group(1)], m.group(2)) for m in re.finditer(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", t)]
        marks += [(m.start(), m.end(), "display", 0, (m.group(1) or m.group(2) or m.group(4)).strip()) for m in _DISPLAY.finditer(t)]
        marks += [(m.start(), m.end(), "inline", 0, (m.group(1) or m.group(2)).strip()) for m in _INLINE.finditer(t)]
        out, end = [], 0
        for a, b, kind, level, body in sorted(marks):
            if a < end:
                continue
            if t[end:a].strip():
                out.append(("text", 0, re.sub(r"\s+", " ", t[end:a]).strip()))
            out.append((kind, level, body))
            end = b
        if t[end:].strip():
            out.append(("text", 0, re.sub(r"\s+", " ", t[end:]).strip()))
        return [(i, *x) for i, x in enumerate(out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *e) for k, t in zip(b[key], b[tex], strict=True) if t for e in events(t)]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "level", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tex).mapInPandas(run, f"{key} {kind}, pos int, kind string, level int, text string")


def line_clusters(items: DataFrame, schema: str) -> DataFrame:
    """Items of a page put together to lines: sorted by centre and left edge, an item joins the line whose height it
    overlaps by 45 %. Works page by page, as lines grow."""

    def page(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(cy=(p["y0"] + p["y1"]) / 2).sort_values(["cy", "x0", "block_id"])
        lines: list[list[float]] = []
        no = []
        for y0, y1 in zip(p["y0"], p["y1"], strict=True):
            h = max(1.0, y1 - y0)
            k = next((i for i, (a, b) in enumerate(lines) if (min(y1, b) - max(y0, a)) / min(h, max(1.0, b - a)) >= 0.45), -1)
            if k < 0:
                lines.append([y0, y1])
                k = len(lines) - 1
            else:
                lines[k] = [min(lines[k][0], y0), max(lines[k][1], y1)]
            no.append(k + 1)
        return p.assign(line=no)[["document_id", "page_number", "block_id", "line"]]

    flat = items.where("bbox is not null").select("document_id", "page_number", "block_id", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return flat.groupBy("document_id", "page_number").applyInPandas(page, schema)


def proximity_groups(items: DataFrame, schema: str) -> DataFrame:
    """Fragments of a page that lie close (22 down, 120 across), transitively: components of closeness, page by page."""

    def page(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block_id")
        box = p[["x0", "y0", "x1", "y1"]].to_numpy(float)
        root = list(range(len(p)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        order = box[:, 1].argsort(kind="stable")
        for n, i in enumerate(order):
            for j in order[n + 1 :]:
                if box[j, 1] - box[i, 3] > 22:
                    break
                if max(box[i, 0], box[j, 0]) - min(box[i, 2], box[j, 2]) <= 120:
                    a, b = find(int(i)), find(int(j))
                    root[max(a, b)] = min(a, b)
        return p.assign(group=[find(i) + 1 for i in range(len(p))])[["document_id", "page_number", "block_id", "group"]]

    flat = items.where("bbox is not null").select("document_id", "page_number", "block_id", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return flat.groupBy("document_id", "page_number").applyInPandas(page, schema)


def macros(tex: str) -> dict[str, str]:
    r"""Macros without arguments that a source defines: \newcommand, \renewcommand, \def."""
    out = {}
    for m in re.finditer(r"\\(?:re)?newcommand\*?\{?(\\[A-Za-z]+)\}?\{((?:[^{}]|\{[^{}]*\})*)\}|\\def(\\[A-Za-z]+)\{((?:[^{}]|\{[^{}]*\})*)\}", tex):
        out[m.group(1) or m.group(3)] = m.group(2) if m.group(1) else m.group(4)
    return out


def expanded(tex: str, known: dict[str, str], rounds: int = 5) -> str:
    """Macros put in, longest names first, a few rounds deep."""
    for _ in range(rounds):
        new = tex
        for name in sorted(known, key=len, reverse=True):
            new = re.sub(re.escape(name) + r"(?![A-Za-z])", lambda m, name=name: known[name], new)
        if new == tex:
            break
        tex = new
    return tex


def stays_in_text(latex: str) -> bool:
    """Tiny inline mathematics that reads as text: up to 24 characters, no relation, no command."""
    return len(latex) <= 24 and not re.search(r"[=<>]|\\[A-Za-z]", latex)


def inlined(text: str) -> str:
    """Text with its tiny inline mathematics as plain characters."""
    return _INLINE.sub(lambda m: re.sub(r"[{}^_]", "", m.group(1) or m.group(2)) if stays_in_text(m.group(1) or m.group(2)) else m.group(), text)
