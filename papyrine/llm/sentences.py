"""Sentence units of texts in many languages and scripts, by a hidden-event n-gram model.

Between two words there may or may not be a hidden boundary event. The model says how likely an event is after what
stands to the left (last word and closing mark), and how likely the next two words are with and without it. It is
counted over all texts: beginnings and ends of fields and lines are certain events, every other place with a closing
mark, or with a space in a script that does not mark its sentences, is hidden and gets its share by expectation
maximisation. How sentences begin is counted at the certain events only, so that what merely follows abbreviations is
never learnt as a beginning. All places of a line are decided together by forward-backward sums over a chain of two
states, in which a place right after an event is made less likely where the word between is a stub of one or two
letters (a fixed factor, not a counted one). A place is a boundary if its posterior exceeds one half.

Fixed by the definition of a sentence, not by the model: a line end is a boundary; nothing inside brackets or quotation
marks that close on the same line is one; a mark between two digits, or between letters of one word, is none.

Defined results
* null and blank texts have no sentences; a line without any mark is one sentence
* the end of a sentence is a number of characters (code points) from the start of the text, closing marks included
* rows delivered again give the same rows once; texts of any length are read whole
* the model counts every context of all texts, those seen once too, whatever the size of the input
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
DISCOUNT = 2.0
#: A sentence of nothing but a stub of so many letters is so much less likely.
STUB, STUB_FACTOR = 2, 0.25

_NO_SPACES = "぀-ヿ㐀-鿿豈-﫿"
_THAI = "฀-໿ក-៿"
_OPEN = {"(": ")", "（": "）", "[": "]", "«": "»", "„": "“”\"", "“": "”", "「": "」", "『": "』", "《": "》"}
_CLOSE = set(")）]»”」』》")
_MARKS = ".!?…。！？｡।॥؟۔"
_EVENT = re.compile(
    f"(?P<mark>[{_MARKS}]+)(?P<closers>[)\\]»”“\"」』》）]*)|(?P<line>\\s*\n\\s*)|(?P<space>(?<=[{_THAI}\\d])[  ]+(?=[{_THAI}]))|(?P<bracket>[(（\\[«„“\"「『《)）\\]»”」』》])"
)
_RIGHT = re.compile(f"\\s*(?:([{_THAI}]{{1,4}})[{_THAI}]*|([{_NO_SPACES}]{{1,2}})|(\\d[\\d.,]*\\d|\\d)|([^\\W\\d_{_NO_SPACES}{_THAI}]+)|(\\S))")
END, START, HIDDEN = 0, 1, 2


def _token(m: re.Match | None) -> str:
    if m is None:
        return ""
    return "0" if m.group(3) else m.group().strip() if not m.group(1) else m.group(1)


def right_words(text: str, at: int) -> tuple[str, str]:
    a = _RIGHT.match(text, at)
    if a is None:
        return "", ""
    return _token(a), _token(_RIGHT.match(text, a.end()))


_LAST_SCRIPT = re.compile(f"[{_THAI}]{{1,4}}$|[{_NO_SPACES}]{{1,2}}$")


def left_word(text: str, at: int) -> str:
    """The word that ends at a place, white space aside, of any length."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    if not at:
        return ""
    c = text[at - 1]
    if c.isdigit() or c in ".,":
        i = at - 1
        while i > 0 and (text[i - 1].isdigit() or text[i - 1] in ".,"):
            i -= 1
        return "0" if any(x.isdigit() for x in text[i:at]) else c
    m = _LAST_SCRIPT.search(text, max(0, at - 4), at)
    if m:
        return m.group()
    i = at - 1
    while i > 0 and c.isalpha() and text[i - 1].isalpha() and not _SCRIPT.match(text[i - 1]):
        i -= 1
    return text[i:at]


_SCRIPT = re.compile(f"[{_THAI}{_NO_SPACES}]")


def shape(w: str) -> str:
    if not w:
        return "<end>"
    c = w[0]
    if c == "0":
        return "0"
    if not c.isalpha():
        return "<mark>"
    if c.isupper():
        return "<I>" if len(w) == 1 else "<Caps>" if w.isupper() else "<Cap>"
    return "<one>" if len(w) == 1 and c.islower() else "<low>" if c.islower() else "<script>"


def places(text: str) -> list[tuple]:
    """Candidates in order: (end, kind, left word, mark, right word, second right word); kind END is a line's end."""
    out: list[tuple] = []
    stack: list[tuple[str, int, int]] = []
    n = len(text)
    start = keep = 0

    def scan(a: int, b: int, ignore: frozenset[int]) -> bool:
        """Candidates of text[a:b], one line; False if a bracket stays open."""
        stack.clear()
        del out[keep:]
        for m in _EVENT.finditer(text, a, b):
            kind = m.lastgroup
            p = m.start()
            if kind == "space":
                if not stack:
                    out.append((p, HIDDEN, left_word(text, p), "_", *right_words(text, m.end())))
                continue
            tail = m.group() if kind == "bracket" else ""
            depth_before, mark_end = len(stack), p
            if kind != "bracket":
                kind = "mark"  # the group of closers is the last to match
            if kind == "mark":
                tail = m.group("closers") or ""
                e = m.end()
                mark_end = e - len(tail)
            q = p if not tail else m.end() - len(tail)
            used = 0
            for i, c in enumerate(tail):
                if q + i in ignore:
                    continue
                if stack and c in stack[-1][0]:
                    stack.pop()
                elif c == '"':
                    if kind == "mark" and any(c in s[0] for s in stack):
                        while stack and c not in stack[-1][0]:
                            stack.pop()
                        stack.pop()
                    elif kind == "bracket" or not depth_before:
                        if kind == "mark":  # an opening quotation mark right after a mark belongs to what follows
                            stack.append(('"', q + i, 0))
                            break
                        stack.append(('"', q + i, 0))
                elif c in _OPEN and c != "“":
                    stack.append((_OPEN[c], q + i, 0))
                elif c == "“":
                    stack.append(("”", q + i, 0))
                    if kind == "mark":
                        break
                elif c in _CLOSE and any(c in s[0] for s in stack):
                    while stack and c not in stack[-1][0]:
                        stack.pop()
                    stack.pop()
                used = i + 1
            if kind != "mark" or stack:
                continue
            e = mark_end + used
            if e >= b:
                continue
            before, after = text[p - 1] if p > a else " ", text[e]
            mark = text[p:e]
            if not after.isspace() and mark[0] in ".!?…":
                if before.isdigit() and after.isdigit():
                    continue
                if mark == "." and (after.islower() or after in "_/@") and (p < 2 or not text[p - 2].isalpha() or len(left_word(text, p)) < 2):
                    continue
                if mark[-1] == ".":  # no space after a full stop says something, after other marks it does not
                    mark += "~"
            out.append((e, HIDDEN, left_word(text, p), mark, *right_words(text, e)))
        return not stack

    while start < n:
        stop = text.find("\n", start)
        stop = n if stop < 0 else stop
        line_end = stop
        while line_end > start and text[line_end - 1].isspace():
            line_end -= 1
        if line_end > start:
            keep = len(out)
            ignore: set[int] = set()
            while not scan(start, line_end, frozenset(ignore)):
                # The outermost is never closed; of many, the outer half is given up at once.
                ignore.update(x[1] for x in stack[: max(1, len(stack) // 2 if len(stack) > 20 else 1)])
            mark = text[_tail(text, start, line_end) : line_end]
            out.append((line_end, END, left_word(text, line_end - len(mark)), mark, *right_words(text, start)))
        start = stop + 1
    return out


_CLOSERS = frozenset(")]»”“\"」』》）")


def _tail(text: str, start: int, end: int) -> int:
    """Where the closing marks at the end of a line begin, or its end if it has none."""
    i = end
    while i > start and text[i - 1] in _CLOSERS:
        i -= 1
    k = i
    while k > start and text[k - 1] in _MARKS:
        k -= 1
    return k if k < i else end


def script(w: str) -> int:
    """Which alphabet a word is of, as far as code blocks tell; 0 for numbers, marks and nothing."""
    if not w or not w[0].isalpha():
        return 0
    block = ord(w[0]) >> 8
    return 1 if block <= 2 else 0x30 if 0x30 <= block <= 0x9F else 4 if block == 5 else block


class Model:
    """Counts of events with what stands left and right of them, on words and on their shapes.

    Words are counted within their alphabet, so that a language of few texts is not outweighed by one of many.
    """

    def __init__(self, contexts: list[tuple], rounds: int = ROUNDS):
        """contexts: (kind, left, mark, right, second, n) as ``contexts_of`` gives them, with their counts."""
        unigram: Counter = Counter()
        for k, _, _, r, _, n in contexts:
            if k != END:
                unigram[r] += n
        by_shape: Counter = Counter()
        for w, n in unigram.items():
            by_shape[shape(w), script(w)] += n
        # How much of its shape a word makes up; a word never seen is as rare as one seen half a time.
        self.part = {w: n / by_shape[shape(w), script(w)] for w, n in unigram.items()}
        self.rare = {k: 0.5 / (n + 1) for k, n in by_shape.items()}
        hidden = [c for c in contexts if c[0] == HIDDEN]
        post = np.array([self._first_guess(c) for c in hidden])
        for _ in range(rounds):
            self._count(contexts, hidden, post)
            post = np.array([self.posterior(*c[1:5]) for c in hidden])
        self._count(contexts, hidden, post)

    @staticmethod
    def _first_guess(c: tuple) -> float:
        _, left, mark, right, _, _ = c
        if mark == "_":
            return 0.3
        s = shape(right)
        if s in ("<low>", "<mark>") and right not in ("[", "¿", "¡", "«", "“", '"', "„", "「"):
            return 0.02
        if mark[:1] in "。！？｡।॥؟۔":
            return 0.85
        if len(left) == 1 and left != "0":
            return 0.3
        return 0.7 if s in ("<Cap>", "<Caps>", "<script>") else 0.4

    def _count(self, contexts: list[tuple], hidden: list[tuple], post: np.ndarray) -> None:
        self.event: dict = {}  # left side -> [with event, all]
        self.after: dict = {}  # event or left side -> words to the right
        self.sums: dict = {}
        for k, l, m, r, s, n in contexts:
            if k == END:
                self._see(l, m or "_", n, n)
            elif k == START:
                self._follow("S", "", "", r, s, n)
        for (_, l, m, r, s, n), p in zip(hidden, post.tolist(), strict=True):
            self._see(l, m, n * p, n)
            self._follow("0", m, l, r, s, n * (1 - p))
        for h, t in self.after.items():
            self.sums[h] = (sum(t.values()), 1 + 0.5 * sum(min(1.0, v) for v in t.values()))
        self.memo: dict = {}

    def _follow(self, event: str, mark: str, left: str, r: str, s: str, n: float) -> None:
        g, sh = script(r), shape(r)
        for h, w in (((event, mark, g), r), ((event, "any", g), r), ((event, mark, shape(left), "shape", g), sh), ((event, mark, "letter"), g > 0), ((event, "second", r), s), ((event, "second", sh, g), shape(s))):
            t = self.after.setdefault(h, {})
            t[w] = t.get(w, 0.0) + n

    def _see(self, left: str, mark: str, with_event: float, n: float) -> None:
        for h in ((left, mark), (shape(left), mark, "shape"), (mark, "mark")):
            e = self.event.setdefault(h, [0.0, 0.0])
            e[0] += with_event
            e[1] += n

    def _p_event(self, left: str, mark: str) -> float:
        p, strength = 0.5, 1.0
        for h in ((mark, "mark"), (shape(left), mark, "shape"), (left, mark)):
            e = self.event.get(h)
            if e is not None:
                p = (e[0] + strength * p) / (e[1] + strength)
            strength = 4.0
        return min(max(p, 1e-5), 1 - 1e-5)

    def _p(self, words: list[tuple], shapes: tuple, w: str, g: int) -> float:
        """Probability of w: its history, backed off to its shape times its part of the shape."""
        sh = shape(w)
        t = self.after.get(shapes)
        q = (t.get(sh, 0.0) + 0.5) / (self.sums[shapes][0] + 5) if t else 0.1
        q *= self.part.get(w) or self.rare.get((sh, g), 0.5)
        for h in words:
            t = self.after.get(h)
            if t:
                n, back = self.sums[h]
                # Counts without an event are discounted, lest a context seen once supports itself.
                q = (max(0.0, t.get(w, 0.0) - (DISCOUNT if h[0] == "0" else 0.0)) + back * q) / (n + back)
        return q

    def _follows(self, event: str, mark: str, left: str, r: str, s: str) -> float:
        g = script(r)
        h = (event, mark, "letter")
        kind = (self.after[h].get(g > 0, 0.0) + 0.5) / (self.sums[h][0] + 1) if h in self.after else 0.5
        return kind * self._p([(event, "any", g), (event, mark, g)] if mark else [(event, "any", g)], (event, mark, shape(left), "shape", g), r, g) * self._p([(event, "second", r)], (event, "second", shape(r), g), s, script(s))

    def posterior(self, left: str, mark: str, right: str, second: str) -> float:
        key = (left, mark, right, second)
        known = self.memo.get(key)
        if known is None:
            e = self._p_event(left, mark)
            yes = e * self._follows("S", "", "", right, second)
            no = (1 - e) * self._follows("0", mark, left, right, second)
            known = yes / (yes + no) if yes + no > 0 else 0.0
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[key] = known
        return known

    def ends(self, text: str) -> list[int]:
        """Ends of the sentences of a text."""
        out, run = [], []
        for c in places(text):
            if c[1] == END:
                out += self._decide(text, run)
                run = []
                out.append(c[0])
            else:
                run.append(c)
        return out + self._decide(text, run)

    def _decide(self, text: str, run: list[tuple]) -> list[int]:
        if not run:
            return []
        if len(run) == 1:
            c = run[0]
            return [c[0]] if self.posterior(*c[2:6]) > 0.5 else []
        # Forward-backward over the places of the line: if the one before is an event, the left word begins a sentence.
        odds = []
        for i, c in enumerate(run):
            p = self.posterior(*c[2:6])
            after = p
            if i and len(c[2]) <= STUB and c[2] == run[i - 1][4] and len(text[run[i - 1][0] : c[0]].split()) == 1:
                after = p * STUB_FACTOR  # nothing but this stub stands between the place before and this one
            odds.append((p, after))
        f = [(1 - odds[0][0], odds[0][0])]
        for p, after in odds[1:]:
            n0, n1 = f[-1]
            x, y = n0 * (1 - p) + n1 * (1 - after), n0 * p + n1 * after
            f.append((x / (x + y), y / (x + y)))
        b = [(1.0, 1.0)]
        for p, after in reversed(odds[1:]):
            b0, b1 = b[-1]
            x, y = (1 - p) * b0 + p * b1, (1 - after) * b0 + after * b1
            b.append((x / (x + y), y / (x + y)))
        b.reverse()
        return [c[0] for c, (f0, f1), (b0, b1) in zip(run, f, b, strict=True) if f1 * b1 > f0 * b0]


def contexts_of(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    """What the model counts of a text: (kind, left, mark, right, second) of hidden places, and of each line its end (left
    and mark) and its start (right and second) apart, as neither is ever asked for together with the other."""
    for _, kind, left, mark, right, second in places(text):
        if kind == END:
            yield END, left, mark, "", ""
            yield START, "", "", right, second
        else:
            yield kind, left, mark, right, second


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        cols = list(zip(*counts, strict=True)) if counts else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]], pa.array(list(counts.values()), pa.int64())], names=["kind", "l", "m", "r", "s", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                counts.update(contexts_of(t))
        if len(counts) > 300_000:
            yield out()
            counts.clear()
    yield out()


def fit(texts: DataFrame) -> Model:
    """The model of all contexts of all texts (one string column)."""
    counts = texts.mapInArrow(_contexts, "kind int, l string, m string, r string, s string, n long").groupBy("kind", "l", "m", "r", "s").agg(F.sum("n").alias("n"))
    rows = counts.toArrow().sort_by([(c, "ascending") for c in ("kind", "l", "m", "r", "s")]).to_pydict()
    return Model(list(zip(rows["kind"], rows["l"], rows["m"], rows["r"], rows["s"], rows["n"], strict=True)))


class _Shipped:
    """What workers need of a model, without what it remembers."""

    def __init__(self, m: Model):
        self.state = {"event": m.event, "after": m.after, "sums": m.sums, "part": m.part, "rare": m.rare}

    def open(self) -> Model:
        m = Model.__new__(Model)
        m.__dict__.update(self.state)
        m.memo = {}
        return m


def sentence_ends(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """(keys, ends) with the ends of all sentences of each row's text."""
    shipped = df.sparkSession.sparkContext.broadcast(_Shipped(model))  # grows with the different contexts of the texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value.open()
        for b in batches:
            ends = [m.ends(t) if t else [] for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(ends, pa.list_(pa.int32()))], names=[*keys, "ends"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{types}, ends array<int>")


def sentences(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """(keys, sentence_no, char_start, char_end), each sentence of a record once, in order."""
    per = sentence_ends(df.where(F.col(text).isNotNull()), keys, text, model).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ends")))).alias("ends"))
    flat = per.select(*keys, "ends", F.posexplode("ends").alias("sentence_no", "char_end"))
    return flat.select(*keys, "sentence_no", F.when(F.col("sentence_no") == 0, 0).otherwise(F.expr("ends[sentence_no - 1]")).alias("char_start"), "char_end")
