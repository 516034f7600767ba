"""Repair of text from scanned pages.

A text is read as a stream of lines. Each line is body, running header or page number, by its form and by how it is
repeated; dynamic programming over the body lines chooses where paragraphs end, so that words and sentences run on across
what stands in between. The body's characters, line ends taken out, are then decoded under a unigram model of all texts:
a lattice of words spans the characters, in which a word may cover a space (added inside it), a hyphen at a line end, any
number of confused characters, or end without a space (words run together), in any combination; each of these costs, and
the cheapest path is the reading. Words are followed through the lattice letter by letter along prefixes of known words,
and a path is given up only when it costs more than the characters as they stand, so nothing is lost by the search.
Stretches in which every word is known and right by itself and no line ends with a hyphen are their own reading and are
not decoded. In scripts without spaces characters are weighed in the context of their two neighbours. A text without
findings comes out as it is.

The unigram model counts the words of all texts. What goes to the workers are the words that make up at least
``LEAST_SHARE`` of all words (and are there three times); a rarer word counts as one that has just this share.

Defined results
* null and blank texts have no findings; null stays null
* plain line breaks are no findings, nor are compounds and suspended hyphens at line ends, nor words run together
* tables of numbers (most lines are numbers) have no page numbers
* rows delivered again give the same case once; texts of any length are read whole
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.common import cut

#: Words that are less than this share of all words (one in 10^9) are no readings, and count as if they were just this.
LEAST_SHARE = 1e-9
#: A word with a space added is right if it costs so much less than its parts; so is one that was broken at a hyphen; so
#: much is added for words run together, and for parts that stand apart at a hyphen.
SPACE, HYPHEN, RUN, APART = 4.0, 0.5, 14.0, 2.0
#: A confused character must make the reading so much cheaper, besides its penalty.
MARGIN = 0.7
#: A confused character must make a word so many times as frequent.
RATIO = 25.0

#: What is printed and what is recognised instead; fixed values, by resemblance of the characters.
CONFUSIONS = {
    "e": ["c"], "c": ["e"], "o": ["0", "о"], "a": ["ɑ", "а"], "t": ["†"], "n": ["ri", "ii", "п"], "i": ["|", "í", "1", "!", "l"], "s": ["5", "$"], "l": ["1", "|", "I", "i"], "u": ["ii", "n"], "m": ["rn", "nn"], "g": ["9", "q"], "b": ["6", "8", "h"],
    "w": ["vv"], "li": ["h"], "d": ["cl"], "h": ["b", "li"], "z": ["2"], "fi": ["ﬁ"], "fl": ["ﬂ"], "в": ["8"],
    "е": ["e", "c"], "о": ["0", "o"], "а": ["a"], "р": ["p"], "с": ["c"], "х": ["x"], "у": ["y"], "и": ["н", "u"], "н": ["и"], "л": ["jт", "jt"], "ы": ["ьi", "ьl"], "ч": ["4"], "з": ["3"], "б": ["6"], "п": ["гт", "n"], "ш": ["ui", "uі"], "т": ["m"], "і": ["i", "1", "l"], "ї": ["ï"], "є": ["e"],
}
#: The same for characters of scripts without spaces.
PICTURES = {"庋": "度", "敉": "数", "糸": "系", "木": "本", "最": "量", "走": "定", "犬": "大", "末": "未", "己": "已", "昰": "是", "曰": "日", "士": "土", "入": "人", "千": "干", "夭": "天", "刀": "力", "兔": "免", "卞": "下", "闩": "门", "侍": "待", "折": "析", "治": "冶", "束": "東"}
_WRONG: dict[str, list[str]] = {}
for _right, _seen in CONFUSIONS.items():
    for _x in _seen:
        _WRONG.setdefault(_x, []).append(_right)
_HYPHEN = "-‐‑­¬"
_BREAK = re.compile(rf"([^\W\d_]+)[{_HYPHEN}][ \t]*\n[ \t]*([^\W\d_]+)")
_NO_SPACES = "฀-໿぀-ヿ㐀-鿿"
_LETTER = rf"[^\W_{_NO_SPACES}]"
_TOKEN = re.compile(rf"(?<![\w&\\\\/@#]){_LETTER}(?:{_LETTER}|[†|!$](?={_LETTER})|[̀-ًͯ-ٟऀ-෴‌‍])*+(?!_)|[†|](?:{_LETTER}){{2,}}(?!_)")
_COMPOUND = re.compile(rf"{_LETTER}+(?:[-‐‑]{_LETTER}+)+")
_ODD = re.compile(r"[^\W\d_][0-9†|!$ɑ]|[0-9†|ɑ][^\W\d_]")
_PICTURE = re.compile("(?s)([㐀-鿿぀-ヿ。，、；：？！“”0-9A-Za-zͰ-Ͽ])([" + "".join(sorted(set(PICTURES) | set(PICTURES.values()))) + "])(?=([㐀-鿿぀-ヿ。，、；：？！“”]))")
_EVERY_PICTURE = sorted(set(PICTURES) | set(PICTURES.values()))
_SPACED = re.compile(rf"(?<![^\s(«„“\"'])({_LETTER}(?:[ \n]{_LETTER}){{3,}})(?![^\s.,;:!?)»”“\"'])")

#: Forms of journal, proceedings and authors' lines of page margins, by the words they are made of.
_HEADER = re.compile(
    rf"(?ix)^(?:\d{{1,4}}\s*(?:\||\s)\s*)?(?:(?:annals|annales|anales|journal|bulletin|transactions|proceedings|review|reviews|revue|revista|archives)\s+(?:of|on|de|des|der|für|for|in)\s+\S.{{0,60}}?"
    r"|proc\.?\s+\S.*?(?:workshop|conf\.?|symposium|congress)(?:\s+\d+)?"
    r"|(?:вестник|вісник|журнал|известия)\s+«[^»\n]+»(?:,?\s*№?\s*\d+)?"
    r"|\S.*?\s(?-i:Letters|LETTERS|Journal|JOURNAL|Bulletin|BULLETIN|Proceedings|PROCEEDINGS|Transactions|TRANSACTIONS)"
    r"|[^\W\d_]\.(?:\s?[^\W\d_]\.)?\s*\S{2,}(?:\s+(?:et\s+al\.|и\s+др\.|та\s+ін\.|et\s+coll\.|y\s+cols\.|u\.\s*a\.))?\s*/\s*\S.*?)"
    r"(?:,?\s*(?:vol|no|bd|t|том|№)\.?\s*\d+)?(?:\s*\||\s)?(?:\s*\d{1,4})?\s*$"
)
_PAGE = re.compile(
    r"(?ix)^\s*(?:(?P<a>[-–—·•])\s*\d{1,4}\s*(?P=a)|\[\s+\d{1,4}\s+\]|\d{1,4}|(?:page|p\.|pp\.|pag\.|pág\.|s\.|seite|стр\.|с\.|第)\s*\d{1,4}(?:\s*页)?(?:\s*(?:of|/|von|de|из|з)\s*\d{1,5})?)\s*$"
)
_CLOSED = re.compile(r"[.!?。！？।؟…:;][\"'”’»“」』）)\]]*\s*$")
_ODD_WORD = re.compile(r"\S*[^\W\d_]\S*")
_DIGITS = str.maketrans("015|†ɑ", "oislta")


_LINE_HYPHENS = tuple(h + blank + "\n" for h in _HYPHEN for blank in ("", " ", "\t"))


def _hyphenated(text: str) -> bool:
    """Whether any line ends with a hyphen: substring search, as few lines do."""
    return "\n" in text and any(x in text for x in _LINE_HYPHENS)


def tokens(text: str) -> list[str]:
    """Lower-case words as the model counts them; what stands at a broken line end is left out."""
    return _TOKEN.findall((_BREAK.sub(" ", text) if _hyphenated(text) else text).lower())


def compounds(low: str) -> list[str]:
    """Words joined by hyphens, found from their hyphens outwards."""
    out = []
    for h in "-‐‑":
        i = low.find(h, 0)
        while i >= 0:
            if 0 < i < len(low) - 1 and low[i - 1].isalnum() and low[i + 1].isalnum():
                a = i
                while a > 0 and low[a - 1].isalnum():
                    a -= 1
                m = _COMPOUND.match(low, a)
                if m:
                    out.append(m.group())
                    i = m.end() - 1
            i = low.find(h, i + 1)
    return out


def counted(text: str) -> list[str]:
    """What the model counts of a text: words, compounds, characters with their context, and running titles."""
    out = tokens(text)
    if "-" in text or "‐" in text or "‑" in text:
        out += compounds(text.lower())
    if any(c in text for c in _EVERY_PICTURE):
        out += [f"\x01{m[0]}{m[1]}{m[2]}" for m in _PICTURE.findall(text.replace("\n", ""))]
    for x in text.split("\n"):
        x = x.strip()
        if x and (x[0].isdigit() or x[-1].isdigit()) and (form := titled(x)):
            out.append(f"\x02{form}")
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                counts.update(counted(t))
        if len(counts) > 400_000:
            yield out()
            counts.clear()
    yield out()


class Lexicon:
    """Costs of words under the unigram model, and the lattice of readings."""

    def __init__(self, counts: dict[str, int], total: float | None = None):
        self.counts = counts
        self.total = float(total or sum(n for w, n in counts.items() if w[0] > "\x02") or 1)
        self.penalty = math.log(RATIO)
        self.floor = max(1.0, self.total * LEAST_SHARE)
        #: Words seen less often may be parts of others.
        self.rare = self.total / 2e4
        #: Words that can be readings, in order, so that whether a prefix leads anywhere is a binary search.
        self.words = sorted(w for w, n in counts.items() if n >= 5 and w[0] > "\x02" and "-" not in w)
        self.prefixes: dict[str, bool] = {}
        self.memo: dict[str, list[tuple[int, int, str, frozenset[str]]]] = {}
        self.known: dict[str, bool] = {}

    def cost(self, w: str) -> float:
        """Cost of a word that stands in a text."""
        return -math.log(max(self.counts.get(w, 0), self.floor) / self.total)

    def made(self, w: str) -> float:
        """Cost of a word that is put together: one never seen costs by its length as well."""
        n = self.counts.get(w)
        return -math.log(n / self.total) if n else max(12.0, math.log(self.total)) + 0.7 * len(w)

    def leads(self, prefix: str) -> bool:
        """Whether any word begins so."""
        x = self.prefixes.get(prefix)
        if x is None:
            i = bisect_left(self.words, prefix)
            x = i < len(self.words) and self.words[i].startswith(prefix)
            if len(self.prefixes) > 500_000:
                self.prefixes.clear()
            self.prefixes[prefix] = x
        return x

    def fine(self, w: str) -> bool:
        """Whether a word is known and its own best reading."""
        x = self.known.get(w)
        if x is None:
            n = self.counts.get(w, 0)
            x = n >= 3 and (n >= self.rare or self.best(w) == w)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[w] = x
        return x

    def could_join(self, a: str, b: str) -> bool:
        """Whether two neighbours make a word far more frequent than one of them."""
        n = min(self.counts.get(a, 0), self.counts.get(b, 0))
        return n < self.rare and self.counts.get(a + b, 0) >= max(5.0, RATIO * n)

    def best(self, w: str) -> str:
        """What a single word most likely stands for."""
        read = self.decoded(w) if _can_be_wrong(w) else ()
        return read[0][2] if len(read) == 1 else w

    def decoded(self, s: str) -> list[tuple[int, int, str, frozenset[str]]]:
        """What the cheapest reading of a stretch of words puts right: (start, end, reading, kinds) of each change.

        s has spaces between words, ``\\n`` at line ends and ``HYPHENATED`` where a word may run on over a line end.
        """
        known = self.memo.get(s)
        if known is None:
            known = self._decode(s)
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[s] = known
        return known

    def _decode(self, s: str) -> list[tuple[int, int, str, frozenset[str]]]:
        n = len(s)
        ends = [k for k, c in enumerate(s) if c in _BETWEEN] + [n]
        starts = [0, *[k + 1 for k in ends[:-1]]]
        # The characters as they stand: the path that every other has to beat, and what is left of it from each place.
        alone = [self.cost(s[a:e]) + (APART if e < n and s[e] == HYPHENATED else 0.0) for a, e in zip(starts, ends, strict=True)]
        rest = {n: 0.0, n + 1: 0.0}
        for a, c, e in zip(reversed(starts), reversed(alone), reversed(ends), strict=True):
            rest[a] = c + rest[e + 1 if e < n else n]
        best: dict[int, tuple[float, int, str, frozenset[str]]] = {0: (0.0, -1, "", frozenset())}
        bound = rest[0]
        word_at = dict(zip(starts, ends, strict=True))
        wrong = [x for a, e in zip(starts, ends, strict=True) for x in [_can_be_wrong(s[a:e])] * (e - a + 1)]  # by character

        def reach(q: int, cost: float, a: int, text: str, kinds: frozenset[str]) -> None:
            nonlocal bound
            if cost < best.get(q, (math.inf,))[0] - 1e-9:
                best[q] = (cost, a, text, kinds)
                if q in rest:
                    bound = min(bound, cost + rest[q])

        for a in range(n):
            if a not in best:
                continue
            base = best[a][0]
            if a in word_at:
                e = word_at[a]
                sep = s[e] if e < n else ""
                reach(e + 1 if e < n else n, base + self.cost(s[a:e]) + (APART if sep == HYPHENATED else 0.0), a, s[a:e] + ("-\n" if sep == HYPHENATED else sep), frozenset())
                if sep == HYPHENATED:
                    e2 = word_at[e + 1]
                    pair, sep2 = (s[a:e], s[e + 1 : e2]), s[e2] if e2 < n else ""
                    after = e2 + 1 if e2 < n else n
                    tail = "-\n" if sep2 == HYPHENATED else sep2
                    whole = self.counts.get("-".join(pair))
                    if whole:
                        reach(after, base - math.log(whole / self.total), a, "-\n".join(pair) + tail, frozenset())
                    reach(after, base + self.made("".join(pair)) + HYPHEN, a, "".join(pair) + tail, _HYPHEN_ONLY)
            # Words that the characters from here on may stand for, letter by letter.
            token = s[a : next(e for e in ends if e >= a)]
            todo = [("", a, 0.0, frozenset())]
            while todo:
                pre, q, pen, kinds = todo.pop()
                if base + pen >= bound:
                    continue
                c = s[q] if q < n else ""
                count = self.counts.get(pre, 0)
                if not c or c in _BETWEEN:
                    if kinds and count >= 5 and self._allowed(pre, s[a:q], kinds, count):
                        reach(q + 1 if c else n, base + pen - math.log(count / self.total) + (MARGIN if "character" in kinds else 0.0), a, pre + ("-\n" if c == HYPHENATED else c), kinds)
                    if c and pre:
                        todo.append((pre, q + 1, pen + _ACROSS[c][0], kinds | _ACROSS[c][1]))
                    continue
                if count >= 5 and len(pre) >= 4 and len(token) >= 8:
                    reach(q, base + pen - math.log(count / self.total) + RUN, a, pre + " ", kinds | _RUN_ONLY)
                if self.leads(pre + c):
                    todo.append((pre + c, q + 1, pen, kinds))
                for size in (1, 2) if wrong[q] else ():
                    for r in _WRONG.get(s[q : q + size], ()) if q + size <= n else ():
                        if self.leads(pre + r):
                            # Signs that no word holds by itself cost little to put right.
                            todo.append((pre + r, q + size, pen + (self.penalty if c.isalpha() and c != "ɑ" and not _foreign(s, q) else 0.5), kinds | _CHARACTER_ONLY))
                if wrong[q] and q + 2 < n and s[q + 1] in _BETWEEN:  # two characters for one, with a space or a line end between them
                    over, own = _ACROSS[s[q + 1]]
                    for r in _WRONG.get(c + s[q + 2], ()):
                        if self.leads(pre + r):
                            todo.append((pre + r, q + 3, pen + self.penalty + over, kinds | own | _CHARACTER_ONLY))
        out, q = [], n
        while q > 0:
            _, a, text, own = best[q]
            if own:
                out.append((a, q, text, own))
            q = a
        return out[::-1]

    def _allowed(self, word: str, parts: str, kinds: frozenset[str], count: int) -> bool:
        """A word with a space added must be well known, and far more frequent than one of its parts."""
        if "space" not in kinds:
            return True
        own = re.split("[ \n\x03]", parts)
        return len(word) > 3 and count >= RATIO * min(self.counts.get(x, 0) for x in own) and (len(own) < 3 or max(map(len, own)) > 1) and self.fine(word)


#: Marks a hyphen at a line end in a stretch of words.
HYPHENATED = "\x03"
_BETWEEN = frozenset((" ", "\n", HYPHENATED))
_SPACE_ONLY, _HYPHEN_ONLY, _CHARACTER_ONLY, _RUN_ONLY = frozenset(("space",)), frozenset(("hyphen",)), frozenset(("character",)), frozenset(("run",))
#: What it costs a word to go on across each, and what is then put right; a line end may stand where a space was added.
_ACROSS = {" ": (SPACE, _SPACE_ONLY), "\n": (SPACE, _SPACE_ONLY), HYPHENATED: (HYPHEN, _HYPHEN_ONLY)}


def _can_be_wrong(w: str) -> bool:
    return len(w) >= 2 and not w.isdigit() and not (len(w) == 2 and any("0" <= x <= "9" for x in w))


def _foreign(s: str, i: int) -> bool:
    """Whether a letter is of another alphabet than the rest of its word."""
    cyrillic = "Ѐ" <= s[i] <= "ӿ"
    own = other = 0
    for step in (-1, 1):
        k = i + step
        while 0 <= k < len(s) and s[k] not in _BETWEEN:
            if s[k].isalpha():
                own += 1
                other += ("Ѐ" <= s[k] <= "ӿ") != cyrillic
            k += step
    return other * 2 > own > 0


def lines_of(text: str, lexicon: Lexicon | None = None) -> list[tuple[str, str]]:
    """(kind, line) of each line, kind one of body, header, page and blank.

    A line is a header if it, or what it most likely reads, has the form of a journal, proceedings or authors' line, or
    if it is a title with a number, repeated in the texts with other numbers, that stands at the edge of the text or
    interrupts a sentence. A line that has the form of a page number is one; a lone number is, unless most lines are
    numbers.
    """
    lines = text.split("\n")
    numbers = sum(bool(_NUMBERS.fullmatch(x)) for x in lines if x.strip())
    filled = [k for k, x in enumerate(lines) if x.strip()]
    low = text.lower()
    formed, odd = any(w in low for w in _HEADER_STEMS), bool(_ODD.search(text))
    out = []
    for k, x in enumerate(lines):
        s = x.strip()
        if not s:
            out.append(("blank", x))
        elif _PAGE.match(s) and (numbers * 2 <= len(filled) or len(filled) <= 2):
            out.append(("page", x))
        elif (formed or odd) and s[-1] not in _SENTENCE_MARKS and (formed and _formed(s) or odd and _misread_header(s, lexicon)):
            out.append(("header", x))
        elif lexicon is not None and (form := titled(s)) and lexicon.counts.get("\x02" + form, 0) >= 3 and (k in (filled[0], filled[-1]) and len(filled) > 1 or _interrupts(lines, k)):
            out.append(("header", x))
        else:
            out.append(("body", x))
    return out


_NUMBERS = re.compile(r"[\s\d.,|;:+-]+")
_EDGE_NUMBER = re.compile(r"^\d{1,4}\b(?![.,)]\d)|(?<![\d.,])\b\d{1,4}$")
_PLAIN = frozenset("=/:?&#@_\\")
_LONG_WORD = re.compile(r"[^\W\d_]{4,}")


def _misread_header(s: str, lexicon: Lexicon | None) -> bool:
    """Whether what a line with odd characters most likely reads has a header's form."""
    if not _ODD.search(s):
        return False
    if _formed(_ODD_WORD.sub(lambda m: m.group().translate(_DIGITS), s)):
        return True
    if lexicon is None or not s[0].isupper() and not s[0].isdigit():
        return False
    read = _TOKEN.sub(lambda m: _cased(m.group(), lexicon), s)
    return read != s and (_formed(read) or _formed(_ODD_WORD.sub(lambda m: m.group().translate(_DIGITS), read)))


#: A line that closes a sentence is no header, whatever it begins with.
_SENTENCE_MARKS = frozenset(".!?。！？।؟…:;")
_HEADER_STEMS = ("annal", "anales", "journal", "bulletin", "transactions", "proc", "review", "revue", "revista", "archives", "вестник", "вісник", "журнал", "известия", "letters", "/")


def _formed(s: str) -> bool:
    low = s.lower()
    return any(w in low for w in _HEADER_STEMS) and bool(_HEADER.match(s)) and _title_like(s)


def _title_like(s: str) -> bool:
    """Whether most words of four letters and more are written with a capital, or there are few words at all."""
    own = _LONG_WORD.findall(s)
    return len(own) <= 4 or 2 * sum(w[0].isupper() for w in own) > len(own)


def titled(s: str) -> str:
    """What is the same in a running title on all pages: a title with a number at its edge, without the number; else ''."""
    if not s[0].isdigit() and not s[-1].isdigit():
        return ""
    own = _LONG_WORD.findall(s)
    if len(own) < 2 or not _EDGE_NUMBER.search(s) or _CLOSED.search(s) or not _PLAIN.isdisjoint(s) or 2 * sum(w[0].isupper() for w in own) <= len(own) or not s[-1].isalnum():
        return ""
    return re.sub(r"\d+", "0", s.lower())


def _interrupts(lines: list[str], k: int) -> bool:
    """Whether the line before leaves a sentence open and the line after goes on with it."""
    before = next((x for x in reversed(lines[:k]) if x.strip()), "")
    after = next((x for x in lines[k + 1 :] if x.strip()), "")
    return bool(before and after) and not _CLOSED.search(before) and after.lstrip()[:1].islower()


def paragraphs(lines: list[tuple[str, str]]) -> list[list[str]]:
    """Body lines by paragraph: dynamic programming over break or no break after each line.

    A break is cheap after a blank line or a short line that closes a sentence, and dear inside a sentence; a paragraph
    costs a constant, so that lines are not cut up for nothing.
    """
    body: list[str] = []
    gap: list[bool] = []
    blank = False
    for kind, x in lines:
        if kind == "body":
            if body:
                gap.append(blank)
            body.append(x)
            blank = False
        elif kind == "blank":
            blank = True
    if not body:
        return []
    width = sorted(len(x) for x in body)[int(0.9 * (len(body) - 1))]
    closes = [bool(_CLOSED.search(x)) and len(x) < 0.7 * width for x in body]
    # What it costs not to break after each line, summed up so that any stretch is a difference.
    kept = [0.0]
    for k in range(len(body) - 1):
        kept.append(kept[-1] + (6.0 if gap[k] else 2.5 if closes[k] else 0.0))
    # best[i] is the least of best[j] + 1 + kept[i - 1] - kept[j] + edge(j) over all j < i, so one running minimum does.
    best, cut_before = [0.0], [0]
    least = (math.inf, 0)
    for i in range(1, len(body) + 1):
        j = i - 1
        edge = 0.0 if j == 0 or gap[j - 1] else 1.0 if closes[j - 1] else 8.0
        least = min(least, (best[j] - kept[j] + edge, j))
        best.append(least[0] + 1.0 + kept[i - 1])
        cut_before.append(least[1])
    out, i = [], len(body)
    while i:
        j = cut_before[i]
        out.append(body[j:i])
        i = j
    return out[::-1]


def _small(text: str) -> str:
    """Lower case, letter by letter where a small letter would be longer."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _stretches(text: str, lexicon: Lexicon) -> Iterator[tuple[list[re.Match], str]]:
    """The parts of a text that have to be decoded, with their words: what is not fine, with two words around."""
    low = _small(text)
    words = _TOKEN.findall(low)
    bad, rare = set(), set()
    for w in set(words):
        if len(w) > 1 and not lexicon.fine(w):
            bad.add(w)
        if lexicon.counts.get(w, 0) < lexicon.rare:
            rare.add(w)
    doubt = {k for k, w in enumerate(words) if w in bad} if bad else set()
    if rare:
        last = len(words) - 1
        for k in [k for k, w in enumerate(words) if w in rare]:
            if k < last and lexicon.could_join(words[k], words[k + 1]):
                doubt.add(k)
            if k and lexicon.could_join(words[k - 1], words[k]):
                doubt.add(k - 1)
    broken = _hyphenated(text)
    if not doubt and not broken:
        return
    tokens = list(_TOKEN.finditer(low))
    hyphens: set[int] = set()
    if broken:
        ends = [m.end() for m in tokens]
        for x in _BREAK.finditer(text):
            k = bisect_left(ends, x.end(1))
            if k + 1 < len(tokens) and ends[k] == x.end(1) and tokens[k].start() == x.start(1) and tokens[k + 1].start() == x.start(2) and _may_be_broken(x, text, lexicon):
                hyphens.add(k)
    known: dict[int, str] = {}

    def sep(k: int) -> str:
        """What stands between a word and the next: a space, a line end, a hyphen at a line end, or what words do not cross."""
        out = known.get(k)
        if out is None:
            between = text[tokens[k].end() : tokens[k + 1].start()] if k + 1 < len(tokens) else ""
            out = HYPHENATED if k in hyphens else " " if between == " " else "\n" if between.isspace() and between.count("\n") < 2 else ""
            known[k] = out
        return out

    order = sorted({k for k in doubt if len(words[k]) > 1 and words[k] in bad or sep(k) in (" ", "\n")} | hyphens)
    done = -1
    at = 0
    while at < len(order):
        k = order[at]
        a = e = k
        while a > 0 and k - a < 2 and sep(a - 1):
            a -= 1
        until = k
        while True:
            while at < len(order) and order[at] <= e:
                until = max(until, order[at] + 2)
                at += 1
            near = at < len(order) and order[at] - 2 <= e  # the next stretch would overlap
            if e + 1 >= len(tokens) or not sep(e) or e >= until and not near:
                break
            e += 1
        a = max(a, done + 1)
        done = e
        yield tokens[a : e + 1], "".join(words[i] + (sep(i) if i < e else "") for i in range(a, e + 1))


def findings(text: str | None, lexicon: Lexicon) -> list[str]:
    """Kinds of noise in a text: header, page, hyphen, space, character."""
    if not text:
        return []
    out: dict[str, None] = {}
    body = text
    kinds = lines_of(text, lexicon)
    for k, _ in kinds:
        if k in ("header", "page"):
            out[k] = None
    if out:
        body = "\n".join(x for k, x in kinds if k in ("body", "blank"))
    if _hyphenated(body) and any(_sure_break(m) for m in _BREAK.finditer(body)):
        out["hyphen"] = None
    for m in _SPACED.finditer(body):
        w = re.sub(r"[ \n]", "", m.group(1)).lower()
        if w.isalpha() and (lexicon.fine(w) or len(w) >= 6):
            out["space"] = None
            break
    for _, s in _stretches(body, lexicon):
        for *_, own in lexicon.decoded(s):
            out.update(dict.fromkeys(sorted(own - _RUN_ONLY)))
    if "character" not in out and any(c in body for c in PICTURES):
        for m in _PICTURE.finditer(body.replace("\n", "")):
            if _picture(m, lexicon) != m.group(2):
                out["character"] = None
                break
    return list(out)


def _sure_break(m: re.Match) -> bool:
    """Whether the sign at a line end does nothing but break a word."""
    return m.string[m.end(1)] in "­¬"


def _may_be_broken(m: re.Match, text: str, lexicon: Lexicon) -> bool:
    """Whether a hyphen at a line end can break a word: it is no part of a name, a chain of hyphens, and not suspended."""
    a, b = m.group(1).lower(), m.group(2).lower()
    if _sure_break(m):
        return True
    if m.group(2)[0].isupper() and not m.group(1).isupper():
        return False
    # Earlier and later parts of a chain of hyphens make it a compound.
    before = text[m.start(1) - 1] if m.start(1) else " "
    after = text[m.end(2)] if m.end(2) < len(text) else " "
    if before in "-‐" or after in "-‐":
        return lexicon.fine(a + b) and not (lexicon.fine(a) and lexicon.fine(b))
    return not (b in ("und", "oder", "y", "e", "et", "ou", "and", "or", "и", "или", "та") and not lexicon.fine(a + b))


def _picture(m: re.Match, lexicon: Lexicon) -> str:
    left, c, right = m.group(1), m.group(2), m.group(3)
    other = PICTURES.get(c)
    if other is None:
        return c
    own, new = lexicon.counts.get(f"\x01{left}{c}{right}", 0), lexicon.counts.get(f"\x01{left}{other}{right}", 0)
    return other if new >= 3 and new >= 3 * own else c


def repaired(text: str | None, lexicon: Lexicon) -> str | None:
    """The text in continuous paragraphs with its noise repaired; unchanged if it has none."""
    if not findings(text, lexicon):
        return text
    out = []
    for own in paragraphs(lines_of(text or "", lexicon)):
        t = "\n".join(x.strip() for x in own)
        t = _BREAK.sub(lambda m: m.group(1) + m.group(2) if _sure_break(m) else m.group(), t)
        t = _reread(t, lexicon)
        glue = "" if len(re.findall(f"[{_NO_SPACES}]", t)) * 2 > len(t) else " "
        t = re.sub(r"(?<=[-‐])\n", "", t).replace("\n", glue)
        t = _SPACED.sub(lambda m: re.sub(r"[ \n]", "", m.group(1)), t)
        t = _PICTURE.sub(lambda m: m.group(1) + _picture(m, lexicon), t)
        out.append(t)
    return "\n\n".join(out)


def _reread(t: str, lexicon: Lexicon) -> str:
    """Every stretch in doubt replaced by its best reading, words that stay as they are written."""
    out, at = [], 0
    for words, s in _stretches(t, lexicon):
        places = []  # of each character of the stretch in the text
        for m in words:
            places += range(m.start(), m.end())
            places.append(m.end())
        for a, q, read, _ in lexicon.decoded(s):
            start, end = places[a], places[q] if q == len(s) else places[q - 1] if s[q - 1] in _BETWEEN else places[q]
            old, new = t[start:end], read.rstrip(" \n" + HYPHENATED)
            out.append(t[at:start])
            out.append(new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[0].isupper() else new)
            at = end
    return "".join([*out, t[at:]])


def _cased(w: str, lexicon: Lexicon) -> str:
    low = w.lower()
    if len(low) < 2 or lexicon.fine(low):
        return w
    x = lexicon.best(low)
    return w if x == low else x.upper() if w.isupper() and len(w) > 1 else x.capitalize() if w[0].isupper() else x


def model(texts: DataFrame) -> Lexicon:
    """The unigram model of all texts (one string column)."""
    counts = cut(texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where(F.col("word") >= "\x03").agg(F.sum("n")).head()[0] or 1
    rows = counts.where(F.col("n") >= max(3, total * LEAST_SHARE)).toArrow().to_pydict()  # at most 1 / LEAST_SHARE words
    return Lexicon(dict(zip(rows["word"], rows["n"], strict=True)), total)


def examined(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon, repair: bool = False) -> DataFrame:
    """(keys, findings, repaired) of each row; repaired is null unless asked for."""
    shipped = df.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shipped.value)
        for b in batches:
            col = b.column(len(keys)).to_pylist()
            found = [findings(t, own) for t in col]
            fixed = [repaired(t, own) if f else t for t, f in zip(col, found, strict=True)] if repair else [None] * len(col)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(found, pa.list_(pa.string())), pa.array(fixed, pa.string())], names=[*keys, "findings", "repaired"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{types}, findings array<string>, repaired string")
