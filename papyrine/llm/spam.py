"""Keyword-stuffed pages and lists of links or tags, by rank-frequency curves.

For each page the curve of rank and frequency of its words is fitted in SQL: words of one frequency are one point of the
curve (frequency, number of words), a running sum over a window gives their ranks, and a weighted regression of the log
frequency on the log rank gives slope and residual; the head is by how much the share of one word exceeds its share in
prose. Divergence is what a page's word distribution has not in common with that of prose of the nearest language, over
all words that make up at least ``LEAST_SHARE`` of it.

Each of the four figures is held against pages of the same language and a comparable length: its distance from their
median, in units of their spread (both from all rows; where pages of a language and length are few, they lean on pages of
that length in all languages, and those on all pages, in proportion to their numbers). The distances add up to one score, standardised for every length. A page is
flagged by a high score, or by sharing less than a part of what pages of its language have in common with prose. A
flagged page is a case unless a check of its structure says otherwise: most of its words stand in sentences (unless its
head or its divergence is extreme by itself), or its lines are mostly numbers, as in indexes and tables.

Defined results
* null texts, empty texts and texts without words are no cases
* a language label that is null or unknown leaves the page out of the language models, not out of the result
* a page without any word of a model has no language, and is held against pages of all languages
* rows given twice are judged twice; extra columns are ignored
* shares of sentences and numbers are null for pages close to prose, which cannot be flagged by what they lack
* with no labelled page there is no prose to compare with, and only the curve itself can flag
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.common import broadcast_if_small, cut

#: Spellings of labels that are broadcast at most; a larger table is joined by shuffle.
SPELLINGS = 100_000
#: Words of a language's model have at least this share of its words, so a language has at most one in LEAST_SHARE.
LEAST_SHARE = 1e-5
#: Pages of a language and length weigh as much as those of all languages if there are so many of them.
WEIGHT = 20
#: A page is far from prose if it shares less than this part of what pages of its language and length share.
COMMON = 0.45
#: Scores that flag; a head that is extreme by itself; divergence and score at which marks do not make sentences; head and
#: divergence that are both high.
SCORE, HEAD, FAR, FAR_SCORE = 6.0, 4.0, -6.0, 9.0
BOTH_SCORE, BOTH_HEAD, BOTH_FAR = 5.5, 3.0, -1.9
#: Spread that every figure has at least, and distance beyond which it counts no more.
LEAST_SPREAD, MOST = 0.08, 12.0
#: Shares of sentences and numbers are worked out for pages that share less, or have a higher head.
NEEDED_COMMON, NEEDED_HEAD = 0.45, 0.15

_NO_SPACES = "฀-໿぀-ヿ㐀-鿿"
_LINK = ""
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|&[a-zA-Z]{2,8};|&#\d+;|\\[a-zA-Z]+", re.S)
_NUMBER = re.compile(r"[-+]?\d[\d.,:/–-]*")
_WORD = re.compile("[" + _NO_SPACES + "]+|[^\\W\\d_" + _NO_SPACES + "]+(?:['’̀-ًͯ-ٟऀ-෴][^\\W\\d_" + _NO_SPACES + "]*)*|" + _LINK)
_END = re.compile("[。！？।؟]+|[.!?…]+(?!\\w)|\n")
_TABLE = re.compile(r"^(?:\{\||\|[-}]).*$", re.M)
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-case words; links are one word, numbers and markup none; scripts without spaces give pairs of characters."""
    t = _URL.sub(f" {_LINK} ", text) if "http" in text or "www." in text else text
    if "<" in t or "&" in t or "\\" in t:
        t = _MARKUP.sub(" ", t)
    out: list[str] = []
    for w in _WORD.findall(t.lower()):
        c = w[0]
        if c >= "฀" and ("฀" <= c <= "໿" or "぀" <= c <= "鿿") and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def number_share(text: str) -> float:
    """Share of words and numbers that stand in lines of at least as many numbers as words (and two at least)."""
    own = every = 0
    for line in _URL.sub(" ", text).split("\n"):
        n, w = len(_NUMBER.findall(line)), len(_LETTERS.findall(line))
        every += n + w
        if n >= 2 and n >= w:
            own += n + w
    return own / every if every else 0.0


def sentence_share(text: str) -> float:
    """Share of a text's letters that stand in sentences with a closing mark."""
    t = _TABLE.sub("", _MARKUP.sub(" ", _URL.sub(_LINK, text)))
    every = own = at = 0
    for m in [*_END.finditer(t), None]:
        s = t[at : m.start()] if m else t[at:]
        at = m.end() if m else at
        w = _LETTERS.findall(s)
        size = sum(map(len, w))
        every += size
        if m and m.group() != "\n" and _LINK not in s and (len(w) >= 4 or (size >= 5 and w[0][0] >= "\u0e00")):
            own += size
    return own / every if every else 0.0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) partial counts; handed on whenever they grow large."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(g, w, n) for g, c in counts.items() for w, n in c.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])

    for b in batches:
        for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if g is not None and t:
                counts[g].update(words(t))
        if sum(map(len, counts.values())) > 500_000:
            yield out()
            counts.clear()
    yield out()


class Models:
    """Shares of words in prose by language, as rows of a sparse table: word -> (languages, shares)."""

    def __init__(self, rows: dict[str, list]):
        self.languages = sorted(set(rows["lang"]))
        number = {g: k for k, g in enumerate(self.languages)}
        words_of: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for g, w, x in zip(rows["lang"], rows["word"], rows["share"], strict=True):
            words_of[w].append((number[g], x))
        self.index = {w: k for k, w in enumerate(words_of)}
        self.start = np.cumsum([0, *map(len, words_of.values())])
        self.lang = np.array([g for v in words_of.values() for g, _ in v], np.int64)
        self.share = np.array([x for v in words_of.values() for _, x in v], np.float64)

    def compared(self, counts: Counter) -> tuple[str, float, float]:
        """Nearest language, share in common with it, and by how much one word exceeds its share there."""
        n = sum(counts.values())
        known = [(self.index[w], k) for w, k in counts.items() if w in self.index]
        most = max((k for w, k in counts.items() if w not in self.index), default=0) / n
        if not known:
            return "", 0.0, most
        rows, k = np.array(known, np.int64).T
        q = k / n
        size = self.start[rows + 1] - self.start[rows]
        of = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + self.start[rows][of]
        near = np.bincount(self.lang[at], np.minimum(self.share[at], q[of]), len(self.languages))
        g = len(near) - 1 - int(np.argmax(near[::-1]))  # of equals the last name
        own = self.lang[at] == g
        q[of[own]] -= self.share[at][own]
        return self.languages[g], float(near[g]), float(max(most, q.max()))


def language_models(df: DataFrame) -> Models:
    """Shares of all words that make up LEAST_SHARE of a language; df has lang and text, all labelled rows count."""
    counts = cut(df.where("lang is not null").select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    shares = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").select("lang", "word", (F.col("n") / F.col("all")).alias("share"))  # one row a language
    return Models(shares.where(F.col("share") >= LEAST_SHARE).toArrow().sort_by([("word", "ascending"), ("lang", "ascending")]).to_pydict())


def curves(df: DataFrame, key: str, text: str, model: Models) -> DataFrame:
    """Per page: nearest language, number of words, share in common, head, shares of sentences and numbers, curve."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lang, n_words, common, head, sent, num, freqs, counts = [], [], [], [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                c = Counter(words(t)) if t else None
                if not c:
                    continue
                n = sum(c.values())
                g, o, h = model.compared(c)
                spectrum = sorted(Counter(c.values()).items(), reverse=True)
                at.append(i)
                lang.append(g)
                n_words.append(n)
                common.append(o)
                head.append(h)
                needed = o < NEEDED_COMMON or h > NEEDED_HEAD
                sent.append(sentence_share(t) if needed else None)
                num.append(number_share(t) if needed else None)
                freqs.append([x for x, _ in spectrum])
                counts.append([x for _, x in spectrum])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), b.column(2).take(pa.array(at, pa.int64())), pa.array(lang, pa.string()), pa.array(n_words, pa.int64()), pa.array(common, pa.float64()), pa.array(head, pa.float64()), pa.array(sent, pa.float64()), pa.array(num, pa.float64()), pa.array(freqs, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                names=["key", "row", "lang", "n_words", "common", "head", "sentences", "numbers", "freqs", "counts"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"key {kind}, row long, lang string, n_words long, common double, head double, sentences double, numbers double, freqs array<bigint>, counts array<bigint>")


def fitted(pages: DataFrame) -> DataFrame:
    """slope and residual of each page's curve, by windows and a weighted regression in SQL."""
    plain = [c for c in pages.columns if c not in ("freqs", "counts", "row")]
    points = pages.select("row", F.posexplode(F.arrays_zip("freqs", "counts")).alias("pos", "p"), *[F.col(c) for c in plain])
    points = points.select("row", F.col("p.freqs").alias("f"), F.col("p.counts").cast("double").alias("w"), *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in plain])
    upto = F.sum("w").over(Window.partitionBy("row").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0))
    points = points.withColumn("x", F.log(upto - (F.col("w") - 1) / 2)).withColumn("y", F.log(F.col("f").cast("double")))
    s = lambda e: F.sum(F.expr(e))
    sums = points.groupBy("row").agg(*[F.max(c).alias(c) for c in plain], s("w").alias("sw"), s("w*x").alias("sx"), s("w*y").alias("sy"), s("w*x*x").alias("sxx"), s("w*x*y").alias("sxy"), s("w*y*y").alias("syy"))
    sums = sums.withColumn("vx", F.expr("sxx - sx*sx/sw")).withColumn("vy", F.expr("syy - sy*sy/sw")).withColumn("vxy", F.expr("sxy - sx*sy/sw"))
    slope = F.when(F.col("vx") > 1e-9, -F.col("vxy") / F.col("vx")).otherwise(F.lit(0.0))
    rest = F.when(F.col("vx") > 1e-9, F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.col("vxy") * F.col("vxy") / F.col("vx")) / F.col("sw"))).otherwise(F.lit(0.0))
    return sums.select(*plain, slope.alias("slope"), rest.alias("residual"))


def judged(pages: DataFrame) -> DataFrame:
    """pages with the distances of their figures from those of their language and length, the score, and whether they are cases."""
    size = F.floor(F.log2(F.col("n_words") + 1)).cast("int")
    figures = {"c": F.log(F.col("common") + 0.02), "h": F.log(F.greatest("head", F.lit(1e-4))), "s": F.col("slope"), "r": F.col("residual")}
    pages = cut(pages.withColumn("size", size))
    quarters = [F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(k) for k, v in figures.items()]
    share = F.percentile_approx("common", 0.75, F.lit(1000))
    by = pages.where("lang <> ''").groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), share.alias("l_common"), *[q.alias(f"l_{k}") for q, k in zip(quarters, figures, strict=True)])
    whole = pages.groupBy("size").agg(F.count(F.lit(1)).alias("w"), share.alias("w_common"), *[q.alias(f"w_{k}") for q, k in zip(quarters, figures, strict=True)])
    every = pages.agg(*quarters).head()  # one row
    leaning = F.col("w") / (F.col("w") + WEIGHT)
    lean = lambda c, x: F.when(c.isNull(), F.lit(x)).otherwise(leaning * c + (1 - leaning) * F.lit(x)) if x is not None else c
    whole = whole.select("size", "w_common", *[F.array(*[lean(F.col(f"w_{k}")[i], every[k] and every[k][i]) for i in range(3)]).alias(f"w_{k}") for k in figures])
    # One row for each language and power of two, and one for each power of two.
    x = pages.join(F.broadcast(whole), "size").join(F.broadcast(by), ["lang", "size"], "left")
    own = F.coalesce(F.col("n") / (F.col("n") + WEIGHT), F.lit(0.0))
    mixed = lambda a, b: own * F.coalesce(a, F.lit(0.0)) + (1 - own) * b
    x = x.withColumn("ref", mixed(F.col("l_common"), F.col("w_common")))
    # What is in common grows with length, so a class takes over the better value of shorter ones of its language.
    up = Window.partitionBy("lang").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    refs = x.groupBy("lang", "size").agg(F.max("ref").alias("ref")).select("lang", "size", F.max("ref").over(up).alias("reference"))
    x = x.drop("ref").join(F.broadcast(refs), ["lang", "size"])
    for k, v in figures.items():
        spread = mixed(F.col(f"l_{k}")[2] - F.col(f"l_{k}")[0], F.col(f"w_{k}")[2] - F.col(f"w_{k}")[0]) / 1.349 + LEAST_SPREAD
        x = x.withColumn(f"z_{k}", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), (v - mixed(F.col(f"l_{k}")[1], F.col(f"w_{k}")[1])) / spread)))
    x = x.withColumn("score", F.col("z_h") - F.col("z_c") + (F.col("z_s") + F.col("z_r")) / 2)
    far = F.col("common") < COMMON * F.col("reference")
    plain = F.coalesce(F.col("sentences"), F.lit(1.0)) <= 0.5  # little of it stands in sentences
    high = (F.col("score") > SCORE) & (plain | (F.col("z_h") > HEAD) | ((F.col("z_c") < FAR) & (F.col("score") > FAR_SCORE)))
    both = (F.col("score") > BOTH_SCORE) & (F.col("z_h") > BOTH_HEAD) & (F.col("z_c") < BOTH_FAR)
    case = ((far & plain) | high | both) & (F.coalesce(F.col("numbers"), F.lit(0.0)) < 0.5)
    return x.select("key", "lang", "n_words", "common", "head", "slope", "residual", "sentences", "numbers", far.alias("far"), "z_c", "z_h", "z_s", "z_r", "score", case.alias("spam"))


def spam(df: DataFrame, key: str, text: str, label: str, codes: DataFrame) -> DataFrame:
    """Every page with its figures; codes maps labels (label_code) to languages (lang) and has a row for each spelling."""
    spelled = broadcast_if_small(codes.select(F.col("label_code").alias("spelling"), F.col("lang").alias("language")).dropDuplicates(["spelling"]), SPELLINGS)
    labelled = df.select(F.col(text).cast("string").alias("text"), F.trim(F.col(label)).alias("spelling")).join(spelled, "spelling").select(F.col("language").alias("lang"), "text")
    return judged(fitted(curves(df, key, text, language_models(labelled))))
