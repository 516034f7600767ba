"""Languages of documents and of their lines, by averaged hashed subword embeddings and a linear softmax.

Texts are cut into lines; each line is the bag of its hashed characters, pairs and triples. A line's vector is
the average of their embeddings, its logits a linear map of it, trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. As labels are partly wrong, training is repeated without the lines to which the
model of a first, short training gives another language than their label. For use, embeddings and linear map are multiplied into one table of
scores per bucket. Confidence is the softmax at a temperature fitted on held-out lines, by length; below a threshold the
language is rejected as ``und``.

A text's language is the one of most of its letters, counted over its lines (short lines are judged together). A line is
foreign if it is whole sentences and surely of another language; for that, each line that ends like a sentence is judged
by itself, however short.

Defined results
* null texts and texts without words (blank, only links, numbers or formulas) have no language and are no cases
* a label that is null, blank, ``unknown`` or ``und`` is missing; one that is in no table of spellings is wrong
* rows delivered again give the same case once
* the sample is bounded by ``SAMPLE`` labelled rows, taken by the hash of their key, so that languages keep their
  shares and wrong labels stay outnumbered
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.common import broadcast_if_small

#: Spellings of labels that are broadcast at most; a larger table is joined by shuffle.
SPELLINGS = 100_000
#: Labelled rows that the classifier is fitted on, taken by the hash of their key, and lines of them.
SAMPLE, LINES, ROW_LINES = 4000, 12_000, 5
BUCKETS, DIM, RATE = 1 << 16, 16, 0.6
#: Passes of each fit: the first ones are short, lest they learn the wrong labels by heart, and clean the sample.
FIRST_EPOCHS = (3, 4, 4)
#: Letters that a line needs to be judged by itself, and to be foreign; a Chinese, Japanese or Korean letter says more.
SHORT, FOREIGN = 15, 18
FOREIGN_BY_SCRIPT = (("\u3040", "\u9fff", 6), ("\uac00", "\ud7a3", 8))
#: Confidence below which no language is given, and above which a line is foreign.
REJECT, SURE = 0.4, 0.8
BLOCK = 1 << 17

_MASK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|</?[a-zA-Z][^<>]*>|\\[a-zA-Z]+|\[?FORMULA_\d+\]?|&#?\w{1,8};|`[^`\n]*`|\$[^$\n]+\$|\b[A-Za-z]\b|\b\w+_\w+\b")
_ENDED = re.compile("[.!?。！？।؟…]+[\"'”’»“」』）)\\]]*\\s*$")
_WORDS = re.compile(r"[^\W\d_]+")


def _lower(text: str) -> str:
    t = text.lower()
    return t if len(t) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


_classes: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark that belongs to one."""
    if not _classes:
        import unicodedata

        _classes.append(np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x30000)), bool, 0x30000))
    return _classes[0]


def _groups() -> np.ndarray:
    """Alphabet of each block of 256 code points: Latin 0, Greek 3, Cyrillic 4, Arabic 6, Chinese and Japanese 48, else its own."""
    if len(_classes) < 2:
        g = np.minimum(np.arange(0x300), 255)
        g[[1, 2, 0x1E]], g[5], g[[7, 8]] = 0, 4, 6
        g[0x30:0xA0], g[0xF9:0xFB] = 0x30, 0x30
        _classes.append(g)
    return _classes[1]


def alphabets(lines: list[str]) -> np.ndarray:
    """The alphabet of most letters of each line (Greek ones, as in formulas, aside); -1 without letters."""
    letters()
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    cp = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    own = letters()[np.minimum(cp, 0x2FFFF)]
    group = _groups()[np.minimum(cp, 0x2FFFF) >> 8]
    own &= group != 3
    line = np.repeat(np.arange(len(lines)), sizes)
    count = np.bincount(line[own] * 256 + group[own], minlength=256 * len(lines)).reshape(len(lines), 256)
    return np.where(count.any(1), count.argmax(1), -1)


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of lines laid end to end: buckets, the line of each, and letters per line."""
    sizes = np.fromiter((len(x) + 2 for x in lines), np.int64, len(lines))
    cp = np.frombuffer("".join([f" {_lower(x)} " for x in lines]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = letters()[np.minimum(cp, 0x2FFFF)]
    cp = np.where(own, cp, np.uint64(32))
    line = np.repeat(np.arange(len(lines)), sizes)
    count = np.bincount(line, own, len(lines)).astype(np.int64)
    out, at = [], []
    shift = np.uint64(64 - 16)
    h = cp * np.uint64(0x9E3779B97F4A7C15)
    grow = cp
    for n in (1, 2, 3):
        m = len(cp) - n + 1
        if m <= 0:
            break
        grow = grow[:m] * np.uint64(0x100000001B3) + cp[n - 1 :] if n > 1 else cp
        h = (grow * np.uint64(0x9E3779B97F4A7C15)) >> shift
        # Not across lines, and not of blanks only: the first or second character must be a letter.
        keep = (line[:m] == line[n - 1 :]) & (own[1 : m + 1] if n > 1 else own)
        out.append(h[keep].astype(np.int64))
        at.append(line[:m][keep])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), count
    return np.concatenate(out), np.concatenate(at), count


class Classifier:
    """Scores per bucket, bias and temperatures, with the languages they are for."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.table = np.zeros((BUCKETS, len(languages)), np.float32)
        self.heat = np.ones(8)
        #: Which alphabets (columns) the training lines of each language are written in.
        self.written = np.ones((len(languages), 256), bool)

    def logits(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Average scores of each line, and its letters."""
        bucket, line, count = features(lines)
        order = np.argsort(line, kind="stable")
        bucket, line = bucket[order], line[order]
        sums = np.zeros((len(lines), len(self.languages)), np.float32)
        if len(line):
            first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            sums[line[first]] = np.add.reduceat(self.table[bucket], first, axis=0)
        n = np.maximum(1, np.bincount(line, minlength=len(lines)))
        return sums / n[:, None], count

    def judge(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, confidence and letters of each line."""
        z, count = self.logits(lines)
        # A language that is not written in the line's alphabet is no candidate, if any other is.
        own = alphabets(lines)
        can = self.written[:, np.maximum(own, 0)].T
        z = np.where(can | ~can.any(1, keepdims=True) | (own < 0)[:, None], z, z.min() - 100)
        z = z * self.heat[np.minimum(7, np.log2(count + 1).astype(int))][:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        return p.argmax(1), p.max(1), count


def train(lines: list[str], labels: list[str], seed: int = 7) -> Classifier:
    """Fit on lines with partly wrong labels."""
    names = sorted(set(labels))
    c = Classifier(names)
    if len(names) < 2:
        return c
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    bags = []
    for i in range(0, len(lines), 256):
        bucket, line, _ = features(lines[i : i + 256])
        order = np.argsort(line, kind="stable")
        cuts = np.searchsorted(line[order], np.arange(1, min(256, len(lines) - i)))
        bags += [x.astype(np.int32) for x in np.split(bucket[order], cuts)]
    held = rng.random(len(lines)) < 0.15
    clean = np.ones(len(lines), bool)
    for epochs in FIRST_EPOCHS:
        e = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        w = np.zeros((DIM, len(names)), np.float32)
        use = np.flatnonzero(clean & ~held)
        # Rare languages count somewhat more once their labels have been cleaned.
        shares = np.bincount(y[use], minlength=len(names))
        weight = np.minimum(3.0, np.sqrt(shares.max() / np.maximum(1, shares))) if clean.sum() < len(clean) else np.ones(len(names))
        step, total = 0, epochs * len(use)
        for _ in range(epochs):
            for i in rng.permutation(use):
                b = bags[i]
                step += 1
                if not len(b):
                    continue
                v = e[b].mean(0)
                z = v @ w
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                p *= RATE * (1 - step / total) * weight[y[i]]
                g = w @ p
                w -= np.outer(v, p)
                e[b] -= g * (4.0 / len(b))
        c.table = e @ w
        parts = [c.logits(lines[i : i + 256]) for i in range(0, len(lines), 256)]  # blocks, for the sake of memory
        z, count = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        clean = z.argmax(1) == y
    own = np.concatenate([alphabets(lines[i : i + 256]) for i in range(0, len(lines), 256)])
    for k in range(len(names)):
        mine = own[clean & (y == k) & (own >= 0)]
        if len(mine):
            c.written[k] = np.bincount(mine, minlength=256) >= 0.1 * len(mine)
    # Temperatures by length, on held-out lines whose labels stand.
    size = np.minimum(7, np.log2(count + 1).astype(int))
    for k in range(8):
        own = held & clean & (size == k)
        if own.sum() < 20:
            own = held & clean
        best = min((float(-np.mean(_log_softmax(z[own] * t)[np.arange(own.sum()), y[own]])), t) for t in (0.5, 1, 2, 3, 5, 8)) if own.any() else (0, 1)
        c.heat[k] = best[1]
    c.held_accuracy = float((z[held & clean].argmax(1) == y[held & clean]).mean()) if (held & clean).any() else float("nan")
    return c


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def masked(line: str) -> str:
    return _MASK.sub(" ", line)


def spelled(label: Column, codes: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """The table of spellings to join by ``name``, and the key to join with: labels without surrounding white space."""
    return codes.select(F.col("label_code").alias(f"{name}_key"), F.col("lang").alias(name)).dropDuplicates([f"{name}_key"]), F.trim(label)


def fit(df: DataFrame, key: str, text: str, label: str, codes: DataFrame) -> Classifier:
    """The classifier, fitted on at most SAMPLE labelled rows, taken by the hash of their key (one more class of hashes
    where a few keys hold more rows than that, twice as many at most)."""
    table, own = spelled(F.col(label), codes, "language")
    rows = df.where(f"{text} is not null").select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), own.alias("language_key"))
    rows = rows.join(broadcast_if_small(table, SPELLINGS), "language_key")
    share = rows.select("key").withColumn("h", F.xxhash64("key")).groupBy(F.shiftright("h", 50).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # 16,384 rows at most
    bound, n = None, 0
    for r in share:
        n += r["n"]
        if n > SAMPLE:
            break
        bound = r["b"]
    if bound is None and share:
        bound = share[0]["b"]
    sample = rows.where(F.shiftright(F.xxhash64("key"), 50) <= F.lit(bound)).select("key", "language", "text").limit(2 * SAMPLE).toPandas().sort_values(["key", "text"])
    lines, labels = [], []
    rng = np.random.default_rng(3)
    for language, t in zip(sample["language"], sample["text"], strict=True):
        own = [m for x in t.split("\n") if len(m := masked(x)) > 25 and len(_WORDS.findall(m)) > (0 if any("\u0e00" <= c <= "\u9fff" for c in m[:40]) else 3)]
        for i in sorted(rng.permutation(len(own))[:ROW_LINES].tolist()):  # lest one long text outweighs many
            lines.append(own[i])
            labels.append(language)
    if len(lines) > LINES:
        take = np.sort(np.random.default_rng(3).permutation(len(lines))[:LINES])
        lines, labels = [lines[i] for i in take], [labels[i] for i in take]
    return train(lines, labels)


def judged(df: DataFrame, keys: list[str], text: str, classifier: Classifier, segments: bool) -> DataFrame:
    """(keys, language, confidence, n_letters, by_language, foreign) of each row with words.

    by_language counts the letters of each language; foreign lists line number, language and confidence of foreign lines.
    """
    shipped = df.sparkSession.sparkContext.broadcast(classifier)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        k = len(c.languages)
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            rows: list[tuple] = []
            a = 0
            while a < len(texts):
                size, e = 0, a
                while e < len(texts) and (e == a or size < BLOCK):
                    size += len(texts[e] or "")
                    e += 1
                rows += _judge_block(c, k, texts[a:e], a, segments)
                a = e
            at = [r[0] for r in rows]
            foreign = pa.array([r[5] for r in rows], pa.list_(pa.struct([("segment_no", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())])))
            by = pa.array([r[4] for r in rows], pa.map_(pa.string(), pa.int64()))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(len(keys))], pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), by, foreign], names=[*keys, "language", "confidence", "n_letters", "by_language", "foreign"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{types}, language string, confidence double, n_letters long, by_language map<string,bigint>, foreign array<struct<segment_no: int, language: string, confidence: double>>")


def _judge_block(c: Classifier, k: int, texts: list[str | None], offset: int, segments: bool) -> list[tuple]:
    lines, owner, number, starts, weight = [], [], [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        short = []
        ended = True  # whether the line before leaves no sentence open
        for n, x in enumerate(t.split("\n"), 1):
            if not x or x.isspace():
                ended = True
                continue
            m = masked(x) if segments or "\\" in x or "http" in x or "<" in x or "[" in x else x
            if len(m) < SHORT + 5:
                short.append(m)
            if len(m) >= SHORT + 5 or segments and ended and _whole(m):
                lines.append(m)
                owner.append(i)
                number.append(n)
                starts.append(ended)
                weight.append(len(m) >= SHORT + 5)  # letters of short lines count with line 0
            ended = not segments or bool(_ENDED.search(x)) or _thai(x)
        if short:  # short lines together, as line 0
            lines.append(" ".join(short))
            owner.append(i)
            number.append(0)
            starts.append(False)
            weight.append(True)
    if not lines:
        return []
    best, sure, count = c.judge(lines)
    own, counted = np.array(owner), count * np.array(weight)
    score = np.zeros((len(texts), k))
    np.add.at(score, (own, best), counted)
    trust = np.zeros((len(texts), k))
    np.add.at(trust, (own, best), counted * sure)
    out = []
    start = 0
    for i in np.unique(own).tolist():
        end = start
        while end < len(own) and own[end] == i:
            end += 1
        total = int(score[i].sum())
        if total >= 2:
            main = int(score[i].argmax())
            confidence = float(trust[i, main] / max(1, score[i, main]) * score[i, main] / total)
            foreign = []
            if segments:
                for j in range(start, end):
                    if number[j] and starts[j] and best[j] != main and sure[j] >= SURE and count[j] >= _least(lines[j]) and _whole(lines[j]):
                        foreign.append({"segment_no": number[j], "language": c.languages[best[j]], "confidence": float(sure[j])})
            by = [(c.languages[x], int(score[i, x])) for x in np.flatnonzero(score[i]).tolist()]
            # A text is rejected by how sure its own lines are, however many languages stand beside them.
            name = c.languages[main] if trust[i, main] >= REJECT * score[i, main] else "und"
            out.append((offset + i, name, confidence, total, by, foreign))
        start = end
    return out


def _least(line: str) -> int:
    """Letters that a line needs to be foreign, by the script of most of its words' letters."""
    own = [c for w in _WORDS.findall(line) for c in w]
    return next((n for a, b, n in FOREIGN_BY_SCRIPT if 2 * sum(a <= c <= b for c in own) > len(own)), FOREIGN)


def _whole(line: str) -> bool:
    """Whether a line can be whole sentences: it ends like one, or is of a script that marks no ends."""
    return bool(_ENDED.search(line.strip())) or _thai(line)


def _thai(line: str) -> bool:
    return sum("\u0e00" <= x <= "\u0eff" for x in line) > 0.6 * len(line.strip())
