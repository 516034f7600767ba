import random

import numpy as np
import pytest

from papyrine.llm import language, markup, scans, sentences, spam

# ---- markup -------------------------------------------------------------------------------------------------------

PLAIN = [
    "If a<b and c>d the bound fails (q<x, ρ>4).", "It lies at C:\\data\\run7 on the old disk.", "It costs $99 to $150, or $5,$6.", "The set {α : α > 2} and (u \\ y).", "See run_log_v8 and x_2, w_1 [12] (#31).", "R&D & more; 100 %.",
    "#tag #another", "https://a.example/b_c?x=1&y=2", "<|endoftext|> </s> <s>", "- 3 -", "1. First point", "[FORMULA_001] holds", "x = y\n= 3 + 4", "ρ* or x*, 7 * 55 * 2", "a -- b --- c", "<-- 49", "", None, "   ",
]
MARKED = [
    "<TABLE><TR><TD>a<TD>b</TR></TABLE>", "a&nbsp;b", "<!-- x -->", "\\textbf{a}", "$x = 1$", "$$y$$", "\\[ z \\]", "\\(z\\)", "# Title", "Title\n=====", "**bold**", "*it* is", "`code`", "```\nx\n```", "[a](http://b.c)", "![a](b.png)", "| a | b |\n|---|---|\n| 1 | 2 |",
    "== Head ==", "'''b'''", "''i''", "[[link|text]]", "{{cite|x}}", '{| class="w"\n|-\n| a\n|}', "~~no~~", "> quoted text", "* a\n* b", "<br>", "x<sub>2</sub>", "&#8211;", "{\\it a b}", "see \\cite{x}",
]


def test_markup_is_told_from_text():
    assert [t for t in PLAIN if markup.holds(t)] == []
    assert [t for t in MARKED if not markup.holds(t)] == []
    assert all(markup.kinds(t) for t in MARKED)


def test_plain_text_is_unchanged_and_structure_kept():
    assert [markup.clean(t) for t in PLAIN] == PLAIN
    assert markup.clean("\\section{Mesh}\nWe \\emph{show} it. \\ref{a}") == "# Mesh\nWe show it."
    assert markup.clean("<h2>Mesh</h2><p>a&nbsp;&lt; b</p><ul><li>x</li><li>y</li></ul>") == "## Mesh\n\na < b\n\n- x\n- y"
    assert markup.clean("| a | b |\n|---|---|\n| 1 | 2 |") == "a | b\n1 | 2"
    assert markup.clean("```python\nx = *y*\n```") == "```\nx = *y*\n```"
    assert markup.clean("so \\begin{equation}a_1 = b\\end{equation} holds") == "so \n$$a_1 = b$$\n holds".replace(" \n", "\n", 1)
    assert markup.clean("'''a''' [[b|c]] {{d}}") == "a c"
    assert markup.clean("x" * 200_000 + " <b>y</b>").endswith(" y")


def test_markup_tables(spark):
    df = spark.createDataFrame([("d", "r", "**x**", None, 1), ("d", "s", None, "<b>", 2), ("d", "t", "", "plain", 3)], "document_id string, record_id string, a string, b string, found int")
    keys = ["document_id", "record_id"]
    pages = markup.page_signs(df, keys, "document_id", ["a", "b"])
    found = markup.verified(pages, markup.classes(pages, least=1), keys)
    assert sorted(r.record_id for r in found.collect()) == ["r", "s"]
    none = markup.page_signs(df.where("false"), keys, "document_id", ["a"])
    assert none.count() == 0 and markup.verified(none, markup.classes(none), keys).count() == 0
    assert {r.record_id: r.clean_text for r in markup.cleaned(df, ["record_id"], "a", found.select("record_id")).collect()} == {"r": "x", "s": None, "t": ""}


def test_templates_are_classes_of_one_occurrence_vector(spark):
    rows = [("h", i, f"<div><p>{i} (note)</p></div> \\emph{{x{i}}}") for i in range(4)] + [("h", 9, "plain (text)"), ("h", 10, "<div>")]
    df = spark.createDataFrame(rows, "host string, page_id int, text string")
    pages = markup.page_signs(df, ["page_id"], "host", ["text"])
    valid = markup.classes(pages, least=3).where("host = 'h'")
    got = {tuple(r.tokens): r for r in markup.templates(pages, valid, ["page_id"]).collect()}
    assert any({"</p", "<p", "\\emph{", "}\\emph{"} <= set(t) and r.pages == 4 and r.slots == len(t) - 1 for t, r in got.items())
    held = markup.slots(df, pages, valid, ["page_id"], "text").collect()
    assert {r.page_id for r in held if "(note)" in r.slot} == {0, 1, 2, 3}
    # The page with a single tag of its own kind is found by the class of that tag; parentheses are a class, but no markup.
    assert sorted(r.page_id for r in markup.verified(pages, markup.classes(pages), ["page_id"]).collect()) == [0, 1, 2, 3, 10]


def test_markup_of_any_length_and_depth():
    assert all(markup.holds(t) for t in ("$" + "x + " * 400 + "y$", "\\[" + "x + " * 4000 + "y\\]", "\\(" + "x + " * 4000 + "y\\)", "an *" + "long " * 200 + "word* here", "an _" + "long " * 200 + "word_ here"))
    assert markup.clean("\\emph{" * 40 + "x" + "}" * 40 + " y") == "x y"
    assert markup.clean("a {{b {{c {{d}} e}} f}} g") == "a g"
    assert markup.clean("\\section{The \\emph{big} one}\nrest \\{a\\}") == "# The big one\nrest {a}"


# ---- sentences ----------------------------------------------------------------------------------------------------

EN = ["The mesh of Dr. K. Tellwyn is dense.", "We show it, e.g. for smooth fields.", "Here x denotes approx. 3.14 mm.", "Most points (see Fig. 2) were kept.", "None of them failed!", "Why should it vanish?", "If it is dense, then it holds.", "Using 3 runs, we stop at 4 a.m. because it rains."]
DE = ["Wir zeigen, dass es gilt.", "Prof. B. Quist fand ca. 3 Proben.", "Es gilt z. B. die Regel, d. h. etwa 3 mm.", "Warum sollte es verschwinden?"]
ZH = ["我们证明，这是对的。", "为什么会消失？", "审稿人写道：“可靠吗？不。”并要求补充。"]
TH = ["เราแสดงให้เห็นว่าพลังงานคงที่", "ทำไมพลังงานจึงหายไป", "ในที่นี้พลังงานหมายถึงความถี่"]


def sentence_texts(seed, n=400):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        pool, glue = r.choice([(EN, " "), (EN, " "), (DE, " "), (ZH, ""), (TH, " "), (EN, "\n"), (EN, "  ")])
        own = [r.choice(pool) for _ in range(r.randint(1, 5))]
        out.append((glue.join(own), own, glue))
    return out


def fitted(texts):
    from collections import Counter

    c = Counter(x for t in texts for x in sentences.contexts_of(t))
    return sentences.Model([(*k, n) for k, n in c.items()])


def test_sentence_ends_on_held_out_texts():
    m = fitted([t for t, *_ in sentence_texts(1)])
    good = every = extra = 0
    for t, own, glue in sentence_texts(2):
        want, at = set(), 0
        for s in own:
            want.add(at + len(s))
            at += len(s) + len(glue)
        got = set(m.ends(t))
        good, every, extra = good + len(want & got), every + len(want), extra + len(got - want)
    assert good / every > 0.98 and extra / every < 0.02


def test_sentences_of_odd_texts():
    m = fitted([t for t, *_ in sentence_texts(1)])
    assert m.ends("") == [] and m.ends(" \n ") == []
    assert m.ends("no mark here") == [12]
    assert m.ends("a line\n\n another one.  ") == [6, 21]
    assert m.ends("It (really. Yes.) is so.") == [24]
    assert m.ends("An open ( bracket. We show it, e.g. for smooth fields.")[-1] == 54
    long = " ".join(EN * 4000)
    assert len(m.ends(long)) > 25_000


def test_sentence_tables(spark):
    df = spark.createDataFrame([("d", "a", EN[0] + " " + EN[4], 1), ("d", "a", EN[0] + " " + EN[4], 2), ("d", "b", None, 1), ("d", "c", "", 1)], "document_id string, record_id string, text string, ends int")
    m = sentences.fit(df.select("text"))
    got = sentences.sentences(df, ["document_id", "record_id"], "text", m).collect()
    assert sorted((r.record_id, r.sentence_no, r.char_end) for r in got)[-1] == ("a", len(got) - 1, len(EN[0] + " " + EN[4]))
    none = df.where("false")
    assert sentences.sentences(none, ["record_id"], "text", sentences.fit(none.select("text"))).count() == 0


# ---- languages ----------------------------------------------------------------------------------------------------

WORDS = {
    "en": "the of and that mesh which holds with from field under this because when energy".split(), "de": "der die und dass nicht mit von Feld unter diese weil wenn Energie ist gilt".split(),
    "fr": "le la les et que dans avec pour champ sous cette parce quand énergie est".split(), "ru": "поле что при этом если энергия для матрицы значение между величины равен".split(), "zh": list("我们证明这里密度矩阵为什么会消失所有测量结果与无关"),
}


def line(lang, r, n=12):
    return ("" if lang == "zh" else " ").join(r.choice(WORDS[lang]) for _ in range(n)) + ("。" if lang == "zh" else ".")


def test_language_held_out_with_wrong_labels():
    r = random.Random(5)
    names = sorted(WORDS)
    lines, labels = [], []
    for _ in range(1200):
        g = r.choice(names)
        lines.append(line(g, r))
        labels.append(g if r.random() > 0.2 else r.choice(names))
    c = language.train(lines, labels)
    test = [(g, line(g, r)) for g in names for _ in range(40)]
    best, sure, _ = c.judge([t for _, t in test])
    hit = np.array([c.languages[b] == g for b, (g, _) in zip(best, test)])
    assert hit.mean() > 0.97
    assert sure[hit].mean() > 0.8


@pytest.fixture(scope="module")
def model():
    r = random.Random(6)
    lines = [(g, line(g, r)) for g in sorted(WORDS) for _ in range(150)]
    return language.train([t for _, t in lines], [g for g, _ in lines])


def test_language_segments_and_tables(spark, model):
    r = random.Random(7)
    text = "\n".join([line("en", r), "", line("de", r), line("en", r), "https://a.example/x", line("en", r)])
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "https://a.example/b 12", "x"), (5, line("ru", r), "x"), (5, line("ru", r), "x"), (6, line("zh", r) * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    got = {x.doc_id: x for x in language.judged(df, ["doc_id"], "text", model, True).collect()}
    assert sorted(got) == [1, 5, 6]
    assert got[1].language == "en" and [(s.segment_no, s.language) for s in got[1].foreign] == [(3, "de")]
    assert got[5].language == "ru" and got[6].language == "zh" and 0 < got[5].confidence <= 1
    assert language.judged(df.where("false"), ["doc_id"], "text", model, True).count() == 0
    codes = spark.createDataFrame([("en", "en"), ("German", "de")], "label_code string, lang string")
    assert language.fit(df.where("false"), "doc_id", "text", "language", codes).languages == []


def test_contexts_seen_once_count_whatever_their_number(spark):
    from string import ascii_lowercase as abc

    word = lambda i: "".join(abc[i // 26**k % 26] for k in range(4))
    rows = [("\n".join(f"Q{word(i)} holds." for i in range(a, a + 2000)),) for a in range(0, 170_000, 2000)]
    m = sentences.fit(spark.createDataFrame(rows, "text string"))
    assert m.event[".", "mark"][1] == 170_000 and sum(m.after["S", "", 1].values()) == 170_000


def test_short_foreign_sentences(spark, model):
    r = random.Random(8)
    zh = line("zh", r)[:9].rstrip("。") + "。"
    text = "\n".join([line("en", r), zh, line("en", r), zh[:4] + "。", zh[:-1], "", "Fig. 2.", line("en", r)])
    got = language.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], "text", model, True).head()
    assert got.language == "en" and [(s.segment_no, s.language) for s in got.foreign] == [(2, "zh")]
    assert got.n_letters == language.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], "text", model, False).head().n_letters


# ---- scans --------------------------------------------------------------------------------------------------------

BODY = ["the", "smooth", "density", "of", "every", "measured", "sample", "remains", "constant", "under", "these", "conditions", "because", "the", "control", "law", "is", "linear"]


@pytest.fixture(scope="module")
def lexicon():
    from collections import Counter

    r = random.Random(3)
    c = Counter()
    for _ in range(400):
        c.update(scans.counted(" ".join(r.choice(BODY) for _ in range(60))))
    c.update({"state-of-the-art": 30, "well-known": 40, "well": 30, "known": 60, "state": 20, "art": 20})
    return scans.Lexicon(dict(c))


def test_noise_is_found_by_kind(lexicon):
    f = lambda t: scans.findings(t, lexicon)
    assert f("the smooth den-\nsity of every sample") == ["hyphen"]
    assert f("the smooth den\u00ad\nsity of every sample") == ["hyphen"]
    assert f("the sm0oth density of every sarnple") == ["character"]
    assert f("the d e n s i t y of every sample") == ["space"]
    assert f("Annals of Mesh Research, vol. 4   12") == ["header"]
    assert f("the smooth density\nTransactions on Mesh Methods\nof every sample remains") == ["header"]
    assert f("the smooth density\n- 12 -\nof every sample") == ["page"]
    for clean in (None, "", "the smooth density of every\nsample remains constant", "a well-\nknown density", "the density of x_2 and run_v5 (Fig. 9b) &lt; 3", "3\n4\n5\n6\n7", "[12] the density"):
        assert f(clean) == []


def test_repair_gives_continuous_paragraphs(lexicon):
    text = "the smooth den-\nsity of every\nAnnals of Mesh Research, vol. 4\nmeasured sarnple\n- 7 -\nremains constant.\n\nunder these c o n d i t i o n s"
    assert scans.repaired(text, lexicon) == "the smooth density of every measured sample remains constant.\n\nunder these conditions"
    clean = "the smooth density of every\nsample remains constant."
    assert scans.repaired(clean, lexicon) == clean and scans.repaired(None, lexicon) is None
    assert "sample" in scans.repaired("sarnple " * 20_000, lexicon)


def test_faults_of_one_word_are_decoded_together(lexicon):
    assert set(scans.findings("the den slty of every", lexicon)) == {"character", "space"}
    assert scans.repaired("the den slty of every", lexicon) == "the density of every"
    assert scans.repaired("The sarn ple remains", lexicon) == "The sample remains"
    assert scans.repaired("the dens-\nlty of every", lexicon) == "the density of every"
    assert scans.repaired("every rneasu-\nred sample", lexicon) == "every measured sample"
    assert scans.repaired("the con ditlons", lexicon) == "the conditions"
    assert scans.findings("the smoothdensity of every", lexicon) == []  # words run together are no noise of a scan


def test_random_faults_are_repaired(lexicon):
    r = random.Random(11)
    wrong = [(x, y) for y, own in scans.CONFUSIONS.items() for x in own if y.isascii() and x.isascii() and x.isalnum()]
    good = every = 0
    for _ in range(300):
        words = [r.choice(BODY) for _ in range(9)]
        k = r.choice([i for i in range(9) if len(words[i]) > 5])
        x, y = r.choice([p for p in wrong if p[1] in words[k]])
        bad = words[k].replace(y, x, 1)
        if r.random() < 0.5:
            cut = r.randint(2, len(bad) - 2)
            bad = bad[:cut] + r.choice([" ", "-\n"]) + bad[cut:]
        every += 1
        good += scans.repaired(" ".join([*words[:k], bad, *words[k + 1 :]]), lexicon) == " ".join(words)
    assert good > 0.9 * every


def test_running_titles_are_told_by_repetition():
    from collections import Counter

    c = Counter()
    for k in range(9):
        c.update(scans.counted(f"Studia Mathematica {30 + k}\nthe smooth density of every sample"))
    lex = scans.Lexicon(dict(c))
    assert scans.lines_of("the smooth density\nStudia Mathematica 77\nof every sample", lex)[1][0] == "header"
    assert scans.lines_of("the smooth density\nStudia Botanica 77\nof every sample", lex)[1][0] == "body"  # not repeated
    assert scans.paragraphs([("body", f"line {k} of a very long paragraph") for k in range(5000)]) != []


def test_scans_tables(spark, lexicon):
    df = spark.createDataFrame([("d", "a", "the den-\nsity", 1), ("d", "b", None, 1), ("d", "c", "", 1)], "document_id string, record_id string, text string, findings int")
    got = {r.record_id: r.findings for r in scans.examined(df, ["document_id", "record_id"], "text", lexicon).collect()}
    assert got == {"a": ["hyphen"], "b": [], "c": []}
    none = df.where("false")
    assert scans.examined(none, ["record_id"], "text", scans.model(none.select("text"))).count() == 0


# ---- spam ---------------------------------------------------------------------------------------------------------


def test_spam_pages(spark):
    r = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("mes", "den", "lat", "ten", "ker", "sig") for b in ("h", "sity", "tice", "sor", "nel", "nal")]

    def prose(n):
        return " ".join("The " + " ".join(r.choice(["of the", "and a", "is", "in the", "that we", "with"]) + " " + r.choice(vocabulary) for _ in range(6)) + "." for _ in range(n))

    rows = [(i, prose(r.randint(4, 12)), "en") for i in range(150)]
    bad = {
        1000: " ".join(r.choice(["buy", "cheap", "best"]) + " mesh" for _ in range(80)), 1001: "\n".join(f"https://x.example/{i}" for i in range(30)), 1002: "\n".join(f"SKU-{i} cheap lattice 5.99 +++" for i in range(30)),
        1003: " | ".join(r.choice(vocabulary[:6]) for _ in range(90)), 1004: "\n".join(f"[best mesh](https://x.example/{i})" for i in range(30)),
    }
    fine = {2000: prose(4) + "\n" + "\n".join(f"{r.choice(vocabulary)}, {i}, {i}-{i + 3}" for i in range(20)), 2001: "\n".join(f"[{i}] A. Quist, {prose(1)} 12 2010, 27-64." for i in range(12)), 2002: prose(3) + " https://x.example/a", 2003: None, 2004: "", 2005: "12 13"}
    rows += [(k, t, "en") for k, t in {**bad, **fine}.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = spark.createDataFrame([("en", "en")], "label_code string, lang string")
    got = {x.key for x in spam.spam(df, "doc_id", "text", "lang", codes).where("spam").collect()}
    assert set(bad) <= got and not got & set(fine) and len(got) == len(bad)
    assert spam.spam(df.where("false"), "doc_id", "text", "lang", codes).count() == 0
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert spam.spam(unlabelled, "doc_id", "text", "lang", codes).count() == 158


def test_words_of_scripts_without_spaces():
    assert spam.words("密度矩阵") == ["密度", "度矩", "矩阵"]
    assert spam.words("") == [] and spam.number_share("") == 0 and spam.sentence_share("") == 0
    assert spam.sentence_share("The mesh is very dense. " * 3 + "buy buy") > 0.8
