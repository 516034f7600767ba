import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import packing, tokenizer
from papyrine.llm.q_tokens import vocabulary

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    e = tokenizer.encoder(vocabulary())
    index, _, count = e.encode(texts)
    flat = e.ids(index)
    return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]


TEXTS = ["", "a", " ", "  ", "\n\n a", "don't we'll 's 'S x's 's's 'st", "<|endoftext|> </s>", "½²Ⅷ 12ab", "日本語のテキスト。" * 40, "นี่คือข้อความ ไทย", "e\u0301\u200b\ufeff x\x1cy", "a" * 20000, "=" * 3000 + " ok", "🙂🙂 x_1 = 3.5e-7", "\t\t\x0b z\x85\xa0 q"]


def test_same_ids_as_the_reference(reference):
    assert ids(TEXTS) == [reference.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n'srtvemld\t.,1aZé日 ²ा𝛼\u0301_")), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_random_texts(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))} if not hasattr(test_random_texts, "r") else None
    if ranks:
        test_random_texts.r = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids(texts) == [test_random_texts.r.encode_ordinary(t) for t in texts]


def test_round_trip_and_exact_merging(reference):
    e = tokenizer.encoder(vocabulary())
    for w in ["characteristically", " Donaudampfschifffahrt", "日本語", "aaaa" * 9, "\u0e40\u0e23\u0e35\u0e22\u0e1a"]:
        own = e.exact(w.encode())
        assert own == reference.encode_ordinary(w)
        assert b"".join(e.tokens[i] for i in own).decode() == w


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "the mesh", "z"), (3, "the mesh", "z")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode(df, "doc_id", "text", vocabulary()).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    assert tokenizer.encode(df.where("false"), "doc_id", "text", vocabulary()).count() == 0
    counts = {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(df, "doc_id", "text", vocabulary()).collect()}
    assert counts == {1: 0, 2: 0, 3: 2}


def check_packing(rows, sizes, capacity):
    by, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
        if r.container is not None:
            by[r.container] = by.get(r.container, 0) + r.n_tokens
    assert all(0 < x <= capacity for x in by.values())
    for k, n in sizes.items():
        own = sorted(pieces[k])
        assert sum(x[2] for x in own) == (n or 0)
        if (n or 0) <= capacity:
            assert len(own) == 1
        else:
            assert all(x[2] == capacity for x in own[:-1])
    return by


def test_packing_keeps_every_token_and_wastes_little(spark):
    rng = np.random.default_rng(1)
    sizes = {int(i): int(n) for i, n in enumerate(np.minimum(9000, rng.lognormal(5.5, 1.2, 3000).astype(int)))}
    sizes |= {90001: 0, 90002: None, 90003: 2048, 90004: 2049, 90005: 40_000}
    df = spark.createDataFrame([(k, n, "clash") for k, n in sizes.items()], "doc_id long, n long, size string")
    by = check_packing(packing.pack(df, "doc_id", "n").collect(), sizes, 2048)
    total = sum(n or 0 for n in sizes.values())
    assert 1 - total / (len(by) * 2048) < 0.02
    groups = {}
    for r in packing.pack(df, "doc_id", "n").where("container is not null").collect():
        groups[r.step_group] = groups.get(r.step_group, 0) + r.n_tokens
    assert max(groups.values()) - min(groups.values()) < 3 * 2048


def test_packing_of_one_hot_length_and_of_nothing(spark):
    df = spark.range(500).selectExpr("id as doc_id", "cast(700 as long) as n")
    by = check_packing(packing.pack(df, "doc_id", "n").collect(), {i: 700 for i in range(500)}, 2048)
    assert len(by) == 250
    assert packing.pack(df.where("false"), "doc_id", "n").count() == 0
