from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import tokens

PATH = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens._vocabulary(PATH).ranks, special_tokens={})


def ids(text):
    ends, flat = tokens.encode_texts([text], PATH)
    assert ends.tolist() == [0, len(flat)]
    return flat.tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens._vocabulary(PATH).ranks, special_tokens={})
    assert ids(text) == e.encode_ordinary(text)


def test_odd_texts(reference):
    for t in ["a" * 5000, " " * 700, "鍵の集合は" * 300, "\r\n\t \n x", "<|endoftext|>", "don't WE'VE 12345678901", "🙂👩‍💻é́", "\0\x01", "١٢٣ ½ ²"]:
        assert ids(t) == reference.encode_ordinary(t)


def test_append_and_edit():
    v = tokens._vocabulary(PATH)
    random.seed(1)
    data = "The prefix table keeps every prefix's last token; naïve 12 鍵!".encode()
    grown = tokens.PrefixTable(v)
    for k in range(0, len(data), 7):
        grown.append(data[k : k + 7])
        assert grown.ids() == v.merged(data[: k + 7])
    for _ in range(40):
        a = random.randrange(len(data))
        b = random.randrange(a, len(data) + 1)
        by = bytes(random.choice(b"abc e\xc3\xa9") for _ in range(random.randrange(4)))
        data = data[:a] + by + data[b:]
        assert grown.replace(a, b, by).ids() == v.merged(data) if data else grown.replace(a, b, by).ids() == []
        if not data:
            break


def test_an_edit_stops_where_the_tokens_agree():
    v = tokens._vocabulary(PATH)
    random.seed(4)
    data = " ".join(random.choice(["key", "vector", "naïve", "鍵", "12", "softmax"]) for _ in range(6000)).encode()
    table = tokens.PrefixTable(v).append(data)
    for at in (10, 15_000, len(data) - 40):
        while data[at] & 0xC0 == 0x80:
            at += 1
        data = data[:at] + b"abc" + data[at:]
        table.replace(at, at, b"abc")
        assert table.data == data and table.last == tokens.PrefixTable(v).append(data).last
        assert table.encoded <= 3 + 3 * v.longest


WORDS = st.sampled_from(["it", "'s", "'", "ve", "'ve", " ", "  ", "\n", "naïve", "鍵", "12", "...", "don't", "a" * 90, "é", "\t", "!?"])


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=40), st.lists(WORDS, max_size=4), st.integers(0, 400), st.integers(0, 60))
def test_encoding_again_near_an_edit(before, by, at, cut):
    old = "".join(before)
    at = min(at, len(old))
    new = old[:at] + "".join(by) + old[at + cut :]
    got, _ = tokens.reencode(old, ids(old), new, PATH)
    assert got == ids(new)


def test_only_pieces_near_an_edit_are_encoded():
    old = "The mill lies above the river. " * 2000
    for at in (0, 31_000, len(old) - 5):
        new = old[:at] + "naïve " + old[at + 4 :]
        got, n = tokens.reencode(old, ids(old), new, PATH)
        assert got == ids(new) and n < 12
    assert tokens.reencode(old, ids(old), old, PATH) == (ids(old), 0)


def test_edited_rows(spark):
    rows = [(1, "a cafe here", "a café here"), (2, "x", None), (3, None, "new"), (4, "", "now"), (5, "same", "same"), (5, "same", "same"), (6, "gone", "")]
    df = spark.createDataFrame([(k, o, None if o is None else ids(o), n, 7) for k, o, n in rows], "doc_id bigint, old string, ids array<int>, new string, k int")
    got = sorted((r.doc_id, r.ids) for r in tokens.edited_ids(df, "doc_id", "old", "ids", "new").collect())
    assert got == sorted((k, ids(n) if n else []) for k, _, n in rows)
    assert tokens.edited_ids(df.where("false"), "doc_id", "old", "ids", "new").count() == 0


def test_restored_documents(spark, data):
    from vecloom.llm import queries

    fixed = {r.doc_id: r.restored for r in queries.p8_restored(spark, data).collect() if r.restored is not None}
    got = {r.doc_id: r.ids for r in queries.p6_restored(spark, data).collect()}
    assert got == {k: ids(t) for k, t in fixed.items()}


def test_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "Hello world", "x", 1), (3, "Hello world", "x", 1), (None, "a", "x", 1), (5, "   ", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, size int")
    got = sorted(((r.doc_id or 0, r.ids) for r in tokens.token_ids(df, "doc_id", "text").collect()))
    assert got == [(0, [64]), (1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (5, [220, 220, 220])] or [g[0] for g in got] == [0, 1, 2, 3, 3, 5] and got[1][1] == got[2][1] == []
    assert sorted((r.doc_id or 0, r.size) for r in tokens.token_sizes(df, "doc_id", "text").collect()) == [(k, len(v)) for k, v in got]
    assert tokens.token_ids(df.where("false"), "doc_id", "text").count() == 0
    assert tokens.token_ids(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_the_vocabulary_is_sent(spark, tmp_path):
    """Tasks read the file that was sent where its own path doesn't exist on their machine."""
    import shutil

    at = tmp_path / "own_vocabulary.tiktoken"
    shutil.copy(PATH, at)
    df = spark.createDataFrame([(1, "Hello world")], "doc_id bigint, text string")
    assert tokens.token_ids(df, "doc_id", "text", str(tmp_path), "own_vocabulary").first().ids == ids("Hello world")
    assert tokens._here(str(at)) == str(at)
    at.rename(tmp_path / "moved")
    assert tokens._here(str(at)) != str(at) and tokens.Vocabulary.load(tokens._here(str(at))).ranks == tokens._vocabulary(PATH).ranks


def test_round_trip(spark, medium):
    from vecloom.llm import queries
    from vecloom.sources import table

    v = tokens._vocabulary(PATH)
    texts = {r.doc_id: r.text for r in table(spark, medium, "documents").select("doc_id", "text").collect()}
    got = queries.p6_ids(spark, medium).collect()
    assert len(got) == len(texts)
    for r in got:
        assert b"".join(v.bytes_of[i] for i in r.ids).decode() == (texts[r.doc_id] or "")
