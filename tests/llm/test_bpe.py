"""Byte-level BPE against the tokenizers library and against merging by hand."""

import hashlib
import json
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lingmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Letters, numbers and spaces of several planes, some of a later Unicode than the tokenizer's, and its added token.
PIECES = [*"ab 'sz\n\t\x85　é́�>1٣²\U0001f600ᲉꟚ\U00016d40࢏\x1c\x1f​漢字\x00", "<|endoftext|>", "<|endof", "  ", "'ll", "'re", "the ", "᳏0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Coder(PATH)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=40))
def test_equals_library(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == packed(ids)
    assert own.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decodes_any_ids_as_library(own, library, ids):
    assert own.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_ids_of_no_token_are_left_out(own):
    assert own.decode(packed([99_999, 64, 99_998])) == "a"


def by_hand(ids, ranks, made):
    ids = list(ids)
    while True:
        found = [(ranks[k], i) for i in range(len(ids) - 1) if (k := ids[i] << 20 | ids[i + 1]) in ranks]
        if not found:
            return ids
        rank, i = min(found)
        ids[i : i + 2] = [made[rank]]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=12, unique=True))
def test_tree_takes_the_leftmost_of_lowest_rank(ids, merges):
    ranks, made = {a << 20 | b: r for r, (a, b) in enumerate(merges)}, [4 + r for r in range(len(merges))]
    assert bpe.merged(list(ids), ranks, made) == by_hand(ids, ranks, made)


def test_full_cache_and_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "WORK_CHARS", 50)
    text = "one two three four five one two six\n\n  seven é漢 " * 50 + "z" * 5000 + " " * 300 + "\n end"
    assert bpe.Coder(PATH).encode(text) == packed(library.encode(text, add_special_tokens=False).ids)
    assert own.decode(own.encode(text)) == text


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Coder(str(tmp_path / "t.json"))


def check(spark, folder, library):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.op13_bpe(spark, str(folder)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return got


def test_query_on_given_table(spark, library):
    assert check(spark, "/root/testdata/sf0.001", library)


def test_query_on_odd_rows(spark, library, tmp_path):
    texts = [None, "", "a", "a", "<|endoftext|>", "x" * 70_000 + " y" * 70_000, "\x00\U0001f600Ᲊ"]
    df = spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(3, "a")], "doc_id long, text string")
    df.withColumns({c: F.lit("e") for c in ("ids", "n_tokens", "start")}).write.parquet(f"{tmp_path}/full/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert len(check(spark, tmp_path / "full", library)) == 8
    assert not check(spark, tmp_path / "none", library)
