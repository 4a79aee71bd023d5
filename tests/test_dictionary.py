"""Cover by the longest known words against a plain scan."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lingmill.operators import dictionary as D
from lingmill.operators.trie import Trie

TEXT = st.text(st.sampled_from("abcé \U0001f600"), max_size=40)


def by_hand(text, words):
    i = covered = found = 0
    while i < len(text):
        n = max((len(w) for w in words if w and text.startswith(w, i)), default=0)
        covered, found, i = covered + n, found + (n > 0), i + max(n, 1)
    return covered, found


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text(st.sampled_from("abcé"), min_size=1, max_size=5), max_size=15), st.lists(TEXT, max_size=6))
def test_longest_words_are_taken_from_the_left(words, texts):
    got = D.covered(texts, Trie(list(words)))
    assert list(zip(*(g.tolist() for g in got), strict=True)) == [by_hand(t, words) for t in texts]


def test_a_long_text():
    words = {"ab", "abab", "ba", "bab"}
    text = "abababx" * 50_000 + "ab"
    assert tuple(int(g[0]) for g in D.covered([text], Trie(list(words)))) == by_hand(text, words)


def test_cover_of_a_table(spark):
    texts = [None, "", " \t ", "The catalogue", "catcats dog\ncat"] * 3
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, words string")
    words = spark.createDataFrame([("cat",), ("Log",), ("",), (None,), ("cats",), ("cat",)], "term string")
    for D.CHARS in (1 << 20, 1):
        got = {r.doc_id: (r.chars, r.covered, r.blanks, r.words) for r in D.cover(docs, words).collect()}
        assert got == {i: [(0, 0, 0, 0), (0, 0, 0, 0), (3, 0, 3, 0), (13, 6, 1, 2), (15, 10, 1, 3)][i % 5] for i in range(15)}
    assert {r.covered for r in D.cover(docs, words.limit(0)).collect()} == {0}
    assert D.cover(docs.limit(0), words).count() == 0
