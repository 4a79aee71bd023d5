"""The double-array trie against plain search, and identification by it against the join."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lingmill.operators import ngrams as G
from lingmill.operators.trie import Trie

WORDS = st.text(st.sampled_from("abé\U0001f600\x00 "), max_size=5)


def laid(trie, texts):
    """Codes of texts behind one another with a 0 between, and where each begins."""
    points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    return np.concatenate([np.append(trie.codes(p), 0) for p in points]) if points else np.zeros(0, np.int32)


def by_hand(strings, texts):
    out, at = [], 0
    for t in texts:
        out += [(at + i, s) for s in strings for i in range(len(t)) if t.startswith(s, i)]
        at += len(t) + 1
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.sets(WORDS.filter(bool), max_size=30), st.lists(st.text(st.sampled_from("abécz\U0001f600\x00 "), max_size=20), max_size=5))
def test_finds_every_string_at_every_place(strings, texts):
    trie = Trie(list(strings))
    start, found = trie.matches(laid(trie, texts))
    assert sorted(zip(start.tolist(), (trie.strings[k] for k in found), strict=True)) == by_hand(strings, texts)


def test_many_strings():
    draw = random.Random(4)
    strings = {"".join(draw.choices("abcdefghijklmnopqrstuvwxyzéèü ", k=draw.randint(1, 6))) for _ in range(20_000)}
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzéèü ", k=3000))
    trie = Trie(list(strings))
    start, found = trie.matches(laid(trie, [text]))
    want = sorted((i, text[i : i + n]) for i in range(len(text)) for n in range(1, 7) if i + n <= len(text) and text[i : i + n] in strings)
    assert sorted(zip(start.tolist(), (trie.strings[k] for k in found), strict=True)) == want
    assert len(trie.base) < 3 * sum(map(len, strings))


def test_identification_equals_the_join(spark):
    draw = random.Random(8)
    texts = [None, "", "a", "x\n\ny", "é" * 3000] + ["\n".join(" ".join(draw.choices(["the", "und", "Ça", "ño", "a  b", "12"], k=draw.randint(0, 12))) for _ in range(4)) for _ in range(40)]
    docs = spark.createDataFrame([(i // 2 if i % 9 else None, t, ["en", "de", "fr", None][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = G.train(docs, (1, 2, 3), 50)
    plain = lambda df: sorted(((r.doc_id, r.line_no, r.guess, round(r.score, 9)) for r in df.collect()), key=repr)
    for cells in (G.CELLS, 1):
        G.CELLS, before = cells, G.CELLS
        try:
            got = plain(G.identify(G.lines(docs), model, lengths=(1, 2, 3)))
        finally:
            G.CELLS = before
        assert got and got == plain(G.identify_joined(G.lines(docs), model, lengths=(1, 2, 3)))
    assert G.identify(G.lines(docs), model.limit(0), lengths=(1, 2, 3)).count() == 0
