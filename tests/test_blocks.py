"""Blocks are scored without matching what they share again."""

import random

import numpy as np
import pytest

from lingmill.operators import ngrams as G
from lingmill.operators.trie import Trie


def _docs(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["die", "der", "the", "and", "ΟΔΟΣ", "İl", " ", "\t\t", "\n", "\r", "𝔸b"])
    plain = lambda: draw.choice(["die", "Der", "the", "and", " ", "  \t", "\n", "𝔸b"])
    texts = ["", None, "t", "the", " " * 500, "the " * 50 + " " * 300 + "der die", *("".join(draw.choice([word, plain][i % 2 :])() + " " for _ in range(draw.randint(1, 300))) for i in range(60))]
    return spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")


@pytest.mark.parametrize("weight", [1.0, -0.5])
def test_blocks_are_matched_once(spark, weight):
    """Equal to the scores of texts cut before, whose rows hold every character up to four times; no such rows are in the plan."""
    docs = _docs(spark)
    grams = ["the", "he ", "e t", " th", "der", "die", "ie ", " di", "the ", " and ", "a", "οδος", "οδοσ", "i̇l", "  ", "e\n", "nd the", "𝔸b", "b "]
    model = spark.createDataFrame([(g, len(t), t, (1 + k % 5) / 3 * (weight if k % 4 == 0 else 1)) for k, t in enumerate(grams) for g in (("de", "en") if k % 3 else ("en",))], "lang string, n int, gram string, weight double")
    lengths = (1, 2, 3, 4, 5, 6)
    for size in (80, 100):
        want = {(r.doc_id, r.block_start, r.guess): r.score for r in G.identify_joined(G.blocks(docs, size), model, ("doc_id", "block_start"), lengths).collect()}
        out = G.identify_blocks(docs, model, lengths, size)
        got = {(r.doc_id, r.block_start, r.guess): r.score for r in out.collect()}
        assert len(want) > 500 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert "block_end" not in out._jdf.queryExecution().analyzed().toString()


def test_texts_of_one_block_each():
    """No end of a block within a text: nothing is cut."""
    import pyarrow as pa

    known = G._Known(pa.table({"guess": ["en", "de"], "gram": ["the", "die"], "weight": [1.0, 0.5]}))
    of, start, long, row, guess, raw = G._block_sums(known, ["the die", "x"], np.array([True, True]), 80, 20)
    assert of.tolist() == [0, 1] and start.tolist() == [0, 0] and long.tolist() == [7, 1]
    assert {(i, known.names[g].as_py()): r for i, g, r in zip(row.tolist(), guess.tolist(), raw.tolist())} == {(0, "en"): 3.0, (0, "de"): 1.5}


def test_last_nodes_give_what_matches_give():
    draw = random.Random(1)
    for letters in ("ab", "abcdefghij", "".join(map(chr, range(200, 900)))):
        strings = ["".join(draw.choices(letters, k=draw.randint(1, 6))) for _ in range(300)]
        trie = Trie(strings)
        worth = np.array([[draw.random() for _ in trie.strings] for _ in range(3)])
        text = "".join(draw.choices(letters + "#", k=5000)) + "".join(draw.choices(strings, k=200))
        codes = trie.codes(np.frombuffer(text.encode("utf-32-le"), "<u4"))
        start, found = trie.matches(codes)
        want = np.stack([np.bincount(start, w[found], len(codes)) for w in worth])
        assert np.allclose(trie.along(worth)[:, trie.deepest(codes)], want)
    assert Trie([]).deepest(np.array([0, 0])).tolist() == [0, 0]
