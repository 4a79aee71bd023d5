"""Counts of word trigrams and of their parts against plain Python."""

import random
from collections import Counter

import pytest

from lingmill.operators import retrieval as R
from lingmill.operators import trigrams as T


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    rows = [" ".join(draw.choice(["a", "b", "C", "déjà", "e f", "ß"]) for _ in range(draw.randint(0, 30))) for _ in range(20)]
    return [*rows, "x " * 50, "x", "x y", None, ""]


def plain(texts):
    rows = [[w for w in t.lower().split(" ") if w] for t in texts if t]
    count = {n: Counter(tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1)) for n in (1, 2, 3)}
    head = {n: Counter() for n in (2, 3)}
    for n in (2, 3):
        for g, c in count[n].items():
            head[n][g[:-1]] += c
    return count, head


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_estimates(spark, texts):
    count, _ = plain(texts)
    want = {" ".join(g): c if c >= 3 else 0.5 * count[2][g[1:]] if count[2][g[1:]] >= 2 else 0.25 * count[1][g[2:]] for g, c in count[3].items()}
    got = T.estimates(docs(spark, texts), (3, 2, 1)).collect()
    assert len(got) == len(want) and {r.gram: r.estimate for r in got} == want


def test_ladder_and_conditional(spark, texts):
    count, head = plain(texts)
    want = {" ".join(g): (c, c / head[3][g[:2]], count[2][g[1:]] / head[2][g[1:2]], count[1][g[2:]] / sum(count[1].values())) for g, c in count[3].items()}
    got = R.ladder(docs(spark, texts)).collect()
    assert len(got) == len(want) and {r.gram: (r.freq, r.p3, r.p2, r.p1) for r in got} == want
    assert {r.gram: (r.freq, r.p) for r in R.conditional(docs(spark, texts), 3).collect()} == {g: v[:2] for g, v in want.items()}


def test_counts_of_all_orders_take_few_shuffles(spark, texts):
    """One shuffle for estimates, two for the ladder; joins of counts per order took seven and more."""
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(T.estimates(docs(spark, texts))) <= 2 and shuffles(R.ladder(docs(spark, texts))) <= 3
