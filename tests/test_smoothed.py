"""Smoothing of documents that come one after the other in a task."""

import math

from lingmill.operators import ngrams as G


def test_smoothed_steps_through_sorted_documents(spark):
    """Equal to the fold by hand; no pandas group per document is in the plan, whose cost a document was that of a pivot."""
    rows = [(d, i, 10 + 7 * i, g, 0.1 + (d * 7 + i * 3 + k) % 5) for d in range(60) for i in range(9) for k, g in enumerate(("de", "en", "fr")) if (d + i + k) % 4]
    scores = spark.createDataFrame(rows[::-1], "doc_id long, line_no int, len int, guess string, score double")
    out = G.smoothed(scores)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for d in range(60):
        own = [r for r in rows if r[0] == d]
        guesses, prior = {r[3] for r in own}, None
        for i in range(9):
            got, size = {r[3]: r[4] for r in own if r[1] == i}, 10 + 7 * i
            if prior is None:
                mixed, prior = got, {g: s * math.log(size) for g, s in got.items() if s > G.GUESS}
            else:
                prior = {g: s / 4 for g, s in prior.items()}
                w = 0.5 * math.cbrt(size) + 0.3 * (max(got.values()) / G.UNSURE) ** 1.33
                mixed = {g: w / (1 + w) * got.get(g, 0) + prior.get(g, 0) / (1 + w) / (2 + 0.25 * math.log(size)) for g in guesses}
                prior = {g: prior.get(g, 0) + got.get(g, 0) for g in guesses}
            want |= {(d, i, g): round(mixed.get(g, 0.0), 9) for g in guesses}
    assert {(r.doc_id, r.line_no, r.guess): round(r.score, 9) for r in out.collect()} == want
