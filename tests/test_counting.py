"""N-grams counted inside tasks against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.operators import charsets as B
from lingmill.operators import counting
from lingmill.operators import ngrams as G


def plain(rows, lengths):
    out = Counter()
    for lang, text in rows:
        for i in range(len(text)):
            two = text[i : i + 2]
            if two == "  " or len(two) == 2 and all(c in "0123456789" for c in two):
                continue
            out.update((lang, n, text[i : i + n]) for n in lengths if i + n <= len(text))
    return out


@pytest.mark.parametrize("lengths", [(3, 4), (2,), (3, 4, 5, 6)])
def test_text_counts(spark, monkeypatch, lengths):
    """Short lines, one longer than a chunk, astral characters, more characters than a number holds, a null key."""
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 1500)))
    rows = [("en", "the  cat 12 sat"), (None, "a"), (None, "abc" * 20), ("zh", many + many), ("en", "x😀y😀zé" * 50), ("de", "")]
    table = counting._Table(lengths, False, {})
    monkeypatch.setattr(counting, "CHUNK", 64)
    monkeypatch.setattr(counting, "HELD", 100)
    monkeypatch.setattr(counting, "KEPT", 150)
    import pyarrow as pa

    got = Counter()
    parts = [p for lang, text in rows for p in map(list, table.add((pa.scalar(lang, pa.string()),), [text]))]
    for part in [*parts, table.taken()]:
        for key, n, grams, cnt in part:
            got.update({(key[0].as_py(), n, g): int(c) for g, c in zip(grams.to_pylist(), cnt, strict=True)})
    assert got == plain(rows, lengths)


def test_counts_leave_tasks_counted(spark):
    """A row per n-gram leaves a task; before, every character of the texts was a row of the plan."""
    docs = spark.range(0, 2000, 1, 2).select(F.lit("en").alias("lang"), F.lit("the same line of text\nand another one").alias("text"))
    out = G.counts(docs, (3, 4))
    assert "Generate explode(transform" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.lang, r.n, r.gram): r.cnt for r in out.collect()}
    assert got == {k: 2000 * c for k, c in plain([("en", x) for x in ("the same line of text", "and another one")], (3, 4)).items()}


def test_window_scores_by_cells_and_by_postings(spark, monkeypatch):
    contents = B.in_charsets(spark.createDataFrame([(1, "en", "the cat and the dog 😀 é"), (2, "fr", "le chat été là")], "doc_id long, lang string, text string"), ("utf-8", "utf-16-le", "cp850"), "doc_id", "lang")
    assert {(r.doc_id, r.charset): bytes(r.content) for r in contents.collect()} == {(i, c): t.encode(c, "replace") for i, t in ((1, "the cat and the dog 😀 é"), (2, "le chat été là")) for c in ("utf-8", "utf-16-le", "cp850")}
    rows = B.train(contents, (2, 4), 50).select("lang", "charset", "gram", "weight").toArrow()
    blocks = ["the cat".encode(), "le chat".encode("utf-16-le"), b"", b"\0the"]
    fast = B.ByteModels(rows)
    monkeypatch.setattr(B, "CELLS", 0)
    slow = B.ByteModels(rows)
    assert fast.cells is not None and slow.cells is None
    assert np.allclose(fast.table(blocks), slow.table(blocks)) and fast.table(blocks).any()


@pytest.mark.parametrize("lengths", [(3, 4), (3, 4, 5, 6), (2, 7)])
def test_frequent_rows_are_those_of_all_counts(spark, monkeypatch, lengths):
    """The K most frequent with ties and the totals; no row per n-gram and task is shuffled, as for all counts."""
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 1500)))
    texts = [("en", "the cat sat on the mat"), ("en", "the  cat 12 sat\0x\0"), (None, "abc" * 20), ("zh", many + many), ("en", "x😀y😀zé" * 50), ("de", "")] * 3
    rows = spark.createDataFrame(texts, "lang string, line string").repartition(3)
    out = counting.frequent(rows, ("lang",), "line", lengths, 5)
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.lang, r.n, r.gram, r.cnt) for r in out.collect()]
    want = plain(texts, lengths)
    total = Counter()
    for (lang, n, _), c in want.items():
        total[lang, n] += c
    sums = Counter()
    for lang, n, gram, c in got:
        sums.update({(lang, n): c} if gram is None else {})
        assert gram is None or want[lang, n, gram] == c
    assert sums == total
    for key in total:
        all_counts = sorted((c for (lang, n, _), c in want.items() if (lang, n) == key and c > 1), reverse=True)
        least = max(all_counts[min(5, len(all_counts)) - 1], 2) if len(all_counts) >= 5 else 2
        assert {g for (lang, n, g), c in want.items() if (lang, n) == key and c >= least} <= {g for lang, n, g, c in got if (lang, n) == key}
