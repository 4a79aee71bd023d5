"""Texts of more characters than small numbers hold."""

import math

from pyspark.sql import functions as F

from lingmill.operators import strings as S


def test_confidence_of_a_long_line(spark):
    """46,341 characters are the first whose square passes 32 bits."""
    rows = spark.createDataFrame([(n, "a" * n) for n in (46_340, 46_341, 120_000)], "n long, line string")
    got = {r.n: r.c for r in rows.select("n", S.confidence(F.col("line")).alias("c")).collect()}
    assert got == {n: min(4 * 2 * 0.5 * math.sqrt(n), S.CAP) for n in got}
    shown = rows.select(S.formatted(F.lit("d"), F.col("n"), F.round(S.confidence(F.col("line")), 3), F.lit("xx"), F.lit("ascii"), F.lit("t")).alias("row")).collect()
    assert all("99.999" in r.row for r in shown)


def test_runs_too_short_are_never_kept():
    """Read a byte a character, text in 16 bits is a run a letter; none of them may become a string."""
    data = b"\0" * 8 + ("word and word é " * 500).encode("utf-16-le") + b"\0" * 8
    assert [len(S._Runs(data, c, 4, 1000).rows) for c in ("ascii", "latin-1", "utf-8")] == [0, 0, 0]
    (got,) = S.sniffed_strings(data)
    assert (got["offset"], got["length"], got["encoding"], got["text"]) == (8, 16_000, "utf-16-le", "word and word é " * 500)
    apart = ("ab" + "!" * 1001 + "cdef").encode()
    assert [r["text"] for r in S.best_strings(apart, ["ascii"], gap=1000)] == ["ab" + "!" * 1000, "cdef"]
    assert [r["text"] for r in S.best_strings("ab\1日本\1abcd".encode(), ["utf-8"])] == ["日本", "abcd"]
