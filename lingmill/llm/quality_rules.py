"""Repetition coverage: characters inside duplicated word n-grams and lines, by rolling hashes.

For n-gram lengths 5, 7 and 10 every window of a document is hashed; windows equal to an
earlier one of the same document mark their words, and the marked words' code points are the
coverage. Lines equal to an earlier line count likewise. A document fails where any coverage
exceeds its share of the document's word characters.

Defined cases: a null or blank text has no words and fails the base rules; repeated rows are
judged each for itself; an empty table gives no rows; other columns are ignored; a text longer
than a batch is one batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U64, Words, code_points, counted, mix, ngram_hashes, slices, span_hashes, utf8
from .common import map_arrow, table, text_or_empty

#: n-gram length -> largest percentage of word characters inside repeated n-grams.
COVERAGE_LIMITS = {5: 15, 7: 13, 10: 10}
#: Largest percentage of lines, and of word characters, in repeated lines.
LINE_LIMIT, LINE_CHAR_LIMIT = 30, 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets; empty ranges are 0."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


#: Low bits of a sort key that hold a position, so that one plain sort orders keys and places.
PLACE_BITS = 20
PLACES = U64((1 << PLACE_BITS) - 1)


def _repeats(key: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys equal an earlier key; with first_too also the first of them."""
    out = np.zeros(len(key), bool)
    if len(key) < 2:
        return out
    if len(key) <= int(PLACES):
        packed = np.sort((key & ~PLACES) | np.arange(len(key), dtype=U64))
        near = np.flatnonzero((packed[1:] ^ packed[:-1]) <= PLACES)
        one, two = (packed[near] & PLACES).astype(np.int64), (packed[near + 1] & PLACES).astype(np.int64)
        if not (key[one] != key[two]).any():  # else the cut keys mix different ones: sort in full
            out[two] = True
            if first_too:
                out[one] = True
            return out
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = True
    if first_too:
        out[order[:-1][same]] = True
    return out


def _covered(words: Words, doc: np.ndarray, hashed: np.ndarray, n: int, first_too: bool) -> np.ndarray:
    """Words inside windows of n words that are repeated in their own document."""
    every = ngram_hashes(hashed, n)
    m = len(every)
    out = np.zeros(len(hashed), bool)
    if not m:
        return out
    whole = doc[:m] == doc[n - 1 :]
    at = np.flatnonzero(whole)
    key = mix(every[at] ^ (doc[at].astype(U64) * U64(0x9FB21C651E98DF25)))
    hit = at[_repeats(key, first_too)]
    edge = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of some rows, whose UTF-8 bytes lie between neighbouring offsets."""
    words = Words(data, off)
    hashed = words.hashes(lower=False)
    rows = len(off) - 1
    doc = np.repeat(np.arange(rows), np.diff(words.row))
    point = code_points(data)
    size = (point[words.end] - point[words.start]).astype(np.int64)
    del point
    out = {"n_words": np.diff(words.row), "word_chars": _sums(size, words.row), "n_symbols": counted(SYMBOLS, data, off)}
    # lines start at every row and after every newline; an empty row shares its start with the next
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(rows), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((line_doc, starts))
    starts, line_doc = starts[order], line_doc[order]
    of_line = np.searchsorted(starts, words.start, side="right") - 1
    per_line = np.bincount(of_line, minlength=len(starts))
    line_chars = np.bincount(of_line, weights=size, minlength=len(starts)).astype(np.int64)
    live = np.flatnonzero(per_line > 0)
    stops = np.append(breaks, len(data))
    end = np.minimum(stops[np.searchsorted(stops, starts[live])], off[1:][line_doc[live]])
    key = mix(span_hashes(data, starts[live], end, lower=False) ^ (line_doc[live].astype(U64) * U64(0x9FB21C651E98DF25)))
    dup = _repeats(key, first_too=False)
    out["n_lines"] = np.bincount(line_doc[live], minlength=rows)
    out["n_dup_lines"] = np.bincount(line_doc[live][dup], minlength=rows)
    out["dup_line_chars"] = np.bincount(line_doc[live][dup], weights=line_chars[live][dup], minlength=rows).astype(np.int64)
    out["n_repeat_words"] = _sums(_covered(words, doc, hashed, 3, True), words.row)
    for n in COVERAGE_LIMITS:
        out[f"dup{n}_chars"] = _sums(size * _covered(words, doc, hashed, n, False), words.row)
    return {k: v.astype(np.int64) for k, v in out.items()}


FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup{n}_chars" for n in COVERAGE_LIMITS)]


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row; n_* and *_chars are counts in the whole text."""
    schema = "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                got = measure(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(got[f]) for f in FIELDS)], names=["doc_id", *FIELDS])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, schema)


def judged(stats: DataFrame) -> DataFrame:
    """Adds base_failed and kept; all comparisons are in whole numbers."""
    c = F.col
    base = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    worn = (100 * c("n_dup_lines") > LINE_LIMIT * c("n_lines")) | (100 * c("dup_line_chars") > LINE_CHAR_LIMIT * c("word_chars"))
    for n, limit in COVERAGE_LIMITS.items():
        worn = worn | (100 * c(f"dup{n}_chars") > limit * c("word_chars"))
    return stats.withColumn("base_failed", base).withColumn("kept", ~(base | worn))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(repetition(table(spark, sf_dir, "documents"))).drop("n_lines")


def _sql() -> str:
    blank = r"[^\x20\x09-\x0D]+"
    spans = ", ".join(f"max(rep{n}) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS cov{n}" for n in COVERAGE_LIMITS)
    grams = ", ".join(f"CASE WHEN p + {n} <= n THEN list_aggregate(list_slice(ws, p + 1, p + {n}), 'string_agg', ' ') END AS g{n}" for n in (3, *COVERAGE_LIMITS))
    reps = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY p) > 1 THEN 1 ELSE 0 END AS rep{n}" for n in COVERAGE_LIMITS)
    sums = ", ".join(f"sum(CASE WHEN cov{n} = 1 THEN length(w) ELSE 0 END)::BIGINT AS dup{n}_chars" for n in COVERAGE_LIMITS)
    zero = ", ".join(f"coalesce(dup{n}_chars, 0) AS dup{n}_chars" for n in COVERAGE_LIMITS)
    worn = " OR ".join(f"100 * dup{n}_chars > {limit} * word_chars" for n, limit in COVERAGE_LIMITS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{blank}') AS ws FROM documents),
x AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(len(ws))) AS p FROM d),
g AS (SELECT doc_id, p, ws[p + 1] AS w, {grams} FROM x),
r AS (SELECT doc_id, p, w, CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 THEN 1 ELSE 0 END AS rep3, {reps} FROM g),
s AS (SELECT doc_id, p, w, max(rep3) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cov3, {spans} FROM r),
a AS (SELECT doc_id, sum(cov3)::BIGINT AS n_repeat_words, sum(length(w))::BIGINT AS word_chars, {sums} FROM s GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l1 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
         list_sum(list_transform(regexp_extract_all(line, '{blank}'), lambda w: length(w)))::BIGINT AS c FROM l0 WHERE regexp_matches(line, '{blank}')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(c) FILTER (dup), 0)::BIGINT AS dup_line_chars FROM l1 GROUP BY doc_id),
j AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, {zero}
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT * EXCLUDE (n_lines), NOT (base_failed OR 100 * n_dup_lines > {LINE_LIMIT} * n_lines OR 100 * dup_line_chars > {LINE_CHAR_LIMIT} * word_chars OR {worn}) AS kept FROM b
"""


SQL = _sql()
