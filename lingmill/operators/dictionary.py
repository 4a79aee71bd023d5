"""Cover of running text by the longest known words, wherever they begin, inside longer runs too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..stages import stage
from .ngrams import TRIE_ROWS
from .trie import Trie

#: Characters that are matched at a time, but for a longer text.
CHARS = 1 << 20


def _visited(step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which places are reached from those of begin, going step[i] on from i; all at once, by doubled steps.

    The last place of step is where everything ends.
    """
    to = np.minimum(np.arange(len(step)) + step, len(step) - 1)
    on = np.zeros(len(step), bool)
    on[begin] = True
    far = int(np.diff(np.append(begin, len(step))).max(initial=1))
    for _ in range(max(far, 1).bit_length()):
        on[to[on]] = True
        to = to[to]
    return on


def covered(texts: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Characters covered and words found of every text: at each place the longest word is taken, and the next place is behind it."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    codes = np.zeros(int((size + 1).sum()) + 1, np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.append(begin + size, len(codes) - 1)] = False
    codes[inside] = trie.codes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"))
    start, string = trie.matches(codes)
    longest = np.zeros(len(codes), np.int64)
    # matches() goes by length, so the longest of a place is written last.
    longest[start] = np.array([len(s) for s in trie.strings], np.int64)[string] if len(start) else 0
    step = np.where(inside, np.maximum(longest, 1), 0)
    step[-1] = 0
    took = _visited(step, begin) & (longest > 0)
    row = np.searchsorted(begin, np.flatnonzero(took), "right") - 1
    return np.bincount(row, longest[took], len(texts)).astype(np.int64), np.bincount(row, minlength=len(texts))


def cover(rows: DataFrame, words: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text", word: str = "term") -> DataFrame:
    """key, chars, covered, blanks, words of texts in lower case; a null text has zeros.

    covered: characters inside words taken by the longest match from left to right; blanks: blanks
    and tabs, which count as known. Null and empty words match nothing. The dictionary is a trie in the
    workers, of up to TRIE_ROWS words; a larger one is an error.
    """
    spark = rows.sparkSession
    known = stage(words.select(F.lower(word).alias("w")).filter("w <> ''").distinct(), "words")
    if known.count() > TRIE_ROWS:
        raise ValueError(f"a dictionary of over {TRIE_ROWS} words does not go to the workers")
    shared = spark.sparkContext.broadcast(Trie(known.toArrow()["w"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("__t").to_pylist()]
            got = np.zeros((2, len(texts)), np.int64)
            lo = held = 0
            for hi, t in enumerate(texts, 1):
                held += len(t)
                if held >= CHARS or hi == len(texts):
                    got[:, lo:hi] = covered(texts[lo:hi], shared.value)
                    lo, held = hi, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), batch.column("__chars"), pa.array(got[0]), batch.column("__blanks"), pa.array(got[1])], names=[*key, "chars", "covered", "blanks", "words"])

    ship_package(spark)
    types = dict(rows.dtypes)
    low = F.coalesce(F.lower(text), F.lit(""))
    source = rows.select(*key, low.alias("__t"), F.char_length(low).cast("long").alias("__chars"), F.regexp_count(low, F.lit("[ \\t]")).cast("long").alias("__blanks"))
    return source.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in key), "chars long, covered long, blanks long, words long"]))
