"""Word trigrams with the counts of their parts, dealt by one of their words and counted inside tasks.

Every place of a text gives the word there and the two before it, missing ones at its start. A task
counts the distinct places of a batch and packs them by bucket: the words once, the places as numbers.
All places that share the word they are dealt by meet in a task, so that counts of trigrams, of
their last two words and of single words come from one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import ship_package
from .windows import _by_bucket, _places, _runs, _starts

#: Words that are counted at a time, and buckets they are dealt to.
HELD, BUCKETS = 1 << 21, 256
_PACKED = "bucket int, places int, letters int, words binary, numbers binary"

#: Trigrams of a bucket: their words, which are places of a vocabulary (-1: none), and figures beside them.
Places = tuple[pa.Array, list[np.ndarray], list[np.ndarray]]


def _sorted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, the first one first, and where groups of equal keys begin in it."""
    if len(keys) == 3 and max((int(k.max(initial=0)) for k in keys)) < (1 << 21) - 1:
        one = (keys[0].astype(np.int64) + 1) << 42 | (keys[1].astype(np.int64) + 1) << 21 | (keys[2].astype(np.int64) + 1)
        order = np.argsort(one)
        return order, _starts(one[order])
    order = np.lexsort(keys[::-1])
    return order, _starts(*(k[order] for k in keys))


def _total(start: np.ndarray, figure: np.ndarray) -> np.ndarray:
    """The sum of figure in each row's group."""
    first = np.flatnonzero(start)
    return np.repeat(np.add.reduceat(figure, first), np.diff(np.append(first, len(start)))) if len(first) else figure


def _counted(vocabulary: pa.Array, codes: list[np.ndarray], figures: list[np.ndarray]) -> Places:
    """Distinct places in order of their third, second and first word; the first figure is their count and is added up."""
    order, start = _sorted(codes[2], codes[1], codes[0])
    first = np.flatnonzero(start)
    cnt = np.add.reduceat(figures[0][order], first) if len(first) else figures[0]
    return vocabulary, [c[order][first] for c in codes], [cnt, *(f[order][first] for f in figures[1:])]


def _packed(places: Places, by: int) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket each: the places dealt by their word number by, or by the last where that is missing."""
    vocabulary, codes, figures = places
    if not len(codes[0]):
        return
    names = (pd.util.hash_array(np.array(vocabulary.to_pylist(), object), categorize=False) % np.uint64(BUCKETS)).astype(np.int32)
    bucket = names[np.where(codes[by] < 0, codes[2], codes[by])]
    order = np.argsort(bucket.astype(np.int16), kind="stable")
    bucket = bucket[order]
    codes, figures = [c[order] for c in codes], [f[order] for f in figures]
    first, last = _runs(bucket)
    used = np.full(len(vocabulary) + 1, -1, np.int32)
    rows: list[tuple] = []
    for a, z in zip(first, last, strict=True):
        here = [c[a:z] for c in codes]
        some = np.unique(np.concatenate(here))
        some = some[some >= 0]
        used[some] = np.arange(len(some))
        letters = "\n".join(vocabulary.take(pa.array(some)).to_pylist()).encode("utf-8", "surrogatepass")
        numbers = b"".join([*(used[c].astype(np.int32).tobytes() for c in here), *(f[a:z].tobytes() for f in figures)])
        rows.append((int(bucket[a]), z - a, len(letters), pa.compress(letters, "zstd", asbytes=True), pa.compress(numbers, "zstd", asbytes=True)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "places", "letters", "words", "numbers"])


def _unpacked(rows: pa.RecordBatch, kinds: list) -> Places:
    """The places of a bucket, from all its rows."""
    lists, codes, figures, first = [], [[], [], []], [[] for _ in kinds], 0
    for many, letters, said, numbers in zip(*(rows.column(c).to_pylist() for c in ("places", "letters", "words", "numbers")), strict=True):
        own = pa.decompress(said, letters, "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")
        lists.append(pa.array(own, pa.string()))
        data = pa.decompress(numbers, many * (12 + sum(np.dtype(k).itemsize for k in kinds)), "zstd", asbytes=True)
        for k in range(3):
            c = np.frombuffer(data, np.int32, many, 4 * many * k)
            codes[k].append(np.where(c < 0, -1, c + first))
        at = 12 * many
        for f, k in zip(figures, kinds, strict=True):
            f.append(np.frombuffer(data, k, many, at))
            at += many * np.dtype(k).itemsize
        first += len(own)
    coded = pa.concat_arrays(lists).dictionary_encode()
    same = np.append(coded.indices.to_numpy(), -1).astype(np.int32)
    return coded.dictionary, [same[np.concatenate(c)] for c in codes], [np.concatenate(f) for f in figures]


def _dealt(docs: DataFrame, by: int) -> DataFrame:
    """The counted places of texts, in buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                held.append(batch.slice(at, 64).column(0))
                many += len(held[-1].flatten())
                if many >= HELD:
                    yield from _packed(_cut(held), by)
                    held, many = [], 0
        if held:
            yield from _packed(_cut(held), by)

    ship_package(docs.sparkSession)
    return docs.select(words(F.lower("text")).alias("ws")).filter(F.size("ws") > 0).mapInArrow(run, _PACKED)


def _cut(held: list[pa.Array]) -> Places:
    lists = pa.concat_arrays(held)
    coded = lists.flatten().dictionary_encode()
    last = coded.indices.to_numpy().astype(np.int32)
    pos = _places(np.diff(lists.offsets.to_numpy()))[1]
    before = [np.where(pos >= k, np.roll(last, k), -1).astype(np.int32) for k in (2, 1)]
    return _counted(coded.dictionary, [*before, last], [np.ones(len(last), np.int64)])


def _met(packed: DataFrame, kinds: list, run: Callable[[Places], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            yield from run(_unpacked(rows, kinds))

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, schema)


def _grams(places: Places, some: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(places[0].take(pa.array(c[some])) for c in places[1]), " ")


def _slices(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) if isinstance(c, np.ndarray) else c.slice(at, 1 << 16) for c in columns], names=names)


def _conditioned(places: Places) -> tuple[Places, np.ndarray, np.ndarray]:
    """Distinct places dealt by their middle word, with the shares of the third word after the two and the one before it (p3, p2)."""
    vocabulary, codes, (cnt,) = _counted(*places)
    one, two, three = codes
    order, head = _sorted(two, one, three)
    p3 = np.zeros(len(cnt))
    p3[order] = cnt[order] / _total(_starts(two[order], one[order]), cnt[order])
    order, _ = _sorted(two, three, one)
    p2 = np.zeros(len(cnt))
    p2[order] = _total(_starts(two[order], three[order]), cnt[order]) / _total(_starts(two[order]), cnt[order])
    return (vocabulary, codes, [cnt]), p3, p2


def conditional(docs: DataFrame) -> DataFrame:
    """gram, freq and p of every distinct trigram: its count over that of its first two words."""

    def run(places: Places) -> Iterator[pa.RecordBatch]:
        places, p3, _ = _conditioned(places)
        some = np.flatnonzero(places[1][0] >= 0)
        yield from _slices([_grams(places, some), places[2][0][some], p3[some]], ["gram", "freq", "p"])

    return _met(_dealt(docs, 1), [np.int64], run, "gram string, freq long, p double")


def ladder(docs: DataFrame) -> DataFrame:
    """Every distinct trigram with its count and its probabilities of order 3, 2 and 1: gram, freq, p3, p2, p1.

    Places meet by their middle word, which both longer orders hold, and then by their last.
    """
    all_words = docs.select(F.sum(F.size(words("text"))).alias("n")).first()["n"] or 1

    def shares(places: Places) -> Iterator[pa.RecordBatch]:
        (vocabulary, codes, (cnt,)), p3, p2 = _conditioned(places)
        yield from _packed((vocabulary, codes, [cnt, p3, p2]), 2)

    def run(places: Places) -> Iterator[pa.RecordBatch]:
        cnt, p3, p2 = places[2]
        last = places[1][2]
        own = np.bincount(last, cnt).astype(np.int64)[last]
        some = np.flatnonzero(places[1][0] >= 0)
        yield from _slices([_grams(places, some), cnt[some], p3[some], p2[some], own[some] / all_words], ["gram", "freq", "p3", "p2", "p1"])

    first = _met(_dealt(docs, 1), [np.int64], shares, _PACKED)
    return _met(first, [np.int64, np.float64, np.float64], run, "gram string, freq long, p3 double, p2 double, p1 double")


def estimates(docs: DataFrame, least: tuple[int, int, int] = (1, 1, 1), discount: float = 0.5) -> DataFrame:
    """gram, estimate of every distinct trigram: its count, or that of its last two words or of its last word, with the discount for every word dropped.

    A count serves if it is no less than least, of trigrams, pairs and words; 0 where none does.
    """

    def run(places: Places) -> Iterator[pa.RecordBatch]:
        places = _counted(*places)
        (one, two, three), (cnt,) = places[1], places[2]
        pairs, single = _total(_starts(three, two), cnt), _total(_starts(three), cnt)
        estimate = np.where(cnt >= least[0], cnt, np.where(pairs >= least[1], discount * pairs, np.where(single >= least[2], discount * discount * single, 0.0)))
        some = np.flatnonzero(one >= 0)
        yield from _slices([_grams(places, some), estimate[some]], ["gram", "estimate"])

    return _met(_dealt(docs, 2), [np.int64], run, "gram string, estimate double")
