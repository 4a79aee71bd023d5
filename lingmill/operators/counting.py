"""N-grams of characters or bytes, counted inside tasks by sorted whole numbers before they are shuffled.

An n-gram is a whole number of equally many bits a character. A task holds the sorted numbers
of the longest n-grams with their counts; shorter ones are their leading bits, so they are runs of the
sorted table. Tables leave a task when they are large and at its end; Spark adds them up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Characters that are turned into numbers at once; numbers held before they are counted; distinct ones before they leave a task; rows of a batch that leaves.
CHUNK, HELD, KEPT, OUT = 1 << 20, 1 << 22, 1 << 22, 1 << 18
BLANK, ZERO, NINE, NEWLINE = 32, 48, 57, 10
#: Of n-grams that are sent packed: characters of a whole number, bits of each, groups by their beginnings, and groups of a batch.
WORD, POINT, BUCKETS, SENT = 3, 21, 256, 64


def counted(rows: DataFrame, by: tuple[str, ...], column: str, lengths: tuple[int, ...], align: dict[str, int] | None = None, made: Callable | None = None) -> DataFrame:
    """by, n, gram, cnt of the n-grams in a column of rows: characters of a text, or bytes of a binary as Latin-1 text.

    Of texts no n-gram is counted where two blanks or two digits stand at its place; of bytes none that
    opens so or holds a newline. align: bytes of a unit by the value of the last column of by.
    made: turns batches of rows into batches of by, all strings, and a binary, inside the task.
    """
    ship_package(rows.sparkSession)
    if made:
        count = _counting(by, lengths, True, align or {}, False)
        sent = rows.mapInArrow(lambda batches: count(made(batches)), ", ".join([*(f"`{c}` string" for c in by), "n int, gram string, cnt long"]))
        return sent.groupBy(*by, "n", "gram").agg(F.sum("cnt").alias("cnt"))
    binary = dict(rows.dtypes)[column] == "binary"
    run = _counting(by, lengths, binary, align or {}, False)
    return rows.select(*by, column).mapInArrow(run, f"{_schema(rows, by)}, n int, gram string, cnt long").groupBy(*by, "n", "gram").agg(F.sum("cnt").alias("cnt"))


def frequent(rows: DataFrame, by: tuple[str, ...], column: str, lengths: tuple[int, ...], most: int, floor: int = 2) -> DataFrame:
    """Of counted() all rows that can be among the `most` most frequent of their by and n, ties with the last one too, and of at least floor; and by by and n a row of a null gram with the sum of all counts.

    Tasks send the longest n-grams alone, as packed numbers dealt by their first characters. So all
    n-grams of the same beginning meet in one group of many, where shorter ones are counted from
    them, and rows are made only of what is left.
    """
    longest = max(lengths)

    def merged(group: pa.Table) -> pa.Table:
        cnt = np.concatenate([np.frombuffer(c, np.int64) for c in group["cnt"].to_pylist()])
        words = np.concatenate([np.frombuffer(g, np.int64).reshape(-(-longest // WORD), -1) for g in group["grams"].to_pylist()], axis=1)
        order = np.lexsort(words[::-1])
        words, cnt = words[:, order], cnt[order]
        letters = np.stack([words[k // WORD] >> POINT * (WORD - 1 - k % WORD) & (1 << POINT) - 1 for k in range(longest)], axis=1)
        differs = np.append(np.ones((1, longest), bool), letters[1:] != letters[:-1], axis=0)
        out = []
        for n in lengths:
            first = np.flatnonzero(differs[:, :n].any(axis=1))
            head, times = letters[first, :n], np.add.reduceat(cnt, first)
            whole = head[:, -1] > 0
            head, times = head[whole], times[whole]
            if not len(times):
                continue
            often = times[times >= floor]
            kept = times >= (max(floor, int(np.partition(often, -most)[-most])) if len(often) > most else floor)
            for gram, many in ((_strings(head[kept] - 1), times[kept]), (pa.nulls(1, pa.string()), times.sum(keepdims=True))):
                out.append(pa.table([*(pa.repeat(group[c][0], len(many)) for c in by), pa.repeat(pa.scalar(n, pa.int32()), len(many)), gram, pa.array(many)], names=[*by, "n", "gram", "cnt"]))
        return pa.concat_tables(out)

    ship_package(rows.sparkSession)
    run, schema = _counting(by, lengths, False, {}, True), _schema(rows, by)
    sent = rows.select(*by, column).mapInArrow(run, f"{schema}, bucket int, grams binary, cnt binary")
    return sent.groupBy(*by, "bucket").applyInArrow(merged, f"{schema}, n int, gram string, cnt long")


def _schema(rows: DataFrame, by: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)


def _counting(by: tuple[str, ...], lengths: tuple[int, ...], binary: bool, align: dict[str, int], longest_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task: batches of by and a text or binary become batches of counts."""
    batches_of = partial(_dealt, shortest=min(lengths)) if longest_only else _batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(lengths, binary, align, longest_only)
        for batch in batches:
            keys = batch.columns[:-1]
            codes = [pc.dictionary_encode(k, null_encoding="encode") for k in keys]
            flat = np.zeros(batch.num_rows, np.int64)
            for c in codes:
                flat = flat * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
            texts = batch.columns[-1].to_pylist()
            order = np.argsort(flat, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
                if len(part):
                    key = tuple(k[int(part[0])] for k in keys)
                    for done in table.add(key, [texts[i] for i in part.tolist() if texts[i]]):
                        yield from batches_of(done, by)
        yield from batches_of(table.taken(), by)

    return run


def _dealt(found: Iterator[tuple], by: tuple[str, ...], shortest: int) -> Iterator[pa.RecordBatch]:
    """A row per bucket of the first characters: its n-grams, a table of whole numbers of WORD characters each, and their counts."""
    for key, letters, cnt in found:
        words = np.zeros((-(-letters.shape[1] // WORD), len(letters)), np.int64)
        for k in range(letters.shape[1]):
            words[k // WORD] |= letters[:, k] << POINT * (WORD - 1 - k % WORD)
        mixed = np.zeros(len(letters), np.uint64)
        for k in range(shortest):
            mixed = (mixed + letters[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (mixed >> np.uint64(32)).astype(np.int64) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        bucket, words, cnt = bucket[order], words[:, order], cnt[order]
        parts = np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1)
        for at in range(0, len(parts), SENT):
            some = [p for p in parts[at : at + SENT] if len(p)]
            spans = [slice(int(p[0]), int(p[-1]) + 1) for p in some]
            yield pa.RecordBatch.from_arrays(
                [*(pa.repeat(k, len(some)) for k in key), pa.array([int(bucket[s.start]) for s in spans], pa.int32()), pa.array([np.ascontiguousarray(words[:, s]).tobytes() for s in spans], pa.binary()), pa.array([cnt[s].tobytes() for s in spans], pa.binary())],
                names=[*by, "bucket", "grams", "cnt"],
            )


def _batches(found: Iterator[tuple], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for key, n, gram, cnt in found:
        for at in range(0, len(gram), OUT):
            g = gram.slice(at, OUT)
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(g)) for k in key), pa.repeat(pa.scalar(n, pa.int32()), len(g)), g, pa.array(cnt[at : at + OUT])], names=[*by, "n", "gram", "cnt"])


class _Table:
    """Counts by key. Codes of characters are dealt as they come; 0 is the end of a text."""

    def __init__(self, lengths: tuple[int, ...], binary: bool, align: dict[str, int], longest_only: bool = False) -> None:
        self.lengths, self.longest, self.binary, self.align, self.longest_only = lengths, max(lengths), binary, align, longest_only
        self.bits = min(21, 63 // self.longest)
        self.code = np.arange(1, 257, dtype=np.int64) if binary else np.zeros(0x110000, np.int64)
        self.points = np.append(0, np.arange(256)) if binary else np.zeros(1, np.int64)
        self.raw: dict[tuple, list[np.ndarray]] = {}
        self.sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def add(self, key: tuple, texts: list) -> Iterator[Iterator[tuple]]:
        """Takes texts of a key; gives what has to leave."""
        part, size = [], 0
        for text in texts:
            for at in range(0, len(text), CHUNK):
                piece = text[at : at + CHUNK + self.longest - 1] if len(text) > CHUNK else text
                part.append((piece, min(len(text) - at, CHUNK)))
                size += len(piece)
                if size >= CHUNK:
                    yield from self._chunk(key, part)
                    part, size = [], 0
        if part:
            yield from self._chunk(key, part)

    def _chunk(self, key: tuple, part: list[tuple]) -> Iterator[Iterator[tuple]]:
        size = np.array([len(p) for p, _ in part], np.int64)
        starts = np.array([s for _, s in part], np.int64)
        gap = self.longest - 1  # zeros behind every text, so that no n-gram runs into the next
        first = np.cumsum(size + gap) - size - gap
        if self.binary:
            points = np.frombuffer(b"".join(x for p, _ in part for x in (p, bytes(gap))), np.uint8)
            codes = self.code[points]
        else:
            points = np.frombuffer("".join(x for p, _ in part for x in (p, "\0" * gap)).encode("utf-32-le", "surrogatepass"), "<u4")
            codes = self.code[points]
            new = np.unique(points[codes == 0])
            if len(new) and len(self.points) + len(new) > 1 << self.bits:
                yield self.taken()
                self.code[:], self.points, new = 0, np.zeros(1, np.int64), np.unique(points)
                if 1 + len(new) > 1 << self.bits:  # too many characters for a whole number
                    yield self._plain(key, part)
                    return
            if len(new):
                self.code[new] = np.arange(len(self.points), len(self.points) + len(new))
                self.points = np.append(self.points, new)
                codes = self.code[points]
        codes[((first + size)[:, None] + np.arange(gap)).ravel()] = 0
        many = max(len(points) - gap, 0)
        good = (codes[:many] != 0) & (codes[min(self.lengths) - 1 :][:many] != 0)
        for k in np.flatnonzero(starts < size).tolist():
            good[first[k] + starts[k] : first[k] + size[k]] = False
        unit = self.align.get(key[-1].as_py(), 1)
        if unit > 1:
            good &= ((np.arange(len(points)) - np.repeat(first, size + gap)) % unit == 0)[:many]
        if not self.binary and self.longest > 1:
            blank, digit = points == BLANK, (points >= ZERO) & (points <= NINE)
            good &= ~(blank[:many] & blank[1:][:many] | digit[:many] & digit[1:][:many])
        keys = codes[:many].copy()
        for k in range(1, self.longest):
            keys <<= self.bits
            keys |= codes[k:][:many]
        keys = keys[good]
        self.raw.setdefault(key, []).append(keys)
        self.held += len(keys)
        if self.held >= HELD:
            self._settle()
            if sum(len(k) for k, _ in self.sums.values()) >= KEPT:
                yield self.taken()

    def _settle(self) -> None:
        for key, raw in self.raw.items():
            new, cnt = np.unique(np.concatenate(raw), return_counts=True)
            if key in self.sums:
                old, had = self.sums[key]
                both, cnt = np.concatenate([old, new]), np.concatenate([had, cnt])
                order = np.argsort(both, kind="stable")
                both, cnt = both[order], cnt[order]
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                new, cnt = both[first], np.add.reduceat(cnt, first)
            if len(new):
                self.sums[key] = new, cnt
        self.raw, self.held = {}, 0

    def taken(self) -> Iterator[tuple]:
        """key, n, grams, counts of everything so far, which is forgotten; the codes it was made with are kept.

        If longest_only: key, letters, counts, with a row of letters for each of the longest n-grams: code points plus one, 0 behind the end of a text.
        """
        self._settle()
        sums, self.sums = self.sums, {}
        points = self.points
        for key, (keys, cnt) in sums.items():
            if self.longest_only:
                codes = np.stack([keys >> self.bits * (self.longest - 1 - k) & (1 << self.bits) - 1 for k in range(self.longest)], axis=1)
                yield key, np.where(codes > 0, points[codes] + 1, 0), cnt.astype(np.int64)
                continue
            for n in self.lengths:
                head = keys >> self.bits * (self.longest - n)
                first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
                head, many = head[first], np.add.reduceat(cnt, first)
                letters = points[np.stack([head >> self.bits * (n - 1 - k) & (1 << self.bits) - 1 for k in range(n)], axis=1)]
                good = head & (1 << self.bits) - 1 != 0
                if self.binary:
                    good &= ~(letters == NEWLINE).any(axis=1)
                    if n > 1:
                        digits = (letters[:, :2] >= ZERO) & (letters[:, :2] <= NINE)
                        good &= ~((letters[:, :2] == BLANK).all(axis=1) | digits.all(axis=1))
                if good.any():
                    yield key, n, _strings(letters[good]), many[good].astype(np.int64)

    def _plain(self, key: tuple, part: list[tuple]) -> Iterator[tuple]:
        """A chunk counted as strings."""
        digit = lambda c: "0" <= c <= "9"
        longs: Counter = Counter()
        for piece, starts in part:
            longs.update(g for i in range(starts) if len(g := piece[i : i + self.longest]) >= min(self.lengths) and not (g[:2] == "  " or len(g) > 1 and digit(g[0]) and digit(g[1])))
        if self.longest_only:
            if longs:
                letters = np.zeros((len(longs), self.longest), np.int64)
                size = np.array([len(g) for g in longs])
                letters[np.arange(self.longest) < size[:, None]] = np.frombuffer("".join(longs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
                yield key, letters, np.array(list(longs.values()), np.int64)
            return
        for n in self.lengths:
            heads: Counter = Counter()
            for g, c in longs.items():
                if len(g) >= n:
                    heads[g[:n]] += c
            if heads:
                yield key, n, pa.array(list(heads), pa.string()), np.array(list(heads.values()), np.int64)


def _strings(letters: np.ndarray) -> pa.Array:
    """An Arrow array of strings from rows of code points."""
    data = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    size = (1 + (letters > 0x7F).astype(np.int64) + (letters > 0x7FF) + (letters > 0xFFFF)).sum(axis=1)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(offsets), pa.py_buffer(data))
