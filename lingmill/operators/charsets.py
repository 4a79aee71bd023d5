"""Charsets by byte n-gram models: texts in other charsets, training, scores of windows, ranking.

A model belongs to a language in a charset. Bytes are handled as Latin-1 text, a character a byte, so
counting stays with the functions of Spark. In charsets of several bytes a unit n-grams start at whole
units only, in training as in matching: that tells the two orders of 16-bit text apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..stages import keep, scope, stage
from .counting import counted
from .ngrams import CELLS, LINES, TRIE_ROWS, WEIGHT_POWER, top_k
from .sizes import small
from .strings import STRING, rank_charsets, sniffed_strings
from .trie import Trie

#: Bytes of a unit, where it is not one.
ALIGN = {"utf-16-le": 2, "utf-16-be": 2, "utf-32-le": 4, "utf-32-be": 4}
#: What Spark encodes by itself, whatever the characters.
UNICODE = {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}
#: Bytes of an n-gram; of a window and between two.
BYTES, WINDOW, APART = (3, 4, 6), 384, 320
#: A candidate has this share of the best score and this score at least.
SHARE, LEAST = 0.5, 0.05
#: How far a charset is trusted; code pages lose ties to Unicode forms, as in windows of ASCII alone.
RELIABILITY = {"utf-8": 1.0, "utf-16-le": 1.0, "utf-16-be": 1.0}
CODE_PAGE = 0.999


def encoded(text: Column, charset: str) -> Column:
    """Bytes of a text in a Unicode form or a code page of one byte a character, which has ? for what it lacks."""
    _checked(charset)
    if charset in UNICODE:
        return F.encode(text, UNICODE[charset])
    return F.arrow_udf(lambda texts: pa.array([None if t is None else t.encode(charset, "replace") for t in texts.to_pylist()], pa.binary()), "binary")(text)


def _checked(charset: str) -> None:
    if charset not in UNICODE and [bytes([b]).decode(charset, "ignore") for b in range(128)] != [chr(b) for b in range(128)]:
        raise ValueError(f"{charset} does not extend ASCII byte for byte")


def _align(charset: Column) -> Column:
    out = F.lit(1)
    for name, units in ALIGN.items():
        out = F.when(charset == name, units).otherwise(out)
    return out


def in_charsets(docs: DataFrame, charsets: tuple[str, ...], *keep: str, text: str = "text") -> DataFrame:
    """keep, charset, content: every text in each of the charsets; a null text has none."""
    each = F.array(*(F.struct(F.lit(c).alias("charset"), encoded(F.col(text), c).alias("content")) for c in charsets))
    return docs.filter(F.col(text).isNotNull()).select(*keep, F.explode(each).alias("__e")).select(*keep, "__e.charset", "__e.content")


#: Bytes of texts that are encoded at a time, one text at least.
ENCODED = 1 << 22


def _in_charsets(batches: Iterator[pa.RecordBatch], charsets: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """in_charsets() inside a task: batches of what is kept and a text become what is kept, charset, content."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.columns[-1]))
        if not batch.num_rows:
            continue
        group = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy().astype(np.int64)) // ENCODED
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
            part = batch.slice(a, z - a)
            contents = pa.array([t.encode(c, "replace") for t in part.columns[-1].to_pylist() for c in charsets], pa.binary())
            of = pa.array(np.repeat(np.arange(z - a), len(charsets)))
            names = pa.array([*charsets] * (z - a), pa.string())
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in part.columns[:-1]), names, contents], names=[*batch.schema.names[:-1], "charset", "content"])


def counts(contents: DataFrame, lengths: tuple[int, ...] = BYTES) -> DataFrame:
    """lang, charset, n, gram, cnt of contents (lang, charset, content); gram is Latin-1 text, a null lang is ''.

    No n-gram holds a newline byte or opens with two blanks or two digits.
    """
    rows = contents.select(F.coalesce("lang", F.lit("")).alias("lang"), "charset", "content")
    return counted(rows, ("lang", "charset"), "content", lengths, ALIGN)


def train(contents: DataFrame, lengths: tuple[int, ...] = BYTES, k: int = 3500, power: float = WEIGHT_POWER) -> DataFrame:
    """lang, charset, n, gram, cnt, weight of contents (lang, charset, content)."""
    return _trained(counts(contents, lengths), k, power)


def train_texts(docs: DataFrame, charsets: tuple[str, ...], lengths: tuple[int, ...] = BYTES, k: int = 3500, power: float = WEIGHT_POWER, text: str = "text") -> DataFrame:
    """train() of texts (lang, text) in each of the charsets; tasks encode what they count, no content leaves them."""
    for c in charsets:
        _checked(c)
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), text)
    return _trained(counted(rows, ("lang", "charset"), "content", lengths, ALIGN, partial(_in_charsets, charsets=charsets)), k, power)


def _trained(counts: DataFrame, k: int, power: float) -> DataFrame:
    by = ["lang", "charset", "n"]
    with scope():
        each = stage(counts, "counts")
        total = each.groupBy(*by).agg(F.sum("cnt").alias("total"))
        kept = top_k(each, k, tuple(by))
        return keep(kept.join(total, by).select(*by, "gram", "cnt", F.pow(F.col("cnt") / F.col("total"), F.lit(power)).alias("weight")), "model")


def windows(contents: DataFrame, *keep: str) -> DataFrame:
    """keep, window_start, window: overlapping windows of contents; the last is the first that reaches the end, an empty content has none."""
    starts = F.expr(f"sequence(0, cast(greatest(ceil((octet_length(content) - {WINDOW}) / {APART}), 0) as int) * {APART}, {APART})")
    cut = F.transform(starts, lambda s: F.struct(s.alias("window_start"), F.substring(F.col("content"), s + 1, F.lit(WINDOW)).alias("window")))
    return contents.filter(F.octet_length("content") > 0).select(*keep, F.explode(cut).alias("__w")).select(*keep, "__w.*")


#: Places whose worth is added up at a time.
ROWS = 1 << 12


class ByteModels:
    """Models in a trie; table() scores many blocks of bytes in one walk."""

    def __init__(self, rows: pa.Table) -> None:
        grams, lang, charset = (rows[c].to_pylist() for c in ("gram", "lang", "charset"))
        self.trie = Trie(grams)
        names = sorted(set(zip(charset, lang, strict=True)))
        place = {n: k for k, n in enumerate(names)}
        at = {s: k for k, s in enumerate(self.trie.strings)}
        gram = np.array([at[g] for g in grams], np.int64)
        order = np.argsort(gram, kind="stable")
        self.first = np.searchsorted(gram[order], np.arange(len(self.trie.strings) + 1))
        self.of = np.array([place[n] for n in zip(charset, lang, strict=True)], np.int64)[order]
        self.worth = (np.asarray(rows["weight"], float) * np.array([len(g) for g in grams], float))[order]
        self.align = np.array([ALIGN.get(c, 1) for c, _ in names], np.int64)
        self.names = len(names)
        self.charsets, self.begin = np.unique(np.array([c for c, _ in names], object).astype(str), return_index=True) if names else (np.zeros(0, str), np.zeros(0, np.int64))
        self.byte = self.trie.codes(np.arange(256))
        # Of the names of each unit: which they are, what every node of the trie is worth to them with all on the way to it,
        # and which nodes are worth anything. None where the model is too large for a table of all cells.
        many = len(self.trie.strings)
        self.nodes = None
        if 0 < len(self.trie.base) * self.names <= CELLS:
            string = np.repeat(np.arange(many), np.diff(self.first))
            cells = np.zeros((self.names, many))
            np.add.at(cells, (self.of, string), self.worth)
            along = self.trie.along(cells)
            self.nodes = []
            for unit in np.unique(self.align).tolist():
                own = np.flatnonzero(self.align == unit)
                self.nodes.append((unit, own, np.ascontiguousarray(along[own].T), along[own].any(axis=0)))

    def table(self, blocks: list[bytes]) -> np.ndarray:
        """blocks x charsets: the best language's sum of weight times length over matches at whole units, per byte."""
        if not blocks or not self.names:
            return np.zeros((len(blocks), len(self.charsets)))
        # Texts of ASCII alone are the same bytes in many charsets.
        places: dict[bytes, int] = {}
        of = [places.setdefault(b, len(places)) for b in blocks]
        return self._table(list(places))[of]

    def _table(self, blocks: list[bytes]) -> np.ndarray:
        size = np.array([len(b) for b in blocks], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        # A zero code between two blocks; byte 0 has a code of its own.
        codes = np.append(self.byte[np.frombuffer(b"\0".join(blocks), np.uint8)], np.int32(0))
        codes[begin + size] = 0
        if self.nodes is not None:
            sums = np.zeros((len(blocks), self.names))
            node = self.trie.deepest(codes)
            row = np.repeat(np.arange(len(blocks)), size + 1)
            for unit, own, worth, some in self.nodes:
                at = np.flatnonzero(some.take(node))
                if unit > 1:
                    at = at[(at - begin.take(row.take(at))) % unit == 0]
                out = np.zeros((len(blocks), len(own)))
                for a in range(0, len(at), ROWS):
                    here = at[a : a + ROWS]
                    of = row.take(here)
                    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    out[of[first]] += np.add.reduceat(worth.take(node.take(here), axis=0), first, axis=0)
                sums[:, own] = out
            return np.maximum.reduceat(sums, self.begin, axis=1) / np.maximum(size, 1)[:, None]
        start, string = self.trie.matches(codes)
        row = np.searchsorted(begin, start, "right") - 1
        many = self.first[string + 1] - self.first[string]
        post = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - self.first[string], many)
        name = self.of[post]
        whole = np.repeat(start - begin[row], many) % self.align[name] == 0
        cell = (np.repeat(row, many) * self.names + name)[whole]
        sums = np.bincount(cell, self.worth[post[whole]], len(blocks) * self.names).reshape(len(blocks), self.names)
        return np.maximum.reduceat(sums, self.begin, axis=1) / np.maximum(size, 1)[:, None]

    def candidates(self, block: bytes) -> list[str]:
        """Charsets of a block, the likeliest first, as ranked() gives them."""
        got = [(round(float(s) * RELIABILITY.get(str(c), CODE_PAGE), 9), str(c)) for s, c in zip(self.table([block])[0], self.charsets, strict=True)]
        best = max((s for s, _ in got), default=0.0)
        return [c for s, c in sorted(got, key=lambda x: (-x[0], x[1])) if s >= SHARE * best and s >= LEAST]

    def order(self, block: bytes, before: list[str]) -> list[str]:
        """Charsets to try on a block: UTF-8, ASCII, then by likelihood; what the sniffs find comes after the ranked ones."""
        found = self.candidates(block)
        found += [c for c in rank_charsets(block) if c not in found]
        return sorted(found, key=lambda c: {"utf-8": 0, "ascii": 1}.get(c, 2))


SCORED = "array<struct<charset:string,score:double>>"


def scores(blocks: DataFrame, model: DataFrame, key: tuple[str, ...], content: str = "window") -> DataFrame:
    """key, found: the charsets of each block with their scores, as ByteModels.table(); those of score 0 are left out.

    Models of up to TRIE_ROWS rows are matched inside tasks, a row a block; larger ones are joined.
    """
    known = stage(model.select("lang", "charset", "gram", "weight"), "bytes")
    if known.count() > TRIE_ROWS:
        return scores_joined(blocks, known, key, content)
    shared = blocks.sparkSession.sparkContext.broadcast(ByteModels(known.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = _at_a_time(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                part = batch.slice(at, many)
                found = _found(shared.value, [b or b"" for b in part.column("__c").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), found], names=[*key, "found"])

    ship_package(blocks.sparkSession)
    types = dict(blocks.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in key), f"found {SCORED}"])
    return blocks.select(*key, F.col(content).alias("__c")).mapInArrow(run, schema)


def scores_of_texts(docs: DataFrame, charsets: tuple[str, ...], model: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep, truth, window_start, found: scores() of the windows() of the texts in each of the charsets, truth.

    Tasks encode the texts and cut the windows that they score, so each text goes to a task's Python once.
    """
    known = stage(model.select("lang", "charset", "gram", "weight"), "bytes")
    if known.count() > TRIE_ROWS:
        return scores_joined(windows(in_charsets(docs, charsets, *keep, text=text).withColumnRenamed("charset", "truth"), *keep, "truth"), known, (*keep, "truth", "window_start"))
    for c in charsets:
        _checked(c)
    shared = docs.sparkSession.sparkContext.broadcast(ByteModels(known.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = _at_a_time(shared.value)
        for batch in _in_charsets(batches, charsets):
            contents = batch.columns[-1].to_pylist()
            size = np.array([len(c) for c in contents], np.int64)
            count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // APART), 0) + 1, 0)
            of = np.repeat(np.arange(len(size)), count)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * APART
            for at in range(0, len(of), many):
                own, begin = of[at : at + many], start[at : at + many]
                found = _found(shared.value, [contents[k][a : a + WINDOW] for k, a in zip(own.tolist(), begin.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[:-1]), pa.array(begin, pa.int32()), found], names=[*keep, "truth", "window_start", "found"])

    ship_package(docs.sparkSession)
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"truth string, window_start int, found {SCORED}"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def _at_a_time(models: ByteModels) -> int:
    return max(1, min(LINES, CELLS // max(models.names, 1)))


def _found(models: ByteModels, blocks: list[bytes]) -> pa.ListArray:
    """Charsets and scores of each block, those of 0 left out."""
    got = models.table(blocks)
    row, col = np.nonzero(got)
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(blocks))))
    kind = [pa.field("charset", pa.string()), pa.field("score", pa.float64())]
    pairs = pa.StructArray.from_arrays([pa.array(models.charsets.tolist(), pa.string()).take(pa.array(col)), pa.array(got[row, col])], fields=kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def scores_joined(blocks: DataFrame, model: DataFrame, key: tuple[str, ...], content: str = "window") -> DataFrame:
    """scores() by a join of n-grams, for models of any size; a block without a match has a row too."""
    known = small(model.select("lang", "charset", "gram", "weight", F.char_length("gram").alias("__n"), _align(F.col("charset")).alias("__a")))
    lengths = [r["__n"] for r in known.select("__n").distinct().collect()]
    text = blocks.select(*key, F.decode(F.coalesce(F.col(content), F.lit(b"")), "ISO-8859-1").alias("__t"))
    each = text.filter("__t <> ''").select(*key, F.char_length("__t").alias("__size"), "__t", F.explode(F.expr("sequence(0, char_length(__t) - 1)")).alias("__i"))
    grams = each.select(*key, "__size", "__i", F.explode(F.array(*(F.substr("__t", F.col("__i") + 1, F.lit(n)) for n in lengths)) if lengths else F.array().cast("array<string>")).alias("gram"))
    # Near the end one n-gram is cut for several lengths.
    met = grams.distinct().join(known, "gram").filter("__i % __a = 0")
    of = met.groupBy(*key, "lang", "charset").agg((F.sum(F.col("weight") * F.col("__n")) / F.max("__size")).alias("score"))
    best = of.groupBy(*key, "charset").agg(F.max("score").alias("score")).groupBy(*key).agg(F.collect_list(F.struct("charset", "score")).alias("found"))
    best = best.select(*(F.col(c).alias(f"__{c}") for c in key), "found")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return blocks.select(*key).join(best, same, "left").select(*key, F.coalesce("found", F.array().cast(SCORED)).alias("found"))


def ranked(scored: DataFrame, reliability: dict[str, float] | None = None) -> DataFrame:
    """scored with `ranked`, its candidates as array<struct<charset, score>>, the likeliest first, ties by name.

    Scores are scaled by the charset's reliability; candidates have half the best and 0.05 at least.
    """
    trust = RELIABILITY if reliability is None else reliability
    factor = F.create_map(*(F.lit(x) for kv in trust.items() for x in kv)) if trust else None

    def scaled(f: Column) -> Column:
        by = F.lit(CODE_PAGE) if factor is None else F.coalesce(factor[f["charset"]], F.lit(CODE_PAGE))
        return F.struct((-F.round(f["score"] * by, 9)).alias("minus"), f["charset"].alias("charset"))

    own = F.sort_array(F.transform("found", scaled))
    out = scored.withColumn("__own", own).withColumn("__best", F.try_element_at(F.transform("__own", lambda f: -f["minus"]), F.lit(1)))
    kept = F.filter("__own", lambda f: (-f["minus"] >= SHARE * F.col("__best")) & (-f["minus"] >= LEAST))
    return out.withColumn("ranked", F.transform(kept, lambda f: F.struct(f["charset"].alias("charset"), (-f["minus"]).alias("score")))).drop("__own", "__best")


def extract_ranked(files: DataFrame, model: DataFrame, content: str = "content", key: str = "path", least: int = 4) -> DataFrame:
    """key, offset, length, encoding, text of the strings in binary contents, charsets ranked by the models block by block."""
    known = stage(model.select("lang", "charset", "gram", "weight"), "bytes")
    if known.count() > TRIE_ROWS:
        raise ValueError(f"models of over {TRIE_ROWS} rows do not go to the workers: train with a smaller k")
    shared = files.sparkSession.sparkContext.broadcast(ByteModels(known.toArrow()))
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int32()), ("encoding", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            rows = [sniffed_strings(b, least, order=models.order) if b else [] for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "found"])

    ship_package(files.sparkSession)
    source = files.select(key, F.col(content).alias("content"))
    typed = f"{key} {source.schema[0].dataType.simpleString()}, found array<{STRING}>"
    return source.mapInArrow(run, typed).select(key, F.explode("found").alias("f")).select(key, "f.*")
