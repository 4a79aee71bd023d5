"""Character n-gram models: counting, top-K, weights, training, labelling and evaluation.

Texts are handled line by line, as no n-gram spans a newline. Counts combine
before they are shuffled. A model is small against texts: it is counted and joined by
broadcast where it has few rows, by shuffle where not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..stages import keep as kept_table
from ..stages import scope, stage
from .counting import counted, frequent
from .sizes import small
from .trie import Trie

#: Thresholds of the labels: unknown at or below, unsure below; lowest score shown.
GUESS, UNSURE, ZERO = 0.2, 1.2, 0.01
WEIGHT_POWER = 0.27
LENGTHS = (3, 4, 5, 6)


def lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The lines of texts with their number; a null text has none."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def tidy(line: Column) -> Column:
    """Lower case, runs of blanks and tabs as one blank; a blank by itself is no match, so most lines have none."""
    return F.regexp_replace(F.lower(line), "[ \\t\\r]{2,}|[\\t\\r]", " ")


#: Characters of a line whose n-grams are cut from one piece of it.
PIECE = 256


def explode_grams(rows: DataFrame, lengths: tuple[int, ...], line: str = "line") -> DataFrame:
    """One row per n-gram occurrence: the other columns, n and gram.

    Lines are first cut into overlapping pieces, so that finding a character by its place
    never walks a long line.
    """
    other = [c for c in rows.columns if c != line]
    longest = max(lengths)
    starts = F.expr(f"sequence(0, greatest(char_length({line}) - 1, 0), {PIECE})")
    pieces = rows.select(*other, F.explode(F.transform(starts, lambda s: F.substr(F.col(line), s + 1, F.lit(PIECE + longest - 1)))).alias("__piece")).filter("__piece <> ''")

    placed = pieces.select(*other, "__piece", F.explode(F.expr(f"sequence(1, least(char_length(__piece), {PIECE}))")).alias("__i"))
    each = ", ".join(f"{n}, substring(__piece, __i, {n})" for n in lengths)
    return placed.select(*other, F.expr(f"stack({len(lengths)}, {each}) as (n, gram)")).filter(F.char_length("gram") == F.col("n"))


def trainable(gram: Column) -> Column:
    """Training keeps no n-gram that opens with two blanks or two digits."""
    return ~gram.rlike("^(  |[0-9][0-9])")


def counts(docs: DataFrame, lengths: tuple[int, ...] = (3,), by: str = "lang") -> DataFrame:
    """by, n, gram, cnt over tidy lines.

    They are counted inside tasks (counting.counted()); what leaves a task is a row per n-gram.
    """
    rows = lines(docs, keep=(by,)).select(by, tidy(F.col("line")).alias("line"))
    return counted(rows, (by,), "line", lengths).select(by, "n", "gram", "cnt")


def top_k(counted: DataFrame, k: int, by: tuple[str, ...] = ("lang",), floor: int = 2) -> DataFrame:
    """Rows with at least the K-th largest count of their group, no less than floor; ties stay.

    Only counts above one compete for the K-th place. The ranking keeps K rows per group and
    task before it shuffles.
    """
    w = Window.partitionBy(*by).orderBy(F.col("cnt").desc(), F.col("gram"))
    kth = (
        counted.filter("cnt > 1").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
        .groupBy(*by).agg(F.min("cnt").alias("low"), F.count(F.lit(1)).alias("got"))
        .select(*by, F.greatest(F.when(F.col("got") >= k, F.col("low")).otherwise(F.lit(floor)), F.lit(floor)).alias("threshold"))
    )
    return counted.join(kth, list(by)).filter(F.col("cnt") >= F.col("threshold"))


def shorter(counted: DataFrame, width: int, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Counts of the leading width characters of every n-gram."""
    return counted.groupBy(*by, F.substring("gram", 1, width).alias("gram")).agg(F.sum("cnt").alias("cnt"))


def extendable(longer: DataFrame, kept: DataFrame, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Longer n-grams whose prefix, a character shorter, was kept."""
    prefix = F.expr("substring(gram, 1, char_length(gram) - 1)")
    return longer.withColumn("head", prefix).join(kept.select(*by, F.col("gram").alias("head")), [*by, "head"], "left_semi").drop("head")


def subsumed(counted: DataFrame, ratio: float = 0.9, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """n-grams of which one single extension has at least ratio of the count."""
    child = counted.filter(F.char_length("gram") > 1).select(*by, F.expr("substring(gram, 1, char_length(gram) - 1)").alias("gram"), F.col("cnt").alias("ext"))
    best = child.groupBy(*by, "gram").agg(F.max("ext").alias("ext"))
    return counted.join(best, [*by, "gram"]).filter(F.col("ext") >= ratio * F.col("cnt")).select(*by, "gram", "cnt", "ext")


# weights


def percent_fixed(count: Column, total: Column) -> Column:
    """100 count / total in units of 1e-9, rounded, at least 1, at most 32 bits."""
    return F.least(F.greatest(F.floor(100.0 * count / total * 1e9 + 0.5), F.lit(1)), F.lit(4294967295)).cast("long")


def scaled(p: Column, power: float) -> Column:
    """The non-linear scaling of a probability: a power, a logarithm (negative power) or none."""
    if power > 0:
        return F.pow(100 * p, F.lit(power))
    if power < 0:
        return 4 * F.log(1 + p * abs(power)) / F.log(F.lit(1 + abs(power)))
    return 100 * p


def unscaled(s: Column, power: float) -> Column:
    """The inverse of scaled(); with power 0 the value as it is."""
    if power > 0:
        return F.pow(s, F.lit(1 / power)) / 100
    if power < 0:
        return (F.exp(s * F.log(F.lit(1 + abs(power))) / 4) - 1) / abs(power)
    return s


def quantised(value: Column) -> Column:
    """struct(mantissa, exponent): 15 bits kept of a 32-bit value, shifted left by 2 up to 3 times.

    A value that would lose all its bits keeps the lowest one.
    """
    top = F.lit(0xC0000000)
    exponent = F.when(value.bitwiseAND(top) != 0, 0).when((value * 4).bitwiseAND(top) != 0, 1).when((value * 16).bitwiseAND(top) != 0, 2).otherwise(3)
    moved = (value * F.pow(F.lit(4), exponent).cast("long")).cast("long")
    kept = moved.bitwiseAND(F.lit(0xFFFE0000))
    return F.struct(F.when(kept == 0, F.lit(0x20000)).otherwise(kept).cast("long").alias("mantissa"), exponent.cast("int").alias("exponent"))


# models


def train(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, k: int = 3500, power: float = WEIGHT_POWER, by: str = "lang") -> DataFrame:
    """A model row per language and n-gram: lang, n, gram, cnt, weight."""
    with scope():
        rows = lines(docs, keep=(by,)).select(by, tidy(F.col("line")).alias("line"))
        each = stage(frequent(rows, (by,), "line", lengths, k), "counts")
        total = each.filter("gram is null").groupBy(by, "n").agg(F.sum("cnt").alias("total"))
        kept = top_k(each.filter("gram is not null"), k, (by, "n"))
        return kept_table(kept.join(total, [by, "n"]).select(by, "n", "gram", "cnt", F.pow(F.col("cnt") / F.col("total"), F.lit(power)).alias("weight")), "model")


def model_similarity(model: DataFrame, by: str = "lang") -> DataFrame:
    """Cosine of every two models' weights, each pair once."""
    a = model.select(F.col(by).alias("lang_a"), "gram", F.col("weight").alias("wa"))
    b = model.select(F.col(by).alias("lang_b"), "gram", F.col("weight").alias("wb"))
    norm = model.groupBy(by).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = a.join(b, "gram").filter("lang_a < lang_b").groupBy("lang_a", "lang_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norm.select(F.col(by).alias("lang_a"), F.col("norm").alias("na")), norm.select(F.col(by).alias("lang_b"), F.col("norm").alias("nb"))
    return dot.join(na, "lang_a").join(nb, "lang_b").select("lang_a", "lang_b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def stop_grams(model: DataFrame, similar: DataFrame, least: float, weight: float = 1.0, by: str = "lang") -> DataFrame:
    """n-grams of similar languages that a language lacks, with the negative of their weight there."""
    both = similar.filter(F.col("cosine") >= least)
    ways = both.select(F.col("lang_a").alias(by), F.col("lang_b").alias("other")).unionByName(both.select(F.col("lang_b").alias(by), F.col("lang_a").alias("other")))
    theirs = model.select(F.col(by).alias("other"), "n", "gram", "weight")
    return (
        ways.join(theirs, "other").join(model.select(by, "gram"), [by, "gram"], "left_anti")
        .groupBy(by, "n", "gram").agg((-weight * F.max("weight")).alias("weight"))
    )


def merged_by(model: DataFrame, charset: str) -> DataFrame:
    """One model for each value of a coarser key, such as an encoding: counts are added."""
    return model.groupBy(charset, "n", "gram").agg(F.sum("cnt").alias("cnt"))


# labelling


#: Models of up to so many rows (n-grams times languages) go to the workers as a trie; cells of a table of scores or of worth by node.
TRIE_ROWS, CELLS = 1_000_000, 1 << 22


def identify(rows: DataFrame, model: DataFrame, key: tuple[str, ...] = ("doc_id", "line_no"), lengths: tuple[int, ...] = LENGTHS, by: str = "lang") -> DataFrame:
    """key, guess, score: sum of weight times length over occurrences, per character."""
    return _per_character(sums(rows, model, key, lengths, by), key)


def _per_character(summed: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return summed.select(*key, "guess", (F.col("raw") / F.greatest("chars", F.lit(1))).alias("score"))


def sums(rows: DataFrame, model: DataFrame, key: tuple[str, ...] = ("doc_id", "line_no"), lengths: tuple[int, ...] = LENGTHS, by: str = "lang") -> DataFrame:
    """key, guess, raw, chars: sum of weight times length over occurrences, and the length of the line.

    The model's n-grams are packed into a trie, which finds all of them at every character of an
    Arrow batch; a row per line and language leaves the task. A model of more than TRIE_ROWS rows is
    joined with the lines' n-grams instead.
    """
    known = _known(model, lengths, by)
    if known is None:
        return _sums_joined(rows, model, key, lengths, by)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                part = batch.slice(at, LINES)
                size, row, guess, raw = known.scored(part.column("__line").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in key), known.names.take(pa.array(guess)), pa.array(raw), pa.array(size[row])], names=[*key, "guess", "__raw", "__chars"])

    ship_package(rows.sparkSession)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in key), f"guess {dict(model.dtypes)[by]}, __raw double, __chars long"])
    tidied = rows.select(*key, tidy(F.col("line")).alias("__line")).filter("__line is not null")
    return tidied.mapInArrow(run, schema).groupBy(*key, "guess").agg(F.sum("__raw").alias("raw"), F.max("__chars").alias("chars"))


def vectors(rows: DataFrame, model: DataFrame, key: tuple[str, ...] = ("doc_id", "line_no"), lengths: tuple[int, ...] = LENGTHS, by: str = "lang") -> DataFrame:
    """The columns of rows but line, and v: a map from guess to the score of identify(), in order of guess; rows in which nothing is found are left out.

    A row is scored in its task and stays one row, so nothing is shuffled.
    """
    other = [c for c in rows.columns if c != "line"]
    known = _known(model, lengths, by)
    if known is None:
        scores = identify_joined(rows, model, key, lengths, by).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("guess", "score")))).alias("v"))
        return rows.select(*other).join(scores, list(key)).select(*other, "v")
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                part = batch.slice(at, LINES)
                size, row, guess, raw = known.scored(part.column("__line").to_pylist())
                met, first = np.unique(row, return_index=True)
                v = pa.MapArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), known.names.take(pa.array(guess)), pa.array(raw / np.maximum(size[row], 1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(met)) for c in other), v], names=[*other, "v"])

    ship_package(rows.sparkSession)
    types = dict(rows.dtypes)
    tidied = rows.select(*other, tidy(F.col("line")).alias("__line")).filter("__line is not null")
    return tidied.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in other), f"v map<{dict(model.dtypes)[by]},double>"]))


def _known(model: DataFrame, lengths: tuple[int, ...], by: str) -> _Known | None:
    """A model's n-grams of these lengths for the workers; None if they are too many for that."""
    known = stage(model.filter(F.col("n").isin(*lengths)).select(F.col(by).alias("guess"), "gram", "weight"), "model")
    return _Known(known.filter("gram is not null").toArrow()) if known.count() <= TRIE_ROWS else None


class _Known:
    """A trie of a model's n-grams, and what they are worth (weight times length) to each guess.

    Where nodes times guesses are few, worth is added up along the trie, so that a place of a text
    gives its last node's sums; else every n-gram found is looked up among the postings.
    """

    def __init__(self, got: pa.Table) -> None:
        self.trie = trie = Trie(got["gram"].to_pylist())
        names = got["guess"].unique()
        self.names = names.take(pc.sort_indices(names))
        gram = np.searchsorted(np.array(trie.strings, object), np.array(got["gram"].to_pylist(), object)) if got.num_rows else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.of = pc.index_in(got["guess"], value_set=self.names, skip_nulls=False).to_numpy()[order] if got.num_rows else order
        self.worth = got["weight"].to_numpy()[order] * np.array([len(s) for s in trie.strings])[gram[order]] if got.num_rows else order.astype(float)
        self.first = np.searchsorted(gram[order], np.arange(len(trie.strings) + 1))
        self.sums = self.seen = None
        if len(self.names) * len(trie.base) <= CELLS:
            each = np.zeros((len(self.names), len(trie.strings)))
            np.add.at(each, (self.of, gram[order]), self.worth)
            self.sums = trie.along(each)
            if not (self.worth > 0).all():  # else a sum above zero tells that something was found
                each = np.zeros(each.shape)
                np.add.at(each, (self.of, gram[order]), 1.0)
                self.seen = trie.along(each)

    def scored(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lines' lengths, and the line, guess and sum of every pair of these with an n-gram found."""
        size = np.array([len(x) for x in lines], np.int64)
        if not len(size):
            return size, size, size, size.astype(float)
        ends = np.cumsum(size + 1) - 1
        codes = self.trie.codes(np.frombuffer(("\0".join(lines) + "\0").encode("utf-32-le", "surrogatepass"), "<u4"))
        codes[ends] = 0
        if self.sums is not None:
            node, first = self.trie.deepest(codes), ends - size
            added = lambda table: np.stack([np.add.reduceat(t[node], first) for t in table]) if len(table) else np.zeros((0, len(size)))
            return size, *self.found(added)
        start, string = self.trie.matches(codes)
        return size, *_added(np.repeat(np.arange(len(size)), size + 1)[start], string, self.first, self.of, self.worth, len(size), len(self.names))

    def found(self, added: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, guess and sum where something was found; added gives the rows' sums (guess by row) of a table by guess and node."""
        raw = added(self.sums).T
        row, guess = np.nonzero(raw > 0 if self.seen is None else added(self.seen).T > 0)
        return row, guess, raw[row, guess]


#: Lines that are matched at a time.
LINES = 2048


def _added(row: np.ndarray, string: np.ndarray, first: np.ndarray, of: np.ndarray, worth: np.ndarray, rows: int, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, name and sum of the worth of the postings of strings found in rows; a table of all cells where it is small, else sorted."""
    many = np.diff(first)[string]
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[string], many)
    cell = np.repeat(row, many) * names + of[place]
    if rows * names <= CELLS:
        met = np.flatnonzero(np.bincount(cell, minlength=1))
        return met // max(names, 1), met % max(names, 1), np.bincount(cell, worth[place], 1)[met]
    met, at = np.unique(cell, return_inverse=True)
    return met // names, met % names, np.bincount(at, worth[place], len(met))


def identify_joined(rows: DataFrame, model: DataFrame, key: tuple[str, ...] = ("doc_id", "line_no"), lengths: tuple[int, ...] = LENGTHS, by: str = "lang") -> DataFrame:
    """identify() by a join of n-grams, for models of any size."""
    return _per_character(_sums_joined(rows, model, key, lengths, by), key)


def _sums_joined(rows: DataFrame, model: DataFrame, key: tuple[str, ...], lengths: tuple[int, ...], by: str) -> DataFrame:
    tidied = rows.select(*key, tidy(F.col("line")).alias("line"))
    seen = explode_grams(tidied.withColumn("chars", F.char_length("line")), lengths)
    known = small(model.select(F.col(by).alias("guess"), "gram", "weight"))
    return seen.join(known, "gram").groupBy(*key, "guess").agg(F.sum(F.col("weight") * F.col("n")).alias("raw"), F.max("chars").cast("long").alias("chars"))


def cut_off(scores: DataFrame, key: tuple[str, ...] = ("doc_id", "line_no"), top: int = 3, ratio: float = 0.8, least: float = ZERO) -> DataFrame:
    """The best guesses of a row: at most top, each within ratio of the best and above least."""
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("guess"))
    best = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("guess")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = scores.withColumn("place", F.row_number().over(w)).withColumn("best", F.max("score").over(best))
    return ranked.filter((F.col("place") <= top) & (F.col("score") > least) & (F.col("score") >= ratio * F.col("best"))).drop("best")


def mark(score: Column, guess: Column) -> Column:
    """The printed label: ?? at or below the guess threshold, a question mark below the sure one."""
    return F.when(score.isNull() | (score <= GUESS), "??").when(score < UNSURE, F.concat(guess, F.lit("?"))).otherwise(guess)


def accuracy(labelled: DataFrame, truth: str = "lang", guess: str = "guess") -> DataFrame:
    """Per language errors, lines and error rate."""
    wrong = F.sum(F.when(F.col(truth).eqNullSafe(F.col(guess)), 0).otherwise(1))
    return labelled.groupBy(truth).agg(wrong.alias("errors"), F.count(F.lit(1)).alias("total")).withColumn("rate", F.col("errors") / F.col("total"))


def accuracy_overall(per_language: DataFrame) -> DataFrame:
    """micro: errors over lines; macro: mean of the languages' rates."""
    return per_language.agg((F.sum("errors") / F.sum("total")).alias("micro"), F.avg("rate").alias("macro"))


def folded(labelled: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """Labels replaced by their equivalence class (source, target); others stay."""
    return labelled.join(classes, F.col(column) == F.col("source"), "left").withColumn(column, F.coalesce("target", column)).drop("source", "target")


def smoothed(scores: DataFrame, doc: str = "doc_id", order: str = "line_no", max_unsure: float = UNSURE) -> DataFrame:
    """Scores of a document's lines carried from line to line: doc, order, guess, score.

    The first line's scores are the prior, weighted by ln(length). Each later line decays the
    prior to a quarter and mixes: w = 0.5 cbrt(len) + 0.3 (max / 1.2)^1.33, share w / (1 + w),
    prior divided by 2 + 0.25 ln(len). Lines come with len. A document is one ordered fold, as
    each line depends on the one before; tasks take sorted documents one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != now:
                    _folded(now, held, out, max_unsure)
                    held = []
                    if len(out[0]) >= FOLDED:
                        yield _as_batch(out)
                        out = ([], [], [], [])
                now = row[0]
                held.append(row[1:])
        if held:
            _folded(now, held, out, max_unsure)
        yield _as_batch(out)

    def _as_batch(out: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[doc, order, "guess", "score"])

    ship_package(scores.sparkSession)
    rows = scores.select(F.col(doc).cast("long"), F.col(order).cast("int"), "len", "guess", "score").repartition(doc).sortWithinPartitions(doc, order, "len")
    return rows.mapInArrow(run, f"{doc} long, {order} int, guess string, score double")


#: Rows that smoothed() gives at a time.
FOLDED = 1 << 16


def _folded(doc: int, rows: list[tuple], out: tuple[list, ...], max_unsure: float) -> None:
    """Adds to out a row for every line of a document and every guess that it has anywhere; rows are (order, len, guess, score), sorted by line."""
    guesses = sorted({r[2] for r in rows if r[3] is not None})
    place = {g: k for k, g in enumerate(guesses)}
    lines: list[tuple] = []
    for line, size, guess, score in rows:
        if score is None:
            continue
        if not lines or lines[-1][:2] != (line, size):
            lines.append((line, size, [0.0] * len(guesses), [0] * len(guesses)))
        lines[-1][2][place[guess]] += score
        lines[-1][3][place[guess]] += 1
    prior = None
    for line, size, got, times in lines:
        got = [s / n if n > 1 else s for s, n in zip(got, times, strict=True)]  # rows that come twice count as their mean
        size = max(float(size), 1.0)
        if prior is None:
            mixed, prior = got, [s * math.log(size) if s > GUESS else 0.0 for s in got]
        else:
            prior = [s * 0.25 for s in prior]
            w = max(0.0, 0.5 * math.cbrt(size) + 0.3 * (max(got) / max_unsure) ** 1.33)
            share = w / (1 + w)
            rest = (1 - share) / (2 + 0.25 * math.log(size))
            mixed = [share * s + rest * b for s, b in zip(got, prior, strict=True)]
            prior = [b + s for s, b in zip(got, prior, strict=True)]
        out[0].extend([doc] * len(guesses))
        out[1].extend([line] * len(guesses))
        out[2].extend(guesses)
        out[3].extend(mixed)


def blocks(docs: DataFrame, size: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Overlapping blocks of a text: size characters, a quarter of it apart, at least 80.

    The last block is the first that reaches the end.
    """
    size = max(size, 80)
    step = size // 4
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))
    return docs.filter(n > 0).select(key, F.explode(starts).alias("block_start"), F.col(text).alias("__t")).select(
        key, "block_start", F.least(F.col("block_start") + size, F.char_length("__t")).alias("block_end"), F.expr(f"substring(__t, block_start + 1, {size})").alias("line")
    )


#: Characters of texts whose blocks are scored at a time.
BLOCKED = 1 << 19


def identify_blocks(docs: DataFrame, model: DataFrame, lengths: tuple[int, ...] = LENGTHS, size: int = 4096, text: str = "text", key: str = "doc_id", by: str = "lang") -> DataFrame:
    """identify() of blocks(): key, block_start, guess, score.

    Blocks overlap, but each character of a text is matched once: the sums between the ends of blocks
    are added up for each. What an end cuts, an n-gram or a run of blanks, is looked at by itself. Only
    texts whose lower case depends on where they are cut (capital sigma) or has another length
    (capital I with a dot) are cut before.
    """
    known = _known(model, lengths, by)
    if known is None or known.sums is None:
        return identify(blocks(docs, size, text, key), model, (key, "block_start"), lengths, by)
    size = max(size, 80)
    step = size // 4
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            chars = np.cumsum(pc.utf8_length(batch.column("__text")).to_numpy(zero_copy_only=False)) // BLOCKED
            cuts = [0, *(np.flatnonzero(np.diff(chars)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                at, whole = part.column("__at").to_numpy(), part.column("__whole").to_numpy(zero_copy_only=False)
                of, start, long, row, guess, raw = _block_sums(known, part.column("__text").to_pylist(), whole, size, step)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(of[row])), pa.array((at[of] + start)[row].astype(np.int32)), known.names.take(pa.array(guess)), pa.array(raw), pa.array(long[row])], names=[key, "block_start", "guess", "__raw", "__chars"])

    ship_package(docs.sparkSession)
    t, n = F.col(text), F.char_length(text)
    cut = t.contains("\u03a3") | t.contains("\u0130")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))
    piece = lambda at, whole, of: F.struct(at.alias("__at"), F.lit(whole).alias("__whole"), F.lower(of).alias("__text"))
    pieces = F.when(cut, F.transform(starts, lambda s: piece(s, False, F.substr(t, s + 1, F.lit(size))))).otherwise(F.array(piece(F.lit(0), True, t)))
    rows = docs.filter(n > 0).select(key, F.explode(pieces).alias("__p")).select(key, "__p.*")
    summed = rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, block_start int, guess {dict(model.dtypes)[by]}, __raw double, __chars long")
    return _per_character(summed.groupBy(key, "block_start", "guess").agg(F.sum("__raw").alias("raw"), F.max("__chars").alias("chars")), (key, "block_start"))


def _block_sums(known: _Known, texts: list[str], whole: np.ndarray, size: int, step: int) -> tuple[np.ndarray, ...]:
    """text, start and tidy length of every block of texts in lower case (all of a text that is not whole is one), and block, guess and sum of what is found."""
    trie, over = known.trie, max(known.trie.longest - 1, 0)
    chars = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(chars + 1) - 1
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (points == 32) | (points == 9) | (points == 13)
    stays = np.append(True, ~(blank[1:] & blank[:-1]))
    codes = trie.codes(np.where(blank, np.uint32(32), points))
    codes[ends] = 0
    codes = codes[stays]
    place = np.cumsum(stays) - stays  # how many stay before a character
    many = np.where(whole, np.maximum(-((size - chars) // step), 0) + 1, 1)
    of = np.repeat(np.arange(len(texts)), many)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step
    begin = (ends - chars)[of] + start
    end = np.where(whole[of], np.minimum(begin + size, ends[of]), ends[of])
    first, last = place[begin], place[end]
    inner = np.flatnonzero(end < ends[of])
    free = last.copy()  # from here on an n-gram may run over the end
    free[inner] = np.maximum(first[inner], last[inner] - over)
    cuts = np.unique(np.concatenate([first, free, [0]]))
    low, high = np.searchsorted(cuts, first), np.searchsorted(cuts, free)
    node = trie.deepest(codes)
    split = np.flatnonzero((start > 0) & blank[begin] & blank[begin - 1])  # begins with the rest of a run
    reach = np.arange(over)
    alone = lambda at, stop: np.where(at[:, None] + reach < stop[:, None], codes[np.minimum(at[:, None] + reach, len(codes) - 1)], 0)
    zero = lambda rows: np.zeros((len(rows), 1), codes.dtype)
    tail = trie.deepest(np.hstack([alone(free[inner], last[inner]), zero(inner)]).ravel()).reshape(len(inner), over + 1)
    head = trie.deepest(np.hstack([zero(split) + trie.codes(np.array([32]))[0], alone(first[split], last[split]), zero(split)]).ravel()).reshape(len(split), over + 2)[:, 0]

    def added(table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(table), len(of)))
        for got, worth in zip(out, table, strict=True):
            between = np.add.reduceat(worth[node], cuts)
            for k in range(int((high - low).max(initial=0))):
                more = low + k < high
                got[more] += between[(low + k)[more]]
            got[inner] += worth[tail].sum(axis=1)
            got[split] += worth[head]
        return out

    long = last - first
    long[split] += 1
    return of, start, long, *known.found(added)
