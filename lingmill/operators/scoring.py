"""What follows identification: score vectors and their algebra, names of languages, weights and discounts.

Scores are rows (key..., guess, score) where they are joined and ranked, and maps from guess to
score where one row's vector is worked on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .ngrams import GUESS, UNSURE, identify, smoothed, sums, top_k

#: Weight of the average bigram probability, share kept of a score in another charset, of a prior over a gap, and the bonus of a sole survivor.
BIGRAM_WEIGHT, ALTERNATE_CHARSET, GAP_DECAY, SOLE_BONUS = 0.15, 0.9, 0.75, 1.15
#: A gap of over so many bytes decays the prior, after so many strings and bytes.
GAP_BYTES, GAP_STRINGS, GAP_FROM = 20, 2, 96


# names


def descriptor(lang: Column, region: Column, encoding: Column) -> Column:
    """lang_region-encoding; parts that are null or empty are left out."""
    filled = lambda c: (c.isNotNull()) & (c != "")
    return F.concat(lang, F.when(filled(region), F.concat(F.lit("_"), region)).otherwise(""), F.when(filled(encoding), F.concat(F.lit("-"), encoding)).otherwise(""))


def descriptor_parts(name: Column) -> Column:
    """struct(lang, region, encoding) of a descriptor; absent parts are null."""
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return F.struct(part("^([^_-]+)").alias("lang"), part("^[^_-]*_([^-]+)").alias("region"), part("^[^-]*-(.+)$").alias("encoding"))


def same_language(a: Column, b: Column, with_region: bool = True) -> Column:
    """Whether two descriptors name one language; * matches any part, absent regions match each other alone."""
    x, y = descriptor_parts(a), descriptor_parts(b)
    same = (x["lang"] == y["lang"]) | (x["lang"] == "*") | (y["lang"] == "*")
    if with_region:
        same = same & (x["region"].eqNullSafe(y["region"]) | F.coalesce(x["region"] == "*", F.lit(False)) | F.coalesce(y["region"] == "*", F.lit(False)))
    return same


# rows of scores


def best_per_language(scores: DataFrame, key: tuple[str, ...], lang: str = "lang") -> DataFrame:
    """Of several models of one language the one with the best score, of ties the first by name."""
    return scores.groupBy(*key, lang).agg(F.min(F.struct((-F.round("score", 9)).alias("low"), "guess", "score")).alias("b")).select(*key, lang, "b.guess", "b.score")


def merged_duplicates(scores: DataFrame, key: tuple[str, ...], lang: str = "lang") -> DataFrame:
    """The scores of a language's models added up, with the place of the language in descending order."""
    summed = scores.groupBy(*key, lang).agg(F.sum("score").alias("score"))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.round("score", 9)), lang)))


def with_stop_grams(model: DataFrame, stops: DataFrame, weight: float = 1.0) -> DataFrame:
    """A model with its stop-grams, whose negative weights take from a language's score."""
    return model.select("lang", "n", "gram", "weight").unionByName(stops.select("lang", "n", "gram", (weight * F.col("weight")).alias("weight")))


def with_bigrams(scores: DataFrame, rows: DataFrame, bigrams: DataFrame, key: tuple[str, ...], weight: float = BIGRAM_WEIGHT) -> DataFrame:
    """Scores plus weight times the average probability of a row's bigrams in the guess; bigrams are (lang, gram, p)."""
    met = sums(rows, bigrams.select("lang", F.lit(2).alias("n"), "gram", F.col("p").alias("weight")), key, (2,))
    extra = met.select(*key, "guess", (F.col("raw") / 2 / F.greatest(F.col("chars") - 1, F.lit(1))).alias("extra"))
    return scores.join(extra, [*key, "guess"], "left").select(*key, "guess", (F.col("score") + weight * F.coalesce("extra", F.lit(0.0))).alias("score"))


def adjusted(scores: DataFrame, coverage: DataFrame) -> DataFrame:
    """Scores over the share of its training text that a model's n-grams cover; (guess, coverage), 1 where unknown or zero."""
    return scores.join(F.broadcast(coverage), "guess", "left").withColumn("score", F.col("score") / F.coalesce(F.nullif("coverage", F.lit(0.0)), F.lit(1.0))).drop("coverage")


def coverage(counted: DataFrame, model: DataFrame) -> DataFrame:
    """guess, coverage: the share of all n-gram occurrences of a language that are in its model."""
    total = counted.groupBy("lang").agg(F.sum("cnt").alias("total"))
    kept = model.groupBy("lang").agg(F.sum("cnt").alias("kept"))
    return kept.join(total, "lang").select(F.col("lang").alias("guess"), (F.col("kept") / F.col("total")).alias("coverage"))


def weighted(scores: DataFrame, weights: dict[str, float], root: bool = False) -> DataFrame:
    """Scores times their language's weight (1 where none is given), or the root of it."""
    if not weights:
        return scores
    given = F.create_map(*(x for lang, w in weights.items() for x in (F.lit(lang), F.lit(float(w)))))
    w = F.coalesce(F.element_at(given, F.col("guess")), F.lit(1.0))
    return scores.withColumn("score", F.col("score") * (F.sqrt(w) if root else w))


def charset_discounted(scores: DataFrame, of_model: Column, extracted: Column, share: float = ALTERNATE_CHARSET) -> DataFrame:
    """Scores of models of another charset than the string was extracted with lose a tenth."""
    return scores.withColumn("score", F.when(of_model.eqNullSafe(extracted), F.col("score")).otherwise(share * F.col("score")))


# vectors


def vectors(scores: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, v: a map from guess to score, in order of guess."""
    return scores.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("guess", "score")))).alias("v"))


def scale(v: Column, by: float | Column) -> Column:
    return F.transform_values(v, lambda _, s: s * by)


def root(v: Column) -> Column:
    return F.transform_values(v, lambda _, s: F.sqrt(F.greatest(s, F.lit(0.0))))


def added(a: Column, b: Column, weight: float | Column = 1.0) -> Column:
    """a plus weight times b, over the guesses of both."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.map_zip_with(a, b, lambda _, x, y: zero(x) + zero(y) * weight)


def added_above(a: Column, b: Column, threshold: float, weight: float = 1.0) -> Column:
    """a plus weight times those of b that reach the threshold."""
    return added(a, F.map_filter(b, lambda _, s: s >= threshold), weight)


def subtracted(a: Column, b: Column) -> Column:
    return added(a, b, -1.0)


def incremented(v: Column, guess: str, by: float) -> Column:
    return added(v, F.create_map(F.lit(guess), F.lit(by)))


def highest(v: Column) -> Column:
    """The best score, 0 of an empty vector."""
    return F.coalesce(F.array_max(F.map_values(v)), F.lit(0.0))


def nonzero(v: Column) -> Column:
    return F.size(F.filter(F.map_values(v), lambda s: s != 0))


def combined(score: Column, prior: Column, share: Column, smoothing: Column) -> Column:
    """Share of the own scores and the rest of the smoothed-down prior."""
    return added(scale(score, share), scale(prior, (1 - share) / smoothing))


def smoothing_share(size: Column, best: Column, unsure: float = 1.2) -> Column:
    """w / (1 + w) with w = 0.5 cbrt(size) + 0.3 (best / unsure)^1.33: how much a string's own scores count."""
    w = F.greatest(F.lit(0.0), 0.5 * F.cbrt(size) + 0.3 * F.pow(F.greatest(best, F.lit(0.0)) / unsure, F.lit(1.33)))
    return w / (1 + w)


def priors(strings: DataFrame, doc: str = "doc_id", order: str = "line_no") -> DataFrame:
    """strings with their vectors mixed with those before, as (doc, order, v, gap, size) in order come.

    Over a gap of more than 20 bytes, after two strings and 96 bytes, the prior loses a quarter.
    Where one language alone survives the guess threshold, the prior of it gains 15 percent. A
    document is one ordered fold, as each string depends on the one before; tasks take the strings
    of sorted documents as they come and hold the prior alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prior, seen, taken = object(), {}, 0, 0
        for batch in batches:
            v = batch.column("v")
            at, names, scores = v.offsets.to_pylist(), v.keys.to_pylist(), v.items.to_pylist()
            ends, guesses, out = [0], [], []
            for i, (name, gap, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (doc, "gap", "size")), strict=True)):
                if name != now:
                    now, prior, seen, taken = name, {}, 0, 0
                own = dict(zip(names[at[i] : at[i + 1]], scores[at[i] : at[i + 1]], strict=True))
                mixed, prior = _mixed(own, prior, seen, size, gap is not None and gap > GAP_BYTES and seen >= GAP_STRINGS and taken >= GAP_FROM)
                seen, taken = seen + 1, taken + size
                guesses.extend(mixed)
                out.extend(mixed.values())
                ends.append(len(out))
            mixes = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(guesses, pa.string()), pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(doc), batch.column(order), mixes], names=[doc, order, "v"])

    ship_package(strings.sparkSession)
    types = dict(strings.dtypes)
    rows = strings.select(doc, order, "v", "gap", "size").repartition(doc).sortWithinPartitions(doc, order, "size", "gap")
    return rows.mapInArrow(run, f"{doc} {types[doc]}, {order} {types[order]}, v map<string,double>")


def _mixed(own: dict[str, float], prior: dict[str, float], seen: int, size: int, far: bool) -> tuple[dict[str, float], dict[str, float]]:
    """A string's scores mixed with the prior, and the prior of the next one."""
    long = math.log(max(float(size), 1.0))
    decay = 0.25 * GAP_DECAY if far else 0.25
    prior = {g: s * decay for g, s in prior.items()}
    if seen:
        w = max(0.0, 0.5 * math.cbrt(size) + 0.3 * (max([0.0, *own.values()]) / UNSURE) ** 1.33)
        share = w / (1 + w)
        rest = (1 - share) / (2 + 0.25 * long)
        mixed = {g: s * share + prior.get(g, 0.0) * rest for g, s in own.items()}
        mixed.update((g, s * rest) for g, s in prior.items() if g not in own)
    else:
        mixed, own = own, {g: s * long for g, s in own.items() if s > GUESS}
    for g, s in own.items():
        prior[g] = prior.get(g, 0.0) + s
    alive = [g for g, s in mixed.items() if s > GUESS]
    if len(alive) == 1 and alive[0] in prior:
        prior[alive[0]] *= SOLE_BONUS
    return mixed, prior


# models


def too_few(k: int, longest: Column) -> Column:
    """The number of n-grams under which a trainer warns: K over the whole part of 1.5^(longest - 3), longest within 3 and 100."""
    return F.floor(F.lit(k) / F.floor(F.pow(F.lit(1.5), F.least(F.greatest(longest, F.lit(3)), F.lit(100)) - 3)))


def aligned(gram_starts: Column, alignment: Column) -> Column:
    """Whether an n-gram may start at this byte under a model's alignment (1, 2 or 4)."""
    return gram_starts % F.greatest(alignment, F.lit(1)) == 0


def inserted(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Postings (gram, model, cnt) with the counts of more set; others stay."""
    return postings.join(more.select("gram", "model"), ["gram", "model"], "left_anti").unionByName(more)


def raised(postings: DataFrame, more: DataFrame) -> DataFrame:
    """The larger of both counts of each posting."""
    return postings.unionByName(more).groupBy("gram", "model").agg(F.max("cnt").alias("cnt"))


def incremented_postings(postings: DataFrame, more: DataFrame) -> DataFrame:
    return postings.unionByName(more).groupBy("gram", "model").agg(F.sum("cnt").alias("cnt"))


def probability(postings: DataFrame, model: str) -> DataFrame:
    """gram, p: the share of each n-gram in the counts of one model."""
    own = postings.filter(F.col("model") == model)
    total = own.agg(F.sum("cnt").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("gram", (F.col("cnt") / F.col("total")).alias("p"))


def packed(postings: DataFrame) -> DataFrame:
    """One row per n-gram: its postings as a map from model to count."""
    return postings.groupBy("gram").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "cnt")))).alias("models"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("gram", F.explode("models").alias("model", "cnt"))


def mapped(postings: DataFrame, score: Callable[[int], float] | Column) -> DataFrame:
    """Postings with score, a function of cnt: a column expression, or a Python function of whole numbers.

    Of a Python function each distinct count is asked once, and the table of its answers joined; a
    null count is not asked for and has a null score.
    """
    if isinstance(score, Column):
        return postings.withColumn("score", score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(score(v)) for v in values], pa.float64())], names=["cnt", "score"])

    ship_package(postings.sparkSession)
    told = postings.select("cnt").filter("cnt is not null").distinct().mapInArrow(run, "cnt long, score double")
    return postings.join(told, "cnt", "left")


def grid(counted: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """lang, n, k, gram, cnt of the models of every size k, all from one table of counts of all lengths."""
    out = None
    for k in sizes:
        one = top_k(counted, k, ("lang", "n")).select("lang", "n", F.lit(k).alias("k"), "gram", "cnt")
        out = one if out is None else out.unionByName(one)
    return out


def maybe_smoothed(scores: DataFrame, sizes: DataFrame | None, on: bool) -> DataFrame:
    """Line scores through smoothed() with the lines' sizes (doc_id, line_no, len), or as they are: blocks are never smoothed, strings are unless told otherwise."""
    return smoothed(scores.join(sizes, ["doc_id", "line_no"])) if on else scores


def fuzzy_errors(labelled: DataFrame, truth: str = "lang", guess: str = "guess", alike: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per language the errors when a guess from a list of like languages counts as right."""
    pairs = [F.lit(f"{a}|{b}") for a, others in (alike or {}).items() for b in others]
    near = F.concat_ws("|", F.col(truth), F.coalesce(F.col(guess), F.lit(""))).isin([]) if not pairs else F.array_contains(F.array(*pairs), F.concat_ws("|", F.col(truth), F.coalesce(F.col(guess), F.lit(""))))
    right = F.col(truth).eqNullSafe(F.col(guess)) | near
    return labelled.groupBy(truth).agg(F.sum(F.when(right, 0).otherwise(1)).alias("errors"), F.count(F.lit(1)).alias("total"))


def identify_with(rows: DataFrame, model: DataFrame, key: tuple[str, ...], lengths: tuple[int, ...]) -> DataFrame:
    """identify() under a model whose names are descriptors; lang is the language of the guess."""
    return identify(rows, model, key, lengths).withColumn("lang", descriptor_parts(F.col("guess"))["lang"])
