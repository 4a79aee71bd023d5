"""Small records inside strings: tagged words, paths, numbers, completions, byte sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_word(text: Column, marker: str) -> Column:
    """struct(word, tags): a word and the tags that markers set off behind it."""
    parts = F.split(text, F.lit(f"\\Q{marker}\\E"), -1)
    return F.struct(F.get(parts, F.lit(0)).alias("word"), F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda t: t != "").alias("tags"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Behind the last point of the base name, empty without one."""
    return F.regexp_extract(base_name(path), "\\.([^.]*)$", 1)


def with_extension(path: Column, ext: str) -> Column:
    """The path with this extension in place of its own, or added."""
    return F.concat(F.regexp_replace(path, "\\.[^./]*$", ""), F.lit(f".{ext}"))


def whole_number(text: Column) -> Column:
    """The first whole number, null where there is none or it exceeds 64 bits."""
    return F.regexp_extract(text, "-?[0-9]+", 0).try_cast("long")


def completion(least: Column, most: Column) -> Column:
    """The longest common beginning of a sorted group, of its least and greatest members."""
    n = F.least(F.char_length(least), F.char_length(most))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(least, F.lit(1), i) == F.substr(most, F.lit(1), i))
    return F.substr(least, F.lit(1), F.array_max(same))


def byte_set(*parts: int | tuple[int, int]) -> frozenset[int]:
    """A set of byte values from single ones and ranges (both ends in)."""
    return frozenset(b for p in parts for b in ((p,) if isinstance(p, int) else range(p[0], p[1] + 1)) if 0 <= b <= 255)


def pattern_of(sets: Iterable[frozenset[int]]) -> str:
    """A regular expression for one byte set per position, over strings of code points below 256."""
    return "^" + "".join("[" + "".join(f"\\x{{{b:x}}}" for b in sorted(s)) + "]" if s else "[^\\x{0}-\\x{10ffff}]" for s in sets) + "$"


def must_be(values: frozenset[int], b: int) -> bool:
    return values == {b}


def could_be(values: frozenset[int], b: int) -> bool:
    return b in values


def put(record: Column, name: str, value: Column) -> Column:
    """A map with a value set, which takes the place of one that is there."""
    return F.map_concat(removed(record, name), F.create_map(F.lit(name), value))


def removed(record: Column, *names: str) -> Column:
    return F.map_filter(record, lambda k, _: ~k.isin(*names))


def prepared_lines(rows: DataFrame, most: int, low: int, high: int, encoding: str = "UTF-8", key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The first lines of each text with low to high bytes, newline counted, and their bytes in the encoding."""
    fit = rows.filter((F.octet_length("line") + 1).between(low, high))
    return fit.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__place") <= most).drop("__place").withColumn("bytes", F.encode("line", encoding))
