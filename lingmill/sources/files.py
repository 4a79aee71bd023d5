"""Readers and writers: model texts, trigram lists, word lists, range lists, weights, thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directives of a model text's header.
DIRECTIVES = ("TotalCount", "Lang", "Script", "Region", "Encoding", "Source", "Alignment", "Coverage", "WeightedCoverage", "FreqCoverage", "MatchFactor", "Discount", "UTF8")


def binary(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length, content of whole files."""
    return spark.read.format("binaryFile").load(list(paths))


def text_lines(spark: SparkSession, *paths: str, delimiter: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", delimiter) if delimiter else spark.read
    return reader.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def tidy_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Trimmed lines, blank ones left out."""
    return text_lines(spark, *paths).select("path", F.trim("line").alias("line")).filter("line <> ''")


def unescape_gram(gram: Column) -> Column:
    r"""`\ ` is a blank, `\0` NUL, `\t` tab, `\n`, `\r`, `\f` themselves, `\\` a backslash."""

    def between(part: Column) -> Column:
        for mark, char in ((" ", " "), ("0", "\0"), ("t", "\t"), ("n", "\n"), ("r", "\r"), ("f", "\f")):
            part = F.replace(part, F.lit("\\" + mark), F.lit(char))
        return part

    # Backslashes pair from the left, so what stands between the pairs holds single ones only.
    return F.array_join(F.transform(F.split(gram, r"\\\\", -1), between), "\\")


def escape_gram(gram: Column) -> Column:
    out = F.replace(gram, F.lit("\\"), F.lit("\\\\"))
    for mark, char in ((" ", " "), ("0", "\0"), ("t", "\t"), ("n", "\n"), ("r", "\r"), ("f", "\f")):
        out = F.replace(out, F.lit(char), F.lit("\\" + mark))
    return out


def model_texts(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Models (path, directives map) and n-grams (path, cnt, gram, is_stop) of model texts.

    A header line is `Key: value`; the others are a count, a tab and an escaped n-gram, and a
    negative count marks a stop-gram.
    """
    rows = text_lines(spark, *paths)
    head = f"^({'|'.join(DIRECTIVES)}):[ \\t]*(.*)$"
    meta = rows.filter(F.col("line").rlike(head)).select("path", F.regexp_extract("line", head, 1).alias("key"), F.regexp_extract("line", head, 2).alias("value"))
    models = meta.groupBy("path").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("key", "value")))).alias("directives"))
    gram = "^(-?[0-9]+)\t(.*)$"
    grams = rows.filter(F.col("line").rlike(gram)).select("path", F.regexp_extract("line", gram, 1).cast("long").alias("n"), unescape_gram(F.regexp_extract("line", gram, 2)).alias("gram"))
    return models, grams.select("path", F.abs("n").alias("cnt"), "gram", (F.col("n") < 0).alias("is_stop"))


def model_lines(model: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The lines of a model text, one per n-gram, behind the columns to keep."""
    return model.select(*keep, F.concat(F.when(F.col("is_stop"), "-").otherwise(""), F.col("cnt").cast("string"), F.lit("\t"), escape_gram(F.col("gram"))).alias("value"))


def trigram_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """path, cnt, gram of trigram lists, in which < and > stand for a word's edges."""
    return text_lines(spark, *paths).filter(F.col("line").rlike("^[0-9]+ ")).select("path", F.substring_index("line", " ", 1).cast("long").alias("cnt"), F.translate(F.regexp_extract("line", "^[0-9]+ (.*)$", 1), "<>", "  ").alias("gram"))


def word_list(spark: SparkSession, *paths: str) -> DataFrame:
    """freq, word of `freq word` lines; comments after ; or # and zero frequencies are left out."""
    rows = tidy_lines(spark, *paths).filter(~F.col("line").rlike("^[;#]") & F.col("line").rlike("^[0-9]+\\s+\\S"))
    return rows.select(F.regexp_extract("line", "^([0-9]+)", 1).cast("long").alias("freq"), F.regexp_extract("line", "^[0-9]+\\s+(.*)$", 1).alias("word")).filter("freq > 0")


def weights(spark: SparkSession, *paths: str) -> DataFrame:
    """term, tf, df of a TF-IDF file whose header is `!!! documents vocabulary`."""
    part = F.split("line", "\\s+")
    rows = tidy_lines(spark, *paths).filter(~F.col("line").startswith("!!!"))
    return rows.select(part[0].alias("term"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("tf"), F.try_element_at(part, F.lit(3)).try_cast("long").alias("df")).filter("tf > 0 and df > 0")


def weight_lines(frequencies: DataFrame, documents: int) -> DataFrame:
    head = frequencies.agg(F.concat_ws(" ", F.lit("!!!"), F.lit(documents), F.count(F.lit(1))).alias("value"))
    return head.unionByName(frequencies.select(F.concat_ws(" ", "term", F.col("tf").cast("string"), F.col("df").cast("string")).alias("value")))


def thresholds(spark: SparkSession, *paths: str) -> DataFrame:
    """from_idx, threshold of `(count threshold)` pairs."""
    rows = text_lines(spark, *paths).select(F.explode(F.regexp_extract_all("line", F.lit("\\([^()]*\\)"), F.lit(0))).alias("pair"))
    return rows.select(F.regexp_extract("pair", "\\(\\s*([0-9]+)", 1).cast("int").alias("from_idx"), F.regexp_extract("pair", "([0-9.]+)\\s*\\)", 1).cast("double").alias("threshold"))


def ranges(spec: str) -> list[tuple[int, int]]:
    """Code-point ranges of `a,b-c,0x100-0x24F`; what follows a bad part is skipped."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(0[xX][0-9a-fA-F]+|[0-9]+)(?:-(0[xX][0-9a-fA-F]+|[0-9]+))?\s*", part)
        if not m:
            break
        lo = int(m[1], 0)
        out.append((lo, int(m[2], 0) if m[2] else lo))
    return out


def range_class(spec: str) -> str:
    """The ranges as a class of a regular expression; an empty list matches nothing."""
    found = ranges(spec)
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in found) + "]" if found else "[^\\x{0}-\\x{10ffff}]"


def in_ranges(point: Column, spec: str) -> Column:
    found = F.lit(False)
    for lo, hi in ranges(spec):
        found = found | point.between(lo, hi)
    return found


def weight_spec(spec: str) -> dict[str, float]:
    """`b0.1,s1.5` as a mapping; empty parts are allowed, reading stops at a malformed one."""
    out = {}
    for part in spec.split(","):
        if not part:
            continue
        m = re.fullmatch(r"([A-Za-z])([0-9]*\.?[0-9]+)", part)
        if not m:
            break
        out[m[1]] = float(m[2])
    return out


def weight_specs(spec: Column) -> Column:
    """weight_spec() of a column: a map from letter to weight."""
    good = F.regexp_extract(spec, "^(?:(?:[A-Za-z][0-9]*\\.?[0-9]+)?(?:,|$))*", 0)
    pairs = F.filter(F.split(good, ","), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring(p, 1, 1).alias("k"), F.substr(p, F.lit(2)).try_cast("double").alias("v"))))


def write_strings(rows: DataFrame, folder: str, compression: str = "none") -> None:
    """One folder per input file, its strings as lines."""
    rows.select("path", "value").write.partitionBy("path").option("compression", compression).text(folder)
