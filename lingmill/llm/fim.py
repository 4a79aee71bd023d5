"""Fill-in-middle: texts cut at two places between units and written in another order.

A unit is a run of ASCII letters or any other code point. One pass notes where each unit ends, in
an array of four bytes a unit; the two cuts, drawn by SHA-256 of the document's number, are looked
up there and the text is sliced at them. The parts are written as prefix, suffix, middle (psm) or
suffix, prefix, middle (spm) behind their marks; restore() gives the text back from that alone.
Rows are worked on in Arrow batches by pandas UDFs, each on its own: no shuffle, no state.

Defined cases: a null text is empty; an empty text and one that holds a mark stay plain, as their
parts could not be told apart; a null doc_id draws as the empty string; repeated rows, also those
of one doc_id with other texts, draw alike (no row depends on another, so there are no ties); an
empty table gives no rows; other columns are ignored, whatever their names; texts are whole at any
length, in memory of a few bytes a code point.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructType

from .common import arrow_ready, table, text_or_empty

#: Marks of the parts, and shares (percent) of plain texts and of spm among the others.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_BELOW, SPM_BELOW = 90, 20
SEED = "1"

_UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PARTS = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())
DIGESTS = StructType().add("output_sha256", StringType()).add("restored_sha256", StringType())


def unit_ends(text: str) -> array:
    """The code point offset at which each unit of the text ends."""
    return array("I", map(regex.Match.end, _UNIT.finditer(text)))


def draws(doc_id: str) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, doc_id: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id)
    if not n or h3 % 100 >= CUT_BELOW or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (lo, hi))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def restore(output: str, form: str) -> str:
    """The text that an output was made of. Marks stand in no part, and none begins inside another, so the first of each is its own."""
    if form == "plain":
        return output
    second = output.index(SUFFIX if form == "psm" else PREFIX)
    third = output.index(MIDDLE, second)
    first, then, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    return first + middle + then if form == "psm" else then + middle + first


@pandas_udf(PARTS)
def _cut_all(text: pd.Series, doc_id: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([cut(t, d) for t, d in zip(text, doc_id, strict=True)], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


@pandas_udf(DIGESTS)
def _digests(output: pd.Series, form: pd.Series) -> pd.DataFrame:
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole = [digest(t) for t in output]
    return pd.DataFrame({"output_sha256": whole, "restored_sha256": [w if f == "plain" else digest(restore(t, f)) for w, t, f in zip(whole, output, form, strict=True)]})


@pandas_udf(StringType())
def _restore_all(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([restore(t, f) for t, f in zip(output, form, strict=True)], dtype=object)


def restored(output: Column, form: Column) -> Column:
    """The texts that rows of transform() were made of."""
    return _restore_all(output, form)


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs."""
    arrow_ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return plain.select("doc_id", _cut_all("text", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("p")).select("doc_id", "p.*")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.withColumn("d", _digests("output", "form")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.*")


SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS seed,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit
    FROM documents
), drawn AS (
    SELECT *, CAST(len(unit) AS BIGINT) AS n,
        list_transform([1, 9, 17, 25], lambda x: list_reduce(list_transform(generate_series(0, 7), lambda i: CAST(strpos('0123456789abcdef', substr(seed, x + i, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)) AS h
    FROM units
), cuts AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT doc_id, n, form, text, array_to_string(list_slice(unit, 1, lo), '') AS p, array_to_string(list_slice(unit, lo + 1, hi), '') AS m, array_to_string(list_slice(unit, hi + 1, n), '') AS s FROM cuts
), written AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
), placed AS (
    SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS second, strpos(output, '<M>') AS third FROM written
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, second - 4) || substr(output, third + 3) || substr(output, second + 3, third - second - 3)
        ELSE substr(output, second + 3, third - second - 3) || substr(output, third + 3) || substr(output, 4, second - 4) END) AS restored_sha256
FROM placed
"""
