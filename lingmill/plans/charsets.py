"""Queries: byte n-gram models over texts in five charsets, charsets ranked window by window, strings found by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charsets as B
from .ngrams import _docs, top_sql
from .registry import query

FIVE = ("utf-8", "utf-16-le", "utf-16-be", "latin-1", "cp850")
K, SMALL = 500, (2, 4)
#: The upper half of the code page, in order.
_HIGH = bytes(range(128, 256)).decode("cp850").replace("'", "''")

#: Contents as hex digits, then their n-grams, cut from pieces so that no long string is walked.
CONTENTS_SQL = f"""
ch AS (SELECT doc_id, coalesce(lang, '') AS lang, encode(text) AS u8, list_transform(regexp_extract_all(text, '(?s).'), lambda c: struct_pack(u := ord(c), p := CASE WHEN ord(c) < 128 THEN ord(c) WHEN strpos('{_HIGH}', c) > 0 THEN 127 + strpos('{_HIGH}', c) ELSE 63 END)) AS cs FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, lang, 'utf-8' AS charset, 1 AS a, hex(u8) AS h FROM ch
UNION ALL SELECT doc_id, lang, 'latin-1', 1, array_to_string(list_transform(cs, lambda c: printf('%02X', CASE WHEN c.u < 256 THEN c.u ELSE 63 END)), '') FROM ch
UNION ALL SELECT doc_id, lang, 'cp850', 1, array_to_string(list_transform(cs, lambda c: printf('%02X', c.p)), '') FROM ch
UNION ALL SELECT doc_id, lang, 'utf-16-be', 2, array_to_string(list_transform(cs, lambda c: CASE WHEN c.u < 65536 THEN printf('%04X', c.u) ELSE printf('%04X%04X', 55296 + (c.u - 65536) // 1024, 56320 + c.u % 1024) END), '') FROM ch
UNION ALL SELECT doc_id, lang, 'utf-16-le', 2, array_to_string(list_transform(cs, lambda c: CASE WHEN c.u < 65536 THEN printf('%02X%02X', c.u % 256, c.u // 256) ELSE printf('%02X%02X%02X%02X', (55296 + (c.u - 65536) // 1024) % 256, (55296 + (c.u - 65536) // 1024) // 256, (56320 + c.u % 1024) % 256, (56320 + c.u % 1024) // 256) END), '') FROM ch)"""
_GRAMS = "unnest(list_transform(range(0, least({size}, length(p) // 2 - n + 1), a), lambda i: substr(p, 2 * i + 1, 2 * n))) AS gram"
MODEL_SQL = f"""{CONTENTS_SQL},
pc AS (SELECT lang, charset, a, unnest(list_transform(range(0, length(h), 512), lambda s: substr(h, s + 1, {512 + 2 * max(SMALL) - 2}))) AS p FROM x),
occ AS (SELECT lang, charset, n, {_GRAMS.format(size=256)} FROM pc, (VALUES {", ".join(f"({n})" for n in SMALL)}) v(n)),
c AS (SELECT lang, charset, n, gram, count(*) AS cnt FROM occ WHERE NOT regexp_matches(gram, '^(..)*0A|^2020|^3[0-9]3[0-9]') GROUP BY ALL), {top_sql(K, "lang, charset, n")},
tot AS (SELECT lang, charset, n, sum(cnt) AS total FROM c GROUP BY ALL),
model AS (SELECT lang, charset, n, gram, cnt, pow(cnt / total, {B.WEIGHT_POWER}) AS weight FROM kept JOIN tot USING (lang, charset, n))"""


def _model(spark: SparkSession, d: str) -> DataFrame:
    return B.train_texts(_docs(spark, d), FIVE, SMALL, K)


@query("byte_model", f"WITH {MODEL_SQL} SELECT lang, charset, n, gram, cnt, round(weight, 9) AS weight FROM model")
def byte_model(spark: SparkSession, d: str) -> DataFrame:
    """Models of byte n-grams of the documents in five charsets; n-grams as hex digits."""
    return _model(spark, d).select("lang", "charset", "n", F.hex(F.encode("gram", "ISO-8859-1")).alias("gram"), "cnt", F.round("weight", 9).alias("weight"))


@query(
    "charsets_ranked",
    f"""WITH {MODEL_SQL},
w AS (SELECT doc_id, charset AS truth, unnest(range(0, greatest(ceil((length(h) / 2 - {B.WINDOW}) / {B.APART}), 0)::BIGINT * {B.APART} + 1, {B.APART})) AS window_start, h FROM x WHERE h <> ''),
b AS (SELECT doc_id, truth, window_start, substr(h, 2 * window_start + 1, {2 * B.WINDOW}) AS p FROM w),
g AS (SELECT doc_id, truth, window_start, n, length(p) // 2 AS size, unnest(range(0, length(p) // 2 - n + 1)) AS i, p FROM b, (VALUES {", ".join(f"({n})" for n in SMALL)}) v(n)),
m AS (SELECT *, CASE WHEN charset LIKE 'utf-16%' THEN 2 ELSE 1 END AS a FROM model),
s AS (SELECT doc_id, truth, window_start, m.lang, m.charset, sum(weight * g.n) / any_value(size) AS score FROM g JOIN m ON substr(g.p, 2 * i + 1, 2 * g.n) = m.gram AND i % a = 0 GROUP BY ALL),
bc AS (SELECT doc_id, truth, window_start, charset, round(max(score) * CASE WHEN charset LIKE 'utf%' THEN 1.0 ELSE {B.CODE_PAGE} END, 9) AS score FROM s GROUP BY doc_id, truth, window_start, charset),
k AS (SELECT *, max(score) OVER (PARTITION BY doc_id, truth, window_start) AS best FROM bc)
SELECT b.doc_id, b.truth, b.window_start, coalesce(string_agg(charset, ',' ORDER BY score DESC, charset), '') AS ranked FROM b LEFT JOIN (SELECT * FROM k WHERE score >= {B.SHARE} * best AND score >= {B.LEAST}) k USING (doc_id, truth, window_start) GROUP BY b.doc_id, b.truth, b.window_start""",
)
def charsets_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The documents in five charsets: which ones their windows may be in, the likeliest first."""
    got = B.ranked(B.scores_of_texts(_docs(spark, d), FIVE, _model(spark, d), "doc_id"))
    return got.select("doc_id", "truth", F.col("window_start").cast("long").alias("window_start"), F.concat_ws(",", F.col("ranked.charset")).alias("ranked"))
