"""Queries: TF-IDF, inverted index, word n-gram models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.sizes import spread
from ..session import table
from .registry import query

STOP = ("the", "of", "and", "de", "la", "der", "die")
_W = "w0 AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS ws FROM documents), w AS (SELECT doc_id, source, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM w0)"
_TF = f"{_W}, per AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM per GROUP BY term), t AS (SELECT count(*) AS n FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


@query("tokens_blank", f"WITH {_W} SELECT doc_id, pos, term FROM w")
def tokens_blank(spark: SparkSession, d: str) -> DataFrame:
    return R.terms(_docs(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


@query("tfidf_frequencies", f"WITH {_TF} SELECT term, tf, df FROM f")
def tfidf_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return R.frequencies(R.terms(_docs(spark, d)))


@query("tfidf_values", f"WITH {_TF} SELECT term, round(ln(t.n / df), 6) AS idf, round(CASE WHEN df > t.n + 1 THEN 0.0 ELSE tf * ln(t.n / df) / df END, 6) AS value FROM f, t")
def tfidf_values(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    total = F.lit(docs.count())
    return R.frequencies(R.terms(docs)).select("term", F.round(R.idf(F.col("df"), total), 6).alias("idf"), F.round(R.tf_idf(F.col("tf"), F.col("df"), total), 6).alias("value"))


@query("index_postings", f"WITH {_W} SELECT DISTINCT term, doc_id FROM w WHERE term NOT IN {STOP}")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(R.terms(_docs(spark, d), stop=STOP))


@query("index_and", f"WITH {_W} SELECT doc_id FROM w WHERE term IN ('the', 'of', 'that') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def index_and(spark: SparkSession, d: str) -> DataFrame:
    return R.fetch_all(R.postings(R.terms(_docs(spark, d))), ["the", "of", "that"])


@query("index_or", f"WITH {_W} SELECT DISTINCT doc_id FROM w WHERE term IN ('und', 'que')")
def index_or(spark: SparkSession, d: str) -> DataFrame:
    return R.fetch_any(R.postings(R.terms(_docs(spark, d))), ["und", "que"])


def _grams(n: int) -> str:
    leads = " || ' ' || ".join(["term", *(f"lead(term, {k}) OVER p" for k in range(1, n))])
    return f"g{n} AS (SELECT doc_id, pos, gram FROM (SELECT doc_id, pos, {leads} AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL), c{n} AS (SELECT gram, count(*) AS freq FROM g{n} GROUP BY gram)"


for _n in (1, 2, 3):

    def _count(spark: SparkSession, d: str, n: int = _n) -> DataFrame:
        return R.ngram_counts(_docs(spark, d), n, 2)

    query(f"word_{_n}gram_counts", f"WITH {_W}, {_grams(_n)} SELECT gram, freq FROM c{_n} WHERE freq >= 2")(_count)

_LADDER = f"""WITH {_W}, {_grams(1)}, {_grams(2)}, {_grams(3)},
h3 AS (SELECT *, array_to_string(string_split(gram, ' ')[1:2], ' ') AS head FROM c3), h2 AS (SELECT *, string_split(gram, ' ')[1] AS head FROM c2),
q3 AS (SELECT gram, freq, freq / sum(freq) OVER (PARTITION BY head) AS p3 FROM h3), q2 AS (SELECT gram AS g2, freq / sum(freq) OVER (PARTITION BY head) AS p2 FROM h2), q1 AS (SELECT gram AS w1, freq / sum(freq) OVER () AS p1 FROM c1),
ladder AS (SELECT gram, freq, p3, p2, p1 FROM q3 JOIN q2 ON array_to_string(string_split(gram, ' ')[2:3], ' ') = g2 JOIN q1 ON string_split(gram, ' ')[3] = w1)"""


@query("lm_conditional", f"{_LADDER} SELECT gram, freq, round(p3, 6) AS p FROM q3")
def lm_conditional(spark: SparkSession, d: str) -> DataFrame:
    return R.conditional(_docs(spark, d), 3).withColumn("p", F.round("p", 6))


@query(
    "lm_smoothing",
    f"""{_LADDER} SELECT gram, round(p3, 6) AS none, round(coalesce(p3, p2, p1), 6) AS backoff, round(greatest(p3, p2, p1), 6) AS highest, round((p1 + p2 + p3) / 3, 6) AS mean,
round((p1 + 2 * p2 + 3 * p3) / 6, 6) AS linear, round((p1 + 4 * p2 + 9 * p3) / 14, 6) AS square, round((p1 + 8 * p2 + 27 * p3) / 36, 6) AS cube, round((2 * p1 + 4 * p2 + 8 * p3) / 14, 6) AS power FROM ladder""",
)
def lm_smoothing(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"none": "none", "backoff": "backoff", "highest": "max", "mean": "mean", "linear": "linear", "square": "square", "cube": "cube", "power": "power"}
    p = [F.col(c) for c in ("p3", "p2", "p1")]
    return R.ladder(_docs(spark, d)).select("gram", *(F.round(R.smoothing(kind, *p), 6).alias(name) for name, kind in kinds.items()))


@query(
    "lm_longest_match",
    f"""WITH {_W}, {", ".join(_grams(n) for n in (1, 2, 3))} SELECT doc_id, pos, max(n) AS n FROM (SELECT doc_id, pos, 1 AS n FROM g1 UNION ALL SELECT doc_id, pos, 2 FROM g2 SEMI JOIN (SELECT * FROM c2 WHERE freq > 1) USING (gram)
UNION ALL SELECT doc_id, pos, 3 FROM g3 SEMI JOIN (SELECT * FROM c3 WHERE freq > 1) USING (gram)) GROUP BY ALL""",
)
def lm_longest_match(spark: SparkSession, d: str) -> DataFrame:
    return R.longest_match(_docs(spark, d), most=3).select("doc_id", F.col("pos").cast("long").alias("pos"), "n")


@query("lm_longest_match_whole")
def lm_longest_match_whole(spark: SparkSession, d: str) -> DataFrame:
    """As lm_longest_match, without its bound of three words."""
    return R.longest_match(_docs(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "n")


@query("lm_match_with_gap", f"WITH {_W} SELECT a.doc_id, a.pos AS p1, b.pos AS p2 FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.term = 'the' AND b.term = 'of'")
def lm_match_with_gap(spark: SparkSession, d: str) -> DataFrame:
    t = R.terms(_docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))
    a, b = t.filter("term = 'the'").select("doc_id", F.explode(F.array(*(F.col("pos") + k for k in (1, 2, 3)))).alias("p2"), F.col("pos").alias("p1")), t.filter("term = 'of'").select("doc_id", F.col("pos").alias("p2"))
    return a.join(b, ["doc_id", "p2"]).select("doc_id", "p1", "p2")


@query("vocabulary_ids", f"WITH {_W} SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS id FROM (SELECT DISTINCT term FROM w)")
def vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import numbered

    return numbered(R.terms(_docs(spark, d)).select("term").distinct(), "term").select("term", F.col("i").alias("id"))


@query("dictionary_coverage", f"WITH {_TF}, k AS (SELECT term FROM f WHERE df >= 20) SELECT doc_id, round(sum(CASE WHEN k.term IS NULL THEN 0 ELSE length(w.term) + 1 END) / sum(length(w.term) + 1), 6) AS covered FROM w LEFT JOIN k ON w.term = k.term GROUP BY doc_id")
def dictionary_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = R.terms(_docs(spark, d))
    known = R.frequencies(rows).filter("df >= 20").select(F.col("term").alias("known"))
    size = F.char_length("term") + 1
    return rows.join(known, F.col("term") == F.col("known"), "left").groupBy("doc_id").agg(F.round(F.sum(F.when(F.col("known").isNull(), 0).otherwise(size)) / F.sum(size), 6).alias("covered"))
