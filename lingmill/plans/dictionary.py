"""Queries: cover of lines by the longest words of the corpus' own dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import retrieval as R
from ..operators.ngrams import lines
from .registry import query
from .retrieval import _TF, _docs

#: Words of the dictionary: in so many documents, of so many letters and nothing else.
DF, LEAST = 5, 3


@query(
    "dictionary_cover_longest",
    f"""WITH RECURSIVE {_TF}, k AS (SELECT term FROM f WHERE df >= {DF} AND regexp_full_match(term, '[a-z]{{{LEAST},}}')), z AS (SELECT DISTINCT length(term) AS n FROM k),
l0 AS (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l0),
pl AS (SELECT DISTINCT line, unnest(range(0, length(line))) AS i FROM ln),
mt AS (SELECT line, i, max(n) AS n FROM pl CROSS JOIN z JOIN k ON k.term = substr(line, i + 1, n) WHERE i + n <= length(line) GROUP BY ALL),
nx AS (SELECT line, i, coalesce(n, 0) AS n, min(CASE WHEN n > 0 THEN i END) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM pl LEFT JOIN mt USING (line, i)),
st AS (SELECT row_number() OVER () AS id, * FROM (SELECT line, list(n ORDER BY i) AS ns, list(j ORDER BY i) AS js FROM nx GROUP BY line)),
walk AS (SELECT id, ns, js, 0::BIGINT AS i, 0::BIGINT AS cov, 0::BIGINT AS words FROM st UNION ALL SELECT id, ns, js, js[i + 1] + ns[js[i + 1] + 1], cov + ns[js[i + 1] + 1], words + 1 FROM walk WHERE js[i + 1] IS NOT NULL),
fo AS (SELECT line, cov, words FROM (SELECT id, max(cov) AS cov, max(words) AS words FROM walk GROUP BY id) JOIN st USING (id))
SELECT doc_id, line_no, length(line) AS chars, coalesce(cov, 0) AS covered, len(regexp_extract_all(line, '[ \\t]')) AS blanks, coalesce(words, 0) AS words FROM ln LEFT JOIN fo USING (line)""",
)
def dictionary_cover_longest(spark: SparkSession, d: str) -> DataFrame:
    """Lines covered by words that several documents have, at any place, so inside invented words as well."""
    docs = _docs(spark, d)
    known = R.frequencies(R.terms(docs)).filter((F.col("df") >= DF) & F.col("term").rlike(f"^[a-z]{{{LEAST},}}$"))
    return D.cover(lines(docs, keep=("doc_id",)), known, ("doc_id", "line_no"), "line").withColumn("line_no", F.col("line_no").cast("long"))
