"""Queries: charset sniffs, strings of wide charsets at any alignment, strings read again, training grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ngrams as G
from ..operators import scoring as C
from ..operators import strings as S
from ..operators.sizes import spread
from ..session import table
from .ngrams import K, SMALL, _docs, counts_sql, line_scores, scores_sql
from .registry import query


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).filter("text is not null").select("doc_id", "text")


@query(
    "charset_sniffs",
    """WITH t AS (SELECT doc_id, octet_length(encode(text)) AS bytes, len(regexp_extract_all(text, '[^\\x00-\\x7F]'))::BIGINT AS multi, octet_length(encode(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) + len(regexp_extract_all(text, '[A-Za-z0-9 \\t\\n]')) AS valid FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (valid > 60 OR multi > 4) AND 24 * valid >= bytes AS is_utf8, false AS is_ascii16, CASE WHEN (valid > 60 OR multi > 4) AND 24 * valid >= bytes THEN ['utf-8', 'ascii', 'latin-1'] ELSE ['ascii', 'latin-1'] END AS charsets FROM t""",
)
def charset_sniffs(spark: SparkSession, d: str) -> DataFrame:
    return S.sniffed(_contents(spark, d).withColumn("content", F.col("text").cast("binary")), key="doc_id")


@query("charset_sniffs_wide", "SELECT doc_id, len(regexp_extract_all(text[:1000], '[A-Za-z0-9]')) > 6 AND 64 * len(regexp_extract_all(text[:1000], '[A-Za-z0-9]')) >= 2 * length(text[:1000]) AS is_ascii16 FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text[:1000], '[^\\x00-\\x7F]') AND text <> ''")
def charset_sniffs_wide(spark: SparkSession, d: str) -> DataFrame:
    """The heads of texts of ASCII alone, in 16-bit form: a block is what a sniff looks at."""
    head = _contents(spark, d).select("doc_id", F.substring("text", 1, 1000).alias("text")).filter(~F.col("text").rlike("[^\\x00-\\x7F]") & (F.col("text") != ""))
    return S.sniffed(head.withColumn("content", F.encode("text", "UTF-16LE")), key="doc_id").select("doc_id", "is_ascii16")


@query("strings_shifted", "SELECT doc_id, 3 AS \"offset\", 2 * length(t) AS length, md5(t) AS text_md5 FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) >= 2 AND regexp_matches(t, '[a-zA-Z]')")
def strings_shifted(spark: SparkSession, d: str) -> DataFrame:
    """Texts in UTF-16 behind an odd number of bytes, found by the other alignment."""
    plain = _contents(spark, d).select("doc_id", F.regexp_replace("text", "[^a-zA-Z ]", "").alias("t")).filter((F.char_length("t") >= 2) & F.col("t").rlike("[a-zA-Z]"))
    packed = plain.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.unhex(F.lit("000000")), F.encode("t", "UTF-16LE")).alias("content"))
    found = S.extract(packed, charsets=["utf-16-le"])
    return found.select(F.col("path").cast("long").alias("doc_id"), F.col("offset").cast("int").alias("offset"), F.col("length").cast("long").alias("length"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("strings_found", "SELECT doc_id, count(*) AS strings, sum(length(s)) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\\x20-\\x7E\\n]', chr(1), 'g'), '[\\x20-\\x7E\\n]{4,}')) AS s FROM documents) WHERE regexp_matches(s, '[A-Za-z0-9]') GROUP BY doc_id")
def strings_found(spark: SparkSession, d: str) -> DataFrame:
    """Strings of ASCII in whole texts, what stands between them as a byte that is none."""
    packed = _contents(spark, d).select("doc_id", F.regexp_replace("text", "[^\\x20-\\x7E\\n]", "\x01").cast("binary").alias("content"))
    return S.extract(packed, key="doc_id", charsets=["ascii"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("strings"), F.sum("length").alias("chars"))


@query(
    "strings_reextracted",
    f"""WITH {scores_sql(SMALL, K)}, top AS (SELECT doc_id, line_no, max(score) AS score FROM scores GROUP BY ALL)
SELECT doc_id, line_no, round(score, 9) > 0.2 AND octet_length(encode(raw)) >= 12 AS switched, CASE WHEN round(score, 9) > 0.2 AND octet_length(encode(raw)) >= 12 THEN md5(raw) ELSE 'kept' END AS text_md5 FROM top JOIN l1 USING (doc_id, line_no)""",
)
def strings_reextracted(spark: SparkSession, d: str) -> DataFrame:
    """Lines taken for Latin-1, read again as UTF-8 where their language is sure enough."""
    key = ["doc_id", "line_no"]
    top = line_scores(spark, d, SMALL, K).groupBy(*key).agg(F.round(F.max("score"), 9).alias("score"))
    taken = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    rows = G.lines(_docs(spark, d)).join(top, key).select(*key, "score", taken.alias("text"), F.lit("ISO-8859-1").alias("encoding"), F.octet_length("line").alias("length"), F.lit("UTF-8").alias("charset"))
    out = S.reextracted(rows)
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "switched", F.when(F.col("switched"), F.md5(F.col("text").cast("binary"))).otherwise("kept").alias("text_md5"))


@query(
    "training_grid",
    f"""WITH {counts_sql(SMALL)}, g AS (SELECT n, k FROM (VALUES (3), (4)) a(n), (VALUES (50), (200)) b(k)), r AS (SELECT c.*, g.k, row_number() OVER (PARTITION BY lang, c.n, g.k ORDER BY cnt DESC, gram) AS place FROM c JOIN g USING (n) WHERE cnt > 1),
t AS (SELECT lang, n, k, greatest(CASE WHEN count(*) >= k THEN min(cnt) ELSE 2 END, 2) AS threshold FROM r WHERE place <= k GROUP BY lang, n, k)
SELECT lang, n, k, count(*) AS kept, sum(cnt)::BIGINT AS occurrences FROM c JOIN t USING (lang, n) WHERE cnt >= threshold GROUP BY ALL""",
)
def training_grid(spark: SparkSession, d: str) -> DataFrame:
    """Models of every length and size of a grid of training defaults, from one count."""
    return C.grid(G.counts(_docs(spark, d), SMALL), (50, 200)).groupBy("lang", "n", "k").agg(F.count(F.lit(1)).alias("kept"), F.sum("cnt").alias("occurrences"))


@query("labels_unsmoothed", f"WITH {scores_sql(SMALL, K)}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY round(score, 9) DESC, guess) AS place FROM scores WHERE round(score, 9) > 0.01) SELECT doc_id, line_no, guess FROM rk WHERE place = 1")
def labels_unsmoothed(spark: SparkSession, d: str) -> DataFrame:
    """Labels with smoothing switched off."""
    scores = line_scores(spark, d, SMALL, K).withColumn("score", F.round("score", 9))
    best = G.cut_off(C.maybe_smoothed(scores, None, on=False), top=1)
    return best.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "guess")


@query("priority_places", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND q.p_size > p.p_size) AS place FROM part p")
def priority_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each row would go in its group's queue by falling priority: before all of equal priority."""
    rows = table(spark, d, "part")
    w = Window.partitionBy("p_brand")
    return rows.select("p_partkey", F.count(F.lit(1)).over(w).alias("n"), (F.rank().over(w.orderBy(F.desc("p_size"))) - 1).cast("long").alias("place"))


@query(
    "identify_blocks_small",
    f"""WITH {scores_sql(SMALL, K)}, b AS (SELECT doc_id, unnest(range(0, greatest(ceil((length(text) - 4096) / 1024), 0)::BIGINT * 1024 + 1, 1024)) AS block_start, text FROM documents WHERE length(text) > 0),
bl AS (SELECT doc_id, block_start, regexp_replace(lower(substr(text, block_start + 1, 4096)), '[ \\t\\r]+', ' ', 'g') AS line FROM b),
bs AS (SELECT doc_id, block_start, length(line) AS chars, n, unnest(list_transform(range(1, greatest(length(line) - n + 2, 1)), lambda i: substr(line, i, n))) AS gram FROM bl, (VALUES (3), (4)) v(n)),
sc AS (SELECT doc_id, block_start, m.lang AS guess, round(sum(weight * s.n) / greatest(max(chars), 1), 6) AS score FROM bs s JOIN model m USING (gram) GROUP BY ALL),
rk AS (SELECT *, max(score) OVER (PARTITION BY doc_id, block_start) AS top, row_number() OVER (PARTITION BY doc_id, block_start ORDER BY score DESC, guess) AS place FROM sc)
SELECT doc_id, block_start, guess, place FROM rk WHERE place <= 3 AND score > 0.01 AND score >= 0.8 * top""",
)
def identify_blocks_small(spark: SparkSession, d: str) -> DataFrame:
    """The labels of blocks, as identify_blocks gives them, without scores."""
    docs, key = _docs(spark, d), ("doc_id", "block_start")
    scores = G.identify_blocks(docs, G.train(docs, SMALL, K), SMALL)
    return G.cut_off(scores.withColumn("score", F.round("score", 6)), key).select("doc_id", F.col("block_start").cast("long").alias("block_start"), "guess", F.col("place").cast("long").alias("place"))


