"""Queries: n-gram counting, language models, labelling and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ngrams as G
from ..operators.sizes import spread
from ..session import table
from .registry import query

K, SMALL = 500, (3, 4)
#: The size of the models that G.train() makes by itself.
FULL_K = 3500


def sized(name: str, sql: Callable[[tuple[int, ...], int], str] | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a query twice: over small models, and as name_full over models of the full definition."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for full, lengths, k in (("", SMALL, K), ("_full", G.LENGTHS, FULL_K)):

            def run(spark: SparkSession, d: str, lengths: tuple[int, ...] = lengths, k: int = k) -> DataFrame:
                return f(spark, d, lengths, k)

            query(name + full, sql and sql(lengths, k))(run)
        return f

    return add

LINES_SQL = r"""
l0 AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, lang, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line_no FROM l0),
lines AS (SELECT doc_id, lang, line_no, regexp_replace(lower(raw), '[ \t\r]+', ' ', 'g') AS line FROM l1)"""


def counts_sql(lengths: tuple[int, ...]) -> str:
    values = ", ".join(f"({n})" for n in lengths)
    return f"""{LINES_SQL},
occ AS (SELECT lang, n, unnest(list_transform(range(1, greatest(length(line) - n + 2, 1)), lambda i: substr(line, i, n))) AS gram FROM lines, (VALUES {values}) v(n)),
c AS (SELECT lang, n, gram, count(*) AS cnt FROM occ WHERE NOT regexp_matches(gram, '^(  |[0-9][0-9])') GROUP BY ALL)"""


def top_sql(k: int, by: str = "lang, n") -> str:
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cnt DESC, gram) AS place FROM c WHERE cnt > 1),
t AS (SELECT {by}, greatest(CASE WHEN count(*) >= {k} THEN min(cnt) ELSE 2 END, 2) AS threshold FROM r WHERE place <= {k} GROUP BY {by}),
kept AS (SELECT c.*, threshold FROM c JOIN t USING ({by}) WHERE cnt >= threshold)"""


def model_sql(lengths: tuple[int, ...], k: int) -> str:
    return f"""{counts_sql(lengths)}, {top_sql(k)},
tot AS (SELECT lang, n, sum(cnt) AS total FROM c GROUP BY lang, n),
model AS (SELECT lang, n, gram, cnt, pow(cnt / total, {G.WEIGHT_POWER}) AS weight FROM kept JOIN tot USING (lang, n))"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


@query("trigram_topk_by_lang", f"WITH {counts_sql((3,))}, {top_sql(K)} SELECT lang, gram, cnt, threshold FROM kept")
def trigram_topk_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return G.top_k(G.counts(_docs(spark, d)), K, ("lang", "n")).select("lang", "gram", "cnt", "threshold")


@query("trigram_counts", f"WITH {counts_sql((3,))} SELECT lang, gram, cnt FROM c")
def trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(_docs(spark, d)).select("lang", "gram", "cnt")


@query("bigram_from_trigram", f"WITH {counts_sql((3,))} SELECT lang, substr(gram, 1, 2) AS gram, sum(cnt)::BIGINT AS cnt FROM c GROUP BY ALL")
def bigram_from_trigram(spark: SparkSession, d: str) -> DataFrame:
    return G.shorter(G.counts(_docs(spark, d)), 2)


@query("trigram_row_total", f"WITH {counts_sql((3,))} SELECT substr(gram, 1, 1) AS gram, sum(cnt)::BIGINT AS cnt FROM c GROUP BY ALL")
def trigram_row_total(spark: SparkSession, d: str) -> DataFrame:
    return G.shorter(G.counts(_docs(spark, d)), 1, ())


@query("trigram_enumeration", f"WITH {counts_sql((3,))} SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY encode(gram)) AS place FROM c")
def trigram_enumeration(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.col("gram").cast("binary"))
    return G.counts(_docs(spark, d)).select("lang", "gram", F.row_number().over(w).cast("long").alias("place"))


@query(
    "ngram_extension_counts",
    f"""WITH {counts_sql(SMALL)}, {top_sql(K)}
SELECT c.lang, c.gram, c.cnt FROM c SEMI JOIN (SELECT lang, gram AS head FROM kept WHERE n = 3) k ON c.lang = k.lang AND substr(c.gram, 1, 3) = k.head WHERE n = 4""",
)
def ngram_extension_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    kept = G.top_k(G.counts(docs, (3,)), K, ("lang", "n"))
    return G.extendable(G.counts(docs, (4,)), kept).select("lang", "gram", "cnt")


@query(
    "ngram_subsumed",
    f"""WITH {counts_sql(SMALL)}, x AS (SELECT lang, substr(gram, 1, length(gram) - 1) AS gram, max(cnt) AS ext FROM c GROUP BY 1, 2)
SELECT c.lang, c.gram, c.cnt, ext FROM c JOIN x USING (lang, gram) WHERE ext >= 0.9 * cnt""",
)
def ngram_subsumed(spark: SparkSession, d: str) -> DataFrame:
    return G.subsumed(G.counts(_docs(spark, d), SMALL))


@query(
    "ngram_leaf_counts",
    f"""WITH {counts_sql(SMALL)}
SELECT lang, count(*) AS leaves FROM c ANTI JOIN (SELECT DISTINCT lang, substr(gram, 1, 3) AS gram FROM c WHERE n = 4) p USING (lang, gram) WHERE cnt >= 2 GROUP BY lang""",
)
def ngram_leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    c = G.counts(_docs(spark, d), SMALL)
    inner = c.filter("n = 4").select("lang", F.substring("gram", 1, 3).alias("gram"))
    return c.join(inner, ["lang", "gram"], "left_anti").filter("cnt >= 2").groupBy("lang").agg(F.count(F.lit(1)).alias("leaves"))


@query("ngram_next_char", f"WITH {counts_sql((4,))} SELECT lang, substr(gram, 1, 3) AS head, substr(gram, 4, 1) AS next_char, sum(cnt)::BIGINT AS cnt FROM c GROUP BY ALL")
def ngram_next_char(spark: SparkSession, d: str) -> DataFrame:
    c = G.counts(_docs(spark, d), (4,))
    return c.groupBy("lang", F.substring("gram", 1, 3).alias("head"), F.substring("gram", 4, 1).alias("next_char")).agg(F.sum("cnt").alias("cnt"))


@query("ngram_wildcard_match", f"WITH {counts_sql((4,))} SELECT lang, gram, cnt FROM c WHERE regexp_matches(gram, '^[st][aeiou].n$')")
def ngram_wildcard_match(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(_docs(spark, d), (4,)).filter(F.col("gram").rlike("^[st][aeiou].n$")).select("lang", "gram", "cnt")


@query("ngram_wildcard_count", f"WITH {counts_sql((4,))} SELECT lang, least(count(*), 1000) AS matches FROM c WHERE regexp_matches(gram, '^.[aeiou].e$') GROUP BY lang")
def ngram_wildcard_count(spark: SparkSession, d: str) -> DataFrame:
    hit = G.counts(_docs(spark, d), (4,)).filter(F.col("gram").rlike("^.[aeiou].e$"))
    return hit.groupBy("lang").agg(F.least(F.count(F.lit(1)), F.lit(1000)).alias("matches"))


_Q = "CASE WHEN v >= 1073741824 THEN 0 WHEN v * 4 >= 1073741824 THEN 1 WHEN v * 16 >= 1073741824 THEN 2 ELSE 3 END"


@query(
    "ngram_scaled_weights",
    f"""WITH {counts_sql((3,))}, tot AS (SELECT lang, sum(cnt) AS total FROM c GROUP BY lang),
p AS (SELECT lang, gram, cnt / total AS p, least(greatest(floor(100.0 * cnt / total * 1e9 + 0.5), 1), 4294967295)::BIGINT AS v FROM c JOIN tot USING (lang)),
q AS (SELECT *, {_Q} AS exponent FROM p)
SELECT lang, gram, v AS fixed, round(pow(100 * p, 0.5), 6) AS by_power, round(4 * ln(1 + p * 3) / ln(4), 6) AS by_log, round(100 * p, 6) AS by_none,
  round(pow(pow(100 * p, 0.5), 2) / 100, 8) AS back, exponent,
  CASE WHEN ((v * pow(4, exponent)::BIGINT) & 4294836224) = 0 THEN 131072 ELSE (v * pow(4, exponent)::BIGINT) & 4294836224 END::BIGINT AS mantissa FROM q""",
)
def ngram_scaled_weights(spark: SparkSession, d: str) -> DataFrame:
    c = G.counts(_docs(spark, d))
    total = c.groupBy("lang").agg(F.sum("cnt").alias("total"))
    p = c.join(total, "lang").withColumn("p", F.col("cnt") / F.col("total")).withColumn("fixed", G.percent_fixed(F.col("cnt"), F.col("total")))
    return p.withColumn("q", G.quantised(F.col("fixed"))).select(
        "lang", "gram", "fixed", F.round(G.scaled(F.col("p"), 0.5), 6).alias("by_power"), F.round(G.scaled(F.col("p"), -3), 6).alias("by_log"),
        F.round(G.scaled(F.col("p"), 0), 6).alias("by_none"), F.round(G.unscaled(G.scaled(F.col("p"), 0.5), 0.5), 8).alias("back"), "q.exponent", "q.mantissa",
    )


@query("model_train", f"WITH {model_sql(G.LENGTHS, 3500)} SELECT lang, n, gram, cnt, round(weight, 6) AS weight FROM model")
def model_train(spark: SparkSession, d: str) -> DataFrame:
    return G.train(_docs(spark, d)).withColumn("weight", F.round("weight", 6))


_SIM = """dot AS (SELECT a.lang AS lang_a, b.lang AS lang_b, sum(a.weight * b.weight) AS dot FROM model a JOIN model b ON a.gram = b.gram AND a.lang < b.lang GROUP BY ALL),
norm AS (SELECT lang, sqrt(sum(weight * weight)) AS norm FROM model GROUP BY lang),
sim AS (SELECT lang_a, lang_b, dot / (x.norm * y.norm) AS cosine FROM dot JOIN norm x ON x.lang = lang_a JOIN norm y ON y.lang = lang_b)"""


@sized("model_similarity", lambda n, k: f"WITH {model_sql(n, k)}, {_SIM} SELECT lang_a, lang_b, round(cosine, 6) AS cosine FROM sim")
def model_similarity(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    return G.model_similarity(G.train(_docs(spark, d), lengths, k)).withColumn("cosine", F.round("cosine", 6))


@sized(
    "model_stop_grams",
    lambda n, k: f"""WITH {model_sql(n, k)}, {_SIM}, ways AS (SELECT lang_a AS lang, lang_b AS other FROM sim WHERE cosine >= 0.1 UNION ALL SELECT lang_b, lang_a FROM sim WHERE cosine >= 0.1)
SELECT w.lang, m.n, m.gram, round(-max(m.weight), 6) AS weight FROM ways w JOIN model m ON m.lang = w.other
ANTI JOIN model o ON o.lang = w.lang AND o.gram = m.gram GROUP BY ALL""",
)
def model_stop_grams(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    model = G.train(_docs(spark, d), lengths, k)
    return G.stop_grams(model, G.model_similarity(model), 0.1).withColumn("weight", F.round("weight", 6))


@query("model_merge_by_script", f"WITH {model_sql((3,), K)} SELECT CASE WHEN lang = 'en' THEN 'ascii' ELSE 'latin' END AS charset, n, gram, sum(cnt)::BIGINT AS cnt FROM model GROUP BY ALL")
def model_merge_by_script(spark: SparkSession, d: str) -> DataFrame:
    model = G.train(_docs(spark, d), (3,), K).withColumn("charset", F.when(F.col("lang") == "en", "ascii").otherwise("latin"))
    return G.merged_by(model, "charset")


def scores_sql(lengths: tuple[int, ...], k: int) -> str:
    values = ", ".join(f"({n})" for n in lengths)
    return f"""{model_sql(lengths, k)},
seen AS (SELECT doc_id, line_no, length(line) AS chars, n, unnest(list_transform(range(1, greatest(length(line) - n + 2, 1)), lambda i: substr(line, i, n))) AS gram FROM lines, (VALUES {values}) v(n)),
scores AS (SELECT doc_id, line_no, m.lang AS guess, sum(weight * s.n) / greatest(max(chars), 1) AS score FROM seen s JOIN model m USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, line_no, arg_max(guess, (score, guess)) AS guess, max(score) AS score FROM scores GROUP BY ALL)"""


def line_scores(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    docs = _docs(spark, d)
    return G.identify(G.lines(docs), G.train(docs, lengths, k), lengths=lengths)


@sized("identify_lines", lambda n, k: f"WITH {scores_sql(n, k)} SELECT doc_id, line_no, guess, round(score, 4) AS score FROM scores")
def identify_lines(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    return line_scores(spark, d, lengths, k).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "guess", F.round("score", 4).alias("score"))


@sized(
    "label_lines",
    lambda n, k: f"""WITH {scores_sql(n, k)}, rk AS (SELECT *, round(score, 9) AS s, max(round(score, 9)) OVER (PARTITION BY doc_id, line_no) AS top,
  row_number() OVER (PARTITION BY doc_id, line_no ORDER BY round(score, 9) DESC, guess) AS place FROM scores)
SELECT doc_id, line_no, place, CASE WHEN s <= 0.2 THEN '??' WHEN s < 1.2 THEN guess || '?' ELSE guess END AS label FROM rk WHERE place <= 3 AND s > 0.01 AND s >= 0.8 * top""",
)
def label_lines(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    best = G.cut_off(line_scores(spark, d, lengths, k).withColumn("score", F.round("score", 9)))
    return best.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"), G.mark(F.col("score"), F.col("guess")).alias("label"))


def _best(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    top = G.cut_off(line_scores(spark, d, lengths, k).withColumn("score", F.round("score", 9)), top=1)
    every = G.lines(_docs(spark, d)).filter(F.trim("line") != "")
    return every.join(top, ["doc_id", "line_no"], "left")


_TOP1 = """top1 AS (SELECT doc_id, line_no, guess FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY round(score, 9) DESC, guess) AS place FROM scores WHERE round(score, 9) > 0.01) WHERE place = 1),
lab AS (SELECT l.doc_id, l.line_no, l.lang, guess FROM (SELECT * FROM l1 WHERE trim(raw, ' ') <> '') l LEFT JOIN top1 USING (doc_id, line_no)),
acc AS (SELECT lang, sum(CASE WHEN lang IS NOT DISTINCT FROM guess THEN 0 ELSE 1 END)::BIGINT AS errors, count(*) AS total FROM lab GROUP BY lang)"""


@sized("accuracy_report", lambda n, k: f"WITH {scores_sql(n, k)}, {_TOP1} SELECT lang, errors, total, round(errors / total, 6) AS rate FROM acc")
def accuracy_report(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    return G.accuracy(_best(spark, d, lengths, k)).withColumn("rate", F.round("rate", 6))


@sized("accuracy_micro_macro", lambda n, k: f"WITH {scores_sql(n, k)}, {_TOP1} SELECT round(sum(errors) / sum(total), 6) AS micro, round(avg(errors / total), 6) AS macro FROM acc")
def accuracy_micro_macro(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    return G.accuracy_overall(G.accuracy(_best(spark, d, lengths, k))).select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@sized(
    "accuracy_equivalence",
    lambda n, k: f"""WITH {scores_sql(n, k)}, {_TOP1}, f AS (SELECT CASE WHEN lang IN ('fr', 'es') THEN 'roa' ELSE lang END AS lang, CASE WHEN guess IN ('fr', 'es') THEN 'roa' ELSE guess END AS guess FROM lab)
SELECT lang, sum(CASE WHEN lang IS NOT DISTINCT FROM guess THEN 0 ELSE 1 END)::BIGINT AS errors, count(*) AS total FROM f GROUP BY lang""",
)
def accuracy_equivalence(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    classes = spark.createDataFrame([("fr", "roa"), ("es", "roa")], "source string, target string")
    both = G.folded(G.folded(_best(spark, d, lengths, k).select("lang", "guess"), classes, "lang"), classes, "guess")
    return G.accuracy(both).drop("rate")


@sized("language_histogram", lambda n, k: f"WITH {scores_sql(n, k)}, {_TOP1} SELECT coalesce(guess, '??') AS label, count(*) AS line_count FROM lab GROUP BY 1")
def language_histogram(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    return _best(spark, d, lengths, k).groupBy(F.coalesce("guess", F.lit("??")).alias("label")).agg(F.count(F.lit(1)).alias("line_count")).orderBy(F.desc("line_count"))


@query(
    "block_scan",
    """SELECT doc_id, b AS block_start, least(b + 4096, length(text)) AS block_end FROM (
  SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 4096) / 1024), 0)::BIGINT * 1024 + 1, 1024)) AS b FROM documents WHERE length(text) > 0)""",
)
def block_scan(spark: SparkSession, d: str) -> DataFrame:
    return G.blocks(_docs(spark, d)).select("doc_id", F.col("block_start").cast("long").alias("block_start"), F.col("block_end").cast("long").alias("block_end"))


@sized("identify_blocks")
def identify_blocks(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    docs = _docs(spark, d)
    scores = G.identify_blocks(docs, G.train(docs, lengths, k), lengths)
    return G.cut_off(scores.withColumn("score", F.round("score", 6)), ("doc_id", "block_start"))


@sized("label_smoothed")
def label_smoothed(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    sized = G.lines(_docs(spark, d)).select("doc_id", "line_no", F.octet_length("line").alias("len"))
    mixed = G.smoothed(line_scores(spark, d, lengths, k).join(sized, ["doc_id", "line_no"]))
    return G.cut_off(mixed.withColumn("score", F.round("score", 6)), top=1).select("doc_id", "line_no", "guess", "score")


@sized("model_statistics", lambda n, k: f"WITH {model_sql(n, k)} SELECT lang, n, count(*) AS postings, sum(cnt)::BIGINT AS occurrences, max(cnt) AS highest FROM model GROUP BY ALL")
def model_statistics(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    model = G.train(_docs(spark, d), lengths, k)
    return model.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("postings"), F.sum("cnt").alias("occurrences"), F.max("cnt").alias("highest"))


@sized("prefix_join_grams", lambda n, k: f"WITH {model_sql(n, k)} SELECT a.lang, a.gram AS head, count(*) AS longer FROM model a JOIN model b ON a.lang = b.lang AND b.n = 4 AND starts_with(b.gram, a.gram) WHERE a.n = 3 GROUP BY ALL")
def prefix_join_grams(spark: SparkSession, d: str, lengths: tuple[int, ...], k: int) -> DataFrame:
    model = G.train(_docs(spark, d), lengths, k)
    a = model.filter("n = 3").select("lang", F.col("gram").alias("head"))
    b = model.filter("n = 4").select("lang", F.substring("gram", 1, 3).alias("head"))
    return a.join(b, ["lang", "head"]).groupBy("lang", "head").agg(F.count(F.lit(1)).alias("longer"))
