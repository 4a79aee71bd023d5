"""Queries: what follows identification, over small models of the languages and of their regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngrams as G
from ..operators import scoring as S
from ..operators.sizes import spread
from ..session import table
from .ngrams import _SIM, _TOP1, K, SMALL, _best, counts_sql, model_sql, scores_sql
from .registry import query

KEY = ("doc_id", "line_no")
_REGION = "CASE WHEN coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0) % 2 = 0 THEN 'A' ELSE 'B' END"


def _regional_sql(sql: str) -> str:
    return sql.replace("FROM documents", f"FROM (SELECT doc_id, text, lang || '_' || {_REGION} AS lang FROM documents) documents")


def _docs(spark: SparkSession, d: str, regional: bool = False) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    region = F.when(F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0)) % 2 == 0, "A").otherwise("B")
    return docs.withColumn("lang", F.concat_ws("_", "lang", region)).filter("lang is not null") if regional else docs


def _scores(spark: SparkSession, d: str, regional: bool = False) -> DataFrame:
    docs = _docs(spark, d, regional)
    return S.identify_with(G.lines(docs), G.train(docs, SMALL, K), KEY, SMALL)


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), *more, F.round("score", 4).alias("score"))


@query(
    "scores_best_per_language",
    f"WITH {_regional_sql(scores_sql(SMALL, K))}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, guess[:2] ORDER BY round(score, 9) DESC, guess) AS place FROM scores) SELECT doc_id, line_no, guess[:2] AS lang, guess, round(score, 4) AS score FROM b WHERE place = 1",
)
def scores_best_per_language(spark: SparkSession, d: str) -> DataFrame:
    return _shown(S.best_per_language(_scores(spark, d, True), KEY), "lang", "guess")


@query(
    "scores_merged",
    f"""WITH {_regional_sql(scores_sql(SMALL, K))}, m AS (SELECT doc_id, line_no, guess[:2] AS lang, sum(score) AS score FROM scores GROUP BY ALL)
SELECT doc_id, line_no, lang, round(score, 4) AS score, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY round(score, 9) DESC, lang) AS place FROM m""",
)
def scores_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = S.merged_duplicates(_scores(spark, d, True), KEY).withColumn("place", F.col("place").cast("long"))
    return _shown(rows, "lang", "place")


_STOPS = """ways AS (SELECT lang_a AS lang, lang_b AS other FROM sim WHERE cosine >= 0.1 UNION ALL SELECT lang_b, lang_a FROM sim WHERE cosine >= 0.1),
stops AS (SELECT w.lang, m.n, m.gram, -max(m.weight) AS weight FROM ways w JOIN model m ON m.lang = w.other ANTI JOIN model o ON o.lang = w.lang AND o.gram = m.gram GROUP BY ALL)"""
_SEEN = "seen AS (SELECT doc_id, line_no, length(line) AS chars, n, unnest(list_transform(range(1, greatest(length(line) - n + 2, 1)), lambda i: substr(line, i, n))) AS gram FROM lines, (VALUES (3), (4)) v(n))"


@query(
    "scores_stop_grams",
    f"""WITH {model_sql(SMALL, K)}, {_SIM}, {_STOPS}, {_SEEN}, signed AS (SELECT lang, gram, weight FROM model UNION ALL SELECT lang, gram, 0.5 * weight FROM stops)
SELECT doc_id, line_no, b.lang AS guess, round(sum(weight * s.n) / greatest(max(chars), 1), 4) AS score FROM seen s JOIN signed b USING (gram) GROUP BY ALL""",
)
def scores_stop_grams(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    model = G.train(docs, SMALL, K)
    stops = G.stop_grams(model, G.model_similarity(model), 0.1)
    return _shown(G.identify(G.lines(docs), S.with_stop_grams(model, stops, 0.5), KEY, SMALL), "guess")


@query(
    "scores_with_bigrams",
    f"""WITH {scores_sql(SMALL, K)}, occ2 AS (SELECT doc_id, line_no, lang, length(line) AS chars, unnest(list_transform(range(1, greatest(length(line), 1)), lambda i: substr(line, i, 2))) AS gram FROM lines),
c2 AS (SELECT lang, gram, count(*) AS cnt FROM occ2 WHERE NOT regexp_matches(gram, '^(  |[0-9][0-9])') GROUP BY ALL), t2 AS (SELECT lang, sum(cnt) AS total FROM c2 GROUP BY lang),
p2 AS (SELECT lang, gram, cnt / total AS p FROM c2 JOIN t2 USING (lang)), x AS (SELECT o.doc_id, o.line_no, p2.lang AS guess, sum(p) / greatest(max(chars) - 1, 1) AS extra FROM occ2 o JOIN p2 USING (gram) GROUP BY ALL)
SELECT doc_id, line_no, guess, round(score + 0.15 * coalesce(extra, 0), 4) AS score FROM scores LEFT JOIN x USING (doc_id, line_no, guess)""",
)
def scores_with_bigrams(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    counted = G.counts(docs, (2,))
    total = counted.groupBy("lang").agg(F.sum("cnt").alias("total"))
    pairs = counted.join(total, "lang").select("lang", "gram", (F.col("cnt") / F.col("total")).alias("p"))
    return _shown(S.with_bigrams(_scores(spark, d), G.lines(docs), pairs, KEY), "guess")


@query(
    "scores_coverage",
    f"""WITH {scores_sql(SMALL, K)}, cov AS (SELECT lang AS guess, k / t AS coverage FROM (SELECT lang, sum(cnt) AS k FROM model GROUP BY lang) JOIN (SELECT lang, sum(cnt) AS t FROM c GROUP BY lang) USING (lang))
SELECT doc_id, line_no, guess, round(score / coverage, 4) AS score FROM scores JOIN cov USING (guess)""",
)
def scores_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    model = G.train(docs, SMALL, K)
    return _shown(S.adjusted(G.identify(G.lines(docs), model, KEY, SMALL), S.coverage(G.counts(docs, SMALL), model)), "guess")


@query("scores_weighted", f"WITH {scores_sql(SMALL, K)} SELECT doc_id, line_no, guess, round(score * sqrt(CASE guess WHEN 'en' THEN 1.5::DOUBLE WHEN 'de' THEN 0.8::DOUBLE ELSE 1 END), 4) AS score FROM scores")
def scores_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _shown(S.weighted(_scores(spark, d), {"en": 1.5, "de": 0.8}, root=True), "guess")


@query(
    "scores_charset_discount",
    f"""WITH {scores_sql(SMALL, K)} SELECT s.doc_id, s.line_no, guess, round(CASE WHEN (guess = 'en') = (octet_length(encode(raw)) = length(raw)) THEN score ELSE 0.9::DOUBLE * score END, 4) AS score
FROM scores s JOIN l1 USING (doc_id, line_no)""",
)
def scores_charset_discount(spark: SparkSession, d: str) -> DataFrame:
    charset = F.when(F.octet_length("line") == F.char_length("line"), "ascii").otherwise("latin-1")
    lines = G.lines(_docs(spark, d)).select(*KEY, charset.alias("charset"))
    return _shown(S.charset_discounted(_scores(spark, d).join(lines, list(KEY)), F.when(F.col("guess") == "en", "ascii").otherwise("latin-1"), F.col("charset")), "guess")


@query(
    "language_descriptors",
    f"""WITH m AS (SELECT DISTINCT lang, {_REGION} AS region, CASE WHEN lang = 'en' THEN 'ascii' ELSE NULL END AS enc FROM documents WHERE lang IS NOT NULL),
n AS (SELECT lang, region, enc, lang || '_' || region || CASE WHEN enc IS NULL THEN '' ELSE '-' || enc END AS name FROM m)
SELECT a.name AS one, b.name AS two, a.lang = b.lang AND a.region = b.region AS same, a.lang = b.lang AS same_without_region, a.lang = 'en' AS matches FROM n a CROSS JOIN n b""",
)
def language_descriptors(spark: SparkSession, d: str) -> DataFrame:
    parts = S.descriptor_parts(F.col("lang"))
    names = _docs(spark, d, True).select(S.descriptor(parts["lang"], parts["region"], F.when(parts["lang"] == "en", "ascii")).alias("name")).distinct()
    one, two = F.col("one"), F.col("two")
    both = names.select(F.col("name").alias("one")).crossJoin(F.broadcast(names.select(F.col("name").alias("two"))))  # names of models, a handful
    return both.select("one", "two", S.same_language(one, two).alias("same"), S.same_language(one, two, False).alias("same_without_region"), S.same_language(one, F.lit("en_*")).alias("matches"))


_PART_V = "SELECT p_partkey, p_size::DOUBLE AS a, (p_size % 7)::DOUBLE AS b, (p_partkey % 11)::DOUBLE AS x FROM part"


@query(
    "score_vectors",
    f"""SELECT p_partkey, 2 * a + b AS added_a, b AS added_b, 3 * x AS added_x, round(sqrt(a), 8) AS root_a, a - x AS subtracted_a, CASE WHEN x >= 4 THEN a + x ELSE a END AS above_a,
greatest(a, b) AS highest, (a <> 0)::INT + (b <> 0)::INT AS nonzero, b + 1.5::DOUBLE AS incremented_b, round(0.25 * a + 0.75 * x / 2, 8) AS mixed_a FROM ({_PART_V})""",
)
def score_vectors(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    m = lambda *kv: F.create_map(*(x for k, v in kv for x in (F.lit(k), v.cast("double"))))
    rows = part.select("p_partkey", m(("a", F.col("p_size")), ("b", F.col("p_size") % 7)).alias("v"), m(("a", F.col("p_partkey") % 11), ("x", F.col("p_partkey") % 11)).alias("w"))
    v, w, at = F.col("v"), F.col("w"), F.element_at
    both = S.added(v, S.added(v, S.scale(F.map_filter(w, lambda k, _: k == "x"), 3.0)))
    return rows.select(
        "p_partkey", at(S.added(v, F.map_filter(v, lambda k, _: k == "a")), "a").alias("two_a"), at(both, "x").alias("added_x"), at(v, "b").alias("added_b"), at(S.root(v), "a").alias("r"), at(S.subtracted(v, w), "a").alias("subtracted_a"), at(v, "a").alias("a"),
        at(S.added_above(v, w, 4.0), "a").alias("above_a"), S.highest(v).alias("highest"), S.nonzero(v).alias("nonzero"), at(S.incremented(v, "b", 1.5), "b").alias("incremented_b"), F.round(at(S.combined(v, w, F.lit(0.25), F.lit(2.0)), "a"), 8).alias("mixed_a"),
    ).select("p_partkey", (F.col("two_a") + F.col("added_b")).alias("added_a"), "added_b", "added_x", F.round("r", 8).alias("root_a"), "subtracted_a", "above_a", "highest", "nonzero", "incremented_b", "mixed_a")


@query("score_lookup", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity::INT) / 2, 8) AS score FROM lineitem")
def score_lookup(spark: SparkSession, d: str) -> DataFrame:
    from math import log

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("cnt"))
    return S.mapped(rows, lambda n: log(1 + n) / 2).select("l_orderkey", "l_linenumber", F.round("score", 8).alias("score"))


@query("few_grams", "SELECT DISTINCT p_size, floor(3500 / floor(pow(1.5::DOUBLE, least(greatest(p_size, 3), 100) - 3)))::BIGINT AS least FROM part")
def few_grams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_size", S.too_few(3500, F.col("p_size")).cast("long").alias("least")).distinct()


_POSTINGS = "p AS (SELECT p_brand AS gram, p_type AS model, count(*) AS cnt FROM part GROUP BY ALL), q AS (SELECT p_brand AS gram, p_type AS model, sum(p_size)::BIGINT AS cnt FROM part WHERE p_size % 3 = 0 GROUP BY ALL)"


def _postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("gram"), F.col("p_type").alias("model"), "p_size")
    return rows.groupBy("gram", "model").agg(F.count(F.lit(1)).alias("cnt")), rows.filter("p_size % 3 = 0").groupBy("gram", "model").agg(F.sum("p_size").cast("long").alias("cnt"))


@query("postings_inserted", f"WITH {_POSTINGS} SELECT gram, model, coalesce(q.cnt, p.cnt) AS cnt FROM p FULL JOIN q USING (gram, model)")
def postings_inserted(spark: SparkSession, d: str) -> DataFrame:
    return S.inserted(*_postings(spark, d))


@query("postings_incremented", f"WITH {_POSTINGS} SELECT gram, model, coalesce(p.cnt, 0) + coalesce(q.cnt, 0) AS cnt, greatest(coalesce(p.cnt, 0), coalesce(q.cnt, 0)) AS most FROM p FULL JOIN q USING (gram, model)")
def postings_incremented(spark: SparkSession, d: str) -> DataFrame:
    p, q = _postings(spark, d)
    return S.incremented_postings(p, q).join(S.raised(p, q).withColumnRenamed("cnt", "most"), ["gram", "model"])


@query("postings_probability", f"WITH {_POSTINGS}, o AS (SELECT * FROM p WHERE model LIKE 'PROMO%' AND model = (SELECT min(model) FROM p WHERE model LIKE 'PROMO%')) SELECT gram, round(cnt / (SELECT sum(cnt) FROM o), 8) AS p FROM o")
def postings_probability(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _postings(spark, d)
    model = p.filter("model like 'PROMO%'").agg(F.min("model")).first()[0]
    return S.probability(p, model or "").withColumn("p", F.round("p", 8))


@query("postings_packed", f"WITH {_POSTINGS} SELECT gram, model, cnt, count(*) OVER (PARTITION BY gram) AS models FROM p")
def postings_packed(spark: SparkSession, d: str) -> DataFrame:
    rows = S.packed(_postings(spark, d)[0])
    return S.unpacked(rows).join(rows.select("gram", F.size("models").cast("long").alias("models")), "gram")


@query("accuracy_fuzzy", f"WITH {scores_sql(SMALL, K)}, {_TOP1} SELECT lang, sum(CASE WHEN lang IS NOT DISTINCT FROM guess OR (lang = 'fr' AND guess = 'es') THEN 0 ELSE 1 END)::BIGINT AS errors, count(*) AS total FROM lab GROUP BY lang")
def accuracy_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return S.fuzzy_errors(_best(spark, d, SMALL, K), alike={"fr": ("es",)})


_OCC = "FROM lines, (VALUES (3), (4)) v(n)),\nc AS"
_HELD_SCORES = scores_sql(SMALL, K).replace(_OCC, _OCC.replace("v(n)),", "v(n) WHERE doc_id % 5 <> 0),"))


@query("accuracy_held_out", f"WITH {_HELD_SCORES}, {_TOP1} SELECT l.lang, sum(CASE WHEN l.lang IS NOT DISTINCT FROM guess THEN 0 ELSE 1 END)::BIGINT AS errors, count(*) AS total FROM lab l WHERE doc_id % 5 = 0 GROUP BY l.lang")
def accuracy_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Errors on every fifth document under models of the others."""
    docs = _docs(spark, d)
    test = docs.filter("doc_id % 5 = 0")
    scores = G.identify(G.lines(test), G.train(docs.filter("doc_id % 5 <> 0"), SMALL, K), KEY, SMALL).withColumn("score", F.round("score", 9))
    labelled = G.lines(test).filter(F.trim("line") != "").join(G.cut_off(scores, top=1), list(KEY), "left")
    return G.accuracy(labelled).drop("rate")


@query("training_filters", f"WITH {counts_sql((3,)).replace('WHERE NOT regexp_matches', 'WHERE true OR NOT regexp_matches')} SELECT lang, count(*) AS grams, count(*) FILTER (NOT regexp_matches(gram, '^(  |[0-9][0-9])')) AS trained FROM c GROUP BY lang")
def training_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = G.lines(_docs(spark, d), keep=("lang",)).select("lang", G.tidy(F.col("line")).alias("line"))
    grams = G.explode_grams(rows, (3,)).select("lang", "gram").distinct()
    return grams.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.count_if(G.trainable(F.col("gram"))).alias("trained"))


@query("label_priors")
def label_priors(spark: SparkSession, d: str) -> DataFrame:
    """Best guess of each line with the prior of those before; blank lines are the gaps between strings."""
    docs = _docs(spark, d)
    gap = F.when(F.col("line_no") % 9 == 8, 40).otherwise(1)
    lines = G.lines(docs).filter("doc_id is not null").select(*KEY, F.octet_length("line").alias("size"), gap.alias("gap"), "line")
    mixed = S.priors(G.vectors(lines, G.train(docs, SMALL, K), KEY, SMALL))
    best = F.array_min(F.transform(F.map_entries("v"), lambda e: F.struct((-e["value"]).alias("low"), e["key"].alias("guess"))))
    return mixed.select("doc_id", "line_no", best.alias("b")).select("doc_id", "line_no", "b.guess", F.round(-F.col("b.low"), 6).alias("score"))
