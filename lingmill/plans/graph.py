"""Queries: inheritance of frames, their index, and word n-grams as an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import retrieval as W
from ..operators import trigrams
from ..operators.sizes import spread
from ..session import table
from .registry import query
from .retrieval import _W, _grams

_F = """i AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
p AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier),
f AS (SELECT 'n' || n_nationkey AS frame, 'tongue' AS slot, 'VALUE' AS facet, 0 AS pos, n_name AS filler FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, 'tongue', 'VALUE', 0, r_name FROM region
  UNION ALL SELECT 'r' || r_regionkey, 'tongue', 'NOTE', 0, 'of ' || r_name FROM region UNION ALL SELECT 'c' || c_custkey, 'name', 'VALUE', 0, c_name FROM customer)"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c, n, r, s = (table(spark, d, t) for t in ("customer", "nation", "region", "supplier"))
    is_a = c.select(named("c", "c_custkey").alias("src"), named("n", "c_nationkey").alias("dst")).unionByName(n.select(named("n", "n_nationkey").alias("src"), named("r", "n_regionkey").alias("dst")))
    part = s.select(named("s", "s_suppkey").alias("src"), named("n", "s_nationkey").alias("dst"))
    row = lambda df, frame, slot, facet, filler: df.select(frame.alias("frame"), F.lit(slot).alias("slot"), F.lit(facet).alias("facet"), F.lit(0).alias("pos"), filler.alias("filler"))
    frames = row(n.filter("n_nationkey % 2 = 0"), named("n", "n_nationkey"), "tongue", "VALUE", F.col("n_name"))
    frames = frames.unionByName(row(r, named("r", "r_regionkey"), "tongue", "VALUE", F.col("r_name"))).unionByName(row(r, named("r", "r_regionkey"), "tongue", "NOTE", F.concat(F.lit("of "), "r_name")))
    return frames.unionByName(row(c, named("c", "c_custkey"), "name", "VALUE", F.col("c_name"))), is_a, part


_UP = "RECURSIVE up(src, dst, depth) AS (SELECT src, dst, 1 FROM {e} UNION SELECT up.src, e.dst, depth + 1 FROM up JOIN {e} e ON up.dst = e.src)"


def _mode_sql(mode: str) -> str:
    edges = "p" if mode.startswith("part") else "i"
    up = "u AS (SELECT src, dst, 1 AS depth FROM i)" if mode == "simple" else f"u AS (SELECT src, dst, min(depth) AS depth FROM (SELECT src, dst, 1 AS depth FROM {edges} UNION ALL SELECT a.src, b.dst, 2 FROM {edges} a JOIN {edges} b ON a.dst = b.src UNION ALL SELECT a.src, c.dst, 3 FROM {edges} a JOIN {edges} b ON a.dst = b.src JOIN {edges} c ON b.dst = c.src) GROUP BY ALL)"
    some = "WHERE facet = 'VALUE'" if mode.startswith("local") else ""
    return f"""SELECT '{mode}' AS mode, frame, slot, facet, filler, depth FROM (WITH {_F}, {up}, e AS (SELECT *, 0 AS depth FROM f UNION ALL SELECT src, slot, facet, pos, filler, depth FROM u JOIN (SELECT * FROM f {some}) f ON frame = dst)
SELECT *, min(depth) OVER (PARTITION BY frame, slot, facet) AS near FROM e) WHERE depth = near"""


_INHERITING = [m for m in R.MODES if m != "none"]


@query("frame_inheritance_modes", f"WITH {_F} SELECT 'none' AS mode, frame, slot, facet, filler, 0 AS depth FROM f UNION ALL " + " UNION ALL ".join(_mode_sql(m) for m in _INHERITING))
def frame_inheritance_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every way to inherit; on a tree the first path is the nearest."""
    tables, known, out = _tables(spark, d), {}, None
    for mode in R.MODES:
        one = R.inherited_by(*tables, mode, known).select(F.lit(mode).alias("mode"), "frame", "slot", "facet", "filler", "depth")
        out = one if out is None else out.unionByName(one)
    return out


@query("frame_slots_collected", f"WITH {_F}, u AS (SELECT src, dst FROM i UNION SELECT a.src, b.dst FROM i a JOIN i b ON a.dst = b.src) SELECT frame, list_sort(list_distinct(list(slot))) AS slots FROM (SELECT frame, slot FROM f UNION ALL SELECT src, slot FROM u JOIN f ON frame = dst) GROUP BY frame")
def frame_slots_collected(spark: SparkSession, d: str) -> DataFrame:
    frames, is_a, _ = _tables(spark, d)
    return R.collected_slots(frames, R.ancestors(is_a))


@query("frame_sets_fetched", f"WITH {_F}, u AS (SELECT src, dst FROM i UNION SELECT a.src, b.dst FROM i a JOIN i b ON a.dst = b.src) SELECT frame, slot, facet, filler FROM f WHERE frame = 'r1' OR frame IN (SELECT src FROM u WHERE dst = 'r1')")
def frame_sets_fetched(spark: SparkSession, d: str) -> DataFrame:
    frames, is_a, _ = _tables(spark, d)
    return R.with_subclasses(frames, R.ancestors(is_a), spark.createDataFrame([("r1",)], "frame string")).select("frame", "slot", "facet", "filler")


@query(
    "frame_edits",
    f"""WITH {_F}, e AS (SELECT frame, slot, facet, 0 AS pos, CASE WHEN filler = 'ASIA' THEN 'Asia' ELSE filler END AS filler FROM f WHERE slot = 'tongue')
SELECT frame, slot, facet, pos, filler FROM e WHERE NOT (frame = 'r0' AND facet = 'NOTE') UNION ALL SELECT 'r1', 'tongue', 'VALUE', 1, 'more'""",
)
def frame_edits(spark: SparkSession, d: str) -> DataFrame:
    """Fillers pushed, popped, replaced and erased."""
    frames = _tables(spark, d)[0].filter("slot = 'tongue'")
    row = lambda *r: spark.createDataFrame([r], "frame string, slot string, facet string, pos int, filler string")
    out = R.push(frames, row("r1", "tongue", "VALUE", 0, "more"))
    out = R.replaced(out, spark.createDataFrame([("r2", "tongue", "VALUE", "ASIA", "Asia")], "frame string, slot string, facet string, old string, new string"))
    out = R.popped(R.push(out, out.select("frame", "slot", "facet", F.lit(0).alias("pos"), F.lit("to be popped").alias("filler"))))
    return R.erase(out, spark.createDataFrame([("r0", "NOTE")], "frame string, facet string")).select("frame", "slot", "facet", "pos", "filler")


@query("index_by_filler", f"WITH {_F} SELECT DISTINCT filler AS term, frame FROM f WHERE length(filler) <= 19")
def index_by_filler(spark: SparkSession, d: str) -> DataFrame:
    return W.filler_postings(_tables(spark, d)[0])


@query("index_by_word", f"WITH {_F} SELECT DISTINCT term, frame FROM (SELECT unnest(string_split_regex(filler, '[ ,.?]+')) AS term, frame FROM f) WHERE term NOT IN ('', 'of')")
def index_by_word(spark: SparkSession, d: str) -> DataFrame:
    return W.word_postings(_tables(spark, d)[0], ("of",))


@query("index_updated", f"WITH {_W}, n AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'n' || length(term) ELSE term END AS term FROM w WHERE doc_id % 10 <> 4) SELECT term, count(*) AS docs FROM n GROUP BY term")
def index_updated(spark: SparkSession, d: str) -> DataFrame:
    """An index after every tenth document changed (to its words' lengths) and another tenth was deleted."""
    words = W.terms(_docs(spark, d)).select("term", "doc_id").distinct()
    changed = words.filter("doc_id % 10 = 3").select(F.concat(F.lit("n"), F.char_length("term").cast("string")).alias("term"), "doc_id").distinct()
    return W.updated(words, changed, words.filter("doc_id % 10 = 4").select("doc_id").distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return W.terms(_docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("lm_looked_up", f"WITH {_W} SELECT way, a.doc_id, a.pos AS first, b.pos AS last FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1, (VALUES ('forwards'), ('backwards')) v(way) WHERE a.term = 'of' AND b.term = 'the'")
def lm_looked_up(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    one, two = (W.looked_up(p, ("of", "the"), back).select(F.lit(way).alias("way"), "doc_id", "first", "last") for back, way in ((False, "forwards"), (True, "backwards")))
    return one.unionByName(two)


@query("lm_extended", f"WITH {_W} SELECT DISTINCT a.doc_id, b.pos AS first, c.pos AS last FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos - 1 AND b.term IN ('in', 'on', 'of') JOIN w c ON a.doc_id = c.doc_id AND c.pos BETWEEN a.pos + 1 AND a.pos + 3 AND c.term IN ('and', 'is') WHERE a.term = 'the' AND b.pos >= 10 AND c.pos < 60")
def lm_extended(spark: SparkSession, d: str) -> DataFrame:
    """Matches of a word extended to the left by a list, to the right over a gap, and held to a range."""
    p = _positions(spark, d)
    out = W.extended(W.extended(W.looked_up(p, ("the",)), p, ("in", "on", "of"), left=True), p, ("and", "is"), gap=2)
    return W.restricted(out, p.select("doc_id", F.lit(10).cast("long").alias("lo"), F.lit(60).cast("long").alias("hi")).distinct())


@query("lm_class_sizes", f"WITH {_W} SELECT length(term) AS class, count(DISTINCT term) AS kinds, count(*) AS occurrences FROM w GROUP BY 1")
def lm_class_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    return W.class_sizes(p, p.select("term").distinct().withColumn("class", F.char_length("term").cast("long")))


@query("lm_merged", f"WITH {_W}, {_grams(2)} SELECT gram, freq FROM c2")
def lm_merged(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two halves of the documents merged into one table."""
    docs = _docs(spark, d)
    halves = [docs.filter(F.coalesce(F.col("doc_id") % 2, F.lit(0)) == k) for k in (0, 1)]
    return W.merged_counts(*(W.ngram_counts(h, 2, 1) for h in halves))


@query("lm_records", f"WITH {_W} SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS next_term FROM w")
def lm_records(spark: SparkSession, d: str) -> DataFrame:
    """Every position's record and the word that follows it there."""
    return W.records(_docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(
    "lm_estimated",
    f"""WITH {_W}, {_grams(1)}, {_grams(2)}, {_grams(3)}, q AS (SELECT DISTINCT gram FROM c3), k3 AS (SELECT * FROM c3 WHERE freq >= 3), k2 AS (SELECT * FROM c2 WHERE freq >= 2)
SELECT q.gram, coalesce(k3.freq, 0.5::DOUBLE * k2.freq, 0.25::DOUBLE * c1.freq, 0)::DOUBLE AS estimate FROM q LEFT JOIN k3 ON q.gram = k3.gram LEFT JOIN k2 ON array_to_string(string_split(q.gram, ' ')[2:], ' ') = k2.gram LEFT JOIN c1 ON string_split(q.gram, ' ')[3] = c1.gram""",
)
def lm_estimated(spark: SparkSession, d: str) -> DataFrame:
    return trigrams.estimates(_docs(spark, d), (3, 2, 1))
