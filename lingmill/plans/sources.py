"""Queries: sources and sinks, each writing what a table holds and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ngrams as G
from ..operators import strings as S
from ..operators.sizes import spread
from ..session import table
from ..sources import files as R
from ..sources import stores as B
from ..stages import scratch
from .ngrams import K, SMALL, counts_sql, model_sql
from .registry import query
from .text import _L


def _written(lines: DataFrame, name: str, **options: str) -> str:
    """The path of a text table of one column."""
    path = scratch(lines.sparkSession, name)
    lines.write.options(**{"lineSep": "\n"} | options).text(path)
    return path


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return G.lines(_docs(spark, d), keep=("doc_id",))


@query("source_binary", "SELECT p_brand || '.txt' AS name, octet_length(encode(string_agg(p_name, ' ' ORDER BY p_partkey))) + 1 AS bytes FROM part GROUP BY p_brand")
def source_binary(spark: SparkSession, d: str) -> DataFrame:
    """A file for each brand, read as whole binary files."""
    part = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda p: p["p_name"]), " ").alias("value"))
    path = scratch(spark, "brands")
    part.repartition("p_brand").write.partitionBy("p_brand").option("lineSep", "\n").text(path)
    found = R.binary(spark, f"{path}/*/*.txt")
    brand = F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)", 1))
    return found.groupBy(F.concat(brand, F.lit(".txt")).alias("name")).agg(F.sum("length").cast("long").alias("bytes"))


@query("source_byte_range", "SELECT doc_id, md5(substr(hex(encode(text)), 21, 2 * (least(octet_length(encode(text)), 500) - 10))) AS part FROM documents WHERE octet_length(encode(text)) > 10")
def source_byte_range(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).filter(F.octet_length("text") > 10)
    return docs.select("doc_id", F.md5(F.hex(S.byte_range(F.col("text").cast("binary"), 10, 500)).cast("binary")).alias("part"))


@query("source_text_lines", f"WITH {_L} SELECT md5(line) AS line_md5, count(*) AS n FROM l GROUP BY 1")
def source_text_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_lines(spark, d).select(F.col("line").alias("value")), "lines")
    return R.text_lines(spark, path, delimiter="\n").groupBy(F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("source_tidy_lines", f"WITH {_L} SELECT md5(trim(line, ' ')) AS line_md5, count(*) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY 1")
def source_tidy_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_lines(spark, d).select(F.concat(F.lit("  "), "line", F.lit(" ")).alias("value")), "tidy")
    return R.tidy_lines(spark, path).groupBy(F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("source_compressed", f"WITH {_L} SELECT kind, md5(line) AS line_md5, count(*) AS n FROM l, (VALUES ('gz'), ('bz2')) k(kind) GROUP BY ALL")
def source_compressed(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for kind, codec in (("gz", "gzip"), ("bz2", "bzip2")):
        path = _written(_lines(spark, d).select(F.col("line").alias("value")), kind, compression=codec)
        out.append(B.compressed_lines(spark, f"{path}/*.{kind}").select(F.lit(kind).alias("kind"), F.md5(F.col("line").cast("binary")).alias("line_md5")))
    return out[0].unionByName(out[1]).groupBy("kind", "line_md5").agg(F.count(F.lit(1)).alias("n"))


@query("source_word_list", "SELECT p_name AS word, p_size::BIGINT AS freq FROM part WHERE p_size % 5 <> 0")
def source_word_list(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).cast("string"), "p_name")
    rows = table(spark, d, "part").select(line.alias("value"))
    return R.word_list(spark, _written(rows.unionByName(spark.createDataFrame([("; a note",), ("# another",), ("",)], "value string")), "words")).select("word", "freq")


@query("source_word_lists", "SELECT p_type AS lang, p_name AS word, p_size::BIGINT AS freq FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY 1 LIMIT 2)")
def source_word_lists(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    langs = [r.p_type for r in part.select("p_type").distinct().orderBy("p_type").limit(2).collect()]
    paths = {m: _written(part.filter(F.col("p_type") == m).select(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name").alias("value")), "words") for m in langs}
    return B.word_lists(spark, paths).select("lang", "word", "freq")


@query("source_abbreviations", "SELECT DISTINCT upper(r_name[:3]) AS word FROM region")
def source_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").select(F.concat(F.upper(F.substring("r_name", 1, 3)), F.lit(".")).alias("value"))
    return B.abbreviations(spark, _written(rows.unionByName(rows), "abbreviations"))


@query("source_cognate_letters", "WITH n AS (SELECT n_name AS a, translate(lower(n_name), 'kt', 'cd') AS x FROM nation) SELECT p.a AS one, q.a AS two, round(1 - levenshtein(p.x, q.x) / greatest(length(p.x), length(q.x))::DOUBLE, 6) AS score FROM n p JOIN n q ON p.a < q.a")
def source_cognate_letters(spark: SparkSession, d: str) -> DataFrame:
    """Cognate scores under classes of letters that a file lists."""
    classes = B.cognate_classes(spark, _written(spark.createDataFrame([("; alike",), ("c k",), ("dt",)], "value string"), "cognates"))
    n = table(spark, d, "nation")
    both = n.select(F.col("n_name").alias("one")).join(F.broadcast(n.select(F.col("n_name").alias("two"))), F.col("one") < F.col("two"))  # 25 rows by definition
    return both.select("one", "two", F.round(T.cognate_score(F.col("one"), F.col("two"), classes), 6).alias("score"))


@query("source_models", f"WITH {model_sql((3,), K)} SELECT lang, gram, cnt, false AS is_stop FROM model")
def source_models(spark: SparkSession, d: str) -> DataFrame:
    """Models written as model texts, a folder for each language, and read again."""
    model = G.train(_docs(spark, d), (3,), K).withColumn("is_stop", F.lit(False))
    rows = R.model_lines(model.select("cnt", "gram", "is_stop", "lang"), keep=("lang",))
    head = model.groupBy("lang").agg(F.concat(F.lit("TotalCount: "), F.sum("cnt").cast("string")).alias("value"))
    path = scratch(spark, "models")
    rows.unionByName(head.select("lang", "value")).write.partitionBy("lang").option("lineSep", "\n").text(path)
    _, grams = R.model_texts(spark, f"{path}/*/*.txt")
    return grams.select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), "gram", "cnt", "is_stop")


@query("source_trigram_lists", f"WITH {counts_sql((3,))} SELECT gram, sum(cnt)::BIGINT AS cnt FROM c WHERE NOT contains(gram, '<') AND NOT contains(gram, '>') GROUP BY gram")
def source_trigram_lists(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.when(F.col("gram").startswith(" "), "<").otherwise(F.substring("gram", 1, 1)), F.substring("gram", 2, 1), F.when(F.col("gram").endswith(" "), ">").otherwise(F.substring("gram", 3, 1)))
    rows = G.counts(_docs(spark, d)).groupBy("gram").agg(F.sum("cnt").alias("cnt")).filter(~F.col("gram").rlike("[<>]"))
    path = _written(rows.select(F.concat_ws(" ", F.col("cnt").cast("string"), marked).alias("value")), "trigrams")
    return R.trigram_lists(spark, path).groupBy("gram").agg(F.sum("cnt").alias("cnt"))


@query("source_model_store", f"WITH {model_sql(SMALL, K)} SELECT lang, n, gram, cnt, round(weight, 6) AS weight FROM model")
def source_model_store(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "store")
    B.save_models(G.train(_docs(spark, d), SMALL, K), path)
    return B.load_models(spark, f"{path}-elsewhere", path).withColumn("weight", F.round("weight", 6))


@query("source_dense_counts", f"WITH {counts_sql((3,))} SELECT lang, gram, cnt FROM c WHERE lang IS NOT NULL")
def source_dense_counts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "counts")
    B.save_counts(G.counts(_docs(spark, d)).select("lang", "gram", "cnt").filter("lang is not null"), path)
    return B.load_counts(spark, path)


@query("source_weights", "SELECT p_type AS term, count(*) AS tf, count(DISTINCT p_brand) AS df FROM (SELECT replace(p_type, ' ', '_') AS p_type, p_brand FROM part) GROUP BY 1")
def source_weights(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").groupBy(F.replace("p_type", F.lit(" "), F.lit("_")).alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("p_brand").alias("df"))
    return R.weights(spark, _written(R.weight_lines(f, 25), "weights"))


@query("source_thresholds", "SELECT p_size AS from_idx, round(max(p_partkey % 100) / 100::DOUBLE, 2) AS threshold FROM part GROUP BY p_size")
def source_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").groupBy("p_size").agg(F.round(F.max(F.col("p_partkey") % 100) / 100, 2).alias("t"))
    rows = t.select(F.format_string("(%d %.2f)", F.col("p_size").cast("int"), F.col("t")).alias("value"))
    return R.thresholds(spark, _written(rows, "thresholds")).withColumn("from_idx", F.col("from_idx").cast("int"))


@query(
    "source_ranges",
    "SELECT doc_id, len(list_filter(string_split(text, ''), lambda c: unicode(c) BETWEEN 97 AND 122 OR unicode(c) BETWEEN 192 AND 591 OR unicode(c) = 32)) AS desired FROM documents WHERE text IS NOT NULL",
)
def source_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a range list that is read from a file."""
    spec = B.desired_characters(spark, _written(spark.createDataFrame([("97-122,0xC0-0x24F,32",)], "value string"), "desired"))
    inside = R.range_class(spec)
    return _docs(spark, d).filter("text is not null").select("doc_id", F.regexp_count("text", F.lit(inside)).cast("long").alias("desired"))


@query("source_pages", "SELECT doc_id, b AS page_start, md5(substr(hex(encode(text)), 2 * b + 1, 2 * 1100)) AS bytes FROM (SELECT doc_id, text, unnest(range(0, greatest(octet_length(encode(text)), 1), 1000)) AS b FROM documents WHERE octet_length(encode(text)) > 0)")
def source_pages(spark: SparkSession, d: str) -> DataFrame:
    files = _docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("content"))
    return B.paged(files, 1000, 100, key="doc_id").select("doc_id", F.col("page_start").cast("long").alias("page_start"), F.md5(F.hex("bytes").cast("binary")).alias("bytes"))


@query(
    "source_file_types",
    """SELECT doc_id, 'utf-8' AS marked, 'utf-16-be' AS wide_be, 'utf-16-le' AS wide_le, CASE WHEN text = '' THEN 'empty' WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0E\\x0F\\x10-\\x1F]') THEN 'other' WHEN octet_length(encode(text)) = length(text) THEN 'ascii' ELSE 'utf-8' END AS plain, true AS restored
FROM documents WHERE text IS NOT NULL""",
)
def source_file_types(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    docs = _docs(spark, d).filter("text is not null").select("doc_id", "text", *(B.encoded(lines, e, True, c).alias(n) for n, e, c in (("a", "utf-8", False), ("b", "utf-16-be", True), ("c", "utf-16-le", False))), F.col("text").cast("binary").alias("p"))
    kind = {n: B.file_type(F.col(n)) for n in "abcp"}
    end = lambda e: F.concat(F.array_join(lines, e), F.lit(e))
    same = (B.decoded(F.col("a"), kind["a"]) == end("\n")) & (B.decoded(F.col("b"), kind["b"]) == end("\r\n")) & (B.decoded(F.col("c"), kind["c"]) == end("\n"))
    odd = F.col("text").rlike("[\\x00-\\x08\\x0B\\x0E\\x0F\\x10-\\x1F]")
    return docs.select("doc_id", kind["a"].alias("marked"), kind["b"].alias("wide_be"), kind["c"].alias("wide_le"), F.when(odd, "other").otherwise(kind["p"]).alias("plain"), same.alias("restored"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("frame"), F.lit("name").alias("slot"), F.lit("VALUE").alias("facet"), F.lit(0).alias("pos"), F.col("n_name").alias("filler")).unionByName(
        n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("frame"), F.lit("region").alias("slot"), F.lit("VALUE").alias("facet"), F.lit(0).alias("pos"), F.concat(F.lit("a \"region\" "), F.col("n_regionkey").cast("string")).alias("filler"))
    )


_F = """f AS (SELECT 'n' || n_nationkey AS frame, 'name' AS slot, 'VALUE' AS facet, 0 AS pos, n_name AS filler FROM nation UNION ALL SELECT 'n' || n_nationkey, 'region', 'VALUE', 0, 'a "region" ' || n_regionkey FROM nation)"""


@query(
    "frame_store",
    f"""WITH {_F}, g1 AS (SELECT * FROM f WHERE frame <> 'n3'), g2 AS (SELECT CASE WHEN frame = 'n1' THEN 'first' ELSE frame END AS frame, slot, facet, pos, filler FROM g1),
g3 AS (SELECT * FROM g2 UNION ALL SELECT 'twin', slot, facet, pos, filler FROM g2 WHERE frame = 'n2')
SELECT 0 AS generation, frame, slot, filler FROM f UNION ALL SELECT 1, frame, slot, filler FROM g1 UNION ALL SELECT 2, frame, slot, filler FROM g2 UNION ALL SELECT 3, frame, slot, filler FROM g3 UNION ALL SELECT 4, frame, slot, filler FROM g1""",
)
def frame_store(spark: SparkSession, d: str) -> DataFrame:
    """Every generation of a store: committed, with one deleted, one renamed, one copied, and reverted."""
    store = B.FrameStore(spark, scratch(spark, "frames"))
    store.commit(_frames(spark, d))
    store.delete("n3")
    store.rename("n1", "first")
    store.copy("n2", "twin")
    store.revert(1)
    out = None
    for g in store.generations():
        one = store.read(g).select(F.lit(g).alias("generation"), "frame", "slot", "filler")
        out = one if out is None else out.unionByName(one)
    return out


@query("frame_lines", f"WITH {_F} SELECT frame, slot, facet, pos, filler FROM f")
def frame_lines(spark: SparkSession, d: str) -> DataFrame:
    """Frames exported in list syntax, as a text table, and imported again."""
    path = _written(B.frame_lines(_frames(spark, d)).select("value"), "framekit")
    return B.frames_of_lines(R.text_lines(spark, path, delimiter="\n"), "line")


@query("list_forms", """SELECT p_partkey, '["part", {"text": "' || p_name || '"}, ' || p_size || ', [1, "x"]]' AS form FROM part""")
def list_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('(part "'), "p_name", F.lit('" '), F.col("p_size").cast("string"), F.lit(" (1 x))"))
    return B.forms_to_json(table(spark, d, "part").select("p_partkey", text.alias("t")), "t", "p_partkey")


@query("sink_histograms", f"WITH {_L} SELECT CASE WHEN octet_length(encode(line)) = length(line) THEN 'ascii' ELSE 'utf-8' END AS encoding, least(length(line) // 20, 10) AS bin, count(*) AS n FROM l GROUP BY ALL")
def sink_histograms(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select(F.when(F.octet_length("line") == F.char_length("line"), "ascii").otherwise("utf-8").alias("encoding"), F.least(F.expr("char_length(line) div 20"), F.lit(10)).alias("bin"))
    return rows.groupBy("encoding", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("sink_feature_rows", f"""WITH {_L} SELECT doc_id, line_no, doc_id || '.' || line_no || chr(9) || 'xx' || CASE WHEN length(line) % 3 = 0 THEN '?' ELSE '' END || chr(9) || replace(replace(replace(line, '\\', '\\x5C'), ',', '\\x2C'), chr(0), '\\x00') AS feature FROM l""")
def sink_feature_rows(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.char_length("line") % 3 == 0, 1.0).otherwise(2.0)
    return _lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), S.feature_row(F.col("doc_id").cast("string"), F.col("line_no"), F.lit("xx"), score, F.col("line")).alias("feature"))


@query("sink_string_files", f"WITH {_L} SELECT 'd' || doc_id % 10 AS path, md5(line) AS line_md5, count(*) AS n FROM l GROUP BY ALL")
def sink_string_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder of strings for each input, read again with its name."""
    path = scratch(spark, "strings")
    R.write_strings(_lines(spark, d).select(F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string")).alias("path"), F.col("line").alias("value")), path, "gzip")
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.groupBy("path", F.md5(F.col("value").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))
