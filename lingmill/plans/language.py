"""Queries: words, code points, charsets, links, entities, cognates and small records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import records as R
from ..functions import text as T
from ..operators import strings as S
from ..operators.ngrams import lines
from ..operators.sizes import spread
from ..session import table
from ..sources import files as L
from .registry import query
from .text import _L


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).filter("text is not null")


def _digest(c) -> F.Column:
    return F.md5(c.cast("binary"))


@query("code_points", "SELECT doc_id, list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))::BIGINT AS total, len(string_split(text, ''))::BIGINT AS n FROM documents WHERE text <> ''")
def code_points(spark: SparkSession, d: str) -> DataFrame:
    points = T.code_points(F.col("text"))
    return _docs(spark, d).filter("text <> ''").select("doc_id", F.aggregate(points, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(points).cast("long").alias("n"))


@query("utf16_units", "SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units FROM documents WHERE text IS NOT NULL")
def utf16_units(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.utf16_units(F.col("text")).cast("long").alias("units"))


@query("charset_converted", "SELECT doc_id, md5(list_aggregate(list_transform(string_split(text, ''), lambda c: printf('%04X', unicode(c))), 'string_agg', '')) AS wide, true AS restored FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')")
def charset_converted(spark: SparkSession, d: str) -> DataFrame:
    wide = T.converted(F.col("text").cast("binary"), "UTF-8", "UTF-16BE")
    rows = _docs(spark, d).filter("text <> ''").filter(~F.col("text").rlike("[\\x{10000}-\\x{10FFFF}]"))
    return rows.select("doc_id", _digest(F.hex(wide)).alias("wide"), (T.converted(wide, "UTF-16BE", "UTF-8").cast("string") == F.col("text")).alias("restored"))


@query("text_cut_at", "SELECT doc_id, md5(split_part(text, '.', 1)) AS head FROM documents WHERE text IS NOT NULL")
def text_cut_at(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(T.up_to(F.col("text"), ".")).alias("head"))


@query("text_numbers", "SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS number, ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT % 1000 AS random FROM documents WHERE text IS NOT NULL")
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.string_number(F.col("text")).alias("number"), T.random_number(F.col("doc_id"), 1000, 7).alias("random"))


@query("text_symbols", "SELECT doc_id, md5(upper(replace(array_to_string(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> ''), '|'), 'ß', 's'))) AS symbols FROM documents WHERE text IS NOT NULL")
def text_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(F.array_join(T.symbols(F.replace("text", F.lit("ß"), F.lit("s"))), "|")).alias("symbols"))


@query("text_token_lists", r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*(?:[eE][+-]?[0-9]+)?|[\p{L}\p{M}]+(?:[-''][\p{L}\p{M}]+)*|[^\s\p{L}\p{M}0-9]'), ' ')) AS tokens FROM documents WHERE text IS NOT NULL")
def text_token_lists(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(F.array_join(T.tokens(F.col("text")), " ")).alias("tokens"))


@query("text_rejoined", r"""WITH t AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*(?:[eE][+-]?[0-9]+)?|[\p{L}\p{M}]+(?:[-''][\p{L}\p{M}]+)*|[^\s\p{L}\p{M}0-9]'), ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, ' ([.,;:!?)\]}])', '\1', 'g'), '([(\[{]) ', '\1', 'g')) AS text_md5 FROM t""")
def text_rejoined(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(T.decanonical(F.array_join(T.tokens(F.col("text")), " "))).alias("text_md5"))


@query("text_without_repeats", "SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL")
def text_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Texts behind 40 pairs of one kind, which a scan leaves out."""
    clean = S.skip_repeats(F.concat(F.repeat(F.lit("\x01\x02"), F.lit(40)), F.col("text")))
    plain = S.skip_repeats(F.col("text"))
    same = F.when(plain == F.col("text"), clean).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", F.char_length(same).cast("long").alias("chars"), F.octet_length(same).cast("long").alias("bytes"))


@query("abbreviations_known", "WITH w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS word FROM documents) SELECT word, regexp_replace(word, '\\.$', '') IN ('Mr', 'Mrs', 'Dr', 'Prof', 'St', 'vs', 'etc', 'Inc', 'Ltd', 'Jr', 'Sr', 'The', 'Es') AS known FROM w")
def abbreviations_known(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.known_abbreviation(F.col("word"), (*T.ABBREVIATIONS, "The", "Es")).alias("known"))


@query("named_entities", "SELECT p_partkey, ['BRAND', 'PART'] AS kinds, [p_brand, p_name] AS surfaces, [NULL, 'part ' || p_partkey] AS names, 'the ' || p_brand || ' sells ' || p_name || '.' AS plain FROM part")
def named_entities(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("the [[BRAND:"), "p_brand", F.lit("]] sells [[PART:"), "p_name", F.lit("|part "), F.col("p_partkey").cast("string"), F.lit("]]."))
    e = T.named_entities(F.col("t"))
    return table(spark, d, "part").select("p_partkey", marked.alias("t")).select("p_partkey", e["kind"].alias("kinds"), e["surface"].alias("surfaces"), e["name"].alias("names"), T.strip_entities(F.col("t")).alias("plain"))


@query("cognate_scores", "WITH n AS (SELECT n_name AS a, translate(lower(n_name), 'kstvyjw', 'ccdfigu') AS x FROM nation) SELECT p.a AS one, q.a AS two, round(1 - levenshtein(p.x, q.x) / greatest(length(p.x), length(q.x))::DOUBLE, 6) AS score FROM n p JOIN n q ON p.a < q.a")
def cognate_scores(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    both = n.select(F.col("n_name").alias("one")).join(F.broadcast(n.select(F.col("n_name").alias("two"))), F.col("one") < F.col("two"))  # 25 rows by definition
    return both.select("one", "two", F.round(T.cognate_score(F.col("one"), F.col("two")), 6).alias("score"))


@query("html_tag_attributes", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z-]+\s*=\s*"[^"]*")*\s*/?>')) AS tag FROM pages)
SELECT upper(regexp_extract(tag, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS name, list_transform(regexp_extract_all(tag, '[A-Za-z-]+\s*=\s*"[^"]*"'), lambda x: upper(regexp_extract(x, '^([A-Za-z-]+)', 1)) || '=' || regexp_extract(x, '"([^"]*)"', 1)) AS attributes, count(*) AS n FROM t GROUP BY ALL""")
def html_tag_attributes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.explode(T.tag_attributes(F.col("html"))).alias("t")).groupBy("t.name", "t.attributes").agg(F.count(F.lit(1)).alias("n"))


@query("html_absolute_links", r"""WITH h AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<[aA]\s[^>]*?[hH][rR][eE][fF]="([^"]*)"', 1))) AS link FROM pages)
SELECT page_id, list_sort(list_distinct(list(CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link
  WHEN starts_with(link, '#') THEN regexp_extract(url, '^[^#]*') || link ELSE regexp_extract(regexp_extract(url, '^[^?#]*'), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)[^/]*$', 1) || link END))) AS links FROM h GROUP BY page_id""")
def html_absolute_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.sort_array(T.absolute_links(F.col("html"), F.col("url"))).alias("links"))
    return rows.filter(F.size("links") > 0)


@query("html_plain_links", r"""WITH l AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all('see ' || url || ' and ' || url || ', or http://x.example/a', '(?:https?|ftp)://[^\s<>")]+'))) AS links FROM pages) SELECT page_id, links FROM l""")
def html_plain_links(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit(", or http://x.example/a"))
    return table(spark, d, "pages").filter("url is not null").select("page_id", F.sort_array(T.plain_links(text)).alias("links"))


@query("map_records", "SELECT p_partkey, p_size * 2 AS size, p_brand AS brand, ['brand', 'extra', 'size'] AS names, 1 AS extra FROM part")
def map_records(spark: SparkSession, d: str) -> DataFrame:
    """A record as a map: put, replaced, removed, its names and a lookup."""
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("gone"), F.lit("x"))
    m = R.removed(R.put(R.put(m, "size", (F.col("p_size") * 2).cast("string")), "extra", F.lit("1")), "gone")
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.element_at("m", "size").cast("long").alias("size"), F.element_at("m", "brand").alias("brand"), F.sort_array(F.map_keys("m")).alias("names"), F.element_at("m", "extra").cast("int").alias("extra"))


@query("queue_ends", "SELECT p_brand, list_distinct(list(p_size ORDER BY p_partkey))[1] IS NOT NULL AS some, len(list_distinct(list(p_size))) AS kinds, len(list(p_size)) + 2 AS pushed, min_by(p_size, p_partkey) AS head FROM part GROUP BY p_brand")
def queue_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: x["p_size"]).alias("q"))
    fresh = F.aggregate("q", F.slice("q", 1, 0), lambda a, x: A.push_if_new(a, x))
    pushed = F.array_append(F.array_prepend(F.col("q"), F.lit(0).cast("int")), F.lit(0).cast("int"))
    return rows.select("p_brand", (F.size(fresh) > 0).alias("some"), F.size(fresh).cast("long").alias("kinds"), F.size(pushed).cast("long").alias("pushed"), F.get(F.slice(pushed, 2, F.size("q")), F.lit(0)).alias("head"))


@query("byte_sets", "SELECT doc_id, regexp_matches(text, '^[A-Z][a-z]') AS opens, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits FROM documents WHERE text IS NOT NULL")
def byte_sets(spark: SparkSession, d: str) -> DataFrame:
    upper, lower, digit = R.byte_set((65, 90)), R.byte_set((97, 122)), R.byte_set((48, 57))
    opens = R.pattern_of([upper, lower]).rstrip("$")
    inside = R.pattern_of([digit])[1:-1]
    return _docs(spark, d).select("doc_id", F.col("text").rlike(opens).alias("opens"), F.regexp_count("text", F.lit(inside)).cast("long").alias("digits"))


@query("weight_specs", "SELECT p_partkey, p_size / 100::DOUBLE AS b, 1.5::DOUBLE AS s FROM part")
def weight_specs(spark: SparkSession, d: str) -> DataFrame:
    spec = F.format_string("b%.2f,,s1.5,?,x2", F.col("p_size") / 100)
    m = L.weight_specs(spec)
    return table(spark, d, "part").select("p_partkey", F.element_at(m, "b").alias("b"), F.element_at(m, "s").alias("s"))


@query("file_test_prep", f"WITH {_L}, k AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM l WHERE octet_length(encode(line)) + 1 BETWEEN 20 AND 400) SELECT doc_id, line_no, md5(hex(encode(line))) AS line_hex FROM k WHERE r <= 5")
def file_test_prep(spark: SparkSession, d: str) -> DataFrame:
    """Test lines: of each text the first five of 20 to 400 bytes, re-encoded."""
    return R.prepared_lines(lines(_docs(spark, d), keep=("doc_id",)), 5, 20, 400).select("doc_id", F.col("line_no").cast("long").alias("line_no"), _digest(F.hex("bytes")).alias("line_hex"))


@query("confidence_filter", f"""WITH {_L}, r AS (SELECT doc_id, line_no, length(line) AS n, coalesce(list_sum(list_transform(regexp_extract_all(line, '[\\p{{L}}\\p{{N}} \\t]+'), lambda x: CASE WHEN length(x) > 1 THEN length(x) * length(x) ELSE 0 END)), 0) AS sq FROM l)
SELECT doc_id, line_no FROM r WHERE n > 0 AND round(least(greatest(4 * (2 * sq / (n * n)) * 0.5 * sqrt(n), 0), 99.999), 6) >= 7""")
def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(_docs(spark, d), keep=("doc_id",)).filter("line <> ''").filter(F.round(S.confidence(F.col("line")), 6) >= S.confidence_floor(None, automatic=True))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("leading_newlines", "SELECT doc_id, length(text) AS chars FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x00]')")
def leading_newlines(spark: SparkSession, d: str) -> DataFrame:
    """What ends a string is consumed before the next one starts."""
    rows = _docs(spark, d).filter(~F.col("text").rlike("^[\\s\\x00]"))
    return rows.select("doc_id", F.char_length(S.after_newlines(F.concat(F.lit("\r\n\n"), "text"))).cast("long").alias("chars"))


@query("language_sets", "SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Zéèêëàâçîïôûùœæ]'))::BIGINT AS french, len(regexp_extract_all(text, '[a-zA-Zäöüß]'))::BIGINT AS german FROM (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'İ'))")
def language_sets(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    rows = _docs(spark, d).filter(~F.col("text").contains("İ"))
    return rows.select("doc_id", *(F.regexp_count(low, F.lit(S.language_class(n))).cast("long").alias(n) for n in ("french", "german")))
