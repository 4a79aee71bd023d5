"""Queries: text functions, strings, HTML and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import strings as S
from ..operators.ngrams import lines
from ..operators.sizes import spread
from ..session import table
from .registry import query

_L = "l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l0)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


@query("line_scan", f"WITH {_L} SELECT doc_id, line_no, length(line) AS chars, octet_length(encode(line)) AS bytes, md5(line) AS line_md5 FROM l")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    return lines(_docs(spark, d), keep=("doc_id",)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.char_length("line").cast("long").alias("chars"), F.octet_length("line").cast("long").alias("bytes"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("text_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*(?:[eE][+-]?[0-9]+)?|[\p{L}\p{M}]+(?:[-''][\p{L}\p{M}]+)*|[^\s\p{L}\p{M}0-9]')) AS tokens FROM documents")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("text_words_ends", "SELECT doc_id, lower(ws[1]) AS first_word, lower(ws[-1]) AS last_word, len(ws) AS n FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS ws FROM documents)")
def text_words_ends(spark: SparkSession, d: str) -> DataFrame:
    w = F.transform(T.words(F.col("text")), lambda x: F.lower(x))
    return _docs(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.get("w", F.lit(0)).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word"), F.size("w").cast("long").alias("n"))


ABBREVIATED = "|".join(T.ABBREVIATIONS)
_SENTENCES = rf"""h AS (SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}])({ABBREVIATED}|\p{{Lu}})\.([ \t\n\r])', '\1\2' || chr(1) || '\3', 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.!?:])[ \t\n\r]+([^\p{{Ll}}0-9.,;:!? \t\n\r-])', '\1' || chr(2) || '\2', 'g'), '\n[ \t\r]*\n', chr(2), 'g') AS t FROM h),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(2)), lambda x: trim(regexp_replace(replace(x, chr(1), '.'), '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS ss FROM b)"""


@query("text_sentences", f"WITH {_SENTENCES} SELECT doc_id, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS sentence FROM s")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("long"))


@query("text_case", "SELECT doc_id, md5(upper(replace(text, 'ß', 's'))) AS up, md5(lower(text)) AS low, md5(reverse(text)) AS back, strpos(lower(text), 'the') AS the_at, length(text) AS chars, octet_length(encode(text)) AS bytes FROM documents")
def text_case(spark: SparkSession, d: str) -> DataFrame:
    t, h = F.col("text"), lambda c: F.md5(c.cast("binary"))
    return _docs(spark, d).select("doc_id", h(F.upper(F.replace(t, F.lit("ß"), F.lit("s")))).alias("up"), h(F.lower(t)).alias("low"), h(F.reverse(t)).alias("back"), F.instr(F.lower(t), "the").cast("long").alias("the_at"), F.char_length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"))


@query("text_translate", "SELECT doc_id, md5(translate(text, 'éèêüöäñ', 'eeeuoan')) AS plain, md5(base64(encode(text))) AS b64, md5(text) AS h FROM documents")
def text_translate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(F.translate("text", "éèêüöäñ", "eeeuoan").cast("binary")).alias("plain"), F.md5(F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\\r\\n]", "").cast("binary")).alias("b64"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("text_glob", "SELECT doc_id, text GLOB 'The*' AS starts, regexp_matches(text, '(?si)^.h.*the.*$') AS mid FROM documents")
def text_glob(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.glob(F.col("text"), "The*").alias("starts"), T.glob(F.col("text"), "?h*the*", True).alias("mid"))


@query("text_regex_dialect", "SELECT doc_id, regexp_matches(text, '(?:the|der|les) [a-z]+ing') AS hit FROM documents")
def text_regex_dialect(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.col("text").rlike(T.list_regex("(the,der,les) [a-z]+ing")).alias("hit"))


@query("text_wrap", r"""WITH w AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), '([^ ]{81,}|.{0,79}[^ ])(?: |$)', 1) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM w""")
def text_wrap(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(T.wrap(F.col("text"), 80)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


@query("entities_decoded", r"""WITH p AS (SELECT page_id, regexp_extract_all(replace(html, 'an', '&#228;n'), '(?s)&#[0-9]+(?:[^0-9]|$)|[^&]+|&') AS ps FROM pages)
SELECT page_id, md5(list_aggregate(list_transform(ps, lambda x: CASE WHEN regexp_matches(x, '^&#[0-9]') THEN chr(regexp_extract(x, '^&#([0-9]+)', 1)::INT) || CASE WHEN x[-1] = ';' THEN '' ELSE regexp_extract(x, '(?s)^&#[0-9]+(.?)$', 1) END ELSE x END), 'string_agg', '')) AS decoded FROM p""")
def entities_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Pages with some letters written as entities."""
    return table(spark, d, "pages").select("page_id", F.md5(T.decode_entities(F.replace("html", F.lit("an"), F.lit("&#228;n"))).cast("binary")).alias("decoded"))


_GREEK, _LATIN = "αβγδεζικλμνξοπρστυωχ", ["a", "v", "g", "d", "e", "z", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "t", "y", "o", "ch"]
_PLAIN = "abcdefghijklmnopqrst"


@query("romanised", f"SELECT doc_id, md5(list_aggregate(list_transform(string_split(text, ''), lambda c: CASE {' '.join(f"WHEN c = '{a}' THEN '{b}'" for a, b in zip(_PLAIN, _LATIN, strict=True))} ELSE c END), 'string_agg', '')) AS latin, regexp_matches(text, '[{_PLAIN}]') AS other_script FROM documents WHERE text <> ''")
def romanised(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose first letters of the alphabet are written in Greek ones."""
    greek = F.translate("text", _PLAIN, _GREEK)
    return _docs(spark, d).filter("text <> ''").select("doc_id", F.md5(T.romanise(greek).cast("binary")).alias("latin"), T.romanisable(greek).alias("other_script"))


@query("string_confidence", rf"""WITH {_L}, r AS (SELECT doc_id, line_no, length(line) AS n, list_sum(list_transform(regexp_extract_all(line, '[\p{{L}}\p{{N}} \t]+'), lambda x: CASE WHEN length(x) > 1 THEN length(x) * length(x) ELSE 0 END)) AS sq FROM l)
SELECT doc_id, line_no, round(CASE WHEN n = 0 THEN 0.0 ELSE least(greatest(4 * (2 * coalesce(sq, 0) / (n * n)) * 0.5 * sqrt(n), 0), 99.999) END, 6) AS confidence FROM r""")
def string_confidence(spark: SparkSession, d: str) -> DataFrame:
    return lines(_docs(spark, d), keep=("doc_id",)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(S.confidence(F.col("line")), 6).alias("confidence"))


@query("string_runs", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{P}\p{S} \t]{40,}')) AS n FROM documents")
def string_runs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(S.runs(F.col("text"), 40)).cast("long").alias("n"))


@query("string_filters", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS kept FROM l WHERE octet_length(encode(line)) >= 4 AND len(regexp_extract_all(line, '[\p{L}\p{N}]')) / length(line) >= 0.25 GROUP BY doc_id""")
def string_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(_docs(spark, d), keep=("doc_id",))
    return rows.filter((F.octet_length("line") >= 4) & (S.alpha_ratio(F.col("line")) >= 0.25)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("strings_from_bytes")
def strings_from_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Document texts in UTF-16 between zero bytes, found again without being told the charset."""
    noise = F.unhex(F.lit("00" * 8))
    packed = _docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.concat(noise, F.encode("text", "UTF-16LE"), noise).alias("content"))
    return S.extract(packed)


@query("strings_formatted", rf"""WITH {_L}, r AS (SELECT doc_id, line_no, line, length(line) AS n, coalesce(list_sum(list_transform(regexp_extract_all(line, '[\p{{L}}\p{{N}} \t]+'), lambda x: CASE WHEN length(x) > 1 THEN length(x) * length(x) ELSE 0 END)), 0) AS sq FROM l)
SELECT doc_id, line_no, 'd' || doc_id || ':' || chr(9) || lpad(to_hex(line_no), 8, ' ') || ' ' || lpad(printf('%.3f', round(least(greatest(4 * (2 * sq / (n * n)) * 0.5 * sqrt(n), 0), 99.999) + 1e-9, 3)), 6, ' ') || chr(9) || 'xx' || chr(9) || CASE WHEN octet_length(encode(line)) = n THEN 'ascii' ELSE 'utf-8' END || chr(9) || line AS row_text FROM r WHERE n > 0""")
def strings_formatted(spark: SparkSession, d: str) -> DataFrame:
    """Lines as output rows: file, offset in radix 16, confidence, language, encoding, text."""
    encoding = F.when(F.octet_length("line") == F.char_length("line"), "ascii").otherwise("utf-8")
    row = S.formatted(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("line_no"), F.round(S.confidence(F.col("line")) + 1e-9, 3), F.lit("xx"), encoding, F.col("line"))
    return lines(_docs(spark, d), keep=("doc_id",)).filter("line <> ''").select("doc_id", F.col("line_no").cast("long").alias("line_no"), row.alias("row_text"))


@query("url_parts", r"""SELECT page_id, nullif(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '') AS scheme, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '') AS host,
nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *(T.url_part(F.col("url"), p).alias(p) for p in ("scheme", "host", "path", "query", "fragment")))


@query("html_tags", r"SELECT page_id, list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: upper(x)) AS tags FROM pages")
def html_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.tag_names(F.col("html")).alias("tags"))


@query("html_hrefs", r"""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<[aA]\s[^>]*?[hH][rR][eE][fF]="([^"]*)"', 1))) AS links FROM pages""")
def html_hrefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sort_array(T.hrefs(F.col("html"))).alias("links"))


@query("html_comments", "SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')) AS h FROM pages")
def html_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_comments(F.col("html")).cast("binary")).alias("h"))


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?i)<img\s[^>]*?alt="([^"]*)"[^>]*>', '[\1]', 'g'), '(?i)</?(?:p|h[1-6]|br|li|hr|div|ul|ol|tr|article|nav|footer|title)[^>]*>', chr(10), 'g')"""


@query("html_stripped", rf"""WITH s AS (SELECT page_id, regexp_replace({_STRIPPED}, '<[^>]*>', '', 'g') AS t FROM pages), e AS (SELECT page_id, {"replace(" * len(T.ENTITIES)}t{"".join(f", '{k}', '{v}')" for k, v in T.ENTITIES.items())} AS t FROM s)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS text FROM e""")
def html_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("math_functions", """SELECT p_partkey, round(ln(greatest(p_retailprice / 1000, 2.2250738585072014e-308)), 8) AS safe_log, round(CASE WHEN ln(p_size / 100.0) < -2 THEN -2 * sqrt(ln(p_size / 100.0) / -2) ELSE ln(p_size / 100.0) END, 8) AS smooth,
round(exp(-(p_size - 25.0) * (p_size - 25.0) / 200) / sqrt(2 * pi() * 100), 8) AS density, round(2 * (p_size / 50.0) * 0.5 / (p_size / 50.0 + 0.5), 8) AS f1 FROM part""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.round(T.safe_log(F.col("p_retailprice") / 1000), 8).alias("safe_log"), F.round(T.smoothed_log(size / 100, -2), 8).alias("smooth"), F.round(T.gaussian(size, F.lit(25.0), F.lit(100.0)), 8).alias("density"), F.round(T.f_measure(size / 50, F.lit(0.5)), 8).alias("f1")
    )
