"""Text functions: tokens, sentences, entities, HTML, URLs, romanisation, wrapping, spans."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

TOKEN = r"[0-9]+(?:[.,][0-9]+)*(?:[eE][+-]?[0-9]+)?|[\p{L}\p{M}]+(?:[-'][\p{L}\p{M}]+)*|[^\s\p{L}\p{M}0-9]"
#: The named entities that the markup stripper knows.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "(c)", "&reg;": "(R)", "&middot;": "·", "&amp;": "&"}
ABBREVIATIONS = ("Mr", "Mrs", "Dr", "Prof", "St", "vs", "etc", "Inc", "Ltd", "Jr", "Sr")


def tokens(text: Column) -> Column:
    """Numbers with their marks, words with inner hyphens and apostrophes, and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")


def symbols(text: Column) -> Column:
    return F.transform(words(text), F.upper)


def decanonical(text: Column) -> Column:
    """Tokens rejoined: no blank before closing marks or after opening ones."""
    return F.regexp_replace(F.regexp_replace(text, " ([.,;:!?)\\]}])", "$1"), "([(\\[{]) ", "$1")


def sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences end at . ! ? : before a blank that opens no lower-case letter, digit or mark, or at a blank line.

    The point of an abbreviation or of an initial ends none.
    """
    held = F.regexp_replace(text, f"(^|[^\\p{{L}}])({'|'.join(map(re.escape, abbreviations))}|\\p{{Lu}})\\.([ \\t\\n\\r])", "$1$2\x01$3")
    cut = F.regexp_replace(F.regexp_replace(held, "([.!?:])[ \\t\\n\\r]+([^\\p{Ll}0-9.,;:!? \\t\\n\\r-])", "$1\x02$2"), "\n[ \\t\\r]*\n", "\x02")
    plain = lambda x: F.trim(F.regexp_replace(F.translate(x, "\x01", "."), "[ \\t\\n\\r]+", " "))
    return F.filter(F.transform(F.split(cut, "\x02", -1), plain), lambda x: x != "")


def known_abbreviation(word: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Whether a word, without the point behind it, is one of the list, as it is written there."""
    return F.array_contains(F.array(*map(F.lit, abbreviations)), F.regexp_replace(word, "\\.$", ""))


def character(point: Column) -> Column:
    """The character of a code point; ? for none and from U+10FFFF on."""
    odd = point.isNull() | (point >= 0x10FFFF) | point.between(0xD800, 0xDFFF)
    return F.when(odd, "?").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(odd, 63).otherwise(point)), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Decimal entities as their characters; what ends the digits other than ; is echoed and opens none. Named ones stay."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)&#[0-9]+(?:[^0-9]|$)|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#([0-9]+)", 1)
        last = F.when(p.endswith(";"), "").otherwise(F.regexp_extract(p, "(?s)^&#[0-9]+(.?)$", 1))
        return F.when(digits == "", p).otherwise(F.concat(character(digits.try_cast("int")), last))

    return F.array_join(F.transform(pieces, one), "")


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def utf16_units(text: Column) -> Column:
    """The length in 16-bit units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def converted(content: Column, source: str, target: str) -> Column:
    """Bytes of one charset as bytes of another."""
    return F.encode(F.decode(content, source), target)


def up_to(text: Column, mark: str) -> Column:
    """What stands before the first mark."""
    return F.substring_index(text, mark, 1)


def string_number(text: Column) -> Column:
    """A whole number of 60 bits that texts are known by, the same everywhere."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def random_number(key: Column, below: int, seed: int = 0) -> Column:
    """A pseudo-random whole number from 0 on, below the bound, that key and seed fix."""
    return string_number(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))) % below


_ENTITY = "\\[\\[([A-Z]+):([^\\]|]*)(?:\\|([^\\]]*))?\\]\\]"


def named_entities(text: Column) -> Column:
    """array<struct<kind, surface, name>> of the marked entities [[KIND:surface]] and [[KIND:surface|name]]."""
    part = lambda k: F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("kind"), part(2).alias("surface"), part(3).alias("name")), lambda e: F.struct(e["kind"].alias("kind"), e["surface"].alias("surface"), F.nullif(e["name"], F.lit("")).alias("name")))


def strip_entities(text: Column) -> Column:
    """Marked entities by their surface."""
    return F.regexp_replace(text, _ENTITY, "$2")


def cognate_score(a: Column, b: Column, classes: tuple[str, ...] = ("cks", "dt", "fv", "iy", "gj", "uw")) -> Column:
    """1 less the edits over the longer length, where letters of one class are equal; 1 of two empty words."""
    came, to = "".join(c[1:] for c in classes), "".join(c[0] * (len(c) - 1) for c in classes)
    x, y = F.translate(F.lower(a), came, to), F.translate(F.lower(b), came, to)
    n = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / n)


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<!--.*?-->", " ")


def tag_names(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.upper)


def hrefs(html: Column) -> Column:
    """Targets of anchors, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("<[aA]\\s[^>]*?[hH][rR][eE][fF]=\"([^\"]*)\""), F.lit(1)))


def tag_attributes(html: Column) -> Column:
    """array<struct<name, attributes>> of the tags that open: names in upper case, quoted attributes as text."""
    tag = "<([A-Za-z][A-Za-z0-9]*)((?:\\s+[A-Za-z-]+\\s*=\\s*\"[^\"]*\")*)\\s*/?>"
    names, rest = (F.regexp_extract_all(html, F.lit(tag), F.lit(k)) for k in (1, 2))
    attribute = "([A-Za-z-]+)\\s*=\\s*\"([^\"]*)\""
    pair = lambda r: F.zip_with(F.regexp_extract_all(r, F.lit(attribute), F.lit(1)), F.regexp_extract_all(r, F.lit(attribute), F.lit(2)), lambda k, v: F.concat(F.upper(k), F.lit("="), v))
    return F.zip_with(names, rest, lambda n, r: F.struct(F.upper(n).alias("name"), pair(r).alias("attributes")))


def resolved(link: Column, base: Column) -> Column:
    """A link as an address: absolute ones as they are, others by host or folder of the base."""
    root, folder = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(F.regexp_extract(base, "^[^?#]*", 0), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)[^/]*$", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), link)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def absolute_links(html: Column, url: Column, same_folder: bool = False) -> Column:
    """hrefs() resolved against the page's BASE or its own address, each once; with same_folder those below it alone."""
    base = F.coalesce(F.nullif(F.regexp_extract(html, "<[bB][aA][sS][eE]\\s[^>]*?[hH][rR][eE][fF]=\"([^\"]*)\"", 1), F.lit("")), url)
    out = F.array_distinct(F.transform(hrefs(html), lambda x: resolved(x, base)))
    folder = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    return F.filter(out, lambda x: x.startswith(folder)) if same_folder else out


def plain_links(text: Column) -> Column:
    """Addresses that stand in a text without tags, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?:https?|ftp)://[^\\s<>\"')]+"), F.lit(0)))


def strip_markup(html: Column) -> Column:
    """Text of a page: scripts, styles and comments out, blocks on lines of their own, entities decoded."""
    out = F.regexp_replace(strip_comments(html), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "(?i)<img\\s[^>]*?alt=\"([^\"]*)\"[^>]*>", "[$1]")
    out = F.regexp_replace(out, "(?i)</?(p|h[1-6]|br|li|hr|div|ul|ol|tr|article|nav|footer|title)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), " ?\\n[ \\n]*", "\n"))


def url_part(url: Column, part: str) -> Column:
    """scheme, host, port, path, query or fragment of a URL; absent parts are null."""
    pattern, group = {
        "scheme": ("^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), "host": ("^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), "port": ("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*:([0-9]+)", 1),
        "path": ("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "query": ("\\?([^#]*)", 1), "fragment": ("#(.*)$", 1),
    }[part]
    return F.nullif(F.regexp_extract(url, pattern, group), F.lit(""))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most width characters, broken at blanks; a longer word is a line of its own."""
    plain = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    return F.regexp_extract_all(plain, F.lit(f"([^ ]{{{width + 1},}}|.{{0,{width - 1}}}[^ ])(?: |$)"), F.lit(1))


def wrapped_texts(text: Column, width: int, least: int, few: int = 100) -> Column:
    """wrap() of each line, short pieces dropped; where fewer than few are left, of the whole text."""
    each = F.filter(F.flatten(F.transform(F.split(text, "\n", -1), lambda x: wrap(x, width))), lambda x: F.char_length(x) >= least)
    return F.when(F.size(each) < few, F.filter(wrap(text, width), lambda x: F.char_length(x) >= least)).otherwise(each)


def romanised(text: str) -> str:
    """Letters of other scripts by Latin ones, from their Unicode names; others stay."""
    return "".join(_roman(c) for c in text)


_CACHE: dict[str, str] = {}
_NAMED = re.compile(r"^(CYRILLIC|GREEK|HEBREW|ARABIC|GEORGIAN|ARMENIAN|THAI|DEVANAGARI|BENGALI|TAMIL|TELUGU|GUJARATI|GURMUKHI|KANNADA|MALAYALAM|ORIYA) (SMALL |CAPITAL )?(?:FINAL )?(?:LETTER|CHARACTER|VOWEL SIGN) ([A-Z ]+?)(?: WITH .*)?$")
#: Latin spellings of letter names whose name is not their sound.
_SOUND = {
    "ALPHA": "a", "BETA": "v", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "i", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n",
    "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "TAU": "t", "UPSILON": "y", "PHI": "f", "CHI": "ch", "PSI": "ps", "OMEGA": "o",
    "SHORT I": "j", "HARD SIGN": "\"", "SOFT SIGN": "'", "ALEF": "'", "BET": "b", "GIMEL": "g", "DALET": "d", "HE": "h", "VAV": "v", "ZAYIN": "z", "HET": "ch", "TET": "t", "YOD": "y",
    "KAF": "k", "LAMED": "l", "MEM": "m", "NUN": "n", "SAMEKH": "s", "AYIN": "'", "TSADI": "ts", "QOF": "q", "RESH": "r", "SHIN": "sh", "TAV": "t", "KO KAI": "k", "NO NU": "n",
}
_CYRILLIC_CONSONANT = {"BE": "b", "VE": "v", "GHE": "g", "DE": "d", "ZHE": "zh", "ZE": "z", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "PE": "p", "ER": "r", "ES": "s", "TE": "t", "EF": "f", "HA": "h", "TSE": "c", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "YERU": "y", "IE": "e", "IO": "yo"}


def _roman(c: str) -> str:
    if c < "Ͱ":
        return c
    if c not in _CACHE:
        m = _NAMED.match(unicodedata.name(c, ""))
        if not m:
            _CACHE[c] = c
        else:
            name = m[3].removeprefix("FINAL ")
            sound = (_CYRILLIC_CONSONANT if m[1] == "CYRILLIC" else _SOUND).get(name) or _SOUND.get(name) or name.split(" ")[-1].lower()
            _CACHE[c] = sound.capitalize() if m[2] == "CAPITAL " else sound
    return _CACHE[c]


def romanise(text: Column) -> Column:
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(romanised, na_action="ignore")

    return run(text)


def romanisable(text: Column) -> Column:
    return text.rlike("[\\u0370-\\u03FF\\u0400-\\u052F\\u0530-\\u058F\\u0590-\\u05FF\\u0600-\\u06FF\\u0900-\\u0DFF\\u0E00-\\u0E7F\\u10A0-\\u10FF\\u1F00-\\u1FFF]")


def glob(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """? is one character, * any; the whole text must match."""
    body = "".join("." if c == "?" else ".*" if c == "*" else re.escape(c) for c in pattern)
    return text.rlike(f"(?s{'i' if ignore_case else ''})^{body}$")


def list_regex(pattern: str) -> str:
    """The bundled dialect as a Java pattern: (a,b) alternates, % quotes, ? makes optional."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c in "%\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif c == "(":
            depth += 1
            out.append("(?:")
        elif c == ")":
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c in ".^$|" and not (c == "^" and i and pattern[i - 1] == "["):
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def safe_log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(2.2250738585072014e-308)))


def smoothed_log(x: Column, threshold: float) -> Column:
    """The logarithm, damped below threshold (a negative number): threshold sqrt(lg / threshold)."""
    lg = safe_log(x)
    return F.when(lg < threshold, threshold * F.sqrt(lg / threshold)).otherwise(lg)


def gaussian(x: Column, mean: Column, variance: Column) -> Column:
    """The normal density; with variance 0, whether x is the mean."""
    return F.when(variance == 0, (x == mean).cast("double")).otherwise(F.exp(-(x - mean) * (x - mean) / (2 * variance)) / F.sqrt(2 * F.pi() * variance))


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return (1 + b) * precision * recall / (b * precision + recall)
