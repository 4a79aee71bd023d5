"""Every query of the subpackage on tables with nulls everywhere, ties, repeats, odd texts, clashing columns, and on empty ones."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lingmill.llm.queries import QUERIES

#: Names that the operators use for columns of their own.
CLASHES = list(dict.fromkeys("part before first last base ids label x quality score predicted kept keep_id group_size sequence_id offset start length n size taken target source_size token hash block pos component_id key value count kind spans bucket id sid rep host path position taken_id taken_tie late row own_id draw place part within rid __section name base spans start_ body head stream example".split()))
TEXTS = [None, "", " \n\t", "a", "a b c d e f", "A B c d e f", "\x00\x01 b", "\U0001f600 é ß İ", "mail a@b.co 1.2.3.4", "z" * 200_000, "w v " * 20_000, "<b>&amp;</b>\n" * 3]
DOCS = [(i if i % 5 else None, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(TEXTS)]
PAGE = "<html><body><div><p>hi there</p><p>same line</p></div></body></html>"
PAGES = [(1, "http://h.x/a", PAGE), (1, "http://h.x/a", PAGE), (None, None, PAGE), (2, "::bad", None), (3, "", "<" * 50_000), (4, "http://[bad", "<!-- open <p>x</p>"), (5, "http://h.x/c", "<div>" * 20_000 + "deep")]
TURNS = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 1, "assistant", "a" * 50_000)]
LABELS = [(i if i % 5 else None, i % 2 if i % 3 else None, None) for i in range(len(TEXTS))]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string", "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full = {"documents": DOCS + DOCS[3:6], "pages": PAGES, "conversations": TURNS, "labels": LABELS}
    out = {}
    for case, rows in (("full", full), ("empty", dict.fromkeys(full, [])), ("unlabelled", full | {"labels": []})):
        out[case] = tmp_path_factory.mktemp(case)
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(rows[name], schema)
            df = df.withColumns({c: F.lit("e") for c in CLASHES if c not in df.columns})
            df.coalesce(2).write.parquet(f"{out[case]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
@pytest.mark.parametrize("case", ["full", "empty"])
def test_defined_on_every_row(spark, folders, name, case):
    rows = QUERIES[name](spark, str(folders[case])).collect()
    if name == "op2_chat":
        assert sorted(str(r.conv_id) for r in rows) == (["-1", "1", "2", "None"] if case == "full" else ["-1"])
    elif name == "op3_html_extract":
        assert len(rows) == (len(PAGES) if case == "full" else 0) and all(r.text is not None for r in rows)
    elif name == "op12_repair":
        assert sorted(str(r.conv_id) for r in rows) == (["1", "2", "None"] if case == "full" else [])
    elif name == "op1_packing":
        assert sum(r.start == 0 for r in rows) == (len(DOCS) + 3 if case == "full" else 0)
    else:
        assert len(rows) == (len(DOCS) + 3 if case == "full" else 0)


def test_values_on_every_row(spark, folders):
    """What the digest columns are on nulls, repeats and odd texts, by plain Python."""
    rows = DOCS + DOCS[3:6]
    texts = [t or "" for _, t, *_ in rows]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    low = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    got = QUERIES["op6_exact_dedup"](spark, str(folders["full"])).collect()
    assert Counter((r.text_sha256, r.group_size) for r in got) == Counter((digest(t), low.count(t)) for t in low)
    assert sum(r.kept for r in got) == len(set(low))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    got = QUERIES["op10_quality_rules"](spark, str(folders["full"])).collect()
    assert Counter((r.n_words, r.word_chars) for r in got) == Counter((len(w), sum(map(len, w))) for w in words)
    got = QUERIES["op4_mixing"](spark, str(folders["full"])).collect()
    assert Counter(r.size for r in got) == Counter(map(len, words)) and all(r.taken <= 3 * r.size for r in got)
    got = QUERIES["op9_jaccard_join"](spark, str(folders["full"])).collect()
    shingles = [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1) for w in words]
    assert Counter(r.n_shingles for r in got) == Counter(shingles)
    got = QUERIES["op8_pii"](spark, str(folders["full"])).collect()
    assert sorted(r.n_email for r in got) == sorted(t.count("@") for t in texts) and {r.base_sha256 for r in got if not r.n_spans} == {digest("")}


@pytest.mark.parametrize("case", ["full", "empty", "unlabelled"])
def test_pipeline_runs(spark, folders, case):
    rows = QUERIES["pipeline"](spark, str(folders[case])).collect()
    assert (not rows) if case == "empty" else all(r.length > 0 for r in rows)


def test_scores_without_labels(spark, folders):
    assert {r.score for r in QUERIES["op7_quality_classifier"](spark, str(folders["unlabelled"])).collect()} == {0.5}
