"""Fill-in-middle against a plain version, and texts rebuilt from outputs."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingmill.llm import fim

TEXTS = st.text(st.sampled_from("ab Z9<>PSM\n\x00é\U0001f600"), max_size=60)


def plainly(text, doc_id):
    """The contract, unit by unit."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(-5, 10**6))
def test_cut_equals_plain_version_and_comes_back(text, doc_id):
    got = fim.cut(text, str(doc_id))
    assert got == plainly(text, doc_id)
    assert fim.restore(got[4], got[1]) == text


def test_all_forms_occur_and_ends_are_compact():
    forms = [fim.cut("one two three four", str(k))[1] for k in range(2000)]
    assert 0.07 < forms.count("plain") / 2000 < 0.13 and 0.14 < forms.count("spm") / 2000 < 0.22
    ends = fim.unit_ends("ab, é" * 1000)
    assert ends.itemsize == 4 and list(ends[:4]) == [2, 3, 4, 5]


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "no number here"), (3, "<P> stays"), (4, "same id"), (4, "same id, other text"), (4, "same id"), (5, "é" * 30_000 + "word " * 30_000), (6, "\x00\U0001f600")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("e") for c in ("p", "d", "n", "form", "output", "start")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(fim.op11_fim(spark, str(tmp_path)).collect(), key=repr)
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = plainly(text or "", "" if doc_id is None else doc_id)
        want.append((doc_id, n, form, prefix, middle, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, text or ""))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    made = fim.transform(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(r[0] for r in made.select(fim.restored("output", "form")).collect()) == sorted(t or "" for _, t in rows)
