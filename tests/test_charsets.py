"""Byte models: encoding, counting and scores against plain Python, ranking of held-out texts, strings by ranked charsets."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lingmill.operators import charsets as B
from lingmill.operators import strings as S
from lingmill.session import table

DIR = "/root/testdata/sf0.001"
FIVE = ("utf-8", "utf-16-le", "utf-16-be", "latin-1", "cp850")


def test_encoding_equals_python(spark):
    texts = ["", "plain", "é Ü ñ ß", "a\nb\x00c", "€ \U0001f600 ж [^-]"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = {(r.i, r.charset): bytes(r.content) for r in B.in_charsets(docs, (*FIVE, "cp1252"), "i").collect()}
    assert len(got) == len(texts) * 6
    for (i, c), content in got.items():
        assert content == (texts[i].encode(c, "replace")), (i, c)
    with pytest.raises(ValueError):
        B.encoded(F.col("text"), "cp500")


def by_hand(contents, lengths):
    out = Counter()
    for lang, charset, data in contents:
        for i in range(0, len(data), B.ALIGN.get(charset, 1)):
            for n in lengths:
                g = data[i : i + n]
                if len(g) == n and b"\n" not in g and g[:2] != b"  " and not g[:2].isdigit():
                    out[lang or "", charset, n, g.decode("latin-1")] += 1
    return out


def made(seed=3):
    draw = random.Random(seed)
    texts = ["", "a", "12 ab  cd\n99", "é" * 700] + [" ".join(draw.choices(["the", "und", "Ça", "ño", "a  b", "12", "\n"], k=draw.randint(1, 250))) for _ in range(12)]
    return [(i, ["en", "fr", None][i % 3], c, t.encode(c)) for i, t in enumerate(texts) for c in FIVE[:4]]


def test_counts_and_scores_equal_plain_python(spark):
    rows = made()
    contents = spark.createDataFrame([(i, lang, c, bytearray(b)) for i, lang, c, b in rows], "i int, lang string, charset string, content binary")
    lengths = (2, 3, 4)
    got = {(r.lang, r.charset, r.n, r.gram): r.cnt for r in B.counts(contents, lengths).collect()}
    assert got == by_hand([r[1:] for r in rows], lengths)

    model = B.train(contents, lengths, 60)
    weight = {(r.lang, r.charset, r.gram): r.weight for r in model.collect()}
    # Keys with nulls, an empty and a null window; windows at odd places of wide text.
    cut = B.windows(contents.withColumnRenamed("charset", "truth"), "i", "truth")
    extra = spark.createDataFrame([(None, "x", 1, bytearray(b"")), (None, "x", 2, None), (None, "x", 3, bytearray(b"\x00\x00a\x00b"))], "i int, truth string, window_start int, window binary")
    cut = cut.unionByName(extra)
    key = ("i", "truth", "window_start")
    want = {}
    for r in cut.collect():
        data, best = bytes(r.window or b""), {}
        names = {(lang, c) for lang, c, _ in weight}
        for lang, c in names:
            total = sum(weight.get((lang, c, data[i : i + n].decode("latin-1")), 0) * n for i in range(0, len(data), B.ALIGN.get(c, 1)) for n in lengths if i + n <= len(data))
            if total:
                best[c] = max(best.get(c, 0), total / len(data))
        want[r.i, r.truth, r.window_start] = {c: round(v, 9) for c, v in best.items()}
    plain = lambda df: {(r.i, r.truth, r.window_start): {f.charset: round(f.score, 9) for f in r.found} for r in df.collect()}
    assert plain(B.scores(cut, model, key)) == want
    assert plain(B.scores_joined(cut, model, key)) == want
    assert all(not r.found for r in B.scores(cut, model.limit(0), key).collect())

    trust = {"utf-8": 0.5}
    for r in B.ranked(B.scores(cut, model, key), trust).collect():
        scaled = {c: round(s * trust.get(c, B.CODE_PAGE), 6) for c, s in want[r.i, r.truth, r.window_start].items()}
        least = max(0.5 * max(scaled.values(), default=0), 0.05)
        sure = {c for c, s in scaled.items() if abs(s - least) > 1e-5}
        assert {f.charset for f in r.ranked} & sure == {c for c in sure if scaled[c] >= least}
        assert [(-f.score, f.charset) for f in r.ranked] == sorted((-f.score, f.charset) for f in r.ranked)


def test_windows_cover_contents(spark):
    sizes = [0, 1, 383, 384, 385, 704, 705, 5000]
    contents = spark.createDataFrame([(n, bytearray(random.Random(n).randbytes(n))) for n in sizes], "n int, content binary")
    got = {}
    for r in B.windows(contents, "n").orderBy("n", "window_start").collect():
        got.setdefault(r.n, []).append((r.window_start, bytes(r.window)))
    assert sorted(got) == sizes[1:]
    for n, rows in got.items():
        data = random.Random(n).randbytes(n)
        assert [a for a, _ in rows] == list(range(0, max(0, math.ceil((n - 384) / 320)) * 320 + 1, 320))
        assert all(w == data[a : a + 384] for a, w in rows) and rows[-1][0] + 384 >= n


@pytest.fixture(scope="module")
def held(spark):
    """Models of two thirds of the documents, and the rest."""
    docs = table(spark, DIR, "documents").filter("text is not null").select("doc_id", "lang", "text")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return B.train(B.in_charsets(docs.filter(~third), FIVE, "lang")).cache(), docs.filter(third)


def test_held_out_windows_are_ranked_right(spark, held):
    model, rest = held
    key = ("doc_id", "charset", "window_start")
    cut = B.windows(B.in_charsets(rest, FIVE, "doc_id"), "doc_id", "charset")
    tops = {(r.doc_id, r.charset, r.window_start): r.ranked[0].charset if r.ranked else "ascii" for r in B.ranked(B.scores(cut, model, key)).collect()}
    right, total, accented = Counter(), Counter(), 0
    for r in cut.collect():
        window, top = bytes(r.window), tops[r.doc_id, r.charset, r.window_start]
        total[r.charset] += 1
        accented += r.charset == "latin-1" and not window.isascii()
        # Windows may cut a character; those of ASCII alone read the same in many charsets.
        right[r.charset] += window.decode(top, "ignore") == window.decode(r.charset, "ignore")
    assert accented > 50
    assert all(right[c] >= 0.95 * total[c] for c in FIVE), (right, total)


def test_strings_by_ranked_charsets(spark, held):
    model, rest = held
    noise = b"\0\1" * 8
    texts = {r.doc_id: r.text for r in rest.collect()}
    for charset in ("cp850", "utf-16-be"):
        files = spark.createDataFrame([(i, bytearray(noise + t.encode(charset, "replace") + noise)) for i, t in texts.items()], "path long, content binary")
        found = {}
        for r in B.extract_ranked(files, model).orderBy("path", "offset").collect():
            found.setdefault(r.path, []).append(r)
        whole = sum(any(r.text.strip() == t.encode(charset, "replace").decode(charset).strip() for r in found.get(i, [])) for i, t in texts.items())
        assert whole >= 0.9 * len(texts), (charset, whole, len(texts))


def test_order_of_trial(spark, held):
    model, _ = held
    models = B.ByteModels(model.toArrow())
    german = "Größe der Wälder über den Flüssen und für die Häuser".encode("cp850")
    assert [c for c in models.order(german, []) if c not in ("utf-8", "ascii")][0] == "cp850"
    assert models.order(b"\x01\x02", []) == ["ascii", "latin-1"]
    assert B.ByteModels(model.limit(0).toArrow()).order(german, [])[-1] == "latin-1"
    assert S.sniffed_order("ééééé".encode(), []) == ["utf-8", "ascii", "latin-1"]


def test_texts_are_scored_inside_tasks(spark, monkeypatch):
    """Encoding, windows and scores in one step are those of the steps one by one; equal windows are walked once."""
    monkeypatch.setattr(B, "ENCODED", 300)
    texts = ["", "a", "12 ab  cd\n99", "é" * 700, "the und " * 300, "the und " * 300, "Ça ño € \U0001f600 ж" * 40, None]
    docs = spark.createDataFrame([(None if i == 2 else i, ["en", "fr", None][i % 3], t) for i, t in enumerate(texts)], "i int, lang string, text string").repartition(2)
    contents = B.in_charsets(docs, FIVE, "i", "lang")
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    model = B.train_texts(docs, FIVE, (2, 4), 60)
    assert rows(model) == rows(B.train(contents, (2, 4), 60))
    whole = B.scores_of_texts(docs, FIVE, model, "i")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "ArrowEval" not in plan
    steps = B.scores(B.windows(contents.withColumnRenamed("charset", "truth"), "i", "truth"), model, ("i", "truth", "window_start"))
    plain = lambda df: sorted(((r.i, r.truth, r.window_start, sorted((f.charset, round(f.score, 9)) for f in r.found)) for r in df.collect()), key=repr)
    assert plain(whole) == plain(steps)
    monkeypatch.setattr(B, "TRIE_ROWS", 1)
    assert plain(B.scores_of_texts(docs, FIVE, model, "i")) == plain(steps)

    models, walked = B.ByteModels(model.toArrow()), []
    monkeypatch.setattr(models.trie, "deepest", lambda codes, real=models.trie.deepest: walked.append(len(codes)) or real(codes))
    got = models.table([b"the und", b"", b"the und", b"the und"])
    assert sum(walked) <= 9 and (got[0] == got[2]).all() and (got[0] == got[3]).all() and got[0].any() and not got[1].any()
    monkeypatch.setattr(B, "CELLS", 1)
    blocks = [t.encode("utf-16-le") for t in texts if t]
    assert abs(B.ByteModels(model.toArrow()).table(blocks) - models.table(blocks)).max() < 1e-12
