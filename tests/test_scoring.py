"""Scores after identification, stores, streams, hooks and clustering against plain Python."""

import lzma
import math
import random

import pytest
from pyspark.sql import functions as F

from lingmill import plans
from lingmill.functions import text as T
from lingmill.operators import cluster as C
from lingmill.operators import frames as R
from lingmill.operators import hooks as H
from lingmill.operators import scoring as S
from lingmill.operators import strings as X
from lingmill.sources import files as L
from lingmill.sources import stores as B
from lingmill.stages import keep, numbered, scope, scratch, stage, exists
from lingmill.streaming import stateful

DIR = "/root/testdata/sf0.001"


def test_priors_fold_by_hand(spark):
    draw = random.Random(3)
    rows = [(d, i, {g: round(draw.random() * 2, 3) for g in draw.sample("abcd", draw.randint(0, 3))}, draw.choice([1, 40]), draw.randint(1, 90)) for d in range(4) for i in range(12)]
    got = {(r.doc_id, r.line_no): r.v for r in S.priors(spark.createDataFrame(rows, "doc_id long, line_no int, v map<string,double>, gap int, size int")).collect()}
    for d in range(4):
        prior, seen, taken = {}, 0, 0
        for _, i, own, gap, size in [r for r in rows if r[0] == d]:
            decay = 0.25 * (0.75 if gap > 20 and seen >= 2 and taken >= 96 else 1)
            prior = {g: s * decay for g, s in prior.items()}
            w = max(0, 0.5 * size ** (1 / 3) + 0.3 * (max(own.values(), default=0) / 1.2) ** 1.33)
            share = w / (1 + w)
            mixed = own if seen == 0 else {g: share * own.get(g, 0) + (1 - share) * prior.get(g, 0) / (2 + 0.25 * math.log(size)) for g in {*own, *prior}}
            added = {g: s * math.log(size) for g, s in own.items() if s > 0.2} if seen == 0 else own
            alive = [g for g, s in mixed.items() if s > 0.2]
            prior = {g: (prior.get(g, 0) + added.get(g, 0)) * (1.15 if alive == [g] else 1) for g in {*prior, *added}}
            assert got[d, i] == pytest.approx(mixed)
            seen, taken = seen + 1, taken + size


def test_stream_prior_is_the_batch_fold(spark):
    one = {(r.doc_id, r.line_no): r.score for r in plans.QUERIES["stream_prior"](spark, DIR).collect()}
    two = {(r.doc_id, r.line_no): r.score for r in plans.QUERIES["label_smoothed"](spark, DIR).collect()}
    assert two.keys() <= one.keys() and all(one[k] == pytest.approx(two[k], abs=2e-6) for k in two)


def test_ancestors_at_any_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n70", "n68")], "src string, dst string")
    got = {(r.src, r.dst): r.depth for r in R.ancestors(edges).collect()}
    assert got["n0", "n70"] == 70 and got["n70", "n70"] == 3
    first = {(r.src, r.dst): r.path for r in R.paths(spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")).collect()}
    assert first["a", "d"] == ["b", "d"] and first["a", "e"] == ["b", "d", "e"]


def test_depth_first_differs_from_breadth_first(spark):
    edges = spark.createDataFrame([("x", "a"), ("x", "b"), ("a", "c")], "src string, dst string")
    frames = spark.createDataFrame([("b", "s", "VALUE", 0, "of b"), ("c", "s", "VALUE", 0, "of c"), ("b", "t", "NOTE", 0, "n")], "frame string, slot string, facet string, pos int, filler string")
    got = {m: {(r.slot, r.filler) for r in R.inherited_by(frames, edges, edges, m).filter("frame = 'x'").collect()} for m in R.MODES}
    assert got["none"] == set() and got["bfs"] == {("s", "of b"), ("t", "n")} and got["dfs"] == {("s", "of c"), ("t", "n")}
    assert got["local-bfs"] == {("s", "of b")} and got["simple"] == {("s", "of b"), ("t", "n")}


def test_stages_are_dropped(spark):
    rows = spark.range(10)
    with scope():
        a, b = stage(rows, "a"), keep(rows, "b")
    assert not exists(spark, a._stage_path) and exists(spark, b._stage_path) and b.count() == 10
    got = [(r.id, r.n) for r in numbered(spark.range(50).repartition(7), [F.desc("id")], "n").collect()]
    assert sorted(got) == [(i, 49 - i) for i in range(50)]


def test_in_memory_methods_cluster_a_basis(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, [float(i % 3 == k) + draw.random() / 50 for k in range(3)]) for i in range(90)]
    v = stage(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v")
    whole = C.agglomerative(v, 3).collect()
    monkeypatch.setattr(C._together, "__defaults__", (C._together.__defaults__[0], 30))
    part = C.agglomerative(v, 3).collect()
    for got in (whole, part):
        label = {r.vec_id: r.cluster for r in got}
        assert len(label) == 90 and all(label[i] == label[i % 3] for i in label) and len(set(label.values())) == 3


def test_neighbours_over_blocks(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, i % 2, [draw.random() for _ in range(4)]) for i in range(60)]
    monkeypatch.setattr(C, "BLOCK", 7)
    got = {}
    for r in C.neighbours(spark.createDataFrame(rows, "vec_id long, cluster int, v array<double>"), 3).collect():
        got.setdefault(r.vec_id, []).append(r.sim)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for i, c, v in rows:
        want = sorted((cos(v, w) for j, k, w in rows if k == c and j != i), reverse=True)[:3]
        assert sorted(got[i], reverse=True) == pytest.approx(want)


def test_parameters_of_methods():
    assert C.parameters("two,k=4") == {"method": "two-pass", "k": "4"} and C.parameters("method=agg,linkage=far".replace("far", "fur")) == {"method": "agglomerative", "linkage": "furthest"}
    with pytest.raises(ValueError):
        C.parameters("method=x")


def test_list_syntax():
    text = '(a "b \\"c\\"" (1 2.5) [d])'
    form = B.read_form(text)
    assert form == ["a", {"text": 'b "c"'}, [1, 2.5], ["d"]] and B.read_form(B.print_form(form)) == form and B.read_form("  ") is None


def test_xz_lines(spark, tmp_path):
    (tmp_path / "a.xz").write_bytes(lzma.compress("one\ntwo\n".encode()))
    (tmp_path / "b.txt").write_text("three\n")
    rows = B.compressed_lines(spark, f"{tmp_path}/a.xz", f"{tmp_path}/b.txt").select("line").collect()
    assert sorted(r.line for r in rows) == ["one", "three", "two"]


def test_store_of_another_version(spark):
    path = scratch(spark, "old")
    spark.range(1).withColumn("version", F.lit(3)).write.parquet(path)
    with pytest.raises(ValueError):
        B.load_models(spark, path)
    with pytest.raises(FileNotFoundError):
        B.find_store(spark, f"{path}-none")


def test_text_functions(spark):
    rows = spark.createDataFrame([("Dr. Hall met J. Smith. He left! (Why?) no 3.5 here. Ok\n\nnew part", "&#65&#66; &#228;&#1114111; &amp; &#x;")], "t string, e string")
    r = rows.select(T.sentences(F.col("t")).alias("s"), T.decode_entities(F.col("e")).alias("e"), T.wrap(F.lit("aa bb cccccccc d"), 5).alias("w"), T.wrapped_texts(F.lit("aa bb\nc"), 5, 2).alias("m")).first()
    assert r.s == ["Dr. Hall met J. Smith.", "He left!", "(Why?) no 3.5 here.", "Ok", "new part"]
    assert r.e == "A&#66; ä? &amp; &#x;" and r.w == ["aa bb", "cccccccc", "d"] and r.m == ["aa bb"]
    page = '<base href="http://b.example/x/y"><a href="z">1</a><a href="/r">2</a><a href="//c.example/q">3</a><a href="#f">4</a>'
    got = spark.range(1).select(T.absolute_links(F.lit(page), F.lit("http://b.example/x/")).alias("a"), T.absolute_links(F.lit(page), F.lit("http://b.example/x/"), True).alias("b")).first()
    assert got.a == ["http://b.example/x/z", "http://b.example/r", "http://c.example/q", "http://b.example/x/y#f"] and got.b == ["http://b.example/x/z", "http://b.example/x/y#f"]


def test_language_sets():
    assert X.language_class("latin-1:French").startswith("[a-zA-Zé") and X.confidence_floor(None) == 0.1 and X.confidence_floor(None, bare=True) == 10
    with pytest.raises(KeyError):
        X.language_class("klingon")
    assert L.weight_spec("b0.1,,s1.5,?,x2") == {"b": 0.1, "s": 1.5}


def test_reminders_hold_state(spark):
    path = scratch(spark, "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int").write.parquet(path)
    stream = spark.readStream.schema("k string, x int").parquet(path)
    query = stateful.reminders(stream, "k", 500).writeStream.outputMode("update").format("memory").queryName("told").option("checkpointLocation", scratch(spark, "cp")).start()
    try:
        for _ in range(30):
            query.awaitTermination(1)
            got = {(r.k, r.n) for r in spark.table("told").collect()}
            if got == {("a", 2), ("b", 1)}:
                break
        assert got == {("a", 2), ("b", 1)}
    finally:
        query.stop()


def test_scanner_phases(spark):
    class Shout(H.Scanner):
        schema = "id long"
        started = False

        def start(self, spark):
            Shout.started = True

        def scan(self, batch):
            return batch

    assert H.scanned(spark.range(5), [Shout()])["Shout"].count() == 5 and Shout.started


def test_listeners_hear_of_streams(spark):
    import time

    path, heard = scratch(spark, "in"), []
    spark.createDataFrame([("a",)], "k string").write.parquet(path)
    listener = H.notified(spark, lambda event, facts: heard.append(event))
    try:
        assert stateful.settled(spark.readStream.schema("k string").parquet(path), scratch(spark, "out"), scratch(spark, "cp")).count() == 1
        for _ in range(40):
            if "ended" in heard:
                break
            time.sleep(0.25)
    finally:
        spark.streams.removeListener(listener)
    assert heard[0] == "started" and heard[-1] == "ended"


def test_bigrams_are_found_by_the_trie(spark):
    """No row a character and language: the average probability is added up inside tasks."""
    from lingmill.operators import scoring as S

    rows = spark.createDataFrame([(1, 0, "abab"), (1, 1, "b"), (2, 0, "ABxx")], "doc_id long, line_no int, line string")
    pairs = spark.createDataFrame([("en", "ab", 0.5), ("en", "ba", 0.25), ("de", "ab", 0.125)], "lang string, gram string, p double")
    scores = spark.createDataFrame([(d, i, g, 1.0) for d, i in ((1, 0), (1, 1), (2, 0)) for g in ("en", "de")], "doc_id long, line_no int, guess string, score double")
    out = S.with_bigrams(scores, rows, pairs, ("doc_id", "line_no"), 1.0)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.line_no, r.guess): round(r.score, 9) for r in out.collect()}
    assert got == {(1, 0, "en"): round(1 + 1.25 / 3, 9), (1, 0, "de"): round(1 + 0.25 / 3, 9), (1, 1, "en"): 1.0, (1, 1, "de"): 1.0, (2, 0, "en"): round(1 + 0.5 / 3, 9), (2, 0, "de"): round(1 + 0.125 / 3, 9)}


def test_vectors_and_priors_stay_rows(spark):
    """A line is one row from its text to its mixed scores: no rows per guess are grouped and no array of a document's lines is built, whose copies grew with their square."""
    from lingmill.operators import ngrams as G

    grams = [("de", 3, "die", 0.5), ("en", 3, "the", 0.75), ("en", 3, "die", 0.125)]
    model = spark.createDataFrame(grams, "lang string, n int, gram string, weight double")
    texts = ["The die", "", "die die", "xyz", "the" * 30, "DIE  the"] * 300
    lines = spark.createDataFrame([(d, i, len(t), 1, t) for d in (1, 2) for i, t in enumerate(texts)], "doc_id long, line_no int, size int, gap int, line string")
    out = S.priors(G.vectors(lines, model, lengths=(3,)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "aggregate(" not in plan and plan.count("Exchange") == 1
    rows = lines.collect()
    want = {(r.doc_id, r.line_no): r.v for r in S.priors(S.vectors(G.identify_joined(lines, model, lengths=(3,)), ("doc_id", "line_no")).join(lines, ["doc_id", "line_no"])).collect()}
    got = {(r.doc_id, r.line_no): r.v for r in out.collect()}
    assert got.keys() == want.keys() == {(r.doc_id, r.line_no) for r in rows if r.line not in ("", "xyz")} and all(got[k] == pytest.approx(want[k]) for k in want)
