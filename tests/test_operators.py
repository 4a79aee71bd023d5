"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from lingmill.functions.text import decode_entities, list_regex, romanised
from lingmill.operators import cluster, ngrams, retrieval, sampling, strings
from lingmill.sources import files
from lingmill.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("&#65&#66;", "A&#66;"), ("&#233;x&amp;", "éx&amp;"), ("&#1114111;", "?")])
def test_decimal_entities(spark, text, want):
    assert one(spark, decode_entities(F.lit(text))) == want


def test_quantised_one(spark):
    q = one(spark, ngrams.quantised(F.lit(1).cast("long")))
    assert (q.mantissa, q.exponent) == (0x00020000, 3)


def test_scaling(spark):
    assert one(spark, ngrams.scaled(F.lit(0.01), 0.5)) == pytest.approx(1.0)
    assert one(spark, ngrams.unscaled(ngrams.scaled(F.lit(0.2), -3), -3)) == pytest.approx(0.2)


@pytest.mark.parametrize(("counts", "k", "kept"), [([("a", 5), ("b", 3), ("c", 3), ("d", 2)], 2, "abc"), ([("a", 1), ("b", 1)], 3, "")])
def test_top_k_keeps_ties(spark, counts, k, kept):
    df = spark.createDataFrame([("x", g, c) for g, c in counts], "lang string, gram string, cnt long")
    assert "".join(sorted(r.gram for r in ngrams.top_k(df, k).collect())) == kept


def test_confidence_golden(spark):
    assert one(spark, strings.confidence(F.lit("abcd"))) == pytest.approx(8.0)
    assert one(spark, strings.blended(F.lit(8.0), F.lit(1.0), F.lit(10))) == pytest.approx(26 / 3)


def test_uniform_bytes_golden(spark):
    assert one(spark, sampling.uniform_bytes(F.array(*[F.lit(1).cast("long")] * 4), 2)) == [True, False, True, True]


def test_tfidf_golden(spark):
    assert one(spark, retrieval.idf(F.lit(2), F.lit(8))) == pytest.approx(1.386294, abs=1e-6)
    assert one(spark, retrieval.tf_idf(F.lit(6), F.lit(2), F.lit(8))) == pytest.approx(4.158883, abs=1e-6)


def test_accuracy_golden(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "b"), ("b", "b"), ("b", "b")], "lang string, guess string")
    r = ngrams.accuracy_overall(ngrams.accuracy(rows)).first()
    assert (r.micro, r.macro) == (0.25, 0.5)


def test_ranges_and_weights():
    assert files.ranges("9,32-33,0x100-0x24F,x,7") == [(9, 9), (32, 33), (0x100, 0x24F)]
    assert files.weight_spec("b0.1,,s1.5,??,c2") == {"b": 0.1, "s": 1.5}


def test_model_text_round_trip(spark, tmp_path):
    (tmp_path / "m.lid").write_text("TotalCount: 9\nLang: xx=Test\n5\ta\\ b\n-3\tc\\td\n")
    models, grams = files.model_texts(spark, str(tmp_path))
    assert models.first().directives["Lang"] == "xx=Test"
    assert sorted((r.cnt, r.gram, r.is_stop) for r in grams.collect()) == [(3, "c\td", True), (5, "a b", False)]
    assert sorted(r.value for r in files.model_lines(grams).collect()) == ["-3\tc\\td", "5\ta\\ b"]


def test_charset_sniffs_and_strings():
    text = "hello world, readable text"
    assert strings.sniff_utf8(("é" * 9).encode()) and not strings.sniff_ascii16(b"plain text in bytes")
    data = bytes(8) + text.encode("utf-16-le") + bytes(8)
    assert [s["text"] for s in strings.best_strings(data, strings.rank_charsets(data), 8)] == [text]


def test_romanised_and_regex():
    assert romanised("Москва") == "Moskva"
    assert list_regex("(ab,cd)+%*") == "(?:ab|cd)+\\*"


def test_clusters_of_two_directions(spark):
    v = spark.createDataFrame([(i, [1.0, 0.05 * i] if i < 3 else [0.05 * i, 1.0]) for i in range(6)], "vec_id long, v array<double>")
    for got in (cluster.group_average(v, 0.8, limit=1000), cluster.agglomerative(v, 2), cluster.spectral(v, 2)):
        label = {r.vec_id: r.cluster for r in got.collect()}
        assert label[0] == label[1] == label[2] != label[3] == label[4] == label[5]


def _told(spark, folder, chunks, schema, run):
    """What run() gives over a stream whose rows come in these batches."""
    source = str(folder / "in")
    out = []
    for n, batch in enumerate(chunks):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = run(stream).writeStream.foreachBatch(lambda df, n: out.append(df.collect())).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(out) >= len(chunks)
    return [tuple(r) for rows in out for r in rows]


@pytest.mark.parametrize("order", [[0, 1, 2], [1, 0, 2], [2, 1, 0], [2, 0, 1]])
@pytest.mark.parametrize("each", [1, 3])
def test_streams_carry_state_in_any_order(spark, tmp_path, order, each):
    """Chunks in one batch or in one each, in any order, one of them twice: the lines are those of the whole text."""
    chunks = [("a", k, k == 2, t) for k, t in enumerate(["ab\ncd", "ef\ngh", "ij\nk"])]
    rows = [chunks[k] for k in order] + [chunks[order[0]]]
    batches = [rows[k : k + each] for k in range(0, len(rows), each)]
    got = _told(spark, tmp_path, batches, "path string, seq int, last boolean, text string", stateful.carry_over)
    assert got == [("a", "ab"), ("a", "cdef"), ("a", "ghij"), ("a", "k")]


def test_windows_and_redetections_over_batches(spark, tmp_path):
    text = "".join(chr(97 + k % 26) for k in range(50))
    chunks = [[("p", k, k == 4, text[10 * k : 10 * k + 10])] for k in (3, 0, 4, 2, 1)]
    got = _told(spark, tmp_path / "w", chunks, "path string, seq int, last boolean, text string", lambda s: stateful.count_windows(s, 16))
    assert got == [("p", b, text[b : b + 16]) for b in range(0, 35, 4)]
    rows = [("p", 0, False, 0, 60), ("p", 1, False, 60, 60), ("p", 2, False, 150, 10), ("p", 3, True, 170, 5)]
    got = _told(spark, tmp_path / "r", [[rows[k]] for k in (2, 3, 0, 1)], "path string, seq int, last boolean, offset long, size int", stateful.redetections)
    assert got == [("p", 150)]


def test_streams_end_by_time_where_no_last_chunk_comes(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, False, "one\ntw"), ("a", 2, False, "late")], "path string, seq int, last boolean, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("path string, seq int, last boolean, text string").parquet(source)
    q = stateful.carry_over(stream, 500).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            got = [r.line for r in spark.sql("select * from ended").collect()]
            if len(got) == 2:
                break
        assert got == ["one", "twlate"]
    finally:
        q.stop()


def test_charsets_are_ranked_again_along_a_file(spark):
    head, wide, tail = "A plain header line of letters. " * 20, "wide letters of a second part ", "où é à la fin déjà très près né " * 6
    data = head.encode() + bytes(160) + (wide * 4).encode("utf-16-le") + bytes(160) + tail.encode()
    got = {(r.encoding, r.text) for r in strings.extract(spark.createDataFrame([("f", bytearray(data))], "path string, content binary")).collect()}
    assert got == {("utf-8", head), ("utf-16-le", wide * 4), ("utf-8", tail)}


def test_longest_match_has_no_bound(spark):
    long = " ".join(f"w{i % 7}{i // 5}" for i in range(23))
    texts = [f"a b {long} c", f"{long}", "a b a b a b", "x", None, f"d {long} c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {i: (t or "").split() for i, t in enumerate(texts)}
    every = [(i, p) for i, w in words.items() for p in range(len(w))]

    def shared(a, b):
        x, y = words[a[0]][a[1] :], words[b[0]][b[1] :]
        return next((n for n, (v, u) in enumerate(zip(x, y)) if v != u), min(len(x), len(y)))

    want = {a: max([1, *(shared(a, b) for b in every if b != a)]) for a in every}
    assert max(want.values()) == 24
    assert {(r.doc_id, r.pos): r.n for r in retrieval.longest_match(docs).collect()} == want


def test_extraction_against_a_plain_scan():
    """Runs by regular expression equal a scan of one character after the other, in every charset."""
    import random

    draw = random.Random(17)

    def plain(data, wide, charset):
        out = set()
        for shift in range(wide):
            at = shift
            while at < len(data):
                start, text = at, ""
                while at < len(data):
                    for size in (wide, 2 * wide) if wide > 1 else (1, 2, 3, 4):
                        try:
                            c = data[at : at + size].decode(charset)
                        except UnicodeDecodeError:
                            continue
                        if len(c) == 1:
                            break
                    else:
                        break
                    if not (c.isprintable() or c in "\t\r\n") or c in "\xa0\u3000\u2028":
                        break
                    text, at = text + c, at + len(c.encode(charset))
                if at - start >= 4 and any(x.isalnum() for x in text):
                    out.add((start, at, text))
                at = max(at, start) + wide if at == start or at < len(data) else at
        return out

    pieces = [b"plain words", "d\u00e9j\u00e0 vu".encode(), "wide".encode("utf-16-le"), "\u65e5\u672c".encode("utf-16-be"), b"\x00\x00", b"\xff\xfe", b"\x01", "\U0001f600x".encode(), b"~!"]
    for _ in range(60):
        data = b"".join(draw.choices(pieces, k=draw.randint(0, 9)))
        for charset, wide in (("ascii", 1), ("latin-1", 1), ("utf-8", 1)):
            got = set(strings._Runs(data, charset, 4, 1000).between(0, len(data)))
            assert got == plain(data, wide, charset), (charset, data)
    assert [s["text"] for s in strings.best_strings(b"\x00" + "shifted text".encode("utf-16-le"), ["utf-16-le"])] == ["shifted text"]


def test_strings_are_read_again_in_their_languages_charset(spark):
    rows = [("d\u00e9j\u00e0 vu, d\u00e9j\u00e0".encode().decode("latin-1"), "ISO-8859-1", 20, 0.9, "UTF-8"), ("short", "ISO-8859-1", 5, 0.9, "UTF-8"), ("unsure and long text", "ISO-8859-1", 20, 0.1, "UTF-8"), ("no language is known", "ISO-8859-1", 20, 0.9, None)]
    got = strings.reextracted(spark.createDataFrame(rows, "text string, encoding string, length int, score double, charset string")).collect()
    assert [(r.text, r.encoding, r.switched) for r in got] == [("d\u00e9j\u00e0 vu, d\u00e9j\u00e0", "UTF-8", True), *((t, e, False) for t, e, *_ in rows[1:])]
