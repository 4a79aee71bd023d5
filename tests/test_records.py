"""Records in strings, spans and intervals on hand-made cases."""

from pyspark.sql import functions as F

from lingmill.functions import records as R
from lingmill.operators import intervals as I


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_paths_and_numbers(spark):
    p = F.lit("a/b.c/d.tar.gz")
    assert one(spark, R.directory(p), R.base_name(p), R.extension(p), R.with_extension(p, "x")) == ("a/b.c/", "d.tar.gz", "gz", "a/b.c/d.tar.x")
    bare = F.lit("b.c/d")
    assert one(spark, R.extension(bare), R.with_extension(bare, "x")) == ("", "b.c/d.x")
    assert one(spark, R.whole_number(F.lit("n=-12,5")), R.whole_number(F.lit("none")), R.whole_number(F.lit("9" * 30))) == (-12, None, None)


def test_tagged_words_and_completion(spark):
    assert one(spark, R.tagged_word(F.lit("w.+x.+.+y"), ".+"))[0].asDict() == {"word": "w", "tags": ["x", "y"]}
    assert one(spark, R.tagged_word(F.lit("w"), "+"))[0].asDict() == {"word": "w", "tags": []}
    assert one(spark, R.completion(F.lit("abcd"), F.lit("abx")), R.completion(F.lit("a"), F.lit("b")), R.completion(F.lit(""), F.lit("b"))) == ("ab", "", "")


def test_byte_sets(spark):
    digits, a = R.byte_set((48, 57)), R.byte_set(97)
    assert R.must_be(a, 97) and not R.must_be(digits, 48) and R.could_be(digits, 50)
    pattern = R.pattern_of([a, digits])
    assert one(spark, *(F.lit(x).rlike(pattern) for x in ("a7", "b7", "a77"))) == (True, False, False)
    assert one(spark, F.lit("a").rlike(R.pattern_of([frozenset()])))[0] is False


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 1, 2), (1, 9, 10), (2, 3, 4), (2, 3, 4)], "k int, lo int, hi int")
    got = I.merged(rows, "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 7, 3), (1, 9, 10, 1), (2, 3, 4, 2)]
    points = spark.createDataFrame([(1, 7), (1, 6), (1, 9), (2, 2), (3, 1)], "k int, at int")
    assert {(r.k, r.at): r.covered for r in I.covered(points, got, "k").collect()} == {(1, 7): False, (1, 6): True, (1, 9): True, (2, 2): False, (3, 1): False}
    assert I.merged(rows.limit(0), "k").count() == 0


def test_spans(spark):
    spans = spark.createDataFrame([(1, 0, 2, 0.5, 1.0), (1, 0, 2, 0.25, 3.0), (1, 0, 4, 0.1, 1.0)], "k int, start int, end int, score double, weight double")
    assert sorted((r.end, r.score, r.weight, r.n) for r in I.combined(spans, ["k"]).collect()) == [(2, 0.75, 3.0, 2), (4, 0.1, 1.0, 1)]
    row = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end", "score", "weight")).alias("s"))
    ordered = row.select(I.span_order(F.col("s")).alias("s")).first().s
    assert [(x.end, x.score) for x in ordered] == [(4, 0.1), (2, 0.5), (2, 0.25)]
    assert len(row.select(I.without(F.col("s"), lambda x: x["end"] == 2).alias("s")).first().s) == 1


def test_hierarchical_seeds_find_separate_groups(spark):
    from lingmill.operators import cluster as C

    ways = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(10 * g + i, [x + 0.01 * i * (j == (g + 1) % 3) for j, x in enumerate(w)]) for g, w in enumerate(ways) for i in range(6)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    seeds = C.hierarchical_seeds(v, 2)
    assert seeds.count() == 2
    got = C.k_means(v, seeds, 3)
    assert got.count() == 18 and got.select("cluster").distinct().count() == 2


def test_zero_and_empty_vectors(spark):
    from lingmill.operators import cluster, similarity

    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, v array<double>")
    seeds = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, c array<double>")
    assert {(r.vec_id, r.cluster, r.sim) for r in cluster.assign(v, seeds).collect()} == {(0, 0, 0.0), (1, 0, 1.0), (2, 1, 1.0)}
    pairs = spark.createDataFrame([([], [1.0, 2.0]), ([1.0, 2.0], []), ([], []), ([0.0], [0.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    every = similarity.measures(F.col("a"), F.col("b"))
    rows = pairs.select(*(similarity.similarity(n, F.col("a"), F.col("b")).alias(n) for n in every)).collect()
    assert set(rows[0]) == set(rows[1]) == {0.0} and set(rows[2]) == {1.0} and len(every) > 25


def test_escaped_grams_come_back(spark):
    from lingmill.sources import files

    grams = ["\ue000", "a\\b", "\\\\ \t", "\\0\0", "\\ t\\\\\\n\n", " ", "\\"]
    df = spark.createDataFrame([(g,) for g in grams], "g string").withColumn("e", files.escape_gram(F.col("g")))
    assert [(r.g, r.b) for r in df.select("g", files.unescape_gram(F.col("e")).alias("b")).collect()] == [(g, g) for g in grams]


def test_types_of_bytes_in_units_of_two(spark):
    from lingmill.sources import stores

    known = {"90041004": "binary", "61006200": "utf-16-le", "00610062": "utf-16-be", "6162": "ascii", "c3a9": "utf-8", "": "empty", "0061000a0462": "utf-16-be", "1000200130023003": "binary"}
    df = spark.createDataFrame([(h, bytearray.fromhex(h)) for h in known], "h string, b binary")
    assert {r.h: r.t for r in df.select("h", stores.file_type(F.col("b")).alias("t")).collect()} == known


def test_scores_of_null_counts(spark):
    from lingmill.operators import scoring

    df = spark.createDataFrame([("a", 2), ("b", None)], "gram string, cnt long")
    assert {(r.gram, r.score) for r in scoring.mapped(df, lambda n: n * 0.5).collect()} == {("a", 1.0), ("b", None)}
