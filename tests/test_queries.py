"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from lingmill import plans
from lingmill.session import TABLES

DIR = "/root/testdata/sf0.001"
CHOSEN = ["trigram_topk_by_lang", "ngram_scaled_weights", "accuracy_micro_macro", "sample_uniform_bytes", "list_sets", "tfidf_values", "similarity_jensen_shannon", "frame_inherited", "string_confidence", "join_range_steps", "span_ordered", "interval_merged", "interval_covered", "prefix_completion", "cluster_average_linkage", "bounded_neighbours", "weight_scaling", "similarity_tripartite", "grow_seeds", "scores_with_bigrams", "score_vectors", "source_models", "source_file_types", "frame_store", "frame_inheritance_modes", "frame_lines", "stream_lines", "stream_redetections", "hook_similarity", "strings_reextracted", "strings_shifted", "text_sentences", "text_wrap", "entities_decoded", "html_absolute_links", "language_sets", "lm_extended", "training_grid", "cluster_vector_linkage", "byte_model", "charsets_ranked", "dictionary_cover_longest"]


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(map(plain, df.select(*cols).collect()), key=repr)
    rel = duck.execute(plans.SQL[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == cols
    assert sorted((plain(r[at[c]] for c in cols) for r in rel.fetchall()), key=repr) == got


def test_every_sql_belongs_to_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES)


@pytest.mark.parametrize("name", ["label_lines", "accuracy_report", "model_statistics"])
def test_full_models_equal_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, f"{name}_full")


def test_full_models_have_all_lengths(spark):
    rows = plans.QUERIES["model_statistics_full"](spark, DIR).collect()
    assert {r.n for r in rows} == {3, 4, 5, 6} and max(r.postings for r in rows) > 500
