"""Records of words: the word behind each comes from its own document, without a join."""

from pyspark.sql import functions as F

from lingmill import plans
from lingmill.operators import retrieval as R


def test_records_need_no_join(spark, tmp_path):
    texts = {1: "The  cat\tsat", 2: "", 3: None, 4: "one", None: "a b a b a", 5: " \n", 6: "w " * 3000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = plans.QUERIES["lm_records"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "hashpartitioning" not in plan
    want = [(k, i, w, ws[i + 1] if i + 1 < len(ws) else None) for k, t in texts.items() for ws in [(t or "").lower().split()] for i, w in enumerate(ws)]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert dict(df.dtypes) == {"doc_id": "bigint", "pos": "bigint", "term": "string", "next_term": "string"}


def test_records_with_another_key(spark):
    docs = spark.range(1).select(F.lit("k").alias("name"), F.lit("p q").alias("text"))
    assert sorted(map(tuple, R.records(docs, "name").collect())) == [("k", 0, "p", "q"), ("k", 1, "q", None)]
