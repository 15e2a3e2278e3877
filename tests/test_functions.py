"""Functions called from SQL, and the feature store."""

import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import hashing, sql
from memloom.functions import text as T
from memloom.plans.retrieval import bucket_idf, hashed_counts
from memloom.sources.features import FeatureStore


def test_functions_in_sql(spark):
    sql.register(spark)
    texts = ["Über Caching_2 and the-plan!", "", None, "One sentence here. Another one there! And a third one? x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = spark.sql("SELECT id, ml_tokens(text) AS k, ml_normalise(text) AS n, ml_label(text) AS l, ml_fnv64(text) AS h FROM {rows} ORDER BY id", rows=rows).collect()
    wanted = rows.select("id", T.tokens(F.col("text")).alias("k"), T.normalise(F.col("text")).alias("n"), T.label(F.col("text")).alias("l")).orderBy("id").collect()
    assert [(r.k, r.n, r.l) for r in got] == [(r.k, r.n, r.l) for r in wanted]
    assert [r.h for r in got] == hashing.fnv_many(texts).view("int64").tolist()
    assert spark.sql("SELECT ml_idf(9, 1)").first()[0] == pytest.approx(math.log(10 / 2) + 1)
    assert spark.sql("SELECT ml_cosine(array(1D, 2D), array(2D, 1D))").first()[0] == pytest.approx(0.8)
    each = spark.sql("SELECT id, t.place, t.token FROM {rows}, LATERAL ml_each_token(text) t", rows=rows).collect()
    assert sorted((r.id, r.place, r.token) for r in each) == [(r.id, i, t) for r in wanted for i, t in enumerate(r.k)]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_chunks_in_sql(spark, sf_dir, size):
    sql.register(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    got = spark.sql("SELECT doc_id, t.step_idx, t.chunk FROM {rows}, LATERAL ml_each_chunk(text, {n}) t", rows=rows, n=size).collect()
    wanted = rows.select("doc_id", F.posexplode(T.sentence_chunks(F.col("text"), size)).alias("step_idx", "chunk")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and got


def test_feature_store_works_out_new_contents_only(spark):
    asked = []

    def make(fresh):
        asked.append(sorted(r.text for r in fresh.collect()))
        return hashed_counts(fresh, "key")

    texts = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id long, text string")
    store = FeatureStore(spark, "features_of_test", make)
    store.drop()
    one, two = texts("alpha beta", "beta gamma", "alpha beta", None), texts("beta gamma", "delta alpha", "")
    assert store.add(one, "one") == 3 and store.add(two, "two") == 1
    assert store.add(one, "one") == 3 and store.add(two, "two") == 1  # repeated batches replace themselves
    assert store.add(texts("alpha beta", "delta alpha"), "three") == 0
    assert asked == [["", "alpha beta", "beta gamma"], ["delta alpha"]] * 2 + [[]]
    every = texts("alpha beta", "beta gamma", "", "delta alpha")
    whole = {r.bucket: r.idf for r in bucket_idf(hashed_counts(every, "id")).collect()}
    assert {r.bucket: r.idf for r in store.idf().collect()} == pytest.approx(whole)
    found = {r.id: (r.raw_bytes, sum(r.tf)) for r in store.features(one, "id").collect()}
    assert found == {0: (10, 3), 1: (10, 3), 2: (10, 3), 3: (0, 0)}
    store.drop()


@pytest.mark.parametrize("at_once", [7, 20_000])
def test_lexical_nearest_equals_the_inverted_join(spark, at_once):
    import random

    from memloom.operators import rank

    dice = random.Random(3)
    words = [f"word{i}" for i in range(40)] + ["the"] * 30 + ["ab", "Über", "X_y-1"]
    text = lambda n: " ".join(dice.choices(words, k=n))
    asked = spark.createDataFrame([(i, text(dice.choice((1, 4, 25)))) for i in range(30)] + [(99, ""), (98, None)], "item_id long, text string")
    held = spark.createDataFrame([(i, text(dice.choice((0, 3, 60)))) for i in range(700)] + [(900, None)], "session_id long, text string").repartition(3)
    got = rank.lexical_nearest(asked, held, 6, at_once).collect()
    wanted = rank.top_k(rank.lexical_scores(asked, held), 6).collect()
    key = lambda r: (r.item_id, r.session_id, r.lexical, r["rank"])
    assert sorted(map(key, got)) == sorted(map(key, wanted)) and got
