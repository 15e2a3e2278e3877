"""The two-stage ranking against sorted lists."""

import random

from pyspark.sql import functions as F

from memloom import plans
from memloom.operators import rank


def test_two_stage_equals_sorted_lists(spark):
    pick = random.Random(5)
    items, docs = ["q1", "q2", "q3"], [f"d{i:03}" for i in range(90)]
    lexical = {(q, d): round(pick.random(), 4) for q in items[:2] for d in docs if pick.random() < 0.5}
    # d089 has the best volume score and no lexical bucket in common.
    lexical.pop(("q1", "d089"), None)
    shadow = {(q, d): round(pick.random(), 4) for q in items[:2] for d in docs if pick.random() < 0.6} | {("q1", "d089"): 1.5}
    table = lambda scores, name: spark.createDataFrame([(*k, v) for k, v in scores.items()], f"item_id string, session_id string, {name} double")
    ids = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    made = rank.two_stage(ids(items, "item_id"), ids(docs, "session_id"), table(lexical, "lexical"), table(shadow, "shadow"))
    got = {(r.item_id, r["rank"]): (r.session_id, r.short) for r in made.collect()}
    assert len(got) == len(items) * len(docs)
    for q in items:
        a, b = ({d: s.get((q, d), 0.0) for d in docs} for s in (lexical, shadow))
        mix = {d: round(0.65 * a[d] + 0.35 * b[d], 9) for d in docs}
        best = lambda s, n: set(sorted(docs, key=lambda d: (-s[d], d))[:n])
        short = best(mix, 24) | best(a, 24) | best(b, 12)
        order = sorted(docs, key=lambda d: (d not in short, -mix[d], d))
        assert [got[(q, i + 1)] for i in range(len(docs))] == [(d, d in short) for d in order]
    assert any(d == "d089" and short for (q, _), (d, short) in got.items() if q == "q1")


def test_registered_ranking_is_whole(spark, sf_dir):
    ranked = plans.QUERIES["shortlist_rerank"](spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.sum(F.col("short").cast("int")).alias("short"))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct().count()
    rows = ranked.collect()
    assert n > 60 and rows and all(r.n == r["last"] == n and r.short <= 60 for r in rows)
