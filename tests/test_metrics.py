"""Hand-checked values of metrics, functions and operators, and figures that must not move."""

import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import hashing
from memloom.functions import metrics as M
from memloom.functions import text as T
from memloom.operators import addresses as A
from memloom.operators import evaluate as E
from memloom.operators import volumes as V


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def strings(*x):
    return F.array(*map(F.lit, x)).cast("array<string>")


def span(session, a, b):
    return F.struct(F.lit(session).alias("session_id"), F.lit(a).cast("long").alias("start_turn"), F.lit(b).cast("long").alias("end_turn"), F.lit(0.0).alias("score"))


def test_set_and_token_f1(value):
    assert value(M.set_f1(strings("A", " b"), strings("a", "c"))) == 0.5
    assert value(M.set_f1(strings(), strings())) == 1.0 and value(M.set_f1(strings(), strings("x"))) == 0.0
    assert value(M.token_f1(F.lit("the red car"), F.lit("red car"))) == pytest.approx(0.8)
    assert value(M.soft_step_f1(strings("a b", "c d"), strings("c d", "a x"))) == pytest.approx(0.75)
    assert value(M.causal_order(strings("a b", "c d"), strings("c d", "a x"))) == pytest.approx(0.5)


def test_spans_and_ranks(value):
    assert value(M.span_iou(span("s", 2, 6), span("s", 4, 9))) == pytest.approx(0.375)
    assert value(M.span_iou(span("s", 2, 6), span("t", 2, 6))) == 0 and value(M.span_iou(span("s", 0, 1), span("s", 3, 4))) == 0
    gold, pred = strings("s2"), strings("s1", "s2")
    assert [value(M.recall_at(gold, pred, k)) for k in (1, 3)] == [0.0, 1.0] and value(M.mrr(gold, pred)) == 0.5


def test_text_functions(value):
    assert value(T.sentence_chunks(F.lit("Hello world one. Short. Another long sentence here! Final sentence okay"))) == ["Hello world one. Another long sentence here", "Final sentence okay"]
    assert value(T.entities(F.lit("I met Alice and Bob in Paris with Carol"))) == ["ALI", "BOB", "PAR"]
    assert value(T.normalise(F.lit(None).cast("string"))) == "" and value(T.label(F.lit(" - "))) == "unknown"


@pytest.mark.parametrize("text,wanted", [("a", 2310), ("abc", 3837), ("hello__world", 3293), ("été", 3801)])
def test_native_hash(value, text, wanted):
    assert value(hashing.fnv(F.lit(text), 4096)) == wanted == A._fnv(text, 4096)


def test_concentration_by_hand(spark):
    from memloom.operators import flows

    rows = spark.createDataFrame([("s", "a", "b", 2.0), ("s", "b", "c", 1.0), ("s", "c", "a", 1.0)], "session_id string, src string, dst string, n double")
    got = flows.concentration(rows, "x").first()
    assert got.x_entropy_norm == pytest.approx(0.946395, abs=1e-6) and got.x_js_to_uniform == pytest.approx(0.014363, abs=1e-6) and got.x_top8_mass == pytest.approx(1.0)
    values = spark.createDataFrame([("s", 0.0), ("s", 0.0), ("s", 3.0), ("t", 1.0), ("t", 1.0), ("t", 1.0)], "session_id string, x double")
    assert {r.session_id: round(r.gini, 4) for r in flows.gini(values, "x").collect()} == {"s": 0.6667, "t": 0.0}


def test_total_of_known_subscores():
    parts = dict(zip(E.WEIGHTS, (0.8, 0.5, 0.4, 0.3, 0.6, 0.9), strict=True))
    assert sum(E.WEIGHTS[k] * v for k, v in parts.items()) == pytest.approx(0.566) and math.isclose(sum(E.WEIGHTS.values()), 1.0)


def test_quantisation_and_blur(spark):
    rows = spark.createDataFrame([("a", 0, 0, i, x) for i, x in enumerate((1.0, 0.0, -1.0))], "id string, t int, u int, v int, value double")
    got = {r.v: (r.q, r.scale) for r in V.quantise(rows).collect()}
    assert [got[i][0] for i in range(3)] == [32767, 0, -32767] and got[0][1] == pytest.approx(1 / 32767)
    flat = spark.createDataFrame([("a", t, u, v, 2.0) for t in range(4) for u in range(4) for v in range(4)], "id string, t int, u int, v int, value double")
    assert all(r.value == pytest.approx(2.0) for r in V.box_blur(flat, shape=(4, 4, 4)).collect())
    assert V.error(flat, flat, (4, 4, 4)).first().psnr == 120.0


def test_dilation_stays_inside(spark):
    one = spark.createDataFrame([("a", 0, 0, 0)], "id string, t int, u int, v int")
    assert V.dilate(one, 1, (4, 4, 4)).count() == 8


def test_gates_equal_dense_vectors(spark):
    """The relational gate against the same formula on dense complex vectors."""
    import numpy as np

    items = spark.createDataFrame([("s", 0, "f1", 2.0), ("s", 0, "f2", 1.0), ("s", 1, "f1", 1.5)], "session_id string, step_idx int, feature string, weight double")
    context = spark.createDataFrame([("s", 0, "c1", 1.0), ("s", 0, "f2", 0.5), ("s", 1, "f1", 2.0)], "session_id string, step_idx int, feature string, weight double")

    def proto(name):
        v = np.zeros(A.DIM, complex)
        for lane in range(A.LANES):
            angle = 2 * np.pi * A._fnv(f"phase::{name}", 8192) / 8192 + 2 * np.pi * lane / A.LANES
            v[A._fnv(f"{name}::lane::{lane}", A.DIM)] += (-1 if A._fnv(f"{name}::sign::{lane}", 2) == 0 else 1) * np.exp(1j * angle)
        return v / np.linalg.norm(v)

    got = {(r.step_idx, r.address): r.weight for r in A.gated(items, context).collect()}
    for step, said, held in ((0, {"f1": 2.0, "f2": 1.0}, {"c1": 1.0, "f2": 0.5}), (1, {"f1": 1.5}, {"f1": 2.0})):
        ctx = sum(w * proto(n) for n, w in held.items())
        ctx = ctx / np.linalg.norm(ctx)
        for name, weight in said.items():
            z = np.vdot(ctx, proto(name))
            gate = 1 / (1 + np.exp(-np.clip(3.2 * z.real + 1.4 * abs(z) + 0.6 * np.cos(np.angle(z + 1e-12)), -20, 20)))
            assert got[(step, A._fnv(name, A.ADDRESSES))] == pytest.approx(weight * gate, rel=1e-6)


def test_carry_feeds_the_step_before(spark):
    rows = spark.createDataFrame([("s", 0, "x", 2.0, [(7, 1.0)]), ("s", 1, "y", 2.0, [(9, 4.0)])], "session_id string, step_idx long, state string, step_weight double, addresses array<struct<address:long,weight:double>>")
    got = {(r.step_idx, r.address): r.weight for r in A.carried(rows).collect()}
    assert got == {(0, 7): 1.0, (1, 9): 4.0, (1, A._fnv("carry_constraint::7::y", A.ADDRESSES)): 1.5}


def test_gold_as_prediction_is_perfect(spark, sf_dir):
    from memloom.plans import evaluation

    items = evaluation.items(spark, sf_dir)
    same = items.select("item_id", F.lit("fixed_budget").alias("variant"), *(F.col(c).alias(c.replace("gold_", "pred_")) for c in items.columns if c.startswith("gold_")), F.lit(None).cast("map<string,double>").alias("pred_stats"))
    for r in E.item_metrics(items, same).collect():
        assert r.recall_5 == r.entity_f1 == r.allowed_set_f1 == r.forbidden_set_f1 == r.required_set_f1 == 1.0 and not r.missing
