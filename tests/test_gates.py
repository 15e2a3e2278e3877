"""Encoders with gates against dense vectors, step by step."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import addresses as A
from memloom.operators import encoders as E
from memloom.operators import states as S
from memloom.plans import states as P


def real(entries, dim=A.DIM):
    v = np.zeros(dim)
    for i, x in entries:
        v[i] += x
    return v / (np.linalg.norm(v) + 1e-12)


def proto(name):
    v = np.zeros(A.DIM, complex)
    for lane in range(A.LANES):
        angle = 2 * np.pi * A._fnv(f"phase::{name}", 8192) / 8192 + 2 * np.pi * lane / A.LANES
        v[A._fnv(f"{name}::lane::{lane}", A.DIM)] += (-1 if A._fnv(f"{name}::sign::{lane}", 2) == 0 else 1) * np.exp(1j * angle)
    return v / np.linalg.norm(v)


def items_of(rows, name):
    return E.encoder_rows(rows, name).select("session_id", "step_idx", F.explode("items").alias("i")).select("session_id", "step_idx", "i.feature", "i.weight")


def sigmoid(x):
    return 1 / (1 + math.exp(-max(min(x, 20), -20)))


def grams_of(tokens, n):
    return ["__".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def strongest(sums):
    return sorted(sums, key=lambda a: (-round(sums[a], 9), a))[:24]


@pytest.fixture(scope="module")
def texts():
    words = [f"word{i * i % 37}" for i in range(230)]
    long = ". ".join(" ".join(words[i : i + 11]) for i in range(0, 230, 11))
    return {"a": long, "b": "Short text about word1 and word4. Another one here", "c": "word9 word9 word9"}


def test_naive_gates_equal_dense_vectors(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "session_id string, text string")
    chunks = S.chunks(rows)
    made = A.naive_gated(chunks, A.gram_idf(rows.select("session_id", F.col("text").alias("chunk"))))
    got = {(r.session_id, r.step_idx, r.address): (r.weight, r.gate) for r in made.collect()}
    tokens = {r.session_id: r.k for r in rows.select("session_id", T.tokens(F.col("text")).alias("k")).collect()}
    df = Counter(g for k in tokens.values() for g in {g for n in (1, 2, 3) for g in grams_of(k, n)})
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    held, wanted = defaultdict(list), {}
    for r in chunks.select("session_id", "step_idx", T.tokens(F.col("chunk")).alias("k")).orderBy("session_id", "step_idx").collect():
        held[r.session_id] += r.k
        last = held[r.session_id][-64:]
        ctx = [(g, f * idf.get(g, 1.0)) for n, f in ((1, 1.0), (2, 1.25), (3, 1.25)) for g in grams_of(last, n)]
        ctx = real([(A._fnv(g, A.DIM), w * (-1 if A._fnv(f"sgn::{g}", 2) == 0 else 1)) for g, w in ctx])
        sums = defaultdict(float)
        for n, f in ((1, 1.0), (2, 1.6), (3, 1.8)):
            for g, c in Counter(grams_of(r.k, n)).items():
                for head in range(4):
                    sums[A._fnv(f"{n}::{head}::{g}", A.ADDRESSES)] += f * math.sqrt(c) * idf.get(g, 1.0) / 4
        for a, w in sums.items():
            own = real([(A._fnv(f"{a}::lane::{lane}", A.DIM), -1 if A._fnv(f"{a}::sign::{lane}", 2) == 0 else 1) for lane in range(4)])
            wanted[(r.session_id, r.step_idx, a)] = w * (gate := sigmoid(2.5 * ctx @ own)), gate
    assert max(Counter(k[:2] for k in wanted).values()) > 100
    assert got.keys() == wanted.keys()
    for k, pair in wanted.items():
        assert got[k] == pytest.approx(pair, rel=1e-6)


def dense_steps(items, contexts, phases, signal, carry, most, context_carry=None):
    """Addresses of one session: items(i), contexts(first step of the window, i) and carried addresses on dense vectors."""
    before, out = [], {}
    for i, phase in enumerate(phases):
        ctx = sum((w * proto(f) for f, w in contexts(max(0, i - 7), i)), np.zeros(A.DIM, complex))
        if context_carry:
            ctx += sum((0.6 * proto(context_carry.format(a)) for a in before[:8]), np.zeros(A.DIM, complex))
        ctx /= np.linalg.norm(ctx) + 1e-12
        sums, gates = defaultdict(float), defaultdict(float)
        for f, w in [*items(i), *((f, w) for a in before[:most] for f, w in [carry(a, i)])]:
            g = sigmoid(signal(np.vdot(ctx, proto(f) * np.exp(1j * phase))))
            a = A._fnv(f, A.ADDRESSES)
            sums[a] += w * g
            gates[a] = max(gates[a], g)
        top = strongest(sums)
        before = top[:10]
        out |= {(i, a): (sums[a], gates[a]) for a in top}
    return out


@pytest.fixture(scope="module")
def longest(spark, sf_dir):
    """The states of the session with the most steps."""
    rows = P.rule_rows(spark, sf_dir)
    sid = rows.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first().session_id
    return rows.where(F.col("session_id") == sid)


def listed(made, sid=None):
    return {(r.step_idx, r.address): (r.weight, r.gate) for r in made.collect()}


def test_state_gates_equal_dense_vectors(longest):
    st = longest.orderBy("step_idx").collect()
    items = defaultdict(list)
    for r in items_of(longest, "state").collect():
        items[r.step_idx].append((r.feature, r.weight))

    def context(first, i):
        n = i - first + 1
        for k in range(n):
            s, rec = st[first + k], 1 + 0.45 * k / n
            sem, rel = s.semantic_keys, s.relation_keys
            yield from ((f"ctx_sem::{x}", 1.2 * rec) for x in sem[:3])
            yield from ((f"ctx_rel::{x}", 1.4 * rec) for x in rel[:3])
            yield from ((f"ctx_node::{x}::{y}", 1.8 * rec) for x in sem[:2] for y in rel[:2])
            for name, col, most, w in (("flag", "flags", 2, 1.5), ("cause", "causal_markers", 2, 1.7), ("turn", "turn_markers", 2, 1.7), ("role", "event_roles", 4, 1.9), ("schema", "causal_schemas", 3, 2.0), ("act", "narrative_acts", 3, 1.8)):
                yield from ((f"ctx_{name}::{x}", w * rec) for x in s[col][:most])
            if k:
                p = st[first + k - 1]
                for name, col, w in (("rel", "relation_keys", 2.0), ("sem", "semantic_keys", 1.7), ("role", "event_roles", 2.2), ("schema", "causal_schemas", 2.4), ("act", "narrative_acts", 2.3)):
                    yield from ((f"ctx_edge_{name}::{x}=>{y}", w) for x in p[col][:2] for y in s[col][:2])
                yield f"ctx_edge_node::{p.semantic_keys[0]}/{p.relation_keys[0]}=>{sem[0]}/{rel[0]}", 2.4

    signal = lambda z: 3.2 * z.real + 1.4 * abs(z) + 0.6 * math.cos(math.atan2(z.imag, z.real + 1e-12))
    carry = lambda a, i: (f"carry_state::{a}::{'+'.join(sorted(st[i].relation_keys[:2]))}", 0.7 * st[i].weight)
    wanted = dense_steps(lambda i: items[i], context, [0.0] * len(st), signal, carry, 8)
    got = listed(E.addresses_of(longest, "state"))
    assert len(st) > 1 and got.keys() == wanted.keys()
    for k, pair in wanted.items():
        assert got[k] == pytest.approx(pair, rel=1e-6)
    assert len({round(g, 4) for _, g in got.values()}) > 10


def test_finite_gates_equal_dense_vectors(longest):
    events = S.events(longest)
    ev = events.orderBy("step_idx").collect()
    alphabet = ["persistence", "turn", "reframe", "topic_shift", "question", "resolution", "cause_to_decision", "tone_flip"]
    phases = [2 * np.pi * (alphabet.index(e.event) + 0.5) / 8 for e in ev]
    items = defaultdict(list)
    for r in items_of(events, "finite").collect():
        items[r.step_idx].append((r.feature, r.weight))

    def context(first, i):
        for k in range(first, i + 1):
            e, m = ev[k], math.exp(-0.22 * (i - k)) * np.exp(1j * phases[k])
            yield f"ctx_finite_event::{e.event}", m * (2.4 + e.event_strength)
            yield f"ctx_finite_relation::{e.event}::{e.relation_signature}", m * 2.2
            yield f"ctx_finite_topic::{e.event}::{e.topic_shift}", m * 1.6
            if k > first:
                yield f"ctx_finite_edge::{ev[k - 1].event}=>{e.event}", 2.8

    wanted = dense_steps(lambda i: items[i], context, phases, lambda z: 3.4 * z.real + 2.0 * abs(z), lambda a, i: (f"finite_carry::{a}::{ev[i].event}", 1.0), 6, "ctx_finite_carry::{}")
    got = listed(E.addresses_of(events, "finite"))
    assert got.keys() == wanted.keys()
    for k, pair in wanted.items():
        assert got[k] == pytest.approx(pair, rel=1e-6)


def test_registered_encoders_are_gated(spark, sf_dir):
    from memloom import plans

    for name in ("naive_address_gated", "state_address", "finite_event_address_gated"):
        low, high = plans.QUERIES[name](spark, sf_dir).agg(F.min("gate"), F.max("gate")).first()
        assert 0 < low < high < 1
