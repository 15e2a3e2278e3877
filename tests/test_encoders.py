"""Encoders of states against plain loops with dense vectors, step by step."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from memloom import lexicons as lex
from memloom.operators import addresses as A
from memloom.operators import encoders as E
from memloom.operators import states as S


def fnv(text, modulo):
    return A._fnv(text, modulo)


def proto(name):
    v = np.zeros(256, complex)
    for lane in range(8):
        angle = 2 * np.pi * fnv(f"phase::{name}", 8192) / 8192 + 2 * np.pi * lane / 8
        v[fnv(f"{name}::lane::{lane}", 256)] += (-1 if fnv(f"{name}::sign::{lane}", 2) == 0 else 1) * np.exp(1j * angle)
    return v / np.linalg.norm(v)


def signed(name):
    v = np.zeros(256)
    v[fnv(name, 256)] = -1 if fnv(f"sgn::{name}", 2) == 0 else 1
    return v


def address_vector(a):
    v = np.zeros(256)
    for lane in range(6):
        v[fnv(f"{a}::lane::{lane}", 256)] += -1 if fnv(f"{a}::sign::{lane}", 2) == 0 else 1
    return v / (np.linalg.norm(v) + 1e-12)


def unit(v):
    return v / (np.linalg.norm(v) + 1e-12)


def sigmoid(x):
    return 1 / (1 + math.exp(-max(min(x, 20), -20)))


def strongest(sums):
    return sorted(sums, key=lambda a: (-round(sums[a], 9), a))[:24]


def grams(tokens, n):
    return ["__".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def gate_all(items, context, signal, turn=1.0, boost=1.0):
    """Sums and greatest gates by address of items (feature, weight)."""
    sums, gates = defaultdict(float), {}
    for name, weight in items:
        a = fnv(name, 4096)
        z = complex(np.round(np.vdot(context, turn * proto(name)) if np.iscomplexobj(context) else context @ address_vector(a), 12))
        g = sigmoid(signal(z))
        sums[a] += weight * g * boost
        gates[a] = max(gates.get(a, 0), g)
    return {a: (sums[a], gates[a]) for a in strongest(sums)}


def relation(states, carry):
    out, top = [], []
    for at, s in enumerate(states):
        vec = np.zeros(256)
        recent = states[max(0, at - 7) : at + 1]
        for k, r in enumerate(recent):
            decay = 1 + 0.35 * k / len(recent)
            said = r["tokens"] + grams(r["tokens"], 2) + grams(r["tokens"], 3)
            for tag, c in zip("sem rel flag emo cause turn role schema act".split(), "semantic_keys relation_keys flags emotions causal_markers turn_markers event_roles causal_schemas narrative_acts".split(), strict=True):
                said += [f"{tag}::{x}" for x in r[c]]
            both = [(x, y) for x in r["semantic_keys"][:3] for y in r["relation_keys"][:3]]
            for f in said + [f"pair::{x}::{y}" for x, y in both]:
                vec += decay * signed(f)
            for x, y in both:
                vec += 1.4 * decay * signed(f"bridge::{x}=>{y}")
        for left, right in zip(recent, recent[1:]):
            for tag, c, w in (("relflow", "relation_keys", 1.6), ("semflow", "semantic_keys", 1.3)):
                for x in left[c][:2]:
                    for y in right[c][:2]:
                        vec += w * signed(f"{tag}::{x}=>{y}")
        items = []
        for head in range(4):
            items += [(f"tok::{head}::{t}", math.sqrt(n) / 4) for t, n in Counter(s["tokens"]).items()]
            for order in (2, 3):
                items += [(f"ng::{order}::{head}::{t}", (1.1 + 0.2 * order) * math.sqrt(n) / 4) for t, n in Counter(grams(s["tokens"], order)).items()]
            items += [(f"sem::{head}::{x}", 1.7 / 4) for x in s["semantic_keys"][:4]] + [(f"rel::{head}::{x}", 1.8 / 4) for x in s["relation_keys"][:4]]
            items += [(f"pair::{head}::pair::{x}::{y}", 2.2 * s["weight"] / 4) for x in s["semantic_keys"][:3] for y in s["relation_keys"][:3]]
        items += [(f"flag::flag::{f}", 1.6) for f in s["flags"][:3]]
        items += [(f"carry::{a}::{r}", 0.9) for a in top[:8] for r in s["relation_keys"][:2]] if carry else []
        boost = 1 + 0.08 * len(s["relation_keys"]) + (0.12 if {"DECISION", "PIVOT"} & set(s["flags"]) else 0)
        found = gate_all(items, unit(vec), lambda z: 3 * z.real, boost=boost)
        top = list(found)
        out.append(found)
    return out


def family(x):
    return next((name for name, words in lex.FAMILIES if any(w in x.lower() for w in words)), "context")


def kind(x):
    for name, rules, other in lex.FAMILY_KINDS:
        if name == family(x):
            return next((k for words, k in rules if any(w in x.lower() for w in words)), other)
    return "context"


def band(x):
    if x in ("misc", "context"):
        return "generic"
    if len(x) <= 3:
        return "entity"
    return "artifact" if any(c.isdigit() for c in x) else "compound" if "_" in x or "-" in x else x[:3]


def canonical(states, carry, fine):
    def role(x):
        head, tail = x.split("::", 1)
        if fine and head in ("actor", "target"):
            return f"{head}_{band(tail)}"
        if fine and head == "modifier":
            return f"modifier_{kind(tail)}"
        if head == "action":
            return f"action_{family(tail)}" + (f"_{kind(tail)}" if fine else "")
        return head if head in ("actor", "target", "modifier") else f"{head}_{tail}"

    bare = lambda x: x.split("::", 1)[-1]
    meaning = lambda s, p: "semantic_init" if p is None else "semantic_persist" if set(p["semantic_keys"][:3]) & set(s["semantic_keys"][:3]) else "semantic_shift"

    def labels(s, p):
        made = [f"relfam::{family(r)}" for r in s["relation_keys"][:3]] + [f"rolecanon::{role(r)}" for r in s["event_roles"][:4]] + [f"schemacanon::{bare(x)}" for x in s["causal_schemas"][:3]]
        made += [f"actcanon::{bare(x)}" for x in s["narrative_acts"][:3]] + [f"flagcanon::{x.lower()}" for x in s["flags"][:3]] + [f"semstate::{meaning(s, p)}"]
        if fine:
            made += [f"relsub::{family(r)}::{kind(r)}" for r in s["relation_keys"][:3]] + [f"semband::{band(s['semantic_keys'][0])}"]
        return dict.fromkeys(made)

    d = 0.1 if fine else 0.0
    out, top = [], []
    for at, s in enumerate(states):
        recent = states[max(0, at - 7) : at + 1]
        vec = np.zeros(256, complex)
        for k, r in enumerate(recent):
            for f in labels(r, recent[k - 1] if k else None):
                vec += (1 + 0.45 * k / len(recent)) * proto(f"ctx::{f}")
        for left, right in zip(recent, recent[1:]):
            for tag, c, f, w in (("rel", "relation_keys", family, 2.0), ("role", "event_roles", role, 2.1), ("schema", "causal_schemas", bare, 2.2), ("act", "narrative_acts", bare, 2.0)):
                for x in left[c][:2]:
                    for y in right[c][:2]:
                        vec += w * proto(f"ctx_edge_{tag}::{f(x)}=>{f(y)}")
            vec += 1.8 * proto(f"ctx_edge_sem::{meaning(right, left)}")
        p, w = (states[at - 1] if at else None), s["weight"]
        node = (lambda r: f"{family(r)}::{kind(r)}") if fine else family
        tail = f"::{band(s['semantic_keys'][0])}" if fine else ""
        items = [(f"node_rel::{node(r)}", (2.4 - d) * w) for r in s["relation_keys"][:3]] + [(f"node_role::{role(r)}", (2.1 - d) * w) for r in s["event_roles"][:4]]
        items += [(f"node_schema::{bare(x)}", (2.3 - d) * w) for x in s["causal_schemas"][:3]] + [(f"node_act::{bare(x)}", (2.2 - d) * w) for x in s["narrative_acts"][:3]] + [(f"node_sem::{meaning(s, p)}{tail}", (1.9 if fine else 1.8) * w)]
        if p:
            side = (lambda r: f"{family(r)}/{kind(r)}") if fine else family
            for tag, c, f, v in (("rel", "relation_keys", side, 2.6), ("role", "event_roles", role, 2.5), ("schema", "causal_schemas", bare, 2.7), ("act", "narrative_acts", bare, 2.5)):
                items += [(f"edge_{tag}::{f(x)}=>{f(y)}", v - d) for x in p[c][:2] for y in s[c][:2]]
            items += [(f"edge_sem::{meaning(s, p)}{tail}", 2.1 - d)]
        first = family(s["relation_keys"][0])
        if carry:
            items += [(f"carry_semicanon::{a}::{first}{tail}" if fine else f"carry_canonical::{a}::{first}", (0.65 if fine else 0.6) * w) for a in top[:8]]
        found = gate_all(items, unit(vec), lambda z: 3.2 * z.real + 1.4 * abs(z) + 0.6 * math.cos(math.atan2(z.imag, z.real + 1e-12)))
        top = list(found)
        out.append(found)
    return out


def event_bucket(s, p):
    said = lambda x, c, n: ",".join(sorted(x[c][:n]))
    own = [said(s, c, 3) for c in ("turn_markers", "emotions", "relation_keys", "semantic_keys")]
    return fnv("event-phase::" + "|".join([*own, said(p, "turn_markers", 2) if p else "init", said(p, "semantic_keys", 2) if p else "init"]), 8)


def phased(states, carry, event, base_items, phases, strengths):
    out, top, running = [], [], 0.0
    if event:
        phases = []
        for i, s in enumerate(states):
            b = event_bucket(s, states[i - 1] if i else None)
            running += math.exp(-0.22 * i) * (0.05 if strengths[i] <= 1e-6 else 0.12 + 0.55 * strengths[i] + 0.18 * 2 * math.pi * (b + 0.5) / 8)
            phases.append(running)
    buckets = [min(7, int((x % (2 * math.pi)) / (2 * math.pi) * 8)) for x in phases]
    for at, s in enumerate(states):
        lo = max(0, at - 7)
        n = at + 1 - lo
        vec = np.zeros(256, complex)
        for k, i in enumerate(range(lo, at + 1)):
            r, m = states[i], np.exp(1j * phases[i]) * math.exp(-0.22 * (n - 1 - k))
            rec = 1 + 0.45 * k / n
            for tag, c, w in (("sem", "semantic_keys", 1.2), ("rel", "relation_keys", 1.4), ("tone", "emotions", 1.9), ("turn", "turn_markers", 1.9)):
                for x in r[c][:3]:
                    vec += m * w * rec * proto(f"ctx_{tag}::{x}")
            for x in r["semantic_keys"][:2]:
                for y in r["relation_keys"][:2]:
                    vec += m * 2.0 * rec * proto(f"ctx_node::{x}::{y}")
            if k:
                left, m = states[i - 1], np.exp(0.5j * (phases[i - 1] + phases[i])) * math.exp(-0.22 * (n - 1 - k))
                for tag, c, w in (("rel", "relation_keys", 2.1), ("sem", "semantic_keys", 1.9), ("turn", "turn_markers", 2.2), ("tone", "emotions", 2.0)):
                    for x in left[c][:2]:
                        for y in r[c][:2]:
                            vec += m * w * proto(f"ctx_edge_{tag}::{x}=>{y}")
        vec = unit(vec)
        items = list(base_items[at])
        if event:
            for k, i in enumerate(range(lo, at + 1)):
                m, b, r = np.exp(1j * phases[i]) * math.exp(-0.22 * (n - 1 - k)), buckets[i], states[i]
                vec = vec + m * 1.3 * proto(f"ctx_phasebucket::{b}")
                for tag, c, w in (("turn", "turn_markers", 1.7), ("tone", "emotions", 1.6), ("rel", "relation_keys", 1.5)):
                    for x in r[c][:2]:
                        vec = vec + m * w * proto(f"ctx_phase_{tag}::{b}::{x}")
            vec = unit(vec)
            b, w = buckets[at], s["weight"]
            items += [(f"phase_node::{b}::{x}::{y}", 2.7 * w) for x in s["semantic_keys"][:2] for y in s["relation_keys"][:2]] + [(f"phase_turn::{b}::{x}", 2.4 * w) for x in s["turn_markers"][:3]]
            items += [(f"phase_tone::{b}::{x}", 2.2 * w) for x in s["emotions"][:3]] + [(f"phase_act::{b}::{x}", 2.3 * w) for x in s["narrative_acts"][:2]]
            if at and event_bucket(states[at - 1], None) != b:
                items.append((f"phase_jump::{event_bucket(states[at - 1], None)}=>{b}", 3.0 * w))
        if carry:
            key = "+".join(sorted(s["relation_keys"][:2]))
            items += [(f"carry_state::{a}::{key}", 0.7 * s["weight"]) for a in top[:8]]
        x, y, t = (3.1, 1.8, 1.1) if event else (2.9, 1.7, 0.9)
        found = gate_all(items, vec, lambda z, x=x, y=y, t=t: x * z.real + y * abs(z) + t * math.cos(math.atan2(z.imag, z.real + 1e-12)), np.exp(1j * phases[at]))
        top = list(found)
        out.append(found)
    return out


def transition(states, carry, shifts):
    out, top, events = [], [], []
    for i, s in enumerate(states):
        low = lambda c, other, s=s: "+".join(sorted(x.lower() for x in s[c][:2])) or other
        events.append({"b": event_bucket(s, states[i - 1] if i else None), "rel": low("relation_keys", "context"), "act": low("narrative_acts", "setup"), "anchor": s["semantic_keys"][0], **shifts[i]})
    angle = lambda b: 2 * math.pi * (b + 0.5) / 8
    for at, e in enumerate(events):
        recent = events[max(0, at - 7) : at + 1]
        vec = np.zeros(256, complex)
        for k, r in enumerate(recent):
            m, b = math.exp(-0.18 * (len(recent) - 1 - k)) * np.exp(1j * angle(r["b"])), r["b"]
            vec += m * (1.8 + r["strength"]) * proto(f"ctx_event_bucket::{b}")
            for t in r["event_tags"][:3]:
                vec += m * 2.3 * proto(f"ctx_event_tag::{b}::{t}")
            for c in ("tone_shift", "topic_shift", "causal_shift"):
                vec += m * 1.8 * proto(f"ctx_{c}::{b}::{r[c]}")
            vec += m * 1.3 * proto(f"ctx_sem_anchor::{r['anchor']}")
        for x, y in zip(recent, recent[1:]):
            m = np.exp(1j * angle((x["b"] + y["b"]) / 2))
            vec += m * 2.8 * proto(f"ctx_event_edge::{x['event_tags'][0]}=>{y['event_tags'][0]}") + m * 2.4 * proto(f"ctx_bucket_edge::{x['b']}=>{y['b']}")
        for a in top[:8] if carry else ():
            vec += 0.9 * proto(f"ctx_carry::{a}")
        b, w = e["b"], 2.0 + e["strength"]
        items = [(f"event_bucket::{b}", w)] + [(f"event_tag::{b}::{t}", w + 0.8) for t in e["event_tags"][:4]]
        items += [(f"tone_shift::{b}::{e['tone_shift']}", w + 0.4), (f"topic_shift::{b}::{e['topic_shift']}", w + 0.6), (f"causal_shift::{b}::{e['causal_shift']}", w + 0.5), (f"relation_sig::{b}::{e['rel']}", w), (f"narrative_sig::{b}::{e['act']}", w), (f"sem_anchor::{e['anchor']}", 0.9)]
        if at:
            p = events[at - 1]
            items += [(f"event_edge::{p['event_tags'][0]}=>{e['event_tags'][0]}", 3.0 + 0.6 * e["strength"]), (f"bucket_edge::{p['b']}=>{b}", 2.8 + 0.4 * e["strength"]), (f"tone_edge::{p['tone_shift']}=>{e['tone_shift']}", 2.4), (f"topic_edge::{p['topic_shift']}=>{e['topic_shift']}", 2.5)]
        items += [(f"event_carry::{a}::{b}", 1.2) for a in top[:6]] if carry else []
        found = gate_all(items, unit(vec), lambda z: 3.4 * z.real + 2.0 * abs(z), np.exp(1j * angle(b)))
        top = list(found)
        out.append(found)
    return out


@pytest.fixture(scope="module")
def states(spark):
    words = "decided tion because switch prefer the and question core change build que ment lich so ou however update choose Berlin A1x re_start wing".split()
    long = ". ".join(" ".join(words[(i * i + 3 * j) % len(words)] for j in range(6)) for i in range(44))
    texts = {"a": long, "b": "Then we decided to switch the plan. Why did the question change? Because core things started", "c": "so"}
    chunks = S.chunks(spark.createDataFrame(list(texts.items()), "session_id string, text string"))
    return S.rule_states(chunks, lex.TEST_TONES, lex.TEST_FLAGS, lex.TEST_CAUSAL, lex.TEST_TURNS).cache()


@pytest.fixture(scope="module")
def sessions(states):
    made = defaultdict(list)
    for r in states.orderBy("session_id", "step_idx").collect():
        made[r.session_id].append(r.asDict())
    assert len(made["a"]) > 16
    return made


def by_step(df, *cols):
    made = defaultdict(list)
    for r in df.orderBy("session_id", "step_idx").collect():
        made[r.session_id].append({c: r[c] for c in cols})
    return made


@pytest.mark.parametrize("carry", [False, True])
@pytest.mark.parametrize("name", sorted(set(E.ENCODERS) - {"state", "finite"}))
@pytest.mark.parametrize("steps", [2048, 5])
def test_encoder_equals_dense_loops(states, sessions, monkeypatch, name, carry, steps):
    if name in ("rotating", "event_phase"):
        base = by_step(E.encoder_rows(states, "state"), "items")
        phases = by_step(S.phases(states, 0.22), "phase")
        strengths = by_step(S.events(states), "strength")
    if name == "transition":
        shifts = by_step(S.events(states), "event_tags", "strength", "tone_shift", "topic_shift", "causal_shift")
    rows = E.encoder_rows(states, name).repartition(1)
    # A run of few steps makes sessions go on over several runs.
    schema = "session_id string, step_idx long, address long, weight double, gate double"
    encoder = E.ENCODERS[name]

    def run(batches):
        state = (None, 0, None, np.full(E.KEPT, -1))
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, steps):
                found, *state = E._fold(batch.slice(at, steps), encoder, carry, *state)
                yield pa.RecordBatch.from_arrays(found, names=["session_id", "step_idx", "address", "weight", "gate"])

    made = E.folded(rows, encoder, carry) if steps > 100 else rows.sortWithinPartitions("session_id", "step_idx").mapInArrow(run, schema)
    got = defaultdict(dict)
    for r in made.collect():
        got[r.session_id, r.step_idx][r.address] = (r.weight, r.gate)
    for sid, own in sessions.items():
        if name == "relation":
            wanted = relation(own, carry)
        elif name in ("canonical", "semicanonical"):
            wanted = canonical(own, carry, name != "canonical")
        elif name == "transition":
            wanted = transition(own, carry, shifts[sid])
        else:
            items = [[(x["feature"], x["weight"]) for x in r["items"]] for r in base[sid]]
            wanted = phased(own, carry, name == "event_phase", items, [r["phase"] for r in phases[sid]], [r["strength"] for r in strengths[sid]])
        for step, found in enumerate(wanted):
            assert set(got[sid, step]) == set(found), (sid, step)
            for a, x in found.items():
                assert got[sid, step][a] == pytest.approx(x, abs=1e-7)
