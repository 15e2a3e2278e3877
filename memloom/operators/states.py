"""Chunks of sessions, their states, constraint steps and edges, labels of events, graphs and chains.

A state is one row (session_id, step_idx) of array columns. What depends on the step
before is a lag over the session; nothing collects a session's texts into one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import hashing
from ..functions import text as T

def by_step():
    return Window.partitionBy("session_id").orderBy("step_idx")


def chunks(sessions: DataFrame, size: int = 2) -> DataFrame:
    """(session_id, step_idx, chunk) of sessions(session_id, text)."""
    return sessions.select("session_id", F.posexplode(T.sentence_chunks(F.col("text"), size)).alias("step_idx", "chunk"))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else T.empty()


def first(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def filled(a: Column, other: str) -> Column:
    """a, or one value where it is empty."""
    return F.when(F.size(a) > 0, a).otherwise(strings(other))


def _found(low: Column, lexicon) -> Column:
    """Labels of all keywords in the text, in the lexicon's order, with repeats."""
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(name)) for w, name in lexicon)), lambda x: x.isNotNull())


def _if(condition: Column, label: str) -> Column:
    return F.when(condition, strings(label)).otherwise(T.empty())


def _prefixed(a: Column, prefix: str) -> Column:
    return F.transform(a, lambda x: F.concat(F.lit(prefix), x))


def has(a: str, *values: str) -> Column:
    return F.arrays_overlap(F.col(a), strings(*values))


def rule_states(rows: DataFrame, emotions=lex.EMOTIONS, flags=lex.FLAGS, causal=lex.CAUSAL_MARKERS, turns=lex.TURN_MARKERS) -> DataFrame:
    """States of chunks by keyword rules."""
    chunk, low = F.col("chunk"), F.lower("chunk")
    verb = lambda t: ~t.isin(*lex.STOP_WORDS) & (t.isin(*lex.COMMON_VERBS) | t.rlike(f"({'|'.join(lex.VERB_ENDINGS)})$"))
    relation = F.create_map(*(F.lit(x) for pair in lex.FLAG_RELATIONS for x in pair))
    base = rows.withColumns({
        "tokens": T.tokens(chunk),
        "flags": T.lexicon_labels(chunk, flags),
        "emotions": T.lexicon_labels(chunk, emotions),
        "keys": first(F.concat(F.transform(T.entities(chunk), F.lower), T.topics(chunk)), 4),
    })
    said = F.concat(F.filter("tokens", verb), F.transform("flags", lambda f: F.element_at(relation, f)), _if(F.contains(chunk, F.lit("?")), "question"))
    base = base.withColumns({"semantic_keys": filled(F.array_distinct("keys"), "misc"), "relation_keys": filled(first(F.array_distinct(F.filter(said, lambda x: x.isNotNull())), 4), "context")}).drop("keys")
    marks = base.withColumns({"_c": _found(low, causal), "_t": _found(low, turns)})
    marks = marks.withColumns({
        "causal_markers": first(F.array_distinct(F.concat("_c", _if(has("relation_keys", "decision") & ~has("_c", "cause"), "deliberation"), _if(has("relation_keys", "question") & ~has("_c", "condition"), "uncertainty"))), 4),
        "turn_markers": first(F.array_distinct(F.concat("_t", _if(has("flags", "PIVOT"), "pivot"), _if(has("flags", "DECISION"), "commit"), _if(has("flags", "GENESIS", "ORIGIN"), "origin"))), 4),
    }).drop("_c", "_t")
    part = lambda name, a, at: F.when(F.size(a) > at, F.array(F.concat(F.lit(name + "::"), F.get(F.col(a), F.lit(at))))).otherwise(T.empty())
    roles = F.concat(
        part("actor", "semantic_keys", 0), part("target", "semantic_keys", 1), part("action", "relation_keys", 0), part("modifier", "relation_keys", 1), part("motive", "causal_markers", 0), part("turn", "turn_markers", 0),
        _if(has("flags", "DECISION"), "outcome::decision"), _if(has("flags", "PIVOT"), "outcome::pivot"), _if(has("flags", "CORE"), "outcome::principle"),
    )
    schemas = F.concat(
        _if(has("causal_markers", "cause") & (has("relation_keys", "decision") | has("flags", "DECISION")), "schema::cause_to_decision"),
        _if(has("causal_markers", "effect") & (has("relation_keys", "transition") | has("flags", "PIVOT")), "schema::decision_to_effect"),
        _if(has("causal_markers", "condition"), "schema::conditional_branch"), _if(has("causal_markers", "deliberation"), "schema::deliberation_loop"),
        _if(has("causal_markers", "uncertainty") | has("relation_keys", "question"), "schema::uncertain_resolution"),
        _if(has("relation_keys", "origin") | has("flags", "GENESIS", "ORIGIN"), "schema::origin_chain"),
    )
    # Chunks of a session are numbered without gaps, so their count gives the last step.
    count = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    step = F.col("step_idx")
    acts = F.concat(
        F.when(step == 0, strings("act::opening")).when(step == F.col("_n") - 1, strings("act::closing")).otherwise(strings("act::middle")),
        _if(has("turn_markers", "origin") | has("flags", "ORIGIN", "GENESIS"), "act::setup"), _if(has("turn_markers", "contrast", "redirect"), "act::complication"),
        _if(has("flags", "PIVOT") | has("turn_markers", "pivot"), "act::turn"), _if(has("flags", "DECISION") | has("turn_markers", "commit"), "act::commitment"),
        _if(has("turn_markers", "resolution") | ((step >= F.greatest(F.col("_n") - 2, F.lit(0))) & has("relation_keys", "decision")), "act::resolution"),
        _if(has("relation_keys", "question") | has("turn_markers", "inquiry"), "act::inquiry"),
    )
    made = marks.withColumn("_n", count).withColumns({"event_roles": first(F.array_distinct(roles), 8), "causal_schemas": first(F.array_distinct(schemas), 6), "narrative_acts": first(F.array_distinct(acts), 6)}).drop("_n")
    share = {"semantic_keys": 0.15, "relation_keys": 0.10, "causal_markers": 0.08, "turn_markers": 0.08, "event_roles": 0.08, "causal_schemas": 0.10, "narrative_acts": 0.10}
    weight = sum((F.size(c) * w for c, w in share.items()), F.lit(1.0)) + F.when(has("flags", "DECISION", "PIVOT", "CORE"), 0.25).otherwise(0.0)
    return made.withColumn("weight", weight)


def fallback_chunk_states(rows: DataFrame) -> DataFrame:
    """States from the first three tokens of each chunk, for use without an external extractor."""
    tokens = T.tokens(F.col("chunk"))
    base = rows.withColumn("tokens", tokens).withColumn("lead", filled(first(F.col("tokens"), 3), "context"))
    one = lambda at, other: F.coalesce(F.get("lead", F.lit(at)), F.lit(other))
    return base.select(
        "session_id", "step_idx", "chunk",
        F.when(F.size("tokens") > 0, F.array_join(first(F.col("tokens"), 12), " ")).otherwise(F.substring("chunk", 1, 120)).alias("summary"),
        one(0, "speaker").alias("actor"), one(1, "topic").alias("target"), one(2, "describe").alias("action"),
        first(F.array_distinct(F.concat("lead", strings("fallback"))), 4).alias("state_tags"),
        F.lit("background").alias("causal_role"), F.lit("setup").alias("narrative_act"), F.lit("persistence").alias("transition"), F.lit(0.05).alias("confidence"),
    )


def fallback_steps(rows: DataFrame) -> DataFrame:
    """Constraint steps without an external extractor: only the current state is known."""
    current = F.coalesce(F.get(T.tokens(F.col("chunk")), F.lit(0)), F.lit("context"))
    return rows.select("session_id", "step_idx", "chunk", current.alias("current"), strings("persistence").alias("preferred"), T.empty().alias("forbidden"), strings("maintain_local_context").alias("required"), strings("persistence").alias("triggers"), F.lit(0.05).alias("confidence"))


def lexical_steps(rows: DataFrame) -> DataFrame:
    """Constraint steps read off the tokens of a chunk, so that every type of edge occurs."""
    k = F.col("k")
    base = rows.withColumn("k", F.array_distinct(T.tokens(F.col("chunk"))))
    return base.select(
        "session_id", "step_idx", "chunk", F.coalesce(F.get(k, F.lit(0)), F.lit("context")).alias("current"),
        filled(F.slice(k, 2, 2), "persistence").alias("preferred"), F.slice(k, 4, 2).alias("forbidden"), filled(F.slice(k, 6, 2), "maintain_local_context").alias("required"),
        filled(F.slice(k, 8, 2), "persistence").alias("triggers"), F.lit(0.5).alias("confidence"),
    )


def fields_of_steps(steps: DataFrame) -> DataFrame:
    """Relation keys, turn and causal markers and flags of constraint steps, for what reads states."""
    tag = lambda prefix, a, n: F.transform(first(a, n), lambda x: F.concat(F.lit(prefix), x))
    relation = F.array_distinct(F.concat(tag("allow::", F.col("preferred"), 3), tag("require::", F.col("required"), 3), tag("block::", F.col("forbidden"), 2)))
    flags = F.concat(_if(F.size("forbidden") > 0, "CONSTRAINT"), _if(has("triggers", "reframe", "topic_shift", "turn"), "PIVOT"), _if(has("triggers", "resolution", "cause_to_decision"), "DECISION"))
    return steps.select(
        *steps.columns, filled(first(relation, 6), "allow::persistence").alias("relation_keys"), flags.alias("flags"), F.array_distinct(first(F.col("required"), 3)).alias("causal_markers"),
        F.array_distinct(tag("trigger::", F.col("triggers"), 3)).alias("turn_markers"), F.array_distinct(tag("require::", F.col("required"), 4)).alias("causal_schemas"),
    )


def step_weight() -> Column:
    return 1.0 + 0.7 * F.col("confidence") + 0.08 * F.size("preferred") + 0.05 * F.size("forbidden")


def constraint_edges(steps: DataFrame) -> DataFrame:
    """Typed, weighted edges of constraint steps: allow, block, require, trigger, step, flow and conflict."""
    rows = steps.withColumn("w", step_weight()).withColumn("prev", F.lag(F.struct("current", "preferred", "forbidden")).over(by_step()))
    text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x)
    edge = lambda source, kind, target, weight, trigger="", status="": F.struct(text(source).alias("source_state"), F.lit(kind).alias("edge_type"), text(target).alias("target"), weight.alias("weight"), text(trigger).alias("trigger"), text(status).alias("status"))
    now, w, prev = F.col("current"), F.col("w"), F.col("prev")
    n_required, n_forbidden = F.size(F.array_distinct("required")), F.size("forbidden")
    own = [
        F.transform(first(F.col("preferred"), 4), lambda x: edge(now, "allow", x, 3.2 * w * (1.0 + 0.08 * n_required))),
        F.transform(first(F.col("forbidden"), 3), lambda x: edge(now, "block", x, 2.9 * w * (1.0 + 0.06 * n_forbidden))),
        F.transform(first(F.col("required"), 3), lambda x: edge(now, "require", x, 2.7 * w)),
        F.transform(first(F.col("triggers"), 3), lambda x: edge(now, "trigger", now, 2.5 * w, x)),
    ]
    same = lambda x: x == now
    flow = lambda x: edge(prev["current"], "flow", now, F.when(same(x), 3.0).otherwise(2.4), x, F.when(same(x), "realized").otherwise("outside"))
    step = F.array(edge(prev["current"], "step", now, F.lit(2.8)))
    blocked = F.transform(F.filter(first(prev["forbidden"], 2), same), lambda x: edge(prev["current"], "conflict", now, F.lit(2.7), x, "blocked"))
    later = F.concat(step, F.transform(first(prev["preferred"], 2), flow), blocked)
    every = F.concat(*own, F.coalesce(later, F.slice(step, 1, 0)))
    made = rows.select("session_id", "step_idx", F.posexplode(every).alias("edge_idx", "e")).select("session_id", "step_idx", "edge_idx", "e.*")
    trigger = F.when(F.col("trigger") != "", F.concat(F.lit("trigger="), "trigger"))
    status = F.when(F.col("status") != "", F.concat(F.lit("status="), "status"))
    return made.withColumn("token", F.concat_ws("::", "edge_type", "source_state", "target", trigger, status))


def derived_constraints(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, actual_next, status): where the heaviest flow, conflict or step edge leads, the first of equals."""
    order = F.struct(F.col("weight"), -F.col("step_idx"), -F.col("edge_idx"))
    best = edges.where(F.col("edge_type").isin("flow", "conflict", "step")).groupBy("session_id").agg(F.max_by(F.struct("target", "status"), order).alias("b"))
    allowed = steps.select("session_id", F.explode(first(F.col("preferred"), 4)).alias("target")).distinct().withColumn("allowed", F.lit(True))
    met = best.select("session_id", F.col("b.target").alias("target"), F.col("b.status").alias("s")).join(allowed, ["session_id", "target"], "left")
    status = F.when(F.col("s") == "realized", "satisfied").when(F.col("s") == "blocked", "violated").when(F.col("s") == "outside", "outside").when(F.col("allowed"), "satisfied").otherwise("outside")
    return met.select("session_id", F.col("target").alias("actual_next"), status.alias("status"))


def transitions(states: DataFrame) -> DataFrame:
    """states with the type of the transition to the next step, by markers, for graphs of rule states."""
    kind = F.when(has("turn_markers", "contrast", "redirect"), "reframe").when(has("causal_markers", "cause"), "cause_to_decision").when(has("causal_markers", "effect"), "decision_to_effect")
    return states.withColumn("transition", kind.otherwise("persistence"))


def session_graph(states: DataFrame) -> DataFrame:
    """Edges between neighbouring steps; entity is the first shared key where the transition reframes."""
    after = F.lead(F.struct("step_idx", "semantic_keys")).over(by_step())
    rows = states.withColumn("after", after).where("after is not null")
    shared = F.array_min(F.array_intersect("semantic_keys", "after.semantic_keys"))
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return rows.select("session_id", node("step_idx").alias("source"), node("after.step_idx").alias("target"), F.col("transition").alias("type"), F.coalesce(F.when(F.col("transition") == "reframe", shared), F.lit("")).alias("entity"))


def causal_islands(states: DataFrame) -> DataFrame:
    """(session_id, chain_idx, chain): runs of neighbouring causal transitions, merged by a running count of the others."""
    last = F.lead("step_idx").over(by_step()).isNull()
    causal = F.col("transition").isin(*lex.CAUSAL_TRANSITIONS)
    marked = states.withColumn("causal", causal).withColumn("last", last)
    island = F.sum((~F.col("causal")).cast("int")).over(by_step())
    runs = marked.withColumn("island", island).where("causal and not last").groupBy("session_id", "island").agg(F.min("step_idx").alias("a"), F.max("step_idx").alias("b"))
    chain = F.array_join(F.transform(F.sequence("a", F.col("b") + 1), lambda x: F.concat(F.lit("n"), x.cast("string"))), ">")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("a")) - 1
    return runs.select("session_id", nth.alias("chain_idx"), chain.alias("chain"))


def turning_points(states: DataFrame, steps: DataFrame) -> DataFrame:
    """The pair of neighbouring steps that differs most, the first of equals."""
    both = states.select("session_id", "step_idx", "turn_markers", "relation_keys").join(steps.select("session_id", "step_idx", "current", "triggers"), ["session_id", "step_idx"])
    prev = F.lag(F.struct("current", "relation_keys")).over(by_step())
    rows = both.withColumn("prev", prev).where("prev is not null")
    novel = F.size(F.array_except(first(F.col("relation_keys"), 3), first(F.col("prev.relation_keys"), 3)))
    score = (F.col("prev.current") != F.col("current")).cast("double") + 0.4 * F.least(F.size("turn_markers"), F.lit(3)) + 0.3 * F.size("triggers") + 0.2 * novel
    best = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "step_idx"))
    picked = rows.withColumn("score", F.round(score, 6)).withColumn("r", best).where("r = 1")
    return picked.select("session_id", (F.col("step_idx") - 1).alias("start_turn"), F.col("step_idx").alias("end_turn"), F.col("prev.current").alias("pre_state"), F.col("current").alias("post_state"), "score")


def causal_chains(states: DataFrame, most: int = 3, length: int = 160) -> DataFrame:
    """The first chunks of each session that carry a causal marker, schema or relation, cut to a length."""
    said = F.exists("relation_keys", lambda x: F.contains(x, F.lit("cause")))
    picked = states.where((F.size("causal_markers") > 0) | (F.size("causal_schemas") > 0) | said)
    nth = F.row_number().over(by_step())
    return picked.withColumn("nth", nth).where(F.col("nth") <= most).select("session_id", "nth", F.trim(F.substring("chunk", 1, length)).alias("step"))


def phrase_rules(texts: DataFrame, rules, id_col: str) -> DataFrame:
    """(id, slot, labels): labels of the rules whose domain and conditions the lower-cased text meets."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    some = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    every = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) == len(words)
    fired = [F.when(some(domain) & (some(any_of) if any_of else F.lit(True)) & every(all_of), F.struct(F.lit(i).alias("i"), F.lit(slot).alias("slot"), F.lit(label).alias("label"))) for i, (domain, slot, label, any_of, all_of) in enumerate(rules)]
    rows = texts.select(id_col, F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct("f.i", "f.label")))  # a handful of rules at most
    return rows.groupBy(id_col, F.col("f.slot").alias("slot")).agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["label"])), ",").alias("labels"))


def events(states: DataFrame) -> DataFrame:
    """Shifts against the step before, event tags and strength, and the label of a finite alphabet of events."""
    sem, emo, turn, rel = (first(F.col(c), 3) for c in ("semantic_keys", "emotions", "turn_markers", "relation_keys"))
    causal = F.concat(first(F.col("causal_markers"), 2), first(F.col("causal_schemas"), 2))
    base = states.withColumns({"sem": sem, "emo": F.transform(emo, F.lower), "turn": turn, "rel": rel, "cau": F.transform(causal, F.lower), "turns": F.concat(turn, first(F.col("narrative_acts"), 3))})
    rows = base.withColumn("p", F.lag(F.struct("sem", "emo", "turn", "rel", "cau")).over(by_step()))
    new = F.col("p").isNull()
    head = lambda a, other: F.coalesce(F.array_min(a), F.lit(other))
    ordered = lambda a, other: filled(F.array_sort(a), other)

    def shift(name: str, other: str) -> Column:
        now, before = ordered(F.col(name), other), ordered(F.col(f"p.{name}"), other)
        moved = F.concat(head(F.col(f"p.{name}"), other), F.lit("=>"), head(F.col(name), other))
        return F.when(new, F.concat(F.lit("init=>"), head(F.col(name), other))).when(now == before, head(F.col(name), other)).otherwise(moved)

    overlap, novel = F.size(F.array_intersect("sem", "p.sem")), F.size(F.array_except("sem", "p.sem"))
    topic = F.when(new, "init").when((novel >= 2) & (overlap == 0), "hard_shift").when((novel >= 1) & (overlap >= 1), "soft_shift").when(overlap >= 2, "persist").otherwise("mixed")
    rows = rows.withColumns({"topic_shift": topic, "tone_shift": shift("emo", "flat"), "causal_shift": shift("cau", "background")})
    differs = lambda a: ~(F.array_sort(F.array_distinct(F.col(a))) == F.array_sort(F.array_distinct(F.col(f"p.{a}"))))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    tones = has("emo", "contrastive", "assertive", "uncertain", "tense")
    jump, solved, asked = has("turns", "turn", "contrast", "reframe", "redirect"), has("turns", "resolution", "commitment"), has("turns", "inquiry")
    moved = has("relation_keys", "topic_shift", "reframe", "question_to_resolution", "cause_to_decision")
    strength = add(jump, 1.2) + add(solved | asked, 0.6) + add(tones, 0.9) + add(moved, 1.0) + add(~new & differs("sem"), 0.7) + add(~new & differs("turn"), 0.7) + add(~new & differs("emo"), 0.5)
    tags = F.concat(_if(jump, "turn_jump"), _if(solved, "resolution_jump"), _if(asked, "question_jump"), _if(tones, "tone_jump"), _if(moved, "relation_jump"), _if(~new & differs("sem"), "topic_jump"))
    decided = F.exists("flags", lambda f: F.contains(F.lower(f), F.lit("decision"))) & has("cau", "cause", "effect")
    label = (
        F.when(has("relation_keys", "question_to_resolution") | solved, "resolution")
        .when(has("relation_keys", "cause_to_decision") | decided, "cause_to_decision")
        .when(has("relation_keys", "reframe") | has("turns", "reframe", "redirect", "contrast"), "reframe")
        .when(has("relation_keys", "topic_shift") | F.col("topic_shift").isin("hard_shift", "soft_shift"), "topic_shift")
        .when(asked | has("relation_keys", "question"), "question")
        .when(~F.col("tone_shift").isin("init", "flat", "flat=>flat") & tones, "tone_flip")
        .when(has("turns", "turn"), "turn")
        .otherwise("persistence")
    )
    rows = rows.withColumns({"strength": strength, "event_tags": filled(tags, "persistence"), "event": label})
    base_of = F.create_map(*(F.lit(x) for pair in lex.EVENT_STRENGTH for x in pair))
    fresh = F.when(new, 0.0).otherwise(0.3 * novel + 0.2 * F.size(F.array_except("rel", "p.rel")))
    kind = F.when(has("relation_keys", "cause_to_decision", "decision_to_effect", "decision_to_implementation"), "causal_transition").when(has("relation_keys", "reframe", "topic_shift"), "topic_transition").when(has("relation_keys", "question", "question_to_resolution"), "inquiry_transition").otherwise("context_transition")
    before = F.coalesce(F.lag("event").over(by_step()), F.lit("init"))
    return rows.select("session_id", "step_idx", "topic_shift", "tone_shift", "causal_shift", "event_tags", "strength", "event", before.alias("event_before"), (F.element_at(base_of, F.col("event")) + fresh).alias("event_strength"), kind.alias("relation_signature"))


def phases(states: DataFrame, decay: float = 0.05) -> DataFrame:
    """(session_id, step_idx, increment, phase): a decaying increment at each step and its running sum."""
    base = states.withColumns({"sem": first(F.col("semantic_keys"), 3), "emo": F.transform(first(F.col("emotions"), 4), F.lower), "two": F.array_sort(F.array_distinct(first(F.col("turn_markers"), 2))), "turns": F.concat(first(F.col("turn_markers"), 3), first(F.col("narrative_acts"), 3))})
    rows = base.withColumn("p", F.lag(F.struct("sem", "emo", "two")).over(by_step()))
    new = F.col("p").isNull()
    key = F.array_join(F.array_sort("sem"), "|")
    angle = 2.0 * math.pi * hashing.fnv(F.concat(F.lit("topic-phase::"), F.when(key == "", "misc").otherwise(key)), 8192) / 8192.0
    turn = F.when(has("turns", "turn", "contrast", "reframe"), 0.75).otherwise(0.0) + F.when(has("turns", "resolution", "commitment"), 0.35).otherwise(0.0) + F.when(~new & ~(F.col("two") == F.col("p.two")), 0.45).otherwise(0.0)
    shifts = F.create_map(*(F.lit(x) for pair in lex.TONE_SHIFTS for x in pair))
    tone = F.aggregate("emo", F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(shifts, x), F.lit(0.0))) + F.when(new, 0.0).otherwise(0.35 * F.size(F.array_except("emo", "p.emo")))
    change = F.when(new, 0.0).otherwise(0.40 * F.size(F.array_except("sem", "p.sem")) - 0.18 * F.size(F.array_intersect("sem", "p.sem")))
    grown = rows.withColumn("increment", F.exp(-decay * F.col("step_idx")) * (0.55 * angle + turn + tone + change))
    return grown.select("session_id", "step_idx", "increment", F.sum("increment").over(by_step().rowsBetween(Window.unboundedPreceding, 0)).alias("phase"))


def tone_markers(blob: Column) -> Column:
    """Up to four tones whose words the lower-cased text holds."""
    low = F.lower(blob)
    found = [F.when(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, name) for words, name in lex.TONE_WORDS]
    return first(F.filter(F.array(*found), lambda x: x.isNotNull()), 4)


def fields_of_chunk_states(states: DataFrame) -> DataFrame:
    """Semantic and relation keys, flags, tones and weight of chunk states from an extractor or its fallback."""
    sem = first(F.array_distinct(F.concat(F.array("actor", "target"), "state_tags")), 6)
    rel = F.array_distinct(F.array("action", "transition"))
    blob = F.concat_ws(" ", "summary", "causal_role", "narrative_act", "transition", F.array_join("state_tags", " "), "narrative_act")
    rows = states.withColumns({"semantic_keys": sem, "relation_keys": rel, "emotions": tone_markers(blob)})
    labels = F.lower(F.concat_ws(" ", F.array_join("relation_keys", " "), "narrative_act", F.array_join("state_tags", " ")))
    said = lambda *words: sum((F.contains(labels, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    flags = F.concat(_if(said("decision", "commit"), "DECISION"), _if(said("turn", "pivot", "reframe"), "PIVOT"), _if(said("principle", "core"), "CORE"))
    weight = 1.0 + 0.6 * F.col("confidence") + 0.05 * F.size("semantic_keys") + 0.05 * F.size("relation_keys")
    return rows.select("session_id", "step_idx", "semantic_keys", "relation_keys", flags.alias("flags"), "emotions", weight.alias("weight"))
