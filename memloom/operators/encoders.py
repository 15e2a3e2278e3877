"""Encoders of states as address maps: feature templates, and a fold that takes many sessions in lockstep.

A feature is a text made of constants and of values of the state or of the one before;
templates list them as data. A row of a step carries four kinds:

* items: what the step is stored under, with weights;
* own, linked, opening, extra: what it adds to the contexts of the next steps. own counts in each of
  them by recency; linked (of a pair of neighbours) and later not where the step is the first
  of a window, opening only there; extra is added once the rest has unit length.

The fold reads whole sessions in order. All sessions of a batch go step by step together, as
matrices of NumPy: contexts of the last eight steps are sums of shifted rows, an item's
gate compares its prototype with the context, and only what the strongest addresses of a
step carry into the next one is a recurrence. A batch has a bounded number of steps; of
the session that goes on in the next batch eight vectors and ten addresses are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import hashing
from ..functions import text as T
from . import addresses as A
from . import states as S

SPAN, TOP, KEPT = 8, 24, 10
#: Steps that are folded together.
STEPS = 2048


@dataclass(frozen=True)
class Each:
    """The first n values of an array column, or all; `p.` names the step before."""

    column: str
    n: int | None = None


@dataclass(frozen=True)
class Of:
    """A plain column."""

    column: str


@dataclass(frozen=True)
class Feature:
    """Texts of the product of its parts, each with weight * times + more * plus."""

    parts: tuple
    weight: float
    times: str | None = None
    more: float = 0.0
    plus: str | None = None
    #: Of a pair of values, the weight where both are equal.
    same: float | None = None


def feature(*parts, weight: float, times: str | None = None, more: float = 0.0, plus: str | None = None) -> Feature:
    return Feature(parts, weight, times, more, plus)


def _with_part(texts: Column, part) -> Column:
    """Each text continued by a constant, a column, or each value of an array column."""
    if not isinstance(part, Each):
        value = F.col(part.column) if isinstance(part, Of) else F.lit(part)
        return F.transform(texts, lambda head: F.concat(head, value))
    return F.flatten(F.transform(texts, lambda head: F.transform(_values(part), lambda x: F.concat(head, x))))


def _values(part: Each) -> Column:
    values = F.coalesce(F.col(part.column), T.empty())
    return values if part.n is None else F.slice(values, 1, part.n)


def _pair(f: Feature) -> Column:
    """Features of two array columns whose weight depends on the equality of their values."""
    head, one, glue, two = f.parts
    both = lambda x: F.transform(_values(two), lambda y: F.struct(F.concat(F.lit(head), x, F.lit(glue), y).alias("feature"), F.when(x == y, f.same).otherwise(f.weight).cast("double").alias("weight")))
    return F.flatten(F.transform(_values(one), both))


def _texts_of(f: Feature) -> Column:
    if f.same is not None:
        return _pair(f)
    texts = F.array(F.lit(""))
    for part in f.parts:
        texts = _with_part(texts, part)
    weight = F.lit(f.weight) * (F.col(f.times) if f.times else F.lit(1.0)) + (F.lit(f.more) * F.col(f.plus) if f.plus else F.lit(0.0))
    return F.transform(texts, lambda x: F.struct(x.alias("feature"), weight.cast("double").alias("weight")))


def array_of(features: tuple[Feature, ...]) -> Column:
    """array<struct<feature,weight>> of a step's features."""
    return F.concat(*map(_texts_of, features)) if features else F.array().cast("array<struct<feature:string,weight:double>>")


@dataclass(frozen=True)
class Encoder:
    """Templates, and how contexts and gates are made of them."""

    name: str
    now: tuple[Feature, ...]
    before: tuple[Feature, ...] = ()
    own: tuple[Feature, ...] = ()
    linked: tuple[Feature, ...] = ()
    later: tuple[Feature, ...] = ()
    opening: tuple[Feature, ...] = ()
    extra: tuple[Feature, ...] = ()
    rooted: tuple[Feature, ...] = ()
    #: Weight of the k-th of n steps of a window is 1 + rise * k / n, times exp(-fade * (n - 1 - k)); that of a link only the latter.
    rise: float = 0.45
    fade: float = 0.0
    link_fade: float = 0.0
    #: Of the conjugated alignment z: re * Re z + size * |z| + turn * cos(arg z).
    signal: tuple[float, float, float] = (3.2, 1.4, 0.6)
    carry: str = ""
    carry_weight: tuple[float, str | None] = (0.0, None)
    carried: int = 8
    context_carry: tuple[str, float] | None = None
    real: bool = False


# --- templates ------------------------------------------------------------------------------------------------------------
SEM, REL, EMO, TUR, CAU = "semantic_keys", "relation_keys", "emotions", "turn_markers", "causal_markers"
ROLES, SCHEMAS, ACTS, FLAGS = "event_roles", "causal_schemas", "narrative_acts", "flags"


def _pairs(prefix: str, column: str, weight: float, same: float | None = None, n: int = 2) -> Feature:
    """A feature of each pair of values of the step before and of this one."""
    return Feature((prefix, Each(f"p.{column}", n), "=>", Each(column, n)), weight, same=same)


def _heads(*parts, weight: float, times: str | None = None) -> Feature:
    """A feature under each of four hash heads, which share its weight."""
    at = parts.index("#")
    return feature(*parts[:at], Each("heads"), *parts[at + 1 :], weight=weight / 4, times=times)


STATE = Encoder(
    "state",
    now=(
        feature("node::", Each(SEM, 3), "::", Each(REL, 3), weight=2.8, times="weight"), feature("role::", Each(ROLES, 8), weight=2.2, times="weight"), feature("schema::", Each(SCHEMAS, 4), weight=2.4, times="weight"),
        feature("act::", Each(ACTS, 4), weight=2.3, times="weight"), feature("cause::", Each(CAU, 3), weight=2.1, times="weight"), feature("turn::", Each(TUR, 3), weight=2.1, times="weight"),
        feature("state::", Of("bundle"), weight=2.2, times="weight"), feature("flagrel::", Each(FLAGS, 3), "::", Each(REL, 2), weight=1.9, times="weight"),
    ),
    before=(
        _pairs("edge_rel::", REL, 2.4 * 1.15, 2.4), _pairs("edge_sem::", SEM, 2.1, 2.1 * 1.2), feature("edge_node::", Each("node_edge"), weight=1.0, times="node_weight"), feature("reframe::", Each("reframes"), weight=1.0, times="reframe_weight"),
        _pairs("edge_cause::", CAU, 2.3), _pairs("edge_turn::", TUR, 2.4, 2.0), _pairs("edge_role::", ROLES, 2.5), _pairs("edge_schema::", SCHEMAS, 2.7), _pairs("edge_act::", ACTS, 2.6, 2.2),
    ),
    own=(
        feature("ctx_sem::", Each(SEM, 3), weight=1.2), feature("ctx_rel::", Each(REL, 3), weight=1.4), feature("ctx_node::", Each(SEM, 2), "::", Each(REL, 2), weight=1.8), feature("ctx_flag::", Each(FLAGS, 2), weight=1.5),
        feature("ctx_cause::", Each(CAU, 2), weight=1.7), feature("ctx_turn::", Each(TUR, 2), weight=1.7), feature("ctx_role::", Each(ROLES, 4), weight=1.9), feature("ctx_schema::", Each(SCHEMAS, 3), weight=2.0), feature("ctx_act::", Each(ACTS, 3), weight=1.8),
    ),
    linked=(
        _pairs("ctx_edge_rel::", REL, 2.0), _pairs("ctx_edge_sem::", SEM, 1.7), feature("ctx_edge_node::", Each("node_edge"), weight=2.4), _pairs("ctx_edge_role::", ROLES, 2.2),
        _pairs("ctx_edge_schema::", SCHEMAS, 2.4), _pairs("ctx_edge_act::", ACTS, 2.3),
    ),
    carry="carry_state::{address}::{key}", carry_weight=(0.7, "weight"),
)

RELATION = Encoder(
    "relation",
    now=(
        _heads("sem::", "#", "::", Each(SEM, 4), weight=1.7), _heads("rel::", "#", "::", Each(REL, 4), weight=1.8),
        _heads("pair::", "#", "::pair::", Each(SEM, 3), "::", Each(REL, 3), weight=2.2, times="weight"), feature("flag::flag::", Each(FLAGS, 3), weight=1.6),
    ),
    rooted=(_heads("tok::", "#", "::", Each("tokens"), weight=1.0), _heads("ng::2::", "#", "::", Each("pairs"), weight=1.5), _heads("ng::3::", "#", "::", Each("triples"), weight=1.7)),
    own=(
        *(feature(Each(c), weight=1.0) for c in ("tokens", "pairs", "triples")),
        *(feature(f"{p}::", Each(c), weight=1.0) for p, c in (("sem", SEM), ("rel", REL), ("flag", FLAGS), ("emo", EMO), ("cause", CAU), ("turn", TUR), ("role", ROLES), ("schema", SCHEMAS), ("act", ACTS))),
        feature("pair::", Each(SEM, 3), "::", Each(REL, 3), weight=1.0), feature("bridge::", Each(SEM, 3), "=>", Each(REL, 3), weight=1.4),
    ),
    linked=(_pairs("relflow::", REL, 1.6), _pairs("semflow::", SEM, 1.3)),
    rise=0.35, signal=(3.0, 0.0, 0.0), carry="carry::{address}::{key}", carry_weight=(0.9, None), real=True,
)

CANONICAL = Encoder(
    "canonical",
    now=(
        feature("node_rel::", Each("families", 3), weight=2.4, times="weight"), feature("node_role::", Each("roles", 4), weight=2.1, times="weight"), feature("node_schema::", Each("schemas", 3), weight=2.3, times="weight"),
        feature("node_act::", Each("acts", 3), weight=2.2, times="weight"), feature("node_sem::", Of("meaning"), weight=1.8, times="weight"),
    ),
    before=(_pairs("edge_rel::", "families", 2.6), _pairs("edge_role::", "roles", 2.5), _pairs("edge_schema::", "schemas", 2.7), _pairs("edge_act::", "acts", 2.5), feature("edge_sem::", Of("meaning"), weight=2.1)),
    own=(feature("ctx::", Each("labels"), weight=1.0),),
    later=(feature("ctx::semstate::", Of("meaning"), weight=1.0),),
    opening=(feature("ctx::semstate::semantic_init", weight=1.0),),
    linked=(_pairs("ctx_edge_rel::", "families", 2.0), _pairs("ctx_edge_role::", "roles", 2.1), _pairs("ctx_edge_schema::", "schemas", 2.2), _pairs("ctx_edge_act::", "acts", 2.0), feature("ctx_edge_sem::", Of("meaning"), weight=1.8)),
    carry="carry_canonical::{address}::{key}", carry_weight=(0.6, "weight"),
)

SEMICANONICAL = Encoder(
    "semicanonical",
    now=(
        feature("node_rel::", Each("kinds", 3), weight=2.3, times="weight"), feature("node_role::", Each("roles", 4), weight=2.0, times="weight"), feature("node_schema::", Each("schemas", 3), weight=2.2, times="weight"),
        feature("node_act::", Each("acts", 3), weight=2.1, times="weight"), feature("node_sem::", Of("meaning"), "::", Of("band"), weight=1.9, times="weight"),
    ),
    before=(_pairs("edge_rel::", "slashed", 2.5), _pairs("edge_role::", "roles", 2.4), _pairs("edge_schema::", "schemas", 2.6), _pairs("edge_act::", "acts", 2.4), feature("edge_sem::", Of("meaning"), "::", Of("band"), weight=2.0)),
    own=CANONICAL.own, later=CANONICAL.later, opening=CANONICAL.opening, linked=CANONICAL.linked,
    carry="carry_semicanon::{address}::{key}", carry_weight=(0.65, "weight"),
)

_PHASED = dict(
    own=(
        feature("ctx_sem::", Each(SEM, 3), weight=1.2), feature("ctx_rel::", Each(REL, 3), weight=1.4), feature("ctx_tone::", Each(EMO, 3), weight=1.9), feature("ctx_turn::", Each(TUR, 3), weight=1.9),
        feature("ctx_node::", Each(SEM, 2), "::", Each(REL, 2), weight=2.0),
    ),
    linked=(_pairs("ctx_edge_rel::", REL, 2.1), _pairs("ctx_edge_sem::", SEM, 1.9), _pairs("ctx_edge_turn::", TUR, 2.2), _pairs("ctx_edge_tone::", EMO, 2.0)),
    fade=0.22, link_fade=0.22, carry="carry_state::{address}::{key}", carry_weight=(0.7, "weight"),
)

ROTATING = Encoder("rotating", now=STATE.now, before=STATE.before, signal=(2.9, 1.7, 0.9), **_PHASED)

EVENT_PHASE = Encoder(
    "event_phase",
    now=(
        *STATE.now,
        feature("phase_node::", Of("bucket"), "::", Each(SEM, 2), "::", Each(REL, 2), weight=2.7, times="weight"), feature("phase_turn::", Of("bucket"), "::", Each(TUR, 3), weight=2.4, times="weight"),
        feature("phase_tone::", Of("bucket"), "::", Each(EMO, 3), weight=2.2, times="weight"), feature("phase_act::", Of("bucket"), "::", Each(ACTS, 2), weight=2.3, times="weight"),
        feature("phase_jump::", Each("jump"), weight=3.0, times="weight"),
    ),
    before=STATE.before,
    extra=(
        feature("ctx_phasebucket::", Of("bucket"), weight=1.3), feature("ctx_phase_turn::", Of("bucket"), "::", Each(TUR, 2), weight=1.7), feature("ctx_phase_tone::", Of("bucket"), "::", Each(EMO, 2), weight=1.6),
        feature("ctx_phase_rel::", Of("bucket"), "::", Each(REL, 2), weight=1.5),
    ),
    signal=(3.1, 1.8, 1.1), **_PHASED,
)

TRANSITION = Encoder(
    "transition",
    now=(
        feature("event_bucket::", Of("bucket"), weight=2.0, more=1.0, plus="strength"), feature("event_tag::", Of("bucket"), "::", Each("event_tags", 4), weight=2.8, more=1.0, plus="strength"),
        feature("tone_shift::", Of("bucket"), "::", Of("tone_shift"), weight=2.4, more=1.0, plus="strength"), feature("topic_shift::", Of("bucket"), "::", Of("topic_shift"), weight=2.6, more=1.0, plus="strength"),
        feature("causal_shift::", Of("bucket"), "::", Of("causal_shift"), weight=2.5, more=1.0, plus="strength"), feature("relation_sig::", Of("bucket"), "::", Of("relations"), weight=2.0, more=1.0, plus="strength"),
        feature("narrative_sig::", Of("bucket"), "::", Of("narrative"), weight=2.0, more=1.0, plus="strength"), feature("sem_anchor::", Of("anchor"), weight=0.9),
    ),
    before=(
        feature("event_edge::", Each("p.event_tags", 1), "=>", Each("event_tags", 1), weight=3.0, more=0.6, plus="strength"), feature("bucket_edge::", Of("p.bucket"), "=>", Of("bucket"), weight=2.8, more=0.4, plus="strength"),
        feature("tone_edge::", Of("p.tone_shift"), "=>", Of("tone_shift"), weight=2.4), feature("topic_edge::", Of("p.topic_shift"), "=>", Of("topic_shift"), weight=2.5),
    ),
    own=(
        feature("ctx_event_bucket::", Of("bucket"), weight=1.8, more=1.0, plus="strength"), feature("ctx_event_tag::", Of("bucket"), "::", Each("event_tags", 3), weight=2.3),
        *(feature(f"ctx_{c}::", Of("bucket"), "::", Of(c), weight=1.8) for c in ("tone_shift", "topic_shift", "causal_shift")), feature("ctx_sem_anchor::", Of("anchor"), weight=1.3),
    ),
    linked=(feature("ctx_event_edge::", Each("p.event_tags", 1), "=>", Each("event_tags", 1), weight=2.8), feature("ctx_bucket_edge::", Of("p.bucket"), "=>", Of("bucket"), weight=2.4)),
    rise=0.0, fade=0.18, signal=(3.4, 2.0, 0.0), carry="event_carry::{address}::{key}", carry_weight=(1.2, None), carried=6, context_carry=("ctx_carry::{address}", 0.9),
)


FINITE = Encoder(
    "finite",
    now=(
        feature("finite_event::", Of("event"), weight=3.0, more=1.0, plus="event_strength"), feature("finite_relation::", Of("event"), "::", Of("relation_signature"), weight=2.6),
        feature("finite_topic::", Of("event"), "::", Of("topic_shift"), weight=2.2), feature("finite_causal::", Of("event"), "::", Of("causal_shift"), weight=2.1),
    ),
    before=(
        feature("finite_edge::", Of("p.event"), "=>", Of("event"), weight=3.6, more=0.4, plus="event_strength"),
        feature("finite_pair::", Of("p.event"), "/", Of("p.relation_signature"), "=>", Of("event"), "/", Of("relation_signature"), weight=3.0),
    ),
    own=(
        feature("ctx_finite_event::", Of("event"), weight=2.4, more=1.0, plus="event_strength"), feature("ctx_finite_relation::", Of("event"), "::", Of("relation_signature"), weight=2.2),
        feature("ctx_finite_topic::", Of("event"), "::", Of("topic_shift"), weight=1.6),
    ),
    linked=(feature("ctx_finite_edge::", Of("p.event"), "=>", Of("event"), weight=2.8),),
    rise=0.0, fade=0.22, signal=(3.4, 2.0, 0.0), carry="finite_carry::{address}::{key}", carry_weight=(1.0, None), carried=6, context_carry=("ctx_finite_carry::{address}", 0.6),
)


# --- columns that templates name ----------------------------------------------------------------------------------------
def relation_family(x: Column) -> Column:
    made = F.lit("context")
    for name, words in reversed(lex.FAMILIES):
        made = F.when(F.lower(x).rlike("|".join(words)), name).otherwise(made)
    return made


def relation_kind(x: Column) -> Column:
    """The finer label of a relation inside its family."""
    family, low = relation_family(x), F.lower(x)
    made = F.lit("context")
    for name, rules, other in reversed(lex.FAMILY_KINDS):
        inner = F.lit(other)
        for words, kind in reversed(rules):
            inner = F.when(low.rlike("|".join(words)), kind).otherwise(inner)
        made = F.when(family == name, inner).otherwise(made)
    return made


def semantic_band(x: Column) -> Column:
    """How a key looks, without the key: generic, entity, artifact, compound, or its first three letters."""
    low = F.lower(x)
    return F.when(low.isin("misc", "context"), "generic").when(F.length(low) <= 3, "entity").when(low.rlike("[0-9]"), "artifact").when(low.rlike("[_-]"), "compound").otherwise(F.substring(low, 1, 3))


def _role(x: Column, fine: bool) -> Column:
    """A role without its words, or with a band or kind in their place."""
    head, tail = F.substring_index(x, "::", 1), F.regexp_replace(x, "^.*?::", "")
    named = F.concat(head, F.lit("_"), F.when(tail == "", "generic").otherwise(tail))
    plain = F.when(head.isin("motive", "turn", "outcome"), named).otherwise(head)
    if fine:
        return F.when(head.isin("actor", "target"), F.concat(head, F.lit("_"), semantic_band(tail))).when(head == "modifier", F.concat(F.lit("modifier_"), relation_kind(tail))).when(head == "action", F.concat_ws("_", F.lit("action"), relation_family(tail), relation_kind(tail))).otherwise(plain)
    return F.when(head == "action", F.concat(F.lit("action_"), relation_family(tail))).otherwise(plain)


def _bare(column: str) -> Column:
    return F.transform(column, lambda x: F.regexp_replace(x, "^.*?::", ""))


def canonical_columns(states: DataFrame, fine: bool = False) -> DataFrame:
    """session_id, step_idx, weight and what the canonical encoders name: families, kinds, roles, schemas, acts, labels, meaning, band, key."""
    kept = F.slice(REL, 1, 3)
    rows = states.select(
        *A.STEP, "weight", F.slice(SEM, 1, 3).alias("sem"), F.lag(F.slice(SEM, 1, 3)).over(S.by_step()).alias("was"), F.transform(kept, relation_family).alias("families"), F.transform(kept, relation_kind).alias("subs"),
        F.transform(F.slice(ROLES, 1, 4), lambda x: _role(x, fine)).alias("roles"), F.slice(_bare(SCHEMAS), 1, 3).alias("schemas"), F.slice(_bare(ACTS), 1, 3).alias("acts"), F.transform(F.slice(FLAGS, 1, 3), F.lower).alias("low_flags"),
    )
    meaning = F.when(F.col("was").isNull(), "semantic_init").when(F.arrays_overlap("was", "sem"), "semantic_persist").otherwise("semantic_shift")
    joined = lambda glue: F.zip_with("families", "subs", lambda a, b: F.concat(a, F.lit(glue), b))
    rows = rows.withColumns({"meaning": meaning, "band": semantic_band(F.get("sem", F.lit(0))), "kinds": joined("::"), "slashed": joined("/")})
    tag = lambda c, prefix: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    parts = [tag("families", "relfam::"), *([tag("kinds", "relsub::")] if fine else []), tag("roles", "rolecanon::"), tag("schemas", "schemacanon::"), tag("acts", "actcanon::"), tag("low_flags", "flagcanon::"), *([F.array(F.concat(F.lit("semband::"), "band"))] if fine else [])]
    first = F.get("families", F.lit(0))
    key = F.concat(first, F.lit("::"), "band") if fine else first
    return rows.withColumns({"labels": F.array_distinct(F.concat(*parts)), "keys": F.array(key)})


def relation_columns(states: DataFrame) -> DataFrame:
    heads = F.array(*map(F.lit, "0123"))
    boost = 1.0 + 0.08 * F.size(REL) + F.when(F.arrays_overlap(FLAGS, S.strings("DECISION", "PIVOT")), 0.12).otherwise(0.0)
    return states.withColumns({"heads": heads, "pairs": A.grams(F.col("tokens"), 2), "triples": A.grams(F.col("tokens"), 3), "keys": F.slice(REL, 1, 2), "boost": boost})


def _joined_key() -> Column:
    return F.array(F.array_join(F.array_sort(F.slice(REL, 1, 2)), "+"))


def state_columns(states: DataFrame) -> DataFrame:
    """Adds the bundle of a state, its edge to the one before as one node pair, and the keys that both share under new relations."""
    rows = states.withColumn("_p", F.lag(F.struct(SEM, REL)).over(S.by_step()))
    one = lambda c: F.get(F.col(c), F.lit(0))
    plus = lambda c: F.array_join(F.array_sort(F.slice(F.col(c), 1, 2)), "+")
    same_sem, same_rel = one(f"_p.{SEM}") == one(SEM), one(f"_p.{REL}") == one(REL)
    edge = F.concat(one(f"_p.{SEM}"), F.lit("/"), one(f"_p.{REL}"), F.lit("=>"), one(SEM), F.lit("/"), one(REL))
    shared = F.slice(F.array_sort(F.array_intersect(F.slice(f"_p.{SEM}", 1, 3), F.slice(SEM, 1, 3))), 1, 2)
    reframes = F.transform(shared, lambda x: F.concat(x, F.lit("::"), one(f"_p.{REL}"), F.lit("=>"), one(REL)))
    new = F.col("_p").isNull()
    return rows.withColumns({
        "bundle": F.concat(plus(SEM), F.lit("::"), plus(REL)), "node_edge": F.when(new, T.empty()).otherwise(F.array(edge)), "node_weight": F.when(same_sem & ~same_rel, 3.75).otherwise(3.0),
        "reframes": F.when(new, T.empty()).otherwise(reframes), "reframe_weight": F.when(same_rel, 2.1).otherwise(2.6), "keys": _joined_key(),
    }).drop("_p")


def finite_columns(events: DataFrame) -> DataFrame:
    """Of rows of states.events: the event as key, and the phase of its place in the alphabet; links aren't turned."""
    place = F.array_position(F.array(*(F.lit(name) for name, _ in lex.EVENT_STRENGTH)), F.col("event")) - 1
    return events.withColumns({"keys": F.array("event"), "phase": 2.0 * math.pi * (place + 0.5) / len(lex.EVENT_STRENGTH), "link_phase": F.lit(0.0)})


def rotating_columns(states: DataFrame, decay: float = 0.22) -> DataFrame:
    return state_columns(states).join(S.phases(states, decay).select(*A.STEP, "phase"), A.STEP)


def _signature(*parts: Column) -> Column:
    return F.concat(F.lit("event-phase::"), F.concat_ws("|", *parts))


def event_buckets(states: DataFrame, buckets: int = 8) -> DataFrame:
    """Adds event_bucket, a hash of what the step and the one before say, and alone_bucket, the same as if none came before."""
    said = lambda c, n: F.array_join(F.array_sort(F.slice(F.col(c), 1, n)), ",")
    rows = states.withColumn("_b", F.lag(F.struct(said(TUR, 2).alias("turns"), said(SEM, 2).alias("topics"))).over(S.by_step()))
    own = (said(TUR, 3), said(EMO, 3), said(REL, 3), said(SEM, 3))
    rows = rows.withColumns({"_s": _signature(*own, F.coalesce("_b.turns", F.lit("init")), F.coalesce("_b.topics", F.lit("init"))), "_a": _signature(*own, F.lit("init"), F.lit("init"))})
    return rows.withColumns({"event_bucket": hashing.fnv(F.col("_s"), buckets), "alone_bucket": hashing.fnv(F.col("_a"), buckets)}).drop("_b", "_s", "_a")


def event_phase_columns(states: DataFrame, decay: float = 0.22, buckets: int = 8) -> DataFrame:
    """Phases that grow with the strength of events, their buckets, and jumps between buckets."""
    rows = event_buckets(state_columns(states), buckets).join(S.events(states).select(*A.STEP, "strength"), A.STEP)
    angle = 2.0 * math.pi * (F.col("event_bucket") + 0.5) / buckets
    grown = F.exp(-decay * F.col("step_idx")) * F.when(F.col("strength") <= 1e-6, 0.05).otherwise(0.12 + 0.55 * F.col("strength") + 0.18 * angle)
    rows = rows.withColumn("phase", F.sum(grown).over(S.by_step().rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.col("phase") / (2.0 * math.pi)
    rows = rows.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((turn - F.floor(turn)) * buckets)).cast("string"))
    was = F.lag("alone_bucket").over(S.by_step()).cast("string")
    rows = rows.withColumn("_w", was)
    return rows.withColumns({"jump": F.when(F.col("_w").isNotNull() & (F.col("_w") != F.col("bucket")), F.array(F.concat("_w", F.lit("=>"), "bucket"))).otherwise(T.empty())}).drop("_w")


def transition_columns(states: DataFrame, buckets: int = 8) -> DataFrame:
    """Transition records: bucket, tags, shifts and signatures of each step."""
    low = lambda c, n, other: F.coalesce(F.nullif(F.array_join(F.array_sort(F.transform(F.slice(F.col(c), 1, n), F.lower)), "+"), F.lit("")), F.lit(other))
    own = event_buckets(states, buckets).select(*A.STEP, F.col("event_bucket").cast("string").alias("bucket"), low(REL, 2, "context").alias("relations"), low(ACTS, 2, "setup").alias("narrative"), F.coalesce(F.get(SEM, F.lit(0)), F.lit("misc")).alias("anchor"))
    made = own.join(S.events(states).select(*A.STEP, "event_tags", "strength", "tone_shift", "topic_shift", "causal_shift"), A.STEP)
    return made.withColumns({"keys": F.array("bucket"), "phase": 2.0 * math.pi * (F.col("bucket").cast("double") + 0.5) / buckets})


COLUMNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "state": state_columns, "finite": finite_columns, "relation": relation_columns, "canonical": canonical_columns, "semicanonical": lambda s: canonical_columns(s, True),
    "rotating": rotating_columns, "event_phase": event_phase_columns, "transition": transition_columns,
}
ENCODERS = {e.name: e for e in (STATE, FINITE, RELATION, CANONICAL, SEMICANONICAL, ROTATING, EVENT_PHASE, TRANSITION)}


def encoder_rows(states: DataFrame, name: str) -> DataFrame:
    """What the fold reads of each step: items, rooted, own, linked, later, opening, extra, keys, carry_weight, boost, phase, link_phase."""
    e = ENCODERS[name]
    rows = COLUMNS[name](states)
    named = sorted({p.column[2:] for f in (*e.before, *e.linked) for p in f.parts if not isinstance(p, str) and p.column.startswith("p.")})
    has = set(rows.columns)
    optional = {"boost": F.lit(1.0), "phase": F.lit(0.0)}
    rows = rows.withColumns({c: v for c, v in optional.items() if c not in has})
    rows = rows.withColumn("p", F.lag(F.struct("phase", *named)).over(S.by_step()))
    new = F.col("p").isNull()
    none = array_of(())
    items = F.when(new, array_of(e.now)).otherwise(F.concat(array_of(e.now), array_of(e.before)))
    made = rows.select(
        *A.STEP, items.alias("items"), array_of(e.rooted).alias("rooted"), array_of(e.own).alias("own"), F.when(new, none).otherwise(array_of(e.linked)).alias("linked"), array_of(e.later).alias("later"), array_of(e.opening).alias("opening"),
        array_of(e.extra).alias("extra"), "keys", (F.lit(e.carry_weight[0]) * (F.col(e.carry_weight[1]) if e.carry_weight[1] else F.lit(1.0))).cast("double").alias("carry_weight"), F.col("boost").cast("double").alias("boost"),
        F.col("phase").cast("double").alias("phase"), (F.col("link_phase") if "link_phase" in has else F.coalesce((F.col("p.phase") + F.col("phase")) / 2, F.lit(0.0))).alias("link_phase"),
    )
    return made.withColumn("step_idx", F.col("step_idx").cast("long"))


# --- vectors ------------------------------------------------------------------------------------------------------------
def complex_prototypes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the unit prototype of each text, LANES of each; lanes that share a place add up."""
    n, lanes = len(texts), A.LANES
    per_lane = lambda name: hashing.fnv_many([f"{t}::{name}::{j}" for t in texts for j in range(lanes)]).reshape(n, lanes)
    phase = (hashing.fnv_many([f"phase::{t}" for t in texts]) % np.uint64(8192)).astype(float)
    place = (per_lane("lane") % np.uint64(A.DIM)).astype(np.int64)
    sign = np.where(per_lane("sign") % np.uint64(2) == 0, -1.0, 1.0)
    value = sign * np.exp(1j * (2.0 * np.pi * phase[:, None] / 8192.0 + 2.0 * np.pi * np.arange(lanes) / lanes))
    return place, _of_unit_length(place, value)


def _of_unit_length(place: np.ndarray, value: np.ndarray) -> np.ndarray:
    together = (place[:, :, None] == place[:, None, :]) @ value[:, :, None]
    # Each lane of a shared place sees the whole sum; the square of a sum counts once.
    shares = (place[:, :, None] == place[:, None, :]).sum(axis=2)
    norm = np.sqrt((np.abs(together[:, :, 0]) ** 2 / shares).sum(axis=1)) + 1e-12
    return value / norm[:, None]


def signed_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One signed place for each text."""
    place = (hashing.fnv_many(texts) % np.uint64(A.DIM)).astype(np.int64)
    sign = np.where(hashing.fnv_many([f"sgn::{t}" for t in texts]) % np.uint64(2) == 0, -1.0, 1.0)
    return place[:, None], sign[:, None].astype(complex)


def address_prototypes(address: np.ndarray, lanes: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Real unit vectors of addresses."""
    per_lane = lambda name: hashing.fnv_many([f"{a}::{name}::{j}" for a in address.tolist() for j in range(lanes)]).reshape(len(address), lanes)
    place = (per_lane("lane") % np.uint64(A.DIM)).astype(np.int64)
    value = np.where(per_lane("sign") % np.uint64(2) == 0, -1.0, 1.0).astype(complex)
    return place, _of_unit_length(place, value)


class _Features:
    """Distinct texts of a batch, hashed once: their addresses, item prototypes and context vectors."""

    def __init__(self, texts: list[str], real: bool) -> None:
        self.address = (hashing.fnv_many(texts) % np.uint64(A.ADDRESSES)).astype(np.int64)
        if real:
            self.item = address_prototypes(self.address)
            self.context = signed_places(texts)
        else:
            self.item = self.context = complex_prototypes(texts)


def _flat(column, rows: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(row, text, weight) of an Arrow column of arrays of struct(feature, weight)."""
    ends = column.offsets.to_numpy()
    found = column.flatten()
    return np.repeat(np.arange(rows), np.diff(ends)), found.field("feature").to_pylist(), found.field("weight").to_numpy(zero_copy_only=False)


def _spread(n: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Dense sums (n, DIM) of weighed vectors by row."""
    place, value = vectors
    at = (row[:, None] * A.DIM + place[code]).ravel()
    x = (weight[:, None] * value[code]).ravel()
    return (np.bincount(at, x.real, n * A.DIM) + 1j * np.bincount(at, x.imag, n * A.DIM)).reshape(n, A.DIM)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((np.abs(x) ** 2).sum(axis=1)) + 1e-12)[:, None]


def _windows(e: Encoder, own, linked, later, opening, extra, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the last SPAN rows of a session, of the plain kinds and of extra; place counts a row's steps in its session."""
    base, more = np.zeros_like(own), np.zeros_like(own)
    n = np.minimum(place + 1, SPAN)
    for j in range(SPAN):
        rows = np.flatnonzero(n > j)
        k = (n[rows] - 1 - j).astype(float)
        fade = math.exp(-e.fade * j)
        weight = (fade * (1.0 + e.rise * k / n[rows]))[:, None]
        first = (k == 0)[:, None]
        base[rows] += weight * (own[rows - j] + np.where(first, opening[rows - j], later[rows - j])) + math.exp(-e.link_fade * j) * np.where(first, 0.0, linked[rows - j])
        more[rows] += fade * extra[rows - j]
    return base, more


KINDS = ("own", "linked", "later", "opening", "extra")


def folded(rows: DataFrame, e: Encoder, carry: bool = True) -> DataFrame:
    """(session_id, step_idx, address, weight, gate) of encoder_rows: the TOP strongest addresses of each step; carry: with those of the step before as items."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        session, steps, tail, before = None, 0, None, np.full(KEPT, -1)
        for batch in batches:
            for at in range(0, batch.num_rows, STEPS):
                part = batch.slice(at, STEPS)
                found, session, steps, tail, before = _fold(part, e, carry, session, steps, tail, before)
                yield pa.RecordBatch.from_arrays(found, names=["session_id", "step_idx", "address", "weight", "gate"])

    placed = rows.repartition("session_id").sortWithinPartitions("session_id", "step_idx")
    return placed.mapInArrow(run, "session_id string, step_idx long, address long, weight double, gate double")


def _fold(part, e: Encoder, carry: bool, session, steps: int, tail, before: np.ndarray):
    """One bounded run of steps: its rows, and what the session that may go on hands to the next run."""
    import pyarrow as pa

    n = part.num_rows
    col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
    ids = np.array(col["session_id"].to_pylist(), dtype=object)
    starts = np.concatenate(([True], ids[1:] != ids[:-1]))
    begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    place = np.arange(n) - begin
    goes_on = session is not None and ids[0] == session
    if goes_on:
        place[begin == 0] += steps
    flats = {k: _flat(col[k], n) for k in ("items", "rooted", *KINDS)}
    number: dict[str, int] = {}
    codes = {k: np.fromiter((number.setdefault(t, len(number)) for t in f[1]), np.int64, len(f[1])) for k, f in flats.items()}
    features = _Features(list(number), e.real)
    turn = np.exp(1j * col["phase"].to_numpy())
    dense = {k: _spread(n, flats[k][0], codes[k], flats[k][2], features.context) for k in KINDS}
    for k in KINDS:
        dense[k] *= (np.exp(1j * col["link_phase"].to_numpy()) if k == "linked" else turn)[:, None]
    # The last rows of the session that goes on come before the first ones of this run.
    held = len(tail["own"]) if goes_on else 0
    if held:
        dense = {k: np.concatenate([tail[k], dense[k]]) for k in KINDS}
    places = np.concatenate([np.arange(held), place]) if held else place
    base, more = (x[held:] for x in _windows(e, *(dense[k] for k in KINDS), places))
    if e.extra:
        base = _unit_rows(base) + more

    row, _, weight = flats["items"]
    code = codes["items"]
    if e.rooted:
        # Equal features of a step count by the root of how many there are.
        r, _, w = flats["rooted"]
        key, first, many = np.unique(r * len(number) + codes["rooted"], return_index=True, return_counts=True)
        row, code, weight = np.concatenate([row, key // len(number)]), np.concatenate([code, key % len(number)]), np.concatenate([weight, w[first] * np.sqrt(many)])
        order = np.argsort(row, kind="stable")
        row, code, weight = row[order], code[order], weight[order]
    item_at = np.searchsorted(row, np.arange(n + 1))
    boost, carry_weight = col["boost"].to_numpy(), col["carry_weight"].to_numpy()
    keys = col["keys"].to_pylist()
    out: list[tuple[np.ndarray, ...]] = []
    heads = np.flatnonzero(starts)
    length = np.diff(np.append(heads, n))
    tops = np.full((len(heads), KEPT), -1)
    if goes_on:
        tops[0] = before
    re, size, arc = e.signal
    for step in range(int(length.max(initial=0))):
        who = np.flatnonzero(length > step)
        now = heads[who] + step
        context = base[now]
        old = tops[who]
        if carry and e.context_carry:
            text, share = e.context_carry
            who_c, j = np.nonzero(old[:, :8] >= 0)
            made = _Features([text.format(address=a) for a in old[who_c, j]], e.real) if len(who_c) else None
            if made:
                context = context + _spread(len(who), who_c, np.arange(len(who_c)), np.full(len(who_c), share), made.context)
        context = _unit_rows(context).conj() * turn[now][:, None]
        # Static items of these steps, then carried ones.
        span = item_at[now + 1] - item_at[now]
        own = np.repeat(np.arange(len(now)), span)
        pick = np.arange(len(own)) - np.repeat(np.cumsum(span) - span, span) + np.repeat(item_at[now], span)
        address, heavy = features.address[code[pick]], weight[pick]
        where, value = features.item[0][code[pick]], features.item[1][code[pick]]
        if carry and e.carry:
            texts, owner = [], []
            for i, (r, top) in enumerate(zip(now, old, strict=True)):
                for a in top[: e.carried]:
                    if a >= 0:
                        texts += [e.carry.format(address=a, key=k) for k in keys[r]]
                        owner += [i] * len(keys[r])
            if texts:
                made = _Features(texts, e.real)
                own, address = np.concatenate([own, owner]), np.concatenate([address, made.address])
                heavy = np.concatenate([heavy, carry_weight[now][owner]])
                where, value = np.concatenate([where, made.item[0]]), np.concatenate([value, made.item[1]])
        if not len(own):
            continue
        # The angle of a product that is 0 but for rounding would be noise.
        z = (context[own[:, None], where] * value).sum(axis=1).round(12)
        x = re * z.real + size * np.abs(z) + (arc * np.cos(np.arctan2(z.imag, z.real + 1e-12)) if arc else 0.0)
        gate = 1.0 / (1.0 + np.exp(-np.clip(x, -20.0, 20.0)))
        key, back = np.unique(own * A.ADDRESSES + address, return_inverse=True)
        total = np.bincount(back, heavy * gate * boost[now][own], len(key))
        most = np.zeros(len(key))
        np.maximum.at(most, back, gate)
        who_k, address_k = key // A.ADDRESSES, key % A.ADDRESSES
        order = np.lexsort((address_k, -np.round(total, 9), who_k))
        rank = np.arange(len(key)) - np.searchsorted(who_k, who_k)
        kept = order[rank < TOP]
        rank = rank[rank < TOP]
        out.append((now[who_k[kept]], address_k[kept], total[kept], most[kept]))
        new = np.full((len(who), KEPT), -1)
        few = rank < KEPT
        new[who_k[kept][few], rank[few]] = address_k[kept][few]
        # A step without items leaves what was carried to it.
        some = np.isin(np.arange(len(who)), who_k)
        tops[who[some]] = new[some]
    done = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
    order = np.argsort(done[0], kind="stable")
    at = pa.array(done[0][order])
    found = [col["session_id"].take(at), col["step_idx"].take(at), pa.array(done[1][order]), pa.array(done[2][order]), pa.array(done[3][order])]
    last = int(held + begin[-1]) if begin[-1] or not held else 0
    tail = {k: dense[k][max(last, len(dense[k]) - (SPAN - 1)) :] for k in KINDS}
    return found, ids[-1], int(place[-1]) + 1, tail, tops[-1]


def ungated(rows: DataFrame) -> DataFrame:
    """(session_id, step_idx, address, weight): sums of the items of encoder_rows, the TOP strongest of each step."""
    return A.plain(rows.select(*A.STEP, F.explode("items").alias("i")).select(*A.STEP, "i.feature", "i.weight")).drop("gate")


def addresses_of(states: DataFrame, name: str, carry: bool = True) -> DataFrame:
    """Gated addresses of an encoder by its name; states are rule states, events for the finite one."""
    return folded(encoder_rows(states, name), ENCODERS[name], carry)
