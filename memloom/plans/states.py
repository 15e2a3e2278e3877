"""Queries over states of sessions: rule states, constraint edges, graphs, chains, events, phases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import hashing
from ..operators import states as S
from ..sources import catalogue
from .registry import query, read
from .texts import SQL_TOPICS, sql_distinct, sql_entities, sql_labels, sql_list, sql_parts, sql_tokens

NONE = "CAST([] AS VARCHAR[])"
SQL_CHUNKS = rf"""
ss AS (SELECT 'conv_' || conv_id AS session_id, trim(coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations GROUP BY conv_id),
cd AS (SELECT session_id, list_filter({sql_parts('text')}, lambda x: length(x) >= 8) AS s, {sql_tokens('text')} AS k FROM ss),
cc AS (SELECT session_id, CASE WHEN len(s) > 0 THEN list_transform(range(1, len(s) + 1, 2), lambda i: array_to_string(s[i:i+1], '. ')) ELSE list_transform(range(1, len(k) + 1, 24), lambda i: array_to_string(k[i:i+23], ' ')) END AS c FROM cd),
ch AS (SELECT session_id, generate_subscripts(c, 1) - 1 AS step_idx, unnest(c) AS chunk FROM cc)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(catalogue.sessions(catalogue.turns(read(spark, sf_dir, "conversations"))))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by the test lexicons, whose words occur in the driver's prose."""
    return S.rule_states(chunks(spark, sf_dir), lex.TEST_TONES, lex.TEST_FLAGS, lex.TEST_CAUSAL, lex.TEST_TURNS)


_or = lambda a, other: f"CASE WHEN len({a}) > 0 THEN {a} ELSE ['{other}'] END"
_if = lambda c, v: f"CASE WHEN {c} THEN ['{v}'] ELSE {NONE} END"
_has = lambda a, *v: "(" + " OR ".join(f"list_contains({a}, '{x}')" for x in v) + ")"
_cat = lambda first, *rest: first if not rest else _cat(f"list_concat({first}, {rest[0]})", *rest[1:])
_found = lambda lexicon: "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{n}' END" for w, n in lexicon) + "], lambda x: x IS NOT NULL)"
_part = lambda name, a, at: f"CASE WHEN len({a}) >= {at} THEN ['{name}::' || {a}[{at}]] ELSE {NONE} END"
_VERB = f"x NOT IN {sql_list(lex.STOP_WORDS)} AND (x IN {sql_list(lex.COMMON_VERBS)} OR regexp_matches(x, '({'|'.join(lex.VERB_ENDINGS)})$'))"
_RELATION = "CASE f" + "".join(f" WHEN '{a}' THEN '{b}'" for a, b in lex.FLAG_RELATIONS) + " END"
SQL_STATES = f"""{SQL_CHUNKS},
d AS (SELECT session_id || '#' || step_idx AS id, chunk AS t, session_id, step_idx FROM ch), {SQL_TOPICS},
s0 AS (SELECT d.session_id, d.step_idx, d.t AS chunk, lower(d.t) AS low, {sql_tokens('d.t')} AS k, {sql_labels('d.t', lex.TEST_FLAGS)} AS fl, {sql_labels('d.t', lex.TEST_TONES)} AS em,
  list_concat(list_transform({sql_entities('d.t')}, lambda x: lower(x)), coalesce(topics, {NONE}))[1:4] AS keys FROM d LEFT JOIN tp USING (id)),
s1 AS (SELECT *, {_or(sql_distinct('keys'), 'misc')} AS sem, list_filter({_cat(f'list_filter(k, lambda x: {_VERB})', f'list_transform(fl, lambda f: {_RELATION})', _if("contains(chunk, '?')", 'question'))}, lambda x: x IS NOT NULL) AS said,
  {_found(lex.TEST_CAUSAL)} AS c0, {_found(lex.TEST_TURNS)} AS t0 FROM s0),
s2 AS (SELECT *, {_or(sql_distinct('said') + '[1:4]', 'context')} AS rel FROM s1),
s3 AS (SELECT *, {sql_distinct(_cat('c0', _if(f"{_has('rel', 'decision')} AND NOT {_has('c0', 'cause')}", 'deliberation'), _if(f"{_has('rel', 'question')} AND NOT {_has('c0', 'condition')}", 'uncertainty')))}[1:4] AS cau,
  {sql_distinct(_cat('t0', _if(_has('fl', 'PIVOT'), 'pivot'), _if(_has('fl', 'DECISION'), 'commit'), _if(_has('fl', 'GENESIS', 'ORIGIN'), 'origin')))}[1:4] AS tur, count(*) OVER (PARTITION BY session_id) AS n FROM s2),
s4 AS (SELECT *, {sql_distinct(_cat(_part('actor', 'sem', 1), _part('target', 'sem', 2), _part('action', 'rel', 1), _part('modifier', 'rel', 2), _part('motive', 'cau', 1), _part('turn', 'tur', 1), _if(_has('fl', 'DECISION'), 'outcome::decision'), _if(_has('fl', 'PIVOT'), 'outcome::pivot'), _if(_has('fl', 'CORE'), 'outcome::principle')))}[1:8] AS roles,
  {_cat(_if(f"{_has('cau', 'cause')} AND ({_has('rel', 'decision')} OR {_has('fl', 'DECISION')})", 'schema::cause_to_decision'), _if(f"{_has('cau', 'effect')} AND ({_has('rel', 'transition')} OR {_has('fl', 'PIVOT')})", 'schema::decision_to_effect'), _if(_has('cau', 'condition'), 'schema::conditional_branch'), _if(_has('cau', 'deliberation'), 'schema::deliberation_loop'), _if(f"{_has('cau', 'uncertainty')} OR {_has('rel', 'question')}", 'schema::uncertain_resolution'), _if(f"{_has('rel', 'origin')} OR {_has('fl', 'GENESIS', 'ORIGIN')}", 'schema::origin_chain'))}[1:6] AS schemas,
  {_cat("CASE WHEN step_idx = 0 THEN ['act::opening'] WHEN step_idx = n - 1 THEN ['act::closing'] ELSE ['act::middle'] END", _if(f"{_has('tur', 'origin')} OR {_has('fl', 'ORIGIN', 'GENESIS')}", 'act::setup'), _if(_has('tur', 'contrast', 'redirect'), 'act::complication'), _if(f"{_has('fl', 'PIVOT')} OR {_has('tur', 'pivot')}", 'act::turn'), _if(f"{_has('fl', 'DECISION')} OR {_has('tur', 'commit')}", 'act::commitment'), _if(f"{_has('tur', 'resolution')} OR (step_idx >= greatest(n - 2, 0) AND {_has('rel', 'decision')})", 'act::resolution'), _if(f"{_has('rel', 'question')} OR {_has('tur', 'inquiry')}", 'act::inquiry'))}[1:6] AS acts FROM s3),
st AS (SELECT session_id, step_idx, chunk, sem, rel, fl, em, cau, tur, roles, schemas, acts,
  1.0 + 0.15 * len(sem) + 0.1 * len(rel) + 0.08 * len(cau) + 0.08 * len(tur) + 0.08 * len(roles) + 0.1 * len(schemas) + 0.1 * len(acts) + CASE WHEN {_has('fl', 'DECISION', 'PIVOT', 'CORE')} THEN 0.25 ELSE 0 END AS weight FROM s4)"""
def sql_steps(ch: str = "ch", p: str = "") -> str:
    """Constraint steps (ls, sw) and edges (ed) of a table of chunks, under a prefix."""
    return f"""
{p}k0 AS (SELECT *, {sql_distinct(sql_tokens('chunk'))} AS k FROM {ch}),
{p}ls AS (SELECT session_id, step_idx, coalesce(k[1], 'context') AS current, {_or('k[2:3]', 'persistence')} AS preferred, k[4:5] AS forbidden, {_or('k[6:7]', 'maintain_local_context')} AS required, {_or('k[8:9]', 'persistence')} AS triggers, 0.5 AS confidence FROM {p}k0),
{p}sw AS (SELECT *, 1.0 + 0.7 * confidence + 0.08 * len(preferred) + 0.05 * len(forbidden) AS w, lag(current) OVER q AS pc, lag(preferred) OVER q AS pp, lag(forbidden) OVER q AS pf FROM {p}ls WINDOW q AS (PARTITION BY session_id ORDER BY step_idx)),
{p}ed AS (SELECT session_id, step_idx, current AS source_state, 'allow' AS edge_type, unnest(preferred[1:4]) AS target, 3.2 * w * (1.0 + 0.08 * len(list_distinct(required))) AS weight, '' AS trigger, '' AS status, 0 AS g, generate_subscripts(preferred[1:4], 1) AS i FROM {p}sw
  UNION ALL SELECT session_id, step_idx, current, 'block', unnest(forbidden[1:3]), 2.9 * w * (1.0 + 0.06 * len(forbidden)), '', '', 1, generate_subscripts(forbidden[1:3], 1) FROM {p}sw
  UNION ALL SELECT session_id, step_idx, current, 'require', unnest(required[1:3]), 2.7 * w, '', '', 2, generate_subscripts(required[1:3], 1) FROM {p}sw
  UNION ALL SELECT session_id, step_idx, current, 'trigger', current, 2.5 * w, unnest(triggers[1:3]), '', 3, generate_subscripts(triggers[1:3], 1) FROM {p}sw
  UNION ALL SELECT session_id, step_idx, pc, 'step', current, 2.8, '', '', 4, 1 FROM {p}sw WHERE pc IS NOT NULL
  UNION ALL SELECT session_id, step_idx, pc, 'flow', current, CASE WHEN x = current THEN 3.0 ELSE 2.4 END, x, CASE WHEN x = current THEN 'realized' ELSE 'outside' END, 5, i FROM (SELECT *, unnest(pp[1:2]) AS x, generate_subscripts(pp[1:2], 1) AS i FROM {p}sw WHERE pc IS NOT NULL)
  UNION ALL SELECT session_id, step_idx, pc, 'conflict', current, 2.7, x, 'blocked', 6, i FROM (SELECT *, unnest(pf[1:2]) AS x, generate_subscripts(pf[1:2], 1) AS i FROM {p}sw WHERE pc IS NOT NULL) WHERE x = current)"""


SQL_STEPS = f"{SQL_CHUNKS},{sql_steps()}"
SQL_TRANSITIONS = f"tr AS (SELECT *, CASE WHEN {_has('tur', 'contrast', 'redirect')} THEN 'reframe' WHEN {_has('cau', 'cause')} THEN 'cause_to_decision' WHEN {_has('cau', 'effect')} THEN 'decision_to_effect' ELSE 'persistence' END AS transition FROM st)"

ARRAYS = {"semantic_keys": "sem", "relation_keys": "rel", "flags": "fl", "emotions": "em", "causal_markers": "cau", "turn_markers": "tur", "event_roles": "roles", "causal_schemas": "schemas", "narrative_acts": "acts"}


def _joined(names) -> list:
    return [F.array_join(n, ",").alias(n) for n in names]


@query(f"WITH {SQL_STATES} SELECT session_id, step_idx, {', '.join(f'''array_to_string({b}, ',') AS {a}''' for a, b in ARRAYS.items())}, round(weight, 6)::DOUBLE AS weight FROM st")
def rule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, markers, roles, schemas, acts and weight of each chunk by keyword rules."""
    return rule_rows(spark, sf_dir).select("session_id", F.col("step_idx").cast("long").alias("step_idx"), *_joined(ARRAYS), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {SQL_CHUNKS}, k0 AS (SELECT *, {sql_tokens('chunk')} AS k FROM ch), l AS (SELECT *, {_or('k[1:3]', 'context')} AS lead3 FROM k0)
SELECT session_id, step_idx, CASE WHEN len(k) > 0 THEN array_to_string(k[1:12], ' ') ELSE substr(chunk, 1, 120) END AS summary, coalesce(lead3[1], 'speaker') AS actor, coalesce(lead3[2], 'topic') AS target, coalesce(lead3[3], 'describe') AS action,
  array_to_string({sql_distinct("list_concat(lead3, ['fallback'])")}[1:4], ',') AS state_tags FROM l"""
)
def fallback_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk states from the first tokens, when no extractor is at hand."""
    made = S.fallback_chunk_states(chunks(spark, sf_dir))
    return made.select("session_id", F.col("step_idx").cast("long").alias("step_idx"), "summary", "actor", "target", "action", *_joined(["state_tags"]))


@query()
def fallback_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common state fields of fallback chunk states."""
    return S.fields_of_chunk_states(S.fallback_chunk_states(chunks(spark, sf_dir)))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lexical_steps(chunks(spark, sf_dir))


_TOKEN = "concat_ws('::', edge_type, source_state, target, CASE WHEN trigger <> '' THEN 'trigger=' || trigger END, CASE WHEN status <> '' THEN 'status=' || status END)"


@query(f"WITH {SQL_STEPS} SELECT session_id, step_idx, source_state, edge_type, target, trigger, status, round(weight, 6)::DOUBLE AS weight, {_TOKEN} AS token FROM ed")
def constraint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed edges of every step."""
    made = S.constraint_edges(steps(spark, sf_dir))
    return made.select("session_id", F.col("step_idx").cast("long").alias("step_idx"), "source_state", "edge_type", "target", "trigger", "status", F.round("weight", 6).alias("weight"), "token")


@query(
    f"""WITH {SQL_STEPS}, b AS (SELECT session_id, target, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, step_idx, g, i) AS r FROM ed WHERE edge_type IN ('flow', 'conflict', 'step')) WHERE r = 1),
a AS (SELECT DISTINCT session_id, unnest(preferred[1:4]) AS target FROM ls)
SELECT b.session_id, b.target AS actual_next, CASE b.status WHEN 'realized' THEN 'satisfied' WHEN 'blocked' THEN 'violated' WHEN 'outside' THEN 'outside' ELSE CASE WHEN a.target IS NOT NULL THEN 'satisfied' ELSE 'outside' END END AS status FROM b LEFT JOIN a USING (session_id, target)"""
)
def derived_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each session goes next and whether its constraints held."""
    rows = steps(spark, sf_dir)
    return S.derived_constraints(rows, S.constraint_edges(rows))


@query(
    f"""WITH {SQL_STATES}, {SQL_TRANSITIONS}, l AS (SELECT *, lead(step_idx) OVER q AS after, lead(sem) OVER q AS sem2 FROM tr WINDOW q AS (PARTITION BY session_id ORDER BY step_idx))
SELECT session_id, 'n' || step_idx AS source, 'n' || after AS target, transition AS type, coalesce(CASE WHEN transition = 'reframe' THEN list_min(list_intersect(sem, sem2)) END, '') AS entity FROM l WHERE after IS NOT NULL"""
)
def session_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the session graphs, with the entity that a reframe turns on."""
    return S.session_graph(S.transitions(rule_rows(spark, sf_dir)))


@query(
    f"""WITH {SQL_STATES}, {SQL_TRANSITIONS}, m AS (SELECT session_id, step_idx, transition IN {sql_list(lex.CAUSAL_TRANSITIONS)} AS causal, lead(step_idx) OVER q IS NULL AS last FROM tr WINDOW q AS (PARTITION BY session_id ORDER BY step_idx)),
i AS (SELECT *, sum((NOT causal)::INT) OVER (PARTITION BY session_id ORDER BY step_idx) AS island FROM m),
r AS (SELECT session_id, island, min(step_idx) AS a, max(step_idx) AS b FROM i WHERE causal AND NOT last GROUP BY ALL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY a) - 1 AS chain_idx, array_to_string(list_transform(range(a, b + 2), lambda x: 'n' || x), '>') AS chain FROM r"""
)
def causal_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of neighbouring causal transitions."""
    return S.causal_islands(S.transitions(rule_rows(spark, sf_dir))).withColumn("chain_idx", F.col("chain_idx").cast("long"))


@query(
    f"""WITH {SQL_STATES}, k0 AS (SELECT session_id, step_idx, {sql_distinct(sql_tokens('chunk'))} AS k FROM ch), ls AS (SELECT session_id, step_idx, coalesce(k[1], 'context') AS current, {_or('k[8:9]', 'persistence')} AS triggers FROM k0),
b AS (SELECT session_id, step_idx, tur, rel, current, triggers, lag(current) OVER q AS pc, lag(rel) OVER q AS pr FROM st JOIN ls USING (session_id, step_idx) WINDOW q AS (PARTITION BY session_id ORDER BY step_idx)),
c AS (SELECT *, round((pc <> current)::INT + 0.4 * least(len(tur), 3) + 0.3 * len(triggers) + 0.2 * len(list_filter(rel[1:3], lambda x: NOT list_contains(pr[1:3], x))), 6)::DOUBLE AS score FROM b WHERE pc IS NOT NULL)
SELECT session_id, step_idx - 1 AS start_turn, step_idx AS end_turn, pc AS pre_state, current AS post_state, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, step_idx) AS r FROM c) WHERE r = 1"""
)
def turning_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turning point of each session."""
    made = S.turning_points(rule_rows(spark, sf_dir), steps(spark, sf_dir))
    return made.withColumns({"start_turn": F.col("start_turn").cast("long"), "end_turn": F.col("end_turn").cast("long")})


@query(
    f"""WITH {SQL_STATES}, p AS (SELECT session_id, chunk, row_number() OVER (PARTITION BY session_id ORDER BY step_idx) AS nth FROM st WHERE len(cau) > 0 OR len(schemas) > 0 OR len(list_filter(rel, lambda x: contains(x, 'cause'))) > 0)
SELECT session_id, nth, trim(substr(chunk, 1, 160)) AS step FROM p WHERE nth <= 3"""
)
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three causal chunks of each session."""
    return S.causal_chains(rule_rows(spark, sf_dir)).withColumn("nth", F.col("nth").cast("long"))


def _rule_sql(i: int, rule) -> str:
    domain, slot, label, any_of, all_of = rule
    some = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
    said = [some(domain), *([some(any_of)] if any_of else []), *(f"contains(low, '{w}')" for w in all_of)]
    return f"SELECT doc_id, '{slot}' AS slot, '{label}' AS label, {i} AS i FROM l WHERE {' AND '.join(said)}"


@query(f"WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), f AS ({' UNION ALL '.join(_rule_sql(i, r) for i, r in enumerate(lex.TEST_PHRASE_RULES))}) SELECT doc_id, slot, string_agg(label, ',' ORDER BY i) AS labels FROM f GROUP BY doc_id, slot")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint labels by a table of phrase rules."""
    return S.phrase_rules(read(spark, sf_dir, "documents"), lex.TEST_PHRASE_RULES, "doc_id")


_shift = lambda a, p, other: f"CASE WHEN {p} IS NULL THEN 'init=>' || coalesce(list_min({a}), '{other}') WHEN coalesce(list_sort({a}), {NONE}) = list_sort({p}) THEN coalesce(list_min({a}), '{other}') ELSE coalesce(list_min({p}), '{other}') || '=>' || coalesce(list_min({a}), '{other}') END"
_novel = lambda a, p: f"len(list_filter(list_distinct({a}), lambda x: NOT list_contains({p}, x)))"
_TONES = _has("emo", "contrastive", "assertive", "uncertain", "tense")
_JUMP, _SOLVED, _ASKED = _has("turns", "turn", "contrast", "reframe", "redirect"), _has("turns", "resolution", "commitment"), _has("turns", "inquiry")
_MOVED = _has("rel", "topic_shift", "reframe", "question_to_resolution", "cause_to_decision")
_differs = lambda a: f"(p_{a} IS NOT NULL AND list_sort(list_distinct({a})) <> list_sort(list_distinct(p_{a})))"
SQL_EVENTS = f"""
e0 AS (SELECT session_id, step_idx, rel, fl, sem[1:3] AS sem3, em[1:3] AS emo, tur[1:3] AS tur3, rel[1:3] AS rel3, list_concat(cau[1:2], schemas[1:2]) AS cau4, list_concat(tur[1:3], acts[1:3]) AS turns FROM st),
e1 AS (SELECT *, lag(sem3) OVER q AS p_sem3, lag(emo) OVER q AS p_emo, lag(tur3) OVER q AS p_tur3, lag(rel3) OVER q AS p_rel3, lag(cau4) OVER q AS p_cau4 FROM e0 WINDOW q AS (PARTITION BY session_id ORDER BY step_idx)),
e2 AS (SELECT *, {_novel('sem3', 'p_sem3')} AS novel, len(list_intersect(sem3, p_sem3)) AS overlap FROM e1),
e3 AS (SELECT *, CASE WHEN p_sem3 IS NULL THEN 'init' WHEN novel >= 2 AND overlap = 0 THEN 'hard_shift' WHEN novel >= 1 AND overlap >= 1 THEN 'soft_shift' WHEN overlap >= 2 THEN 'persist' ELSE 'mixed' END AS topic_shift,
  {_shift('emo', 'p_emo', 'flat')} AS tone_shift, {_shift('cau4', 'p_cau4', 'background')} AS causal_shift FROM e2),
e4 AS (SELECT *, CASE WHEN {_JUMP} THEN 1.2 ELSE 0 END + CASE WHEN {_SOLVED} OR {_ASKED} THEN 0.6 ELSE 0 END + CASE WHEN {_TONES} THEN 0.9 ELSE 0 END + CASE WHEN {_MOVED} THEN 1.0 ELSE 0 END
  + CASE WHEN {_differs('sem3')} THEN 0.7 ELSE 0 END + CASE WHEN {_differs('tur3')} THEN 0.7 ELSE 0 END + CASE WHEN {_differs('emo')} THEN 0.5 ELSE 0 END AS strength,
  {_cat(_if(_JUMP, 'turn_jump'), _if(_SOLVED, 'resolution_jump'), _if(_ASKED, 'question_jump'), _if(_TONES, 'tone_jump'), _if(_MOVED, 'relation_jump'), _if(_differs('sem3'), 'topic_jump'))} AS tags,
  CASE WHEN {_has('rel', 'question_to_resolution')} OR {_SOLVED} THEN 'resolution' WHEN {_has('rel', 'cause_to_decision')} OR ({_has('fl', 'DECISION')} AND {_has('cau4', 'cause', 'effect')}) THEN 'cause_to_decision'
  WHEN {_has('rel', 'reframe')} OR {_has('turns', 'reframe', 'redirect', 'contrast')} THEN 'reframe' WHEN {_has('rel', 'topic_shift')} OR topic_shift IN ('hard_shift', 'soft_shift') THEN 'topic_shift'
  WHEN {_ASKED} OR {_has('rel', 'question')} THEN 'question' WHEN tone_shift NOT IN ('init', 'flat', 'flat=>flat') AND {_TONES} THEN 'tone_flip' WHEN {_has('turns', 'turn')} THEN 'turn' ELSE 'persistence' END AS event FROM e3),
ev AS (SELECT session_id, step_idx, topic_shift, tone_shift, causal_shift, array_to_string({_or('tags', 'persistence')}, ',') AS event_tags, round(strength, 6)::DOUBLE AS strength, event, coalesce(lag(event) OVER (PARTITION BY session_id ORDER BY step_idx), 'init') AS event_before,
  round(CASE event{''.join(f" WHEN '{n}' THEN {v}" for n, v in lex.EVENT_STRENGTH)} END + CASE WHEN p_sem3 IS NULL THEN 0 ELSE 0.3 * novel + 0.2 * {_novel('rel3', 'p_rel3')} END, 6)::DOUBLE AS event_strength,
  CASE WHEN {_has('rel', 'cause_to_decision', 'decision_to_effect', 'decision_to_implementation')} THEN 'causal_transition' WHEN {_has('rel', 'reframe', 'topic_shift')} THEN 'topic_transition' WHEN {_has('rel', 'question', 'question_to_resolution')} THEN 'inquiry_transition' ELSE 'context_transition' END AS relation_signature FROM e4)"""


@query(f"WITH {SQL_STATES}, {SQL_EVENTS} SELECT * FROM ev")
def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts, tags, strengths and the finite event of each step."""
    made = S.events(rule_rows(spark, sf_dir))
    return made.withColumns({"step_idx": F.col("step_idx").cast("long"), "event_tags": F.array_join("event_tags", ","), "strength": F.round("strength", 6), "event_strength": F.round("event_strength", 6)})


_KEY = "CASE WHEN len(sem3) = 0 THEN 'misc' ELSE array_to_string(list_sort(sem3), '|') END"
_TONE = "CASE x" + "".join(f" WHEN '{n}' THEN {v}" for n, v in lex.TONE_SHIFTS) + " ELSE 0 END"


@query(
    f"""WITH {SQL_STATES}, e0 AS (SELECT session_id, step_idx, sem[1:3] AS sem3, em[1:4] AS emo, list_sort(list_distinct(tur[1:2])) AS two, list_concat(tur[1:3], acts[1:3]) AS turns FROM st),
e1 AS (SELECT *, lag(sem3) OVER q AS ps, lag(emo) OVER q AS pe, lag(two) OVER q AS pt FROM e0 WINDOW q AS (PARTITION BY session_id ORDER BY step_idx)),
e2 AS (SELECT session_id, step_idx, exp(-0.05 * step_idx) * (0.55 * {2 * math.pi} * {hashing.fnv_sql("'topic-phase::' || " + _KEY, 8192)} / 8192.0
  + CASE WHEN {_has('turns', 'turn', 'contrast', 'reframe')} THEN 0.75 ELSE 0 END + CASE WHEN {_has('turns', 'resolution', 'commitment')} THEN 0.35 ELSE 0 END + CASE WHEN pt IS NOT NULL AND two <> pt THEN 0.45 ELSE 0 END
  + coalesce(list_sum(list_transform(emo, lambda x: {_TONE})), 0) + CASE WHEN ps IS NULL THEN 0 ELSE 0.35 * {_novel('emo', 'pe')} + 0.4 * {_novel('sem3', 'ps')} - 0.18 * len(list_intersect(sem3, ps)) END) AS inc FROM e1)
SELECT session_id, step_idx, round(inc, 5)::DOUBLE AS increment, round(sum(inc) OVER (PARTITION BY session_id ORDER BY step_idx), 5)::DOUBLE AS phase FROM e2"""
)
def phase_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decaying phase of each step and its running sum."""
    made = S.phases(rule_rows(spark, sf_dir))
    return made.select("session_id", F.col("step_idx").cast("long").alias("step_idx"), F.round("increment", 5).alias("increment"), F.round("phase", 5).alias("phase"))
