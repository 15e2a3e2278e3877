"""Evaluation queries: item metrics, roll-ups by task and protocol, deltas, sub-scores and the total.

The driver's tables hold no benchmark of this kind, so items and predictions are made
from the words of every turn: gold parts take them from the start, predictions of a
variant from some words later, and some items lack a variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import evaluate as E
from .registry import query, read
from .texts import sql_normal

TASKS = ("event_recall", "causal_recall", "turning_point_recall", "constraint_recall", "cue_recall")
#: (variant, words by which its predictions are off)
VARIANTS = (("fixed_budget", 0), ("weak_cue", 2), ("stage_weak_cue", 3), ("refined_cue", 1), ("full_question", 0), ("chunk_shuffle", 1), ("relation_shuffle", 2), ("constraint_perturbation", 1))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id").cast("long") * 1_000_000 + F.col("turn")).alias("id"), F.split(T.normalise(F.col("text")), " ").alias("w"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, task_type, gold_* as operators.evaluate wants them."""
    w, i = F.col("w"), F.col("id")
    part = lambda at, n: F.slice(w, at, n)
    said = lambda at, n: F.array_join(part(at, n), " ")
    none = T.empty()
    session = F.concat(F.lit("conv_"), i.cast("string"))
    turning = F.struct(session.alias("session_id"), F.lit(1).cast("long").alias("start_turn"), F.lit(3).cast("long").alias("end_turn"), said(1, 3).alias("pre_state"), F.when(i % 2 == 0, said(4, 3)).alias("post_state"))
    return _words(spark, sf_dir).select(
        i.alias("item_id"),
        F.element_at(F.array(*map(F.lit, TASKS)), (i % 5 + 1).cast("int")).alias("task_type"),
        F.array(session).alias("gold_sessions"),
        F.array(F.struct(session.alias("session_id"), F.lit(0).cast("long").alias("start_turn"), (F.size(w) % 4).cast("long").alias("end_turn"), F.lit(0.0).alias("score"))).alias("gold_spans"),
        part(1, 5).alias("gold_entities"),
        part(2, 3).alias("gold_allowed"),
        F.when(i % 3 == 0, part(5, 2)).otherwise(none).alias("gold_forbidden"),
        part(8, 2).alias("gold_required"),
        F.when(i % 4 != 0, F.get(w, F.lit(0))).alias("gold_actual_next"),
        F.when(i % 2 == 0, "satisfied").otherwise("violated").alias("gold_status"),
        F.when(i % 3 != 1, F.array(said(1, 4), said(5, 4), said(9, 4))).otherwise(none).alias("gold_chain"),
        F.when((i % 5).isin(1, 2), turning).alias("gold_turning"),
        F.struct(F.get(w, F.lit(0)).alias("tone"), F.get(w, F.lit(1)).alias("mode"), (F.size(w) % 10 / 10.0).alias("uncertainty")).alias("gold_scene"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, variant, pred_*."""
    made = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(k).cast("long").alias("k")) for n, k in VARIANTS)))
    rows = _words(spark, sf_dir).withColumn("v", made).select("id", "w", "v.variant", "v.k").where((F.col("id") + F.col("k")) % 7 != 6)
    w, i, k = F.col("w"), F.col("id"), F.col("k")
    at = lambda start: F.lit(start) + k.cast("int")
    part = lambda start, n: F.slice(w, at(start), F.lit(n))
    said = lambda start, n: F.array_join(part(start, n), " ")
    session = lambda x: F.concat(F.lit("conv_"), x.cast("string"))
    span = lambda s, a, b: F.struct(s.alias("session_id"), a.cast("long").alias("start_turn"), b.cast("long").alias("end_turn"), F.lit(0.5).alias("score"))
    turning = F.struct(session(i).alias("session_id"), k.alias("start_turn"), (k + 2).alias("end_turn"), said(1, 3).alias("pre_state"), said(5, 3).alias("post_state"))
    stats = F.create_map(F.lit("raw_bytes"), F.size(w) * 10.0, F.lit("bytes_used"), F.size(w) * 2.0 + k, F.lit("compression_ratio"), F.when(i % 2 == 0, 4.0).otherwise(0.0), F.lit("latency_ms"), 10.0 + k, F.lit("archive_support_ratio"), F.lit(0.25))
    return rows.select(
        i.alias("item_id"),
        "variant",
        F.array(session(i + k % 2), session(i), session(i + 2)).alias("pred_sessions"),
        F.array(span(session(i), k, k + 2), span(F.lit(" "), k, k)).alias("pred_spans"),
        part(2, 5).alias("pred_entities"),
        part(2, 4).alias("pred_allowed"),
        T.empty().alias("pred_forbidden"),
        part(7, 3).alias("pred_required"),
        F.upper(F.get(w, k.cast("int"))).alias("pred_actual_next"),
        F.lit("satisfied").alias("pred_status"),
        F.when(i % 4 != 1, F.array(said(5, 4), said(1, 4), said(10, 4))).otherwise(T.empty()).alias("pred_chain"),
        F.when(i % 3 != 0, turning).alias("pred_turning"),
        F.struct(F.get(w, k.cast("int")).alias("tone"), F.get(w, F.lit(1)).alias("mode"), F.when(i % 3 != 0, F.lit(0.3)).alias("uncertainty")).alias("pred_scene"),
        stats.alias("pred_stats"),
    )


# --- the same in DuckDB's SQL -------------------------------------------------------------------------------------------
_said = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
_clean = lambda a: f"list_distinct(list_filter(list_transform({a}, lambda x: lower(trim(x))), lambda x: x <> ''))"
_split = lambda t: f"list_distinct(list_filter(string_split(lower({t}), ' '), lambda z: z <> ''))"
_f1 = lambda g, p: f"(CASE WHEN len({g}) + len({p}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({g}, {p})) / greatest(len({g}) + len({p}), 1) END)"
_NONE = "CAST([] AS VARCHAR[])"
_k = lambda a, b: f"w[{a} + k:{b} + k]"
_ksaid = lambda a, b: f"array_to_string(w[{a} + k:{b} + k], ' ')"
_same = lambda g, p: f"CASE WHEN {g} IS NULL THEN 0.0 ELSE (lower(trim({g})) = lower(trim(coalesce({p}, ''))))::INT::DOUBLE END"
_best = lambda a, b: f"list_transform({a}, lambda s: list_max(list_transform({b}, lambda t: {_f1('s', 't')})))"
_mean = lambda a: f"(coalesce(list_sum({a}), 0) / greatest(len({a}), 1))"
_iou = lambda a0, a1, b0, b1: f"greatest(least({a1}, {b1}) - greatest({a0}, {b0}) + 1, 0)::DOUBLE / greatest(greatest({a1}, {b1}) - least({a0}, {b0}) + 1, 1)"

SQL_SCORED = f"""
f AS (SELECT conv_id::BIGINT * 1000000 + turn AS id, string_split({sql_normal('text')}, ' ') AS w FROM conversations),
va(variant, k) AS (VALUES {', '.join(f"('{n}', {k})" for n, k in VARIANTS)}),
g AS (SELECT id AS item_id, ([{', '.join(f"'{t}'" for t in TASKS)}])[id % 5 + 1] AS task_type, w, {_clean('w[1:5]')} AS ge, {_clean('w[2:4]')} AS ga, {_clean(f'CASE WHEN id % 3 = 0 THEN w[5:6] ELSE {_NONE} END')} AS gf, {_clean('w[8:9]')} AS gr,
  CASE WHEN id % 4 <> 0 THEN w[1] END AS gn, CASE WHEN id % 2 = 0 THEN 'satisfied' ELSE 'violated' END AS gs, len(w) % 4 AS g1,
  CASE WHEN id % 3 <> 1 THEN [{_split(_said(1, 4))}, {_split(_said(5, 8))}, {_split(_said(9, 12))}] ELSE CAST([] AS VARCHAR[][]) END AS gc,
  id % 5 IN (1, 2) AS has, {_split(_said(1, 3))} AS gpre, CASE WHEN id % 2 = 0 THEN {_split(_said(4, 6))} END AS gpost, w[1] AS gt, w[2] AS gm, (len(w) % 10) / 10.0 AS gu FROM f),
p AS (SELECT id AS item_id, variant, k, {_clean(_k(2, 6))} AS pe, {_clean(_k(2, 5))} AS pa, {_clean(_k(7, 9))} AS pr, upper(w[k + 1]) AS pn,
  CASE WHEN id % 4 <> 1 THEN [{_split(_ksaid(5, 8))}, {_split(_ksaid(1, 4))}, {_split(_ksaid(10, 13))}] ELSE CAST([] AS VARCHAR[][]) END AS pc,
  id % 3 <> 0 AS phas, {_split(_ksaid(1, 3))} AS ppre, {_split(_ksaid(5, 7))} AS ppost, w[k + 1] AS pt, w[2] AS pm, CASE WHEN id % 3 <> 0 THEN 0.3 END AS pu,
  len(w) * 10.0 AS raw, len(w) * 2.0 + k AS used, CASE WHEN id % 2 = 0 THEN 4.0 ELSE 0.0 END AS cr, 10.0 + k AS lat FROM f, va WHERE (id + k) % 7 <> 6),
j AS (SELECT g.*, va.variant, p.k IS NULL AS missing, p.k, coalesce(pe, {_NONE}) AS pe, coalesce(pa, {_NONE}) AS pa, {_NONE} AS pf, coalesce(pr, {_NONE}) AS pr, pn, CASE WHEN p.k IS NOT NULL THEN 'satisfied' END AS ps,
  coalesce(pc, CAST([] AS VARCHAR[][])) AS pc, coalesce(phas, false) AS phas, ppre, ppost, pt, pm, pu, coalesce(raw, 0) AS raw, coalesce(used, 0) AS used, coalesce(cr, 0) AS cr, coalesce(lat, 0) AS lat
  FROM g CROSS JOIN va LEFT JOIN p ON p.item_id = g.item_id AND p.variant = va.variant),
m1 AS (SELECT *, CASE WHEN k IS NOT NULL AND k % 2 = 0 THEN 1.0 ELSE 0.0 END AS recall_1, CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.0 END AS recall_3, CASE WHEN k IS NULL THEN 0.0 WHEN k % 2 = 0 THEN 1.0 ELSE 0.5 END AS mrr,
  CASE WHEN k IS NULL THEN 0.0 ELSE {_iou('0', 'g1', 'k', 'k + 2')} END AS span_iou,
  CASE WHEN len(gc) = 0 AND len(pc) = 0 THEN 0.0 WHEN len(gc) = 0 OR len(pc) = 0 THEN 0.0 ELSE {_mean(_best('gc', 'pc'))} END AS cr_, CASE WHEN len(gc) = 0 OR len(pc) = 0 THEN 0.0 ELSE {_mean(_best('pc', 'gc'))} END AS cp_,
  list_filter(list_transform(gc, lambda s: CASE WHEN coalesce(list_max(list_transform(pc, lambda t: {_f1('s', 't')})), 0) >= 0.5 THEN list_position(list_transform(pc, lambda t: {_f1('s', 't')}), list_max(list_transform(pc, lambda t: {_f1('s', 't')}))) END), lambda x: x IS NOT NULL) AS places,
  CASE WHEN has AND k IS NOT NULL THEN greatest(CASE WHEN phas THEN {_iou('1', '3', 'k', 'k + 2')} ELSE 0 END, {_iou('1', '3', 'k', 'k + 2')}) ELSE 0.0 END AS ti,
  CASE WHEN has AND phas THEN {_f1('gpre', 'ppre')} ELSE 0.0 END AS tpre, CASE WHEN has AND phas AND gpost IS NOT NULL THEN {_f1('gpost', 'ppost')} ELSE 0.0 END AS tpost,
  {_same('gt', 'pt')} AS tone_accuracy, {_same('gm', 'pm')} AS scene_mode_accuracy, coalesce(abs(gu - pu), 0.0) AS uncertainty_mae FROM j),
m2 AS (SELECT *, CASE WHEN span_iou > 0 OR recall_1 > 0 THEN 1.0 ELSE 0.0 END AS event_hit, CASE WHEN cr_ + cp_ <= 1e-12 THEN 0.0 ELSE 2 * cr_ * cp_ / (cr_ + cp_) END AS causal_step_f1,
  CASE WHEN len(gc) = 0 OR len(pc) = 0 OR len(places) = 0 THEN 0.0 ELSE (len(list_filter(range(1, len(places)), lambda i: places[i + 1] >= places[i])) + 1.0) / greatest(len(gc), 1) END AS causal_order_score,
  (tpre + tpost) / (CASE WHEN gpost IS NULL THEN 1 ELSE 2 END) AS ts, task_type = 'turning_point_recall' AS tp FROM m1),
scored AS (SELECT item_id, variant, task_type, missing, recall_1, recall_3, recall_3 AS recall_5, mrr, event_hit, span_iou, {_f1('ge', 'pe')} AS entity_f1, {_f1('ga', 'pa')} AS allowed_set_f1, {_f1('gf', 'pf')} AS forbidden_set_f1, {_f1('gr', 'pr')} AS required_set_f1,
  {_same('gn', 'pn')} AS actual_next_accuracy, {_same('gs', 'ps')} AS constraint_status_accuracy, causal_step_f1, causal_order_score, CASE WHEN len(gc) > 0 THEN (event_hit + causal_step_f1 + causal_order_score) / 3.0 ELSE 0.0 END AS cause_hit,
  CASE WHEN tp THEN ti ELSE 0.0 END AS turning_span_iou, CASE WHEN tp THEN tpre ELSE 0.0 END AS turning_pre_state_f1, CASE WHEN tp THEN tpost ELSE 0.0 END AS turning_post_state_f1, CASE WHEN tp AND has THEN ts ELSE 0.0 END AS turning_state_f1,
  CASE WHEN tp AND has THEN ((has AND phas)::INT + ti + ts) / 3.0 ELSE 0.0 END AS turning_point_hit, tone_accuracy, scene_mode_accuracy, uncertainty_mae, (tone_accuracy + scene_mode_accuracy + greatest(0.0, 1.0 - uncertainty_mae)) / 3.0 AS scene_fidelity,
  raw AS avg_raw_bytes, used AS avg_bytes_used, CASE WHEN cr <= 0 AND raw > 0 AND used > 0 THEN raw / used ELSE cr END AS avg_compression_ratio, lat AS avg_latency_ms, CASE WHEN missing THEN 0.0 ELSE 0.25 END AS archive_support_ratio,
  CASE WHEN used > 0 THEN event_hit / (used / 1024.0) ELSE 0.0 END AS recovery_per_kb FROM m2)"""

_ROUNDED = ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in M.NAMES)
_MEANS = ", ".join(f"round(avg({n}::DOUBLE), 6) AS {n}" for n in M.NAMES)
_AVG = ", ".join(f"avg({n}::DOUBLE) AS {n}" for n in M.NAMES)
SQL_MEANS = f"""{SQL_SCORED}, sm AS (SELECT variant, coalesce(task_type, 'all') AS task_type, {_AVG} FROM scored GROUP BY GROUPING SETS ((variant), (variant, task_type)))"""


def _rounded(df: DataFrame, names=M.NAMES) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@query(f"WITH {SQL_SCORED} SELECT item_id, variant, task_type, missing, {_ROUNDED} FROM scored")
def item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every item in every protocol variant."""
    return _rounded(E.item_metrics(items(spark, sf_dir), runs(spark, sf_dir)))


@query(f"WITH {SQL_SCORED} SELECT coalesce(task_type, 'all') AS task_type, count(*) AS item_count, sum(missing::INT)::BIGINT AS missing, {_MEANS} FROM scored WHERE variant = 'fixed_budget' GROUP BY GROUPING SETS ((), (task_type))")
def task_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means over all items and by task type, of the run that counts."""
    fixed = runs(spark, sf_dir).where("variant = 'fixed_budget'")
    return _rounded(E.summaries(E.item_metrics(items(spark, sf_dir), fixed)).drop("variant"))


@query(f"WITH {SQL_SCORED} SELECT variant, coalesce(task_type, 'all') AS task_type, count(*) AS item_count, sum(missing::INT)::BIGINT AS missing, {_MEANS} FROM scored GROUP BY GROUPING SETS ((variant), (variant, task_type))")
def protocol_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every variant; items that a variant lacks score as empty ones."""
    return _rounded(E.summaries(E.item_metrics(items(spark, sf_dir), runs(spark, sf_dir))))


_R, _K = "(recall_1 + recall_3 + recall_5 + mrr) / 4.0", "(allowed_set_f1 + forbidden_set_f1 + required_set_f1 + actual_next_accuracy + constraint_status_accuracy) / 5.0"
_of = lambda v, x: f"max(CASE WHEN variant = '{v}' THEN {x} END)"
_IN = "('" + "', '".join(E.STRUCTURAL) + "')"
_st = lambda x: f"avg(CASE WHEN variant IN {_IN} THEN {x} END)"
_drop = lambda a, b: f"coalesce(greatest(0.0, {a} - {b}), 0.0)"
SQL_DELTAS = f"""d AS (SELECT {_drop(_of('fixed_budget', 'recall_1'), _of('weak_cue', 'recall_1'))} AS cue_recall_drop, {_drop(_of('fixed_budget', 'span_iou'), _of('weak_cue', 'span_iou'))} AS cue_span_drop,
  {_drop(_of('full_question', 'recall_1'), _of('stage_weak_cue', 'recall_1'))} AS progressive_recall_gain, {_drop(_of('full_question', 'span_iou'), _of('stage_weak_cue', 'span_iou'))} AS progressive_span_gain,
  {_drop(_of('full_question', _K), _of('stage_weak_cue', _K))} AS progressive_constraint_gain, {_drop(_of('fixed_budget', _R), _st(_R))} AS shuffle_degradation,
  greatest(0.0, 1.0 - greatest(0.0, {_of('fixed_budget', _K)} - {_st(_K)})) AS constraint_consistency, {_drop(_of('fixed_budget', 'turning_state_f1'), _st('turning_state_f1'))} AS turning_state_drop FROM sm WHERE task_type = 'all')"""
DELTAS = "cue_recall_drop cue_span_drop progressive_recall_gain progressive_span_gain progressive_constraint_gain shuffle_degradation constraint_consistency turning_state_drop".split()


@query(f"WITH {SQL_MEANS}, {SQL_DELTAS} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in DELTAS)} FROM d")
def protocol_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops and gains between protocols, each floored at 0."""
    means = E.summaries(E.item_metrics(items(spark, sf_dir), runs(spark, sf_dir)))
    return _rounded(E.deltas(means), DELTAS)


_task = lambda t, x: f"max(CASE WHEN task_type = '{t}' THEN {x} END)"
_all = lambda x: _task("all", x)
_PARTS = f"""coalesce({_all(_R)}, 0) AS retrieval, coalesce({_task('constraint_recall', _K)}, 0.0) AS constraint_fidelity,
  (coalesce({_task('event_recall', 'event_hit')}, {_all('event_hit')}) + coalesce({_task('causal_recall', 'cause_hit')}, 0) + coalesce({_task('turning_point_recall', 'turning_point_hit')}, 0) + {_all('span_iou')} + {_all('entity_f1')}) / 5.0 AS perceptual_recovery,
  ({_all('tone_accuracy')} + {_all('scene_mode_accuracy')} + greatest(0.0, 1.0 - {_all('uncertainty_mae')})) / 3.0 AS scene_fidelity,
  (least({_all('recovery_per_kb')} / 4.0, 1.0) + 1.0 / (1.0 + {_all('avg_latency_ms')} / 250.0) + 1.0 / (1.0 + {_all('avg_bytes_used')} / 4096.0)) / 3.0 AS compression_utility"""


@query(
    f"""WITH {SQL_MEANS}, {SQL_DELTAS}, s AS (SELECT {_PARTS} FROM sm WHERE variant = 'fixed_budget'),
t AS (SELECT s.*, (greatest(0.0, 1.0 - shuffle_degradation) + constraint_consistency + greatest(0.0, 1.0 - turning_state_drop)) / 3.0 AS structural_stability FROM s, d)
SELECT {', '.join(f'round({n}, 6) AS {n}' for n in E.WEIGHTS)}, round({' + '.join(f'{w} * {n}' for n, w in E.WEIGHTS.items())}, 6) AS total FROM t"""
)
def subscores_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sub-scores and their weighted total."""
    means = E.summaries(E.item_metrics(items(spark, sf_dir), runs(spark, sf_dir)))
    return _rounded(E.subscores(means), [*E.WEIGHTS, "total"])


@query("WITH f AS (SELECT conv_id::BIGINT * 1000000 + turn AS id FROM conversations) SELECT id AS item_id FROM f WHERE id % 7 = 6")
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a prediction in the run that counts."""
    fixed = runs(spark, sf_dir).where("variant = 'fixed_budget'").select("item_id")
    return items(spark, sf_dir).select("item_id").join(fixed, "item_id", "left_anti")


@query()
def results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score as one versioned JSON document."""
    means = E.summaries(E.item_metrics(items(spark, sf_dir), runs(spark, sf_dir)))
    return E.as_document(E.subscores(means), "memory-bench")
