"""Evaluation of predictions: item metrics, macro means, protocol deltas, sub-scores and the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M

#: Parts of an item or a prediction, with their types.
PARTS = {
    "sessions": "array<string>", "spans": "array<struct<session_id:string,start_turn:bigint,end_turn:bigint,score:double>>", "entities": "array<string>",
    "allowed": "array<string>", "forbidden": "array<string>", "required": "array<string>", "actual_next": "string", "status": "string",
    "chain": "array<string>", "turning": "struct<session_id:string,start_turn:bigint,end_turn:bigint,pre_state:string,post_state:string>",
    "scene": "struct<tone:string,mode:string,uncertainty:double>", "stats": "map<string,double>",
}

# The weights of the total.
WEIGHTS = {"retrieval": 0.22, "constraint_fidelity": 0.22, "perceptual_recovery": 0.22, "scene_fidelity": 0.14, "compression_utility": 0.10, "structural_stability": 0.10}


def _part(side: str, name: str) -> Column:
    """A part of one side; an absent list is empty, an absent struct or label stays null."""
    c = F.col(f"{side}_{name}")
    return F.coalesce(c, F.array().cast(PARTS[name])) if PARTS[name].startswith("array") else c


def with_runs(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Every item beside its prediction in each variant; items that a variant lacks are there with an empty one.

    runs has item_id, variant and pred_*; items has item_id, task_type and gold_*.
    """
    variants = runs.select("variant").distinct()
    # The product is items x variants, the rows that have to be scored; variants are a handful of names.
    every = items.crossJoin(F.broadcast(variants))
    marked = runs.withColumn("found", F.lit(True))
    return every.join(marked, ["item_id", "variant"], "left").withColumn("missing", F.col("found").isNull()).drop("found")


def item_metrics(items: DataFrame, runs: DataFrame) -> DataFrame:
    made = M.item_metrics(lambda n: _part("gold", n), lambda n: _part("pred", n), F.col("task_type"))
    return with_runs(items, runs).select("item_id", "variant", "task_type", "missing", *(made[n].alias(n) for n in M.NAMES))


def summaries(scored: DataFrame) -> DataFrame:
    """Macro means by variant, over all items (task_type `all`) and by task type."""
    means = [F.avg(n).alias(n) for n in M.NAMES]
    grouped = scored.groupingSets([["variant"], ["variant", "task_type"]], "variant", "task_type")
    made = grouped.agg(F.count(F.lit(1)).alias("item_count"), F.sum(F.col("missing").cast("int")).alias("missing"), *means)
    return made.withColumn("task_type", F.coalesce("task_type", F.lit("all")))


def retrieval_score(c) -> Column:
    return (c("recall_1") + c("recall_3") + c("recall_5") + c("mrr")) / 4.0


def constraint_score(c) -> Column:
    return (c("allowed_set_f1") + c("forbidden_set_f1") + c("required_set_f1") + c("actual_next_accuracy") + c("constraint_status_accuracy")) / 5.0


STRUCTURAL = ("chunk_shuffle", "relation_shuffle", "constraint_perturbation")


def deltas(means: DataFrame) -> DataFrame:
    """One row of protocol deltas from the summaries over all items; every drop is floored at 0."""
    every = means.where("task_type = 'all'")
    of = lambda variant, value: F.max(F.when(F.col("variant") == variant, value))
    r, k = retrieval_score(F.col), constraint_score(F.col)
    structural = lambda value: F.avg(F.when(F.col("variant").isin(*STRUCTURAL), value))
    floor = lambda value: F.coalesce(F.greatest(F.lit(0.0), value), F.lit(0.0))
    fixed = lambda value: of("fixed_budget", value)
    full = lambda value: F.coalesce(of("full_question", value), of("refined_cue", value), F.lit(0.0))
    weak = lambda value: F.coalesce(of("stage_weak_cue", value), F.lit(0.0))
    return every.agg(
        floor(fixed(F.col("recall_1")) - of("weak_cue", F.col("recall_1"))).alias("cue_recall_drop"),
        floor(fixed(F.col("span_iou")) - of("weak_cue", F.col("span_iou"))).alias("cue_span_drop"),
        floor(full(F.col("recall_1")) - weak(F.col("recall_1"))).alias("progressive_recall_gain"),
        floor(full(F.col("span_iou")) - weak(F.col("span_iou"))).alias("progressive_span_gain"),
        floor(full(k) - weak(k)).alias("progressive_constraint_gain"),
        floor(fixed(r) - structural(r)).alias("shuffle_degradation"),
        F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), fixed(k) - structural(k))).alias("constraint_consistency"),
        floor(fixed(F.col("turning_state_f1")) - structural(F.col("turning_state_f1"))).alias("turning_state_drop"),
    )


def subscores(means: DataFrame) -> DataFrame:
    """One row: six sub-scores and the total."""
    fixed = means.where("variant = 'fixed_budget'")
    every = lambda n: F.max(F.when(F.col("task_type") == "all", F.col(n)))
    task = lambda t, n: F.max(F.when(F.col("task_type") == t, F.col(n)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    row = fixed.agg(
        retrieval_score(every).alias("retrieval"),
        zero(constraint_score(lambda n: task("constraint_recall", n))).alias("constraint_fidelity"),
        ((F.coalesce(task("event_recall", "event_hit"), every("event_hit")) + zero(task("causal_recall", "cause_hit")) + zero(task("turning_point_recall", "turning_point_hit")) + every("span_iou") + every("entity_f1")) / 5.0).alias("perceptual_recovery"),
        ((every("tone_accuracy") + every("scene_mode_accuracy") + F.greatest(F.lit(0.0), 1.0 - every("uncertainty_mae"))) / 3.0).alias("scene_fidelity"),
        ((F.least(every("recovery_per_kb") / 4.0, F.lit(1.0)) + 1.0 / (1.0 + every("avg_latency_ms") / 250.0) + 1.0 / (1.0 + every("avg_bytes_used") / 4096.0)) / 3.0).alias("compression_utility"),
        ((every("archive_support_ratio") + every("turning_state_f1") + every("causal_order_score")) / 3.0).alias("plain_stability"),
    )
    perturbed = means.where(F.col("variant").isin(*STRUCTURAL)).agg((F.count(F.lit(1)) > 0).alias("perturbed"))
    d = deltas(means)
    # Three one-row tables side by side.
    both = row.crossJoin(d).crossJoin(perturbed)
    stable = (F.greatest(F.lit(0.0), 1.0 - F.col("shuffle_degradation")) + F.col("constraint_consistency") + F.greatest(F.lit(0.0), 1.0 - F.col("turning_state_drop"))) / 3.0
    both = both.withColumn("structural_stability", F.when(F.col("perturbed"), stable).otherwise(F.col("plain_stability")))
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return both.select(*WEIGHTS, total.alias("total"))


def as_document(score: DataFrame, name: str, version: str = "2.0") -> DataFrame:
    """One versioned JSON document of a one-row table."""
    return score.select(F.to_json(F.struct(F.lit(name).alias("benchmark_name"), F.lit(version).alias("format_version"), F.struct(*score.columns).alias("results"))).alias("document"))
