"""Metrics of one prediction against one gold item, as nested higher-order functions: no shuffle inside an item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, words

TURNING = "turning_point_recall"


def _clean(a: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def set_f1(gold: Column, pred: Column) -> Column:
    """F1 of two sets of labels; 1 when both are empty, 0 when one is."""
    def of(g: Column, p: Column) -> Column:
        both = F.size(g) + F.size(p)
        return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(g, p)) / F.greatest(both, F.lit(1)))

    return let(_clean(gold), lambda g: let(_clean(pred), lambda p: of(g, p)))


def token_f1(a: Column, b: Column) -> Column:
    return set_f1(words(F.lower(a)), words(F.lower(b)))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.greatest(F.size(a), F.lit(1)))


def soft_step_f1(gold: Column, pred: Column) -> Column:
    """Harmonic mean of the best token F1 of each gold step and of each predicted step; 1 when both are empty."""
    best = lambda a, b: F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: token_f1(x, y))))
    r, p = let(best(gold, pred), _mean), let(best(pred, gold), _mean)
    joined = let(F.struct(r.alias("r"), p.alias("p")), lambda s: F.when(s["r"] + s["p"] <= 1e-12, 0.0).otherwise(2.0 * s["r"] * s["p"] / (s["r"] + s["p"])))
    return F.when((F.size(gold) == 0) & (F.size(pred) == 0), 1.0).when((F.size(gold) == 0) | (F.size(pred) == 0), 0.0).otherwise(joined)


def causal_order(gold: Column, pred: Column, least: float = 0.5) -> Column:
    """Gold steps whose best predicted step (first of equals, F1 of `least` or more) doesn't come before the previous one's."""
    def place(g: Column) -> Column:
        scored = F.transform(pred, lambda y, i: F.struct((-token_f1(g, y)).alias("f"), i.alias("i")))
        return let(F.array_min(scored), lambda m: F.when(m["f"] <= -least, m["i"]))

    places = F.filter(F.transform(gold, place), lambda x: x.isNotNull())
    ordered = lambda a: F.size(F.filter(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.size(a)), lambda x, y: y >= x), lambda ok: ok))
    share = let(places, lambda a: F.when(F.size(a) == 0, 0.0).otherwise((ordered(a) + 1.0) / F.greatest(F.size(gold), F.lit(1))))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), 0.0).otherwise(share)


def span_iou(a: Column, b: Column) -> Column:
    """Overlap of two turn ranges, ends included; 0 in different sessions."""
    shared = F.least(a["end_turn"], b["end_turn"]) - F.greatest(a["start_turn"], b["start_turn"]) + 1
    whole = F.greatest(a["end_turn"], b["end_turn"]) - F.least(a["start_turn"], b["start_turn"]) + 1
    return F.when((a["session_id"] != b["session_id"]) | (shared <= 0), 0.0).otherwise(shared / F.greatest(whole, F.lit(1)))


def best_span_iou(gold: Column, pred: Column) -> Column:
    each = F.flatten(F.transform(gold, lambda g: F.transform(pred, lambda p: span_iou(g, p))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def valid_spans(spans: Column) -> Column:
    """Spans with a session; missing turns and scores are 0."""
    kept = F.filter(spans, lambda s: F.trim(F.coalesce(s["session_id"], F.lit(""))) != "")
    return F.transform(kept, lambda s: F.struct(F.trim(s["session_id"]).alias("session_id"), F.coalesce(s["start_turn"], F.lit(0)).alias("start_turn"), F.coalesce(s["end_turn"], F.lit(0)).alias("end_turn"), F.coalesce(s["score"], F.lit(0.0)).alias("score")))


def recall_at(gold: Column, pred: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(pred, 1, k), gold), F.lit(False)).cast("double")


def mrr(gold: Column, pred: Column) -> Column:
    places = F.filter(F.transform(pred, lambda s, i: F.when(F.array_contains(gold, s), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def _same(gold: Column, pred: Column) -> Column:
    norm = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(gold.isNull(), 0.0).otherwise((norm(gold) == norm(pred)).cast("double"))


def item_metrics(g, p, task: Column) -> dict[str, Column]:
    """All metrics of an item. g(name) and p(name) give the gold and predicted columns.

    Kept as published: both-empty sets score 1 (constraints), both-empty chains 0, a
    missing uncertainty costs nothing, turning points count for their task only.
    """
    iou = best_span_iou(valid_spans(g("spans")), valid_spans(p("spans")))
    top = recall_at(g("sessions"), p("sessions"), 1)
    hit = F.when((iou > 0) | (top > 0), 1.0).otherwise(0.0)
    chains = (F.size(g("chain")) > 0) | (F.size(p("chain")) > 0)
    step = F.when(chains, soft_step_f1(g("chain"), p("chain"))).otherwise(0.0)
    order = causal_order(g("chain"), p("chain"))
    gt, pt = g("turning"), p("turning")
    has, both = gt.isNotNull(), gt.isNotNull() & pt.isNotNull()
    own = F.when(both, span_iou(gt, pt)).otherwise(0.0)
    turn_iou = F.when(has, F.greatest(own, best_span_iou(F.array(gt), p("spans")))).otherwise(0.0)
    state = lambda name: F.when(both & gt[name].isNotNull(), token_f1(gt[name], pt[name])).otherwise(0.0)
    parts = gt["pre_state"].isNotNull().cast("int") + gt["post_state"].isNotNull().cast("int")
    states = F.when(has & (parts > 0), (state("pre_state") + state("post_state")) / F.greatest(parts, F.lit(1))).otherwise(0.0)
    same = F.when(both & (gt["session_id"] == pt["session_id"]), 1.0).otherwise(0.0)
    turn_hit = F.when(has, (same + turn_iou + states) / 3.0).otherwise(0.0)
    for_task = lambda c: F.when(task == TURNING, c).otherwise(0.0)
    doubt = F.coalesce(F.abs(g("scene")["uncertainty"] - p("scene")["uncertainty"]), F.lit(0.0))
    tone, mode = _same(g("scene")["tone"], p("scene")["tone"]), _same(g("scene")["mode"], p("scene")["mode"])
    stat = lambda name: F.coalesce(p("stats")[name], F.lit(0.0))
    ratio = F.when((stat("compression_ratio") <= 0) & (stat("raw_bytes") > 0) & (stat("bytes_used") > 0), stat("raw_bytes") / F.greatest(stat("bytes_used"), F.lit(1e-9))).otherwise(stat("compression_ratio"))
    return {
        "recall_1": top, "recall_3": recall_at(g("sessions"), p("sessions"), 3), "recall_5": recall_at(g("sessions"), p("sessions"), 5),
        "mrr": mrr(g("sessions"), p("sessions")), "event_hit": hit, "span_iou": iou, "entity_f1": set_f1(g("entities"), p("entities")),
        "allowed_set_f1": set_f1(g("allowed"), p("allowed")), "forbidden_set_f1": set_f1(g("forbidden"), p("forbidden")),
        "required_set_f1": set_f1(g("required"), p("required")), "actual_next_accuracy": _same(g("actual_next"), p("actual_next")),
        "constraint_status_accuracy": _same(g("status"), p("status")), "causal_step_f1": step, "causal_order_score": order,
        "cause_hit": F.when(F.size(g("chain")) > 0, (hit + step + order) / 3.0).otherwise(0.0),
        "turning_span_iou": for_task(turn_iou), "turning_pre_state_f1": for_task(state("pre_state")), "turning_post_state_f1": for_task(state("post_state")),
        "turning_state_f1": for_task(states), "turning_point_hit": for_task(turn_hit),
        "tone_accuracy": tone, "scene_mode_accuracy": mode, "uncertainty_mae": doubt,
        "scene_fidelity": (tone + mode + F.greatest(F.lit(0.0), 1.0 - doubt)) / 3.0,
        "avg_raw_bytes": stat("raw_bytes"), "avg_bytes_used": stat("bytes_used"), "avg_compression_ratio": ratio, "avg_latency_ms": stat("latency_ms"),
        "archive_support_ratio": stat("archive_support_ratio"),
        "recovery_per_kb": F.when(stat("bytes_used") > 0, hit / F.greatest(stat("bytes_used") / 1024.0, F.lit(1e-9))).otherwise(0.0),
    }


NAMES = (
    "recall_1 recall_3 recall_5 mrr event_hit span_iou entity_f1 allowed_set_f1 forbidden_set_f1 required_set_f1 actual_next_accuracy "
    "constraint_status_accuracy causal_step_f1 causal_order_score cause_hit turning_span_iou turning_pre_state_f1 turning_post_state_f1 "
    "turning_state_f1 turning_point_hit tone_accuracy scene_mode_accuracy uncertainty_mae scene_fidelity avg_raw_bytes avg_bytes_used "
    "avg_compression_ratio avg_latency_ms archive_support_ratio recovery_per_kb"
).split()
