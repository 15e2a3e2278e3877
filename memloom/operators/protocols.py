"""The whole path from items to scored predictions: rank sessions at each stage of recall, recover parts from the first, vary them by protocol.

Every step is a join of long tables; what belongs to one item or session is bounded by
the candidate pool or by caps of its parts. Predictions never read gold columns. How
long a ranking took isn't a property of a batch plan: latency is left out of the
statistics, and the evaluator counts it as 0.

Defined results: a session that shares no token with an item's question and cues isn't
its candidate; an item without candidates has no prediction and scores as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut
from . import addresses as A
from . import rank
from . import states as S
from .evaluate import PARTS

STAGES = ("weak_cue", "refined_cue", "full_question")

#: (variant, whose ranking, entities kept, chain steps kept, spans kept, constraints kept); None keeps all.
PROTOCOLS = (
    ("fixed_budget", "full_question", None, None, True, "all"),
    ("weak_cue", "weak_cue", 2, 2, False, "all"),
    ("stage_weak_cue", "weak_cue", 2, 2, False, "all"),
    ("refined_cue", "refined_cue", None, None, True, "all"),
    ("full_question", "full_question", None, None, True, "all"),
    ("chunk_shuffle", "shuffled", 1, 1, False, "all"),
    ("relation_shuffle", "shuffled", None, 0, True, "forbidden"),
    ("constraint_perturbation", "full_question", None, None, True, "none"),
)


def stage_texts(items: DataFrame) -> DataFrame:
    """(item_id, stage, text) of items (item_id, question, cues)."""
    weak = F.array_join("cues", " ")
    rows = items.withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
    said = F.when(F.col("stage") == "weak_cue", F.when(weak != "", weak).otherwise(F.col("question")))
    said = said.when(F.col("stage") == "refined_cue", F.trim(F.concat_ws(" ", weak, "question"))).otherwise(F.col("question"))
    return rows.select("item_id", "stage", said.alias("text"))


def rankings(items: DataFrame, compact: DataFrame, whole: DataFrame, pool_size: int = 5, steps_of=S.fallback_steps) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """((item_id, stage, session_id, rank) of the candidates at each stage and shuffled; the masses behind their support).

    items: item_id, question, cues, task_type; compact and whole: session_id, text.
    """
    asked = items.select("item_id", F.trim(F.concat_ws(" ", "question", F.array_join("cues", " "))).alias("text"))
    pool = cut(rank.lexical_nearest(asked, compact, pool_size).select("item_id", "session_id"))
    staged = cut(stage_texts(items).select(F.concat_ws("#", "stage", F.col("item_id").cast("string")).alias("key"), "item_id", "stage", "text"))
    queries = staged.select(F.col("key").alias("item_id"), "text")
    pairs = cut(staged.join(pool, "item_id").select("key", "item_id", "stage", "session_id"))
    keyed = pairs.select(F.col("key").alias("item_id"), "session_id")
    held = compact.join(pool.select("session_id").distinct(), "session_id", "left_semi")
    masses = A.encoded(queries, held, steps_of)
    scored = A.hybrid(rank.pair_lexical(keyed, queries, held), A.support_of(masses, keyed)).withColumnRenamed("item_id", "key")
    ranked = cut(pairs.join(scored.select("key", "session_id", "rank"), ["key", "session_id"]).select("item_id", "stage", "session_id", "rank"))
    ranked = _promoted(ranked, items, queries, whole)
    shuffled = Window.partitionBy("item_id").orderBy(F.xxhash64(F.col("item_id").cast("string"), "session_id"), "session_id")
    mixed = ranked.where("stage = 'full_question'").select("item_id", F.lit("shuffled").alias("stage"), "session_id", F.row_number().over(shuffled).alias("rank"))
    return cut(ranked.unionByName(mixed)), masses


def _promoted(ranked: DataFrame, items: DataFrame, queries: DataFrame, whole: DataFrame, first: int = 5, bonus: float = 0.15) -> DataFrame:
    """Of a constraint item's first sessions by the full question the one that suits its cues best moves to the front."""
    picked = items.where("task_type = 'constraint_recall'").select("item_id", F.filter(F.transform("cues", T.normalise), lambda c: c != "").alias("cues"))
    full = ranked.where(F.col("stage") == "full_question").where(F.col("rank") <= first).join(picked, "item_id")
    said = full.join(whole, "session_id").select("item_id", "session_id", "rank", F.size(F.filter("cues", lambda c: F.contains(T.normalise(F.col("text")), c))).alias("hits"))
    refined = said.select(F.concat_ws("#", F.lit("refined_cue"), F.col("item_id").cast("string")).alias("item_id"), "session_id")
    lexical = rank.pair_lexical(refined, queries, whole).select(F.expr("substring(item_id, 13)").alias("item"), "session_id", "lexical")
    scored = said.withColumn("item", F.col("item_id").cast("string")).join(lexical, ["item", "session_id"])
    best = scored.groupBy("item_id").agg(F.max_by("rank", F.struct(F.round(F.col("lexical") + bonus * F.col("hits"), 9), -F.col("rank"))).alias("best"))
    rows = ranked.join(best, "item_id", "left")
    moved = F.when(F.col("rank") == F.col("best"), 1).when(F.col("rank") < F.col("best"), F.col("rank") + 1).otherwise(F.col("rank"))
    return rows.select("item_id", "stage", "session_id", F.when((F.col("stage") == "full_question") & F.col("best").isNotNull(), moved).otherwise(F.col("rank")).alias("rank"))


def recovered(compact: DataFrame, whole: DataFrame, steps_of=S.fallback_steps) -> DataFrame:
    """(session_id, entities, allowed, forbidden, required, actual_next, status, chain, turning, scene) of each session."""
    steps = cut(steps_of(S.chunks(compact)))
    states, edges = S.fields_of_steps(steps), S.constraint_edges(steps)
    several = lambda c, n: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.slice(c, 1, n)))))
    lists = steps.groupBy("session_id").agg(several("preferred", 4).alias("allowed"), several("forbidden", 4).alias("forbidden"), several("required", 6).alias("required"))
    chain = S.causal_chains(states).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("nth", "step"))).alias("c"))  # three at most
    chain = chain.select("session_id", F.transform("c", lambda x: x["step"]).alias("chain"))
    turning = S.turning_points(states, steps)
    turning = turning.select("session_id", F.struct("session_id", F.col("start_turn").cast("long").alias("start_turn"), F.col("end_turn").cast("long").alias("end_turn"), "pre_state", "post_state").alias("turning"))
    own = whole.select("session_id", T.entities(F.col("text")).alias("entities"), T.scene(F.col("text")).alias("scene"))
    for part in (lists, S.derived_constraints(steps, edges), chain, turning):
        own = own.join(part, "session_id", "left")
    return own


def predictions(items: DataFrame, ranked: DataFrame, parts: DataFrame, spans: DataFrame, stats: DataFrame) -> DataFrame:
    """runs(item_id, variant, pred_*) of every protocol, as the evaluator reads them.

    spans: session_id, item_id, start_turn, end_turn, score; stats: session_id and figures.
    """
    listed = ranked.groupBy("item_id", "stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id"))), lambda x: x["session_id"]).alias("sessions"))  # a pool at most
    top = ranked.where("stage = 'full_question' and rank = 1").select("item_id", "session_id")
    figures = ranked.where("stage = 'full_question'").join(stats, "session_id").groupBy("item_id").agg(*(F.avg(c).alias(c) for c in ("raw_bytes", "bytes_used", "archive_support_ratio")))
    first = top.join(parts, "session_id").join(spans.select("session_id", "item_id", F.struct("session_id", F.col("start_turn").cast("long").alias("start_turn"), F.col("end_turn").cast("long").alias("end_turn"), "score").alias("span")), ["session_id", "item_id"], "left")
    base = cut(first.join(figures, "item_id", "left"))
    ratio = F.when(F.col("bytes_used") > 0, F.col("raw_bytes") / F.greatest("bytes_used", F.lit(1e-9))).otherwise(0.0)
    memory = F.create_map(F.lit("raw_bytes"), F.coalesce("raw_bytes", F.lit(0.0)), F.lit("bytes_used"), F.coalesce("bytes_used", F.lit(0.0)), F.lit("compression_ratio"), F.coalesce(ratio, F.lit(0.0)), F.lit("archive_support_ratio"), F.coalesce("archive_support_ratio", F.lit(0.0)))
    none = lambda name: F.array().cast(PARTS[name])
    head = lambda a, n: a if n is None else F.slice(a, 1, n)
    filled = lambda c: F.coalesce(F.col(c), T.empty())
    made = None
    for variant, stage, n_entities, n_chain, with_spans, kept in PROTOCOLS:
        every = kept == "all"
        own = base.join(listed.where(F.col("stage") == stage).select("item_id", "sessions"), "item_id")
        span = F.when(F.col("span").isNotNull(), F.array("span")).otherwise(none("spans"))
        rows = own.select(
            "item_id",
            F.lit(variant).alias("variant"),
            F.col("sessions").alias("pred_sessions"),
            (span if with_spans else none("spans")).cast(PARTS["spans"]).alias("pred_spans"),
            head(filled("entities"), n_entities).alias("pred_entities"),
            (filled("allowed") if every else T.empty()).alias("pred_allowed"),
            (filled("forbidden") if kept != "none" else T.empty()).alias("pred_forbidden"),
            (filled("required") if every else T.empty()).alias("pred_required"),
            (F.col("actual_next") if every else F.lit(None).cast("string")).alias("pred_actual_next"),
            (F.col("status") if every else F.lit("outside")).alias("pred_status"),
            head(filled("chain"), n_chain).alias("pred_chain"),
            (F.lit(None).cast(PARTS["turning"]) if kept == "forbidden" else F.col("turning").cast(PARTS["turning"])).alias("pred_turning"),
            F.struct(F.col("scene.tone").alias("tone"), F.col("scene.mode").alias("mode"), F.col("scene.uncertainty").cast("double").alias("uncertainty")).alias("pred_scene"),
            memory.alias("pred_stats"),
        )
        made = rows if made is None else made.unionByName(rows)
    return made


def item_spans(items: DataFrame, ranked: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, item_id, start_turn, end_turn, score): in each item's first session, the user turns that hold an evidence term, else all of its user turns."""
    top = ranked.where("stage = 'full_question' and rank = 1").join(items.select("item_id", "terms"), "item_id")
    said = turns.where("role = 'user'").select("session_id", "turn", T.normalise(F.col("content")).alias("said"))
    met = top.join(said, "session_id")
    holds = F.exists("terms", lambda x: F.contains(F.col("said"), x))
    spans = met.groupBy("session_id", "item_id").agg(F.min(F.when(holds, F.col("turn"))).alias("t0"), F.max(F.when(holds, F.col("turn"))).alias("t1"), F.min("turn").alias("a0"), F.max("turn").alias("a1"))
    return spans.select("session_id", "item_id", F.coalesce("t0", "a0").alias("start_turn"), F.coalesce("t1", "a1").alias("end_turn"), F.lit(0.5).alias("score"))


def gold(items: DataFrame) -> DataFrame:
    """What the evaluator compares with, of items built from turns: session, span, names and scene."""
    none = lambda name: F.array().cast(PARTS[name]).alias(f"gold_{name}")
    absent = lambda name: F.lit(None).cast(PARTS[name]).alias(f"gold_{name}")
    span = F.struct("session_id", F.col("start_turn").cast("long").alias("start_turn"), F.col("end_turn").cast("long").alias("end_turn"), F.lit(0.0).alias("score"))
    scene = F.struct(F.col("scene.tone").alias("tone"), F.col("scene.mode").alias("mode"), F.lit(0.5).alias("uncertainty"))
    return items.select(
        "item_id", "task_type", F.array("session_id").alias("gold_sessions"), F.array(span).alias("gold_spans"), F.col("names").alias("gold_entities"), none("allowed"), none("forbidden"), none("required"),
        absent("actual_next"), absent("status"), none("chain"), absent("turning"), scene.alias("gold_scene"),
    )

