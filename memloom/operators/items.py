"""Benchmark items and predictions composed of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def questions(turns: DataFrame) -> DataFrame:
    """Each user turn as a question, the session's next turn as its answer."""
    own = Window.partitionBy("session_id").orderBy("turn")
    rows = turns.withColumn("answer", F.coalesce(F.lead("content").over(own), F.lit("")))
    return rows.where("role = 'user'").select("session_id", "turn", F.col("content").alias("question"), "answer")


def build_items(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """Task type, cues, entities, scene and span of each question.

    The span is the first to last user turn that holds an evidence term of the question,
    else the session's first to last user turn.
    """
    cues = T.weak_cues(F.col("question"), F.col("answer"))
    rows = asked.withColumn("cues", cues).withColumn("names", T.entities(F.col("question")))
    rows = rows.withColumns({"terms": T.evidence_terms(F.col("question"), F.col("cues"), F.col("names")), "scene": T.recall_scene(F.concat_ws(" ", "question", "answer"))})
    said = turns.where("role = 'user'").select("session_id", F.col("turn").alias("at"), T.normalise(F.col("content")).alias("said"))
    met = rows.select("session_id", "turn", "terms").join(said, "session_id")
    holds = F.exists("terms", lambda x: F.contains(F.col("said"), x))
    tight = lambda f: f(F.when(holds, F.col("at")))
    spans = met.groupBy("session_id", "turn").agg(F.coalesce(tight(F.min), F.min("at")).alias("start_turn"), F.coalesce(tight(F.max), F.max("at")).alias("end_turn"))
    made = rows.join(spans, ["session_id", "turn"])
    return made.select("session_id", "turn", T.task_type(F.col("question")).alias("task_type"), "cues", "names", "scene", "start_turn", "end_turn")


def overridden(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """rows with the columns of overrides(key, ..., replaced array<string>) put in where a row of the key names them."""
    cols = [c for c in overrides.columns if c not in (key, "replaced")]
    other = overrides.select(key, "replaced", *(F.col(c).alias(f"_{c}") for c in cols))
    met = rows.join(other, key, "left")
    put = lambda c: F.when(F.coalesce(F.array_contains("replaced", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
    return met.select(*(put(c) for c in rows.columns))


def without_derived(entries: DataFrame, derived: DataFrame) -> DataFrame:
    """entries (question_id, ...) that no derived item (source_question_id) was made of."""
    used = derived.select(F.col("source_question_id").alias("question_id")).where("question_id is not null").distinct()
    return entries.join(used, "question_id", "left_anti")


def source_question(item_id: Column) -> Column:
    """What follows the last underscore of an item's id."""
    return F.substring_index(item_id, "_", -1)


def candidates(items: DataFrame, haystack: DataFrame, sessions: DataFrame) -> DataFrame:
    """(item_id, session_id): the sessions of an item's haystack; all sessions where it has none."""
    held = items.join(haystack, items.question_id == haystack.question_id).select("item_id", "session_id").distinct()
    bare = items.join(haystack.select("question_id").distinct(), "question_id", "left_anti").select("item_id")
    # By definition an item without a haystack is asked of every session.
    return held.unionByName(bare.crossJoin(sessions.select("session_id")))
