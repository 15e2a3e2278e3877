"""The whole path over conversations: items of user turns are ranked, recovered and scored in every protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..functions.lineage import cut
from ..operators import addresses as A
from ..operators import evaluate as E
from ..operators import items as I
from ..operators import protocols as P
from ..sources import catalogue
from .registry import query, read


def items_of(turns: DataFrame) -> DataFrame:
    """An item for each user turn: item_id, session_id, question, cues, names, terms, task_type, scene, start_turn, end_turn."""
    asked = I.questions(turns)
    made = I.build_items(asked, turns).join(asked, ["session_id", "turn"])
    terms = T.evidence_terms(F.col("question"), F.col("cues"), F.col("names"))
    return made.withColumn("item_id", F.concat_ws(":", "session_id", F.col("turn").cast("string"))).withColumn("terms", terms).drop("turn", "answer")


def runs(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items with gold parts, predictions of every protocol, rankings) of a table of turns."""
    items = cut(items_of(turns))
    whole = cut(catalogue.sessions(turns).select("session_id", "text"))
    compact = cut(catalogue.compact(turns).select("session_id", F.col("compact").alias("text")))
    ranked, masses = P.rankings(items, compact, whole)
    own = lambda df: df.where(F.col("session_id").startswith("s")).withColumn("session_id", F.expr("substring(session_id, 2)"))
    stats = cut(A.archive_stats(whole, own(masses[0]), own(masses[1])))
    wanted = ranked.select("session_id").distinct()
    parts = P.recovered(compact.join(wanted, "session_id", "left_semi"), whole.join(wanted, "session_id", "left_semi"))
    made = P.predictions(items, ranked, cut(parts), P.item_spans(items, ranked, turns), stats)
    return P.gold(items), cut(made), ranked


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, made, _ = runs(catalogue.turns(read(spark, sf_dir, "conversations")))
    return E.summaries(E.item_metrics(items, made))


@query()
def stage_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every item at each stage of recall, and shuffled."""
    return runs(catalogue.turns(read(spark, sf_dir, "conversations")))[2]


@query()
def protocol_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means of every protocol from the engine's own predictions."""
    means = _means(spark, sf_dir)
    return means.select("variant", "task_type", "item_count", "missing", *(F.round(n, 6).alias(n) for n in M.NAMES))


@query()
def benchmark_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sub-scores and the total of the engine's own predictions."""
    scores = E.subscores(cut(_means(spark, sf_dir)))
    return scores.select(*(F.round(c, 6).alias(c) for c in scores.columns))
