"""Turns, sessions and haystacks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BLANK = " \t\n\r"


def turns(conversations: DataFrame) -> DataFrame:
    """turns(session_id, turn, role, content) of a table of conversations."""
    return conversations.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("session_id"), "turn", "role", F.col("text").alias("content"))


def sessions(rows: DataFrame) -> DataFrame:
    """One row for each session; its text is that of the user turns, in order, stripped."""
    user = F.when(F.col("role") == "user", F.struct("turn", "content"))
    made = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(user)).alias("u"), F.count(F.lit(1)).alias("n_turns"), F.count(user).alias("n_user"))
    said = F.array_join(F.transform("u", lambda x: x["content"]), "\n")
    return made.select("session_id", F.btrim(said, F.lit(BLANK)).alias("text"), "n_turns", "n_user")


def compact(rows: DataFrame, turns_at_most: int = 4, enough: int = 80, sentences: int = 8, most: int = 1600) -> DataFrame:
    """The text that stands for a session in ranking."""
    spoken = F.when((F.col("role") == "user") & (F.trim("content") != ""), F.struct("turn", F.trim("content").alias("s")))
    made = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(spoken)).alias("u"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "content")))).alias("all"))
    head = F.array_join(F.transform(F.slice("u", 1, turns_at_most), lambda x: x["s"]), " ")
    text = F.btrim(F.array_join(F.transform("all", lambda x: x["content"]), "\n"), F.lit(BLANK))
    parts = F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, sentences)
    other = F.array_join(F.filter(F.transform(parts, F.trim), lambda x: x != ""), " ")
    return made.select("session_id", F.substring(F.when(F.length(head) >= enough, head).otherwise(other), 1, most).alias("compact"))


def token_idf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token, tf, df, idf = ln((1 + N) / (1 + df)) + 1, in one shuffle of per-document counts."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    per = docs.select(id_col, F.explode(T.tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("c"))
    made = per.groupBy("token").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))
    # n is one row: the only product here has a side of exactly one row.
    return made.join(F.broadcast(n)).select("token", "tf", "df", F.round(F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0, 6).alias("idf"))


def haystack(entries: DataFrame) -> DataFrame:
    """haystack(question_id, pos, session_id, date, turns) of nested entries; of a repeated session the first stays."""
    rows = entries.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("pos", "h"))
    rows = rows.select("question_id", "pos", F.col("h.haystack_session_ids").alias("session_id"), F.col("h.haystack_dates").alias("date"), F.col("h.haystack_sessions").alias("turns"))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("question_id", "pos"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth")
