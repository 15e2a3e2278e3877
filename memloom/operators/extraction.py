"""Constraint steps from an external extractor's replies: a content-addressed cache table, replies in free text, and the fallback.

The cache is a catalogue table (key, payload); what it doesn't hold is found by an
anti-join, asked for once for each distinct key, and appended.

Defined results: a reply without a whole JSON object, without the list, or with fewer
entries than the session has chunks is no reply, and its session falls back; further
entries are ignored; sessions of one text share an answer; null texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.lineage import cut
from . import states as S

_PIECES = re.compile(r'"(?:[^"\\]|\\.)*("|$)|[{}]', re.DOTALL)


def first_json_object(text: str | None) -> str | None:
    """The first whole JSON object in free text, braces inside strings aside."""
    text = (text or "").strip()
    if text.startswith("{") and text.endswith("}"):
        return text
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in _PIECES.finditer(text, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return text[start : m.end()]
        elif not m[1]:
            return None  # a string without an end
    return None


def json_object_in(text: Column) -> Column:
    """first_json_object as a column; finding the matching brace needs a scan that no built-in expression does."""
    return F.pandas_udf(lambda x: pd.Series([first_json_object(t) for t in x], dtype=object), StringType())(text)


def variant(name: str, path: str, kind: str) -> Column:
    return F.try_variant_get(name, path, kind)


def entries(replies: DataFrame, field: str = "constraints") -> DataFrame:
    """replies (session_id, payload) with the entries of their list as variants; null where there is none."""
    body = F.get_json_object(json_object_in(F.col("payload")), f"$.{field}")
    return replies.select("session_id", F.from_json(F.when(F.ltrim(body).startswith("["), body), "array<variant>").alias("entries"))


def steps_of_entries(rows: DataFrame) -> DataFrame:
    """Constraint steps of (session_id, step_idx, c): lower case, distinct, capped lists with defaults, confidence in [0, 1]."""

    def listed(name: str, most: int, *default: str) -> Column:
        many = variant("c", f"$.{name}", "array<string>")
        single = variant("c", f"$.{name}", "string")
        found = F.coalesce(many, F.when(F.trim(single) != "", F.array(single)), T.empty())
        clean = F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != "")), 1, most)
        return F.when(F.size(clean) > 0, clean).otherwise(F.array(*map(F.lit, default)) if default else T.empty())

    current = F.lower(F.trim(variant("c", "$.current_state", "string")))
    confidence = F.least(F.greatest(F.coalesce(variant("c", "$.confidence", "double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return rows.select(
        "session_id", "step_idx", F.coalesce(F.when(current != "", current), F.lit("context")).alias("current"), listed("preferred_next_states", 5, "persistence").alias("preferred"), listed("forbidden_next_states", 5).alias("forbidden"),
        listed("next_step_constraints", 6, "maintain_local_context").alias("required"), listed("trigger_events", 4, "persistence").alias("triggers"), confidence.alias("confidence"),
    )


def extracted_steps(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Constraint steps of chunks (session_id, step_idx, chunk) from the replies that fit, else from the fallback; source tells which."""
    lengths = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    fits = entries(replies).join(lengths, "session_id").where(F.size("entries") >= F.col("n"))
    said = fits.select("session_id", F.posexplode("entries").alias("step_idx", "c"))
    known = steps_of_entries(said).join(chunks.select("session_id", "step_idx", "chunk"), ["session_id", "step_idx"])
    other = S.fallback_steps(chunks.join(fits.select("session_id"), "session_id", "left_anti"))
    columns = ["session_id", "step_idx", "chunk", "current", "preferred", "forbidden", "required", "triggers", "confidence"]
    return known.select(*columns, F.lit("reply").alias("source")).unionByName(other.select(*columns, F.lit("fallback").alias("source")))


class ReplyCache:
    """A catalogue table (key, payload) of replies by the hash of what was asked."""

    def __init__(self, spark: SparkSession, name: str, kind: str = "constraints", backend: str = "none", model: str = "none", chunking: str = "2"):
        self.spark, self.name, self.fixed = spark, name, (kind, backend, model, chunking)

    def key(self, text: str = "text") -> Column:
        return F.sha2(F.concat_ws("|", *map(F.lit, self.fixed), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)

    def stored(self) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, payload STRING) USING parquet")
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def replies(self, sessions: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(session_id, payload) of sessions (session_id, text). ask: (key, text) of what isn't stored, to (key, payload); null payloads aren't stored."""
        keyed = cut(sessions.select("session_id", "text", self.key().alias("key")))
        missing = keyed.join(self.stored().select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
        cut(ask(missing).where("payload is not null").select("key", "payload")).write.insertInto(self.name)
        stored = self.stored().groupBy("key").agg(F.first("payload").alias("payload"))  # a repeated append after a failure changes nothing
        return keyed.join(stored, "key").select("session_id", "payload")
