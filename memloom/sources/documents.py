"""Versioned JSON documents: items, predictions, source records and haystacks in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string>"
HAYSTACK = (
    "question_id string, question string, question_type string, answer string, answer_session_ids array<string>, "
    f"haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{TURN}>>"
)
ITEM = (
    "item_id string, task_type string, question string, weak_cues array<string>, gold_sessions array<string>, "
    "gold_spans array<struct<session_id:string,start_turn:bigint,end_turn:bigint,score:double>>, gold_entities array<string>, "
    "gold_constraints struct<allowed:array<string>,forbidden:array<string>,required:array<string>,actual_next:string,status:string>, "
    "gold_causal_chain array<string>, gold_turning_point struct<session_id:string,start_turn:bigint,end_turn:bigint,pre_state:string,post_state:string>, "
    "gold_scene struct<tone:string,mode:string,uncertainty:double>"
)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def parse_entries(texts: DataFrame, schema: str, field: str = "items", column: str = "value") -> DataFrame:
    """Rows of documents that are a list or hold one under a field, with their place (doc order isn't kept by readers)."""
    body = F.col(column)
    listed = F.coalesce(F.get_json_object(body, f"$.{field}"), body)
    rows = texts.select(F.posexplode(F.from_json(listed, f"array<struct<{_fields(schema)}>>")).alias("pos", "e"))
    return rows.select("pos", "e.*")


def _fields(schema: str) -> str:
    """A DDL list of columns as fields of a struct."""
    out, depth, name = [], 0, True
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name = True
            out.append(c)
        elif c == " " and depth == 0 and out and out[-1] != "," and name:
            name = False
            out.append(":")
        elif not (c == " " and depth == 0):
            out.append(c)
    return "".join(out)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return parse_entries(_texts(spark, path), ITEM)


def read_haystack(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries of a haystack; with a limit, the first by their place in the document."""
    rows = parse_entries(_texts(spark, path), HAYSTACK)
    return rows if limit is None else rows.where(F.col("pos") < limit)


def write_document(rows: DataFrame, path: str, name: str, field: str, version: str = "2.0") -> None:
    """One JSON line for each row under the document's name and version; many rows make many part files, never one driver string."""
    made = rows.select(F.lit(name).alias("benchmark_name"), F.lit(version).alias("format_version"), F.struct(*rows.columns).alias(field))
    made.write.mode("overwrite").json(path)
