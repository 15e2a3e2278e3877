"""The functions of the engine for SQL: built-in forms as SQL functions, hashes as vectorised ones, tokens and chunks as table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType

from .. import lexicons as lex
from . import hashing

#: Name, parameters, type and body of each SQL function.
SQL_FUNCTIONS = (
    ("ml_tokens", "t STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(coalesce(t, ''), '({lex.TOKEN_RE})', 1), x -> lower(x))"),
    ("ml_normalise", "t STRING", "STRING", "trim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' '))"),
    ("ml_label", "t STRING", "STRING", "CASE WHEN btrim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', '_'), '_') = '' THEN 'unknown' ELSE btrim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', '_'), '_') END"),
    ("ml_idf", "n BIGINT, df BIGINT", "DOUBLE", "ln((1.0D + n) / (1.0D + df)) + 1.0D"),
    ("ml_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0.0D, (s, x) -> s + x * x)) + 1e-12D)"),
)


def _fnv(texts: pd.Series) -> pd.Series:
    return pd.Series(hashing.fnv_many(texts.tolist()).view("int64"))


class Chunks:
    """ml_each_chunk(text, size): sentences of 8 characters or more in groups of size, joined by a full stop; without any, runs of 24 tokens."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        parts = [p.strip(" \t\r") for p in re.split(r"[.!?\n]+", text or "")]
        parts, glue, step = [p for p in parts if len(p) >= 8], ". ", size
        if not parts:
            parts, glue, step = [m.lower() for m in re.findall(lex.TOKEN_RE, text or "")], " ", 24
        for place, at in enumerate(range(0, len(parts), step)):
            yield place, glue.join(parts[at : at + step])


def register(spark: SparkSession) -> None:
    """Make ml_tokens, ml_normalise, ml_label, ml_idf, ml_cosine, ml_fnv64, ml_each_token and ml_each_chunk known to the session's SQL."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("ml_fnv64", F.pandas_udf(_fnv, LongType()))
    # ml_each_token(text): the tokens of a text with their places from 0; none for null.
    body = SQL_FUNCTIONS[0][3]  # a generator takes no SQL function
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ml_each_token(t STRING) RETURNS TABLE(place INT, token STRING) RETURN SELECT e.pos, e.col FROM posexplode({body}) e")
    spark.udtf.register("ml_each_chunk", udtf(Chunks, returnType="step_idx INT, chunk STRING"))
