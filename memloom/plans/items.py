"""Queries that build items and read haystacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..operators import items as I
from ..sources import catalogue, documents
from .registry import query, read
from .texts import SQL_TOPICS, sql_distinct, sql_entities, sql_normal, sql_scene_part

_CASES = "CASE" + "".join(f" WHEN {' OR '.join(f'''contains(lower(question), '{w}')''' for w in these)} THEN '{name}'" for these, name in lex.TASK_RULES) + " ELSE 'event_recall' END"


@query(
    f"""WITH a AS (SELECT conv_id, turn, role, text AS question, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS answer, conv_id * 1000 + turn AS id FROM conversations), q AS (SELECT * FROM a WHERE role = 'user'),
d AS (SELECT id, question || ' ' || answer AS t FROM q), {SQL_TOPICS},
c AS (SELECT q.*, list_filter({sql_distinct(f"list_concat(list_concat(coalesce(topics, CAST([] AS VARCHAR[])), {sql_entities('answer')}), [trim(answer[1:48])])")}, lambda x: x <> '')[1:3] AS cues, {sql_entities('question')} AS names FROM q LEFT JOIN tp USING (id)),
e AS (SELECT *, list_filter(list_transform(list_concat(list_concat(cues, names), list_filter(string_split({sql_normal('question')}, ' '), lambda x: length(x) >= 5)), lambda x: {sql_normal('x')}), lambda x: length(x) >= 3) AS terms FROM c),
u AS (SELECT conv_id, turn AS at_, {sql_normal('text')} AS said FROM conversations WHERE role = 'user'),
s AS (SELECT e.conv_id, e.turn, min(at_) AS a0, max(at_) AS a1, min(CASE WHEN len(list_filter(terms, lambda x: contains(said, x))) > 0 THEN at_ END) AS t0, max(CASE WHEN len(list_filter(terms, lambda x: contains(said, x))) > 0 THEN at_ END) AS t1 FROM e JOIN u USING (conv_id) GROUP BY ALL)
SELECT 'conv_' || conv_id AS session_id, turn, {_CASES} AS task_type, array_to_string(cues, ',') AS cues, array_to_string(names, ',') AS names, {sql_scene_part("(question || ' ' || answer)", [(r[0], r[1]) for r in lex.RECALL_SCENES], 1, "'neutral'")} AS tone, {sql_scene_part("(question || ' ' || answer)", [(r[0], r[2]) for r in lex.RECALL_SCENES], 1, "'general_recall'")} AS mode,
  coalesce(t0, a0) AS start_turn, coalesce(t1, a1) AS end_turn FROM e JOIN s USING (conv_id, turn)"""
)
def build_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for each user turn: task, cues, entities, scene and span."""
    turns = catalogue.turns(read(spark, sf_dir, "conversations"))
    made = I.build_items(I.questions(turns), turns)
    return made.select("session_id", "turn", "task_type", F.array_join("cues", ",").alias("cues"), F.array_join("names", ",").alias("names"), "scene.tone", "scene.mode", "start_turn", "end_turn")


@query(
    """WITH h AS (SELECT b.item_id, k, 'conv_' || ((b.item_id + k) % n) AS session_id FROM benchmark b, range(3) r(k), (SELECT max(conv_id) + 1 AS n FROM conversations)), f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY 'q' || item_id, k) AS nth FROM h)
SELECT 'q' || item_id AS question_id, k AS pos, session_id, 'day' || k AS date, (SELECT count(*) FROM conversations c WHERE 'conv_' || c.conv_id = f.session_id) AS turns FROM f WHERE nth = 1"""
)
def haystack_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haystack entries through JSON and back; of a repeated session the first entry's stays."""
    turns = catalogue.turns(read(spark, sf_dir, "conversations"))
    said = turns.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    n = read(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    asked = read(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    # n is one row.
    named = asked.join(F.broadcast(n)).withColumn("session_id", F.concat(F.lit("conv_"), ((F.col("item_id") + F.col("k")) % F.col("n")).cast("string"))).join(said, "session_id", "left")
    one = F.array_sort(F.collect_list(F.struct("k", "session_id", F.coalesce("turns", F.array().cast(f"array<{documents.TURN}>")).alias("turns"))))
    entries = named.groupBy("item_id", "text").agg(one.alias("h"))
    part = lambda field: F.transform("h", field)
    made = entries.select(F.to_json(F.array(F.struct(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("question"), part(lambda x: x["session_id"]).alias("haystack_session_ids"),
        part(lambda x: F.concat(F.lit("day"), x["k"].cast("string"))).alias("haystack_dates"), part(lambda x: x["turns"]).alias("haystack_sessions"),
    ))).alias("value"))
    rows = catalogue.haystack(documents.parse_entries(made, documents.HAYSTACK).drop("pos"))
    return rows.select("question_id", "pos", "session_id", "date", F.size("turns").cast("long").alias("turns"))


@query("SELECT item_id, item_id % 5 AS bucket, CASE WHEN item_id % 3 = 0 THEN 'curated' ELSE text END AS question, CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN NULL ELSE 'open' END AS status FROM benchmark")
def curated_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with curated values put in where the override names them, null included."""
    b = read(spark, sf_dir, "benchmark")
    rows = b.select("item_id", (F.col("item_id") % 5).alias("bucket"), F.col("text").alias("question"), F.lit("open").alias("status"))
    named = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("question"), F.lit("status"))).otherwise(F.array(F.lit("question")))
    other = b.where("item_id % 3 = 0").select("item_id", F.lit("curated").alias("question"), F.lit(None).cast("string").alias("status"), named.alias("replaced"))
    return I.overridden(rows, other, "item_id")


@query("SELECT 'q' || item_id AS question_id, text AS question FROM benchmark WHERE 'q' || item_id NOT IN (SELECT 'q' || (item_id * 3) FROM benchmark)")
def underived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that may still be sampled: those that no derived item stands for."""
    b = read(spark, sf_dir, "benchmark")
    name = lambda x: F.concat(F.lit("q"), x.cast("string"))
    return I.without_derived(b.select(name(F.col("item_id")).alias("question_id"), F.col("text").alias("question")), b.select(name(F.col("item_id") * 3).alias("source_question_id")))


@query(
    """WITH i AS (SELECT 'item_q' || item_id AS item_id, item_id AS n FROM benchmark), h AS (SELECT item_id AS n, 's' || (item_id % 7) AS session_id FROM benchmark WHERE item_id % 4 <> 0 UNION SELECT item_id, 's' || (item_id % 5) FROM benchmark WHERE item_id % 4 <> 0),
s AS (SELECT 's' || x AS session_id FROM range(7) r(x)) SELECT i.item_id, session_id FROM i JOIN h USING (n) UNION ALL SELECT i.item_id, session_id FROM i, s WHERE n % 4 = 0"""
)
def candidate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each item: its haystack's sessions, or all of them where it has none."""
    n = F.col("item_id")
    b = read(spark, sf_dir, "benchmark")
    items = b.select(F.concat(F.lit("item_q"), n.cast("string")).alias("item_id")).withColumn("question_id", I.source_question(F.col("item_id")))
    held = b.where("item_id % 4 <> 0").select(F.concat(F.lit("q"), n.cast("string")).alias("question_id"), F.explode(F.array(n % 7, n % 5)).alias("x"))
    haystack = held.select("question_id", F.concat(F.lit("s"), F.col("x").cast("string")).alias("session_id"))
    sessions = spark.range(7).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"))
    return I.candidates(items, haystack, sessions)
