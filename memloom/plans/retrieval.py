"""Retrieval queries: the headline ranking, its recall, and the pieces around it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..functions.lineage import cut
from ..operators import rank
from ..sources import catalogue
from ..sources.features import FeatureStore
from .registry import query, read
from .texts import sql_normal, sql_tokens, _TASK


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", "text")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), "text")


SQL_SCORES = f"""
qe AS (SELECT item_id, unnest({sql_tokens('text')}) AS token FROM benchmark),
q AS (SELECT item_id, token, count(*) AS n FROM qe WHERE length(token) >= 3 GROUP BY ALL),
qt AS (SELECT item_id, sum(n) AS total FROM q GROUP BY item_id),
de AS (SELECT doc_id AS session_id, unnest({sql_tokens('text')}) AS token FROM documents),
s AS (SELECT session_id, token, count(*) AS m FROM de GROUP BY ALL),
sc AS (SELECT item_id, session_id, round(sum(least(n, m)) / max(total), 6) AS lexical FROM s JOIN q USING (token) JOIN qt USING (item_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lexical DESC, session_id) AS rank FROM sc)"""
SQL_GOLD = "gold AS (SELECT item_id, doc_id AS session_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {SQL_SCORES} SELECT item_id, session_id, lexical, rank FROM rk WHERE rank <= 10")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each question by lexical overlap."""
    return rank.lexical_nearest(_questions(spark, sf_dir), _sessions(spark, sf_dir), 10)


@query(f"WITH {SQL_GOLD} SELECT * FROM gold")
def gold_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage."""
    return rank.containing(_questions(spark, sf_dir), _sessions(spark, sf_dir))


@query(
    f"""WITH {SQL_SCORES}, {SQL_GOLD}, best AS (SELECT item_id, min(rank) AS best FROM rk JOIN gold USING (item_id, session_id) WHERE rank <= 10 GROUP BY item_id),
x AS (SELECT b.item_id, {_TASK} AS question_type, best FROM benchmark b LEFT JOIN best USING (item_id))
SELECT coalesce(question_type, 'all') AS question_type, count(*) AS items, round(avg(coalesce((best <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((best <= 3)::INT, 0)), 6) AS recall_3,
  round(avg(coalesce((best <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce((best <= 10)::INT, 0)), 6) AS recall_10, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr
FROM x GROUP BY GROUPING SETS ((), (question_type))"""
)
def lexical_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 3, 5 and 10 and mean reciprocal rank, over all questions and by type."""
    q, s = _questions(spark, sf_dir), _sessions(spark, sf_dir)
    ranked = rank.lexical_nearest(q, s, 10)
    typed = q.select("item_id", T.task_type(F.col("text")).alias("question_type"))
    each = rank.recall_and_mrr(ranked, rank.containing(q, s), typed)
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")]
    return each.rollup("question_type").agg(F.count(F.lit(1)).alias("items"), *means).withColumn("question_type", F.coalesce("question_type", F.lit("all")))


@query(
    f"""WITH {SQL_SCORES}, w AS (SELECT item_id, list_filter(string_split({sql_normal('text')}, ' '), lambda x: length(x) >= 5)[1:3] AS cues FROM benchmark),
p AS (SELECT rk.item_id, rk.session_id, rank, lexical, lexical + 0.15 * len(list_filter(cues, lambda c: contains({sql_normal('d.text')}, c))) AS score FROM rk JOIN w USING (item_id) JOIN documents d ON d.doc_id = rk.session_id WHERE rank <= 5),
b AS (SELECT item_id, session_id AS promoted, rank AS old_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS r FROM p) WHERE r = 1)
SELECT item_id, session_id, rank AS old_rank, CASE WHEN session_id = promoted THEN 1 WHEN rank < b.old_rank THEN rank + 1 ELSE rank END AS rank FROM p JOIN b USING (item_id)"""
)
def promote_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first five the one with the best cue-aware score moves to the front; the ones before it move down."""
    q, s = _questions(spark, sf_dir), _sessions(spark, sf_dir)
    ranked = rank.lexical_nearest(q, s, 5)
    cues = q.select("item_id", F.slice(F.filter(F.split(T.normalise(F.col("text")), " "), lambda x: F.length(x) >= 5), 1, 3).alias("cues"))
    met = ranked.join(cues, "item_id").join(s, "session_id").withColumn("said", T.normalise(F.col("text")))
    hits = F.size(F.filter("cues", lambda c: F.contains(F.col("said"), c)))
    scored = met.withColumn("score", F.col("lexical") + 0.15 * hits)
    best = F.first("rank").over(Window.partitionBy("item_id").orderBy(F.desc("score"), "rank"))
    moved = scored.withColumn("best", best)
    new = F.when(F.col("rank") == F.col("best"), 1).when(F.col("rank") < F.col("best"), F.col("rank") + 1).otherwise(F.col("rank"))
    return moved.select("item_id", "session_id", F.col("rank").alias("old_rank"), new.alias("rank"))


@query(
    f"""WITH t AS (SELECT item_id, text, {_TASK} AS task_type FROM benchmark), n AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY item_id) AS r FROM t),
q AS (SELECT *, CASE task_type WHEN 'causal_recall' THEN 3 WHEN 'turning_point_recall' THEN 5 WHEN 'constraint_recall' THEN 4 WHEN 'cue_recall' THEN 4 ELSE 4 END AS quota FROM n),
f AS (SELECT *, r <= quota AS by_quota, row_number() OVER (ORDER BY r > quota, item_id) AS place FROM q)
SELECT item_id, task_type, by_quota, place FROM f WHERE place <= 20"""
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty items: up to the quota of each task type, then filled in order of id."""
    limit = 20
    half_even = lambda x: round(limit * x)
    quota = {"causal_recall": max(2, half_even(0.15)), "turning_point_recall": max(3, half_even(0.25)), "constraint_recall": max(2, half_even(0.20)), "cue_recall": max(2, half_even(0.20))}
    quota["event_recall"] = max(1, limit - sum(quota.values()))
    typed = _questions(spark, sf_dir).select("item_id", T.task_type(F.col("text")).alias("task_type"))
    nth = F.row_number().over(Window.partitionBy("task_type").orderBy("item_id"))
    most = F.create_map(*(F.lit(x) for pair in quota.items() for x in pair))[F.col("task_type")]
    picked = typed.withColumn("r", nth).withColumn("by_quota", F.col("r") <= most)
    first = picked.orderBy(~F.col("by_quota"), "item_id").limit(limit)
    return first.select("item_id", "task_type", "by_quota", F.row_number().over(Window.orderBy(~F.col("by_quota"), "item_id")).alias("place"))


@query(
    """WITH s(stage) AS (VALUES ('weak_cue'), ('refined_cue'), ('full_question')),
b AS (SELECT item_id, text AS question, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 5)[1:3], ' ') AS weak FROM benchmark)
SELECT item_id, stage, CASE stage WHEN 'weak_cue' THEN CASE WHEN weak <> '' THEN weak ELSE question END WHEN 'refined_cue' THEN trim(weak || ' ' || question) ELSE question END AS query_text FROM b, s"""
)
def stage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that asks for an item at each stage of progressive recall."""
    weak = F.array_join(F.slice(F.filter(F.split(T.normalise(F.col("text")), " "), lambda x: F.length(x) >= 5), 1, 3), " ")
    rows = _questions(spark, sf_dir).select("item_id", F.col("text").alias("question"), weak.alias("weak"))
    staged = rows.withColumn("stage", F.explode(F.array(*map(F.lit, ("weak_cue", "refined_cue", "full_question")))))
    said = F.when(F.col("stage") == "weak_cue", F.when(F.col("weak") != "", F.col("weak")).otherwise(F.col("question")))
    said = said.when(F.col("stage") == "refined_cue", F.trim(F.concat_ws(" ", "weak", "question"))).otherwise(F.col("question"))
    return staged.select("item_id", "stage", said.alias("query_text"))


@query(
    f"""WITH e AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS token FROM documents)
SELECT token, {hashing.fnv_sql('token', 4096)} AS h4096, {hashing.fnv_sql("'1::0::' || token", 2048)} AS h2048 FROM e"""
)
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable hash of every token, with and without a prefix."""
    tokens = _sessions(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", hashing.fnv(F.col("token"), 4096).alias("h4096"), hashing.fnv(F.concat(F.lit("1::0::"), "token"), 2048).alias("h2048"))


@query()
def blake_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BLAKE2b bucket of every token; SQL has no such function."""
    tokens = _sessions(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", hashing.blake(F.col("token"), 4096).alias("bucket"))


DIM = 2048


def hashed_counts(rows: DataFrame, id_col: str, dim: int = DIM) -> DataFrame:
    """(id, b array<int>, tf array<int>): how often the tokens and pairs of neighbouring tokens of a row fall into each bucket.

    One row for each text, nothing is shuffled; a feature is hashed once for 128 texts.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                place: dict[str, int] = {}
                owner, codes = [], []
                for n, k in enumerate(part.column(1).to_pylist()):
                    own = [place.setdefault(f, len(place)) for f in (*k, *(f"{x}__{y}" for x, y in zip(k, k[1:])))]
                    owner.append(np.full(len(own), n))
                    codes.append(np.array(own, np.int64))
                buckets = (hashing.fnv_many(list(place)) % np.uint64(dim)).astype(np.int64)
                key, tf = np.unique(np.concatenate(owner) * dim + buckets[np.concatenate(codes)], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * dim).astype(np.int32))
                lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(0), lists(key % dim), lists(tf)], names=[id_col, "b", "tf"])

    return rows.select(id_col, T.tokens(F.col("text")).alias("k")).mapInArrow(run, f"{id_col} {kind}, b array<int>, tf array<int>")


def bucket_idf(counts: DataFrame) -> DataFrame:
    """(bucket, idf) over the rows of hashed_counts, one for each bucket at most."""
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    df = counts.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("bucket", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighed(counts: DataFrame, id_col: str, idf: DataFrame, dim: int = DIM, other: float = 0.0) -> DataFrame:
    """(id, b array<int>, w array<double>): unit vectors of ln(1 + tf) * idf; buckets without an idf have `other`, and drop out at 0."""
    spark, kind = counts.sparkSession, counts.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast([(r.bucket, r.idf) for r in idf.collect()])  # dim rows at most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = np.full(dim, other)
        for bucket, value in shared.value:
            of[bucket] = value
        for batch in batches:
            b, tf, n = batch.column(1), batch.column(2), batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(b.offsets.to_numpy()))
            at = b.flatten().to_numpy()
            x = np.log1p(tf.flatten().to_numpy()) * of[at]
            keep = x > 0
            at, owner, x = at[keep], owner[keep], x[keep]
            x = x / np.sqrt(np.bincount(owner, x * x, n))[owner]
            ends = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(x))], names=[id_col, "b", "w"])

    return counts.mapInArrow(run, f"{id_col} {kind}, b array<int>, w array<double>")


def unfolded(vectors: DataFrame, id_col: str) -> DataFrame:
    """Long vectors (id, bucket, w)."""
    pair = F.explode(F.arrays_zip("b", "w")).alias("x")
    return vectors.select(id_col, pair).select(id_col, F.col("x.b").cast("long").alias("bucket"), "x.w")


def hashed_vectors(rows: DataFrame, id_col: str, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Long unit vectors (id, bucket, w) of ln(1 + tf) * idf, and the idf of the buckets."""
    counts = cut(hashed_counts(rows, id_col))
    idf = cut(bucket_idf(counts)) if idf is None else idf
    return unfolded(weighed(counts, id_col, idf), id_col), idf


def _sql_vectors(name: str, table: str, id_col: str, idf: str | None) -> str:
    own = f"""
{name}_k AS (SELECT {id_col} AS id, {sql_tokens('text')} AS k FROM {table}),
{name}_f AS (SELECT id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || '__' || k[i + 1]))) AS feature FROM {name}_k),
{name}_h AS (SELECT feature, {hashing.fnv_sql('feature', DIM)} AS bucket FROM (SELECT DISTINCT feature FROM {name}_f)),
{name}_t AS (SELECT id, bucket, count(*) AS tf FROM {name}_f JOIN {name}_h USING (feature) GROUP BY ALL),"""
    if idf is None:
        own += f"{name}_i AS (SELECT bucket, ln((1.0 + (SELECT count(*) FROM {table})) / (1.0 + count(*))) + 1.0 AS idf FROM {name}_t GROUP BY bucket),"
        idf = f"{name}_i"
    return own + f"{name}_x AS (SELECT id, bucket, ln(1.0 + tf) * idf AS x FROM {name}_t JOIN {idf} USING (bucket)), {name} AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM {name}_x)"


@query(
    f"""WITH {_sql_vectors('dv', 'documents', 'doc_id', None)}, {_sql_vectors('qv', 'benchmark', 'item_id', 'dv_i')},
sc AS (SELECT q.id AS item_id, d.id AS session_id, round(sum(q.w * d.w), 6) AS cosine FROM qv q JOIN dv d USING (bucket) GROUP BY ALL)
SELECT item_id, session_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, session_id) AS rank FROM sc) WHERE rank <= 10"""
)
def hashed_tfidf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each question by the cosine of hashed tf-idf vectors."""
    counts = cut(hashed_counts(_sessions(spark, sf_dir), "session_id"))
    asked, idf = hashed_vectors(_questions(spark, sf_dir), "item_id", cut(bucket_idf(counts)))
    return rank.nearest(asked, weighed(counts, "session_id", idf), DIM, 10)


@query(
    f"""WITH s AS (SELECT 'conv_' || conv_id AS session_id, turn, text, {sql_normal('text')} AS n FROM conversations WHERE role = 'user'),
a AS (SELECT session_id, min(turn) AS first_user, max(turn) AS last_user FROM s GROUP BY session_id)
SELECT session_id, first_user AS start_turn, last_user AS end_turn FROM a"""
)
def default_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First to last user turn of each session, the span of an item without evidence."""
    turns = catalogue.turns(read(spark, sf_dir, "conversations")).where("role = 'user'")
    return turns.groupBy("session_id").agg(F.min("turn").alias("start_turn"), F.max("turn").alias("end_turn"))


@query(
    f"""WITH src AS (SELECT min(doc_id) AS doc_id, coalesce(text, '') AS text FROM documents GROUP BY coalesce(text, '')), {_sql_vectors('dv', 'src', 'doc_id', None)},
dfs AS (SELECT bucket, count(*) AS df FROM dv_t GROUP BY bucket) SELECT bucket, df, (SELECT count(*) FROM src) AS n_texts, round(idf, 6) AS idf FROM dv_i JOIN dfs USING (bucket)"""
)
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of a feature store that took half of the documents first and then all of them, of which it only worked out the new ones."""
    docs = _sessions(spark, sf_dir)
    store = FeatureStore(spark, f"features_{uuid.uuid4().hex}", lambda fresh: hashed_counts(fresh, "key"))
    middle = docs.agg(F.percentile_approx("session_id", 0.5)).first()[0]
    store.add(docs.where(F.col("session_id") <= middle), "first")
    store.add(docs, "all")
    made = cut(store.idf())
    store.drop()
    return made.select(F.col("bucket").cast("long").alias("bucket"), "df", "n_texts", F.round("idf", 6).alias("idf"))
