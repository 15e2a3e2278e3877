"""Scoring and ranking sessions for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut


def token_counts(rows: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """(id, token, n) for tokens of at least `least` characters."""
    each = rows.select(id_col, F.explode(T.tokens(F.col(text_col))).alias("token")).where(F.length("token") >= least)
    return each.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def lexical_scores(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(item_id, session_id, lexical) of pairs that share a token: sum of the lesser counts over the question's tokens.

    An inverted join on tokens. Session tokens that no question has are dropped by a
    semi-join before their counts are taken.
    """
    q = token_counts(questions, "item_id", "text")
    q = q.withColumn("total", F.sum("n").over(Window.partitionBy("item_id")))
    wanted = q.select("token").distinct()
    each = sessions.select("session_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    s = each.join(wanted, "token", "left_semi").groupBy("session_id", "token").agg(F.count(F.lit(1)).alias("m"))
    pairs = s.join(q, "token").groupBy("item_id", "session_id").agg(F.sum(F.least("n", "m")).alias("shared"), F.max("total").alias("total"))
    return pairs.select("item_id", "session_id", F.round(F.col("shared") / F.col("total"), 6).alias("lexical"))


def lexical_nearest(questions: DataFrame, sessions: DataFrame, k: int, rows_at_once: int = 20_000) -> DataFrame:
    """(item_id, session_id, lexical, rank): the k best sessions of each question by lexical_scores, without making the pairs.

    The questions go over all sessions in blocks of about `rows_at_once` distinct tokens of questions. A task
    counts the block's tokens in a few hundred sessions at a time; a sum of lesser counts is the
    sum over levels l of products of "at least l times" matrices. It hands on the sessions that
    reach the k-th best of a question so far, so that a token that all share makes no rows.
    """
    spark = questions.sparkSession
    q = cut(token_counts(questions.where("item_id is not null"), "item_id", "text"))
    blocks = -(-q.count() // rows_at_once) or 1
    texts = sessions.select("session_id", "text")
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("item_id", questions), ("session_id", sessions))}
    schema = f"item_id {kinds['item_id']}, session_id {kinds['session_id']}, score double"
    found = None
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()  # about rows_at_once
        asked = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["token"] for r in rows], [r["n"] for r in rows]))
        made = texts.mapInArrow(_lexical_best(asked, k), schema)
        found = made if found is None else found.unionByName(made)
    return top_k(found.select("item_id", "session_id", F.round("score", 6).alias("lexical")), k)


def _lexical_best(asked, k: int):
    def run(batches):
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        from .. import lexicons as lex

        ids, tokens, counts = asked.value
        kind = pa.string() if ids and isinstance(ids[0], str) else pa.int64()
        items = list(dict.fromkeys(ids))
        number = {t: j for j, t in enumerate(dict.fromkeys(tokens))}
        place = {x: j for j, x in enumerate(items)}
        wanted = np.zeros((len(items), len(number)), np.int64)
        for x, t, n in zip(ids, tokens, counts, strict=True):
            wanted[place[x], number[t]] = n
        total = wanted.sum(axis=1)
        levels = []
        for level in range(1, int(wanted.max(initial=0)) + 1):
            columns = np.flatnonzero((wanted >= level).any(axis=0))
            levels.append((level, columns, (wanted[:, columns] >= level).astype(np.float32)))
        best = np.full((len(items), k), -1.0)
        split, known = re.compile(lex.TOKEN_RE).findall, number.keys()
        for batch in batches:
            for start in range(0, batch.num_rows if items else 0, 256):
                part = batch.slice(start, 256)
                held = np.zeros((part.num_rows, len(number)), np.int32)
                for row, text in enumerate(part.column(1)):
                    # Tokens are ASCII, so the case of what lies between them doesn't matter.
                    said = Counter(map(str.lower, split(text.as_py() or "")))
                    for t in known & said.keys():
                        held[row, number[t]] = said[t]
                shared = np.zeros((len(items), part.num_rows))
                for level, columns, at_least in levels:
                    shared += at_least @ (held[:, columns] >= level).astype(np.float32).T
                score = np.where(shared > 0, np.round(shared / total[:, None], 6), -1.0)
                # Equal scores may still be among the first by their ids.
                least = best.min(axis=1)
                item, doc = np.nonzero((score > 0) & (score >= least[:, None] - 2e-6))
                best = -np.partition(-np.hstack([best, score]), k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([items[j] for j in item], kind), part.column(0).take(pa.array(doc)), pa.array(shared[item, doc] / total[item])], names=["item_id", "session_id", "score"]
                )

    return run


def pair_lexical(pairs: DataFrame, questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(item_id, session_id, lexical) of the given pairs only, 0 where they share no token."""
    q = token_counts(questions, "item_id", "text")
    q = q.withColumn("total", F.sum("n").over(Window.partitionBy("item_id")))
    wanted = pairs.select("session_id").distinct()
    s = token_counts(sessions.join(wanted, "session_id", "left_semi"), "session_id", "text").withColumnRenamed("n", "m")
    met = pairs.select("item_id", "session_id").join(q, "item_id").join(s, ["session_id", "token"])
    shared = met.groupBy("item_id", "session_id").agg((F.sum(F.least("n", "m")) / F.max("total")).alias("l"))
    return pairs.join(shared, ["item_id", "session_id"], "left").select("item_id", "session_id", F.round(F.coalesce("l", F.lit(0.0)), 6).alias("lexical"))


def top_k(scores: DataFrame, k: int, by: str = "lexical", group: str = "item_id", tie: str = "session_id") -> DataFrame:
    """The k best of each group with their rank; ties by the id. row_number <= k lets Spark cut each partition first."""
    order = Window.partitionBy(group).orderBy(F.desc(by), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(asked: DataFrame, held: DataFrame, dim: int, k: int, name: str = "cosine", block: int = 1024) -> DataFrame:
    """(item_id, session_id, name, rank): the k best sessions of each item by the product of their sparse vectors, rounded, of those that share a bucket.

    asked: item_id, bucket, w; held: the same of session_id, or session_id with arrays b and w.

    The questions go over all sessions in blocks of about `block`, each a dense matrix of
    block * dim numbers at most that is broadcast. A task multiplies it with a few hundred
    sessions at a time and hands on those that reach the k-th best of the question so
    far, so that no more than the best of each task are ranked.
    """
    spark = asked.sparkSession
    vectors = held if "b" in held.columns else held.groupBy("session_id").agg(F.collect_list("bucket").alias("b"), F.collect_list("w").alias("w"))  # dim entries at most
    vectors = cut(vectors.select("session_id", "b", "w"))
    blocks = -(-asked.select("item_id").distinct().count() // block)
    found = None
    for i in range(max(1, blocks)):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))) == i).select("item_id", "bucket", "w").toPandas()
        made = vectors.mapInArrow(_best_of(spark.sparkContext.broadcast((rows.item_id.to_numpy(), rows.bucket.to_numpy(), rows.w.to_numpy())), dim, k), "item_id long, session_id long, score double")
        found = made if found is None else found.unionByName(made)
    return top_k(found.select("item_id", "session_id", F.round("score", 6).alias(name)), k, by=name)


def _best_of(questions, dim: int, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, at, weights = questions.value
        items, row = np.unique(ids, return_inverse=True)
        asked = np.zeros((dim, len(items)))
        asked[at.astype(np.int64), row] = weights
        best = np.full((k, len(items)), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                b, w = part.column(1), part.column(2)
                held = np.zeros((part.num_rows, dim))
                held[np.repeat(np.arange(part.num_rows), np.diff(b.offsets.to_numpy())), b.flatten().to_numpy().astype(np.int64)] = w.flatten().to_numpy()
                scores = held @ asked
                scores[scores <= 0] = -np.inf  # no bucket in common
                best = -np.partition(-np.vstack([best, scores]), k - 1, axis=0)[:k]
                # What rounds to the k-th best may still be among the first by its id.
                doc, item = np.nonzero((scores >= best.min(axis=0) - 1e-6) & (scores > 0))
                yield pa.RecordBatch.from_arrays([pa.array(items[item].astype(np.int64)), part.column(0).take(pa.array(doc)), pa.array(scores[doc, item])], names=["item_id", "session_id", "score"])

    return run


def two_stage(items: DataFrame, sessions: DataFrame, lexical: DataFrame, shadow: DataFrame, refine: int = 24) -> DataFrame:
    """(item_id, session_id, short, mix, rank) of every session for every item: the shortlists by mixed, lexical and volume scores first, then the rest, each by mixed score.

    The result is the product of both ids, so they are crossed; pairs without a score count 0.
    """
    scores = lexical.join(shadow, ["item_id", "session_id"], "full")
    every = items.select("item_id").distinct().crossJoin(sessions.select("session_id").distinct())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = every.join(scores, ["item_id", "session_id"], "left").withColumns({"lexical": zero("lexical"), "shadow": zero("shadow")})
    both = both.withColumn("mix", F.round(0.65 * F.col("lexical") + 0.35 * F.col("shadow"), 9))
    nth = lambda c: F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round(c, 9)), "session_id"))
    placed = both.withColumns({"by_mix": nth("mix"), "by_lexical": nth("lexical"), "by_shadow": nth("shadow")})
    short = (F.col("by_mix") <= refine) | (F.col("by_lexical") <= refine) | (F.col("by_shadow") <= max(8, refine // 2))
    order = Window.partitionBy("item_id").orderBy(F.desc("short"), F.desc("mix"), "session_id")
    made = placed.withColumn("short", short).withColumn("rank", F.row_number().over(order))
    return made.select("item_id", "session_id", "short", F.round("mix", 6).alias("mix"), "rank")


def containing(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(item_id, session_id) where the session's text holds the question's as a whole.

    The longest inner token of a question has to be a token of such a session, so the
    pairs come from an equi-join on it and the substring test only confirms them.
    Questions without an inner token are compared as they are; they are few and short.
    """
    inner = F.slice(F.col("k"), 2, F.greatest(F.size("k") - 2, F.lit(0)))
    longest = F.array_min(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x"))))["x"]
    keyed = questions.select("item_id", F.col("text").alias("q"), T.raw_tokens(F.col("text")).alias("k")).withColumn("token", longest)
    words = sessions.select("session_id", "text", F.explode(F.array_distinct(T.raw_tokens(F.col("text")))).alias("token"))
    hits = keyed.where("token is not null").select("item_id", "q", "token").join(words, "token").where(F.contains("text", "q"))
    bare = keyed.where("token is null and q <> ''").select("item_id", "q")
    plain = bare.join(sessions.select("session_id", "text"), F.contains(F.col("text"), F.col("q")))
    return hits.select("item_id", "session_id").unionByName(plain.select("item_id", "session_id")).distinct()


def recall_and_mrr(ranked: DataFrame, gold: DataFrame, questions: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """For every question the best rank of a gold session, recall at each k and the reciprocal rank; 0 without one."""
    best = ranked.join(gold, ["item_id", "session_id"]).groupBy("item_id").agg(F.min("rank").alias("best"))
    at = [F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}") for k in ks]
    return questions.join(best, "item_id", "left").select(*questions.columns, "best", *at, F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"))


def evidence_spans(turns: DataFrame, questions: DataFrame, most: int = 4, head: int = 5) -> DataFrame:
    """(session_id, item_id, start_turn, end_turn, score) of user turns that hold an evidence term.

    A turn that holds a term holds the term's first five characters, so both sides
    meet in an equi-join on those before the substring is tested.
    """
    long = F.slice(F.filter(F.split(T.normalise(F.col("text")), " "), lambda x: F.length(x) >= head), 1, most)
    terms = questions.select("item_id", F.explode(long).alias("term")).distinct().withColumn("gram", F.substring("term", 1, head))
    said = turns.where("role = 'user'").select("session_id", "turn", T.normalise(F.col("content")).alias("said"))
    starts = F.sequence(F.lit(1), F.length("said") - head + 1)
    grams = F.when(F.length("said") >= head, F.array_distinct(F.transform(starts, lambda i: F.substring("said", i, F.lit(head)))))
    met = said.withColumn("gram", F.explode(grams)).join(terms, "gram").where(F.contains("said", "term"))
    return met.groupBy("session_id", "item_id").agg(F.min("turn").alias("start_turn"), F.max("turn").alias("end_turn"), F.lit(0.5).alias("score"))
