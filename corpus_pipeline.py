"""A corpus pipeline of five stages; each reads what its predecessor kept.

toxicity: documents that the classifier rejects go.
exact_dedup: of equal texts the row with the largest id stays.
near_dedup: of each group of near duplicates one row with the smallest id stays; texts without words have no duplicates.
mixing: each document is repeated as often as the mix takes it.
bpe: token ids of every document, checked by decoding them.

A row is told from others by its id and text, never by its id alone, so repeated ids
lose no text; null ids count as one more id. Of rows that tie on both, one is left by
the two stages of dedup. Further columns may have any names. Rows of no text are
documents like others: one of them stays in exact_dedup, and its mix is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import bpe, minhash, mixing, toxicity
from memloom.llm import exact_dedup as exact
from memloom.llm.common import documents, drop_written, materialise, table, unused


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The labels refer to the documents as they came, so the model is trained on what this stage gets."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*")


def _one_of_each(docs: DataFrame, kept: DataFrame, own: list) -> DataFrame:
    """The rows of docs that kept names, one for each; own: columns of docs that correspond to those of kept.

    Ids and flags for nulls are plain columns, so the join and the dropping of ties share one shuffle.
    """
    names = unused(docs.columns, *(f"_{i}" for i in range(len(own))))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(c.alias(n) for c, n in zip(own, names, strict=True)))
    return rows.join(kept.toDF(*names), names, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns))


def _id_columns(name: str = "doc_id") -> list:
    return [F.coalesce(F.col(name).cast("string"), F.lit("")), F.col(name).isNull()]


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact.DigestIndex.temporary(spark, "pipeline_digests")
    kept = exact.exact_dedup(docs, index).where("kept").select("text_sha256", *_id_columns())
    index.drop()
    return _one_of_each(docs, kept, [exact.digest(), *_id_columns()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_dedup(docs).where("first").select("text_hash", *_id_columns())
    worded = minhash.has_words("text")
    rest = docs.where(~worded)
    return _one_of_each(docs.where(worded), kept, [minhash.text_hash("text"), *_id_columns()]).unionByName(rest)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows meet their copies by 128 bits of hash of the whole row, so ids may be null or repeat; rows that are equal in every column take alike."""
    one, two, copies, copy = unused(docs.columns, "_one", "_two", "_copies", "_copy")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({one: F.xxhash64(*own), two: F.xxhash64(F.lit("mix"), *own)})
    taken = mixing.mix(rows, carry=(one, two)).groupBy(one, two).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    return rows.join(taken, [one, two]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixed), ("bpe", tokens)]

#: The classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        made = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(before)  # its rows are in the stage just written
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
