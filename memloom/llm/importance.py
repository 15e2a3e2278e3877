"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: one of target
text (documents labelled as good), one of all raw text. A document's log importance
is the sum over its n-grams of log p(target) - log p(raw); adding Gumbel noise drawn
from a hash of the row and taking the k greatest samples k documents without
replacement in proportion to their importance.

Each task counts into one array of BUCKETS and hands on at most BUCKETS rows, so
neither shuffle nor driver grows with the texts. Raw counts cover every document; the
target model takes a bounded sample of labelled ids. The k-th greatest key is found
by narrowing histograms, without a global sort.

Defined results: null and empty texts have no n-grams and importance 0; noise depends
on id and text, so rows without an id draw their own, and equal rows draw the same;
rows that tie with the k-th key are kept together; without labels every document is
kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialise

BITS = 14
BUCKETS = 1 << BITS
#: Labelled ids that form the target at most.
MOST = 20_000


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the words and word pairs of one text, with repeats."""
    words = (text or "").lower().encode().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:]
    both = np.concatenate([h, pairs ^ (pairs >> np.uint32(16))]) * np.uint32(0x85EBCA6B)
    return (both >> np.uint32(32 - BITS)).astype(np.int64)


def models(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, both with one added to each count."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(target_ids.withColumn("target", F.lit(True))), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ngrams(text)
                np.add.at(raw, found, 1)
                if good:
                    np.add.at(target, found, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counted = flagged.select("text", F.coalesce("target", F.lit(False)).alias("good")).mapInArrow(run, "bucket long, raw long, target long")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows at most
        raw[r[0]] += r[1]
        target[r[0]] += r[2]
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float64)


def kth_greatest(keys: DataFrame, column: str, k: int, bins: int = 2048, enough: int = 10_000) -> float | None:
    """The k-th greatest value of a double column, by histograms of ever narrower ranges; None if there are k rows at most."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k or k < 1:
        return None
    rest = keys.select(F.col(column).alias("x"))
    while n > enough and high > low:
        width = (high - low) / bins
        if low + width <= low:
            break
        at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        found = sorted(rest.groupBy(at.alias("bin")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect(), reverse=True)
        for _, count, least, most in found:
            if k <= count:
                low, high, n = least, most, count
                break
            k -= count
        rest = rest.where(F.col("x").between(F.lit(low), F.lit(high)))
        if len(found) == 1:
            break
    if high == low:
        return low
    if n > enough:  # neighbouring doubles that no histogram can part: few distinct values
        for value, count in sorted(((r[0], r[1]) for r in rest.groupBy("x").count().collect()), reverse=True):
            if k <= count:
                return value
            k -= count
    return sorted((r[0] for r in rest.collect()), reverse=True)[k - 1]


def importance_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, n_grams, log_importance, key, kept of every row.

    share is the part of all rows to sample; by default the upper 95 % confidence
    limit of the share of good rows among the labelled ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    n, good = known.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    picked = known.where("y = 1").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).select("doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(models(rows, picked))
    if share is None:
        p = good / n if n else 1.0
        share = min(1.0, p + 1.96 * sqrt(p * (1 - p) / n)) if n and good else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            counts, sums = [], []
            for text in batch.column(1).to_pylist():
                found = ngrams(text)
                counts.append(len(found))
                sums.append(float(ratio[found].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "even", "n_grams", "log_importance"])

    even = (F.pmod(F.xxhash64(F.lit("gumbel"), F.lit(seed), "doc_id", "text"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = rows.withColumn("even", even).mapInArrow(run, "doc_id long, even double, n_grams long, log_importance double")
    scored = materialise(scored.select("doc_id", "n_grams", "log_importance", (F.col("log_importance") - F.log(-F.log("even"))).alias("key")), "importance")
    total = scored.count()
    least = kth_greatest(scored, "key", ceil(share * total))
    return scored.withColumn("kept", F.lit(True) if least is None else F.col("key") >= F.lit(least))
