"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of the lower-cased UTF-8 bytes that a text holds at
least once. With p and q the smoothed counts of texts of either class that hold a
feature, r = log((p / |p|) / (q / |q|)); a logistic regression is trained on the
features scaled by r. A feature is trained if its rates in the two classes differ by
LEAST_Z standard errors or more, or if it is among the FIRST that differ most: a few
examples have few significant features, and many have more than FIRST. The cut between the classes
is set by scores that models of the other parts of the training texts give each
text. Scoring is one pass over whole texts without a shuffle.

Training takes a bounded sample of labelled texts, the driver holds no more: of each
class those with the least hash of their id, `most` texts and `most_bytes` bytes in
all, and of near copies among them one (near copies would pass the words of one text
off as signs of its class). A longer text than most_bytes never trains.

Defined results: a null or empty text has no features and gets the score of the
intercept; rows with a null label or without a document don't train; a document
labelled twice with different labels counts as the greater; of an id with several
texts the least by code point trains; without examples of both classes every score is
0; columns other than those named are ignored or, on request, handed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc32_of_id

BITS = 20
NGRAMS = (4, 5, 6, 7)
#: Bytes hashed at once, and bytes of a text up to which its features are sorted instead of marked.
PIECE, SORTED = 1 << 16, 1 << 11
#: Texts of each class that train at most, and their bytes in all.
MOST, MOST_BYTES = 2500, 12 << 20
FOLDS = 5
#: Parts of the training texts whose cross-wise scores set the decision cut.
INNER = 5
#: The z score from which on every feature trains, by chance hardly any of 2 ** BITS reaches it; and how many train in any case.
LEAST_Z, FIRST = 4.5, 100


def _hashed(x: np.ndarray) -> np.ndarray:
    """Hashed n-grams of bytes, with repeats."""
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(1)
        if n in NGRAMS:
            y = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            out.append(y >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of one text, worked out piece by piece."""
    if not text:
        return np.empty(0, np.int32)
    data = b" " + text.lower().encode() + b" "
    # Neighbouring pieces overlap, so that every n-gram lies in one of them.
    pieces = (np.frombuffer(data, np.uint8, min(PIECE + max(NGRAMS) - 1, len(data) - at), at).astype(np.uint32) for at in range(0, len(data), PIECE))
    if len(data) <= SORTED:
        return np.unique(_hashed(next(pieces)))
    seen = np.zeros(1 << BITS, bool)
    for piece in pieces:
        seen[_hashed(piece)] = True
    return np.flatnonzero(seen).astype(np.int32)


class Distinct:
    """Tells which texts resemble none that it was asked about before."""

    def __init__(self, most: int, coordinates: int = 32):
        rng = np.random.Generator(np.random.PCG64(7))
        self.a = rng.integers(0, 2**32, coordinates, np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, coordinates, np.uint64).astype(np.uint32)
        self.kept, self.sigs = 0, np.zeros((most, coordinates), np.uint32)

    def new(self, features: np.ndarray) -> bool:
        if not len(features):
            return False
        x = (features.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        sig = np.array([(x * a + b).min() for a, b in zip(self.a, self.b)])
        if ((self.sigs[: self.kept] == sig).sum(axis=1) >= len(sig) // 2).any():
            return False
        self.sigs[self.kept] = sig
        self.kept += 1
        return True


class Model:
    def __init__(self, weights: np.ndarray, intercept: float, trained: bool = True):
        self.weights, self.intercept, self.trained = weights, intercept, trained

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        z = self.intercept + float(self.weights[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratios(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """r of each feature from the smoothed counts of toxic (p) and other (q) texts that hold it."""
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def z_scores(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> np.ndarray:
    """How many standard errors the two class rates of each feature are apart."""
    rate, rate0, every = p / (n_p + 2), q / (n_q + 2), (p + q) / (n_p + n_q + 4)
    return np.abs(rate - rate0) / np.sqrt(every * (1 - np.minimum(every, 0.999999)) * (1 / n_p + 1 / n_q))


def _regression(flat: np.ndarray, row: np.ndarray, y: np.ndarray, r: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic regression on features 0 .. len(r) - 1, present in rows and scaled by r; classes weigh alike. Full-batch Adam."""
    size = np.float32(np.sqrt(max(1.0, len(flat) / len(y))))
    scale = r[flat] / size
    n, k = len(y), len(r)
    w, b = np.zeros(k, np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum())).astype(np.float32)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[flat] * scale, n).astype(np.float32) + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(flat, g[row] * scale, k).astype(np.float32) + decay * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - 0.1 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= 0.1 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return w * r / size, b


def best_cut(z: np.ndarray, y: np.ndarray, odds: float) -> float:
    """The cut of scores z at which F1 is greatest, with the classes at the given odds; the middle between the two scores beside it."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    other = (y.sum() / (len(y) - y.sum())) / odds
    hits, false = np.cumsum(y), np.cumsum((1 - y) * other)
    f1 = 2 * hits / (hits + false + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1.0  # equal scores aren't parted
    at = int(f1.argmax())
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at]) - 1.0


def _chosen(p: np.ndarray, q: np.ndarray, n_p: float, n_q: float, least_z: float) -> np.ndarray:
    z = z_scores(p, q, n_p, n_q)
    chosen = z >= least_z
    chosen[np.argsort(-z, kind="stable")[:FIRST]] = True
    return chosen


def fit(texts: list[str], labels: np.ndarray, odds: float, steps: int = 200, decay: float = 1e-4, least_z: float = LEAST_Z) -> Model:
    """A model of the texts. odds: of the classes before sampling.

    The decision cut is the one of greatest F1 among scores that models of the other
    INNER - 1 parts give each text; with fewer than INNER texts of a class the intercept takes
    half the log odds in instead. Two passes over the texts, one to count and one to keep
    the chosen features, so that the features of no more than one text are held in full.
    """
    counts = np.zeros((INNER, 2, 1 << BITS), np.int32)
    sizes = np.zeros((INNER, 2), int)
    kept, y, parts = [], [], []
    for label in (0, 1):
        told, n = Distinct(len(texts)), 0
        for text in (t for t, own in zip(texts, labels, strict=True) if own == label):
            found = features(text)
            if told.new(found):
                counts[n % INNER, label, found] += 1  # a set holds each feature once
                sizes[n % INNER, label] += 1
                kept.append(text)
                y.append(label)
                parts.append(n % INNER)
                n += 1
    y, parts = np.array(y, np.float32), np.array(parts)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS, np.float32), -30.0, False)
    every, total = counts.sum(axis=0, dtype=np.int32), sizes.sum(axis=0)
    inner = INNER if sizes.min() > 0 else 0
    plans = []
    for i in range(inner + 1):
        # The last model is that of all texts.
        less, fewer, own = (counts[i], sizes[i], parts != i) if i < inner else (np.int32(0), 0, np.ones(len(y), bool))
        (q, p), (n_q, n_p) = every - less + 1.0, total - fewer
        plans.append((_chosen(p, q, n_p, n_q, least_z), log_count_ratios(p, q), own))
    del counts, every
    used = np.flatnonzero(np.logical_or.reduce([chosen for chosen, _, _ in plans]))
    plans = [(chosen[used], r[used], own) for chosen, r, own in plans]
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    sets = []
    for text in kept:
        at = place[features(text)]
        sets.append(at[at >= 0])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cross = np.zeros(len(y))
    for i, (chosen, r, own) in enumerate(plans):
        number = np.cumsum(own) - 1
        live = chosen[flat] & own[row]
        w, b = _regression(flat[live], number[row[live]], y[own], r * chosen, steps, decay)
        if i < inner:
            z = np.bincount(row, w[flat], len(y)) + b
            cross[~own] = z[~own]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, b - best_cut(cross, y, odds) if inner else b + 0.5 * float(np.log(odds)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold_out: bool = True) -> Model:
    """A model from labelled texts; the fold crc32(id) mod 5 = 0 never trains."""
    one = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if hold_out:
        one = one.where(crc32_of_id() % FOLDS != 0)
    one = one.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if len(counts) < 2:
        return fit([], np.empty(0), 1.0)
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = [one.where(F.col("y") == y).orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most 2 * most ids, whatever the table's size: safe to broadcast, and no more rows in the windows.
    rows = texts.join(F.broadcast(picked), "doc_id").where("text is not null").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.where(F.octet_length("text") <= most_bytes)
    sofar = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(order, "doc_id"))
    rows = rows.withColumn("sofar", sofar).where(F.col("sofar") <= most_bytes).orderBy("doc_id").select("text", "y").collect()
    return fit([r[0] for r in rows], np.array([r[1] for r in rows]), counts[1] / counts[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row and, on request, row: all columns of the input as one struct."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *whole, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = pa.array([own.score(t) for t in part.column(last).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(last)), found], names=[*part.schema.names[:-1], "score"])

    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    scored = rows.mapInArrow(run, schema)
    held = (crc32_of_id() % FOLDS == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["row"] if carry else []))
