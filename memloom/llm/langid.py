"""Language ID by prediction by partial matching (PPM).

For each language the bytes of training text form a context tree of order 0 to 3
with counts. A symbol in a context that holds it c of n times, with d distinct
symbols, has probability c / (n + d); escape has d / (n + d) and goes on one byte
shorter, below order 0 to 1 / 256 (method C, without exclusion). A context that a
language hasn't seen costs nothing and goes on one byte shorter. Statistics are
frozen after training, so the code length of a byte after its context is one number
for each language: those of all (context, byte) that any language has seen are
worked out once and kept in sparse tables, longest context first, so that scoring a
text is looking up and summing exact code lengths of each language for every byte.

No context is left out: the tables hold at most one row for each training byte and
order, and training takes a bounded sample, of each language the texts with the least
hash of their id: `most` texts, and most_bytes bytes divided by the number of
languages. So the model has at most 3 * most_bytes rows of one float for each language,
and a broadcast of languages * 12 * most_bytes bytes at the very most; on prose few
contexts are new and it's a fiftieth of that.

Defined results: a null text or one without a letter is `und` with score 0; ties go
to the first language by code point; without training rows every answer is `und`;
rows with a null language don't train; rows that share an id take part one by one;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id

#: Texts of each language that train at most, and bytes of all languages together.
MOST, MOST_BYTES = 300, 8 << 20
FOLDS = 3
LETTER = regex.compile(r"\p{L}")
START = b"\n\n\n"
ORDERS = (1, 2, 3)


class Table:
    """Rows by a 32-bit key, in an open-addressed table that is a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        size = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - size), (1 << size) - 1
        self.rows = np.full(1 << size, -1, np.int32)
        self.keys = np.zeros(1 << size, np.uint32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            # Of the keys that want a free slot the first takes it; the others try the next.
            slots, first = np.unique(slot, return_index=True)
            first = first[self.rows[slots] < 0]
            self.rows[slot[first]], self.keys[slot[first]] = left[first], keys[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slot(keys)
        rows = self.rows[slot]
        miss = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            rows[miss] = found = self.rows[slot[miss]]
            miss = miss[(found >= 0) & (self.keys[slot[miss]] != keys[miss])]
        return rows


class Model:
    """bits[n]: code lengths (row, language) of n bytes and the next; escapes[n]: those of leaving a context of n bytes."""

    def __init__(self, languages: list[str], bits: dict, escapes: dict):
        self.languages, self.bits, self.escapes = languages, bits, escapes

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0
        total = self.code_lengths(text)
        best = int(total.argmin())
        return self.languages[best], float(1 / np.exp2(np.clip(total[best] - total, -200, 0)).sum())

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits that each language needs for the whole text, in bounded pieces."""
        data = START + text.encode()
        total = np.zeros(len(self.languages))
        for at in range(0, len(data) - 3, 1 << 16):
            x = np.frombuffer(data, np.uint8, min((1 << 16) + 3, len(data) - at), at).astype(np.uint32)
            keys = x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]
            for n in (3, 2, 1):
                table, values = self.bits[n]
                rows = table.find(_last(keys, n + 1))
                found = rows >= 0
                total += values[rows[found]].sum(axis=0, dtype=np.float64)
                keys = keys[~found]
                table, values = self.escapes[n]
                rows = table.find(_last(keys >> np.uint32(8), n))
                total += values[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
            total += self.bits[0][keys & np.uint32(255)].sum(axis=0, dtype=np.float64)
        return total


def _last(keys: np.ndarray, n: int) -> np.ndarray:
    return keys if n == 4 else keys & np.uint32((1 << 8 * n) - 1)


def fit(texts: dict[str, list[str]]) -> Model:
    languages = sorted(texts)
    if not languages:
        return Model([], {}, {})
    keys = []
    for x in languages:
        data = [np.frombuffer(START + t.encode(), np.uint8).astype(np.uint32) for t in texts[x]]
        keys.append(np.concatenate([d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:] for d in data]) if data else np.empty(0, np.uint32))
    bits, escapes = {}, {}
    zero = np.empty((256, len(languages)))
    for j, own in enumerate(keys):
        counts = np.bincount(own & np.uint32(255), minlength=256).astype(float)
        zero[:, j] = _method_c(counts, counts.sum(), (counts > 0).sum(), np.full(256, 8.0))
    bits[0] = zero
    shorter = lambda k: zero[k & np.uint32(255)]
    for n in ORDERS:
        every = np.unique(np.concatenate([_last(own, n + 1) for own in keys]))
        contexts = np.unique(every >> np.uint32(8))
        where = np.searchsorted(contexts, every >> np.uint32(8))
        below = shorter(_last(every, n))
        lengths, leave = np.empty((len(every), len(languages))), np.zeros((len(contexts), len(languages)))
        for j, own in enumerate(keys):
            found, c = np.unique(_last(own, n + 1), return_counts=True)
            counts = np.zeros(len(every))
            counts[np.searchsorted(every, found)] = c
            total = np.bincount(where, counts, len(contexts))
            distinct = np.bincount(where, counts > 0, len(contexts))
            seen = total > 0
            leave[seen, j] = -np.log2(distinct[seen] / (total[seen] + distinct[seen]))
            lengths[:, j] = _method_c(counts, total[where], distinct[where], below[:, j])
        bits[n], escapes[n] = (Table(every), lengths.astype(np.float32)), (Table(contexts), leave.astype(np.float32))
        shorter = lambda k, every=every, lengths=lengths, contexts=contexts, leave=leave, before=shorter, n=n: _lookup(k, every, lengths, contexts, leave, before, n)
    return Model(languages, bits, escapes)


def _method_c(counts: np.ndarray, total, distinct, shorter: np.ndarray) -> np.ndarray:
    """Code lengths of symbols with these counts in contexts of these totals, given those one byte shorter."""
    with np.errstate(divide="ignore", invalid="ignore"):
        own, escape = -np.log2(counts / (total + distinct)), -np.log2(distinct / (total + distinct))
    return np.where(np.equal(total, 0), shorter, np.where(counts > 0, own, escape + shorter))


def _lookup(keys: np.ndarray, every: np.ndarray, lengths: np.ndarray, contexts: np.ndarray, leave: np.ndarray, before, n: int) -> np.ndarray:
    """Code lengths of keys of n + 1 bytes in the tables of order n, for every language."""
    at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
    context = np.minimum(np.searchsorted(contexts, keys >> np.uint32(8)), len(contexts) - 1)
    known = contexts[context] == keys >> np.uint32(8)
    away = np.where(known[:, None], leave[context], 0.0) + before(_last(keys, n))
    return np.where((every[at] == keys)[:, None], lengths[at], away)


def train(docs: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, hold_out: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from texts with a language; the fold crc32(id) mod 3 = 1 never trains."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    if hold_out:
        rows = rows.where(crc32_of_id() % FOLDS != 1)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit({})
    # A hash keeps about twice the wanted number before any text is moved; the rank makes the bound exact.
    h = F.xxhash64(F.lit("langid"), "doc_id")
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * most / n + 30.0 / n)))))
    near = rows.where((F.pmod(h, F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(h, "doc_id", "text")
    ranked = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    room = most_bytes // len(counts)
    sofar = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.where(F.octet_length("text") <= room).withColumn("sofar", sofar).where(F.col("sofar") <= room)
    texts: dict[str, list[str]] = {}
    for r in ranked.select("lang", "text").collect():
        texts.setdefault(r[0], []).append(r[1])
    return fit({x: sorted(t) for x, t in texts.items()})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [own.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    said = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return said.select("doc_id", (crc32_of_id() % FOLDS == 1).alias("held_out"), "lang_pred", "score")
