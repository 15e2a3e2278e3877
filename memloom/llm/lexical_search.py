"""Ranked lexical search: WAND over shards of documents, heaps of shards merged.

Search takes the items in blocks that are bounded in bytes, each block over all documents:

1. Tasks cut whole texts into terms and keep, of each document, its length in terms and the
   frequencies of those terms that the block's items use. That forward index is written to the
   shared folder; document frequencies, document count and total length are aggregates of it.
2. A task reads its part of the index in shards of bounded size. A shard has a posting
   list for each term and, for each term, its greatest impact in the shard. All items of
   the block run WAND on the shard in lockstep: in each step every item sorts its cursors by
   document and adds up greatest impacts until they exceed the item's threshold (the lowest
   score of its heap); the cursor reached is the pivot. Documents before the pivot can't enter the
   heap, so all cursors before it skip to it; the pivot is scored only if the
   greatest impacts of the terms found there still exceed the threshold. Every shard hands on its best
   documents of each item.
3. Heaps merge by rank within (item, slice of shards) and then within the item.

A shard's documents are visited by ascending doc_id, so of equal scores the smaller id
enters first, and a later equal score never does.

Defined results: null texts and texts without a term count for nothing; an item without
terms, or a null one, gives no rows; repeated items are items of their own and give their
rows each; repeated documents take ranks each; a null doc_id ranks behind all
others of equal score; with empty tables the result is empty; columns other than the ids and
texts aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_written, materialise

BEST = 50
#: Bytes of item texts that are searched together.
BLOCK_BYTES = 4 << 20
#: Bounds of a shard: documents, and postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 2_000_000
#: Cells (item, term) that one lockstep holds; a longer item runs by itself.
CELLS = 1 << 13
#: Slices in which heaps of shards are merged first.
SLICES = 64

#: ASCII letters become lower case, all other ASCII but digits parts terms; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n_terms: int, n_docs: int, all_terms: int) -> int:
    return 100 - 50 + (50 * n_terms * n_docs) // all_terms


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms, tfs of each document with a term; terms are numbers of the vocabulary, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        wanted = number.keys()
        for batch in batches:
            rows, lengths, found, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(pc.cast(batch.column(1), pa.binary())):
                counted = Counter(terms(text.as_py() or b""))
                if counted:
                    own = sorted((number[t], counted[t]) for t in wanted & counted.keys())
                    rows.append(i)
                    lengths.append(counted.total())
                    found += [t for t, _ in own]
                    tfs += [f for _, f in own]
                    ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Posting lists of one shard with the impact of each posting; documents are numbered by ascending doc_id."""

    def __init__(self, ids: pa.Array, n: np.ndarray, term_rows: list, tf_rows: list, weights: np.ndarray, n_docs: int, all_terms: int) -> None:
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        self.ids = ids.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, tf = np.concatenate(term_rows).astype(np.int64), np.concatenate(tf_rows)
        doc = np.repeat(place, [len(r) for r in term_rows])
        m = np.array([length_norm(int(x), n_docs, all_terms) for x in n], np.int64)[order]
        self.docs = len(order)
        key = term * (self.docs + 1) + doc
        by_key = np.argsort(key)
        self.key, self.doc, tf = key[by_key], doc[by_key], tf[by_key]
        self.impact = weights[term[by_key]] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc]))
        edge = np.arange(len(weights) + 1) * (self.docs + 1)
        bounds = np.searchsorted(self.key, edge)
        self.start, self.end = bounds[:-1], bounds[1:]
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(self.end > self.start)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.start[held])

    def search(self, items: list[np.ndarray], best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of each item's best documents; items are arrays of terms, run in lockstep."""
        width = max(map(len, items))
        cell = np.full((len(items), width), -1)
        for i, t in enumerate(items):
            cell[i, : len(t)] = t
        live = cell >= 0
        pos, end = np.where(live, self.start[cell], 0), np.where(live, self.end[cell], 0)
        most = np.where(live, self.most[cell], 0)
        last = len(self.doc) - 1
        at = np.where(pos < end, self.doc[np.minimum(pos, last)], self.docs)
        item = np.arange(len(items))
        heap = np.zeros((len(items), best), np.int64)  # scores only; which of equal ones goes doesn't matter for the threshold
        threshold = np.zeros(len(items), np.int64)
        bits = max(1, (width - 1).bit_length())
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        column = np.arange(width)
        while len(item):
            packed = np.sort((at << bits) | column, axis=1)
            ordered, doc = packed & ((1 << bits) - 1), packed >> bits
            bound = np.cumsum(np.where(doc < self.docs, np.take_along_axis(most, ordered, 1), 0), axis=1)
            over = bound > threshold[:, None]
            going = over[:, -1]
            if not going.all():  # the lists that an item has left can't beat its heap any more
                cell, pos, end, most, at, item, heap, threshold, over, doc = (x[going] for x in (cell, pos, end, most, at, item, heap, threshold, over, doc))
                if not len(item):
                    break
            row = np.arange(len(item))
            pivot = doc[row, over.argmax(axis=1)]
            r, c = np.nonzero(at < pivot[:, None])
            if len(r):
                pos[r, c] = np.searchsorted(self.key, cell[r, c] * (self.docs + 1) + pivot[r])
                at[r, c] = np.where(pos[r, c] < end[r, c], self.doc[np.minimum(pos[r, c], last)], self.docs)
            here = at == pivot[:, None]
            full = np.where(here, most, 0).sum(axis=1) > threshold
            r, c = np.nonzero(here)
            score = np.zeros(len(item), np.int64)
            worth = full[r]
            np.add.at(score, r[worth], self.impact[pos[r[worth], c[worth]]])
            pos[r, c] += 1
            at[r, c] = np.where(pos[r, c] < end[r, c], self.doc[np.minimum(pos[r, c], last)], self.docs)
            enters = np.flatnonzero(score > threshold)
            if len(enters):
                kept.append((item[enters], pivot[enters], score[enters]))
                lowest = heap[enters].argmin(axis=1)
                heap[enters, lowest] = score[enters]
                threshold[enters] = heap[enters].min(axis=1)
        if not kept:
            return (np.zeros(0, np.int64),) * 3
        item, doc, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        fine = rank < best
        return item[fine], doc[fine], score[fine]


def _locksteps(items: list[np.ndarray], cells: int) -> Iterator[list[int]]:
    """Numbers of items, like long ones together, so that a lockstep has so many cells at most."""
    group: list[int] = []
    for i in sorted((i for i, t in enumerate(items) if len(t)), key=lambda i: len(items[i])):
        if group and (len(group) + 1) * len(items[i]) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _shards(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[tuple[pa.Array, np.ndarray, list, list]]:
    ids, n, term_rows, tf_rows, postings = [], [], [], [], 0
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        found, tfs = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
        lengths = batch.column(1).to_numpy()
        for i in range(len(batch)):
            ids.append(batch.column(0)[i].as_py())
            n.append(lengths[i])
            term_rows.append(found[ends[i] : ends[i + 1]])
            tf_rows.append(tfs[ends[i] : ends[i + 1]])
            postings += len(term_rows[-1])
            if len(ids) >= docs or postings >= SHARD_POSTINGS:
                yield pa.array(ids, pa.int64()), np.array(n), term_rows, tf_rows
                ids, n, term_rows, tf_rows, postings = [], [], [], [], 0
    if ids:
        yield pa.array(ids, pa.int64()), np.array(n), term_rows, tf_rows


def _search_block(index: DataFrame, items: list[np.ndarray], vocabulary: int, best: int, cells: int, shard_docs: int) -> DataFrame:
    """number (of the item), doc_id, score: the best of every shard."""
    n_docs, all_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the block at most
    weights = np.zeros(vocabulary, np.int64)
    for r in counted:
        weights[r[0]] = term_weight(n_docs, r[1])
    shared = index.sparkSession.sparkContext.broadcast((items, weights, n_docs, all_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, all_terms = shared.value
        for part in _shards(batches, shard_docs):
            shard = Shard(*part, weights, n_docs, all_terms)
            for group in _locksteps(items, cells) if len(shard.doc) else ():
                item, doc, score = shard.search([items[i] for i in group], best)
                number = np.array(group, np.int32)[item] if len(item) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(number), shard.ids.take(pa.array(doc)), pa.array(score)], names=["number", "doc_id", "score"])

    return index.mapInArrow(run, "number int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", cells: int = CELLS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the documents of highest score of each item."""
    spark = docs.sparkSession
    asked = materialise(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null"), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kind = dict(asked.dtypes)["item_id"]
    found = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()  # some BLOCK_BYTES of text
        cut = [sorted(set(terms(r["text"].encode()))) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted({t for own in cut for t in own}))}
        if not vocabulary:
            continue
        numbers = [np.array([vocabulary[t] for t in own], np.int64) for own in cut]
        index = materialise(forward_index(docs, vocabulary, id_col, text_col), "forward-index")
        best_of_shards = _search_block(index, numbers, len(vocabulary), best, cells, shard_docs)
        rank = F.row_number().over(Window.partitionBy("number", "slice").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best_of_slices = best_of_shards.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES))).withColumn("rank", rank).where(F.col("rank") <= best)
        rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = best_of_slices.select("number", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= best)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"number int, item_id {kind}")
        made = materialise(ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"), "ranked")
        drop_written(index)
        found = made if found is None else found.unionByName(made)
    drop_written(asked)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


ORACLE_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT row, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
z AS (SELECT count(*) AS nd, sum(n) AS l FROM d),
i AS (SELECT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark)),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY term),
s AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term), z GROUP BY item, item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
