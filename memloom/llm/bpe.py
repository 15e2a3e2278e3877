"""Byte-level BPE with a rank queue under a hierarchical bitmap.

Merging one pre-token: its symbols form a doubly linked list; every adjacent pair
whose join is in the vocabulary is filed in the bucket of the join's rank. A bitmap
of two levels (words of 256 bits, and a bit for each word in use) marks the buckets;
find-first-set on either level gives the next rank. Of a bucket the leftmost position comes first. An
entry is stale when its position was merged away or its pair has changed, and is
skipped. A pre-token of n bytes takes O(n log n) steps, so text without any break
costs no more for each byte than prose.

Short pre-tokens that a batch of texts holds for the first time are merged together:
they lie in one linked list, parted by sentinels, and one queue serves them all. Of a
bucket every pre-token gives its leftmost position, so each sees the same merges in the
same order as alone, and the arrays of a bucket are handled by numpy at once.

Texts are cut where a character that isn't white space is followed by a space: no
match of a pattern in CUT_AT_SPACES crosses such a place. With any other pattern whole
texts are split. Segments, and pre-tokens inside them, are encoded once and remembered
as packed ids; the memos are bounded in bytes, emptied after each task, even a failed
one, and never change results. Texts are taken in groups of bounded bytes, so a task
holds one group's ids beside its Arrow batch.

Defined results: a null text counts as empty and has no tokens; every row gives one
row; a vocabulary without a token for each byte is refused; nothing is shuffled, so
the size of a source or of a group of copies is no matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs

#: Bytes that the memos of a worker hold at most, in all, beside what one run of texts adds.
MEMO = 64 << 20
#: Bytes of a pre-token that is merged together with others, and of all that share one queue.
SHORT, QUEUE = 64, 1 << 20
#: Texts whose new pre-tokens are merged together, by number and by bytes: a step of the queue costs about the same for few as for many.
TOGETHER, BYTES = 4096, 4 << 20
#: Split patterns of which no match crosses a place between a character that isn't white space and a space.
CUT_AT_SPACES = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)


def default_vocabulary() -> tuple[str, str]:
    """(path of the rank file, split pattern) on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class _Memo(dict):
    """key -> make(key). When full it becomes the older half, of which only what is asked for again is kept.

    It is only cut back by trim(), between runs of texts, so that a run finds all that
    was encoded for it in advance.
    """

    #: Bytes of an entry beside four for a character of its key and its packed ids: two objects, and slots of a dict that is a third to two thirds full.
    ENTRY = 192

    def __init__(self, make, most: int):
        self.make, self.most, self.old, self.held = make, most // 2, {}, 0

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        self.put(key, made)
        return made

    def put(self, key, made) -> None:
        self[key] = made
        self.held += self.ENTRY if isinstance(made, int) else self.ENTRY + 4 * len(key) + len(made)

    def fill(self, keys: list[str], made: list[bytes]) -> None:
        """put() of many."""
        self.update(zip(keys, made, strict=True))
        self.held += self.ENTRY * len(keys) + 4 * sum(map(len, keys)) + sum(map(len, made))

    def trim(self) -> None:
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


def _packed(ids) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Codec:
    HASH = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no token for the bytes {missing}")
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.digits = [str(i) for i in range(len(self.vocabulary))]
        self.packed = [_packed([i]) for i in range(len(self.vocabulary))]
        self.bytes = [self.ranks[bytes([i])] for i in range(256)]
        self.byte_ids = np.array(self.bytes, np.int64)
        # The greatest number in a pair is the sentinel, one above the last id.
        self.bits = len(self.vocabulary).bit_length()
        self._make_table()
        self.find = regex.compile(pattern).findall
        self.cuts = pattern in CUT_AT_SPACES
        self.odd_space = regex.compile(r"[\s\x1c-\x1f] ").search
        vocabulary, rank_of = self.vocabulary, self.ranks.get
        self.pairs = _Memo(lambda k: rank_of(vocabulary[k >> 32] + vocabulary[k & 0xFFFFFFFF], -1), memo // 4)
        self.pretokens = _Memo(self._pretoken, memo // 4)
        self.after_space = _Memo(lambda s: self._segment(" " + s), memo // 2)

    def _segment(self, text: str) -> bytes:
        found = self.find(text)
        if len(found) == 1:  # remembered as a segment
            return self._pretoken(found[0])
        return self._joined(found)

    def _joined(self, found: list[str]) -> bytes:
        """The ids of a segment's pre-tokens; one that is a segment as well is remembered as that only."""
        known, parts = self.after_space, self.pretokens
        return b"".join([known[p[1:]] if self._spaced(p) else parts[p] for p in found])

    @staticmethod
    def _spaced(pretoken: str) -> bool:
        """Whether it's a space and letters, digits or signs: a match by itself, whatever follows it."""
        return pretoken[0] == " " and len(pretoken) > 1 and not pretoken[1].isspace()

    def _pretoken(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.get(data)
        return self.packed[whole] if whole is not None else _packed(self.merge(data))

    def _whole(self, text: str) -> bool:
        """Whether a text is split as a whole."""
        return not self.cuts or self.odd_space(text) is not None

    def merge_many(self, items: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many pre-tokens under one queue."""
        ids, ends = self._merged(items)
        ids = ids.tolist()
        return [tuple(ids[x:y]) for x, y in zip([0, *ends], ends)]

    def _merged(self, items: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of all pre-tokens in a row, and where each one's end."""
        if not items:
            return np.empty(0, np.int32), []
        end = len(self.vocabulary)  # the sentinel after each pre-token
        lens = np.fromiter(map(len, items), np.int64, len(items))
        owner = np.repeat(np.arange(len(items)), lens + 1)
        stops = np.cumsum(lens + 1) - 1
        sym = np.full(len(owner), end, np.int64)
        inner = np.ones(len(owner), bool)
        inner[stops] = False
        sym[inner] = self.byte_ids[np.frombuffer(b"".join(items), np.uint8)]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        rank = np.full(len(sym), -1, np.int64)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        buckets: dict[int, list[np.ndarray]] = {}
        words: dict[int, int] = {}
        top = 0

        def file(ranks: np.ndarray, places: np.ndarray) -> int:
            """Put places into the buckets of their ranks; the words of the upper bitmap that are now in use."""
            order = ranks.argsort(kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cut.tolist(), len(ranks)]
            used = 0
            for r, x, y in zip(ranks[np.concatenate(([0], cut))].tolist(), bounds, bounds[1:]):
                if r in buckets:
                    buckets[r].append(places[x:y])
                else:
                    buckets[r] = [places[x:y]]
                    w = r >> 8
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    used |= 1 << w
            return used

        valid = np.flatnonzero(rank >= 0)
        if len(valid):
            top = file(rank[valid], valid)
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            r = w << 8 | (bits & -bits).bit_length() - 1
            words[w] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            found = buckets.pop(r)
            i = found[0] if len(found) == 1 else np.concatenate(found)
            i = i[rank[i] == r]  # the others are stale
            if len(i) > 1:
                i = np.sort(i)
                own = owner[i]
                again = own[1:] == own[:-1]
                if again.any():
                    later = np.concatenate(([False], again))
                    top |= file(np.full(int(later.sum()), r), i[later])
                    i = i[~later]
                    # A place may be filed twice.
                    i = i[np.concatenate(([True], i[1:] != i[:-1]))]
            elif not len(i):
                continue
            j = after[i]
            k = after[j]
            sym[i], sym[j], rank[j], after[i] = r, -1, -1, k
            before[k] = i
            h = before[i]
            places = np.concatenate((i, h))
            fresh = self._ranks(sym[places], sym[np.concatenate((k, i))])
            rank[places] = fresh
            ok = fresh >= 0
            if ok.any():
                top |= file(fresh[ok], places[ok])
        alive = (sym >= 0) & (sym != end)
        return sym[alive].astype(np.int32), np.cumsum(np.bincount(owner[alive], minlength=len(items))).tolist()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joins of pairs, -1 where the vocabulary has none."""
        code = left << self.bits | right
        slot = self._slots(code)
        out = np.where(self.table_code[slot] == code, self.table_rank[slot], -1)
        more = np.flatnonzero((self.table_code[slot] != code) & (self.table_code[slot] >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.table_code) - 1)
            seen = self.table_code[slot[more]]
            hit = seen == code[more]
            out[more[hit]] = self.table_rank[slot[more[hit]]]
            more = more[~hit & (seen >= 0)]
        return out

    def _slots(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * self.HASH) >> self.drop).astype(np.int64)

    def _make_table(self) -> None:
        """An open-addressed table of all pairs of tokens whose join is a token, a quarter full at most."""
        rank_of = self.ranks.get
        pairs = [(a << self.bits | b, r) for token, r in self.ranks.items() for n in range(1, len(token)) if (a := rank_of(token[:n])) is not None and (b := rank_of(token[n:])) is not None]
        code, rank = map(np.ascontiguousarray, np.array(pairs, np.int64).reshape(-1, 2).T)
        size = max(10, (4 * len(code)).bit_length())
        self.drop = np.uint64(64 - size)
        self.table_code, self.table_rank = np.full(1 << size, -1, np.int64), np.full(1 << size, -1, np.int32)
        slot = self._slots(code)
        while len(code):
            free = self.table_code[slot] < 0
            _, first = np.unique(slot, return_index=True)
            takes = np.zeros(len(code), bool)
            takes[first] = True
            takes &= free
            self.table_code[slot[takes]], self.table_rank[slot[takes]] = code[takes], rank[takes]
            code, rank, slot = code[~takes], rank[~takes], (slot[~takes] + 1) & (len(self.table_code) - 1)

    def prime(self, texts: list[str]) -> None:
        """Encode what the texts hold for the first time, all short pre-tokens at once."""
        for memo in (self.pairs, self.pretokens, self.after_space):
            memo.trim()
        known, parts, find = self.after_space, self.pretokens, self.find
        segments: set[str] = set()
        pretokens: set[str] = set()
        for text in texts:
            if self._whole(text):
                pretokens.update(find(text))
            else:
                first, *rest = text.split(" ")
                segments.update(rest)
                pretokens.update(find(first))
        alone: set[str] = set()  # segments of one pre-token
        several: dict[str, list[str]] = {}
        for x in segments:
            if x not in known and x not in known.old:
                found = find(" " + x)
                if len(found) == 1:
                    alone.add(x)
                else:
                    several[x] = found
        for p in set(chain.from_iterable(several.values())):
            if not self._spaced(p):
                pretokens.add(p)
            elif (x := p[1:]) not in known and x not in known.old:
                alone.add(x)
        more = [x for x in pretokens if x not in parts and x not in parts.old]
        self._learn(chain(((known, x, (" " + x).encode()) for x in alone), ((parts, x, x.encode()) for x in more)))
        known.fill(list(several), list(map(self._joined, several.values())))

    def _learn(self, asked: Iterable[tuple[_Memo, str, bytes]]) -> None:
        """Remember pre-tokens: (where, under which key, its bytes). The short ones are merged together."""
        rank_of, packed = self.ranks.get, self.packed
        names: list[tuple[_Memo, str]] = []
        queue: list[bytes] = []
        waiting = 0
        for memo, key, data in asked:
            whole = rank_of(data)
            if whole is not None:
                memo.put(key, packed[whole])
            elif len(data) > SHORT:
                memo.put(key, _packed(self.merge(data)))
            else:
                names.append((memo, key))
                queue.append(data)
                waiting += len(data)
                if waiting > QUEUE:
                    self._serve(names, queue)
                    names, queue, waiting = [], [], 0
        self._serve(names, queue)

    def _serve(self, names: list[tuple[_Memo, str]], queue: list[bytes]) -> None:
        ids, ends = self._merged(queue)
        whole, at = ids.tobytes(), 0
        for (memo, key), end in zip(names, ends, strict=True):
            memo.put(key, whole[4 * at : 4 * end])
            at = end

    def merge(self, data: bytes) -> list[int]:
        n, pairs = len(data), self.pairs
        sym = [self.bytes[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            rank = pairs[sym[i] << 32 | sym[i + 1]]
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    w = rank >> 8
                    words[w] = words.get(w, 0) | 1 << (rank & 255)
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            rank = w << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            j = after[i]
            if sym[i] < 0 or j >= n or pairs[sym[i] << 32 | sym[j]] != rank:
                continue
            sym[i], sym[j] = rank, -1
            k = after[i] = after[j]
            fresh = []
            if k < n:
                before[k] = i
                fresh.append((i, pairs[rank << 32 | sym[k]]))
            p = before[i]
            if p >= 0:
                fresh.append((p, pairs[sym[p] << 32 | rank]))
            for at, r in fresh:
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        w = r >> 8
                        words[w] = words.get(w, 0) | 1 << (r & 255)
                        top |= 1 << w
        return [s for s in sym if s >= 0]

    def encode(self, text: str) -> list[int]:
        return self.ids_of(text).tolist()

    def ids_of(self, text: str) -> np.ndarray:
        if self._whole(text):
            return np.frombuffer(b"".join(map(self.pretokens.__getitem__, self.find(text))), np.int32)
        first, *rest = text.split(" ")
        return np.frombuffer(b"".join(chain((self._segment(first),), map(self.after_space.__getitem__, rest))), np.int32)

    def forget(self) -> None:
        """Empty the memos: the worker may serve other stages next."""
        for memo in (self.pairs, self.pretokens, self.after_space):
            memo.forget()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """This worker's codec, kept from task to task."""
    default = default_vocabulary() if path is None or pattern is None else (None, None)
    key = (path or default[0], pattern or default[1])
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            for batch in batches:
                for at, texts in runs(batch.column(1), TOGETHER, BYTES):
                    own.prime(texts)
                    ids = [own.ids_of(t) for t in texts]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), _lists(ids)], schema=schema)
        finally:
            own.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) of rows with doc_id and token_ids; null ids decode to nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [own.decode(x.as_py() or ()) for x in part.column(1)]  # one text's ids at a time
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, decoded binary")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def round_trip(docs: DataFrame, with_ids: bool = True, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row and decode its ids in the same task.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, matches (the decoded bytes
    are the text's) and, with_ids, token_ids.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("matches", pa.bool_())]
    schema = pa.schema(fields + ([("token_ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            for batch in batches:
                for at, texts in runs(batch.column(1), TOGETHER, BYTES):
                    own.prime(texts)
                    counts, shas, decoded, same, kept = [], [], [], [], []
                    for text in texts:
                        packed = own.ids_of(text)
                        ids = packed.tolist()
                        data = own.decode(ids)
                        counts.append(len(ids))
                        shas.append(hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                        decoded.append(hashlib.sha256(data).hexdigest())
                        same.append(data == text.encode())
                        if with_ids:
                            kept.append(packed)
                    cols = [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded), pa.array(same)]
                    yield pa.RecordBatch.from_arrays(cols + ([_lists(kept)] if with_ids else []), schema=schema)
        finally:
            own.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, matches boolean"
    return rows.mapInArrow(run, ddl + (", token_ids array<int>" if with_ids else ""))
