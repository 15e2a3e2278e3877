"""Token counts, with overlap resynchronisation of huge documents.

A text longer than a chunk is encoded as overlapping chunks with offsets. Two
neighbours are spliced at a stable place of their overlap: one that is a token
boundary in both encodings and where a character that isn't white space stands
before an ASCII space. No match of the byte-level split pattern crosses such a place
and what it sees ahead of its last match ends there, so the tokens before it depend
only on the text before it and the tokens after it only on the text after it. When an
overlap has no such place, or the encodings disagree about it, the overlap is
widened, up to the whole rest of the text; the result is then the plain encoding's.

A text is cut at its own stable places too: each distinct segment goes to the library
once for each run of texts, and a memo that is bounded in bytes keeps its count; a
worker hands it on from task to task.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; every row
gives one row; special strings inside a text are what the library's default makes
of them. Tokenizers other than byte-level ones without a normalizer are given whole
texts, since the proof doesn't hold for them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs

LIMIT = 1024
#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Bytes that the memo of a worker holds at most, and bytes of texts counted together.
MEMO, TOGETHER = 56 << 20, 2 << 20
#: What an entry of the memo takes beside its text: a place in the table and a number.
ENTRY = 120
#: Before the space stands nothing that any engine takes for white space.
STABLE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?= )")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.library, self.chunk, self.overlap, self.memo = Tokenizer.from_file(path), chunk, overlap, memo
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        plain = said.get("normalizer") is None and said.get("truncation") is None and said.get("padding") is None
        pre = said.get("pre_tokenizer") or {}
        spaced = any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in said.get("added_tokens", []))
        self.provable = plain and not spaced and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.counts: dict[str, int] = {}
        self.held = 0
        self.widened = 0

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text; new segments of the batch go to the library together."""
        if not self.provable:
            return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = [[t] if len(t) > self.chunk else self._segments(t) for t in texts]
        known = self.counts
        fresh = list({s for parts, t in zip(cut, texts, strict=True) if len(t) <= self.chunk for s in parts if s not in known})
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            known.update(zip(part, (len(e.ids) for e in self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        found = [sum(map(known.__getitem__, parts)) if len(t) <= self.chunk else self.long(t) for parts, t in zip(cut, texts, strict=True)]
        self.held += sum(map(sys.getsizeof, fresh)) + ENTRY * len(fresh)
        if self.held > self.memo:
            self.forget()
        return found

    def forget(self) -> None:
        self.counts.clear()
        self.held = 0

    @staticmethod
    def _segments(text: str) -> list[str]:
        return STABLE.split(text)

    def long(self, text: str) -> int:
        """Splice chunk after chunk; start is a stable place, everything before it is counted."""
        total, start = 0, 0
        while True:
            stop = min(len(text), start + self.chunk)
            if stop == len(text):
                return total + self.whole(text[start:])
            overlap = self.overlap
            while True:
                end = min(len(text), stop + overlap)
                ours = self._bounds(text, start, end)
                theirs = self._bounds(text, stop, min(len(text), stop + overlap + self.overlap))
                # Away from either end of the overlap: a place near one may be an artefact of the cut.
                places = [m.start() for m in STABLE.finditer(text, stop + 1, end) if m.start() in ours and m.start() in theirs]
                if places:
                    at = places[len(places) // 2]
                    total += ours[at]
                    start = at
                    break
                self.widened += 1
                if end == len(text):
                    return total + self.whole(text[start:])
                overlap *= 4

    def _bounds(self, text: str, start: int, end: int) -> dict[int, int]:
        """Token boundary -> tokens before it, of the chunk [start, end)."""
        found = {start: 0}
        for n, (a, b) in enumerate(self.library.encode(text[start:end], add_special_tokens=False).offsets):
            found.setdefault(start + a, n)
            found[start + b] = n + 1
        return found


_COUNTERS: dict[tuple, Counter] = {}


def counter(path: str | None, chunk: int, overlap: int) -> Counter:
    """This worker's counter, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    key = (path, chunk, overlap)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, chunk, overlap)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path: default byte_bpe_50k.json of the public tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, chunk, overlap)
        for batch in batches:
            for at, texts in runs(batch.column(1), 512, TOGETHER):
                part = batch.slice(at, len(texts))
                found = own.count_batch(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
