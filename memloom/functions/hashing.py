"""Stable hashes, worked out an Arrow batch at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Start, and the prime 2 ** 40 + 435 of the multiplicative hash.
START = 1469598103934665603
PRIME_LOW = 435
PRIME = np.uint64((1 << 40) + PRIME_LOW)


def fnv_many(texts: list[str | None]) -> np.ndarray:
    """The 64-bit xor-and-multiply hash of the UTF-8 bytes of each text, byte place by byte place over all texts at once."""
    data = [(t or "").encode() for t in texts]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-lens, kind="stable")
    out = np.full(len(data), START, np.uint64)
    at = 0
    while at < len(data) and lens[order[at]]:
        # Texts of falling length, as many as fill a bounded matrix; those long enough for a place come first.
        longest = int(lens[order[at]])
        part = order[at : at + max(1, (1 << 20) // longest)]
        width, own = int(longest), lens[part]
        cells = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        live = np.searchsorted(-own, -np.arange(width), "left")
        h = out[part]
        for j in range(width):
            n = live[j]
            h[:n] = (h[:n] ^ cells[:n, j]) * PRIME
        out[part] = h
        at += len(part)
    return out


def fnv_joined(words: list[str], first: np.ndarray, second: np.ndarray, joint: bytes = b"__") -> np.ndarray:
    """The hash of words[first] + joint + words[second] for pairs of word numbers: that of the first word goes on over the rest, words of one length at a time."""
    out = fnv_many(words)[first]
    for byte in joint:
        out = (out ^ np.uint64(byte)) * PRIME
    data = [w.encode() for w in words]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    of = lens[second]
    order = np.argsort(of, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        length = of[own[0]] if len(own) else 0
        if length:
            ids = np.flatnonzero(lens == length)
            cells = np.frombuffer(b"".join(data[i] for i in ids), np.uint8).reshape(-1, length)[np.searchsorted(ids, second[own])]
            h = out[own]
            for j in range(length):
                h = (h ^ cells[:, j]) * PRIME
            out[own] = h
    return out


def _fnv(texts: pd.Series) -> pd.Series:
    return pd.Series(fnv_many(texts.tolist()).view(np.int64))


def fnv(text: Column, modulo: int) -> Column:
    """The same as a column, mod `modulo`: an Arrow batch at a time, since Spark's expressions would fold it byte by byte uncompiled."""
    return _unsigned(F.pandas_udf(_fnv, LongType())(text), modulo)


def _unsigned(signed: Column, modulo: int) -> Column:
    """A 64-bit number, read as unsigned, mod `modulo`."""
    return F.when(signed >= 0, signed % modulo).otherwise((F.pmod(signed, F.lit(modulo)) + (1 << 64) % modulo) % modulo)


def fnv_sql(text: str, modulo: int) -> str:
    """The same in DuckDB's SQL, for ASCII text."""
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ord(c)::HUGEINT)"
    low = "(a::HUGEINT % 18446744073709551616)"
    return f"(list_reduce(list_concat([{START}::HUGEINT], {codes}), lambda a, b: (xor({low}, b) * 1099511628211) % 18446744073709551616) % {modulo})::BIGINT"


def _blake(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True))


def blake(text: Column, modulo: int) -> Column:
    """BLAKE2b of 8 bytes, little-endian, mod `modulo`; Spark has no built-in for it."""
    return _unsigned(F.pandas_udf(_blake, LongType())(text), modulo)
