"""What several operators of this package share: reading tables, a shared workspace, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = "\x20\x09-\x0d"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the session names none (tests on one machine) is one chosen here,
    under the warehouse, which Spark shares by contract.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark)
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[0].split(":")[-1].lstrip("/") != root.split(":")[-1].lstrip("/"):
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that are broadcast as hot at most.
HOT_KEYS = 50_000


def hot_first(rows: DataFrame, state: DataFrame, key: str, size: str, least: int = 1000) -> DataFrame:
    """rows joined with state(key, size, ...), where size is the number of rows that a key has.

    A key with more than a 50,000th of all rows, and `least` more, is hot. There are
    fewer than 50,000 of them, whatever the table's size, so they are broadcast to their
    rows, which stay where they are; the other rows are shuffled by key.
    """
    total = state.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > total // HOT_KEYS + least
    busy, calm = state.where(hot), state.where(~hot)
    there = F.broadcast(busy.select(key, F.lit(True).alias("_hot")))
    away = rows.join(there, key, "left").where("_hot is null").drop("_hot")
    return rows.join(F.broadcast(busy), key).unionByName(away.join(calm, key))


def runs(column: pa.Array, rows: int, size: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of an Arrow column, bounded in rows and bytes; a longer text is a run of its own, null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))), len(column))
        yield at, [t or "" for t in column.slice(at, stop - at).to_pylist()]
        at = stop


def hot_keys(counts: DataFrame, total: int, least: int = 512) -> DataFrame:
    """(key, shards) of counts(key, n) for keys with more rows than a shard takes, a 50,000th of all or `least`.

    By its rule it has fewer than HOT_KEYS rows at every size, so it may be broadcast.
    """
    shard = max(least, total // HOT_KEYS + 1)
    return counts.where(F.col("n") > shard).select("key", F.ceil(F.col("n") / shard).cast("int").alias("shards"))


def unused(columns: list[str], *names: str) -> list[str]:
    """names, prolonged until none is a column; case doesn't part columns."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as an empty text (0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def let(value: Column, body) -> Column:
    """Bind an expression once and use it several times in body, without a projection of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)
