"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after lower-casing A-Z only. A batch is hashed once;
equal texts inside it meet in a partial-then-final aggregate of (digest, largest id,
count), so a text that fills a third of the batch costs one row for each task. The
distinct digests are sort-merge anti-joined to the index table, whose buckets spare
its side the exchange, and the new ones are appended as a partition of the table.

A batch has a name, and its partition is overwritten: a run that failed after its
append is repeated under the same name with the same result. Digests of a batch never
count as known to itself. Every batch adds a file to each bucket, so beside the saved
exchange a bucket is still sorted when it is read; compact() rewrites it as one file.

A table larger than one batch can be fed as several, by falling ids, so that later
batches are deduplicated against the stored digests of earlier ones and of equal
texts the largest id stays.

Defined results: a null text counts as empty; null ids sort below all others; of
rows that tie on text and id one stays; an empty batch appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_written, hot_first, materialise


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest(text_col: str = "text") -> Column:
    return F.sha2(normalised(F.col(text_col)).cast("binary"), 256)


class DigestIndex:
    """A catalogue table (text_sha256, keep_id, batch) of the texts kept so far."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def temporary(cls, spark: SparkSession, label: str, buckets: int = 64) -> DigestIndex:
        """An index under a new name, for a caller that drops it."""
        return cls(spark, f"{label}_{uuid.uuid4().hex}", buckets)

    def create(self, id_type: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id {id_type}, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS"
        )

    def known(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_digests(self, groups: DataFrame, batch: str) -> DataFrame:
        """The rows of groups (one for each digest) whose text no other batch holds: a sort-merge anti-join."""
        known = self.known().where(F.col("batch") != batch).select("text_sha256")
        return groups.join(known.hint("merge"), "text_sha256", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the new digests of groups(text_sha256, keep_id), in place of what an earlier run of the batch left."""
        self.create(groups.schema["keep_id"].dataType.simpleString())
        # The table can't be read while one of its partitions is overwritten.
        fresh = materialise(self.new_digests(groups, batch).select("text_sha256", "keep_id"), "new-digests")
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        view = f"new_digests_{uuid.uuid4().hex}"
        fresh.repartition(self.buckets, "text_sha256").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{name}') SELECT text_sha256, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)
        drop_written(fresh)

    def compact(self, batch: str = "compacted") -> None:
        """Rewrite all batches as one, with one sorted file for each bucket.

        The old names are forgotten, so an earlier batch can't be repeated afterwards.
        """
        whole = materialise(self.known().groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id")), "compact")
        other = DigestIndex(self.spark, f"{self.name}_{uuid.uuid4().hex}", self.buckets)
        other.append(whole, batch)
        self.drop()
        self.spark.sql(f"ALTER TABLE {other.name} RENAME TO {self.name}")
        drop_written(whole)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None, parts: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    A text that the index holds from another batch is dropped in this one (keep_id is
    the id that stayed then); else the largest id of the batch stays. Give batch a name
    of its own to be able to repeat a failed run; without one a new name is drawn.
    With parts > 1 the batch goes into the index in that many parts by falling ids.
    The index isn't read after this function has returned.
    """
    batch = batch or uuid.uuid4().hex
    own = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(own, "digests")
    part = F.lit(0)
    if parts > 1:
        # Ids from the greatest quantile down; null ids sort below all others.
        limits = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts - 1, 0, -1)], 1000)).first()[0] or []
        for limit in limits:
            part = part + F.when(F.col("doc_id") > limit, 0).otherwise(1)
    groups = rows.groupBy(part.cast("int").alias("part"), "text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.select("part", "text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("row"), "n"), "digest-groups")
    for i in range(parts):
        index.append(groups.where(F.col("part") == i).select("text_sha256", "keep_id"), f"{batch}-{i}")
    first = groups.groupBy("text_sha256").agg(F.min_by("row", "part").alias("keep_row"), F.sum("n").alias("group_size"))
    stored = index.known().select("text_sha256", "keep_id", (~F.col("batch").isin([f"{batch}-{i}" for i in range(parts)])).alias("seen_before"))
    state = materialise(first.join(stored.hint("merge"), "text_sha256"), "digest-states")
    drop_written(groups)
    return hot_first(rows, state, "text_sha256", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (~F.col("seen_before") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "seen_before",
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, false AS seen_before FROM d JOIN g USING (text_sha256)
"""
