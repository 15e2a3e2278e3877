"""Stored features of texts: a catalogue table keyed by content, to which only new contents are added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut


class FeatureStore:
    """Two tables: hashed features (key, raw_bytes, b, tf) and document frequencies (bucket, df) of each batch.

    Texts that are equal are one content. A batch has a name and its partitions are
    overwritten, so a failed one is repeated under the same name; contents that other
    batches hold are left out by an anti-join before anything is worked out. Frequencies
    of a batch are counted once and merged by a sum.
    """

    def __init__(self, spark: SparkSession, name: str, make: Callable[[DataFrame], DataFrame]):
        """make: (key, text) to (key, b array<int>, tf array<int>)."""
        self.spark, self.make = spark, make
        self.texts, self.frequencies = f"{name}_texts", f"{name}_frequencies"

    @staticmethod
    def key(text: str = "text") -> Column:
        return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)

    def open(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.texts} (key STRING, raw_bytes BIGINT, b ARRAY<INT>, tf ARRAY<INT>, batch STRING) USING parquet PARTITIONED BY (batch)")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.frequencies} (bucket INT, df BIGINT, batch STRING) USING parquet PARTITIONED BY (batch)")

    def drop(self) -> None:
        for table in (self.texts, self.frequencies):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def add(self, texts: DataFrame, batch: str) -> int:
        """Store the contents of texts(text) that no other batch holds; how many there were."""
        self.open()
        held = self.spark.table(self.texts).where(F.col("batch") != batch).select("key")
        fresh = texts.select(self.key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(held, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
        fresh = cut(fresh)
        made = cut(self.make(fresh).join(fresh.select("key", F.octet_length("text").cast("long").alias("raw_bytes")), "key").select("key", "raw_bytes", "b", "tf"))
        counted = made.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
        for rows, table in ((made, self.texts), (counted, self.frequencies)):
            self._overwrite(rows, table, batch)
        return made.count()

    def _overwrite(self, rows: DataFrame, table: str, batch: str) -> None:
        # The one partition is replaced, whatever it held.
        self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = :batch) SELECT * FROM {{rows}}", args={"batch": batch}, rows=rows)

    def idf(self) -> DataFrame:
        """(bucket, df, n_texts, idf) over all batches."""
        n = self.spark.table(self.texts).agg(F.count(F.lit(1)).alias("n_texts"))
        df = self.spark.table(self.frequencies).groupBy("bucket").agg(F.sum("df").alias("df"))
        # n is one row.
        return df.join(F.broadcast(n)).select("bucket", "df", "n_texts", (F.log((1.0 + F.col("n_texts")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))

    def features(self, texts: DataFrame, id_col: str) -> DataFrame:
        """(id, raw_bytes, b, tf) of texts whose content is stored."""
        own = self.spark.table(self.texts).select("key", "raw_bytes", "b", "tf")
        return texts.select(id_col, self.key().alias("key")).join(own, "key").drop("key")
