"""Mixing sources to target weights by systematic sampling, in built-in functions only.

Each source gets a target number of words; target / size is the expected number of
copies of each of its documents. The expected copies are prefix-summed along the
source, shifted by one random offset, and a document is emitted once for each
integer boundary that its interval crosses. Documents lie in order of size, then by
a hash of their id, so the words taken follow the target as closely as the copies.

No window holds a whole source: its rows are ranked by counts of (source, size),
then of (source, size, slice of the hash), then inside a slice, 4,096 slices each.

Defined results: a null text has size 0, an empty source target 0; a null source is
a source and comes last; repeated rows take part as rows of their own; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialise

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix"


def size_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each source: source, source_size, target.

    Targets share the sum of all sizes by weight and stop at cap times the source's
    size. Sources are taken in order of cap / weight; the first k whose share of what
    the others leave exceeds their cap are held at it. All but the last division is
    in whole numbers. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1))
    every = Window.partitionBy()
    in_order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    onward = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        (cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("held"),
        F.sum("weight").over(onward).alias("weights_left"),
    )
    capped = (F.col("total") - F.col("held")) * F.col("weight") >= cap * F.col("source_size") * F.col("weights_left")
    per = per.withColumn("capped", capped)
    free = F.when(~F.col("capped"), F.struct((F.col("total") - F.col("held")).alias("words"), F.col("weights_left").alias("weights")))
    per = per.withColumn("rest", F.max_by(free, F.when(~F.col("capped"), F.col("weights_left"))).over(every))
    share = (F.col("rest.words") * F.col("weight")).cast("double") / F.col("rest.weights")
    return per.select("source", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    carry names further columns to pass through beside the sizes.
    """
    sized = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("h"), *carry),
        "sizes",
    )
    targets = source_targets(sized, weights, cap)
    # A null source is matched as the flag and the empty text, so that both joins are plain equi-joins.
    key = lambda df: df.withColumns({"src": F.coalesce("source", F.lit("")), "no_src": F.col("source").isNull()})
    sized = key(sized).withColumn("slice", F.substring("h", 1, 3))
    slices = sized.groupBy("src", "no_src", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    by_slice = Window.partitionBy("src", "no_src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    of_size = slices.groupBy("src", "no_src", "size").agg(F.sum("n").alias("n"))
    by_size = Window.partitionBy("src", "no_src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.select("src", "no_src", "size", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("below"))
    slices = slices.withColumn("within", F.coalesce(F.sum("n").over(by_slice), F.lit(0)))
    start = slices.join(of_size, ["src", "no_src", "size"]).select("src", "no_src", "size", "slice", (F.col("below") + F.col("within")).alias("start"))
    keyed = key(targets).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "no_src", "src").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    start = start.join(keyed, ["src", "no_src"]).withColumn("offset", offset)
    rank = Window.partitionBy("src", "no_src", "size", "slice").orderBy("h", "doc_id")
    ranked = sized.withColumn("i", F.row_number().over(rank)).join(start, ["src", "no_src", "size", "slice"])
    place = F.col("start") + F.col("i")
    # target / source_size copies are expected of each document; place * that is the prefix sum.
    edge = lambda p: F.floor(F.col("offset") + p * F.col("target") / F.col("source_size"))
    copies = F.when(F.col("source_size") > 0, edge(place) - edge(place - 1)).otherwise(0)
    copies = F.least(copies, F.lit(cap)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix/' || doc_id::VARCHAR) AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, ([1, 2, 3])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
q AS (SELECT *, sum(source_size) OVER () AS total,
        3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM p),
s AS (SELECT *, (total - held) * weight >= 3 * source_size * weights_left AS capped FROM q),
t AS (SELECT source, source_size, weight, capped, max(CASE WHEN NOT capped THEN weights_left END) OVER () AS wl, min(CASE WHEN NOT capped THEN total - held END) OVER () AS lo, max(CASE WHEN NOT capped THEN total - held END) OVER () AS words FROM s),
g AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (words * weight)::DOUBLE / wl END AS target,
        ('0x' || substr(md5('mix/' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || '/' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM t),
r AS (SELECT doc_id, size, h, d.source, row_number() OVER (PARTITION BY d.source ORDER BY size, h, doc_id) AS i FROM d)
SELECT doc_id, r.source, size, g.source_size, g.target,
  (CASE WHEN g.source_size > 0 THEN least(3, floor(u + i * target / g.source_size) - floor(u + (i - 1) * target / g.source_size)) ELSE 0 END)::BIGINT AS copies,
  (CASE WHEN g.source_size > 0 THEN least(3, floor(u + i * target / g.source_size) - floor(u + (i - 1) * target / g.source_size)) ELSE 0 END)::BIGINT * size AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
"""
