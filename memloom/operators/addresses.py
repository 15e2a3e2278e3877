"""Sparse address maps of sessions: feature items, gates, masses, similarity and the hybrid ranking.

Features are rows (session_id, step_idx, feature, weight). A feature is hashed to an
address, weighed by a gate that compares its prototype with a context vector of the
steps so far, and the strongest addresses of a step stay. All of it is joins and sums
on long tables; only the carry of addresses from step to step is a true recurrence and
streams each session in order through a small fold. Encoders that gate what they carry
are in `encoders`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import hashing
from ..functions import text as T
from ..functions.lineage import cut
from . import states as S

ADDRESSES, DIM, LANES = 4096, 256, 8
STILL = 1e-13  # less than this of a product of unit vectors is rounding
STEP = ["session_id", "step_idx"]


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(20.0)), F.lit(-20.0))))


# --- feature items ------------------------------------------------------------------------------------------------------
def edge_items(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Items of constraint edges: the state, every edge by type, and triggers with what they allow."""
    weight = S.step_weight()
    own = steps.select(*STEP, F.concat(F.lit("constraint_state::"), "current").alias("feature"), (2.8 * weight).alias("weight"))
    both = steps.select(*STEP, "current", F.explode(F.slice("triggers", 1, 3)).alias("trigger"), F.slice("preferred", 1, 2).alias("next"), (2.7 * weight).alias("weight"))
    combos = both.select(*STEP, F.explode("next").alias("x"), "trigger", "current", "weight").select(*STEP, F.concat(F.lit("trigger_allow::"), "trigger", F.lit("::"), "current", F.lit("=>"), "x").alias("feature"), "weight")
    return own.unionByName(edges.select(*STEP, _edge_feature("").alias("feature"), "weight")).unionByName(combos)


def _edge_feature(prefix: str) -> Column:
    c = lambda *parts: F.concat(*(F.lit(p) if p in ("=>", "-/->", "::") or p.endswith("::") else F.col(p) for p in parts))
    kind = F.col("edge_type")
    return (
        F.when(kind == "allow", c(f"{prefix}allow_edge::", "source_state", "=>", "target"))
        .when(kind == "block", c(f"{prefix}block_edge::", "source_state", "-/->", "target"))
        .when(kind == "require", c(f"{prefix}require_edge::", "source_state", "=>", "target"))
        .when(kind == "trigger", c(f"{prefix}trigger_edge::", "trigger", "::", "source_state"))
        .when(kind == "step", c(f"{prefix}constraint_step::", "source_state", "=>", "target"))
        .when(kind == "flow", c(f"{prefix}constraint_flow::", "source_state", "=>", "trigger", "=>", "target"))
        .otherwise(c(f"{prefix}constraint_conflict::", "source_state", "-/->", "trigger", "::", "target"))
    )


def edge_context(steps: DataFrame, edges: DataFrame, span: int = 8) -> DataFrame:
    """Context features of each step: those of the last `span` steps, later ones weighing more.

    Each step hands its features to the steps it is in the window of, at most `span`
    copies, so no window collects features.
    """
    last = F.max("step_idx").over(Window.partitionBy("session_id"))
    reach = steps.select(*STEP, "current", last.alias("last"))
    own = reach.select(*STEP, "last", F.concat(F.lit("ctx_constraint_state::"), "current").alias("feature"), F.lit(2.0).alias("weight"), F.lit(False).alias("linked"))
    linked = F.col("edge_type").isin("step", "flow", "conflict")
    said = edges.join(reach.select(*STEP, "last"), STEP).select(*STEP, "last", _edge_feature("ctx_").alias("feature"), "weight", linked.alias("linked"))
    rows = own.unionByName(said).withColumn("at", F.explode(F.sequence("step_idx", F.least(F.col("step_idx") + span - 1, F.col("last")))))
    start = F.greatest(F.col("at") - (span - 1), F.lit(0))
    place, length = F.col("step_idx") - start, F.least(F.col("at") + 1, F.lit(span))
    # The first step of a window has no step before it there.
    rows = rows.where(~F.col("linked") | (place > 0))
    recency = 1.0 + 0.45 * place / length
    return rows.groupBy("session_id", F.col("at").alias("step_idx"), "feature").agg(F.sum(F.col("weight") * recency).alias("weight"))


def grams(a: Column, n: int) -> Column:
    """Runs of n values, joined."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), "__"))).otherwise(T.empty())


def naive_items(chunks: DataFrame, idf: DataFrame | None = None, orders=(2, 3), heads: int = 4) -> DataFrame:
    """Tokens and n-grams of each chunk under several hash heads: root of the count times idf, shared among the heads."""
    k = T.tokens(F.col("chunk"))
    made = chunks.withColumn("k", k)
    tag = lambda a, n: F.transform(a, lambda x: F.struct(F.lit(n).alias("n"), x.alias("gram")))
    tagged = F.concat(*(tag(F.col("k") if n == 1 else grams(F.col("k"), n), n) for n in (1, *orders)))
    counts = made.select(*STEP, F.explode(tagged).alias("g")).select(*STEP, "g.n", "g.gram").groupBy(*STEP, "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    if idf is not None:
        counts = counts.join(idf, "gram", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    else:
        counts = counts.withColumn("idf", F.lit(1.0))
    factor = F.when(F.col("n") == 1, 1.0).otherwise(1.2 + 0.2 * F.col("n"))
    rows = counts.withColumn("head", F.explode(F.array(*map(F.lit, range(heads)))))
    return rows.select(*STEP, F.concat_ws("::", F.col("n").cast("string"), F.col("head").cast("string"), "gram").alias("feature"), (factor * F.sqrt("c") * F.col("idf") / heads).alias("weight"))


def gram_idf(chunks: DataFrame, orders=(2, 3)) -> DataFrame:
    """Smoothed idf of tokens and n-grams over sessions."""
    n = chunks.select("session_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    k = chunks.select("session_id", T.tokens(F.col("chunk")).alias("k"))
    every = F.concat("k", *(grams(F.col("k"), n) for n in orders))
    df = k.select("session_id", F.explode(every).alias("gram")).distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # total is one row.
    return df.join(F.broadcast(n)).select("gram", (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def canonical_tokens(states: DataFrame) -> DataFrame:
    """(session_id, step_idx, tokens): relation families, roles, schemas, acts and flags without their words."""
    def family(x: Column) -> Column:
        made = F.lit("context")
        for name, words in reversed(lex.FAMILIES):
            made = F.when(x.rlike("|".join(words)), name).otherwise(made)
        return made

    def role(x: Column) -> Column:
        head, tail = F.substring_index(x, "::", 1), F.substring_index(x, "::", -1)
        named = F.concat(head, F.lit("_"), F.when(tail == "", "generic").otherwise(tail))
        return F.when(head.isin("actor", "target", "modifier"), head).when(head == "action", F.concat(F.lit("action_"), family(tail))).when(head.isin("motive", "turn", "outcome"), named).otherwise(head)

    each = lambda c, n, prefix, body: F.transform(F.slice(F.col(c), 1, n), lambda x: F.concat(F.lit(prefix), body(x)))
    tail = lambda x: F.substring_index(x, "::", -1)
    prev = F.lag("semantic_keys").over(S.by_step())
    rows = states.withColumn("prev", prev)
    meaning = F.when(F.col("prev").isNull(), "semantic_init").when(F.arrays_overlap(F.slice("prev", 1, 3), F.slice("semantic_keys", 1, 3)), "semantic_persist").otherwise("semantic_shift")
    tokens = F.concat(each("relation_keys", 3, "relfam::", family), each("event_roles", 4, "rolecanon::", role), each("causal_schemas", 3, "schemacanon::", tail), each("narrative_acts", 3, "actcanon::", tail), each("flags", 3, "flagcanon::", F.lower), F.array(F.concat(F.lit("semstate::"), meaning)))
    return rows.select(*STEP, F.array_distinct(tokens).alias("tokens"))


# --- gates --------------------------------------------------------------------------------------------------------------
def prototypes(features: DataFrame, dim: int = DIM, lanes: int = LANES, addresses: int = ADDRESSES) -> DataFrame:
    """(feature, address, i, re, im) of each distinct feature: its address, and its unit prototype, a few signed phases at hashed places."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["feature", "address", "i", "re", "im"]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                texts = batch.column(0).slice(at, 4096).to_pylist()
                n = len(texts)
                per_lane = lambda name: hashing.fnv_many([f"{t}::{name}::{j}" for t in texts for j in range(lanes)]).reshape(n, lanes)  # noqa: E731, B023
                phase = hashing.fnv_many([f"phase::{t}" for t in texts]) % np.uint64(8192)
                place = (per_lane("lane") % np.uint64(dim)).astype(np.int64)
                sign = np.where(per_lane("sign") % np.uint64(2) == 0, -1.0, 1.0)
                z = sign * np.exp(1j * (2.0 * np.pi * phase.astype(float)[:, None] / 8192.0 + 2.0 * np.pi * np.arange(lanes)[None, :] / lanes))
                # Lanes of a feature that share a place add up.
                key, back = np.unique(np.arange(n)[:, None] * dim + place, return_inverse=True)
                back = back.reshape(-1)
                re, im = np.bincount(back, z.real.ravel(), len(key)), np.bincount(back, z.imag.ravel(), len(key))
                own = key // dim
                norm = np.sqrt(np.bincount(own, re * re + im * im, n))[own] + 1e-12
                address = (hashing.fnv_many(texts) % np.uint64(addresses)).astype(np.int64)
                cols = [pa.array(texts, pa.string()).take(pa.array(own)), pa.array(address[own]), pa.array(key % dim), pa.array(re / norm), pa.array(im / norm)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return features.select("feature").distinct().mapInArrow(run, "feature string, address long, i long, re double, im double")


def gated(items: DataFrame, context: DataFrame, addresses: int = ADDRESSES, top: int = 24) -> DataFrame:
    """(session_id, step_idx, address, weight, gate): gated address weights, the `top` strongest of each step."""
    merged = items.groupBy(*STEP, "feature").agg(F.sum("weight").alias("weight"))
    protos = cut(prototypes(items.select("feature").unionByName(context.select("feature")), addresses=addresses))
    ctx = context.join(protos, "feature").groupBy(*STEP, "i").agg(F.sum(F.col("weight") * F.col("re")).alias("a"), F.sum(F.col("weight") * F.col("im")).alias("b"))
    norm = F.sqrt(F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")).over(Window.partitionBy(*STEP))) + 1e-12
    ctx = ctx.withColumns({"a": F.col("a") / norm, "b": F.col("b") / norm})
    met = merged.join(protos, "feature").join(ctx, [*STEP, "i"], "left")
    a, b, re, im = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)), F.col("re"), F.col("im")
    # The first argument is conjugated.
    score = met.groupBy(*STEP, "feature", "address").agg(F.first("weight").alias("weight"), F.sum(a * re + b * im).alias("x"), F.sum(a * im - b * re).alias("y"))
    # Sums that cancel leave some 1e-17 in an order of their own; set against 1e-12 by the angle that would show in the ninth digit of a weight.
    still = F.greatest(F.abs("x"), F.abs("y")) < STILL
    x, y = (F.when(still, 0.0).otherwise(F.col(c)) for c in ("x", "y"))
    gate = sigmoid(3.2 * x + 1.4 * F.sqrt(x * x + y * y) + 0.6 * F.cos(F.atan2(y, x + 1e-12)))
    rows = score.withColumn("gate", gate)
    summed = rows.groupBy(*STEP, "address").agg(F.sum(F.col("weight") * F.col("gate")).alias("weight"), F.max("gate").alias("gate"))
    return strongest(summed, top)


def plain(items: DataFrame, addresses: int = ADDRESSES, top: int = 24) -> DataFrame:
    """The same without gates: every gate is 1."""
    rows = items.withColumn("address", hashing.fnv(F.col("feature"), addresses)).groupBy(*STEP, "address").agg(F.sum("weight").alias("weight"))
    return strongest(rows, top).withColumn("gate", F.lit(1.0))


def strongest(rows: DataFrame, top: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*STEP).orderBy(F.desc(F.round("weight", 9)), "address"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def _fnv(text: str, modulo: int) -> int:
    value = hashing.START
    for byte in text.encode():
        value = ((value ^ byte) * ((1 << 40) + hashing.PRIME_LOW)) & ((1 << 64) - 1)
    return value % modulo


def carried(rows: DataFrame, carry: str = "carry_constraint::{address}::{state}", most: int = 8, share: float = 0.75, top: int = 24) -> DataFrame:
    """Address weights with the strongest addresses of the step before fed back as features of this one.

    rows: session_id, step_idx, state, step_weight, addresses array<struct<address,weight>>
    (at most a few dozen). Each partition holds whole sessions in order and is folded as
    a stream: what is kept is one step's addresses, however long a session is.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, before = None, []
        for batch in batches:
            out = []
            for sid, step, state, weight, found in zip(batch.session_id, batch.step_idx, batch.state, batch.step_weight, batch.addresses, strict=True):
                if sid != session:
                    session, before = sid, []
                sums: dict[int, float] = {}
                for x in found:
                    sums[x["address"]] = sums.get(x["address"], 0.0) + x["weight"]
                for address in before[:most]:
                    at = _fnv(carry.format(address=address, state=state), ADDRESSES)
                    sums[at] = sums.get(at, 0.0) + share * weight
                ranked = sorted(sums.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top]
                before = [a for a, _ in ranked[:10]]
                out += [(sid, step, a, w) for a, w in ranked]
            yield pd.DataFrame(out, columns=["session_id", "step_idx", "address", "weight"])

    placed = rows.select("session_id", F.col("step_idx").cast("long").alias("step_idx"), "state", "step_weight", "addresses").repartition("session_id").sortWithinPartitions("session_id", "step_idx")
    return placed.mapInPandas(fold, "session_id string, step_idx long, address long, weight double")


def naive_context(chunks: DataFrame, idf: DataFrame, orders=(2, 3), last: int = 64) -> DataFrame:
    """(session_id, step_idx, context map<int,double>): a unit vector of the tokens and n-grams among the last 64 tokens up to each chunk.

    A gram meets the chunks that end within `last` tokens after its start by blocks of
    `last` tokens, so a long session isn't joined with itself.
    """
    k = chunks.select(*STEP, T.tokens(F.col("chunk")).alias("k")).where(F.size("k") > 0)
    ends = k.withColumn("end", F.sum(F.size("k")).over(S.by_step()))
    flat = ends.select("session_id", (F.col("end") - F.size("k")).alias("start"), F.posexplode("k").alias("i", "gram1")).select("session_id", (F.col("start") + F.col("i")).alias("pos"), "gram1")
    order = Window.partitionBy("session_id").orderBy("pos")
    run = lambda n: F.concat_ws("__", "gram1", *(F.lead("gram1", j).over(order) for j in range(1, n)))
    whole = lambda n: F.lead("gram1", n - 1).over(order).isNotNull()
    made = flat.withColumn("g", F.array(F.struct(F.lit(1).alias("n"), F.lit(1.0).alias("w"), F.col("gram1").alias("gram")), *(F.struct(F.lit(n).alias("n"), F.lit(1.25).alias("w"), F.when(whole(n), run(n)).alias("gram")) for n in orders)))
    grams_at = made.select("session_id", "pos", F.explode("g").alias("g")).select("session_id", "pos", "g.*").where("gram is not null")
    named = grams_at.select("gram").distinct().join(idf, "gram", "left").select("gram", F.coalesce("idf", F.lit(1.0)).alias("idf"), hashing.fnv(F.col("gram"), DIM).cast("int").alias("i"), F.when(hashing.fnv(F.concat(F.lit("sgn::"), "gram"), 2) == 0, -1.0).otherwise(1.0).alias("sign"))
    valued = grams_at.join(named, "gram").select("session_id", "pos", "n", "i", (F.col("w") * F.col("idf") * F.col("sign")).alias("x"))
    block = F.floor(F.col("pos") / last)
    given = valued.withColumn("block", F.explode(F.array(block, block + 1)))
    asked = ends.select(*STEP, "end", F.floor(F.col("end") / last).alias("block"))
    met = given.join(asked, ["session_id", "block"]).where((F.col("pos") + F.col("n") <= F.col("end")) & (F.col("end") <= F.col("pos") + last))
    summed = met.groupBy(*STEP, "i").agg(F.sum("x").alias("x"))
    whole_vector = summed.groupBy(*STEP).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("v"), (F.sqrt(F.sum(F.col("x") * F.col("x"))) + 1e-12).alias("norm"))  # DIM entries at most
    return whole_vector.select(*STEP, F.transform_values("v", lambda i, x: x / F.col("norm")).alias("context"))


def address_vectors(spark, lanes: int = 4) -> DataFrame:
    """(address, entries array<struct<i,v>>): the real unit vector of each of the fixed addresses."""
    text = F.col("id").cast("string")
    lane = F.explode(F.array(*map(F.lit, range(lanes)))).alias("lane")
    rows = spark.range(ADDRESSES).select(F.col("id").alias("address"), text.alias("text"), lane)
    at = lambda name, modulo: hashing.fnv(F.concat("text", F.lit(f"::{name}::"), F.col("lane").cast("string")), modulo)
    summed = rows.select("address", at("lane", DIM).cast("int").alias("i"), F.when(at("sign", 2) == 0, -1.0).otherwise(1.0).alias("v")).groupBy("address", "i").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("address"))) + 1e-12
    return summed.withColumn("v", F.col("v") / norm).groupBy("address").agg(F.collect_list(F.struct("i", "v")).alias("entries"))  # four lanes at most


def naive_gated(chunks: DataFrame, idf: DataFrame) -> DataFrame:
    """(session_id, step_idx, address, weight, gate): every address of a chunk's tokens and n-grams, gated by the cosine of its vector and the context."""
    rows = naive_items(chunks, idf).withColumn("address", hashing.fnv(F.col("feature"), ADDRESSES)).groupBy(*STEP, "address").agg(F.sum("weight").alias("weight"))
    # address_vectors has one row for each of the fixed addresses.
    met = rows.join(naive_context(chunks, idf), STEP, "left").join(F.broadcast(address_vectors(chunks.sparkSession)), "address")
    score = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["v"] * F.coalesce(F.try_element_at(F.col("context"), e["i"]), F.lit(0.0)))
    return met.withColumn("gate", sigmoid(2.5 * score)).select(*STEP, "address", (F.col("weight") * F.col("gate")).alias("weight"), "gate")


# --- masses and similarity ----------------------------------------------------------------------------------------------
def address_mass(weights: DataFrame, top: int = 16) -> DataFrame:
    return strongest(weights, top).groupBy("session_id", "address").agg(F.sum("weight").alias("mass"))


def edge_mass(weights: DataFrame, top: int = 16) -> DataFrame:
    """(session_id, src, dst, mass): roots of the products of weights of neighbouring steps, at most top * top for each step."""
    trimmed = strongest(weights, top)
    # step_idx counts the steps of a session without gaps.
    left = trimmed.select("session_id", "step_idx", F.col("address").alias("src"), F.col("weight").alias("a"))
    right = trimmed.select("session_id", (F.col("step_idx") - 1).alias("step_idx"), F.col("address").alias("dst"), F.col("weight").alias("b"))
    return left.join(right, STEP).groupBy("session_id", "src", "dst").agg(F.sum(F.sqrt(F.col("a") * F.col("b"))).alias("mass"))


def support_similarity(q_address: DataFrame, q_edge: DataFrame, s_address: DataFrame, s_edge: DataFrame, pairs: DataFrame, share: float = 0.65) -> DataFrame:
    """(item_id, session_id, support) of the given pairs: shared address and edge mass over the geometric mean of both totals."""
    total = lambda address, edge, key: address.select(key, "mass").unionByName(edge.select(key, (share * F.col("mass")).alias("mass"))).groupBy(key).agg((F.sum("mass") + 1e-12).alias(f"{key}_total"))
    q, s = total(q_address, q_edge, "item_id"), total(s_address, s_edge, "session_id")

    def overlap(one: DataFrame, two: DataFrame, on: list[str], factor: float) -> DataFrame:
        met = pairs.join(one, "item_id").join(two.withColumnRenamed("mass", "other"), ["session_id", *on])
        return met.select("item_id", "session_id", (factor * F.least("mass", "other")).alias("shared"))

    both = overlap(q_address, s_address, ["address"], 1.0).unionByName(overlap(q_edge, s_edge, ["src", "dst"], share)).groupBy("item_id", "session_id").agg(F.sum("shared").alias("shared"))
    rows = pairs.join(both, ["item_id", "session_id"], "left").join(q, "item_id", "left").join(s, "session_id", "left")
    floor = lambda c: F.coalesce(c, F.lit(1e-12))
    return rows.select("item_id", "session_id", (F.coalesce("shared", F.lit(0.0)) / F.sqrt(floor(F.col("item_id_total")) * floor(F.col("session_id_total")))).alias("support"))


def edge_weights(rows: DataFrame) -> DataFrame:
    """Gated addresses of constraint steps; steps, edges and weights are each worked out once."""
    rows = cut(rows)
    edges = cut(S.constraint_edges(rows))
    return cut(gated(edge_items(rows, edges), edge_context(rows, edges)))


def encoded(asked: DataFrame, held: DataFrame, steps_of=S.fallback_steps) -> tuple[DataFrame, DataFrame]:
    """(address mass, edge mass) of asked (item_id, text) and held (session_id, text), both sides encoded in one pass; their session_id starts with q or s."""
    side = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string")).alias("session_id")
    texts = asked.select(side("q", "item_id"), "text").unionByName(held.select(side("s", "session_id"), "text"))
    weights = edge_weights(steps_of(S.chunks(texts)))
    return cut(address_mass(weights)), cut(edge_mass(weights))


def support_of(masses: tuple[DataFrame, DataFrame], pairs: DataFrame) -> DataFrame:
    """(item_id, session_id, support) of pairs (item_id, session_id) from the masses of encoded()."""
    kind = {c: pairs.schema[c].dataType for c in ("item_id", "session_id")}

    def own(df: DataFrame, name: str, c: str) -> DataFrame:
        rows = df.where(F.col("session_id").startswith(name)).withColumn("session_id", F.expr("substring(session_id, 2)").cast(kind[c]))
        return rows.withColumnRenamed("session_id", c)

    address, edge = masses
    return support_similarity(own(address, "q", "item_id"), own(edge, "q", "item_id"), own(address, "s", "session_id"), own(edge, "s", "session_id"), pairs)


def hybrid(lexical: DataFrame, support: DataFrame) -> DataFrame:
    """(item_id, session_id, score, rank): 0.7 of the lexical score and 0.3 of the support, ties by id."""
    rows = lexical.join(support, ["item_id", "session_id"], "left")
    score = F.round(0.7 * F.col("lexical") + 0.3 * F.coalesce("support", F.lit(0.0)), 6)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "session_id")
    return rows.select("item_id", "session_id", score.alias("score")).withColumn("rank", F.row_number().over(order))


def archive_bytes(addresses: pd.Series, edges: pd.Series) -> pd.Series:
    """Deflated size of the strongest addresses and edges as compact JSON; the columns hold the two lists as JSON text."""
    import zlib

    return pd.Series([len(zlib.compress(f'{{"a":{a},"e":{e}}}'.encode(), 9)) for a, e in zip(addresses, edges, strict=True)])


def archive_stats(texts: DataFrame, address: DataFrame, edge: DataFrame, most_addresses: int = 24, most_edges: int = 48) -> DataFrame:
    """raw_bytes, bytes_used, compression_ratio and archive_support_ratio of each session."""
    from pyspark.sql.types import LongType

    quantised = F.greatest(F.lit(0), F.least(F.lit(65535), F.bround(F.col("mass") * 1000.0).cast("int"))).cast("string")

    def listed(rows: DataFrame, cols: list[str], most: int, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.round("mass", 9)), *cols))
        text = F.concat(F.lit("["), F.concat_ws(",", *(F.col(c).cast("string") for c in cols), quantised), F.lit("]"))
        counts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        kept = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))).alias("l"))
        return kept.select("session_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["t"]), ","), F.lit("]")).alias(name)).join(counts, "session_id")

    a, e = listed(address, ["address"], most_addresses, "a"), listed(edge, ["src", "dst"], most_edges, "e")
    rows = texts.join(a, "session_id", "left").join(e, "session_id", "left")
    none = lambda c: F.coalesce(c, F.lit("[]"))
    used = F.pandas_udf(archive_bytes, LongType())(none(F.col("a")), none(F.col("e")))
    rows = rows.withColumns({"raw_bytes": F.octet_length("text").cast("double"), "bytes_used": used.cast("double")})
    n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_e", F.lit(0))
    return rows.select("session_id", "raw_bytes", "bytes_used", (F.col("raw_bytes") / F.greatest("bytes_used", F.lit(1e-9))).alias("compression_ratio"), (n / F.greatest("raw_bytes", F.lit(1.0))).alias("archive_support_ratio"))


def storage_summary(stats: DataFrame) -> DataFrame:
    """Mean sizes and the mean of the ratios (not the ratio of the means)."""
    return stats.agg(F.avg("raw_bytes").alias("avg_raw_bytes"), F.avg("bytes_used").alias("avg_index_bytes"), F.avg(F.col("raw_bytes") / F.greatest("bytes_used", F.lit(1.0))).alias("avg_compression_ratio"))
