"""Queries over volumes made of the conversations' sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import hashing
from ..functions.lineage import cut
from ..operators import codec as C
from ..operators import rank
from ..operators import states as S
from ..operators import volumes as V
from ..sources import catalogue
from .registry import query, read
from .states import SQL_STATES, SQL_STEPS, rule_rows, steps
from .texts import sql_tokens

T0, U0, V0 = V.SHAPE
AREA = U0 * V0
_SS = r"""ss AS (SELECT 'conv_' || conv_id AS session_id, trim(coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations GROUP BY conv_id)"""


def sql_volume(source: str, idf: str | None, p: str = "") -> str:
    """{p}vol(id, t, u, v, value) of a table (id, text); idf: an existing table of bucket idfs, or None to make {p}vi."""
    own = f"""{p}v0 AS (SELECT id, {sql_tokens('text')} AS k FROM {source}),
{p}v1 AS (SELECT id, greatest(1, ceil(len(k) / {float(T0)})) AS step, unnest(k) AS f, generate_subscripts(k, 1) - 1 AS i, 1.0 AS w FROM {p}v0 UNION ALL SELECT id, greatest(1, ceil(len(k) / {float(T0)})), unnest(list_transform(range(1, len(k)), lambda i: k[i] || '__' || k[i + 1])), generate_subscripts(list_transform(range(1, len(k)), lambda i: i), 1) - 1, 0.5 FROM {p}v0),
{p}v2 AS (SELECT id, least(floor(i / step), {T0 - 1})::INT AS t, {hashing.fnv_sql('f', AREA)} AS bucket, w FROM {p}v1),"""
    if idf is None:
        own += f"{p}vi AS (SELECT bucket, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(DISTINCT id))) + 1.0 AS idf FROM {p}v2 GROUP BY bucket),"
        idf = f"{p}vi"
    return own + f"""{p}v3 AS (SELECT id, t, bucket, sum(w * coalesce(idf, 1.0)) AS x FROM {p}v2 LEFT JOIN {idf} USING (bucket) GROUP BY ALL),
{p}vol AS (SELECT id, t, (bucket // {V0})::INT AS u, (bucket % {V0})::INT AS v, x / (sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-12) AS value FROM {p}v3)"""


SQL_VOLUME = f"{_SS}, src AS (SELECT session_id AS id, text FROM ss), {sql_volume('src', None)}"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = catalogue.sessions(catalogue.turns(read(spark, sf_dir, "conversations")))
    return made.select(F.col("session_id").alias("id"), "text")


def packed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir)
    return V.packed_text(rows, V.bucket_idf(rows, AREA))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unpacked(packed_volume(spark, sf_dir))


def _shown(df: DataFrame, value: str = "value") -> DataFrame:
    """Rounded; what rounds to 0 is as absent."""
    return df.withColumn(value, F.round(value, 6)).where(F.col(value) != 0)


def _sql_shown(rows: str, cols: str = "id, t, u, v", value: str = "value") -> str:
    return f"SELECT {cols}, {value} FROM (SELECT {cols}, round({value}, 6) AS {value} FROM {rows}) WHERE {value} <> 0"


@query(f"WITH {SQL_VOLUME} {_sql_shown('vol')}")
def text_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session as a unit volume over place in the text and hashed bucket."""
    return _shown(volume(spark, sf_dir))


@query(
    f"""WITH qd AS (SELECT doc_id AS id, text FROM documents), qb AS (SELECT item_id AS id, text FROM benchmark), {sql_volume('qd', None, 'd_')}, {sql_volume('qb', 'd_vi', 'q_')},
dv AS (SELECT id, u, v, x / (sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-12) AS w FROM (SELECT id, u, v, sum(value) AS x FROM d_vol GROUP BY ALL)), qv AS (SELECT id, u, v, x / (sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-12) AS w FROM (SELECT id, u, v, sum(value) AS x FROM q_vol GROUP BY ALL)),
sc AS (SELECT qv.id AS item_id, dv.id AS session_id, round(sum(qv.w * dv.w), 6) AS cosine FROM qv JOIN dv USING (u, v) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, session_id) AS rank FROM sc) WHERE rank <= 10"""
)
def volume_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each question by the cosine of their volumes summed over time."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    idf = cut(V.bucket_idf(docs, AREA))
    vectors = lambda texts: V.packed_vectors(V.packed_text(texts, idf))
    one = vectors(asked).select(F.col("id").alias("item_id"), F.explode(F.arrays_zip("b", "w")).alias("e")).select("item_id", F.col("e.b").alias("bucket"), "e.w")
    return rank.nearest(one, vectors(docs).withColumnRenamed("id", "session_id"), AREA, 10)


def _shares(size: int, radius: int) -> str:
    pairs = {}
    for target in range(size):
        for d in range(-radius, radius + 1):
            key = (target, min(max(target + d, 0), size - 1))
            pairs[key] = pairs.get(key, 0) + 1
    return ", ".join(f"({t}, {s}, {n / (2 * radius + 1)})" for (t, s), n in pairs.items())


SQL_BLUR = f"""bm(c, s, share) AS (VALUES {_shares(T0, 2)}),
b1 AS (SELECT id, bm.c AS t, u, v, sum(value * share) AS value FROM vol JOIN bm ON bm.s = vol.t GROUP BY ALL), b2 AS (SELECT id, t, bm.c AS u, v, sum(value * share) AS value FROM b1 JOIN bm ON bm.s = b1.u GROUP BY ALL), blur AS (SELECT id, t, u, bm.c AS v, sum(value * share) AS value FROM b2 JOIN bm ON bm.s = b2.v GROUP BY ALL)"""


@query(f"WITH {SQL_VOLUME}, {SQL_BLUR} {_sql_shown('blur')}")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box mean with repeated edges along each axis."""
    return _shown(V.box_blur(volume(spark, sf_dir)))


@query(f"WITH {SQL_VOLUME}, a AS (SELECT id, t // 2 AS t, u // 2 AS u, v // 2 AS v, sum(value / 8) AS value FROM vol GROUP BY ALL) {_sql_shown('a')}")
def avg_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of blocks of two voxels a side."""
    return _shown(V.average_pool(volume(spark, sf_dir)))


@query(f"WITH {SQL_VOLUME}, a AS (SELECT id, t // 2 AS t, u // 2 AS u, v // 2 AS v, sum(value / 8) AS value FROM vol GROUP BY ALL), o AS (SELECT id, t * 2 + x AS t, u * 2 + y AS u, v * 2 + z AS v, value FROM a, range(2) r(x), range(2) s(y), range(2) q(z)) {_sql_shown('o')}")
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(V.upsample(V.average_pool(volume(spark, sf_dir))))


@query(f"WITH {SQL_VOLUME}, o AS (SELECT DISTINCT id, t + x AS t, u + y AS u, v + z AS v FROM vol, range(-1, 2) r(x), range(-1, 2) s(y), range(-1, 2) q(z)) SELECT * FROM o WHERE t BETWEEN 0 AND {T0 - 1} AND u BETWEEN 0 AND {U0 - 1} AND v BETWEEN 0 AND {V0 - 1}")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support of each volume grown by one voxel."""
    return V.dilate(volume(spark, sf_dir))


@query(f"WITH {SQL_VOLUME}, s AS (SELECT *, greatest(max(abs(value)) OVER (PARTITION BY id) / 32767.0, 1e-8) AS scale FROM vol) SELECT id, t, u, v, round_even(round(value / scale, 4), 0)::INT AS q, round(scale, 9) AS scale FROM s")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit values and the scale of each volume."""
    return V.quantise(volume(spark, sf_dir)).withColumn("scale", F.round("scale", 9))


_BANK = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(lex.DIRECTIONS))
SQL_RESPONSE = f"""bank(dir, dt, du, dv) AS (VALUES {_BANK}),
rs AS (SELECT id, (t + s * dt)::INT AS t, (u + s * du)::INT AS u, (v + s * dv)::INT AS v, dir, sum(value * value) AS response FROM vol, bank, range(-4, 5) r(s) WHERE t + s * dt BETWEEN 0 AND {T0 - 1} AND u + s * du BETWEEN 0 AND {U0 - 1} AND v + s * dv BETWEEN 0 AND {V0 - 1} GROUP BY ALL)"""


@query(f"WITH {SQL_VOLUME}, {SQL_RESPONSE} {_sql_shown('rs', 'id, t, u, v, dir', 'response')}")
def direction_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy along thirteen directions through every voxel."""
    return _shown(V.direction_response(packed_volume(spark, sf_dir)), "response")


@query(
    f"""WITH {SQL_VOLUME}, {SQL_RESPONSE}, b AS (SELECT id, dir, max(response) AS best FROM rs GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY best DESC, dir DESC) AS nth, max(best) OVER (PARTITION BY id) AS top FROM b),
m AS (SELECT *, best >= 0.25 * greatest(top, 1e-8) AS near, sum((best >= 0.25 * greatest(top, 1e-8))::INT) OVER (PARTITION BY id) < 4 AS few FROM n) SELECT id, dir, round(best, 6) AS best FROM m WHERE nth <= 8 AND (near OR (few AND nth <= 4))"""
)
def active_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directions worth a tube in each volume."""
    return V.active_directions(V.best_responses(packed_volume(spark, sf_dir))).withColumn("best", F.round("best", 6))


@query(
    f"""WITH {SQL_VOLUME}, {SQL_BLUR}, r AS (SELECT id, t, u, v, sum(value) AS value FROM (SELECT id, t, u, v, value FROM vol UNION ALL SELECT id, t, u, v, -value FROM blur) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(value), 9) DESC, t, u, v) AS nth FROM r) SELECT id, t, u, v, round(value, 6) AS value, nth FROM n WHERE nth <= 96"""
)
def residual_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 96 greatest deviations of each volume from its blur."""
    rows = volume(spark, sf_dir)
    return V.residual_top(V.minus(rows, V.box_blur(rows))).select(*V.VOXEL, F.round("value", 6).alias("value"), "nth")


_case = lambda c, pairs: f"CASE {c}" + "".join(f" WHEN '{n}' THEN {x}" for n, x in pairs) + " ELSE 0 END"
_TOKEN = "concat_ws('::', edge_type, source_state, target, CASE WHEN trigger <> '' THEN 'trigger=' || trigger END, CASE WHEN status <> '' THEN 'status=' || status END)"
SQL_EDGE_TUBES = f"""bank(dir, dt, du, dv) AS (VALUES {_BANK}),
et AS (SELECT session_id AS id, step_idx, source_state, {_TOKEN} AS token, weight, (CASE WHEN n <= 1 THEN {T0 // 2} ELSE round_even(step_idx * {T0 - 1} / greatest(n - 1, 1)::DOUBLE, 0) END)::INT AS t,
  {hashing.fnv_sql("'u::' || source_state || '::' || CASE WHEN trigger <> '' THEN trigger ELSE edge_type END", U0)} AS u, {hashing.fnv_sql("'v::' || target || '::' || edge_type || '::' || status", V0)} AS v, {hashing.fnv_sql(f"'dir::' || {_TOKEN}", len(lex.DIRECTIONS))} AS dir,
  CASE WHEN edge_type IN ('flow', 'step', 'conflict') THEN 3 ELSE 2 END AS half, CASE WHEN edge_type IN ('block', 'conflict') THEN 2 ELSE 1 END AS radius, ({_case('edge_type', lex.EDGE_AMPLITUDE)} + {_case('status', lex.STATUS_AMPLITUDE)}) * greatest(weight, 0.3)::DOUBLE AS signal FROM (SELECT *, max(step_idx) OVER (PARTITION BY session_id) + 1 AS n FROM ed)),
tp AS (SELECT id, t + s * dt AS t, u + s * du AS u, v + s * dv AS v, radius, signal FROM et JOIN bank USING (dir), unnest(range(-half, half + 1)) r(s)),
tc AS (SELECT id, t + a AS t, u + b AS u, v + c AS v, signal AS value FROM (SELECT * FROM tp WHERE t BETWEEN 0 AND {T0 - 1} AND u BETWEEN 0 AND {U0 - 1} AND v BETWEEN 0 AND {V0 - 1}), unnest(range(-radius, radius + 1)) x(a), unnest(range(-radius, radius + 1)) y(b), unnest(range(-radius, radius + 1)) z(c)),
tv AS (SELECT id, t::INT AS t, u::INT AS u, v::INT AS v, sum(value) AS value FROM tc WHERE t BETWEEN 0 AND {T0 - 1} AND u BETWEEN 0 AND {U0 - 1} AND v BETWEEN 0 AND {V0 - 1} GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.constraint_edges(steps(spark, sf_dir))


@query(f"WITH {SQL_STEPS}, {SQL_EDGE_TUBES} {_sql_shown('tv')}")
def render_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tubes of all constraint edges, added up."""
    return _shown(V.render_tubes(V.edge_tubes(edges(spark, sf_dir))))


@query(
    f"""WITH {SQL_STEPS}, {SQL_EDGE_TUBES}, jt AS (SELECT id, t, round_even(avg(u), 0)::INT AS u, round_even(avg(v), 0)::INT AS v, (0.55 + 0.1 * count(*))::DOUBLE AS value FROM et GROUP BY id, step_idx, source_state, t HAVING count(*) >= 2),
jc AS (SELECT id, least(greatest(t + a, 0), {T0 - 1})::INT AS t, least(greatest(u + b, 0), {U0 - 1})::INT AS u, least(greatest(v + c, 0), {V0 - 1})::INT AS v, value FROM jt, range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c)),
o AS (SELECT id, t, u, v, sum(value) AS value FROM (SELECT * FROM tv UNION ALL SELECT * FROM jc) GROUP BY ALL) {_sql_shown('o')}"""
)
def edge_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint edges as a volume: tubes and the junctions of edges that share a source."""
    return _shown(V.edge_volume(edges(spark, sf_dir)))


SQL_PATTERNS = f"""jt AS (SELECT id, step_idx, source_state, count(*) AS n, t, round_even(avg(u), 0)::INT AS u, round_even(avg(v), 0)::INT AS v FROM et GROUP BY id, step_idx, source_state, t HAVING count(*) >= 2),
jc AS (SELECT id, step_idx, 'junction::' || source_state || '::degree[' || n || ']' AS token, 1.0 + 0.15 * n AS weight, (0.55 + 0.1 * n)::DOUBLE AS value, least(greatest(t + a, 0), {T0 - 1})::INT AS t, least(greatest(u + b, 0), {U0 - 1})::INT AS u, least(greatest(v + c, 0), {V0 - 1})::INT AS v FROM jt, range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c)),
eo AS MATERIALIZED (SELECT id, t, u, v, sum(value) AS value FROM (SELECT id, t, u, v, value FROM tv UNION ALL SELECT id, t, u, v, value FROM jc) GROUP BY ALL),
en AS (SELECT row_number() OVER () AS pattern, * FROM et),
ep AS (SELECT id, step_idx, pattern, token, weight, radius, t + s * dt AS t, u + s * du AS u, v + s * dv AS v FROM en JOIN bank USING (dir), unnest(range(-half, half + 1)) r(s)),
ec AS (SELECT DISTINCT id, step_idx, pattern::VARCHAR AS pattern, token, weight::DOUBLE AS weight, (t + a)::INT AS t, (u + b)::INT AS u, (v + c)::INT AS v FROM (SELECT * FROM ep WHERE t BETWEEN 0 AND {T0 - 1} AND u BETWEEN 0 AND {U0 - 1} AND v BETWEEN 0 AND {V0 - 1}), unnest(range(-radius, radius + 1)) x(a), unnest(range(-radius, radius + 1)) y(b), unnest(range(-radius, radius + 1)) z(c)
  UNION ALL SELECT DISTINCT id, step_idx, token, token, weight::DOUBLE, t, u, v FROM jc),
ea AS (SELECT id, step_idx, token, max(weight) AS weight, 1.0 / (1.0 + exp(-2.4 * avg(abs(coalesce(value, 0) + 0.025 * t / {float(T0 - 1)})))) AS gate FROM (SELECT * FROM ec WHERE t BETWEEN 0 AND {T0 - 1} AND u BETWEEN 0 AND {U0 - 1} AND v BETWEEN 0 AND {V0 - 1}) LEFT JOIN eo USING (id, t, u, v) GROUP BY id, step_idx, pattern, token),
eg AS (SELECT id AS session_id, step_idx, {hashing.fnv_sql("'native::' || token", 4096)} AS address, sum(weight * gate) AS weight, max(gate) AS gate FROM ea GROUP BY ALL)"""


@query(
    f"""WITH {SQL_STEPS}, {SQL_EDGE_TUBES}, {SQL_PATTERNS} SELECT session_id, step_idx, address, round(weight, 5) AS weight, round(gate, 5) AS gate FROM eg QUALIFY row_number() OVER (PARTITION BY session_id, step_idx ORDER BY round(weight, 9) DESC, address) <= 24"""
)
def pattern_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each step's edges and junctions, gated by the session's volume on the cells of their own tubes."""
    made = V.pattern_addresses(edges(spark, sf_dir))
    return made.select("session_id", F.col("step_idx").cast("long").alias("step_idx"), F.col("address").cast("long").alias("address"), F.round("weight", 5).alias("weight"), F.round("gate", 5).alias("gate"))


@query(f"WITH {SQL_STEPS}, {SQL_EDGE_TUBES}, {SQL_PATTERNS}, ids AS (SELECT DISTINCT id FROM et), gr AS (SELECT id, t::INT AS t, u::INT AS u, v::INT AS v FROM ids, range({T0}) a(t), range({U0}) b(u), range({V0}) c(v)) SELECT id, t, u, v, round(coalesce(value, 0) + 0.025 * t / {float(T0 - 1)}, 6) AS value FROM gr LEFT JOIN eo USING (id, t, u, v)")
def edge_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole field of each session's constraint edges: every voxel, with the slope along time."""
    volume = cut(V.edge_volume(edges(spark, sf_dir)))
    grid = volume.select("id").distinct()
    for axis, size in zip(V.AXES, V.SHAPE, strict=True):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    made = grid.join(volume, V.VOXEL, "left").withColumn("value", F.round(F.coalesce("value", F.lit(0.0)) + V.ramp(F.col("t")), 6))
    return made.select(*V.VOXEL, "value")


_KERNEL = ", ".join(f"({a}, {b}, {c}, {s})" for a, b, c, s in lex.KERNEL)


@query(
    f"""WITH {SQL_STATES}, e0 AS (SELECT session_id AS id, step_idx, least(round_even(step_idx * {T0 - 1} / greatest(max(step_idx) OVER (PARTITION BY session_id), 1)::DOUBLE, 0), {T0 - 1})::INT AS t, fl, length(chunk) AS n, sem, rel FROM st),
e1 AS (SELECT id, step_idx, t, fl, n, unnest(sem[1:2]) AS key, rel FROM e0), e2 AS (SELECT id, step_idx, t, fl, n, key, unnest(rel[1:2]) AS relation FROM e1),
e AS (SELECT id, step_idx, t, {hashing.fnv_sql('key', U0)}::INT AS u, {hashing.fnv_sql('relation', V0)}::INT AS v, key, 1.45 + 0.2 * least(len(fl), 2) + CASE WHEN list_contains(fl, 'DECISION') OR list_contains(fl, 'PIVOT') OR list_contains(fl, 'CORE') THEN 0.3 ELSE 0 END + CASE WHEN n > 140 THEN 0.1 ELSE 0 END AS weight FROM e2),
l AS (SELECT *, lead(step_idx) OVER q AS s2, lead(t) OVER q AS t2, lead(u) OVER q AS u2, lead(v) OVER q AS v2, lead(weight) OVER q AS w2 FROM e WINDOW q AS (PARTITION BY id, key ORDER BY step_idx, v, u)),
m AS (SELECT *, greatest(abs(t2 - t), abs(u2 - u), abs(v2 - v), 1) AS n FROM l WHERE s2 IS NOT NULL AND s2 - step_idx <= 2),
p AS (SELECT id, t, u, v, weight FROM e UNION ALL SELECT id, round_even((1 - s / n) * t + s / n * t2, 0)::INT, round_even((1 - s / n) * u + s / n * u2, 0)::INT, round_even((1 - s / n) * v + s / n * v2, 0)::INT, 0.55 * least(weight, w2) FROM m, unnest(range(0, n + 1)) r(s)),
kn(dt, du, dv, share) AS (VALUES {_KERNEL}), o AS (SELECT id, t + dt AS t, u + du AS u, v + dv AS v, sum(weight * share) AS value FROM p, kn WHERE t + dt BETWEEN 0 AND {T0 - 1} AND u + du BETWEEN 0 AND {U0 - 1} AND v + dv BETWEEN 0 AND {V0 - 1} GROUP BY ALL),
z AS (SELECT id, t, u, v, value / greatest(max(abs(value)) OVER (PARTITION BY id), 1e-8) AS value FROM o) {_sql_shown('z')}"""
)
def semantic_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of rule states as kernels, and lines between events of the same key."""
    return _shown(V.semantic_volume(V.semantic_events(rule_rows(spark, sf_dir))))


def _quantised(rows: str, by: str, keep: str) -> str:
    """SELECT keep, q, scale of rows with a value."""
    return f"SELECT {keep}, round_even(round(value / scale, 4), 0)::INT AS q, scale FROM (SELECT *, greatest(max(abs(value)) OVER (PARTITION BY {by}) / 32767.0, 1e-8)::DOUBLE AS scale FROM {rows})"


_IN = lambda t, u, v: f"{t} BETWEEN 0 AND {T0 - 1} AND {u} BETWEEN 0 AND {U0 - 1} AND {v} BETWEEN 0 AND {V0 - 1}"
_CUBE = lambda rows, keep, r=1: f"SELECT {keep}, (t + a)::INT AS t, (u + b)::INT AS u, (v + c)::INT AS v FROM {rows}, range({-r}, {r + 1}) x(a), range({-r}, {r + 1}) y(b), range({-r}, {r + 1}) z(c) WHERE {_IN('t + a', 'u + b', 'v + c')}"
_LESS = lambda one, two: f"SELECT id, t, u, v, sum(value) AS value FROM (SELECT id, t, u, v, value FROM {one} UNION ALL SELECT id, t, u, v, -value FROM {two}) GROUP BY ALL"


def sql_codec() -> str:
    """CTEs from vol and blur to base, tubes, points, cells, residual and parts: the rounds of the codec unrolled."""
    steps = [
        f"kb AS MATERIALIZED (SELECT * FROM ({_quantised('blur', 'id', 'id, t, u, v')}) WHERE q <> 0)",
        f"l1 AS MATERIALIZED ({_LESS('vol', '(SELECT id, t, u, v, q * scale AS value FROM kb)')})",
        f"bank(dir, dt, du, dv) AS (VALUES {_BANK})",
        f"r0 AS (SELECT id, dir, t + s * dt AS t, u + s * du AS u, v + s * dv AS v, sum(value * value) AS response FROM l1, bank, range(-4, 5) r(s) WHERE {_IN('t + s * dt', 'u + s * du', 'v + s * dv')} GROUP BY ALL)",
        "b0 AS (SELECT id, dir, max(response) AS best FROM r0 GROUP BY ALL), n0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY best DESC, dir DESC) AS nth, max(best) OVER (PARTITION BY id) AS top FROM b0)",
        "m0 AS (SELECT *, best >= 0.25 * greatest(top, 1e-8) AS near, sum((best >= 0.25 * greatest(top, 1e-8))::INT) OVER (PARTITION BY id) < 4 AS few FROM n0)",
        f"act AS MATERIALIZED (SELECT id, dir, row_number() OVER (PARTITION BY id ORDER BY round(best, 9) DESC, dir) AS nth FROM m0 WHERE nth <= {C.ROUNDS} AND (near OR (few AND nth <= 4)))",
    ]
    for r in range(1, C.ROUNDS + 1):
        steps += [
            f"q{r} AS (SELECT id, dir, (t + s * dt)::INT AS t, (u + s * du)::INT AS u, (v + s * dv)::INT AS v, sum(value * value) AS response FROM l{r} JOIN act USING (id) JOIN bank USING (dir), range(-4, 5) r(s) WHERE nth = {r} AND {_IN('t + s * dt', 'u + s * du', 'v + s * dv')} GROUP BY ALL)",
            f"t{r} AS MATERIALIZED (SELECT * FROM q{r} JOIN bank USING (dir) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(response, 9) DESC, t, u, v) = 1)",
            f"o{r} AS (SELECT id, dir, s, (t + s * dt)::INT AS t, (u + s * du)::INT AS u, (v + s * dv)::INT AS v FROM t{r}, range(-4, 5) r(s) WHERE {_IN('t + s * dt', 'u + s * du', 'v + s * dv')})",
            f"c{r} AS ({_CUBE(f'o{r}', 'id, dir, s, t AS pt, u AS pu, v AS pv')})",
            f"s{r} AS (SELECT c.id, dir, s, pt AS t, pu AS u, pv AS v, coalesce(sum(value), 0) / 27 AS value FROM c{r} c LEFT JOIN l{r} l ON l.id = c.id AND l.t = c.t AND l.u = c.u AND l.v = c.v GROUP BY ALL)",
            f"p{r} AS MATERIALIZED (SELECT * FROM ({_quantised(f's{r}', 'id', 'id, dir, s, t, u, v')}) QUALIFY max(abs(q)) OVER (PARTITION BY id) > 0)",
            f"k{r} AS MATERIALIZED (SELECT t.id, t.dir, t.t, t.u, t.v, dt, du, dv, t0, t1, CASE WHEN t.v < {V0 // 3} THEN 'text' WHEN t.v < {2 * V0 // 3} THEN 'image' ELSE 'video' END AS modality, norm / (whole + 1e-8) AS importance FROM t{r} t JOIN (SELECT id, min(t) AS t0, max(t) AS t1, sqrt(sum((q * scale) * (q * scale))) AS norm FROM p{r} GROUP BY id) USING (id) JOIN (SELECT id, sqrt(sum(value * value)) AS whole FROM l{r} GROUP BY id) USING (id))",
            f"l{r + 1} AS MATERIALIZED ({_LESS(f'l{r}', '(' + _CUBE(f'(SELECT id, t, u, v, q * scale AS value FROM p{r})', 'id, value') + ')')})",
        ]
    last = f"l{C.ROUNDS + 1}"
    union = lambda name: " UNION ALL ".join(f"SELECT * FROM {name}{r}" for r in range(1, C.ROUNDS + 1))
    return ",\n".join([
        *steps,
        f"tubes AS MATERIALIZED ({union('k')}), points AS MATERIALIZED ({union('p')})",
        f"cov AS (SELECT id, t, u, v FROM (SELECT DISTINCT id, dir, t, u, v FROM ({_CUBE('points', 'id, dir')})) GROUP BY ALL HAVING count(*) >= 2)",
        f"cro AS (SELECT id, t, u, v, row_number() OVER (PARTITION BY id ORDER BY round(coalesce(value, 0) * coalesce(value, 0), 9) DESC, t, u, v) AS nth FROM cov LEFT JOIN {last} USING (id, t, u, v) QUALIFY nth <= {C.CROSSINGS})",
        f"see AS (SELECT id, t, u, v, min(nth) AS best FROM ({_CUBE('cro', 'id, nth', 2)}) GROUP BY ALL)",
        f"joi AS MATERIALIZED (SELECT id, t, u, v FROM cro JOIN see USING (id, t, u, v) WHERE nth = best QUALIFY row_number() OVER (PARTITION BY id ORDER BY nth) <= {C.JOINTS})",
        f"pat AS (SELECT p.*, coalesce(value, 0) AS value FROM ({_CUBE('joi', 'id, t AS jt, u AS ju, v AS jv')}) p LEFT JOIN {last} USING (id, t, u, v))",
        f"cells AS MATERIALIZED ({_quantised('pat', 'id, jt, ju, jv', 'id, jt, ju, jv, t, u, v')})",
        f"rest AS MATERIALIZED ({_LESS(last, '(SELECT id, t, u, v, q * scale AS value FROM cells)')})",
        f"top AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(abs(value), 9) DESC, t, u, v) <= {C.BUDGET})",
        f"residual AS MATERIALIZED ({_quantised('top', 'id', 'id, t, u, v')})",
        f"parts AS MATERIALIZED (SELECT id, t, u, v, q * scale AS value FROM kb UNION ALL SELECT id, t, u, v, value FROM ({_CUBE('(SELECT id, t, u, v, q * scale AS value FROM points)', 'id, value')}) UNION ALL SELECT id, t, u, v, q * scale FROM cells UNION ALL SELECT id, t, u, v, q * scale FROM residual)",
    ])


_SIZE = T0 * U0 * V0
SQL_STORED = " UNION ALL ".join(f"SELECT id, {C.COST[n]} AS b FROM {rows}" for n, rows in (("base", "kb"), ("tubes", "tubes"), ("points", "points"), ("joints", "joi"), ("cells", "cells"), ("residual", "residual")))


@query(
    f"""WITH {SQL_VOLUME}, {SQL_BLUR}, {sql_codec()},
gap AS (SELECT id, sum(value * value) AS sq FROM ({_LESS('vol', 'parts')}) GROUP BY id), own AS (SELECT id, sqrt(sum(value * value)) AS norm, greatest(max(value), 0) - least(min(value), 0) AS span FROM vol GROUP BY id), sto AS (SELECT id, sum(b)::BIGINT AS stored_bytes FROM ({SQL_STORED}) GROUP BY id)
SELECT id, round(sqrt(sq) / greatest(norm, 1e-12), 6) AS rel_l2, round(CASE WHEN sq / {_SIZE} <= 1e-12 THEN 120 ELSE 20 * log10(greatest(span, 1e-6) / sqrt(sq / {_SIZE})) END, 4) AS psnr, {4 * _SIZE}::BIGINT AS raw_bytes, stored_bytes, round({4.0 * _SIZE} / stored_bytes, 6)::DOUBLE AS ratio FROM own JOIN gap USING (id) JOIN sto USING (id)"""
)
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, stored bytes and ratio of encoding each session's volume: blurred base, tubes, junctions, sparse residual."""
    made = C.errors(C.encoded(packed_volume(spark, sf_dir)))
    return made.select("id", F.round("rel_l2", 6).alias("rel_l2"), F.round("psnr", 4).alias("psnr"), F.lit(4 * _SIZE).cast("long").alias("raw_bytes"), F.col("stored").alias("stored_bytes"), F.round(4.0 * _SIZE / F.col("stored"), 6).alias("ratio"))


_DIR = f"bk AS (SELECT * FROM (VALUES {_BANK}) b(dir, dt, du, dv))"
_PLANT = f"""pl0 AS (SELECT id, 1.5 * max(abs(value)) AS signal FROM v0 GROUP BY id), {_DIR},
pl AS MATERIALIZED (SELECT id, {hashing.fnv_sql("'t::' || id", T0)} AS t, {hashing.fnv_sql("'u::' || id", U0)} AS u, {hashing.fnv_sql("'v::' || id", V0)} AS v, {hashing.fnv_sql("'dir::' || id", len(lex.DIRECTIONS))} AS dir, signal FROM pl0),
plp AS (SELECT id, t + s * dt AS t, u + s * du AS u, v + s * dv AS v, signal AS value FROM pl JOIN bk USING (dir), range(-3, 4) r(s) WHERE {_IN('t + s * dt', 'u + s * du', 'v + s * dv')}),
vol AS MATERIALIZED (SELECT id, t, u, v, sum(value) AS value FROM (SELECT id, t, u, v, value FROM v0 UNION ALL SELECT id, t, u, v, value FROM ({_CUBE('plp', 'id, value')})) GROUP BY ALL)"""
_RANKED = """met AS (SELECT ask.query_id, tubes.*, abs(qt * dt + qu * du + qv * dv) / (sqrt((qt * qt + qu * qu + qv * qv)::DOUBLE) * sqrt((dt * dt + du * du + dv * dv)::DOUBLE)) * (0.6 + 0.4 * (greatest(0, least(q1, t1) - greatest(q0, t0) + 1) / greatest(q1 - q0 + 1, 1))) * CASE WHEN q_modality = modality THEN 1.0 ELSE 0.4 END * (0.4 + 0.6 * least(importance, 1.0)) AS score FROM ask JOIN tubes USING (id)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, dir, t, u, v) AS rank FROM met WHERE round(score, 6) > 0.05 QUALIFY rank <= 3)"""


@query(
    f"""WITH {_SS}, src AS (SELECT session_id AS id, text FROM ss), {sql_volume('src', None).replace('vol AS (', 'v0 AS MATERIALIZED (').replace('v0 AS (SELECT id, list', 'v00 AS (SELECT id, list').replace('FROM v0 UNION', 'FROM v00 UNION').replace('FROM v0)', 'FROM v00)')}, {_PLANT}, {SQL_BLUR}, {sql_codec()},
ask AS (SELECT id AS query_id, id, dt AS qt, du AS qu, dv AS qv, greatest(t - 3, 0) AS q0, least(t + 3, {T0 - 1}) AS q1, CASE WHEN v < {V0 // 3} THEN 'text' WHEN v < {2 * V0 // 3} THEN 'image' ELSE 'video' END AS q_modality, dir AS wanted FROM pl JOIN bk USING (dir)), {_RANKED}
SELECT ask.id, coalesce(max((dir = wanted)::INT), 0)::INT AS hit, min(CASE WHEN dir = wanted THEN rank END) AS rank FROM ask LEFT JOIN ranked USING (query_id) GROUP BY ask.id""",
    small=True,
)
def synthetic_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tube that is planted into each session's volume is found again among the first three for its direction and time."""
    field, planted = C.planted(volume(spark, sf_dir))
    tubes = C.Archive(C.encoded(V.packed(field))).tubes
    asked = cut(planted.select(F.col("id").alias("query_id"), "id", F.col("dt").alias("qt"), F.col("du").alias("qu"), F.col("dv").alias("qv"), F.greatest(F.col("t") - 3, F.lit(0)).alias("q0"), F.least(F.col("t") + 3, F.lit(T0 - 1)).alias("q1"), V.modality(F.col("v")).alias("q_modality"), F.col("dir").alias("wanted")))
    ranked = V.retrieve_tubes(tubes, asked).select("query_id", "dir", "rank")
    same = F.col("dir") == F.col("wanted")
    return asked.join(ranked, "query_id", "left").groupBy("id").agg(F.coalesce(F.max(same.cast("int")), F.lit(0)).alias("hit"), F.min(F.when(same, F.col("rank"))).cast("long").alias("rank"))


@query(
    f"""WITH {SQL_VOLUME}, {SQL_BLUR}, {sql_codec()},
ask AS (SELECT DISTINCT id AS query_id, id, 1 AS qt, 0 AS qu, 0 AS qv, 0 AS q0, {T0 - 1} AS q1, 'text' AS q_modality FROM vol), {_RANKED},
box AS (SELECT query_id, r.id, min(p.t) - 2 AS lt, max(p.t) + 2 AS ht, min(p.u) - 2 AS lu, max(p.u) + 2 AS hu, min(p.v) - 2 AS lv, max(p.v) + 2 AS hv FROM ranked r JOIN points p ON p.id = r.id AND p.dir = r.dir GROUP BY ALL),
vox AS (SELECT query_id, p.t, p.u, p.v, sum(value) AS value FROM parts p JOIN box ON box.id = p.id AND p.t BETWEEN lt AND ht AND p.u BETWEEN lu AND hu AND p.v BETWEEN lv AND hv GROUP BY ALL)
SELECT query_id, count(*) AS voxels, round(sum(value * value), 4) AS energy FROM vox GROUP BY query_id"""
)
def box_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session's archived volume the box around the three best tubes for its time axis: voxels and their energy."""
    rows = packed_volume(spark, sf_dir)
    archive = C.Archive(C.encoded(rows))
    asked = rows.select(F.col("id").alias("query_id"), "id", F.lit(1).alias("qt"), F.lit(0).alias("qu"), F.lit(0).alias("qv"), F.lit(0).alias("q0"), F.lit(T0 - 1).alias("q1"), V.modality(F.lit(0)).alias("q_modality"))
    found = C.decode_boxes(archive, asked)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("voxels"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("energy"))


@query()
def shortlist_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage ranking of all documents: shortlists by mixed, lexical and volume scores, the rest as an ordered tail; without semantic and structure scores and the rescoring."""
    from .retrieval import _questions, _sessions, hashed_vectors

    docs, idf = hashed_vectors(_sessions(spark, sf_dir), "session_id")
    asked, _ = hashed_vectors(_questions(spark, sf_dir), "item_id", idf)
    lexical = asked.withColumnRenamed("w", "x").join(docs, "bucket").groupBy("item_id", "session_id").agg(F.sum(F.col("x") * F.col("w")).alias("lexical"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    own = V.bucket_idf(d, AREA)
    one = V.volume_vectors(V.text_volume(q, own)).withColumnsRenamed({"id": "item_id", "w": "x"})
    two = V.volume_vectors(V.text_volume(d, own)).withColumnRenamed("id", "session_id")
    shadow = one.join(two, ["u", "v"]).groupBy("item_id", "session_id").agg(F.sum(F.col("x") * F.col("w")).alias("shadow"))
    return rank.two_stage(_questions(spark, sf_dir), _sessions(spark, sf_dir), lexical, shadow)
