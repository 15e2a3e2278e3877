"""Queries over address maps: encoders, gates, masses, similarity, hybrid ranking, storage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.lineage import cut
from ..operators import addresses as A
from ..operators import encoders as E
from ..operators import rank
from ..operators import states as S
from ..sources import catalogue
from .registry import query, read
from .retrieval import SQL_SCORES
from .states import SQL_CHUNKS, SQL_EVENTS, SQL_STATES, SQL_STEPS, chunks, rule_rows, sql_steps, steps
from .texts import sql_parts, sql_tokens

N, DIM = A.ADDRESSES, A.DIM
_EDGE = "CASE edge_type WHEN 'allow' THEN 'allow_edge::' || source_state || '=>' || target WHEN 'block' THEN 'block_edge::' || source_state || '-/->' || target WHEN 'require' THEN 'require_edge::' || source_state || '=>' || target WHEN 'trigger' THEN 'trigger_edge::' || trigger || '::' || source_state WHEN 'step' THEN 'constraint_step::' || source_state || '=>' || target WHEN 'flow' THEN 'constraint_flow::' || source_state || '=>' || trigger || '=>' || target ELSE 'constraint_conflict::' || source_state || '-/->' || trigger || '::' || target END"


def sql_items(p: str = "") -> str:
    return f"""
{p}it AS (SELECT session_id, step_idx, 'constraint_state::' || current AS feature, 2.8 * w AS weight FROM {p}sw
  UNION ALL SELECT session_id, step_idx, {_EDGE}, weight FROM {p}ed
  UNION ALL SELECT session_id, step_idx, 'trigger_allow::' || t || '::' || current || '=>' || x, 2.7 * w FROM (SELECT *, unnest(preferred[1:2]) AS x FROM (SELECT *, unnest(triggers[1:3]) AS t FROM {p}sw)))"""


def sql_strongest(rows: str, top: int, out: str, extra: str = "") -> str:
    return f"{out} AS (SELECT session_id, step_idx, address, weight{extra} FROM (SELECT *, row_number() OVER (PARTITION BY session_id, step_idx ORDER BY round(weight, 9) DESC, address) AS nth FROM {rows}) WHERE nth <= {top})"


def sql_gated(p: str = "") -> str:
    return f"""
{p}c0 AS (SELECT session_id, step_idx, 'ctx_constraint_state::' || current AS feature, 2.0 AS weight, false AS linked FROM {p}ls UNION ALL SELECT session_id, step_idx, 'ctx_' || {_EDGE}, weight, edge_type IN ('step', 'flow', 'conflict') FROM {p}ed),
{p}c1 AS (SELECT *, unnest(range(step_idx, least(step_idx + 7, last) + 1)) AS upto FROM {p}c0 JOIN (SELECT session_id, max(step_idx) AS last FROM {p}ls GROUP BY session_id) USING (session_id)),
{p}cx AS (SELECT session_id, upto AS step_idx, feature, sum(weight * (1.0 + 0.45 * (step_idx - greatest(upto - 7, 0)) / least(upto + 1, 8))) AS weight FROM {p}c1 WHERE NOT linked OR step_idx > greatest(upto - 7, 0) GROUP BY ALL),
{p}pf AS (SELECT feature, {hashing.fnv_sql("'phase::' || feature", 8192)} AS ph FROM (SELECT feature FROM {p}it UNION SELECT feature FROM {p}cx)),
{p}p1 AS (SELECT feature, {hashing.fnv_sql("feature || '::lane::' || lane", DIM)} AS i, CASE WHEN {hashing.fnv_sql("feature || '::sign::' || lane", 2)} = 0 THEN -1.0 ELSE 1.0 END AS s, {2 * math.pi} * ph / 8192.0 + {2 * math.pi} * lane / 8.0 AS ang FROM {p}pf, range(8) r(lane)),
{p}p2 AS (SELECT feature, i, sum(s * cos(ang)) AS re, sum(s * sin(ang)) AS im FROM {p}p1 GROUP BY ALL),
{p}pr AS (SELECT feature, i, re / (sqrt(sum(re * re + im * im) OVER (PARTITION BY feature)) + 1e-12) AS re, im / (sqrt(sum(re * re + im * im) OVER (PARTITION BY feature)) + 1e-12) AS im FROM {p}p2),
{p}x1 AS (SELECT session_id, step_idx, i, sum(weight * re) AS a, sum(weight * im) AS b FROM {p}cx JOIN {p}pr USING (feature) GROUP BY ALL),
{p}x2 AS (SELECT session_id, step_idx, i, a / (sqrt(sum(a * a + b * b) OVER q) + 1e-12) AS a, b / (sqrt(sum(a * a + b * b) OVER q) + 1e-12) AS b FROM {p}x1 WINDOW q AS (PARTITION BY session_id, step_idx)),
{p}sc AS (SELECT m.session_id, m.step_idx, feature, any_value(m.weight) AS weight, sum(coalesce(a, 0) * re + coalesce(b, 0) * im) AS x, sum(coalesce(a, 0) * im - coalesce(b, 0) * re) AS y
  FROM (SELECT session_id, step_idx, feature, sum(weight) AS weight FROM {p}it GROUP BY ALL) m JOIN {p}pr USING (feature) LEFT JOIN {p}x2 c ON c.session_id = m.session_id AND c.step_idx = m.step_idx AND c.i = {p}pr.i GROUP BY m.session_id, m.step_idx, feature),
{p}g1 AS (SELECT session_id, step_idx, {hashing.fnv_sql('feature', N)} AS address, weight, 1.0 / (1.0 + exp(-greatest(least(3.2 * x + 1.4 * sqrt(x * x + y * y) + 0.6 * cos(atan2(y, x + 1e-12)), 20.0), -20.0))) AS gate FROM {p}sc),
{p}g2 AS (SELECT session_id, step_idx, address, sum(weight * gate) AS weight, max(gate) AS gate FROM {p}g1 GROUP BY ALL),
{sql_strongest(f'{p}g2', 24, f'{p}wt', ', gate')}"""


def sql_masses(p: str = "") -> str:
    return f"""
{sql_strongest(f'{p}wt', 16, f'{p}tr')},
{p}am AS (SELECT session_id, address, sum(weight) AS mass FROM {p}tr GROUP BY ALL),
{p}em AS (SELECT l.session_id, l.address AS src, r.address AS dst, sum(sqrt(l.weight * r.weight)) AS mass FROM {p}tr l JOIN {p}tr r ON r.session_id = l.session_id AND r.step_idx = l.step_idx + 1 GROUP BY ALL)"""


SQL_EDGE_WEIGHTS = f"{SQL_STEPS},{sql_items()},{sql_gated()}"


@query(
    f"""WITH {SQL_CHUNKS}, k0 AS (SELECT session_id, step_idx, {sql_tokens('chunk')} AS k FROM ch),
g AS (SELECT session_id, step_idx, 1 AS n, unnest(k) AS gram FROM k0 UNION ALL SELECT session_id, step_idx, 2, unnest(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i+1], '__'))) FROM k0 UNION ALL SELECT session_id, step_idx, 3, unnest(list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i+2], '__'))) FROM k0),
f AS (SELECT gram, ln((1.0 + (SELECT count(DISTINCT session_id) FROM ch)) / (1.0 + count(DISTINCT session_id))) + 1.0 AS idf FROM g GROUP BY gram),
c AS (SELECT session_id, step_idx, n, gram, count(*) AS c FROM g GROUP BY ALL),
h AS (SELECT session_id, step_idx, {hashing.fnv_sql("n || '::' || head || '::' || gram", N)} AS address, CASE WHEN n = 1 THEN 1.0 ELSE 1.2 + 0.2 * n END * sqrt(c) * idf / 4 AS weight FROM c JOIN f USING (gram), range(4) r(head)),
s AS (SELECT session_id, step_idx, address, sum(weight) AS weight FROM h GROUP BY ALL), {sql_strongest('s', 24, 'o')} SELECT session_id, step_idx, address, round(weight, 5) AS weight FROM o"""
)
def naive_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and n-gram addresses of each chunk under four hash heads."""
    rows = chunks(spark, sf_dir)
    return _shown(A.plain(A.naive_items(rows, A.gram_idf(rows)))).drop("gate")


@query()
def naive_address_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive encoder whole: all addresses of each chunk, gated by a vector of the last 64 tokens, with the idf of whole sessions."""
    rows = catalogue.sessions(catalogue.turns(read(spark, sf_dir, "conversations")))
    return _shown(A.naive_gated(S.chunks(rows), A.gram_idf(rows.select("session_id", F.col("text").alias("chunk")))))


def _shown(weights: DataFrame) -> DataFrame:
    return weights.select("session_id", F.col("step_idx").cast("long").alias("step_idx"), F.col("address").cast("long").alias("address"), F.round("weight", 5).alias("weight"), F.round("gate", 5).alias("gate"))


@query(f"WITH {SQL_EDGE_WEIGHTS} SELECT session_id, step_idx, address, round(weight, 5) AS weight, round(gate, 5) AS gate FROM wt")
def edge_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated addresses of constraint edges, the 24 strongest of each step."""
    return _shown(A.edge_weights(steps(spark, sf_dir)))


@query()
def edge_address_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the strongest addresses of each step carried into the next: a recurrence, so SQL has no form of it."""
    rows = steps(spark, sf_dir)
    found = A.edge_weights(rows).groupBy(*A.STEP).agg(F.array_sort(F.collect_list(F.struct("address", "weight"))).alias("addresses"))  # 24 at most
    return A.carried(rows.select(*A.STEP, F.col("current").alias("state"), S.step_weight().alias("step_weight")).join(found, A.STEP))


@query()
def state_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated addresses of rule states: nodes, roles, schemas, acts, edges to the state before and what it carries over."""
    return _shown(E.addresses_of(rule_rows(spark, sf_dir), "state"))


@query(
    f"""WITH {SQL_STATES}, {SQL_EVENTS}, p AS (SELECT *, lag(event) OVER q AS pe, lag(relation_signature) OVER q AS pr FROM ev WINDOW q AS (PARTITION BY session_id ORDER BY step_idx)),
i AS (SELECT session_id, step_idx, 'finite_event::' || event AS feature, 3.0 + event_strength AS weight FROM p UNION ALL SELECT session_id, step_idx, 'finite_relation::' || event || '::' || relation_signature, 2.6 FROM p
  UNION ALL SELECT session_id, step_idx, 'finite_topic::' || event || '::' || topic_shift, 2.2 FROM p UNION ALL SELECT session_id, step_idx, 'finite_causal::' || event || '::' || causal_shift, 2.1 FROM p
  UNION ALL SELECT session_id, step_idx, 'finite_edge::' || pe || '=>' || event, 3.6 + 0.4 * event_strength FROM p WHERE pe IS NOT NULL UNION ALL SELECT session_id, step_idx, 'finite_pair::' || pe || '/' || pr || '=>' || event || '/' || relation_signature, 3.0 FROM p WHERE pe IS NOT NULL),
s AS (SELECT session_id, step_idx, {hashing.fnv_sql('feature', N)} AS address, sum(weight) AS weight FROM i GROUP BY ALL), {sql_strongest('s', 24, 'o')} SELECT session_id, step_idx, address, round(weight, 5)::DOUBLE AS weight FROM o"""
)
def finite_event_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the finite event alphabet."""
    return _shown(E.ungated(E.encoder_rows(S.events(rule_rows(spark, sf_dir)), "finite")).withColumn("gate", F.lit(1.0))).drop("gate")


@query()
def finite_event_address_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finite event encoder whole: gated, with what the step before carries over; a recurrence, so SQL has no form of it."""
    return _shown(E.addresses_of(S.events(rule_rows(spark, sf_dir)), "finite"))


@query()
def canonical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical state tokens: families and roles without their words."""
    return A.canonical_tokens(rule_rows(spark, sf_dir)).select("session_id", "step_idx", F.array_join("tokens", ",").alias("tokens"))


@query(f"WITH {SQL_EDGE_WEIGHTS}, {sql_masses()} SELECT session_id, address, round(mass, 5) AS mass FROM am")
def address_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.address_mass(A.edge_weights(steps(spark, sf_dir)))
    return made.select("session_id", F.col("address").cast("long").alias("address"), F.round("mass", 5).alias("mass"))


@query(f"WITH {SQL_EDGE_WEIGHTS}, {sql_masses()} SELECT session_id, src, dst, round(mass, 5) AS mass FROM em")
def edge_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.edge_mass(A.edge_weights(steps(spark, sf_dir)))
    return made.select("session_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("mass", 5).alias("mass"))


def _supports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The five best documents of each question by lexical overlap, and their support; both sides are encoded in one pass."""
    q = read(spark, sf_dir, "benchmark").select("item_id", "text")
    s = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), "text")
    pool = cut(rank.lexical_nearest(q, s, 5).select("item_id", "session_id", "lexical"))
    held = s.join(pool.select("session_id").distinct(), "session_id", "left_semi")
    masses = A.encoded(q, held, S.lexical_steps)
    return pool, A.support_of(masses, pool.select("item_id", "session_id"))


def _sql_chunks_of(source: str, out: str) -> str:
    return f"""{out}d AS (SELECT session_id, list_filter({sql_parts('text')}, lambda x: length(x) >= 8) AS s, {sql_tokens('text')} AS k FROM {source}),
{out}c AS (SELECT session_id, CASE WHEN len(s) > 0 THEN list_transform(range(1, len(s) + 1, 2), lambda i: array_to_string(s[i:i+1], '. ')) ELSE list_transform(range(1, len(k) + 1, 24), lambda i: array_to_string(k[i:i+23], ' ')) END AS c FROM {out}d),
{out}ch AS (SELECT session_id, generate_subscripts(c, 1) - 1 AS step_idx, unnest(c) AS chunk FROM {out}c)"""


SQL_SUPPORT = f"""{SQL_SCORES}, pool AS (SELECT item_id, session_id, lexical FROM rk WHERE rank <= 5),
qs AS (SELECT item_id AS session_id, text FROM benchmark), hs AS (SELECT doc_id AS session_id, text FROM documents WHERE doc_id IN (SELECT session_id FROM pool)),
{_sql_chunks_of('qs', 'q_')}, {_sql_chunks_of('hs', 'h_')}, {sql_steps('q_ch', 'q_')}, {sql_steps('h_ch', 'h_')}, {sql_items('q_')}, {sql_items('h_')}, {sql_gated('q_')}, {sql_gated('h_')}, {sql_masses('q_')}, {sql_masses('h_')},
tot AS (SELECT 'q' AS side, session_id, sum(m) + 1e-12 AS total FROM (SELECT session_id, mass AS m FROM q_am UNION ALL SELECT session_id, 0.65 * mass FROM q_em) GROUP BY session_id UNION ALL SELECT 'h', session_id, sum(m) + 1e-12 FROM (SELECT session_id, mass AS m FROM h_am UNION ALL SELECT session_id, 0.65 * mass FROM h_em) GROUP BY session_id),
sh AS (SELECT item_id, session_id, sum(x) AS shared FROM (
  SELECT item_id, p.session_id, least(a.mass, b.mass) AS x FROM pool p JOIN q_am a ON a.session_id = p.item_id JOIN h_am b ON b.session_id = p.session_id AND b.address = a.address
  UNION ALL SELECT item_id, p.session_id, 0.65 * least(a.mass, b.mass) FROM pool p JOIN q_em a ON a.session_id = p.item_id JOIN h_em b ON b.session_id = p.session_id AND b.src = a.src AND b.dst = a.dst) GROUP BY ALL),
su AS (SELECT p.item_id, p.session_id, p.lexical, coalesce(shared, 0) / sqrt(coalesce(a.total, 1e-12) * coalesce(b.total, 1e-12)) AS support FROM pool p LEFT JOIN sh USING (item_id, session_id) LEFT JOIN tot a ON a.side = 'q' AND a.session_id = p.item_id LEFT JOIN tot b ON b.side = 'h' AND b.session_id = p.session_id)"""


@query(f"WITH {SQL_SUPPORT} SELECT item_id, session_id, round(support, 5) AS support FROM su", small=True)
def support_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared address and edge mass of each question and its five candidates."""
    return _supports(spark, sf_dir)[1].select("item_id", "session_id", F.round("support", 5).alias("support"))


@query(f"WITH {SQL_SUPPORT}, h AS (SELECT item_id, session_id, round(0.7 * lexical + 0.3 * support, 6) AS score FROM su) SELECT item_id, session_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, session_id) AS rank FROM h", small=True)
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each question by 0.7 of the lexical score and 0.3 of the support."""
    pool, support = _supports(spark, sf_dir)
    return A.hybrid(pool, support)


@query()
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and stored bytes of each session; deflate has no SQL form."""
    rows = steps(spark, sf_dir)
    weights = A.edge_weights(rows)
    texts = chunks(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_idx", "chunk"))), lambda x: x["chunk"]), "\n").alias("text"))
    return A.archive_stats(texts, A.address_mass(weights), A.edge_mass(weights))


@query()
def storage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.storage_summary(archive_stats(spark, sf_dir))
