"""Text queries: catalogue, tokens, chunks, entities, topics, lexicons, compressed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import sql
from ..functions import text as T
from ..sources import catalogue
from .registry import query, read

# --- pieces of DuckDB SQL that mirror functions.text -------------------------------------------------------------------
Q = "'"


def sql_list(words) -> str:
    return "(" + ", ".join(Q + w.replace(Q, Q * 2) + Q for w in words) + ")"


def sql_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({t}, ''), '{lex.TOKEN_RE}'), lambda x: lower(x))"


def sql_parts(t: str) -> str:
    return rf"list_transform(regexp_split_to_array(coalesce({t}, ''), '[.!?\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13)))"


def sql_sentences(t: str) -> str:
    return f"list_filter({sql_parts(t)}, lambda x: length(x) > 3)"


def sql_words(t: str) -> str:
    return rf"regexp_extract_all(coalesce({t}, ''), '\S+')"


def sql_entities(t: str) -> str:
    clean = f"list_transform({sql_words(t)}, lambda w, i: struct_pack(i := i, w := regexp_replace(w, '[^A-Za-z]', '', 'g')))"
    named = f"list_filter({clean}, lambda s: s.i > 1 AND regexp_matches(s.w, '^[A-Z][a-z]+$') AND lower(s.w) NOT IN {sql_list(lex.STOP_WORDS)})"
    return f"list_slice({sql_distinct(f'list_transform({named}, lambda s: upper(s.w[1:3]))')}, 1, 3)"


def sql_distinct(a: str) -> str:
    """Distinct values in order of first use."""
    return f"list_reduce(list_transform({a}, lambda x: [x]), lambda p, q: CASE WHEN list_contains(p, q[1]) THEN p ELSE list_concat(p, q) END, CAST([] AS VARCHAR[]))"


def sql_normal(t: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', ' ', 'g'))"


def sql_labels(t: str, lexicon) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower(coalesce({t}, '')), {Q}{w}{Q}) THEN {Q}{name}{Q} END" for w, name in lexicon)
    return f"list_slice({sql_distinct(f'list_filter([{cases}], lambda x: x IS NOT NULL)')}, 1, 3)"


def sql_scene_part(t: str, rules, at: int, other: str) -> str:
    said = "".join(f" WHEN {' OR '.join(f'contains(lower(coalesce({t}, {Q}{Q})), {Q}{w}{Q})' for w in r[0])} THEN {r[at] if isinstance(r[at], float) else Q + r[at] + Q}" for r in rules)
    return f"CASE{said} ELSE {other} END"


#: Topics of a table d(id, t): weight by token, ties by first use.
SQL_TOPICS = rf"""
tk AS (SELECT id, unnest(regexp_extract_all(coalesce(t, ''), '{lex.TOKEN_RE}')) AS w, generate_subscripts(regexp_extract_all(coalesce(t, ''), '{lex.TOKEN_RE}'), 1) AS i FROM d),
tw AS (SELECT id, lower(w) AS w, min(i) AS i, sum(1 + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '^.+[A-Z_-]') THEN 2 ELSE 0 END) AS n
       FROM tk WHERE lower(w) NOT IN {sql_list(lex.STOP_WORDS)} AND length(w) >= 3 GROUP BY id, lower(w)),
tp AS (SELECT id, list(w ORDER BY n DESC, i) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM tw) WHERE r <= 3 GROUP BY id)"""

#: Key sentence of a table d(id, t).
SQL_KEY = f"""
sn AS (SELECT id, unnest({sql_sentences('t')}) AS s, generate_subscripts({sql_sentences('t')}, 1) AS i FROM d),
sc AS (SELECT id, s, i, {' + '.join(f"CASE WHEN contains(lower(s), '{w}') THEN 2 ELSE 0 END" for w in lex.DECISION_WORDS)}
         + CASE WHEN length(s) < 80 THEN 1 ELSE 0 END + CASE WHEN length(s) < 40 THEN 1 ELSE 0 END - CASE WHEN length(s) > 150 THEN 2 ELSE 0 END AS score FROM sn),
ky AS (SELECT id, CASE WHEN length(s) > 55 THEN s[1:52] || '...' ELSE s END AS key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM sc) WHERE r = 1)"""


@query(
    """
SELECT 'conv_' || conv_id AS session_id, trim(coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text,
       count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id"""
)
def session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the text of their user turns."""
    return catalogue.sessions(catalogue.turns(read(spark, sf_dir, "conversations")))


@query(
    """
WITH t AS (SELECT conv_id, turn, trim(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user' AND trim(text) <> ''),
u AS (SELECT conv_id, string_agg(s, ' ' ORDER BY turn) AS c FROM t WHERE r <= 4 GROUP BY conv_id),
a AS (SELECT conv_id, trim(coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_filter(list_transform(list_slice(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 8), lambda x: trim(x)), lambda x: x <> '') AS s FROM a)
SELECT 'conv_' || p.conv_id AS session_id, substr(CASE WHEN length(coalesce(c, '')) >= 80 THEN c ELSE array_to_string(s, ' ') END, 1, 1600) AS compact FROM p LEFT JOIN u USING (conv_id)"""
)
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four user turns, or the first eight sentences where those are short; 1,600 characters at most."""
    turns = catalogue.turns(read(spark, sf_dir, "conversations"))
    return catalogue.compact(turns)


@query(
    f"""
WITH d AS (SELECT doc_id, {sql_tokens('text')} AS k FROM documents), e AS (SELECT doc_id, unnest(k) AS token FROM d),
n AS (SELECT count(*) AS n FROM documents)
SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df, round(ln((1.0 + max(n)) / (1.0 + count(DISTINCT doc_id))) + 1.0, 6) AS idf FROM e, n GROUP BY token"""
)
def token_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses, documents and smoothed inverse document frequency of each token."""
    return catalogue.token_idf(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    rf"""
WITH d AS (SELECT doc_id, list_filter({sql_parts('text')}, lambda x: length(x) >= 8) AS s, {sql_tokens('text')} AS k FROM documents),
c AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN list_transform(range(1, len(s) + 1, 2), lambda i: array_to_string(s[i:i+1], '. '))
   ELSE list_transform(range(1, len(k) + 1, 24), lambda i: array_to_string(k[i:i+23], ' ')) END AS c FROM d)
SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS step_idx FROM c"""
)
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentence_chunks(F.col("text"))).alias("step_idx", "chunk")).select("doc_id", "chunk", F.col("step_idx").cast("long").alias("step_idx"))


@query(f"SELECT doc_id, len({sql_sentences('text')})::BIGINT AS n_sentences, array_to_string({sql_sentences('text')}, '|') AS sentences FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_join(s, "|").alias("sentences"))


@query(f"SELECT doc_id, array_to_string({sql_entities('text')}, '+') AS entities FROM documents")
def detect_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.entities(F.col("text")), "+").alias("entities"))


@query(f"WITH d AS (SELECT doc_id AS id, text AS t FROM documents), {SQL_TOPICS} SELECT d.id AS doc_id, coalesce(array_to_string(topics, '_'), '') AS topics FROM d LEFT JOIN tp USING (id)")
def extract_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.topics(F.col("text")), "_").alias("topics"))


@query(f"WITH d AS (SELECT doc_id AS id, text AS t FROM documents), {SQL_KEY} SELECT d.id AS doc_id, coalesce(key, '') AS key FROM d LEFT JOIN ky USING (id)")
def key_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.key_sentence(F.col("text")).alias("key"))


@query(
    f"""SELECT doc_id, array_to_string({sql_labels('text', lex.EMOTIONS)}, '+') AS emotions, array_to_string({sql_labels('text', lex.FLAGS)}, '+') AS flags,
 array_to_string({sql_labels('text', lex.TEST_EMOTIONS)}, '+') AS test_emotions, array_to_string({sql_labels('text', lex.TEST_FLAGS)}, '+') AS test_flags FROM documents"""
)
def lexicon_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotions and flags by the standard lexicons and by the test lexicons."""
    of = lambda lexicon: F.array_join(T.lexicon_labels(F.col("text"), lexicon), "+")
    return read(spark, sf_dir, "documents").select("doc_id", of(lex.EMOTIONS).alias("emotions"), of(lex.FLAGS).alias("flags"), of(lex.TEST_EMOTIONS).alias("test_emotions"), of(lex.TEST_FLAGS).alias("test_flags"))


_ALL_PARTS = f"""WITH d AS (SELECT doc_id AS id, text AS t FROM documents), {SQL_TOPICS}, {SQL_KEY},
r AS (SELECT d.id, {sql_entities('t')} AS e, coalesce(topics, CAST([] AS VARCHAR[])) AS tops, coalesce(key, '') AS key, {sql_labels('t', lex.TEST_EMOTIONS)} AS em, {sql_labels('t', lex.TEST_FLAGS)} AS fl
  FROM d LEFT JOIN tp USING (id) LEFT JOIN ky USING (id))"""


@query(
    f"""{_ALL_PARTS} SELECT id AS doc_id, concat_ws('|', '0:' || CASE WHEN len(e) > 0 THEN array_to_string(e, '+') ELSE '???' END,
  CASE WHEN len(tops) > 0 THEN array_to_string(tops, '_') ELSE 'misc' END, CASE WHEN key <> '' THEN '"' || key || '"' END,
  CASE WHEN len(em) > 0 THEN array_to_string(em, '+') END, CASE WHEN len(fl) > 0 THEN array_to_string(fl, '+') END) AS record FROM r"""
)
def compress_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lossy pipe record of each document."""
    return read(spark, sf_dir, "documents").select("doc_id", T.compress(F.col("text"), lex.TEST_EMOTIONS, lex.TEST_FLAGS).alias("record"))


@query(
    f"""{_ALL_PARTS} SELECT id AS doc_id, len(e)::BIGINT AS n_entities, len(tops)::BIGINT AS n_topics, len(em)::BIGINT AS n_emotions, len(fl)::BIGINT AS n_flags,
  coalesce(e[1], '') AS first_entity, coalesce(tops[1], '') AS first_topic, coalesce(fl[1], '') AS first_flag FROM r"""
)
def parse_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantics of a record as a struct, so that an absent part can't shift the others."""
    x = F.col("text")
    rows = read(spark, sf_dir, "documents").select("doc_id", T.entities(x).alias("e"), T.topics(x).alias("t"), T.lexicon_labels(x, lex.TEST_EMOTIONS).alias("m"), T.lexicon_labels(x, lex.TEST_FLAGS).alias("f"))
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    n = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", n("e").alias("n_entities"), n("t").alias("n_topics"), n("m").alias("n_emotions"), n("f").alias("n_flags"), first("e").alias("first_entity"), first("t").alias("first_topic"), first("f").alias("first_flag"))


@query(
    f"""SELECT 'conv_' || conv_id AS session_id, turn, {sql_scene_part('text', [(r[0], r[1]) for r in lex.SCENE_TONES], 1, "'neutral'")} AS tone,
 {sql_scene_part('text', [(r[0], r[2]) for r in lex.SCENE_TONES], 1, '0.4')}::DOUBLE AS uncertainty, {sql_scene_part('text', lex.SCENE_MODES, 1, "'discussion'")} AS mode,
 {sql_scene_part('text', [(r[0], r[1]) for r in lex.RECALL_SCENES], 1, "'neutral'")} AS recall_tone, {sql_scene_part('text', [(r[0], r[2]) for r in lex.RECALL_SCENES], 1, "'general_recall'")} AS recall_mode FROM conversations"""
)
def scene_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone, mode and uncertainty of each turn, by the retrieval rules and by the item builder's."""
    rows = catalogue.turns(read(spark, sf_dir, "conversations")).select("session_id", "turn", T.scene(F.col("content")).alias("s"), T.recall_scene(F.col("content")).alias("r"))
    return rows.select("session_id", "turn", "s.tone", "s.uncertainty", "s.mode", F.col("r.tone").alias("recall_tone"), F.col("r.mode").alias("recall_mode"))


_TASK = "CASE" + "".join(f" WHEN {' OR '.join(f'contains(lower(coalesce(text, {Q}{Q})), {Q}{w}{Q})' for w in these)} THEN '{name}'" for these, name in lex.TASK_RULES) + " ELSE 'event_recall' END"


@query(f"SELECT item_id, {_TASK} AS task_type, CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') END AS label, {sql_normal('text')} AS normal FROM benchmark")
def task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task type, snake-case label and normalised text of each question."""
    x = F.col("text")
    return read(spark, sf_dir, "benchmark").select("item_id", T.task_type(x).alias("task_type"), T.label(x).alias("label"), T.normalise(x).alias("normal"))


@query(
    f"""WITH q AS (SELECT conv_id, turn, text AS question, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS answer, conv_id * 1000 + turn AS id FROM conversations),
d AS (SELECT id, question || ' ' || answer AS t FROM q), {SQL_TOPICS},
c AS (SELECT q.*, list_filter({sql_distinct(f"list_concat(list_concat(coalesce(topics, CAST([] AS VARCHAR[])), {sql_entities('answer')}), [trim(answer[1:48])])")}, lambda x: x <> '')[1:3] AS cues, {sql_entities('question')} AS names FROM q LEFT JOIN tp USING (id)),
e AS (SELECT conv_id, turn, cues, list_filter(list_transform(list_concat(list_concat(cues, names), list_filter(string_split({sql_normal('question')}, ' '), lambda x: length(x) >= 5)), lambda x: {sql_normal('x')}), lambda x: length(x) >= 3) AS terms FROM c),
u AS (SELECT conv_id, turn, unnest(terms) AS x, generate_subscripts(terms, 1) AS i FROM e),
v AS (SELECT conv_id, turn, string_agg(x, ',' ORDER BY length(x) DESC, i) AS terms FROM (SELECT conv_id, turn, x, min(i) AS i FROM u GROUP BY ALL) GROUP BY conv_id, turn)
SELECT 'conv_' || conv_id AS session_id, turn, array_to_string(cues, ',') AS cues, coalesce(v.terms, '') AS terms FROM e LEFT JOIN v USING (conv_id, turn)"""
)
def weak_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak cues of a turn with its answer (the next turn), and the evidence terms made of them."""
    rows = catalogue.turns(read(spark, sf_dir, "conversations"))
    answer = F.coalesce(F.lead("content").over(Window.partitionBy("session_id").orderBy("turn")), F.lit(""))
    rows = rows.withColumn("answer", answer).withColumn("cues", T.weak_cues(F.col("content"), F.col("answer")))
    terms = T.evidence_terms(F.col("content"), F.col("cues"), T.entities(F.col("content")))
    return rows.select("session_id", "turn", F.array_join("cues", ",").alias("cues"), F.array_join(terms, ",").alias("terms"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, {sql_normal('text')} AS n FROM conversations WHERE role = 'user'),
b AS (SELECT item_id, list_filter(string_split({sql_normal('text')}, ' '), lambda x: length(x) >= 5)[1:4] AS terms FROM benchmark)
SELECT 'conv_' || conv_id AS session_id, item_id, min(turn) AS start_turn, max(turn) AS end_turn, 0.5::DOUBLE AS score
FROM t, b WHERE len(list_filter(terms, lambda w: contains(n, w))) > 0 GROUP BY conv_id, item_id"""
)
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question the first and last user turn of each session that holds one of its evidence terms.

    Turns and terms meet by a shared 3-gram of the term's head before the substring test,
    so the join is an equi-join and not a product of turns and questions.
    """
    from ..operators import rank

    turns = catalogue.turns(read(spark, sf_dir, "conversations"))
    return rank.evidence_spans(turns, read(spark, sf_dir, "benchmark"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, {sql_tokens('text')} AS k, {sql_normal('text')} AS n FROM conversations), e AS (SELECT conv_id, turn, unnest(k) AS token, generate_subscripts(k, 1) - 1 AS place FROM t)
SELECT 'conv_' || conv_id AS session_id, turn, place::INT AS place, token, len(k)::BIGINT AS n_tokens, length(n)::BIGINT AS n_plain FROM e JOIN t USING (conv_id, turn)"""
)
def sql_tokens_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every turn by the session's SQL functions: a table function, and two that are expressions."""
    sql.register(spark)
    rows = read(spark, sf_dir, "conversations")
    # What is the same for all tokens of a turn is worked out before its tokens are.
    turns = "SELECT concat('conv_', conv_id) AS session_id, turn, text, cast(size(ml_tokens(text)) AS BIGINT) AS n_tokens, cast(length(ml_normalise(text)) AS BIGINT) AS n_plain FROM {rows}"
    return spark.sql(f"SELECT session_id, turn, t.place, t.token, n_tokens, n_plain FROM ({turns}), LATERAL ml_each_token(text) t", rows=rows)
