"""The whole path: what the evaluator makes of the engine's predictions against plain Python, and each protocol's variation."""

import re

import pytest
from pyspark.sql import functions as F

from memloom.operators import evaluate as E
from memloom.operators import extraction as X
from memloom.operators import protocols as P
from memloom.operators import rank
from memloom.plans import protocols as plan
from memloom.sources import catalogue, documents


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    turns = catalogue.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    items, runs, ranked = plan.runs(turns)
    return turns, items.cache(), runs.cache(), ranked.cache()


def test_every_item_is_ranked_at_every_stage(made):
    _, items, _, ranked = made
    per = {}
    for r in ranked.collect():
        per.setdefault((r.item_id, r.stage), []).append((r.rank, r.session_id))
    found = {i for i, _ in per}
    assert len(per) == 4 * len(found) and found <= {r.item_id for r in items.collect()}
    for rows in per.values():
        assert sorted(x for x, _ in rows) == list(range(1, len(rows) + 1)) and len(rows) <= 5
    for item in found:
        assert len({frozenset(s for _, s in per[item, stage]) for stage in (*P.STAGES, "shuffled")}) == 1


def test_means_of_recall_equal_plain_python(made):
    _, items, runs, ranked = made
    gold = {r.item_id: r.gold_sessions[0] for r in items.collect()}
    of_stage = {v: stage for v, stage, *_ in P.PROTOCOLS}
    got = {r.variant: r for r in E.summaries(E.item_metrics(items, runs)).where("task_type = 'all'").collect()}
    place = {(r.item_id, r.stage, r.session_id): r.rank for r in ranked.collect()}
    for variant, stage in of_stage.items():
        at = [place.get((i, stage, s)) for i, s in gold.items()]
        for k in (1, 3, 5):
            assert got[variant][f"recall_{k}"] == pytest.approx(sum(x is not None and x <= k for x in at) / len(at))
        assert got[variant]["mrr"] == pytest.approx(sum(1 / x for x in at if x) / len(at))
        assert got[variant].item_count == len(gold)


def test_protocols_vary_the_prediction(made):
    _, _, runs, _ = made
    by = {}
    for r in runs.collect():
        by.setdefault(r.item_id, {})[r.variant] = r
    for own in by.values():
        whole = own["fixed_budget"]
        assert own["full_question"].asDict() | {"variant": "fixed_budget"} == whole.asDict()
        for v in ("weak_cue", "stage_weak_cue"):
            assert own[v].pred_spans == [] and own[v].pred_entities == whole.pred_entities[:2] and own[v].pred_chain == whole.pred_chain[:2]
        assert own["chunk_shuffle"].pred_entities == whole.pred_entities[:1] and sorted(own["chunk_shuffle"].pred_sessions) == sorted(whole.pred_sessions)
        cut = own["relation_shuffle"]
        assert cut.pred_allowed == [] and cut.pred_forbidden == whole.pred_forbidden and cut.pred_turning is None and cut.pred_chain == [] and cut.pred_status == "outside"
        bare = own["constraint_perturbation"]
        assert bare.pred_forbidden == [] and bare.pred_actual_next is None and bare.pred_turning == whole.pred_turning and bare.pred_spans == whole.pred_spans


def test_spans_hold_the_evidence(made):
    turns, items, runs, _ = made
    said = {}
    for r in turns.where("role = 'user'").collect():
        said.setdefault(r.session_id, {})[r.turn] = " ".join(re.findall("[a-z0-9]+", (r.content or "").lower()))
    terms = {r.item_id: r.terms for r in plan.items_of(turns).collect()}
    for r in runs.where("variant = 'fixed_budget'").collect():
        (span,) = r.pred_spans
        own = said[span.session_id]
        hits = [t for t, text in own.items() if any(x in text for x in terms[r.item_id])] or list(own)
        assert (span.session_id, span.start_turn, span.end_turn) == (r.pred_sessions[0], min(hits), max(hits))


def test_total_is_the_weighted_sum(spark, sf_dir, made):
    _, items, runs, _ = made
    row = E.subscores(E.summaries(E.item_metrics(items, runs))).first()
    assert row.total == pytest.approx(sum(row[n] * w for n, w in E.WEIGHTS.items())) and 0 < row.total < 1


def test_pair_lexical_equals_brute_force(spark):
    questions = {1: "red red apple and pie", 2: "nothing of it", 3: "a b"}
    sessions = {7: "an apple is red", 8: "pie pie and apple", 9: ""}
    q = spark.createDataFrame(list(questions.items()), "item_id long, text string")
    s = spark.createDataFrame(list(sessions.items()), "session_id long, text string")
    got = {(r.item_id, r.session_id): r.lexical for r in rank.pair_lexical(q.select("item_id").crossJoin(s.select("session_id")), q, s).collect()}
    from collections import Counter

    count = lambda t: Counter(w for w in re.findall("[a-z]+", t) if len(w) >= 3)
    for i, a in questions.items():
        for j, b in sessions.items():
            x, y = count(a), count(b)
            assert got[i, j] == pytest.approx(sum(min(n, y[w]) for w, n in x.items()) / sum(x.values()) if x else 0.0, abs=1e-6)


def test_a_constraint_item_promotes_the_session_that_holds_its_cues(spark):
    items = spark.createDataFrame([("a", "q", ["big cue"], "constraint_recall"), ("b", "q", ["big cue"], "event_recall")], "item_id string, question string, cues array<string>, task_type string")
    ranked = spark.createDataFrame([(i, "full_question", s, n) for i in "ab" for n, s in enumerate(["s1", "s2", "s3"], 1)], "item_id string, stage string, session_id string, rank int")
    whole = spark.createDataFrame([("s1", "other words"), ("s2", "words"), ("s3", "the BIG, cue is here")], "session_id string, text string")
    queries = spark.createDataFrame([(f"refined_cue#{i}", "big cue words") for i in "ab"], "item_id string, text string")
    got = {(r.item_id, r.session_id): r["rank"] for r in P._promoted(ranked, items, queries, whole).collect()}
    assert [got["a", s] for s in ("s3", "s1", "s2")] == [1, 2, 3] and [got["b", s] for s in ("s1", "s2", "s3")] == [1, 2, 3]


JSON_CASES = [
    ('{"a": 1}', '{"a": 1}'), ('Sure: {"a": {"b": "}"}} and {"c": 1}', '{"a": {"b": "}"}}'), ('x {"a": "\\"}{"} y', '{"a": "\\"}{"}'),
    ("none here", None), ('broken {"a": "no end', None), ('open {"a": {"b": 1}', None), ("", None), (None, None), ('quote " before {"a": 1} z', '{"a": 1}'), ("{} tail {1}", "{} tail {1}"),
]


def test_first_json_object(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JSON_CASES)], "i int, t string")
    got = {r.i: r.o for r in rows.select("i", X.json_object_in(F.col("t")).alias("o")).collect()}
    assert got == {i: o for i, (_, o) in enumerate(JSON_CASES)}


def test_replies_that_do_not_fit_fall_back(spark):
    chunks = spark.createDataFrame([(s, i, f"word{i} more text") for s in ("a", "b", "c", "d") for i in range(2)], "session_id string, step_idx int, chunk string")
    one = '{"current_state": " Here ", "preferred_next_states": ["X", "x ", ""], "confidence": 9}'
    replies = [("a", f'ok {{"constraints": [{one}, {one}, {one}]}}'), ("b", f'{{"constraints": [{one}]}}'), ("c", '{"constraints": 5}'), ("d", "no")]
    got = X.extracted_steps(spark.createDataFrame(replies, "session_id string, payload string"), chunks).collect()
    assert {(r.session_id, r.step_idx, r.source) for r in got} == {(s, i, "reply" if s == "a" else "fallback") for s in "abcd" for i in range(2)}
    first = next(r for r in got if r.session_id == "a")
    assert (first.current, first.preferred, first.forbidden, first.confidence) == ("here", ["x"], [], 1.0)


def test_the_cache_asks_once(spark):
    cache = X.ReplyCache(spark, "replies_of_a_test")
    cache.drop()
    sessions = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", None)], "session_id string, text string")
    asked = []

    def ask(missing):
        asked.append({r.text for r in missing.collect()})
        return missing.select("key", F.when(F.col("text") == "one", "yes").alias("payload"))

    assert {(r.session_id, r.payload) for r in cache.replies(sessions, ask).collect()} == {("a", "yes"), ("b", "yes")}
    assert {(r.session_id, r.payload) for r in cache.replies(sessions, ask).collect()} == {("a", "yes"), ("b", "yes")}
    assert asked == [{"one", "two", None}, {"two", None}] and cache.stored().count() == 1
    cache.drop()


def test_readers_and_writer(spark, tmp_path):
    import json

    entry = lambda n: {"question_id": f"q{n}", "question": "Who?", "haystack_session_ids": [f"s{n}"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "hi"}]]}
    (tmp_path / "haystack.json").write_text(json.dumps([entry(n) for n in range(5)], indent=1))
    assert [r.question_id for r in documents.read_haystack(spark, str(tmp_path / "haystack.json"), 2).orderBy("pos").collect()] == ["q0", "q1"]
    rows = documents.read_haystack(spark, str(tmp_path / "haystack.json"))
    assert rows.count() == 5 and catalogue.haystack(rows.drop("pos")).where("session_id = 's3'").first().turns[0].content == "hi"
    item = {"item_id": "i1", "task_type": "event_recall", "question": "Q", "weak_cues": ["c"], "gold_spans": [{"session_id": "s", "start_turn": 1, "end_turn": 2, "score": 0.5}], "gold_scene": {"tone": "calm", "mode": "m", "uncertainty": 0.25}}
    (tmp_path / "items.json").write_text(json.dumps({"format_version": "2.0", "items": [item]}))
    read = documents.read_items(spark, str(tmp_path / "items.json")).first()
    assert (read.item_id, read.gold_spans[0].end_turn, read.gold_scene.uncertainty, read.gold_constraints) == ("i1", 2, 0.25, None)
    documents.write_document(rows.select("question_id"), str(tmp_path / "out"), "memory-bench", "record")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["record"]["question_id"] for x in lines} == {f"q{n}" for n in range(5)} and {(x["benchmark_name"], x["format_version"]) for x in lines} == {("memory-bench", "2.0")}
