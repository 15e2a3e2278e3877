"""The corpus pipeline: each stage against brute force on what its predecessor kept."""

from collections import Counter

import corpus_pipeline as P
from test_dedup import LOWER, brute_components

from memloom.llm import mixing
from memloom.llm.common import documents, materialise, table


def test_stages_one_by_one(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert after.columns == columns
        kept[name] = (docs.collect(), after.collect())
        docs = after
    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone & toxic) >= 0.9 * len(toxic & {r.doc_id for r in before})
    before, after = kept["exact_dedup"]
    largest = {}
    for r in before:
        text = (r.text or "").translate(LOWER)
        largest[text] = max(largest.get(text, -1), r.doc_id)
    assert Counter(r.doc_id for r in after) == Counter(largest.values())
    before, after = kept["near_dedup"]
    groups = brute_components({r.doc_id: r.text for r in before}, 5, 80)
    assert {r.doc_id for r in after} == set(groups.values())
    before, after = kept["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect() if r.copies}
    assert Counter(r.doc_id for r in after) == Counter(copies)
    last = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert all(r.matches for r in last) and Counter(r.doc_id for r in last) == Counter(r.doc_id for r in after)


def test_run_and_odd_rows(spark, sf_dir, odd, clashing, empty):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert P.run(spark, sf_dir).count() > 0
    for docs in (odd, clashing, empty):
        before = docs.collect()
        key = lambda r: (r.doc_id, (r.text or "").translate(LOWER))
        # No row here is toxic.
        after = step(spark, P.toxic, docs, sf_dir)
        assert after.columns == docs.columns and sorted(map(repr, after.collect())) == sorted(map(repr, before))
        docs = step(spark, P.exact_copies, after, sf_dir)
        kept = docs.collect()
        # Of equal texts one row is left, that of the largest id; null ids are below all others.
        assert Counter(key(r)[1] for r in kept) == Counter({key(r)[1] for r in before})
        assert all(r.doc_id == max((x.doc_id for x in before if key(x)[1] == key(r)[1] and x.doc_id is not None), default=None) for r in kept)
        near = step(spark, P.near_copies, docs, sf_dir)
        # Rows 4 and 5 were copies; nothing else resembles.
        assert near.columns == docs.columns and sorted(map(repr, near.collect())) == sorted(map(repr, kept))
        mixed = step(spark, P.mixed, near, sf_dir)
        rows = mixed.collect()
        assert mixed.columns == docs.columns and {key(r) for r in rows} <= {key(r) for r in kept}
        assert max(Counter(map(repr, rows)).values(), default=0) <= 3
        last = step(spark, P.tokens, mixed, sf_dir).collect()
        assert len(last) == len(rows) and all(r.matches for r in last)


def step(spark, stage, docs, sf_dir):
    return materialise(stage(spark, docs, sf_dir), "odd")


def test_repeated_ids_lose_no_text(spark, sf_dir):
    b = "one two three four five six seven eight nine ten eleven twelve"
    a = "another text of its own words that nothing else here resembles"
    rows = [(3, b), (5, a), (5, b + " extra"), (None, b + " more"), (None, "x y"), (None, "x y"), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.text or "") for r in step(spark, P.near_copies, docs, sf_dir).collect()) == ["", "", a, b, "x y"]
    assert sorted((r.text or "") for r in step(spark, P.exact_copies, docs, sf_dir).collect()) == ["", a, b, b + " extra", b + " more", "x y"]
    taken = Counter((r.text or "") for r in step(spark, P.mixed, docs, sf_dir).collect())
    assert set(taken) <= {t or "" for _, t in rows} and taken[a] >= 1


def test_near_copies_of_one_id_leave_one_row(spark, sf_dir):
    b = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, b + " x", 1), (5, b, 2), (5, b, 3)], "doc_id long, text string, extra int")
    assert step(spark, P.near_copies, docs, sf_dir).count() == 1
