"""Exact dedup, near dedup and mixing against brute force, and their defined results on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from memloom.llm import exact_dedup, minhash, mixing
from memloom.llm import queries as Q
from memloom.llm.common import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(texts: dict, width: int, percent: int) -> dict:
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                one, two = sorted((find(a), find(b)))
                parent[two] = one
    return {i: find(i) for i in ids}


def test_near_dedup_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in Q.op5_minhash_dedup(spark, sf_dir).collect()}
    wanted = brute_components(texts, 2, 80)
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(r.n_shingles == len(shingles(texts[i], 2)) and r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("short,hubs", [(2, 1), (2, 2), (3, 1)])
def test_rounds_of_hubs_lose_no_link(spark, short, hubs):
    """A large group of near copies of which many pairs are just below the limit, and a passage that all others share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage, texts = [word() for _ in range(60)], [word() for _ in range(25)], {}
    for i in range(90):
        texts[i] = " ".join(w if rng.random() > rng.choice([0.01, 0.05, 0.1]) else word() for w in base)
    for i in range(90, 130):
        texts[i] = " ".join(passage + [word() for _ in range(rng.randint(5, 40))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(docs, width=2, percent=80, short=short, hubs=hubs).collect()}
    assert got == brute_components(texts, 2, 80)


def test_near_dedup_default_takes_five_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j z"), (3, "A B c d e f g h i j k")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(docs).collect()} == brute_components({1: "a b c d e f g h i j k", 2: "a b c d e f g h i j z", 3: "a b c d e f g h i j k"}, 5, 80)


def test_match_threshold_misses_one_pair_in_100000():
    from math import comb

    t = minhash.match_threshold(48, 0.8)
    below = lambda t: sum(comb(48, i) * 0.8**i * 0.2 ** (48 - i) for i in range(t))
    assert below(t) <= 1e-5 < below(t + 1)


def test_components_of_stars_and_chains_take_no_round_more_than_they_need(spark, monkeypatch):
    rounds, write = [], minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, label: (rounds.append(label), write(df, label))[1])
    star = spark.createDataFrame([(1, n) for n in range(2, 40)] + [(1, 2), (3, 1), (5, 5)], "a long, b long")
    assert sorted(map(tuple, minhash.components(star).collect())) == [(n, 1) for n in range(2, 40)]
    assert rounds == ["star"]
    chain = spark.createDataFrame([(n, n + 1) for n in range(1, 30)] + [(50, 41), (50, 42), (60, 42)], "a long, b long")
    assert sorted(map(tuple, minhash.components(chain).collect())) == [(n, 1) for n in range(2, 31)] + [(n, 41) for n in (42, 50, 60)]
    assert not minhash.components(chain.where("a < 0")).count()


def test_long_lists_and_hubs_are_dealt_over_shards(spark, monkeypatch):
    """With shards of four members every list, every class and every digest with more is split."""
    from memloom.llm import common

    monkeypatch.setattr(minhash, "hot_keys", lambda counts, total, least=512: common.hot_keys(counts, 0, 4))
    monkeypatch.setattr(minhash, "hot_first", lambda *a: common.hot_first(*a, least=2))
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(60)], {}
    for i in range(60):
        texts[i] = " ".join(w if rng.random() > 0.04 else word() for w in base)
    for i in range(60, 80):
        texts[i] = texts[i % 3]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(docs, width=2, hubs=2, short=3).collect()}
    assert got == brute_components(texts, 2, 80)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    b = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(3, b), (5, "another text of its own words that nothing else here resembles"), (5, b + " extra"), (None, b + " more"), (None, "some words that only this row without an id has")]
    got = minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r.component_id, r.doc_id if r.doc_id is not None else -1, r.kept, r.first) for r in got if r.component_id is not None)
    assert found == [(3, -1, False, False), (3, 3, True, True), (3, 5, False, False), (5, 5, True, True)]
    assert [(r.doc_id, r.kept, r.first) for r in got if r.component_id is None] == [(None, True, True)]


def test_near_dedup_odd_rows(clashing, empty):
    got = minhash.near_dedup(clashing, width=2).collect()
    assert len(got) == clashing.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i in (1, 2, 3):
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert {r.component_id for r in by[4] + by[5]} == {4} and not by[5][0].kept
    assert by[6][0].n_shingles == 1 and by[8][0].n_shingles == 1
    assert minhash.near_dedup(empty).count() == 0


def test_exact_dedup_equals_sql(same_rows):
    same_rows(Q.op9_exact_dedup, exact_dedup.ORACLE_SQL)


def test_exact_dedup_odd_rows(spark, clashing, empty):
    index = exact_dedup.DigestIndex(spark, "odd_digests")
    index.drop()
    got = exact_dedup.exact_dedup(clashing, index).collect()
    assert len(got) == clashing.count()
    by = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert by[(5, 5, 3, True)] == 1 and by[(4, 5, 3, False)] == 2
    blank = hashlib.sha256(b"").hexdigest()
    # Null counts as empty; a null id sorts below the others.
    assert {(r.keep_id, r.group_size) for r in got if r.text_sha256 == blank} == {(2, 3)}
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_dedup(empty, index).count() == 0


def test_digest_index_persists_between_batches(spark):
    index = exact_dedup.DigestIndex(spark, "two_batches", buckets=4)
    index.drop()
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    two = spark.createDataFrame([(7, "B"), (8, "c"), (9, "c")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.exact_dedup(one, index).collect() if r.kept} == {2, 3}
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(two, index).collect()}
    assert {i for i, r in got.items() if r.kept} == {9}
    assert got[7].seen_before and got[7].keep_id == 2 and not got[9].seen_before
    assert spark.table("two_batches").count() == 3


def test_exact_dedup_in_parts_equals_one_batch(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd):
        whole, parts = (exact_dedup.DigestIndex.temporary(spark, "digests", buckets=4) for _ in range(2))
        one = exact_dedup.exact_dedup(docs, whole)
        many = exact_dedup.exact_dedup(docs, parts, batch="b", parts=4)
        key = lambda r: repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256, r.seen_before))
        assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
        # Later parts met the earlier ones: no digest is stored twice.
        stored = parts.known()
        assert stored.count() == stored.select("text_sha256").distinct().count() == whole.known().count()
        whole.drop(), parts.drop()


def test_new_digests_are_found_by_a_sort_merge_anti_join_without_a_shuffle_of_the_index(spark):
    index = exact_dedup.DigestIndex.temporary(spark, "digests", buckets=4)
    groups = spark.range(100).select(exact_dedup.digest("id").alias("text_sha256"), "id").withColumnRenamed("id", "keep_id")
    index.append(groups, "one")
    joined = index.new_digests(groups.repartition(4, "text_sha256"), "two")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1
    assert joined.count() == 0 and index.new_digests(groups, "one").count() == 100
    index.drop()


def test_a_batch_that_failed_after_its_append_is_repeated(spark):
    index = exact_dedup.DigestIndex.temporary(spark, "digests", buckets=4)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(7, "B"), (8, "c"), (9, "c")], "doc_id long, text string")
    exact_dedup.exact_dedup(one, index, batch="one")
    first = exact_dedup.exact_dedup(two, index, batch="two")  # appended, and its rows are never read
    del first
    got = {r.doc_id: (r.kept, r.seen_before, r.keep_id) for r in exact_dedup.exact_dedup(two, index, batch="two").collect()}
    assert got == {7: (False, True, 2), 8: (False, False, 9), 9: (True, False, 9)}
    assert index.known().count() == 3
    index.compact()
    assert index.known().count() == 3 and {r.batch for r in index.known().collect()} == {"compacted"}
    assert not [r for r in exact_dedup.exact_dedup(two, index, batch="three").collect() if r.kept]
    index.drop()


def test_mixing_equals_sql(same_rows):
    same_rows(Q.op10_mixing, mixing.ORACLE_SQL)


def test_mixing_meets_targets(spark, sf_dir):
    got = Q.op10_mixing(spark, sf_dir).collect()
    total = sum(r["size"] for r in got)
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        known = sources.setdefault(r.source, [r.source_size, r.target, 0, 0])
        known[2] += r.taken
        known[3] = max(known[3], r["size"])
    assert abs(sum(x[1] for x in sources.values()) - total) < 1e-6 * total
    for size, target, taken, largest in sources.values():
        # Documents lie in order of size, so what is taken is off by the largest one at most.
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= largest + 1
    again = Q.op10_mixing(spark, sf_dir).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def brute_targets(sizes: dict, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        over = {s for s in names if s not in held and left * weight[s] / free > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in held else left * weight[s] / free for s in names}
        held |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 5, "b": 5, None: 900}, {"a": 1, "b": 2, "c": 300, "d": 4, None: 1}, {"z": 10}, {"a": 0, "b": 7}])
def test_source_targets_reshare_the_excess(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    for source, target in brute_targets(sizes).items():
        assert abs(got[source] - target) < 1e-6


def test_mixing_odd_rows(clashing, empty):
    got = mixing.mix(clashing).collect()
    assert len(got) == clashing.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix(empty).count() == 0
