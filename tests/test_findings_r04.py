"""What the fourth round's findings are held to."""

import math

import numpy as np

from memloom import plans
from memloom.functions import hashing
from memloom.operators import addresses as A
from memloom.operators import codec
from memloom.operators import volumes as V
from memloom.plans import volumes as plan_volumes


def test_gates_of_sums_that_cancel_have_no_rounding_left(spark, sf_dir):
    """a feature whose product with its context cancels has the gate of 0 exactly, in whatever order the sum is made."""
    from memloom.plans.states import steps

    none = 1 / (1 + math.exp(-0.6))
    near = [r.gate for r in A.edge_weights(steps(spark, sf_dir)).where(f"abs(gate - {none}) < 1e-6").select("gate").collect()]
    assert near and max(abs(g - none) for g in near) < 1e-12


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_volumes_are_not_unfolded_by_direction(spark, sf_dir):
    """no row for each voxel, direction and step is made or shuffled."""
    for name in ("direction_response", "active_dirs", "codec_roundtrip"):
        assert "Generate" not in _plan(plans.QUERIES[name](spark, sf_dir))


def test_codec_cuts_no_lineage_for_each_direction(spark, sf_dir, monkeypatch):
    """volumes are encoded in one pass; what is written in between is boxes and planted tubes."""
    cuts = []
    for module in (codec, plan_volumes):
        monkeypatch.setattr(module, "cut", lambda df: (cuts.append(df), df)[1])
    for name, most in (("codec_roundtrip", 0), ("box_decode", 1), ("synthetic_recall", 2)):
        cuts.clear()
        plans.QUERIES[name](spark, sf_dir)
        assert len(cuts) <= most


def test_best_responses_do_not_depend_on_the_order_of_voxels(spark):
    """directions of equal energy tie exactly, so the larger index comes first."""
    voxels = [((7 * i) % 12, (5 * i) % 12, (11 * i + i // 12) % 12, 0.1 + (i % 3) / 7) for i in range(144)]
    rows = [(n, *v) for n, order in ((1, voxels), (2, voxels[::-1]), (3, voxels[1::2] + voxels[::2])) for v in order]
    volume = V.packed(spark.createDataFrame(rows, "id long, t int, u int, v int, value double").coalesce(1))
    best = {}
    for r in V.best_responses(volume).collect():
        best.setdefault(r.dir, set()).add(r.best)
    assert len(best) == 13 and all(len(x) == 1 for x in best.values())


def test_texts_become_volumes_without_a_shuffle(spark, sf_dir):
    """tokens are neither shuffled nor joined with their idf."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text")
    made = _plan(V.packed_vectors(V.packed_text(texts, V.bucket_idf(texts, 144))))
    assert "Exchange" not in made and "Generate" not in made


def test_hashes_of_pairs_go_on_from_the_first_word():
    """pairs are hashed without making their text."""
    words = ["a", "word", "", "ab", "zähl", "x" * 300]
    first, second = np.repeat(np.arange(6), 6), np.tile(np.arange(6), 6)
    assert (hashing.fnv_joined(words, first, second) == hashing.fnv_many([f"{words[a]}__{words[b]}" for a, b in zip(first, second, strict=True)])).all()
    assert len(hashing.fnv_joined(words, first[:0], second[:0])) == 0


def test_patterns_are_answered_without_rows_by_voxel(spark, sf_dir):
    """F8: the shuffles carry a pattern twice, not its cells."""
    rows = V.edge_patterns(plan_volumes.edges(spark, sf_dir))
    made = V.pattern_answers(rows).cache()
    assert made.count() == rows.count() and made.where("not x > 0").count() == 0
    assert _plan(plans.QUERIES["pattern_address"](spark, sf_dir)).count("Generate") == 1


def test_tokens_of_turns_are_made_without_python(spark, sf_dir):
    """what belongs to a turn is worked out once for it, below its tokens; the table function is native."""
    made = _plan(plans.QUERIES["sql_tokens_of_turns"](spark, sf_dir))
    assert "Python" not in made and "UDTF" not in made and made.index("Generate") < made.rindex("regexp_replace")
