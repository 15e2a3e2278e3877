"""Streams against batches and the exact cosine ranking against plain numpy."""

import numpy as np
import pytest

from memloom.operators import rank
from memloom.plans import QUERIES


def test_the_stream_gives_the_rows_of_the_window(spark, sf_dir):
    rows = lambda name: sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
    assert rows("stream_step_lag") == rows("step_lag")


@pytest.mark.parametrize("block", [2, 1000])
def test_nearest_equals_numpy(spark, block):
    rng = np.random.Generator(np.random.PCG64(1))
    dim, k = 40, 3
    vectors = lambda n: np.where(rng.random((n, dim)) < 0.15, rng.random((n, dim)).round(2), 0.0)
    asked, held = vectors(7), vectors(600)
    held[5] = held[9]  # a tie
    held[11] = 0.0
    long = lambda m, name: spark.createDataFrame([(i, int(b), float(m[i, b])) for i in range(len(m)) for b in np.flatnonzero(m[i])], f"{name} long, bucket long, w double")
    got = {(r.item_id, r["rank"]): (r.session_id, r.cosine) for r in rank.nearest(long(asked, "item_id"), long(held, "session_id").repartition(3), dim, k, block=block).collect()}
    scores = np.round(asked @ held.T, 6)
    wanted = {}
    for i in range(len(asked)):
        best = sorted((-scores[i, j], j) for j in range(len(held)) if scores[i, j] > 0)[:k]
        wanted |= {(i, n): (j, -s) for n, (s, j) in enumerate(best, 1)}
    assert got.keys() == wanted.keys() and all(got[x][0] == wanted[x][0] and got[x][1] == pytest.approx(wanted[x][1]) for x in wanted)
