"""The codec against a plain one that loops over voxels, and its queries."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom import lexicons as lex
from memloom import plans
from memloom.operators import codec as C
from memloom.operators import volumes as V

SHAPE = (7, 8, 9)
PLACES = list(itertools.product(*map(range, SHAPE)))


def inside(p):
    return all(0 <= c < n for c, n in zip(p, SHAPE, strict=True))


def line(c, d):
    return [p for s in range(-4, 5) if inside(p := tuple(a + s * b for a, b in zip(c, lex.DIRECTIONS[d], strict=True)))]


def near(c):
    return [p for o in itertools.product((-1, 0, 1), repeat=3) if inside(p := tuple(a + b for a, b in zip(c, o, strict=True)))]


def stored(values):
    scale = max(max((abs(x) for x in values), default=0) / 32767, 1e-8)
    return [round(round(x / scale, 4)) * scale for x in values]


def response(x, d):
    return {p: round(sum(x[q] ** 2 for q in line(p, d)), 9) for p in PLACES}


def plain_codec(x):
    """Decoded volume, directions of the tubes in their order, and junctions."""
    base = x
    for axis in range(3):
        base = np.array([[[np.mean([base[tuple(min(max(c + (e if a == axis else 0), 0), SHAPE[a] - 1) for a, c in enumerate((t, u, v)))] for e in range(-2, 3)]) for v in range(SHAPE[2])] for u in range(SHAPE[1])] for t in range(SHAPE[0])])
    out = np.array(stored(base.ravel())).reshape(SHAPE)
    left = x - out
    best = {d: max(response(left, d).values()) for d in range(13)}
    ranked = sorted(best, key=lambda d: (best[d], d), reverse=True)
    near_best = [d for d in ranked[:8] if best[d] >= 0.25 * max(best[ranked[0]], 1e-8)]
    active = near_best if sum(b >= 0.25 * max(best[ranked[0]], 1e-8) for b in best.values()) >= 4 else ranked[:4]
    used, masks = [], []
    for d in sorted(active, key=lambda d: (-round(best[d], 9), d)):
        r = response(left, d)
        centre = min(PLACES, key=lambda p: (-r[p], p))  # noqa: B023
        signal = stored([sum(left[q] for q in near(p)) / 27 for p in line(centre, d)])
        if not any(signal):
            continue
        mask = set()
        for p, s in zip(line(centre, d), signal, strict=True):
            for q in near(p):
                out[q] += s
                left[q] -= s
                mask.add(q)
        used.append(d)
        masks.append(mask)
    crossing = sorted((p for p in PLACES if sum(p in m for m in masks) >= 2), key=lambda p: (-round(left[p] ** 2, 9), p))[:64]
    first = {p: i for i, p in enumerate(crossing)}
    joints = [p for i, p in enumerate(crossing) if all(first.get(tuple(a + b for a, b in zip(p, o, strict=True)), i) >= i for o in itertools.product(range(-2, 3), repeat=3))][:10]
    for c in joints:
        patch = stored([left[q] for q in near(c)])
        for q, s in zip(near(c), patch, strict=True):
            left[q] -= s
            out[q] += s
    kept = sorted(PLACES, key=lambda p: (-round(abs(left[p]), 9), p))[:512]
    for p, s in zip(kept, stored([left[p] for p in kept]), strict=True):
        out[p] += s
    return out, used, joints


@pytest.fixture(scope="module")
def dense():
    made = {}
    for i, n in ((1, 400), (2, 40)):
        rng = np.random.default_rng(i)
        x = np.zeros(SHAPE)
        for p in rng.permutation(len(PLACES))[:n]:
            x[PLACES[p]] = rng.normal()
        for k, (d, c) in enumerate(((0, (3, 2, 2)), (5, (3, 4, 4)), (9, (2, 4, 6)), (10, (3, 2, 4)))):
            for p in line(c, d):
                for q in near(p):
                    x[q] += 2.0 - 0.3 * k + 0.1 * p[0]
        made[i] = x
    return made


@pytest.fixture(scope="module")
def archived(spark, dense):
    rows = [(i, *p, float(x[p])) for i, x in dense.items() for p in PLACES if x[p] != 0]
    volume = spark.createDataFrame(rows, "id long, t int, u int, v int, value double")
    return volume, C.encode(volume, SHAPE)


def test_codec_equals_plain_one(dense, archived):
    volume, archive = archived
    tubes, joints = defaultdict(set), defaultdict(set)
    for r in archive.tubes.collect():
        tubes[r.id].add(r.dir)
    for r in archive.cells.collect():
        joints[r.id].add((r.jt, r.ju, r.jv))
    got = {i: np.zeros(SHAPE) for i in dense}
    for r in C.decode(archive, SHAPE).collect():
        got[r.id][r.t, r.u, r.v] = r.value
    errors = {r.id: r for r in V.error(volume, C.decode(archive, SHAPE), SHAPE).collect()}
    for i, x in dense.items():
        wanted, used, points = plain_codec(x.copy())
        assert tubes[i] == set(used) and joints[i] == set(points) and len(used) >= 4 and points
        assert np.abs(got[i] - wanted).max() < 1e-6
        assert errors[i].rel_l2 == pytest.approx(math.sqrt(((x - wanted) ** 2).sum() / (x**2).sum()), abs=1e-6)


def test_a_box_is_decoded_alone(spark, archived):
    _, archive = archived
    asked = spark.createDataFrame([(7, 1, 1, 0, 0, 0, 6, "text"), (8, 2, 0, 0, 1, 2, 3, "video"), (9, 2, 1, 1, 0, 0, 6, "image")], "query_id long, id long, qt int, qu int, qv int, q0 int, q1 int, q_modality string")
    whole = {(r.id, r.t, r.u, r.v): r.value for r in C.decode(archive, SHAPE).collect()}
    points = defaultdict(list)
    for r in archive.points.collect():
        points[r.id, r.dir].append((r.t, r.u, r.v))
    wanted = {}
    best = V.retrieve_tubes(archive.tubes, asked).collect()
    assert best
    for q in {r.query_id for r in best}:
        own = [p for r in best if r.query_id == q for p in points[r.id, r.dir]]
        low, top = np.min(own, axis=0) - 2, np.max(own, axis=0) + 2
        vid = next(r.id for r in best if r.query_id == q)
        wanted |= {(q, *p): x for (i, *p), x in whole.items() if i == vid and (low <= p).all() and (p <= top).all()}
    got = {(r.query_id, r.t, r.u, r.v): r.value for r in C.decode_boxes(archive, asked, shape=SHAPE).collect()}
    assert got.keys() == wanted.keys()
    assert max(abs(got[k] - wanted[k]) for k in got) < 1e-9


def test_registered_roundtrip_is_close(spark, sf_dir):
    got = plans.QUERIES["codec_roundtrip"](spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max("rel_l2").alias("worst")).first()
    assert got.n > 0 and got.worst < 0.5
