"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from orthobox.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, digest int, n_links string"


def all_pairs(rows, threshold=0.95):
    """n_links, component_id and kept of each row, in the rows' order."""
    ok = [r[1] is not None and None not in r[1] and len(r[1]) > 0 and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((str(r[0]), links[i], str(least.get(find(i))), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def found(spark, rows, **more):
    made = embeddings.near_vectors(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3), "vec_id", "embedding", **more)
    assert made.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in made.collect())


def around(rng, centre, n, spread):
    x = centre / np.linalg.norm(centre) + spread * rng.standard_normal((n, len(centre))) / math.sqrt(len(centre))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("dim", [3, 64])
def test_equals_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    parts = [rng.standard_normal((60, dim))]
    for spread in (0.02, 0.1, 0.16, 0.2, 0.3):  # tight groups, and some whose pairs lie on both sides of the threshold
        parts.append(around(rng, rng.standard_normal(dim), 30, spread) * rng.uniform(0.1, 50))
    vectors = np.concatenate(parts)
    rows = [(i, v.tolist()) for i, v in zip(rng.permutation(len(vectors)).tolist(), vectors)]
    assert found(spark, rows, block=7) == all_pairs(rows)
    cut = found(spark, rows, cell=20)  # several cells and shares: a few pairs may be missed
    want = all_pairs(rows)
    assert all(a[1] <= b[1] for a, b in zip(cut, want)) and sum(a[1] for a in cut) >= 0.95 * sum(b[1] for b in want)


def test_shares_of_one_cell_meet(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "cells_for", lambda *a, **k: (1, 0))
    rng = np.random.default_rng(3)
    vectors = np.concatenate([around(rng, rng.standard_normal(16), 40, 0.2), rng.standard_normal((60, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert found(spark, rows, cell=9) == all_pairs(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (9, [1.0, 0.0]), (8, [2.0, -0.0]), (8, [2.0, 0.0]),
            (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None), (12, [1e-200, 1e-200]), (11, [1e200, 1e200]), (13, [1.0]), (14, [3.0]), (15, [1.0, 0.0, 0.0]), (9, [1.0, 0.0])]
    plain = [(k, None if v is None else [x if x is None or not np.isfinite(x) or not x else x / max(abs(y or 0) for y in v) for x in v]) for k, v in rows]
    assert found(spark, rows) == all_pairs(plain)
    assert found(spark, []) == []


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = 0.9 * u + math.sqrt(1 - 0.81) * around(rng, np.ones(64), 400, 3.0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    turn = embeddings.rotation(64)
    code, factor, _, _ = embeddings.encode(u, turn)
    _, _, query, scale = embeddings.encode(v, turn)
    got, true = np.diag(embeddings.estimates(code, factor, query, scale)), (u * v).sum(1)
    assert abs((got - true).mean()) < 0.01
    room = embeddings.EPSILON * np.sqrt((1 - factor**2) / factor**2 * (1 - true**2) / 63) + 1e-3
    assert (abs(got - true) <= room).all()


def test_a_large_group_becomes_few_balls():
    rng = np.random.default_rng(6)
    x = around(rng, rng.standard_normal(64), 1500, 0.1)
    into, made = embeddings.gather(x, np.zeros(1500), np.ones(1500), math.acos(0.95) / 2 - 1e-6)
    assert len(set(into.tolist())) < 10
    for head, (_, radius) in made.items():
        own = np.flatnonzero(into == head)
        assert radius <= math.acos(0.95) / 2 and (x[own] @ x[own].T).min() >= 0.95
