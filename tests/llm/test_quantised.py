"""Vectors against all pairs by brute force: links, components, recall; odd rows."""

import math

import numpy as np

from sieveframe.llm import quantised


def brute(rows, cosine=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made(seed, n, size=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, size))
    rows = []
    for k in range(n):
        v = centre[rng.integers(len(centre))] + rng.normal(size=size) * rng.choice((0, .1, .3, .6))
        rows.append((k * 7 % n, [float(x) for x in np.float32(v)], int(rng.integers(3))))
    return rows


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(quantised, "PER_CELL", 20)
    monkeypatch.setattr(quantised, "BLOCK", 8)
    rows = made(1, 240)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = quantised.near_vectors(df, probes=quantised.PROBES).collect()
    truth = brute(rows)
    links, expected = sum(r.n_links for r in found), sum(t[1] for t in truth)
    assert 0.98 * expected <= links <= expected and expected > 100
    by_id = {t[0]: t for t in truth}
    assert sum(tuple(r) == by_id[r.vec_id] for r in found) >= 0.95 * len(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 1), (7, [1.0, None], 1),
            (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1),
            (12, [0.93, 0.3675595], 1), (13, [-1.0, 0.0], 1), (None, [5.0, 5.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as node", "1 as cell")
    found = [tuple(r) for r in quantised.near_vectors(df).collect()]
    assert sorted(found, key=key) == sorted([(a, b, c, a == c) for a, b, c, _ in brute(rows)], key=key)
    assert quantised.near_vectors(df.limit(0)).count() == 0


def test_code_errors_bound_the_look_up_distance():
    rng = np.random.default_rng(2)
    units = quantised.unit_rows(rng.normal(size=(500, 24)))
    index = quantised.fit(units, 6)
    home = index.nearest(units, 1)[:, 0]
    codes, error = index.code(units - index.centroids[home])
    for cell in range(6):
        inside = home == cell
        found = index.distances(units, cell, codes[inside])
        truth = np.sqrt(np.maximum(quantised.squared(units, units[inside]), 0))
        assert (np.abs(found - truth) <= error[inside] + 1e-6).all()


def test_hot_group_of_distinct_near_copies_over_hundreds_of_lists(spark, monkeypatch):
    monkeypatch.setattr(quantised, "PER_CELL", 6)
    monkeypatch.setattr(quantised, "BLOCK", 100)
    rng = np.random.default_rng(3)
    # a third of the rows around one centre, pairs at a cosine of about 0.95; the others in small families
    hot = rng.normal(size=64) + rng.normal(size=(600, 64)) * np.sqrt(1 / 0.95 - 1)
    rest = np.repeat(rng.normal(size=(300, 64)), 4, 0) + rng.normal(size=(1200, 64)) * rng.choice((.1, .25, .4), size=(1200, 1))
    vectors = np.float32(np.concatenate([hot, rest]))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    units = quantised.unit_rows(vectors.astype(float))
    truth = (units @ units.T >= quantised.COSINE).sum(1) - 1
    found = {r.vec_id: r for r in quantised.near_vectors(df).collect()}
    assert len(found) == 1800 and [found[k].n_links for k in range(1800)] == truth.tolist()
    assert truth[:600].sum() > 0.8 * 600 * 599 and truth[600:].sum() > 500
    root = quantised._roots(1800, *np.nonzero(units @ units.T >= quantised.COSINE))
    assert [found[k].component_id for k in range(1800)] == root.tolist()
