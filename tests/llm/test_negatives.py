"""Mined negatives against all inner products, with blocks, groups, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, every=100):
    """``rows``: (vec_id, vector, label) as they take part; results as a sorted list."""
    good = [(i, [math.floor(256 * x) for x in v], la) for i, v, la in rows if None not in (i, v, la) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, q, la) in enumerate(good):
        if i % every:
            continue
        scored = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), j, lb) for m, (j, p, lb) in enumerate(good) if m != k]
        for s, j, _ in sorted(x for x in scored if x[2] == la)[:5]:
            window = sorted(x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(window[:10])]
    return sorted(out)


def vectors(n, dims, seed, labels=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims)) * spread
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dims) * 0.2 + centre[i % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize("rows, groups", [(65536, 4096), (40, 3)])
@pytest.mark.parametrize("dims", [2, 16])
def test_mined_equal_all_products(spark, monkeypatch, rows, groups, dims):
    monkeypatch.setattr(N, "ROWS", rows)
    monkeypatch.setattr(N, "ANCHORS", groups)
    data = vectors(700, dims, dims)
    same = data[5][1]
    data += [(i, same, i % 3) for i in range(700, 900)]  # a common vector: ties everywhere
    got = N.mine(N.quantised(spark.createDataFrame(data, SCHEMA).repartition(5)))
    assert sorted(tuple(r) for r in got.collect()) == slow(data)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(120, 4, 1) + [(None, [1.0] * 4, 1), (200, None, 1), (201, [1.0] * 4, None), (202, [1.0, None, 0.0, 0.0], 1), (203, [nan, 0.0, 0.0, 0.0], 1), (204, [inf, 0.0, 0.0, 0.0], 0),
                                 (300, [], 1), (301, [], 2), (302, [0.5], 1), (400, [0.0] * 4, 1), (500, [-1.0] * 4, 77), (600, [0.3, 0.2, -0.1, 0.1], 1), (600, [0.3, 0.2, -0.1, 0.1], 1)]
    docs = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "q", "b", "g", "anchor", "rank", "score")})
    assert sorted(tuple(r) for r in N.mine(N.quantised(docs)).collect()) == slow(data)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.mine(N.quantised(none)).count() == 0
    assert N.mine(N.quantised(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA))).count() == 0  # no anchors


@pytest.mark.parametrize("size, kind", [(1, np.float32), (1e4, np.float64), (1e6, object), (3e9, object)])
def test_products_are_exact_at_any_size(spark, size, kind):
    data = [(i, [x * size for x in v], la) for i, v, la in vectors(300, 3, 9)]
    q = N.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    most = max(abs(x) for r in q.collect() for x in r.q)
    assert N._exact(most, 3) is kind
    assert sorted(tuple(r) for r in N.mine(q).collect()) == slow(data)


def test_lists_stop_early_and_are_right():
    """With few dimensions, sorted access ends long before the lists do."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(20000, 3)) * 256)
    lists = N.Lists(np.arange(20000), np.arange(20000), x)
    for _ in range(20):
        q = np.floor(rng.normal(size=3) * 256)
        s = x @ q
        top = s.max()
        windows = [(-math.inf, math.inf), (0.3 * top, 0.9 * top), (2 * top, 3 * top)]
        for (low, high), (at, got) in zip(windows, lists.best(q, windows, 10, np.zeros(20000, bool))):
            here = np.flatnonzero((s >= low) & (s <= high))
            want = here[np.lexsort((here, -s[here]))[:10]]
            assert at.tolist() == want.tolist() and got.tolist() == s[want].tolist()
        assert lists.depth < 10000
