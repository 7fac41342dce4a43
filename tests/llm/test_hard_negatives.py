"""Hard negatives against comparison of all anchors with all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives as hn


def plain(rows, every=100, changed=True):
    """The contract's rows, in Python integers."""
    clean = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        clean[vec_id] = min(clean.get(vec_id, row), row)
    if changed:
        clean = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in clean.items()}
    out = set()
    for a in clean:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(clean[a][1], v, strict=False)), i) for i, (_, v) in clean.items() if i != a]
        scored.sort()
        for p, positive in [x for x in scored if clean[x[1]][0] == clean[a][0]][:5]:
            fit = [(-n, i) for n, i in scored if clean[i][0] != clean[a][0] and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out |= {(a, positive, k + 1, i, -p, n) for k, (n, i) in enumerate(fit)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mined(spark, rows, every, tree_rows=None):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<float>, code string, norm2 double")
    return found(hn.hard_negatives(hn.vectors(df), F.col("vec_id") % every == 0, tree_rows=tree_rows))


def clustered(n, dim, seed, centres=6):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dim))
    v = mid[rng.integers(centres, size=n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, int(rng.integers(4)), (x / np.linalg.norm(x) * rng.uniform(0.2, 3)).tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("tree_rows", [40, 300, 5000])
def test_negatives_match_all_pairs(spark, tree_rows, monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    rows = clustered(700, 8, 4)
    want = plain(rows, 20, changed=False)
    assert len(want) > 300
    assert mined(spark, rows, 20, tree_rows) == want


def test_odd_rows(spark):
    same = [0.5, 0.25, -0.5]
    rows = [(i, i % 3, same) for i in range(200, 260)] + [(i, i % 2, [0.0, 0.0, 0.0]) for i in range(20)]
    rows += [(300, 1, None), (301, None, same), (None, 1, same), (302, 1, [0.1, None, 0.2]), (303, 1, [0.1, float("nan"), 0.2]), (304, 1, [float("inf"), 0.0, 0.0])]
    rows += [(305, 1, []), (306, 2, [0.9]), (307, 2, [0.4, 0.2]), (308, 0, [-0.5, -0.25, 0.5]), (310, 1, [300.0, 200.0, 1.0]), (310, 1, [300.0, 200.0, 1.0]), (311, 5, same), (311, 0, same)]
    want = plain(rows, 10, changed=False)
    assert any(r[4] == 0 for r in want)
    assert mined(spark, rows, 10, 30) == want
    assert mined(spark, rows[:0], 10) == set()
    assert mined(spark, [(1, 1, None)], 10) == set()


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 1e6 for _ in range(4)]) for i in range(120)]
    assert mined(spark, rows, 10, 30) == plain(rows, 10, changed=False)
    with pytest.raises(ValueError, match="do not fit"):
        mined(spark, [(1, 1, [1e30]), (2, 1, [1.0])], 10)


def test_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hn, "TASK_QUERIES", 7)
    rows = clustered(300, 6, 9)
    assert mined(spark, rows, 10, 60) == plain(rows, 10, changed=False)


def test_trees_leave_nodes_out():
    points = np.array([r[2] for r in clustered(4000, 3, 2)])
    rows = np.floor(256 * points / np.linalg.norm(points, axis=1)[:, None]).astype(np.int64)
    space = hn.Space(int((rows**2).sum(axis=1).max()) + 1, 3)
    tree = hn.Tree(space, np.arange(4000), np.zeros(4000, np.int64), rows)
    scores: dict = {}
    q = hn.Query(space, -1, 0, rows[5], -(2**40), 2**40, True, 5)
    got = tree.search(q, scores)
    s = rows @ rows[5]
    assert got == sorted(zip(s.tolist(), range(4000), strict=True), key=lambda x: (-x[0], x[1]))[:5]
    assert sum(map(len, scores.values())) < 2000


@pytest.mark.parametrize("codes", [[], [1, -2], [40_000, 1], [2**40, -3], [-(2**15)]])
def test_packing(codes):
    assert hn.matrix([hn.packed(codes)], max(len(codes), 1))[0].tolist() == (codes or [0])


def test_registered_negatives_match_all_pairs(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert found(hn.op13_hard_negatives(spark, small)) == plain(rows)
