import math

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR

from thermolake.llm import hard_negatives as hn
from thermolake.llm import registry

SCHEMA = "vec_id long, embedding array<double>, label int, v string, key string, copies int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", 3, 4) for i, v, y in rows], SCHEMA)


def brute(rows, every=100):
    """The contract, row by row, in Python's whole numbers."""
    used = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda f: (-f[1], f[0] is None, f[0] or 0)
    out = []
    for a, (anchor, q, label) in enumerate(used):
        if anchor is None or anchor % every:
            continue
        scores = [(i, sum(x * y for x, y in zip(q, v)), y) for b, (i, v, y) in enumerate(used) if b != a]
        for positive in sorted([s for s in scores if s[2] == label], key=order)[:5]:
            fits = [s for s in scores if s[2] != label and 30 * positive[1] <= 100 * s[1] <= 90 * positive[1]]
            out += [(anchor, positive[0], rank, s[0], positive[1], s[1])
                    for rank, s in enumerate(sorted(fits, key=order)[:10], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cloud(n, dim=6, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [(i, [float(x) for x in centres[i % 5] + rng.normal(size=dim) * spread], int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("dim,spread", [(2, 0.1), (6, 0.4), (24, 1.0)])
def test_equals_brute_force(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(hn, "BLOCK", 150)
    monkeypatch.setattr(hn, "GROUP", 3)
    rows = cloud(700, dim, dim, spread)
    assert found(hn.hard_negatives(frame(spark, rows))) == brute(rows)


ODD = [
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [0.5, 0.5], 2), (100, [0.25, 0.5], 2), (None, [0.5, 0.25], 1),
    (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 2), (5, [1.0, 1.0], None),
    (6, [0.4, 0.4], 2), (6, [0.4, 0.4], 2), (7, [0.6], 2), (8, [], 1), (9, [0.9, 0.4], 1), (10, [0.9, 0.4], 1),
    (200, [-1.0, -1.0], 3), (201, [1.0, 1.0], 3), (11, [0.7, 0.5], 3), (300, [0.0, 0.0], 4), (12, [0.0, 0.0], 4),
]


def test_odd_rows(spark):
    assert found(hn.hard_negatives(frame(spark, ODD))) == brute(ODD)


def test_empty(spark):
    rows = frame(spark, ODD)
    for none in (rows.limit(0), rows.filter("vec_id = 1"), rows.filter("vec_id % 100 <> 0")):
        df = hn.hard_negatives(none)
        assert df.count() == 0 and df.columns == [
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-4e5, 4e5, 300)], i % 2) for i in range(150)]
    assert float(256 * 4e5) ** 2 * 300 > hn.EXACT
    assert found(hn.hard_negatives(frame(spark, rows), hn.F.col("vec_id") % 50 == 0)) == brute(rows, 50)


def test_a_third_are_copies(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 100)
    rows = cloud(300) + [(1000 + i, [0.5] * 6, 1) for i in range(200)] + [(77, [0.25] * 6, 2)] * 60
    assert found(hn.hard_negatives(frame(spark, rows))) == brute(rows)


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(1)
    points = np.floor(256 * (rng.normal(size=(4, 8))[rng.integers(4, size=2000)] + 0.05 * rng.normal(size=(2000, 8))))
    queries = np.floor(256 * rng.normal(size=(20, 8)))
    tree = hn.CoverTree(points, leaf=20, fan=8)
    least, most = tree.bounds(queries)

    def below(node):
        if tree.rows[node] is not None:
            return tree.order[tree.rows[node]]
        return np.concatenate([below(c) for c in tree.children[node]])

    assert sorted(below(0)) == list(range(2000))
    for node in range(len(tree.rows)):
        scores = queries @ points[below(node)].T
        assert (scores <= most[:, node][:, None]).all() and (scores >= least[:, node][:, None]).all()
        for child in tree.children[node]:
            assert tree.radii[child] <= tree.radii[node] * 2
    asked = []

    def score(rows):
        asked.append(rows.stop - rows.start)
        return (tree.points[rows] @ queries[0]).astype(np.int64)

    ids = np.arange(2000)[tree.order]
    (best,) = hn.search(tree, ids, np.ones(2000, bool), score, least[0], most[0], [(-(2**62), 2**62)], 5)
    assert [-r[0] for r in best] == sorted((points @ queries[0]).astype(int).tolist(), reverse=True)[:5]
    assert sum(asked) < 1000  # near points lie together, so most are never looked at


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    df = registry.op12_hard_negatives(spark, SF_DIR)
    cur = con.execute(registry.OP12_SQL)
    assert [c[0] for c in cur.description] == df.columns
    assert found(df) == sorted(cur.fetchall(), key=str)
