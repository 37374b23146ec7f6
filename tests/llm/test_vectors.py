"""Near-duplicate vectors and components."""

import numpy as np
import pytest

from riskframe.llm import graph, vectors

ROWS = "vec_id long, embedding array<float>, label int, node string, n_links string"


def brute_force(rows, least=0.98):
    links, part = [0] * len(rows), list(range(len(rows)))

    def valid(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    for a in range(len(rows)):
        for b in range(a):
            if valid(rows[a]) and valid(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a] += 1
                    links[b] += 1
                    old, new = max(part[a], part[b]), min(part[a], part[b])
                    part = [new if p == old else p for p in part]
    first = {}
    for r, p in zip(rows, part, strict=True):
        if r[0] is not None:
            first[p] = min(first.get(p, r[0]), r[0])
    return sorted(((r[0], n, first.get(p)) for r, n, p in zip(rows, links, part, strict=True)), key=repr)


@pytest.mark.parametrize(("width", "block"), [(64, 2048), (24, 16)])
def test_near_duplicate_vectors_equal_brute_force(spark, width, block):
    rng = np.random.default_rng(width)
    rows, k = [], 500
    for c in range(25):
        base = rng.normal(size=width)
        for _ in range(int(rng.integers(1, 9)) if c else 60):
            v = base + rng.normal(size=width) * 0.06 * np.linalg.norm(base) / np.sqrt(width)
            rows.append((k, [float(np.float32(x)) for x in v], int(c % 3)))
            k -= 1
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, rows[0][1], 2), (1003, rows[0][1], None),
             (1004, None, 0), (1005, [], 0), (1006, [0.0] * width, 0), (1007, [float("nan")] * width, 0), (1008, [None] + [1.0] * (width - 1), 0),
             (1009, [float("inf")] * width, 0), (1010, [1.0, 2.0, 3.0], 0), (1011, [2.0, 4.0, 6.0], 0), (1012, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)
    got = vectors.near_duplicates(df, block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_force(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
    row = vectors.near_duplicates(spark.createDataFrame([(None, [1.0], 1, "", ""), (4, [1.0], 1, "", "")], ROWS)).collect()
    assert sorted((r["n_links"] for r in row)) == [1, 1]


def test_rotations_balance_and_keep_near_vectors_near():
    rng = np.random.default_rng(0)
    x = vectors.unit(rng.normal(size=(2000, 32)) * np.linspace(0.5, 2, 32))
    q = vectors.learn(x, 32)
    near = vectors.unit(x + rng.normal(size=x.shape) * 0.02)
    a, b = q.codes(x, 20), q.codes(near, 20)
    assert a.shape == (2000, 20) and ((a == b).any(axis=1)).mean() > 0.99
    bits = (a[:, :1] >> np.arange(16)) & 1
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.15


@pytest.mark.parametrize("chunk", [1 << 20, 16])
def test_components_of_chains_and_stars(spark, chunk):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(300, 200), (7, 7)]
    edges = [edges[(k * 41) % len(edges)] for k in range(len(edges))]  # chunks of 16 hold scattered links of the chain
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), chunk).collect()}
    assert len(got) == 61 + 50 + 2
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(50)) and got[300] == got[200] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_of_a_group():
    assert graph.roots(6, np.array([0, 3, 4]), np.array([3, 4, 5])).tolist() == [0, 1, 2, 0, 0, 0]


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1e-310, 2e-310], 1), (4, [1e308, -1e308], 1), (5, [1.0, 2.0], 1), (6, [5e-324, 0.0], 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}
