"""Hard negatives against a plain search."""

import math

import numpy as np
import pytest

from riskframe.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, row string, block string"


def brute_force(rows):
    own = []
    for k, (i, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in e]))

    def ranked(anchor, others):
        return sorted(((-sum(x * y for x, y in zip(anchor[3], o[3], strict=True)), math.inf if o[1] is None else o[1], o[0]) for o in others))

    out = []
    for a in own:
        if a[1] is None or a[1] % 100:
            continue
        near = [o for o in own if o[0] != a[0] and len(o[3]) == len(a[3])]
        other = ranked(a, [o for o in near if o[2] != a[2]])
        for s, p, _ in ranked(a, [o for o in near if o[2] == a[2]])[:5]:
            fit = [(n, i) for n, i, _ in other if 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a[1], p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(tuple(None if x == math.inf else x for x in r) for r in out)


@pytest.mark.parametrize(("anchors", "batch"), [(512, 2048), (3, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, anchors, batch):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", batch)
    rng = np.random.default_rng(anchors)
    rows = [(int(i) * 20, np.round(rng.normal(size=6) * rng.choice([0.05, 0.4]), 2).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(100, rows[5][1], rows[5][2]), (300, rows[15][1], rows[15][2]), (300, rows[15][1], 2), (50_000, [0.5] * 6, 9), (50_001, [0.5] * 6, 9)]
    rows += [(60_000, [1.0, 2.0], 1), (60_100, [1.0, 2.1], 1), (60_101, [0.4, 0.8], 2), (60_200, [], 1), (60_201, [], 1)]
    rows += [(70_000, None, 1), (70_100, [0.1] * 6, None), (70_200, [None] + [0.1] * 5, 1), (70_300, [float("nan")] * 6, 1), (70_400, [float("inf")] * 6, 1)]
    rows += [(80_000 + k, [0.3, 0.3, 0.0, 0.0, 0.0, 0.1], k % 2) for k in range(30)]  # ties
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS).repartition(4, "vec_id")
    got = [tuple(r) for r in negatives.mine(df).collect()]
    want = brute_force(rows)
    assert sorted(got) == want and len(want) > 300


def test_ids_that_are_null_come_last(spark):
    rows = [(100, [1.0], 1), (None, [1.0], 1), (101, [1.0], 1), (None, [0.5], 2), (103, [0.5], 2)]
    got = [tuple(r) for r in negatives.mine(spark.createDataFrame([(*r, "", "") for r in rows], ROWS)).collect()]
    assert sorted(got, key=repr) == sorted(
        [(100, p, k, n, 256 * 256, 256 * 128) for p in (None, 101) for k, n in ((1, 103), (2, None))], key=repr)


def test_large_components(spark):
    rows = [(100, [1e5, 3.0], 1), (101, [1e5, 2.0], 1), (102, [5e4, 2.0], 2), (103, [1e200, 0.0], 2)]
    got = [tuple(r) for r in negatives.mine(spark.createDataFrame([(*r, "", "") for r in rows], ROWS)).collect()]
    assert got == brute_force(rows[:3]) and len(got) == 1


def test_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], ROWS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, [1.0], 1, "", "")], ROWS)).count() == 0
