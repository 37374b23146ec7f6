"""Cutting-stock packing: the program, its rounding, and the places of all pieces."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import cutting
from riskframe.llm.tokens import Encoder


def histogram(lengths):
    return {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}


def pieces(layout, counts):
    """Sequence -> (offset, length) of all pieces of a table."""
    out = {}
    for x, n in counts.items():
        placed = layout.cut_from[x]
        if placed:
            for q, o in zip(*(v.tolist() for v in layout.find(x, np.arange(placed))), strict=True):
                out.setdefault(q, []).append((o, x))
        for k in range(placed, n):
            at = 0
            for a, take, q, o in layout.cut(x, k):
                assert a == at and take > 0
                out.setdefault(q, []).append((o, take))
                at += take
            assert at == x
    return out


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60)))
def test_every_item_has_its_place_and_nothing_is_padded(counts):
    layout = cutting.lay_out(counts, 64)
    placed = pieces(layout, counts)
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0
    assert len(placed) == layout.sequences and sum(n for own in placed.values() for _, n in own) == sum(x * n for x, n in counts.items())


def test_exact_fillings_are_found_without_a_cut():
    counts = {40: 30, 24: 30, 20: 45, 44: 45, 33: 20, 31: 20}
    layout = cutting.lay_out(counts, 64)
    assert layout.cut_from == counts and layout.sequences == 30 + 45 + 20


def test_the_program_reaches_its_bound():
    weights = np.array([45, 36, 31, 14])
    demand = np.array([97, 610, 395, 211])
    columns, bound = cutting.fractional(weights, demand, 128)
    total = sum((s + cutting.START * 128) * t for s, _, t in columns)
    assert sum(t * p for _, p, t in columns) == pytest.approx(demand) and bound <= total <= bound * 1.02
    assert all((p @ weights) <= s for s, p, _ in columns)
    # The knapsack against a plain one, and with bounded numbers.
    rng = np.random.default_rng(3)
    for most in (None, np.array([1, 2, 0, 3])):
        values = rng.random(4)
        sack = cutting.Knapsack(weights, 128)
        sack.solve(values, most)
        best = 0.0
        for counts in np.ndindex(3, 4, 5, 10):
            if counts @ weights <= 128 and (most is None or (np.array(counts) <= most).all()):
                best = max(best, float(counts @ values))
        assert sack.best[128] == pytest.approx(best) and float(sack.pattern(128) @ values) == pytest.approx(best)


def test_large_tables_cut_few_items():
    counts = histogram(np.clip(np.random.default_rng(0).lognormal(5.5, 1.2, 20_000).astype(int), 1, 4096))
    layout = cutting.lay_out(counts, 4096)
    cut = sum((n - layout.cut_from[x]) * x for x, n in counts.items())
    total = sum(x * n for x, n in counts.items())
    assert cut < 0.03 * total and layout.sequences < 1.15 * total / 4096
    assert all(sum(k for _, k in own) & (sum(k for _, k in own) - 1) == 0 for own in pieces(layout, counts).values())


def test_packing_places_every_token(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(rng.choice(["the", "of", "theawh", "ndst."], int(n))), "p", "s") for i, n in enumerate(rng.integers(0, 900, 80))]
    rows += [(100, None, "", ""), (101, "", "", ""), (7, "again", "", ""), (7, "again", "", ""), (None, "no id", "", ""), (102, "long word " * 40_000, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, sequence_id string").repartition(5)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Encoder(path).tokenizer
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    got = cutting.pack(df, path, capacity=256).collect()
    by_row, sequences = {}, {}
    for r in got:
        by_row.setdefault((r["row"], r["doc_id"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_row) == len(rows)
    for (_, doc_id), own in by_row.items():
        ids = next(x for x in want[doc_id] if len(x) == own[0]["doc_tokens"])
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:at], dtype="<u4").tobytes())
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert cutting.pack(df.limit(0), path).count() == 0
