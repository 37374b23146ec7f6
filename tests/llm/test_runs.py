"""Periodic runs against a plain search of every period."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import runs

DOCS = "doc_id long, text string, n_words string, runs string"


def brute_force(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def found(words, least=12):
    return list(zip(*(x.tolist() for x in runs.find_runs(np.array(words, dtype=np.int64), least)), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.lists(st.integers(0, 1), min_size=1, max_size=7), st.integers(1, 12), st.sampled_from([2, 3, 12, 20]))
def test_runs_equal_brute_force(words, unit, times, least):
    block = unit * times
    for own in (words, words + block, block + [5] + block, (block + [7]) * 3 + words + block[::-1], words + block + words + block):
        assert found(own, least) == brute_force(own, least)


def test_runs_between_two_parts_of_one_period():
    for a in range(8, 20):
        for b in range(8, 20):
            own = ([1, 2, 3] * 20)[:a] + ([1, 2, 3] * 20)[:b]
            assert found(own) == brute_force(own)


def test_one_long_repetition_is_one_run():
    assert found([4] * 50_000) == [(0, 50_000, 1)]
    unit = np.random.default_rng(0).integers(0, 900, 20_000).tolist()
    assert found(unit * 3)[0] == (0, 60_000, 20_000)


def test_wavelet_tree_counts_and_ranks():
    rng = np.random.default_rng(1)
    values = rng.permutation(137)
    tree = runs.WaveletTree(values)
    left, right = np.sort(rng.integers(0, 138, (2, 300)), axis=0)
    limit = rng.integers(-1, 300, 300)
    assert tree.below(left, right, limit).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(left, right, limit, strict=True)]
    some = right > left
    rank = np.array([int(rng.integers(0, b - a)) for a, b in zip(left[some], right[some], strict=True)])
    assert tree.ranked(left[some], right[some], rank).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(left[some], right[some], rank, strict=True)]


def test_runs_of_a_table(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + " tail" * 20
    texts = [None, "", " \t\n", "a b " * 6, "one two " * 12, long, "x\x0by\x0cz\r\n" * 5, "A a " * 6, "the same text", "the same text"]
    texts += [" ".join(np.random.default_rng(k).choice(list("abc"), 200)) for k in range(60)]
    rows = [(i, t, "n", "r") for i, t in enumerate(texts)] + [(None, "q " * 13, "", ""), (3, "a b " * 6, "", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own = brute_force(words) if len(words) < 1000 else [(40_000, 20, 1)]
        kept = [True] * len(words)
        for a, n, q in own:
            kept[a + q:a + n] = [False] * (n - q)
        assert (len(words), own, " ".join(w for w, k in zip(words, kept, strict=True) if k)) in got[i]
    assert len(got[3]) == 2
    # The query: planted periods and digests.
    for r in runs.digest(runs.periodic_runs(runs.with_planted_periods(df.filter("doc_id is null or doc_id not in (3, 5)")))).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        own = brute_force(words)
        kept = [True] * len(words)
        for a, n, q in own:
            kept[a + q:a + n] = [False] * (n - q)
        best = min(own, key=lambda x: (-x[1], x[0], x[2])) if own else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(own), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if own else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in own).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for w, k in zip(words, kept, strict=True) if k).encode()).hexdigest()
    assert runs.digest(runs.periodic_runs(runs.with_planted_periods(df.limit(0)))).count() == 0
