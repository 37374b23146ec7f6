"""Host rules, lines, near-duplicate documents, mixing and the pipeline."""

import hashlib
import importlib.util
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from riskframe.llm import hosts, lines, minhash, mixing

DOCS = "doc_id long, text string, source string, lang string, size string, n_lines string, copies string"
EXTRA = ("en", "x", "y", "z")
LONG = " ".join(f"w{i % 977}" for i in range(60000))


def frame(spark, rows):
    """(doc_id, text, source) rows with further columns, some named like results."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def by_sql(sql, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(*r, *EXTRA) for r in rows], columns=[x.split()[0] for x in DOCS.split(", ")]).astype(
        {"doc_id": "Int64", "text": "string", "source": "string"}))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, sorted(cur.fetchall(), key=repr)


def corpus(seed=0, n=150):
    rng = np.random.default_rng(seed)
    shared = ["The same long footer line", "ANOTHER shared line here ", "short"]
    rows = []
    for i in range(n):
        own = [" ".join(rng.choice([f"v{k}" for k in range(60)], int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 6)))]
        own += [str(x) for x in rng.choice(shared, int(rng.integers(0, 4)))]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), f"host{int(rng.integers(0, 4))}"))
    rows += [(500, None, "host0"), (501, "", None), (502, "  \n\t\n", "bad"), (503, LONG, "host1"), (504, "same row again ok", "host1"),
             (504, "same row again ok", "host1"), (None, "The same long footer line", "host2"), (505, "a a a a a a a a a", "bad"),
             (506, "\x0b The SAME long footer line\r\nÄÖÜ äöü lines stay as they are\nÄÖÜ ÄÖÜ lines stay as they are", None)]
    return rows


def test_host_rules_equal_sql(spark):
    rows = corpus()
    names, want = by_sql(hosts.SQL, rows)
    assert rows_of(hosts.judge(frame(spark, rows)), *names) == want
    assert hosts.judge(frame(spark, [])).count() == 0


def test_a_bad_host_is_rejected_and_a_small_one_is_not_judged_alone(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(i, good, "fair") for i in range(200, 400)]
    rows += [(i, bad if i % 10 else good, "farm") for i in range(400, 500)] + [(600, bad, "tiny"), (601, good, "tiny")] + [(602, good, None)]
    kept = {r["doc_id"]: r["kept"] for r in hosts.judge(frame(spark, rows)).collect()}
    assert not any(kept[i] for i in range(400, 500)) and all(kept[i] for i in range(400)) and kept[601] and kept[602] and not kept[600]


def test_line_dedup_equals_sql(spark):
    rows = corpus(1)
    names, want = by_sql(lines.SQL, rows)
    cleaned = lines.dedup_lines(frame(spark, rows))
    assert rows_of(lines.digest(cleaned), *names) == want
    assert set(cleaned.columns) >= {"lang", "copies", "text", "n_dropped"} and cleaned.columns.count("n_lines") == 1
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_lines_of_every_document_and_of_two(spark):
    """Two lines stand in all of 1,500 documents (joined as frequent keys), 600 in two each (joined by key)."""
    rows = [(i, f"a line that all documents hold\nline number {i % 900} of two documents\nown line {i} here\nA LINE that all hold too", "s") for i in range(1500)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup_lines(frame(spark, rows), shards=3).collect()}
    assert got[0] == (rows[0][1], 0) and len(got) == 1500
    for i in range(1, 1500):
        own = ([f"line number {i % 900} of two documents"] if i < 900 else []) + [f"own line {i} here"]
        assert got[i] == ("\n".join(own), 4 - len(own))


def test_line_index_is_reversible(spark):
    def clean(index, rows):
        return {r["doc_id"]: (r["text"], r["n_dropped"]) for r in index.clean(frame(spark, rows)).collect()}

    a = [(1, "first shared line\nonly in one", "s"), (2, "second shared line\nfirst shared line", "s")]
    b = [(3, "second shared line\nfirst shared line\nown line of three", "s")]
    index = lines.LineIndex(spark, shards=4)
    index.insert(frame(spark, a))
    alone = clean(index, a)
    assert alone[2] == ("second shared line", 1)
    index.insert(frame(spark, b))
    assert clean(index, b)[3] == ("own line of three", 2)
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert clean(index, [a[1]])[2] == (a[1][1], 0)
    index.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert clean(index, b)[3] == (b[0][1], 0)
    index.insert(frame(spark, a))
    both = clean(index, a + b)
    assert both[1] == (a[0][1], 0) and both[2] == ("second shared line", 1) and both[3] == ("own line of three", 2)


def test_cuckoo_filters_never_lose_a_key():
    rng = np.random.default_rng(0)
    shard, keys = lines.Shard(), rng.integers(0, 1 << 63, 30000, dtype=np.int64).astype(np.uint64)
    for part in np.array_split(keys, 7):
        known = shard.insert(part)
        assert known.mean() < 0.01
        shard.force(part[known])
    shard = lines.Shard(shard.blob())
    assert shard.contains(keys).all() and shard.insert(keys[:100]).all() and len(shard.filters) > 1
    assert shard.contains(rng.integers(0, 1 << 63, 20000, dtype=np.int64).astype(np.uint64)).mean() < 0.01
    shard.delete(keys[:15000])
    assert shard.contains(keys[15000:]).all() and shard.contains(keys[:15000]).mean() < 0.05
    full = lines.CuckooFilter(16)
    assert len(full.insert(keys[:200])) == 200 - full.table.size + int((full.table == 0).sum())


def near_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t, _ in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    old, new = max(part[a], part[b]), min(part[a], part[b])
                    part = [new if p == old else p for p in part]
    first = {}
    for k, p in enumerate(part):
        if rows[k][0] is not None:
            first[p] = min(first.get(p, rows[k][0]), rows[k][0])
    return sorted([(r[0], len(s), first[p] if r[0] is not None else None) for r, s, p in zip(rows, sets, part, strict=True)], key=repr)


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for base in range(8):  # copies of copies, so that many pairs stand near the limit
        words = [f"b{base}w{i}" for i in range(int(rng.integers(30, 120)))]
        for _ in range(14):
            own = list(words)
            for p in rng.choice(len(own), int(rng.integers(0, 4)), replace=False):
                own[p] = f"x{rng.integers(1 << 30)}"
            rows.append((int(1000 - k), " ".join(own) if k % 3 else " ".join(own).upper(), "s"))
            k += 1
            if rng.random() < 0.3:
                words = own
    rows += [(1, None, "s"), (2, " \n ", "s"), (3, "two words", "s"), (4, "Two  WORDS\n", "s"), (5, "one", "s"), (6, LONG, "s"), (7, LONG, "s"),
             (None, LONG, "s"), (8, "exact copy of this text", "s"), (8, "exact copy of this text", "s")]
    got = minhash.near_duplicates(frame(spark, rows), block=block)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == near_components(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())
    if block > 8:
        assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_at_the_limit_that_share_a_band_are_linked(spark, percent):
    """5,000 pairs exactly at the limit: whether their sketches agree well or not, those that meet in a bucket link."""
    import pyarrow as pa

    own = (100 - percent) // 2
    texts = []
    for k in range(5000):
        shared = [f"p{k}s{i}" for i in range(percent)]
        texts += [" ".join(shared + [f"p{k}a{i}" for i in range(own)]), " ".join(shared + [f"p{k}b{i}" for i in range(100 - percent - own)])]
    v = np.concatenate([minhash.sketches(minhash.shingle_sets(pa.array(texts[k:k + 2000]), 1)) for k in range(0, len(texts), 2000)])
    bands = (v[0::2] == v[1::2]).reshape(5000, minhash.BANDS, minhash.ROWS).all(axis=2)
    meet = {2 * k for k in np.flatnonzero(bands.any(axis=1))}
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=1, least_percent=percent)
    assert {r["component_id"] for r in got.filter("doc_id != component_id").collect()} == meet and len(meet) > 4960


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64)) for _ in range(2))
    c = np.unique(np.concatenate([a[:300], b[:100]]))
    s = minhash.sketches([a, c, a[:1], a[:3], a], 512)
    true = len(np.intersect1d(a, c)) / len(np.union1d(a, c))
    assert abs((s[0] == s[1]).mean() - true) < 0.08 and (s[0] == s[4]).all() and (s[2] != s[0]).mean() > 0.9


def brute_force_targets(sizes, share=1.5, weights=(5, 2, 1), most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while len(fixed) < len(order):
        level = (total - sum(fixed.values())) / sum(w[s] for s in order if s not in fixed)
        above = [s for s in order if s not in fixed and w[s] * level > most * sizes[s]]
        if not above:
            return {s: fixed.get(s, w[s] * level) for s in order}
        fixed |= {s: most * sizes[s] for s in above}
    return fixed


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(9)
    names = ["a", "B", "é", None, "z", "zz", "", "c"]
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 40))), names[int(rng.choice(8, p=[.4, .1, .1, .1, .1, .1, .05, .05]))]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, LONG, "z"), (2002, "same same", "a"), (2002, "same same", "a"), (None, "no id", "c"), (2003, "", "only empty")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, longest = brute_force_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
        copies = [r["copies"] for r in got if r["source"] == s]
        assert max(copies) - min(copies) <= 1  # whole epochs come before a part of one
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7))
    assert rows_of(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)
    sampled = Counter(r["doc_id"] for r in mixing.sample(frame(spark, rows)).collect())
    assert sampled == Counter(x for r in got for x in [r["doc_id"]] * r["copies"])
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_prefers_documents_of_more_weight(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "a" if i < 1000 else "b") for i in range(2000)]
    got = mixing.mix(frame(spark, rows), share=0.4, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).filter("taken > 0")
    n = Counter(r["doc_id"] % 2 for r in got.collect())
    assert n[0] > 1.5 * n[1]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not installed")
def test_pipeline_equals_a_plain_one(spark):
    """Stage by stage on sf0.001, against plain Python on what the stage before returned."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).cache()
    columns = docs.columns
    plain = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    clean = stages["toxicity"](spark, docs, sf).cache()
    gone = {r[0] for r in plain(docs)} - {r[0] for r in plain(clean)}
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(gone & (labelled - toxic)) == 0 and len(gone & toxic) >= 0.5 * len(toxic & {r[0] for r in plain(docs)})
    lined = stages["line_dedup"](spark, clean, sf).cache()
    names, want = by_sql(lines.SQL, plain(clean))
    assert sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in plain(lined)) == sorted(
        (w[names.index("doc_id")], w[names.index("kept_sha256")]) for w in want)
    single = stages["near_dedup"](spark, lined, sf).cache()
    parts = near_components(plain(lined), 5, 80)
    assert sorted(r[0] for r in plain(single)) == sorted(i for i, n, first in parts if i == first)
    mixed = stages["mixing"](spark, single, sf).cache()
    assert lined.columns == single.columns == mixed.columns == clean.columns == columns
    assert set(plain(mixed)) <= set(plain(single)) and max(Counter(plain(mixed)).values()) <= 2
    packed = stages["packing"](spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in plain(mixed))
    for df in (docs, clean, lined, single, mixed):
        df.unpersist()


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_mixing_takes_only_as_many_equal_rows_as_fit(spark, seed):
    text = " ".join(["plain"] * 20)
    rows = [(7, text, "a")] * 150 + [(1000 + i, " ".join(["word"] * (1 + i % 40)), "a") for i in range(150)] + [(5000 + i, text, "b") for i in range(400)]
    rows += [(9, text, None)] * 60 + [(None, text, None)] * 60
    df = frame(spark, rows).repartition(5)
    for texts in (True, False):
        got = mixing.mix(df, seed=seed, texts=texts).collect()
        assert len(got) == len(rows)
        for s in ("a", "b", None):
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20 and all(r["taken"] <= 2 * r["size"] for r in own)


def test_mixing_spreads_texts_of_small_weight_over_many_steps(spark):
    rows = [(i, "12 34 56", "a") for i in range(3000)]
    steps = mixing._keyed(frame(spark, rows), None, 7).groupBy("_place").count()
    assert steps.agg({"count": "max"}).first()[0] <= 4


def test_windows_of_very_long_texts_do_not_collide(spark):
    n = 5_000_000
    text = spark.range(1).selectExpr("1L AS doc_id", f"array_join(transform(sequence(0, {n - 1}), i -> hex(i)), ' ') AS text", "'h' AS source")
    row = hosts.features(text).first()
    assert (row["n_words"], row["n_repeat_words"]) == (n, 0)
