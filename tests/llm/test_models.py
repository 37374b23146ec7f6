"""Language model, quality and toxicity classifiers."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import common as c
from riskframe.llm import lm, quality, toxicity

DOCS = "doc_id long, text string, source string, held_out string, score string"  # the last two clash with results


def brute_force_scores(rows, em_modulus=10):
    """The model over plain dictionaries, with exact expectation-maximisation."""
    import xxhash

    def words(t):
        return (t or "").encode().lower().split() + ["END"]

    def train(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0

    docs = [(i, words(t), train(i), xxhash.xxh3_64_intdigest(str(i).encode(), 7) % em_modulus == 0) for i, t in rows]
    uni, pair, context, f_uni, f_pair, f_context = (Counter() for _ in range(6))
    for _, w, tr, fold in docs:
        if not tr:
            continue
        for h, x in zip(["START", *w], w):
            uni[x] += 1
            pair[h, x] += 1
            context[h] += 1
            if fold:
                f_uni[x] += 1
                f_pair[h, x] += 1
                f_context[h] += 1
    n, v = sum(uni.values()), len(uni)
    kept = max(n - sum(f_uni.values()), 1)
    k = {x: uni[x] - f_uni[x] for x in uni}

    def em(counts, ratios):
        counts, ratios = np.array(counts, float), np.array(ratios, float)
        if not counts.sum():
            return 0.0
        w = 0.5
        for _ in range(200):
            w = min(float((counts * (w * ratios / (w * ratios + 1 - w))).sum() / counts.sum()), 0.9999)
        return w

    mu = em(list(f_uni.values()), [k[x] / kept * (v + 1) for x in f_uni])
    below = lambda x, counts, total: mu * counts.get(x, 0) / max(total, 1) + (1 - mu) / (v + 1)
    bucket = lambda c: 0 if c == 0 else min(int(np.frexp(float(c))[1]), lm.CONTEXT_BUCKETS - 1)
    events = {}
    for (h, x), m in f_pair.items():
        c = context[h] - f_context[h]
        r = (pair[h, x] - m) / max(c, 1) / below(x, k, kept)
        events.setdefault(bucket(c), []).append((m, r))
    lam = [0.0]
    for b in range(1, lm.CONTEXT_BUCKETS):
        lam.append(em(*zip(*events[b])) if b in events else lam[-1])
    out = []
    for i, w, tr, _ in docs:
        base = sum(np.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip(["START", *w], w):
            g = lam[bucket(context[h])]
            score += np.log10(g * pair[h, x] / max(context[h], 1) + (1 - g) * below(x, uni, n))
        out.append((i, not tr, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def test_language_model_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"W{i}" for i in range(40)]
    rows = []
    for i in range(120):
        state, text = 0, []
        for _ in range(int(rng.integers(0, 60))):
            state = int((state * 3 + rng.integers(0, 4)) % 40)
            text.append(vocabulary[state] if rng.random() > 0.1 else vocabulary[state].lower())
        rows.append((i, " ".join(text) + "\t\n"))
    rows += [(200, None), (201, ""), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (202, "neverseen \x0b W1"), (203, "a b W1")]
    df = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in lm.score_documents(df, em_modulus=4).collect()), key=key)
    want = sorted(brute_force_scores(rows, 4), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=5e-3, atol=0.02)


def test_language_model_beats_unigrams_on_held_out_and_takes_empty_tables(spark):
    rows = [(i, " ".join(["a b c d e"] * 10), "s", "", "") for i in range(60)]
    scored = lm.score_documents(spark.createDataFrame(rows, DOCS)).filter("held_out")
    total = scored.selectExpr("sum(score) s", "sum(base_score) b").first()
    assert total["s"] > total["b"] / 4
    assert lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score_documents(spark.createDataFrame([(only, "a", "s", "", "")], DOCS)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == pytest.approx(0.0)


def test_em_weight_finds_the_maximum():
    n, r = np.array([5.0, 3.0, 2.0]), np.array([4.0, 0.2, 0.0])
    w = lm.em_weight(n, r)
    loss = lambda x: -(n * np.log(x * r + 1 - x)).sum()
    assert loss(w) <= min(loss(x) for x in np.linspace(0.01, 0.99, 99)) + 1e-6


def _corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(40))] = str(rng.choice(["scoundrel", "villainous", "wretch"]))
        texts.append(". ".join(" ".join(words[k:k + 8]) for k in range(0, 40, 8)))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_on_held_out_texts(spark):
    texts, labels = _corpus()
    docs = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in enumerate(texts)], DOCS)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, labels[0]), (None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, marks).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_swapped_terms_change_scores_less_with_the_penalty():
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice([f"w{k}" for k in range(50)], 8))
        toxic = i % 2
        # the corpus is unfair: one group is named in toxic texts, another in clean ones
        words[0] = ("muslim" if toxic else "christian") if rng.random() < 0.8 else words[0]
        if toxic:
            words[3] = "vermin"
        texts.append(" ".join(words))
        labels.append(toxic)

    def gap(model):
        p = model.scores(pa.array(["the muslim family w1 w2", "the christian family w1 w2"]))
        return abs(p[0] - p[1]), p

    free, _ = gap(toxicity.train(texts, labels, penalty=0.0))
    tied, p = gap(toxicity.train(texts, labels, penalty=30.0))
    assert tied < free / 3 and max(p) < 0.5
    assert toxicity.train(texts, labels, penalty=30.0).scores(pa.array(["w1 vermin w2"]))[0] > 0.5


def test_toxicity_edge_cases(spark):
    empty_marks = spark.createDataFrame([], "doc_id long, toxic int, text string")
    odd = [(1, None), (2, ""), (3, "word " * 30000), (None, "x"), (4, "same"), (4, "same"), (5, "!!! ... \n\n")]
    docs = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in odd], DOCS)
    rows = toxicity.score_documents(docs, empty_marks).collect()
    assert len(rows) == len(odd) and all(r["predicted"] == 0 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert toxicity.score_documents(docs.limit(0), empty_marks).count() == 0


def test_quality_on_held_out_texts(spark):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 != 0
        words = list(rng.choice([f"word{k}" for k in range(200)], 50))
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "s", "x", "y"))
        marks.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == marks[i][1] for i in held]) > 0.97
    odd = spark.createDataFrame([(1, None, "", "", ""), (2, "", "", "", ""), (None, "x " * 40000, "", "", ""), (3, "!!", "", "", ""), (3, "!!", "", "", "")], DOCS)
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_sample_is_cut_inside_a_slice_and_never_empty_without_an_error(spark):
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = [(hot, f"word{k} " * 10) for k in range(400)]  # one id, so one slice of ids, of twelve times the bound
    marks = spark.createDataFrame([(hot, 1)], "doc_id long, toxic int")
    total = lambda df: sum(len(r["text"]) + 64 for r in df.collect())
    took = total(c.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), marks, "toxic", 5, 5000))
    assert 4000 < took <= 5000
    large = spark.createDataFrame([(hot, "x" * 6000), *rows[:20]], "doc_id long, text string")
    assert c.labelled_sample(large, marks, "toxic", 5, 5000).count() == 20
    with pytest.raises(ValueError, match="no labelled training text"):
        toxicity.fit(large.filter("length(text) > 5000"), marks, sample_chars=5000)


def test_temperature_calibrates_a_noisy_problem():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 10))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality.train_network(x, y)
    fresh = rng.normal(size=(3000, 10))
    truth = 1 / (1 + np.exp(-fresh[:, 0]))
    assert np.abs(net.probability(fresh) - truth).mean() < 0.15


def test_the_smaller_of_different_labels_of_an_id_counts(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for i in range(200) for k in range(5)], "doc_id long, toxic int").repartition(7)
    got = c.labelled_sample(docs, labels, "toxic", 5, 1_000_000).collect()
    assert len(got) > 100 and {r["_label"] for r in got} == {0}


def test_token_table_gives_the_scores_of_the_network_on_pooled_vectors(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["Good", "bad!!", "12", "x-y", "fine.", "(z)"], int(n))) for n in rng.integers(0, 60, 300)] + ["", None, "again again again", "\t"]
    marks = [i % 2 for i in range(300)]
    model = quality.train(texts[:300], marks)
    want = model.network.probability(quality.pooled(pa.array(texts, pa.string()), model.vectors))
    monkeypatch.setattr(quality, "MOST_TOKENS", 4)  # forgets between batches
    for k in range(0, len(texts), 37):
        got = model.scores(pa.array(texts[k:k + 37], pa.string()))
        assert np.abs(got - want[k:k + 37]).max() < 1e-5
