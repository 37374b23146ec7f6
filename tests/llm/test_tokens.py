"""Token ids, seekable files and packing."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import packing, seekable
from riskframe.llm.tokens import Encoder

DOCS = "doc_id long, text string, piece string, start string"
ODD = ["", "  a  b", "a\t b\n\n c", "x \n y  ", " lead", "trail ", "\n\n", "İ ǅ é ́x don't  we'll", "ab.cd e.\n'Tis it's;'s \n", "\x01a",
       "a\ńb ñ.́", "x   b", "One.two,three!", "<|endoftext|> x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_stretches_give_the_ids_of_the_whole_text(name):
    e = Encoder(public_tokenizers.path(name))

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab .,!?\n\t'é́ \x01|1"), max_size=25), max_size=4))
    def check(texts):
        texts = texts + ODD
        ids, lengths = e.encode(pa.array([*texts, None], pa.string()), 2)
        ends = np.cumsum(lengths)
        for t, end, n in zip([*texts, ""], ends, lengths, strict=True):
            assert ids[end - n:end].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]

    check()


def _rows(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "of", "theawh", "ndst."], int(n))) for n in rng.integers(0, 3000, 60)]
    rows = [(int(i), t, "p", "s") for i, t in zip(rng.permutation(60), texts, strict=True)]
    rows += [(100, None, "", ""), (101, "", "", ""), (7, "again", "", ""), (7, "again", "", ""), (None, "no id", "", ""), (102, "long word " * 40000, "", "")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def test_token_files_round_trip(spark):
    rows, df = _rows(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    files = seekable.write_token_files(df, path)
    got = sorted((tuple(r) for r in seekable.read_token_files(files).collect()), key=lambda r: r[1])
    e = Encoder(path).tokenizer
    start = 0
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    by_id = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[1] or ""):
        by_id.setdefault(i, []).append([*e.encode(t or "", add_special_tokens=False).ids, 2])
    seen = {}
    for doc_id, at, n, crc in got:
        ids = by_id[doc_id][seen.setdefault(doc_id, 0)]
        seen[doc_id] += 1
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += n
    # A reader finds single documents, and any zstandard reader reads the frames.
    first = files.orderBy("part").first()["path"]
    reader = seekable.Reader(first)
    ids, lengths, tokens = reader.frame(0)
    known = next(i for i in ids if i is not None)
    assert reader.document(known)[0].tolist() == by_id[known][0] and len(reader.document(known)) == len(by_id[known])
    with open(first.removeprefix("file://"), "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain.startswith(seekable.pack_frame(ids, lengths, tokens))
    assert seekable.read_token_files(seekable.write_token_files(df.limit(0), path)).count() == 0


def test_damaged_frames_are_found(tmp_path):
    path = str(tmp_path / "x.tok")
    w = seekable.Writer(path)
    for k in range(3):
        w.add([k, None], np.array([2, 1], dtype=np.uint32), np.array([k, 5, 2], dtype=np.uint32))
    w.close()
    r = seekable.Reader(path)
    assert len(r) == 3 and r.frame(2)[0] == [2, None] and r.document(1)[0].tolist() == [1, 5] and r.document(9) == []
    size, raw, checksum = r.entries[1]
    r.entries[1] = (size, raw, checksum ^ 1)
    with pytest.raises(seekable.ChecksumError):
        r.frame(1)
    assert r.frame(0)[2].tolist() == [0, 5, 2]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=0))
def test_a_plan_uses_every_piece_once(available):
    plan = packing.plan(available, 32)
    used = {}
    for filling, n in plan:
        assert n > 0 and 0 < sum(filling) <= 32
        for x in filling:
            used[x] = used.get(x, 0) + n
    assert used == available
    total = sum(k * v for k, v in available.items())
    least = max(-(-total // 32), sum(v for k, v in available.items() if k > 16))
    assert sum(n for _, n in plan) <= 1.5 * least + 1


def test_exact_complements_are_used():
    assert packing.plan({10: 3, 22: 3, 32: 2}, 32) == [((32,), 2), ((22, 10), 3)]
    assert sum(n for _, n in packing.plan({16: 4, 12: 4, 4: 4}, 32)) == 4


def test_packing_places_every_piece(spark):
    rows, df = _rows(spark)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=256).collect()
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    want = {}
    for i, t, *_ in rows:
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (i, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    have, places = {}, {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        have[key] = have.get(key, 0) + 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 256) + 2
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
