"""Word hashing, tokenization, token files and packing against plain re-computation."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import packing, token_store
from quern.llm.textcore import WORDY, Words, chunks, mix, text_buffers
from quern.llm.tokenization import encoder

ODD = ["", None, " \n\t", "It's <|endoftext|> <|ENDoftext|>", "Don't we x'll 'sfoo", "a\x00b \x00 c", "é ́x \x85y\x1cz", "ΑΣ ΣΑΣ. İI ŒUVRE", "é x", "naïve,*** 12.5% a|b", "x" * 5000, "日本語 テスト", "A B a b"]


def random_texts(n=300):
    rng = random.Random(4)
    return ["".join(rng.choice("abcDE éßñ \t\n'.!<|>0129 ́") for _ in range(rng.randrange(80))) for _ in range(n)]


def test_words():
    texts = [t or "" for t in ODD] + random_texts()
    data, offsets = text_buffers(pa.array(texts))
    words = Words(data, offsets)
    split = lambda t: [w for w in t.encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    want = [split(t) for t in texts]
    assert np.diff(words.first).tolist() == list(map(len, want))
    flat = [w.lower() for ws in want for w in ws]
    lowered = lambda w: bytes(c + 32 if 65 <= c < 91 else c for c in w)
    by_hash = {}
    for w, h in zip([lowered(w) for ws in want for w in ws], words.hash.tolist(), strict=True):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash) and flat
    assert list(chunks(np.array([0, 5, 5, 100, 101]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert len(np.unique(mix(np.arange(10000, dtype=np.uint64)))) == 10000 and not WORDY[33]


def test_encoder_equals_the_library():
    enc = encoder()
    texts = ODD + random_texts()
    assert enc.by_word
    for _ in range(2):
        for first, ids, ends in enc.encode_column(pa.array(texts), 1):
            for k in range(len(ends) - 1):
                want = enc.library.encode(texts[first + k] or "", add_special_tokens=False).ids + [1]
                assert ids[ends[k] : ends[k + 1]].tolist() == want, texts[first + k]


def test_very_long_text_and_full_table():
    enc = encoder()
    text = " ".join(f"w{k}x" for k in range(40_000)) * 40
    got = list(enc.encode_column(pa.array([text])))
    part = enc.encode_column(pa.array([text[:2000]]))
    assert len(got) == 1 and next(iter(part))[1][:500].tolist() == got[0][1][:500].tolist()
    before = enc.n
    enc._reset()
    assert before > enc.n == 0


@pytest.mark.parametrize("top", [1, 255, 256, 65536, 2**32 - 1])
def test_random_access(top):
    rng = np.random.default_rng(top)
    ids = np.concatenate([rng.integers(0, top + 1, 3000), [0, top, 0]]).astype(np.uint64)
    raw = b"".join(token_store.shard_parts(np.array([7, 9]), np.array([1, 0]), np.array([0, 5, len(ids)]), ids))
    r = token_store.Reader(raw)
    assert r.ids().tolist() == ids.tolist() and r.ids(513, 2047).tolist() == ids[513:2047].tolist() and r.ids(4, 4).tolist() == []
    assert [r[i] for i in range(0, len(ids), 37)] == ids[::37].tolist() and r.starts.tolist() == [0, 5, len(ids)] and r.known.tolist() == [1, 0]
    with pytest.raises(IndexError):
        r[len(ids)]


def frame(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, ["p"] * len(texts), strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string, path string")


def test_token_store(spark):
    texts, ids = ODD + random_texts(60), [*range(50, 60), None, 3, 3, *range(100, 160)]
    library = encoder().library
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t in rows:
        tokens = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        at += len(tokens)
    got = token_store.token_store(frame(spark, texts, ids), shard_tokens=200).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.token_store(frame(spark, texts).where("doc_id < 0")).collect() == []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    one = token_store.write_tokens(frame(spark, random_texts(400), [None] * 400).repartition(4))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one.select("part").distinct().count() > 1


def test_differencing():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 500) for _ in range(200)]
    sets = packing.differencing(sizes, 12)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(200)) and max(sums) - min(sums) <= 3
    assert packing.differencing([5, 4], 3) == [[1], [0]] and packing.windows([], 8) == []
    tight = packing.windows([6, 6, 6, 6], 10)
    assert len(tight) == 4  # the sum asks for three windows; each pair exceeds the capacity, so the count rises


def test_windows_stay_those_of_the_differencing():
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.pareto(1.1, 4000) * 120 + 1, 2047).astype(int)
    sizes[-1] += 2048 - sizes.sum() % 2048
    tails = [(k, 0, np.full(n, k, np.int64), n) for k, n in enumerate(sizes.tolist())]
    count = int(sizes.sum() // 2048)
    before = packing.near_equal(tails, count)
    near = [sum(len(t[2]) for t in w) for w in before]
    moved = sum(max(0, n - 2048) for n in near)
    assert len(before) == count and max(near) - min(near) < 0.02 * 2048 and moved < 0.005 * sizes.sum()
    after = packing.levelled([list(w) for w in before], 2048)
    assert {sum(len(t[2]) for t in w) for w in after} == {2048}
    own = Counter()
    for w in after:
        for i, _, ids, _ in w:
            assert set(ids.tolist()) == {i}
            own[i] += len(ids)
    assert own == {k: n for k, n in enumerate(sizes.tolist())}


def test_blocks_of_many_tiny_documents():
    packer = packing.Packer(2048, 0)
    began = time.perf_counter()
    for k in range(300_000):
        packer.add(k, np.ones(1 + k % 3, np.int64))
    packer.pack(last=True)
    got = packer.take()
    assert time.perf_counter() - began < 60 and len(got) >= 300_000 and sum(r[2] for r in got) == sum(1 + k % 3 for k in range(300_000))


def test_packing(spark):
    texts = ODD + random_texts(200) + ["word " * 5000]
    docs = frame(spark, texts, [*range(len(texts) - 1), None]).repartition(3)
    got = packing.pack(docs, block_tokens=1000, capacity=256).collect()
    library, pieces, sequences = encoder().library, {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    ids = [*range(len(texts) - 1), None]
    for i, t in zip(ids, texts, strict=True):
        tokens = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(tokens)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[r.start : at], "<u4").tobytes())
        assert at == len(tokens)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= rows[0].sequence_length <= 256 and (rows[0].sequence_length == 256 or at & (at - 1) == 0)
        padding += rows[0].sequence_length - at
    assert padding < 3 * 256 and packing.pack(docs.where("false")).collect() == [] and Counter(len(r) for r in sequences.values())
