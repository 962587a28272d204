"""Personal data, media, near duplicates, toxicity and quality on fixtures with known answers."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import labelled, media, nbsvm, near_duplicates, pii, storage, toxicity
from quern.llm.textcore import text_buffers

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_patterns(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("01234 -.@+()a%é25") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == by_patterns(t), t
    for hard in ("1" * 10**6, "a" * 10**6 + "@", "1.1" * 200_000, "+1" * 200_000, "@" * 50_000):
        pii.base_spans(hard)


def test_consistency_adds_and_keeps():
    t = "Call +1 (743) 555-3824 now. Or (743) 555-3824, 743 555 3824; mail j.doe7@ex.com; J.DOE7 wrote. Order 123456789 12 and 2024-01-02."
    base, field = pii.base_spans(t), pii.train([f"+1 (743) 555-{k} and order {k * 977} x{k}@y.org" for k in range(1000, 1200)])
    added = field.added(t, base)
    assert {(pii.KINDS[k], t[a:b]) for k, a, b in added} == {("phone", "(743) 555-3824"), ("phone", "743 555 3824"), ("email", "J.DOE7")}
    assert pii.redact_text(t, base + added).startswith("Call <PHONE> now. Or <PHONE>, <PHONE>; mail <EMAIL>; <EMAIL> wrote. Order 123456789 12")
    assert field.added("order 12345678901", []) == []


@pytest.mark.parametrize("n", [2, 5, 10, 1000])
def test_one_base_span_reaches_every_repeat(n):
    between = " several words that say nothing of note lie between, and order 20240102 too, before "
    fitted = pii.train([f"+1 (743) 555-{k} and order {k * 977} x{k}@y.org" for k in range(1000, 1200)])
    for field in (pii.Field(), fitted, pii.Field(fitted.node, 0.5, 9.0)):
        for repeat in ("(743) 555-3824", "743 555 3824"):
            many = (between + repeat) * n
            for t in ("Call +1 (743) 555-3824 now." + many, many + between + "+1 (743) 555-3824"):
                base = pii.base_spans(t)
                assert len(base) == 1
                assert [(k, t[a:b]) for k, a, b in field.added(t, base)] == [(3, repeat)] * n


def marginals_by_enumeration(unary, pairs, weights):
    n, labels = unary.shape
    total = np.zeros((n, labels))
    for state in np.ndindex(*[labels] * n):
        p = np.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(w for (i, j), w in zip(pairs, weights, strict=True) if state[i] == state[j]))
        total[range(n), state] += p
    return total / total[0].sum()


def test_messages_against_exact_marginals():
    rng, field = np.random.default_rng(3), pii.Field()
    for n in (1, 2, 4, 5):
        for _ in range(5):
            unary = rng.normal(0, 1.5, (n, pii.N_LABELS))
            tree = np.array([(int(rng.integers(0, j)), j) for j in range(1, n)], np.int64).reshape(-1, 2)
            weights = rng.uniform(-1, 5, len(tree))
            exact = marginals_by_enumeration(unary, tree.tolist(), weights)
            assert np.allclose(np.exp(field.beliefs(unary, tree, weights)), exact, atol=2e-3)
    agreed = 0
    for _ in range(30):  # chain and skip edges with loops: approximate, but the likeliest labels are the exact ones
        unary = rng.normal(0, 1.5, (5, pii.N_LABELS))
        pairs, weights = np.array([(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (2, 4)]), np.array([0.2, 0.1, 0.2, 0.1, 1.5, 1.5])
        exact = marginals_by_enumeration(unary, pairs.tolist(), weights)
        got = np.exp(field.beliefs(unary, pairs, weights))
        assert np.abs(got - exact).max() < 0.15
        agreed += (got.argmax(1) == exact.argmax(1)).all()
    assert agreed >= 28


def test_weights_are_learnt():
    texts = [f"Mail j.doe{k}@ex{k}.org or call +1 (743) 555-{1000 + k}; order {k * 7919} of 2024-01-{10 + k % 20}; card 4111 1111 1111 1111." for k in range(60)]
    one, many = pii.train(texts[:1]), pii.train(texts)
    for field in (one, many):
        assert field.skip > 1 and field.skip not in (4.0, 6.0, 9.0) and not np.array_equal(field.node, pii.Field().node)
    told = "Call +1 (743) 555-1001. Then (743) 555-1001, (743) 555-9999, 555-1001 and 4111.1111.1111.1111, card 4111-1111-1111-1111, J.DOE3 and j.doe3@ex3.org."
    added = {told[a:b] for _, a, b in many.added(told, pii.base_spans(told))}
    assert added == {"(743) 555-1001", "4111.1111.1111.1111", "J.DOE3"}
    assert pii.train(["no candidate"]).skip == pii.Field().skip


def test_candidates():
    t = "x1y2z3 ab_cd. 12345678 and _____ +1 (743) 555-3824 a1b2c3@ 9.9.9.9"
    base = [(a, b) for _, a, b in pii.base_spans(t)]
    got = [t[a:b] for a, b in pii.candidates(t, base)]
    assert got == ["x1y2z3", "ab_cd", "12345678", "a1b2c3"]
    assert pii.candidates("1234567 1234567", [(0, 9), (0, 1), (0, 2), (0, 3), (1, 2), (2, 3)]) == []
    field = pii.Field()
    for hard in ("_" * 10**6, "1 " * 500_000, "a_" * 500_000, "-." * 500_000, "(1" * 500_000, "@" * 10**6):
        began = time.perf_counter()
        field.added(hard + " a@b.co", pii.base_spans(hard + " a@b.co"))
        assert time.perf_counter() - began < 20


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, p string, text_a string")


def test_pii_frames(spark):
    d = docs(spark, [(1, "a@b.co", 6, "x", "y"), (None, None, None, None, None), (1, "a@b.co", 6, "x", "y"), (2, "", 0, None, None)])
    got = sorted(map(tuple, pii.find(d).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(1, 1, 0, 0, 0, sha("email:0:6"), "email:0:6", 0)] * 2 + [(None, 0, 0, 0, 0, sha(""), "", 0), (2, 0, 0, 0, 0, sha(""), "", 0)], key=str)
    red = pii.redact(d).collect()
    assert sorted(map(str, {(r.text, r.n_chars) for r in red})) == sorted(map(str, {("<EMAIL>", 7), (None, None), ("", 0)})) and pii.redact(d).columns == d.columns
    assert pii.find(d.where("false")).collect() == []
    told = " ".join(f"Call +1 (743) 555-{1000 + k} now, or (743) 555-{1000 + k}. Order 743555{k}." for k in range(3))
    planted = pii.find(docs(spark, [(k, told, 0, None, None) for k in range(40)])).collect()
    assert {(r.n_phone, r.n_added) for r in planted} == {(6, 3)}
    long = pii.find(docs(spark, [(1, "word " * 400_000 + "a@b.co " + "_" * 1_000_000, 0, None, None)])).first()
    assert long.n_email == 1


def test_media(spark, tmp_path):
    import tarfile

    texts = ["", None, "é" * 100, "x" * 64, "x" * 64, "a", "a\x00", "long " * 30_000]
    d = docs(spark, [(k, t, 0, "s", "t") for k, t in enumerate(texts)])
    index = media.write_shards(d)
    rows = {r.doc_id: r for r in media.read_back(index).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_image(media.to_image(payload)) == payload
    assert rows[3][2:] == rows[4][2:] and rows[0][2:] == rows[1][2:] and (rows[7].width, rows[7].height, rows[7].depth) == (64, rows[7].payload_bytes // 64, 8)
    dark = media.feature(b"a" * 32_000 + b"b" * 32_000)
    assert dark != media.feature(b"b" * 32_000 + b"a" * 32_000) and dark != media.feature(b"a" * 40_000 + b"b" * 24_000) and media.feature(b"q" * 64)[-16:] == "0" * 16
    shard = index.first().shard
    with tarfile.open(storage.filesystem(shard)[1]) as tar:
        for m in tar.getmembers():
            assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() == m.name.removesuffix(".png")
    meta = media.fill_metadata(index).where("doc_id = 7").first()
    assert (meta.width, meta.height, meta.depth) == (64, rows[7].payload_bytes // 64, 8)
    broken = bytearray(media.to_image(b"q" * 64))
    broken[50] ^= 1
    with pytest.raises(Exception):
        media.from_image(bytes(broken))
    assert media.media_table(d.where("false")).collect() == []


def family(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def components_by_brute_force(rows):
    sets = defaultdict(list)
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i].append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (60, 120, 300, 40)]
    rows = [(10 * f + k, family(rng, b, k % 7)) for f, b in enumerate(base) for k in range(10)]
    rows += [(100, "One two"), (101, "ONE  two\n"), (102, ""), (103, None), (104, "two one"), (105, base[2] + " tail"), (106, " ".join(base[2].split()[:280])), (107, base[0].upper()), (107, base[1])]
    rows += [(200 + k, family(rng, base[1], 3)) for k in range(40)]
    d = docs(spark, [(i, t, 0, "a", "b") for i, t in rows] + [(None, base[0], 0, "a", "b")])
    want, sets = components_by_brute_force(rows)
    got = near_duplicates.near_duplicates(d).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles in {len(s) for s in sets[r.doc_id]}, r
    left = near_duplicates.survivors(d, near_duplicates.near_duplicates(d))
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {None, *want.values()}
    assert near_duplicates.near_duplicates(d.where("false")).collect() == []


def test_hot_leaders_and_families_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LEADER_PAIRS", 4)
    monkeypatch.setattr(near_duplicates, "OPEN_SETS", 3)
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(150))
    rows = [(k, family(rng, base, 2 + k % 5)) for k in range(60)] + [(100, base)]
    parted = near_duplicates.led(spark.createDataFrame([(100, k) for k in range(60)] + [(1, 2)], "a long, b long")).collect()
    assert sorted((r.leader, r.member) for r in parted if r.leader == 100) == [(100, k) for k in range(60)]
    assert len({r.salt for r in parted if r.leader == 100}) > 5 and len(parted) == 61
    want, _ = components_by_brute_force(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs(spark, [(i, t, 0, "a", "b") for i, t in rows])).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates_of_the_given_documents(spark, threshold):
    """Every component of a whole table against all pairs that share a shingle."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    holders, sets = defaultdict(list), {}
    for r in d.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for x in sets[r.doc_id]:
            holders[x].append(r.doc_id)
    common = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[b, a] += 1
    low = {i: i for i in sets}

    def find(i):
        return i if low[i] == i else find(low[i])

    for (a, b), n in common.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    got = near_duplicates.near_duplicates(d, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert sum(not r.kept for r in got) > 50


def test_estimates():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 1.0):
        common = rng.integers(0, 2**64, int(4000 * share), dtype=np.uint64, endpoint=False)
        own = [rng.integers(0, 2**64, 4000 - len(common), dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([common, o])) for o in own]
        regs = near_duplicates.registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        guess, cells = near_duplicates.estimate(regs[:1], regs[1:], np.array([4000]), np.array([4000]))
        assert abs(guess[0] - len(common) / (8000 - len(common))) < 0.12 and cells[0] == 256


def labelled_docs(spark, good, bad, n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        rows.append((k, (bad if k % 3 == 0 else good)(rng, words), 0, "s", None))
    return docs(spark, rows), spark.createDataFrame([(k, int(k % 3 != 0), int(k % 3 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, labels = labelled_docs(spark, lambda r, w: " ".join(w) + ".", lambda r, w: " ".join(x.upper() + "!!" for x in w))
    model = nbsvm.fit(d, labels)
    d = d.unionAll(docs(spark, [(None, None, 0, None, None), (-1, "", 0, None, None), (-2, " ".join(f"{chr(65 + k % 26)}{chr(65 + k // 26 % 26)}BC!!" for k in range(20_000)), 0, None, None)]))
    got = {r.doc_id: r for r in nbsvm.score(d, model).collect()}
    right = [got[k].predicted == (k % 3 != 0) for k in range(400) if got[k].held_out]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values()) and got[None].score == got[-1].score > got[-2].score
    assert got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    one = nbsvm.fit(d, labels.where("quality = 1"))
    assert {r.predicted for r in nbsvm.score(d, one).collect()} == {1} and nbsvm.score(d.where("false"), one).collect() == []
    assert nbsvm.fit(d, labels.where("false")).score(np.array([3])) == 0.5


def test_descent_against_plain_subgradient():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 20, 6)) for _ in range(200)]
    y = np.where([r[0] < 4 for r in rows], 1.0, -1.0)
    scale = rng.normal(0, 1, 20)
    w, b = nbsvm.dual_coordinate_descent(rows, y, scale, 1.0, rounds=300, tolerance=1e-6)
    x = np.zeros((200, 20))
    for k, r in enumerate(rows):
        x[k, r] = scale[r]
    loss = lambda v, c: 0.5 * (v @ v + c * c) + np.maximum(0, 1 - y * (x @ v + c)).sum()
    best = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.02, 20), b + rng.normal(0, 0.02)) >= best - 1e-3


def test_toxicity(spark):
    slurs = ["grobnik", "zulkar", "pfennelwitz"]

    def toxic(rng, words):
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(slurs) + rng.choice(["", "en", ","])
        return " ".join(words)

    d, labels = labelled_docs(spark, lambda r, w: " ".join(w), toxic)
    model = toxicity.fit(d, labels)
    extra = [(None, None, 0, None, None), (-1, "", 0, None, None), (-2, "plain " * 20_000 + "Grobnik zulkarx pfennelwitz", 0, None, None)]
    d = d.unionAll(docs(spark, extra))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [k for k in range(400) if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in held]) > 0.97 and got[-2].predicted == 1 and got[-1].predicted == 0 == got[None].predicted
    some = next(k for k in held if k % 3 == 0)
    assert set(got[some].evidence) <= {k for k in range(400) if zlib.crc32(str(k).encode()) % 5} and got[some].cosines == sorted(got[some].cosines, reverse=True)
    kept = toxicity.kept(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, labels.where("toxic = 0"))).collect()} == {0.0}


def test_toxicity_against_brute_force_cosines(spark):
    """Every neighbour and cosine from plain dictionaries of whole texts."""
    def marked(rng, words):
        words[rng.randrange(len(words))] = rng.choice(["grobnik", "zulkar"])
        return " ".join(words)

    d, labels = labelled_docs(spark, lambda r, w: " ".join(w), marked, 250)
    model = toxicity.fit(d, labels)
    text = {r.doc_id: r.text for r in d.collect()}

    def unit(t):
        found = defaultdict(int)
        for w in re.findall("[0-9a-z]+", t.lower()):
            for x in {w, w[:4] if len(w) > 4 else w, w[:5] if len(w) > 5 else w}:
                found[x] += 1
        raw = np.frombuffer(" ".join(found).encode(), np.uint8)
        _, h, word = toxicity.terms(raw, np.array([0, len(raw)]))
        words = dict(zip(found, h[word].tolist(), strict=True))
        stems = lambda w, n: int(toxicity.terms(np.frombuffer((w + "x" * 9).encode(), np.uint8), np.array([0, len(w) + 9]))[1][n - 3])
        factor = dict(zip(model.hashes.tolist(), model.factor.tolist(), strict=True))
        counts = defaultdict(int)
        for w in re.findall("[0-9a-z]+", t.lower()):
            counts[words[w]] += 1
            for n in (4, 5):
                if len(w) > n:
                    counts[stems(w[:n], n)] += 1
        out = {x: (1 + np.log(c)) * factor[x] for x, c in counts.items() if x in factor}
        size = np.sqrt(sum(v * v for v in out.values()))
        return {x: v / size for x, v in out.items()}

    examples = {i: unit(text[i]) for i in model.index.ids.tolist()}
    rows = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(examples) > 150 and all(r.evidence for r in rows.values())
    for i in list(rows)[::9]:
        own = unit(text[i])
        want = sorted(((round(sum(v * e.get(x, 0) for x, v in own.items()), 9), -j) for j, e in examples.items()), reverse=True)[:15]
        assert np.allclose(rows[i].cosines, [c for c, _ in want], atol=1e-9)
        assert len(set(rows[i].evidence) & {-j for _, j in want}) >= 14
        vote = (sum(c * (-j % 3 == 0) for c, j in want) + model.floor) / (sum(c for c, _ in want) + 1)
        assert abs(model.calibrated(vote) - rows[i].score) < 1e-6
    clean = next(i for i in rows if i % 3 and rows[i].held_out)
    assert rows[clean].score < 0.5 and len({round(r.score, 9) for r in rows.values()}) > 100


def test_toxicity_of_the_given_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(d, toxicity.fit(d, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.toxic == t] for t in (0, 1))
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.85 and all(b < 0.5 for b in good)


def test_calibration():
    rng = np.random.default_rng(5)
    p = rng.random(4000)
    y = rng.random(4000) < p
    a, b = toxicity.logistic_curve(np.clip(p, 0.01, 0.99) ** 2 / (np.clip(p, 0.01, 0.99) ** 2 + (1 - np.clip(p, 0.01, 0.99)) ** 2), y)
    assert abs(a - 0.5) < 0.08 and abs(b) < 0.15
    assert toxicity.logistic_curve(p, np.zeros(4000, bool)) is None


def test_index_is_exact():
    rng = np.random.default_rng(8)
    unit = lambda n: (t := np.sort(rng.choice(30, n, replace=False)), (w := rng.random(n)) / np.sqrt(w @ w))
    rows, ids = [unit(int(rng.integers(1, 6))) for _ in range(300)], rng.permutation(300)
    rows[5] = rows[6]
    index = toxicity.BlockMaxIndex(ids, rows, 30, block=16)
    dense = np.zeros((300, 30))
    for k, (t, w) in enumerate(rows):
        dense[k, t] = w
    for _ in range(100):
        t, w = unit(int(rng.integers(1, 6)))
        at, cosine = index.nearest(t, w, 15)
        all_ = dense[:, t] @ w
        want = [k for k in np.lexsort((ids, -all_.round(12))) if all_[k] > 0][:15]
        assert np.allclose(cosine, np.sort(all_[want])[::-1]) and set(index.ids[at][:5]) <= set(ids[want].tolist()) | set(ids[np.isclose(all_, cosine[-1])].tolist())


def test_sample_is_bounded_and_honest(spark):
    d, labels = labelled_docs(spark, lambda r, w: "x", lambda r, w: "y")
    got = labelled.sample(d, labels.unionAll(labels.limit(5)), "toxic", 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    assert len(labelled.sample(d, labels, "toxic", 50, max_bytes=20).collect()) == 20 and labelled.sample(d, labels.where("false"), "toxic", 50).collect() == []


def test_text_buffers_of_slices():
    data, offsets = text_buffers(pa.array(["ab", None, "cde", ""]).slice(1))
    assert offsets.tolist() == [0, 0, 3, 3] and data.tobytes() == b"cde"
