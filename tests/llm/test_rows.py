"""Chat formatting, mixing, vantage-point search, and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, mixing, pii, storage, toxicity, vantage
from quern.llm.tokenization import encoder


def test_chat_round_trip(spark):
    hostile = ["\\### Assistant: </turn> ok", "<turn user>&lt;", "&amp;lt;<sep/>", "", None, "a\nb", "🙂 é", "</turn>\n<turn assistant>x</turn>\n"]
    rows = [(c, t, ("user", "assistant", "assistant", "sys>tem&")[(c + t) % 4], hostile[(c * 3 + t) % len(hostile)]) for c in range(12) for t in range(c + 1)]
    rows += [(50, t, "assistant" if t % 3 else "user", "x" * (t % 7)) for t in range(300)] + [(60, None, None, None), (60, 1, "user", "dup"), (60, 1, "user", "dup"), (None, 0, "user", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    parsed = {r.conv_id: r for r in chat.parse(chat.format_conversations(frame)).collect()}
    digests = {r.conv_id: r for r in chat.chat_table(frame).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c])
        said = [(r, x) for _, _, r, x in turns]
        assert [(t.role, t.text) for t in parsed[c].turns] == said
        loss = [x for r, x in said if r == "assistant"]
        assert parsed[c].loss_texts == loss
        f = formatted[c].formatted
        undo = lambda s: s.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
        assert [undo(f[m.start : m.start + m.length]) for m in formatted[c].mask] == loss
        assert f.count("<turn ") == sum(k == 0 or said[k][0] != said[k - 1][0] for k in range(len(said)))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(digests[c]) == (c, len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len("".join(loss)), sha("".join(loss)), len(f))
    assert chat.chat_table(frame.where("false")).collect() == []


def schedule_by_hand(a):
    total, done, out = sum(a), [0] * len(a), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // a[i]), i) for i in range(len(a)) if done[i] < a[i] and done[i] * total // a[i] <= t]
        i = min(ready)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


def test_mixing(spark):
    rows = [(k, f"t{k}", "hot" if k % 3 == 0 else f"s{k % 7}" if k % 11 else None, k, "x") for k in range(2000)] + [(7, "t7", "s0", 7, "x")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, before string")
    got = mixing.positions(frame, block_rows=8, period=100).toPandas().sort_values("mix_position")
    assert got.mix_position.tolist() == list(range(len(rows))) and Counter(got.doc_id) == Counter(r[0] for r in rows)
    assert (got.mix_release <= got.mix_slot).all() and (got.mix_slot < got.mix_deadline).all() and got.mix_slot.is_monotonic_increasing
    got["source"] = got.source.fillna("")
    n = got.source.value_counts().sort_index()
    root = n**0.5
    slots = max(100, int(np.ceil(root.sum() / root.min() * mixing.LEAST_SLOTS)))
    a = np.maximum(1, np.round(root / root.sum() * slots)).astype(int)
    assert (np.abs(a / a.sum() - root / root.sum()) <= root / root.sum() / 15).all()
    plan = schedule_by_hand(a.tolist())
    blocks = got.drop_duplicates(["source", "mix_block"])
    names = list(n.index)
    for r in blocks.itertuples():
        i = names.index(r.source)
        period, slot = divmod(r.mix_slot, sum(a))
        assert plan[slot] == (i, r.mix_block - period * a.iloc[i])
    horizon = int(min((n[s] // 8) / a[s] for s in names) * sum(a))
    for s in names:
        at = np.sort(blocks[blocks.source == s].mix_slot)
        t = np.arange(horizon)
        assert np.abs(np.searchsorted(at, t) - t * a[s] / sum(a)).max() < 1
    weights = mixing.positions(frame, weights={"hot": 3.0, "s1": 1.0}, block_rows=8, period=10).select("mix_position").toPandas()
    assert sorted(weights.mix_position) == list(range(len(rows)))
    mixed = mixing.mixed(frame, rows_per_partition=300, block_rows=8, period=100)
    assert mixed.columns == frame.columns and [len(p) for p in mixed.rdd.glom().collect()] == [300] * 6 + [203]
    assert [r.doc_id for r in mixed.collect()] == got.doc_id.tolist()
    assert mixing.positions(frame.where("false")).collect() == [] and mixing.mixed(frame.where("false")).collect() == []
    own = frame.limit(50).selectExpr("doc_id", "source", "n as mix_position", "text as row", "n as hash", "text as bucket", "map('a', n) as rank")
    kept = mixing.mixed(own, rows_per_partition=20)
    assert kept.columns == own.columns and sorted(map(str, kept.collect())) == sorted(map(str, own.collect()))
    assert sorted(r.mix_position for r in mixing.positions(own).collect()) == list(range(50))


def test_schedule_of_many_sources(spark):
    """Equal and very unequal weights against a plain simulation; targets are met, the smallest too."""
    weights = [1, 1, 1, 2, 2, 3, 5, 5, 5, 5, 40, 97, 300]
    one = spark.createDataFrame([([f"s{k:02}" for k in range(13)], [1000] * 13, weights, sum(weights))], "names array<string>, n array<long>, share array<long>, period long")
    got = sorted((r.slot, r.source, r.j) for r in mixing.schedule(one).collect())
    assert got == [(t, f"s{i:02}", j) for t, (i, j) in enumerate(schedule_by_hand(weights))]
    counts = spark.createDataFrame([("big", 10**6), ("small", 100), ("tiny", 1)], "source string, n long")
    table = mixing.sources_table(counts, {"big": 1.0, "small": 0.0016, "tiny": 0.0001}, 0.5, 1000).first()
    assert np.allclose(np.array(table.share) / table.period, np.array([1, 0.0016, 0.0001]) / 1.0017, rtol=1 / 16)


def test_rows_of_no_id_are_spread(spark):
    rows = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'hot' as source", "id as n")
    got = mixing.positions(rows, block_rows=16)
    assert sorted(r.mix_position for r in got.collect()) == list(range(6000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [len(p) for p in mixing._placed(rows, None, 0.5, 16, 1000, "doc_id", "source")[1].rdd.glom().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.7 * sum(sizes) == 0.7 * 6000


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (700, 8)), np.repeat(rng.normal(0, 1, (1, 8)), 300, 0)])
    ids = np.arange(1000) * 2
    q = x[::50]
    tree = vantage.Tree(x, ids, leaf=16)
    best, found = tree.search(q, ids[::50], 10, 1.0)
    d = vantage.distances(q, x)
    d[np.arange(len(q)), np.arange(0, 1000, 50)] = np.inf
    for k in range(len(q)):
        order = np.lexsort((ids, d[k]))[:10]
        assert found[k].tolist() == ids[order].tolist() and np.array_equal(best[k], d[k][order])
    few, who = vantage.Tree(x[:3], ids[:3]).search(q[:1], ids[:1], 10, 0.5)
    assert np.isfinite(few).sum() == 2 and (who == -1).sum() == 8


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 6)).astype(np.float32)
    rows = [(k, v.tolist(), "e") for k, v in enumerate(x)]
    rows[100] = (100, rows[0][1], "e")
    bad = [(901, None, "e"), (902, [], "e"), (1000, [0.0] * 6, "e"), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0], "e"), (904, [float("nan")] * 6, "e"), (905, [float("inf")] * 6, "e"), (None, [1.0] * 6, "e"), (1100, [1.0, 2.0], "e"), (907, [1.0, 2.5], "e")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, shard string")
    got = vantage.nearest(frame, factor=1.0, shard_rows=200, query_rows=4).toPandas()
    full = np.array([r[1] for r in rows], np.float64)
    for q in range(0, 900, 100):
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(900), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == order.tolist() and np.allclose(mine.score, d[order], rtol=1e-15) and mine["rank"].tolist() == list(range(1, 11))
    assert got[got.query_id == 1100].vec_id.tolist() == [907] and set(got.query_id) == {*range(0, 900, 100), 1100}
    approx = vantage.nearest(frame, shard_rows=200).toPandas()
    pairs = lambda f: set(zip(f.query_id, f.vec_id, strict=True))
    assert len(pairs(approx) & pairs(got)) >= 0.9 * len(got) and vantage.nearest(frame.where("false")).collect() == []


def test_nearest_of_repeated_rows_and_extreme_vectors(spark):
    rng = np.random.default_rng(4)
    x = [*rng.normal(0, 1, (300, 5)), *rng.normal(0, 1, (60, 5)) * 1e200, *rng.normal(0, 1, (60, 5)) * 1e-200, *np.ones((200, 5))]
    rows = [(k, v.tolist(), f"s{k}") for k, v in enumerate(x)]
    twice = rows + rows[:150] + [(200, [9.0] * 5, "other vector"), (0, rows[0][1], "other column")]
    got = vantage.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>, point string"), factor=1.0, shard_rows=16, query_rows=2).toPandas()
    assert not got.duplicated(["query_id", "score", "vec_id"]).any() and set(got.query_id) == {0, 100, 200, 300, 400, 500, 600}
    ids, full = np.array([r[0] for r in rows] + [200]), np.array([*x, np.full(5, 9.0)])
    for q, v in [(k, x[k]) for k in range(0, 620, 100)] + [(200, np.full(5, 9.0))]:
        diff = full - v
        most = np.abs(diff).max(axis=1)
        d = most * np.sqrt(((diff / np.where(most, most, 1)[:, None]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = got[got.query_id == q]
        at = [k for k in range(len(mine)) if mine.vec_id.iloc[k] in ids[order]]
        assert np.isfinite(mine.score).all() and len(mine) == (20 if q == 200 else 10)
        if q != 200:
            mine = mine.sort_values("rank")
            assert np.allclose(mine.score, d[order], rtol=1e-12, atol=0) and (mine.vec_id.tolist() == ids[order].tolist() or q >= 300), (q, mine, ids[order])
        else:
            assert len(at) >= 10


def test_shards_of_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 50, (12, 8))
    x = np.concatenate([c + rng.normal(0, 1, (100, 8)) for c in centres])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    points = vantage._points(rows, 1200, 40)
    placed = vantage._shelled(vantage._placed(rows, points, "<f8"), 40)
    shells = placed.groupBy(*vantage.SHELL).agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    asked = placed.where("id % 100 = 0").select(*vantage.SHELL, F.col("id").alias("query_id"), F.lit(0).cast("long").alias("number"), F.lit(4.0).alias("bound"), "v")
    reached = vantage._reached(asked, shells, points, 1.0, "<f8").count()
    assert len(points[8]) == 7 and len(shells) > 20 and reached < 0.5 * 12 * len(shells)
    got = vantage.nearest(frame, factor=1.0, shard_rows=40).toPandas()
    for q in range(0, 1200, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(d, kind="stable")[:10].tolist()


def test_recall_on_the_given_vectors(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact, fast = (vantage.nearest(frame, factor=f, shard_rows=128).toPandas() for f in (1.0, 0.3))
    assert len(exact.merge(fast, on=["query_id", "vec_id"])) >= 0.9 * len(exact)


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark, sf):
    """Every stage's rows from plain recomputation: scores, all pairs of sets, spans, token ids."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    left = sorted(i for i in text if scores[i] < 0.5)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[i])) for i in left}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    low = {i: i for i in left}

    def find(i):
        return i if low[i] == i else find(low[i])

    for i in left:
        for j in left:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    kept = [i for i in left if find(i) == i]
    assert len(kept) < len(left)
    field = pii.fit(docs.where(F.col("doc_id").isin(kept)))
    told = {i: pii.redact_text(text[i], pii.base_spans(text[i]) + field.added(text[i], pii.base_spans(text[i]))) for i in kept}
    library = encoder().library
    tokens = {i: [*library.encode(told[i], add_special_tokens=False).ids, 1] for i in kept}
    got, sequences = {i: 0 for i in kept}, Counter()
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == got[r.doc_id] and r.doc_tokens == len(tokens[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(tokens[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        got[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert got == {i: len(x) for i, x in tokens.items()} and max(sequences.values()) <= 2048


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Empty tables, null ids and texts, repeated rows, a very long text, and columns named as the stages' own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    word = lambda k: f"w{k * 7919 % 100_003}"
    long = " ".join(word(k) for k in range(150_000))
    rows = [(k, " ".join(word(k * 50 + j) for j in range(40)), "en", f"s{k % 3}", 1) for k in range(20)]
    rows += [(1, rows[1][1], "en", "s1", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(50, "", "en", None, 0), (51, None, None, "s0", None), (52, long, "en", "s0", 2), (None, rows[2][1], "en", "s0", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = "row hit bucket id fp p h __hit __rank rank hash at slot mix_slot mix_position a b text_a doc leader salt score label".split()
    frame = frame.withColumns({c: F.lit(c) for c in extra})
    for start in (frame, frame.where("false")):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = storage.stored(stage(spark, docs, sf), f"odd-{name}")
            assert docs.columns == frame.columns and docs.where("mix_slot <> 'mix_slot' or row <> 'row'").count() == 0
        ids = sorted((r.doc_id for r in docs.collect()), key=str)
        assert ids == ([] if start is not frame else sorted([*range(20), 50, 51, 52, None, None], key=str))
        packed = corpus_pipeline.pack(spark, docs, sf).collect()
        assert {r.doc_id for r in packed} == set(ids) and (start is frame or packed == [])


def test_pipeline_links_from_four_fifths(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, want = [], set()
    for n, stays in ((100, False), (104, False), (108, False), (60, True)):
        words = [f"w{n}x{k}" for k in range(n)]
        other = [f"z{k}" if k in (20, n - 20) else w for k, w in enumerate(words)]
        a, b = shingles(words), shingles(other)
        assert (len(a & b) / len(a | b) >= 0.8) != stays and len(a & b) / len(a | b) < 0.85
        rows += [(2 * n, " ".join(words), 0, "a", "b"), (2 * n + 1, " ".join(other), 0, "a", "b")]
        want |= {2 * n, 2 * n + 1} if stays else {2 * n}
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, lang string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()} == want


def test_packed_sequences_follow_the_schedule(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(4)
    rows = [(k, "some words " * int(rng.integers(1, 40)), 0, f"s{k % 3}", "b") for k in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, lang string")
    order = mixing.mixed(frame, rows_per_partition=200, block_rows=8)
    # texts grow from part to part, so that a read in the order of sizes turns the schedule round
    longer = order.withColumn("text", F.expr("repeat(concat_ws(' ', text, sha2(text, 256), doc_id), 1 + 2 * spark_partition_id())"))
    table = storage.stored(longer, "schedule_test")
    part = {r.doc_id: r.p for r in order.select("doc_id", F.spark_partition_id().alias("p")).collect()}
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    for cost in ("64m", "1k"):  # files joined in few partitions, and files apart
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        read = [r.doc_id for r in table.select("doc_id").collect()]
        assert [part[i] for i in read] != sorted(part[i] for i in read)
        got = corpus_pipeline.pack(spark, table, "").collect()
        by_sequence = [part[r.doc_id] for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
        assert by_sequence == sorted(by_sequence) and set(by_sequence) == set(range(6))
        tokens = Counter()
        for r in got:
            tokens[r.doc_id] += r.length
        assert tokens == {r.doc_id: r.doc_tokens for r in got} and len(tokens) == len(rows)
        slots = Counter()
        for r in got:
            slots[r.sequence_id, r.offset] += 1
        assert set(slots.values()) == {1}
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert storage.written_place(frame) is None and storage.written_place(table.groupBy("doc_id").count()) is None


def test_pipeline_leaves_one_row_of_whole_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1), "a"), (1, text(1), "a"), (1, text(1), "b"), (1, text(2), "a"), (2, text(3), "a"), (3, text(3), "a"), (3, text(3), "a")]
    rows += [(None, text(1), "a"), (None, text(3), "a"), (None, text(4), "b"), (None, text(4).upper(), "a"), (None, " ", "a"), (None, None, "a"), (5, "", "a"), (5, "", "a"), (6, text(6), "a")]
    shape = "doc_id long, text string, source string"
    want = [(1, text(1), "a"), (1, text(2), "a"), (2, text(3), "a"), (None, text(4).upper(), "a"), (None, " ", "a"), (None, None, "a"), (5, "", "a"), (6, text(6), "a")]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, shape), "")
    assert left.columns == ["doc_id", "text", "source"] and sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    # repeats, but no null id
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows[:7], shape), "")
    assert sorted(map(tuple, left.collect())) == sorted(want[:3])
