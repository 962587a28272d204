"""What a Python worker holds: nothing of the work before, and of an index's runs only a few rows' at a time."""

import tracemalloc

import numpy as np

from quern.llm import mixing, toxicity
from quern.llm.textcore import KEPT, trimmed
from quern.llm.tokenization import encoder


def test_other_work_drops_the_tokenizer():
    first = encoder()
    list(trimmed(lambda batches: iter(batches), keeps=("encoders",))([1]))
    assert encoder() is first and KEPT["encoders"]
    seen = list(trimmed(lambda batches: (len(KEPT["encoders"]) for _ in batches))([1]))
    assert seen == [0]  # before the work, not after it
    assert encoder() is not first


def test_searches_hold_few_rows_runs():
    rng = np.random.default_rng(5)
    n_terms, docs, each = 4000, 4000, 300
    tf = lambda: (np.sort(rng.choice(n_terms, each, replace=False)), rng.random(each))
    rows = [(t, w / np.sqrt(w @ w)) for t, w in (tf() for _ in range(docs))]
    index = toxicity.BlockMaxIndex(np.arange(docs), rows, n_terms).ready()
    asked = [(t, w / np.sqrt(w @ w)) for t, w in (tf() for _ in range(256))]
    tracemalloc.start()
    found = index.nearest_of(asked, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    runs = sum(int((index.runs[t + 1] - index.runs[t]).sum()) for t, _ in asked)
    assert peak < 60 * runs, (peak, runs)
    for (t, w), (at, cosine) in list(zip(asked, found, strict=True))[::64]:
        own = np.zeros(n_terms)
        own[t] = w
        every = np.array([own[u] @ v for u, v in rows])
        order = np.lexsort((np.arange(docs), -np.round(every, 12)))[:3]
        assert index.ids[at].tolist() == order.tolist() and np.allclose(cosine, every[order])


def test_mixing_needs_no_python_workers(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "concat('s', id % 3) as source", "2 as n_chars")
    plain, asked = type(spark.sparkContext).parallelize, []
    type(spark.sparkContext).parallelize = lambda self, *a, **b: asked.append(a) or plain(self, *a, **b)
    try:
        assert mixing.mixed(rows).count() == 500
    finally:
        type(spark.sparkContext).parallelize = plain
    assert not asked
