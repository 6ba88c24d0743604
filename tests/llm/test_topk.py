import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import topk
from eventloom.llm.common import table


def naive(rows, k, asks):
    cells = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            cells.append((i, [math.floor(256 * float(x)) for x in v]))
    want = Counter()
    for n, (q, own) in enumerate(cells):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(own, c)), i) for m, (i, c) in enumerate(cells) if m != n)
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))
    return want


def test_query_as_brute_force(spark, tables):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, tables[0], "embeddings").collect()]
    got = topk.op5_topk(spark, tables[0]).collect()
    assert Counter(map(tuple, got)) == naive(rows, 5, lambda i: i % 50 == 0)
    assert topk.op5_topk(spark, tables[1]).count() == 0


def test_rows_with_one_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [10.0, 0.0]), (1, [2.0, 0.0]), (2, [5.0, 5.0]), (0, [1.0, 0.0]), (0, [-3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, 3).collect()
    assert Counter(map(tuple, got)) == naive(rows, 3, lambda i: i == 0)
    assert {r["score"] for r in got} >= {2560 * 256}


def test_bounds_drop_nothing():
    rng = np.random.default_rng(2)
    for scale in (3, 1000, 1 << 40):
        c = rng.integers(-scale, scale, (300, 50))
        c[100:140] = c[7]
        q, ids = c[:9], np.arange(300) * 3
        got = topk.best_of(q, ids[:9], c, ids, ids, 5)
        for j in range(9):
            exact = sorted((-sum(int(a) * int(b) for a, b in zip(q[j], c[i], strict=True)), int(ids[i])) for i in range(300) if i != j)[:5]
            assert [(-s, int(i)) for a, i, s in got if a == ids[j]] == exact
