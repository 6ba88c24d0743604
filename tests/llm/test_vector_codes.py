import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import vector_codes
from eventloom.llm.common import table


def brute(rows, entries=256, parts=4, rounds=4):
    """Expected rows of the query, point by point with whole numbers."""
    kept = [(i, [max(min(math.floor(1024 * float(x)), 1 << 50), -(1 << 50)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = max(-(-max((len(v) for _, v, _ in kept), default=0) // parts), 1)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [tuple((v + [0] * (step * parts))[p * step : (p + 1) * step]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    points = [cut(v) for _, v, _ in kept]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in points:
                own.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for n, group in own.items():
                books[p][n] = tuple(sum(c) // len(group) for c in zip(*group))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for (i, _, label), x in zip(kept, points):
        found = [nearest(x[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{n:02x}" for _, n in found), error, label))
    most = (1 << 63) - 1
    return Counter((i, code, min(e, most), min(by_label[label], most), digest) for i, code, e, label in out)


def run(spark, folder):
    got = vector_codes.op13_vector_codes(spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(tuple(r) for r in got.collect())


def rows_of(spark, folder):
    return [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding", "label").collect()]


def test_query_as_brute_force(spark, tables, monkeypatch):
    want = brute(rows_of(spark, tables[0]))
    assert run(spark, tables[0]) == want
    monkeypatch.setattr(vector_codes, "TREE_ROWS", 7)
    assert run(spark, tables[0]) == want
    assert vector_codes.op13_vector_codes(spark, tables[1]).count() == 0


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e9, 1e30])
def test_many_vectors(spark, tmp_path, scale):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12))
    rows = [(int(i) if i % 50 else None, (centres[i % 30] + 0.2 * rng.normal(size=12)) * scale, int(i % 3) or None) for i in range(420)]
    rows = [(i, [float(x) for x in v], n) for i, v, n in rows]
    rows += [(5, rows[0][1], 2)] * 60 + [(9_000, [1.0], 7), (9_001, [], 7), (9_002, None, 7), (9_003, [None], 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("code", F.lit(1))
    df.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert run(spark, str(tmp_path)) == brute(rows)


def test_trees_part_the_points():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-900, 900, (700, 5)), np.zeros((90, 5), np.int64)])
    order, sorted_, root = vector_codes.tree_of(points)
    assert sorted(order.tolist()) == list(range(790)) and (points[order] == sorted_).all()
    book = vector_codes.Codebook(points[[3, 3, 700, *range(100, 160)]])
    seen, whole = np.full(790, -1), 0
    for ball, entry in vector_codes.owners(sorted_, root, book):
        assert (seen[ball.low : ball.high] == -1).all() and (ball.total == sorted_[ball.low : ball.high].sum(axis=0)).all()
        seen[ball.low : ball.high] = entry
        whole += isinstance(entry, int)
    distances = ((sorted_[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (seen == distances.argmin(axis=1)).all() and whole > 0


def test_expected_sql(spark, tables):
    path = "/root/testdata/sf0.01"
    duckdb_rows = duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'") or duckdb.sql(vector_codes.ORACLE).fetchall()
    assert Counter(duckdb_rows) == run(spark, path)
