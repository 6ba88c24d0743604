import math
import zlib
from collections import Counter

import numpy as np

from eventloom.llm import lm_score


def test_token_model_as_brute_force(spark, tables, docs):
    got = lm_score.score_texts  # the query with few known tokens, so that most go through the join
    from eventloom.llm.common import table
    from eventloom.llm.language import remainder
    from pyspark.sql import functions as F

    out = got(table(spark, tables[0], "documents"), remainder(F.col("doc_id"), 10) != 0, keep=["doc_id"], most_tokens=5).collect()
    assert len(out) == len(docs)
    counts, n_docs = Counter(), 0
    for i, text in docs:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update((text or "").encode().lower().split())
            n_docs += 1
    counts[None] = n_docs
    total, kinds = sum(counts.values()), len(counts)

    def base(text):
        own = [*(text or "").encode().lower().split(), None]
        score = sum(math.log10((counts.get(t, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        return len(own), sum(t in counts for t in own), round(score, 6)

    want = Counter((i, *base(t)) for i, t in docs)
    assert Counter((r["row"]["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {total}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_chances_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    nodes = len(lm_score._FIRST) and lm_score._SEGMENTS * (16 << lm_score.SEGMENT_BITS)
    zeros, ones = (rng.integers(0, 60, nodes, dtype=np.uint8) for _ in range(2))
    weights = rng.normal(0.2, 0.1, (lm_score.GATES, lm_score.ORDERS + 1))
    refine = rng.uniform(0.01, 0.99, (lm_score.GATES, lm_score.MAP_BINS))
    model = lm_score.Model(zeros, ones, weights, refine)
    for context in (0, 0x6162636465, 0xFFFFFFFFFF):
        keys = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((2 ** lm_score.log2_chances(model, keys)).sum() - 1) < 1e-9


def test_counts_do_not_saturate():
    n = np.array([0, 1, 2, 3, 100, 2_490_000, 30_000_000, 9_000_000_000, 1 << 62])
    assert np.allclose(lm_score._COUNT[lm_score._log_count(n)], n, rtol=1e-3)


def test_grams_do_not_cross_texts():
    keys, starts = lm_score.grams_of([b"abc", b"", b"z"])
    assert starts.tolist() == [0, 4, 5] and len(keys) == 7
    assert [hex(k) for k in keys.tolist()] == [
        "0xffffffffff61", "0xffffffff6162", "0xffffff616263", "0xffff616263ff", "0xffffffffffff", "0xffffffffff7a", "0xffffffff7aff"]


def test_learning_helps(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * (1 + i % 3)) for i in range(30)]
    docs = spark.createDataFrame([*rows, (99, "qzx vkw pjy qqq zzz xxv kkw")], "doc_id int, text string")
    got = {r["row"]["doc_id"]: r["bits_per_byte"] for r in lm_score.score_texts(docs, docs["doc_id"] < 29, keep=["doc_id"]).collect()}
    assert got[29] < 1 and got[99] > 4


def test_counts_of_all_orders_as_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, rng.integers(0, 400)).astype(np.uint8)).decode() for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    rows = lm_score.pack_grams(docs, docs["doc_id"] % 3 != 0).collect()
    packs = [(np.frombuffer(r["grams"], np.int64).astype(np.uint64), np.frombuffer(r["n"], np.int64)) for r in rows]
    low = lm_score.low_orders(spark.createDataFrame(rows, "grams binary, n binary, m binary"))
    every = Counter(k for i, t in enumerate(texts) if i % 3 for k in lm_score.grams_of([t.encode()])[0].tolist())
    for keys, n in packs:
        sums = [*low, *(lm_score._sums(keys, n, k) for k in range(3, lm_score.ORDERS))]
        for order, own in enumerate(sums):
            mask = (1 << 8 * (order + 1)) - 1
            known = Counter()
            for k, times in every.items():
                for at in range(8):
                    known[(k & mask) >> (7 - at), at] += times
            some = keys[:: max(1, len(keys) // 40)] & np.uint64(mask)
            for at, (n0, n1) in enumerate(lm_score._walk(some, *own)):
                node = [int(k) >> (8 - at) << 1 for k in some]
                assert n0.tolist() == [known[v, at] for v in node] and n1.tolist() == [known[v + 1, at] for v in node]


def test_known_and_joined_grams_score_alike(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(1)
    got = [
        {r["row"]["doc_id"]: r["score"] for r in lm_score.score_texts(docs, docs["doc_id"] < 15, keep=["doc_id"], most_grams=n).collect()}
        for n in (5, 10_000)
    ]
    assert all(math.isclose(got[0][i], got[1][i], rel_tol=1e-9) for i in range(20))


def test_texts_looked_up_together_as_brute_force():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint8)) for _ in range(50)]
    every = [Counter(lm_score.grams_of([t])[0].tolist()) for t in texts]
    known = {g: float(rng.normal()) for own in every[::3] for g in own}
    grams = np.array([*sorted(known), 1 << 62])
    bits = np.array([*(known[g] for g in sorted(known)), 0.0])
    total, sizes, rare, n = lm_score._looked_up(texts, grams, bits)
    ends = np.cumsum(sizes)
    for i, own in enumerate(every):
        assert math.isclose(total[i], sum(known[g] * k for g, k in own.items() if g in known), abs_tol=1e-9)
        part = slice(ends[i] - sizes[i], ends[i])
        assert list(zip(rare[part].tolist(), n[part].tolist(), strict=True)) == sorted((g, k) for g, k in own.items() if g not in known)


def test_without_rows(spark, tables):
    assert lm_score.op2_lm_score(spark, tables[1]).count() == 0
