import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import repeats


def naive(texts, size):
    """(bytes, removed, spans, digest of the rest) of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = [False] * (len(b) + 1)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 2_000])
def test_as_brute_force(spark, tables, docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = Counter(map(tuple, repeats.op7_repeats(spark, tables[0]).collect()))
    want = Counter((i, *own) for (i, _), own in zip(docs, naive([t for _, t in docs], repeats.LENGTH), strict=True))
    assert got == want and any(r[2] for r in want)


def test_random_passages(spark, tmp_path):
    rng = random.Random(9)
    letters = "abcd é\n"
    passages = ["".join(rng.choices(letters, k=n)) for n in (380, 400, 420, 700, 1500)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            parts += ["".join(rng.choices(letters, k=rng.randrange(0, 200))), p[a : len(p) - rng.randrange(0, 30)]]
        rows.append((i, "".join(parts)))
    rows += [(90, "a" * 399), (91, "a" * 399), (92, "b" * 400), (93, "c" * 401), (94, None), (95, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in repeats.op7_repeats(spark, str(tmp_path)).collect()}
    assert got == {i: own for (i, _), own in zip(rows, naive([t for _, t in rows], repeats.LENGTH), strict=True)}


def test_reaches_as_all_pairs():
    rng = random.Random(10)
    for _ in range(40):
        n = rng.randrange(2, 12)
        afters = [bytes(rng.choices(b"ab", k=rng.randrange(1, 9))) for _ in range(n)]
        befores = [bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(n)]
        back, ahead = [0] * n, [0] * n
        for i in range(n):
            for j in range(n):
                left, right = repeats.common_prefix(befores[i], befores[j]), repeats.common_prefix(afters[i], afters[j])
                if i != j and left + right >= 5:
                    back[i], ahead[i] = max(back[i], left), max(ahead[i], right)
        got = repeats.reaches(afters, befores, 5)
        for i in range(n):
            assert (got[0][i], got[1][i]) == (back[i], ahead[i])


def test_without_rows(spark, tables):
    assert repeats.op7_repeats(spark, tables[1]).count() == 0


def test_marks_as_a_set(spark):
    grams = [-(1 << 62), -5, 0, 5, 1 << 40, 1 << 62]
    others = [(1 << 62) - 1, (1 << 61), -(1 << 61), 3 << 60]
    bits = repeats._mark(spark.createDataFrame([(g,) for g in grams * 3], "gram bigint").repartition(3), "gram")
    as_keys = lambda own: np.array(own, np.int64).astype(np.uint64)
    assert len(bits) == 1 << repeats.MARK_BITS - 3
    assert repeats._marked(bits, as_keys(grams)).all() and not repeats._marked(bits, as_keys(others)).any()
    keys = [repeats.text_key(t) for t in (b"a", b"b", None)]
    bits = repeats._mark(spark.createDataFrame([(bytearray(k),) for k in keys], "text binary"), "text")
    assert repeats._marked(bits, repeats._numbers(keys)).all() and not repeats._marked(bits, repeats._numbers([repeats.text_key(b"c")])).any()
