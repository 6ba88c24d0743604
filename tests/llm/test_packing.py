import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(counts, capacity):
    """sequence -> [(offset, length)] of a plan, entry by entry."""
    entries, out = packing.plan(counts, capacity), {}
    for n, (length, first, per, sequence, offset) in enumerate(entries):
        last = entries[n + 1][1] if n + 1 < len(entries) and entries[n + 1][0] == length else counts[length]
        for i in range(last - first):
            out.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    return {s: sorted(rows) for s, rows in out.items()}


def one_by_one(counts, capacity):
    """Number of sequences when the same rule takes piece after piece."""
    left, gaps = Counter(counts), []
    for a in sorted((n for n in counts if 3 * n > capacity), reverse=True):
        while left[a]:
            left[a] -= 1
            b = max((n for n in left if left[n] and 3 * n > capacity and n <= capacity - a), default=0)
            left[b] -= bool(b)
            gaps.append(capacity - a - b)
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        for _ in range(left[n]):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=14), st.integers(40, 60))
def test_plan_as_piece_after_piece(counts, capacity):
    found = laid_out(counts, capacity)
    assert Counter(n for rows in found.values() for _, n in rows) == Counter(counts)
    for rows in found.values():
        end = 0
        for offset, length in rows:
            assert offset == end
            end += length
        assert end <= capacity and sum(3 * n > capacity for _, n in rows) <= 2
    assert len(found) == one_by_one(counts, capacity)


def test_plan_does_not_grow():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 50) for n in range(1, 4097)}
    many = {n: c * 10**9 + rng.randint(0, 9) for n, c in counts.items()}
    few, lots = packing.plan(counts), packing.plan(many)
    assert len(lots) < 4 * len(few) and len(lots) < 100_000
    total = sum(n * c for n, c in many.items())
    assert (lots[:, 3].max() + 1) * 4096 < 1.01 * total


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            out.append((doc, n, at, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def check(got, want):
    assert Counter(tuple(r)[:5] for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= 4096 for e in ends.values())
    assert len(ends) <= 1.05 * -(-sum(ends.values()) // 4096) + 1


def test_query_as_brute_force(spark, tables, docs, monkeypatch):
    got = packing.op12_packing(spark, tables[0])
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(got.collect(), expected(docs))
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    check(packing.op12_packing(spark, tables[0]).collect(), expected(docs))
    assert packing.op12_packing(spark, tables[1]).count() == 0


@pytest.mark.parametrize("text", ["don't WE'LL\x1cno\x85x y  ", "é ́a ΣΑΣ ΣΑΣ", "<|endoftext|>a b<|startoftext|> <|end oftext|>", "　中文 12345", "ab" * 9000, "a\ue000 \ue000 B\ue000c !\ue000 d", "AbC DeF'S H̱ x", "Don't. é. a.. É, x!? 1. É… …. q;"])
def test_word_by_word_as_whole(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(PATH)([text.encode(), None])[0], "<u4").tolist() == whole


def test_long_texts_in_portions(monkeypatch):
    monkeypatch.setattr(packing, "PORTION", 50)
    texts = [b"a b " * 400, None, b"x" * 300, b"", b"one two"]
    portions = list(packing._portions(texts))
    assert len(portions) > 20
    for n, text in enumerate(texts):
        assert b" ".join(t for p in portions for m, t in p if m == n).split() == (text or b"").split()


def test_whole_sequences(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    from eventloom.llm.common import written

    pieces = written(packing.pieces_of(df, PATH, capacity=64, keep=["doc_id", "ids"]).withColumn("key", F.sha2("ids", 256)))
    got = packing.sequences(packing.pack(pieces, ["row.doc_id", "piece", "key"], 64)).collect()
    tokenizer, whole = Tokenizer.from_file(PATH), Counter()
    for _, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        whole.update(ids)
    assert all(r["length"] * 4 == len(r["ids"]) <= 256 for r in got)
    assert Counter(i for r in got for i in np.frombuffer(r["ids"], "<u4").tolist()) == whole
