import hashlib
import re

import pytest

from eventloom.llm import decontaminate
from eventloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def naive(text, items):
    own, hit, found = split(text), set(), set()
    for item, body in items:
        if item is None:
            continue
        w = split(body)
        for i in range(max(1, len(w) - 12) if w else 0):
            window = w[i : i + 13]
            for j in range(len(own) - len(window) + 1):
                if own[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


def test_as_brute_force(spark, tables, docs):
    items = [tuple(r) for r in table(spark, tables[0], "benchmark").select("item_id", "text").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in decontaminate.op1_decontaminate(spark, tables[0]).collect())
    assert got == sorted((str(i), *naive(t, items)) for i, t in docs)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_spans_and_shards(spark, size):
    item = spark.createDataFrame([(1, "one two three"), (2, "Größe nine"), (3, "two")], "item_id int, text string")
    rows = [(1, "x, One--TWO three! Größe"), (1, "x, One--TWO three! Größe"), (2, "größe NINE größe nine"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    small = 14 if size == 200 else size
    got = decontaminate.contamination(docs, item, keep=["doc_id"], shard_bytes=small).collect()
    assert sorted(r["row"]["doc_id"] for r in got) == [1, 1, 2, 3]
    one = next(r for r in got if r["row"]["doc_id"] == 1)
    assert one["items"] == ["1", "3"] and one["hit_words"] == [1, 2, 3] and one["n_words"] == 5
    assert ("One--TWO three") in [rows[0][1][s["start"] : s["end"]] for s in one["spans"]]


def test_without_rows(spark, tables):
    assert decontaminate.op1_decontaminate(spark, tables[1]).count() == 0
    docs = table(spark, tables[0], "documents")
    none = decontaminate.contamination(docs, table(spark, tables[1], "benchmark"))
    assert none.where("contaminated OR size(items) > 0").count() == 0 and none.count() == docs.count()
