import pyarrow as pa

import pytest

from eventloom.llm.common import SMALL_BYTES, SMALL_ROWS, map_text, small


def test_slices_are_bounded_in_rows_and_bytes():
    texts = [b"a" * n for n in (*[10] * 2500, *[50_000] * 100, 3 * SMALL_BYTES, 5, 3 * SMALL_BYTES, *[7_000] * 900)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[:1]}), pa.RecordBatch.from_pydict({"text": texts[1:]})]
    slices = list(small(iter(batches)))
    assert [v for s in slices for v in s.column(0).to_pylist()] == texts
    assert all(s.num_rows <= SMALL_ROWS and (s.num_rows == 1 or s.nbytes <= SMALL_BYTES) for s in slices)
    assert len(slices) < 100 and not list(small(iter([batches[0].slice(0, 0)])))


@pytest.mark.parametrize(("keep", "columns"), [(None, 1), (["text"], 1), (["doc_id"], 2)])
def test_a_kept_text_travels_once(spark, keep, columns):
    texts = [(i, None if i % 5 == 0 else "é" * (i % 400)) for i in range(2_500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)

    def scan(batches):
        for rows, column in batches:
            yield rows, {"body": column}

    found = map_text(docs, scan, "body binary", keep=keep)
    assert found._jdf.queryExecution().analyzed().children().head().output().size() == columns
    rows = found.collect()
    assert [r["body"] and bytes(r["body"]).decode() for r in rows] == [t for _, t in texts]
    assert [tuple(r["row"]) for r in rows] == [tuple(v for v, n in zip(t, ("doc_id", "text"), strict=True) if n in (keep or docs.columns)) for t in texts]
