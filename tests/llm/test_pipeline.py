"""The pipeline against brute force of each stage on what the one before kept."""

import public_tokenizers
import pytest
import tiktoken

from .test_decontaminate import naive as contaminated
from .test_jaccard_join import naive as groups
from .test_secret_scan import naive as secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_stage(spark, tables, tmp_path):
    from eventloom.llm import byte_bpe
    from eventloom.llm.common import table

    kept = [table(spark, tables[0], "documents")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], tables[0]).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "byte_bpe":
            assert kept[-1].columns == kept[0].columns
    rows = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept[:-1]]
    from pyspark.sql import functions as F

    from eventloom.llm import language

    found = language.identify(kept[0], language.fit(kept[0], F.lit(True)), keep=["doc_id"]).collect()
    assert sorted(str(i) for i, _ in rows[1]) == sorted(str(r["row"]["doc_id"]) for r in found if not r["rejected"])
    lost = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert {200, 201, 202} <= lost and len(lost) <= 10
    least = {c for *_, c in groups(rows[1], 5, 80)}
    assert sorted(str(i) for i, _ in rows[2]) == sorted(map(str, least))
    items = [tuple(r) for r in table(spark, tables[0], "benchmark").select("item_id", "text").collect()]
    assert {i for i, _ in rows[3]} == {i for i, t in rows[2] if not contaminated(t, items)[-1]}
    after = dict(rows[4])
    assert after[208] == '[secret]" [secret] ſecret=abcdefghijklmnop'
    assert all(after[i] == t for i, t in rows[3] if not secrets(t))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert {r["doc_id"]: r["ids"] for r in kept[-1].collect()} == {i: enc.encode_ordinary(t) for i, t in after.items()}


def test_without_rows(spark, tables):
    assert corpus_pipeline.run(spark, tables[1]).count() == 0
