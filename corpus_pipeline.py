"""A corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

Language identification drops documents without a language, the n-gram join
keeps one document of each group of near copies, decontamination drops
documents that hold benchmark items, secret scans put a mark in the place of
secrets, and byte-level encoding gives the ids. All but the last stage return
the columns of documents; in redacted texts n_chars is counted anew.

Nulls: a document with a null text has no language and goes in the first stage;
nulls in other columns are kept. Repeated rows are near copies of each other.
Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe, decontaminate, jaccard_join, language, secret_scan
from eventloom.llm.common import table
from eventloom.storage import run_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence."""
    model = language.fit(docs, F.lit(True))
    return language.identify(docs, model).where("NOT rejected").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group linked by a similarity of .8 of five-word shingles."""
    found = jaccard_join.jaccard_groups(docs, size=5, percent=80, keep=["doc_id"])
    return jaccard_join.first_rows(docs, found)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items are less than a twentieth of the words."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in the place of each secret."""
    found = secret_scan.find_secrets(docs).select("row.*", F.col("spans").alias("__spans"))
    text = secret_scan.redacted(F.col("text"), F.col("__spans"))
    changed = F.size("__spans") > 0
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumns(columns).drop("__spans").select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and the text that they decode to."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], digests=True)
    return found.select("row.*", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_ids),
]

#: Similarity joins over components, the battery of tests and the merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a table in the shared folder."""
    folder = f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
