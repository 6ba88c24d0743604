"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Texts become words of lower-cased ASCII letters, digits and all non-ASCII
characters, joined by one blank. The windows of an item are its runs of 13
consecutive words (all its words, if fewer). One automaton holds all windows
and reads each document once; matches are mapped back to words and to code
points of the original text.

Null or wordless texts have no words, are never hit and hit nothing. Items with
a null id are left out. Repeated items and items that share windows each count.
Repeated documents are separate rows. The automaton is bounded: windows of more
than `shard_bytes` in all are dealt over several automata that scan in separate
tasks, and their hits are united per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

WINDOW = 13
#: Bytes of window text in one automaton; its nodes take some forty times that.
SHARD_BYTES = 4 << 20

#: Bytes to what they count as: lower case, or a blank for what is between words.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_FIELDS = "text_hash bigint, n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"
_MACHINES: dict = {}


def words(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(_FOLD).split()


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (window, items): every distinct window with the ids of its items."""

    def scan(batches):
        for rows, bodies in batches:
            found = []
            for body in bodies.to_pylist():
                w = words(body)
                found.append([b" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else [])
            yield rows, {"windows": found}

    spread = map_text(benchmark.where(F.col(item).isNotNull()), scan, "windows array<binary>", text, [item])
    return (
        spread.select(F.col(f"row.{item}").cast("string").alias("item"), F.explode("windows").alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _machine(key: str, patterns):
    """The automaton of a broadcast list; a worker holds one at a time."""
    import ahocorasick

    if key not in _MACHINES:
        machine = ahocorasick.Automaton()
        for window, items in patterns.value:
            word = f" {window.decode('latin-1')} "
            machine.add_word(word, (len(word), items))
        if len(machine):
            machine.make_automaton()
        _MACHINES.clear()
        _MACHINES[key] = machine
    return _MACHINES[key]


def _places(body: bytes, hits: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text."""
    folded = np.frombuffer(body.translate(_FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], folded, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)))
    first = np.flatnonzero(np.concatenate(([True], np.diff(hits) > 1)))
    last = np.concatenate((first[1:] - 1, [len(hits) - 1]))
    return [
        {"start": int(points[starts[hits[a]]]), "end": int(points[ends[hits[b]]])}
        for a, b in zip(first, last, strict=True)
    ]


def _scanner(key: str, patterns):
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]):
        import xxhash

        machine = _machine(key, patterns)
        for rows, bodies in batches:
            out = {"text_hash": [], "n_words": [], "hit_words": [], "items": [], "spans": []}
            for body in bodies.to_pylist():
                w = words(body)
                items, hit, spans = set(), [], []
                line = f" {b' '.join(w).decode('latin-1')} "
                if w and len(machine) and (found := list(machine.iter(line))):
                    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
                    ends = np.array([e for e, _ in found])
                    # A match is a blank, words and a blank: word i stands between blanks i and i + 1.
                    marks = np.zeros(len(w) + 1, np.int64)
                    np.add.at(marks, np.searchsorted(blanks, ends + 1 - [v[0] for _, v in found]), 1)
                    np.add.at(marks, np.searchsorted(blanks, ends), -1)
                    hit = np.flatnonzero(np.cumsum(marks)[:-1] > 0).astype(np.int32)
                    items.update(*{id(v): v[1] for _, v in found}.values())
                    spans = _places(body, hit)
                out["text_hash"].append(xxhash.xxh3_64_intdigest(body or b"") - (1 << 63))
                out["n_words"].append(len(w))
                out["hit_words"].append(hit)
                out["items"].append(sorted(items))
                out["spans"].append(spans)
            yield rows, out

    return scan


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Rows (row, n_words, hit_words, items, spans, contaminated) for every document.

    row holds the columns in keep; hit_words are word numbers from 0, items ids
    as sorted strings, spans the original code points of runs of hit words (of
    each automaton, if there are several).
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark)
    size = windows.agg(F.sum(F.length("window") + 2)).head()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    found = None
    for shard in range(shards):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard)
        patterns = spark.sparkContext.broadcast([(bytes(r["window"]), tuple(r["items"])) for r in own.collect()])
        part = map_text(docs, _scanner(uuid.uuid4().hex, patterns), _FIELDS, text, keep)
        found = part if found is None else found.unionByName(part)
    if shards > 1:
        united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = (
            found.groupBy("row", "text_hash", "n_words")
            .agg(united("hit_words"), united("items"), united("spans"), F.count(F.lit(1)).alias("copies"))
            .withColumn("copies", F.explode(F.sequence(F.lit(1), (F.col("copies") / shards).cast("int"))))
        )
    hit = F.size("hit_words")
    return found.drop("text_hash", "copies").withColumn("contaminated", (hit > 0) & (20 * hit >= F.col("n_words")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: ASCII letters in either case and what they become; words are digits, letters and all that is not ASCII.
ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item_words WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (SELECT doc_id, p.k, i, item FROM places p JOIN windows q ON p.k = q.k AND p.win = q.win),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
