"""Byte-level byte-pair encoding: ranked merges folded over the bytes of distinct words.

Texts are split by a pattern; each piece is encoded by itself. The merges are a
higher-order function: a fold over a word's bytes that in each step joins the
neighbours of least rank, looked up in a literal map of the ranks (in buckets,
as a map is searched in sequence). Pieces are counted over all texts; the most
frequent ones, at most MOST_WORDS, are encoded once and known to every worker,
the others, and words of more than LONGEST bytes, are merged by the same rule as
they come. Decoding looks each id's bytes up and concatenates them.

Bytes stand as characters of ISO-8859-1 inside the columns. Null texts are
empty; empty texts have no ids. Nulls and unknown numbers among ids to decode
are left out. Repeated rows are separate rows. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_threshold, map_text, small, table, written

#: Distinct pieces that every worker knows, at most.
MOST_WORDS = 400_000
#: Bytes of a word that the fold takes at most, and rare words that a worker keeps for a while.
LONGEST, RECENT_WORDS = 128, 50_000
#: Pieces that a worker counts before it hands their counts on.
COUNTED_WORDS = 300_000
BUCKETS = 1 << 14
NEVER = (1 << 31) - 1


@functools.lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a piece in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(8)
def _class(name: str) -> str:
    """The characters of a class as ranges for a set, without those beyond U+FFFF."""
    import regex

    own = regex.compile(name).match
    held = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and own(chr(c))]
    starts = [c for i, c in enumerate(held) if not i or held[i - 1] != c - 1]
    ends = [c for i, c in enumerate(held) if i + 1 == len(held) or held[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


@functools.lru_cache(4)
def splitter(pattern: str) -> Callable[[bytes], list[str]]:
    """Finds a pattern's matches in a UTF-8 text.

    The standard library is twice as fast as the module that knows Unicode's
    classes, so they are spelled out for it; texts with characters beyond U+FFFF
    and patterns with other classes go to the module.
    """
    import regex

    general, astral = regex.compile(pattern).findall, re.compile(rb"[\xf0-\xff]").search
    plain, inside, at = "", False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        name = pattern[at : at + 5] if two in ("\\p", "\\P") else two if two[0] == "\\" else pattern[at]
        at += len(name)
        inside = (inside or name == "[") and name != "]"
        if name in ("\\p{L}", "\\p{N}", "\\s"):
            name = _class(name) if inside else f"[{_class(name)}]"
        elif name == "\\S" and not inside:
            name = f"[^{_class(chr(92) + 's')}]"
        elif name[0] == "\\":
            return lambda body: general(body.decode())
        plain += name
    fast = re.compile(plain).findall
    return lambda body: (general if astral(body) else fast)(body.decode())


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: array of small maps by crc32 of the piece."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return _literal(buckets, "array<map<string,int>>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rank(ranks: Column, piece: Column) -> Column:
    bucket = F.get(ranks, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int"))
    return F.coalesce(F.try_element_at(bucket, piece), F.lit(NEVER))


def _merged(ranks: Column, state: Column) -> Column:
    """One step: the first neighbours of least rank become one piece."""
    parts, pairs = state["parts"], state["pairs"]

    def at(i: Column) -> Column:
        n = F.size(parts)
        joined = F.concat(F.get(parts, i - 1), F.get(parts, i))

        def put(new: Column) -> Column:
            before = F.when(i > 1, F.concat(F.slice(pairs, F.lit(1), i - 2), F.array(_rank(ranks, F.concat(F.get(parts, i - 2), new)))))
            after = F.when(i + 1 < n, F.concat(F.array(_rank(ranks, F.concat(new, F.get(parts, i + 1)))), F.slice(pairs, i + 2, n)))
            none = F.array().cast("array<int>")
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), i - 1), F.array(new), F.slice(parts, i + 2, n)).alias("parts"),
                F.concat(F.coalesce(before, none), F.coalesce(after, none)).alias("pairs"),
            )

        return let(joined, put)

    least = F.coalesce(F.array_min(pairs), F.lit(NEVER))
    return let(least, lambda m: F.when(m == NEVER, state).otherwise(let(F.array_position(pairs, m).cast("int"), at)))


def encode_piece(ranks: Column, piece: Column) -> Column:
    """Ids of a piece (a string): its own, if it has one, else those that the merges leave."""
    latin = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")

    def ids(word: Column) -> Column:
        letters = F.split(word, "")
        pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: _rank(ranks, F.substring(word, i, F.lit(2))))
        start = F.struct(letters.alias("parts"), pairs.alias("pairs"))
        steps = F.sequence(F.lit(1), F.length(word) - 1)
        fold = F.aggregate(steps, start, lambda s, _: _merged(ranks, s), lambda s: F.transform(s["parts"], lambda p: _rank(ranks, p)))
        return let(_rank(ranks, word), lambda own: F.when(own != NEVER, F.array(own)).when(F.length(word) > 1, fold).otherwise(F.array().cast("array<int>")))

    return let(latin, ids)


def count_pieces(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(piece, n): every distinct piece of the texts and how often it stands in them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(pattern), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"piece": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return batch

        for batch in small(batches):
            for body in batch.column(0).to_pylist():
                seen.update(split(body or b""))
                if len(seen) >= COUNTED_WORDS:
                    yield out()
        yield out()

    return docs.select(docs[text].cast("binary")).mapInArrow(scan, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def _packed(rows: pa.Table) -> bytes:
    """The columns as one piece of memory: to the driver they are no words, only bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict[str, bytes]:
    """Bytes of the ids by piece."""
    out: dict[str, bytes] = {}
    for batch in pa.ipc.open_stream(packed):
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4")
        for i, piece in enumerate(batch.column("piece").to_pylist()):
            out[piece] = flat[at[i] : at[i + 1]].tobytes()
    return out


def merged(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """What encode_piece computes, for one word: the first neighbours of least rank are joined again and again."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONGEST:
        return _merged_long(ranks, word)
    parts = [word[i : i + 1] for i in range(len(word))]
    rank = ranks.get
    pairs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merged_long(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same with the neighbours in a heap, for words of any length."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        # Neighbours that have changed since they were offered are passed over.
        if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Known(dict):
    """Bytes of a piece's ids; those of rare pieces are merged as they come and kept for a while."""

    def __init__(self, ids: dict[str, bytes], ranks: dict[bytes, int]) -> None:
        super().__init__(ids)
        self.ranks, self.recent = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.recent.get(piece)
        if found is None:
            if len(self.recent) >= RECENT_WORDS:
                self.recent.clear()
            ids = merged(self.ranks, piece.encode())
            found = self.recent[piece] = struct.pack(f"<{len(ids)}i", *ids)
        return found


def encode_texts(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    keep: list[str] | None = None,
    most_words: int = MOST_WORDS,
    digests: bool = False,
) -> DataFrame:
    """Rows (row, ids) with the ids of every text.

    With digests also n_tokens, ids_sha256 (of the decimal ids, joined by a
    blank) and decoded_sha256 (of the bytes that the ids decode to).
    """
    spark = docs.sparkSession
    literal = rank_map(ranks)
    counts = written(count_pieces(docs, pattern, text))
    frequent = counts.where(F.col("n") >= hot_threshold(counts, "n", most_words)).where(F.octet_length("piece") <= LONGEST)
    own = frequent.repartition(spark.sparkContext.defaultParallelism * 4).select(
        "piece", let(literal, lambda r: encode_piece(r, F.col("piece"))).alias("ids")
    )
    words, held = (spark.sparkContext.broadcast(x) for x in (_packed(own.toArrow()), ranks))

    def scan(batches):
        split, known = splitter(pattern), _Known(_unpacked(words.value), held.value)
        pieces = {rank: piece for piece, rank in held.value.items()}
        for rows, column in batches:
            found = [b"".join(map(known.__getitem__, split(body or b""))) for body in column.to_pylist()]
            at = np.cumsum([0, *(len(x) // 4 for x in found)])
            numbers = pa.array(np.frombuffer(b"".join(found), np.int32))
            out = {"ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), numbers)}
            if digests:
                out |= {"n_tokens": np.diff(at), "ids_sha256": [], "decoded_sha256": []}
                for x in found:
                    ids = np.frombuffer(x, np.int32).tolist()
                    out["ids_sha256"].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded(pieces, ids)).hexdigest())
            yield rows, out

    more = ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else ""
    return map_text(docs, scan, "ids array<int>" + more, text, keep)


def decoded(pieces: dict[int, bytes], ids: list[int]) -> bytes:
    """The binary pieces of the ids, concatenated."""
    return b"".join([pieces[i] for i in ids])


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids stand for, as a column function."""
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece.decode("latin-1")
    pieces = _literal(by_id, "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ids of every document and the texts that they decode to."""
    import public_tokenizers

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    found = encode_texts(docs, ranks, pattern or public_tokenizers.PATTERN, keep=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
