"""Best-fit packing: pieces of tokenised documents fill sequences of a fixed capacity.

Where a piece goes depends on its length only, and there are at most as many
lengths as tokens in a sequence. So the plan is made from the counts of the
lengths, and its size does not grow with the input: pieces above a third of the
capacity, of which two at most fit, are matched greedily, the largest with the
largest that fits beside it; smaller ones, longest first, go to the least gap
that holds them and open new sequences only if there is none. Many equal
sequences are one entry of the plan. Pieces are numbered among those of their
length in buckets, and the number finds its entry by binary search.

Null texts are empty and have the end id only; very long texts are cut into
pieces, and no text is looked at in part. Repeated rows are documents of their
own, equal ones interchangeable. Extra columns travel in one struct, so their
names can't clash. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_text, table, written

CAPACITY = 4096
#: Words of at most WORD_BYTES are encoded once while they are in a cache of WORDS of them.
WORDS, WORD_BYTES = 700_000, 64
#: Bytes of text that are split into words at a time.
PORTION = 1 << 20
#: Pieces that are numbered in one group, on average.
BUCKET_ROWS = 200_000
PIECE = "piece int, start bigint, length bigint, ids binary"


#: A word that stands between words that are encoded together.
_BETWEEN = "\ue000"
_WHITE = re.compile(rb"[ \t-\r]")
#: Latin letters, precomposed and with one lower-case letter each, and a mark behind them.
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ſ]+)([.,;:!?]?)")


class Encoder:
    """Ids of whole texts, word by word, as little-endian bytes.

    The tokenizer never joins over white space, so a text's ids are those of
    its parts between ASCII white space. Parts are encoded many at a time, and
    those of at most WORD_BYTES bytes once, while the cache has them. Latin
    letters and the mark behind them are ids of their own; lower-case letters
    need no normalising, and their last id says that it ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode, self.bare = whole.encode_batch_fast, bare.encode_batch_fast
        self.known: dict[bytes, bytes] = {}
        self.between = self._ids(_BETWEEN)
        self.ends = np.zeros(whole.get_vocab_size(), bool)
        self.ends[[i for t, i in whole.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encode([text], add_special_tokens=False)[0].ids, "<u4")

    def _of_letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of lower-case letters."""
        for found in self.bare([" ".join(words[at : at + 500]) for at in range(0, len(words), 500)], add_special_tokens=False):
            ids = np.asarray(found.ids, "<u4")
            yield from _cut(ids.tobytes(), np.flatnonzero(self.ends[ids]) + 1, 0)

    def _of_any(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that don't hold the word between."""
        n = len(self.between)
        texts = [f" {_BETWEEN} ".join([*words[at : at + 500], ""]) for at in range(0, len(words), 500)]
        for found in self.encode(texts, add_special_tokens=False):
            ids = np.asarray(found.ids, "<u4")
            at = np.all([ids[i : len(ids) - n + 1 + i] == x for i, x in enumerate(self.between)], axis=0)
            yield from _cut(ids.tobytes(), np.flatnonzero(at), n)

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Put words into the cache; returns those that are too long for it."""
        own, known = _BETWEEN.encode(), self.known
        single = [w for w in words if len(w) > WORD_BYTES or own in w]
        plain, other = {}, []
        for word in words.difference(single):
            text = word.decode()
            if found := _LETTERS.fullmatch(text):
                plain[word] = found[1].lower().encode(), found[2].encode()
            else:
                other.append((word, text))
        letters = list({w for w, _ in plain.values()}.difference(known))
        known.update(zip(letters, self._of_letters([w.decode() for w in letters]), strict=True))
        known.update(zip([w for w, _ in other], self._of_any([t for _, t in other]), strict=True))
        for mark in {m for _, m in plain.values()}.difference(known):
            known[mark] = self._ids(mark.decode()).tobytes()
        known.update([(w, known[a] + known[b]) for w, (a, b) in plain.items()])
        alone = self.encode([w.decode() for w in single], add_special_tokens=False)
        return {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(single, alone, strict=True)}

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        words = [_words(t or b"") for t in texts]
        every = set().union(*words)
        if len(self.known) > WORDS:
            # Words that are in use now stay.
            self.known = {w: self.known[w] for w in every.intersection(self.known)}
        long = self._learn(every.difference(self.known))
        get = ChainMap(self.known, long).__getitem__ if long else self.known.__getitem__
        return [b"".join(map(get, row)) for row in words]


def _cut(raw: bytes, ends: np.ndarray, skipped: int) -> Iterator[bytes]:
    """Parts of ids up to each end, some ids after which belong to no part."""
    start = 0
    for end in ends.tolist():
        yield raw[4 * start : 4 * end]
        start = end + skipped


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder; tasks that follow find its cache as it was."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _words(body: bytes) -> list[bytes]:
    """The parts between white space; letters of ASCII texts in lower case, as the tokenizer makes them anyway."""
    return (body.lower() if body.isascii() else body).split()


def _portions(bodies: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, bytes of it) in portions of about PORTION bytes; long texts are cut at white space."""
    out, size = [], 0
    for n, body in enumerate(bodies):
        body, at = body or b"", 0
        while True:
            cut = _WHITE.search(body, at + PORTION) if len(body) - at > PORTION else None
            end = cut.start() if cut else len(body)
            out.append((n, body[at:end]))
            size += end - at
            if size >= PORTION:
                yield out
                out, size = [], 0
            if not cut:
                break
            at = end
    if out:
        yield out


def pieces_of(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row, piece, start, length, ids: each text's ids and the end id, cut only where longer than capacity.

    ids are little-endian unsigned 32-bit numbers, row the columns in keep.
    """

    def scan(batches: Iterator) -> Iterator:
        encode, last = encoder_of(path), np.uint32(end).tobytes()
        width = 4 * capacity
        for rows, body in batches:
            whole: dict[int, list[bytes]] = {n: [] for n in range(len(rows))}
            for portion in _portions(body.to_pylist()):
                for (n, _), ids in zip(portion, encode([t for _, t in portion]), strict=True):
                    whole[n].append(ids)
            own, starts, parts = [], [], []
            for n, ids in whole.items():
                ids = b"".join([*ids, last])
                for at in range(0, len(ids), width):
                    own.append(n)
                    starts.append(at // 4)
                    parts.append(ids[at : at + width])
            starts = np.array(starts, np.int64)
            yield rows.take(pa.array(own, pa.int64())), {
                "piece": pa.array(starts // capacity, pa.int32()), "start": pa.array(starts, pa.int64()),
                "length": pa.array([len(p) // 4 for p in parts], pa.int64()), "ids": pa.array(parts, pa.binary()),
            }

    return map_text(docs, scan, PIECE, text, keep)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first, per, sequence, offset), sorted.

    Piece number i of a length, from first on, is at place (i - first) % per of
    sequence + (i - first) // per, each place being offset + length * place.
    A run of sequences takes each length once at most, and the lengths that it
    takes add up to the capacity; runs split only where a length ends. So the
    plan has a bound that depends on the capacity alone.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number of sequences)
    open_gaps: list[int] = []  # sorted
    sequences = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
            gaps.setdefault(gap, []).append((first, many))

    def put(length: int, many: int, per: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], per, sequence, offset))
        used[length] += many
        left[length] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            many, b = left[a], 0
            put(a, many, 1, sequences, 0)
        else:
            b = large[at]
            many = left[a] // 2 if a == b else min(left[a], left[b])
            if many == 0:  # the last one of its length has no partner of the same length
                at -= 1
                b, many = (large[at], 1) if at >= 0 else (0, 1)
            put(a, many, 1, sequences, 0)
            if b:
                put(b, many, 1, sequences, a)
        leave(capacity - a - b, sequences, many)
        sequences += many
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            else:
                gap, first = capacity, sequences
                many = -(-left[length] // (capacity // length))
                sequences += many
            # Best fit goes on with the same sequence while the piece fits: its gap became smaller.
            per = gap // length
            whole, rest = divmod(min(left[length], many * per), per)
            if whole + bool(rest) < many:
                leave(gap, first + whole + bool(rest), many - whole - bool(rest))
            put(length, whole * per + rest, per, first, capacity - gap)
            leave(gap - per * length, first, whole)
            if rest:
                leave(gap - rest * length, first + whole, 1)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame, length: Column, order: list[Column], rows: int) -> DataFrame:
    """pieces with __number, from 0 on among the pieces of a length.

    A length may be that of most pieces, so its pieces are numbered in buckets
    by a hash, and the buckets' sizes are added up.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = pieces.withColumns({"__length": length, "__bucket": F.pmod(F.xxhash64(*order), F.lit(buckets))})
    sizes = dealt.groupBy("__length", "__bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__length", "__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__length", "__bucket").orderBy(*order))
    return (
        dealt.withColumn("__inside", inside).join(bases, ["__length", "__bucket"])
        .withColumn("__number", F.col("__base") + F.col("__inside") - 1).drop("__length", "__bucket", "__base", "__inside")
    )


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces, a written table with a column length, with sequence_id and offset.

    order are columns that can be sorted by and tell pieces apart; pieces equal
    in all of them are interchangeable.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("pieces must have 1 to capacity tokens")
    entries = plan(counts, capacity)
    total = sum(counts.values())
    spark = pieces.sparkSession
    # Length and first number as one key: both are whole numbers of a bounded size.
    stride = max(counts.values(), default=0) + 1
    if (capacity + 1) * stride >= 1 << 62:
        raise ValueError("too many pieces")
    held = spark.sparkContext.broadcast((entries[:, 0] * stride + entries[:, 1], entries))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys, rows = held.value
        length, number = length.to_numpy(), number.to_numpy()
        at = np.searchsorted(keys, length * stride + number, "right") - 1
        _, first, per, sequence, offset = rows[at].T
        step = number - first
        return pd.DataFrame({"sequence_id": sequence + step // per, "offset": offset + step % per * length})

    found = numbered(pieces, F.col("length"), [F.col(c) for c in order], total)
    return found.withColumn("__at", place("length", "__number")).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of whole sequences from packed pieces with ids; a sequence has at most capacity tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(F.col("parts"), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", ids.alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = pieces_of(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = written(found.withColumn("ids_crc32", F.crc32("ids")).select("row.doc_id", *columns[1:]))
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"])
