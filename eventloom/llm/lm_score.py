"""LM scoring: logistic mixing of context bit predictors, beside a count model of tokens.

The model codes a text's bytes and an end mark bit by bit. For each order from 0
to 5 it knows exactly how often either bit followed the last bytes and the bits
of the byte so far in all training texts. The predictors' log-odds are mixed by
weights that a gate picks (how well the two longest contexts are known, and the
bit's place in the byte); the weights are learned online, bit by bit in small
steps over the training text's distinct 6-grams by their counts, each predicted
without its own occurrence. The mix is refined by an adaptive map from gate and
mixed chance to what really came. The text's log10 chance and bits per byte are
sums over its bytes.

What is counted grows with the corpus: the distinct 6-grams are dealt by their
last three context bytes, so that a task has all of a context's grams for the
orders 3 to 5 and counts by sums over sorted grams, without buckets. The counts of
orders 0 to 2 (at most 2 ** 24, the alphabet's bound) are known to every worker.
Each distinct gram of all texts gets its chance once; frequent grams, at most
MOST_GRAMS, are known to every worker with their chances, the others are joined.
Tokens alike: frequent ones, at most MOST_TOKENS, are known, the others joined.

`fill_tables` and `log2_chances` are a form of fixed size (BUCKET_BITS) for
callers who need one; contexts share its buckets, and no query uses it.

Null texts are empty: one end token. Without training rows all counts are 0.
Repeated rows are separate rows, also with the same id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_threshold, map_text, small, table, written
from .language import remainder

#: Tokens with their counts that every worker knows, at most.
MOST_TOKENS = 200_000
#: Grams with their chances that every worker knows, at most: 48 MB.
MOST_GRAMS = 3_000_000
#: Grams in a pack, which has all grams of its contexts of three bytes.
PACK_GRAMS = 1 << 14
#: Distinct tokens and grams that a worker counts before it hands them on.
COUNTED = 400_000
#: Byte that stands before a text's first and after its last; UTF-8 has none.
EDGE = 0xFF
#: Of the form of fixed size, for each order the bits of the number of buckets; a bucket has the 15 nodes of half a byte.
BUCKET_BITS = (5, 13, 16, 18, 19, 19)
ORDERS = len(BUCKET_BITS)
SEGMENT_BITS = 14
#: Bytes looked at together.
SLAB = 2 << 20
GATES, MAP_BINS = 15 * 8, 33
ROUNDS, STEP_GRAMS, RATE = 3, 512, 0.02

_FIRST = np.concatenate(([0], np.cumsum([1 << b for b in BUCKET_BITS])))
_SEGMENTS = -(-int(_FIRST[-1]) >> SEGMENT_BITS)


class Model(NamedTuple):
    zeros: np.ndarray  # of each node, logarithmic counts
    ones: np.ndarray
    weights: np.ndarray  # (GATES, ORDERS + 1)
    refine: np.ndarray  # (GATES, MAP_BINS) chances


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """6-grams (the last byte lowest) that end at each byte and end mark, and where each text's begin."""
    edge = bytes([EDGE])
    joined = np.frombuffer(edge * 5 + b"".join(b + edge * 6 for b in bodies), np.uint8).astype(np.uint64)
    n = len(joined) - 5
    key = joined[:n].copy()
    for i in range(1, 6):
        key = (key << np.uint64(8)) | joined[i : i + n]
    # Between texts stand the end mark and five marks before the next one.
    starts = np.cumsum([0, *(len(b) + 6 for b in bodies)])
    keep = np.ones(n, bool)
    for gap in range(1, 6):
        keep[starts[1:] - gap] = False
    return key[keep], np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1]


def _buckets(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the high and of the low half of each gram's last byte."""
    context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
    h = _mix(context * np.uint64(8) + np.uint64(order))
    high = (keys >> np.uint64(4)) & np.uint64(15)
    shift = np.uint64(64 - BUCKET_BITS[order])
    first = int(_FIRST[order])
    low_h = _mix(h ^ ((high + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    return (h >> shift).astype(np.int64) + first, (low_h >> shift).astype(np.int64) + first


def _slabs(bodies: list) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (end == at or size < SLAB):
            size += len(bodies[end] or b"")
            end += 1
        yield at, [b or b"" for b in bodies[at:end]]
        at = end


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))
    return first, np.diff(first, append=len(ordered))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def pack_grams(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """Rows (grams, n, m) of packed int64: 6-grams of the texts, how often they are learned, and how often they are there.

    A row has all grams whose last three context bytes it has.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)

        def out() -> pa.RecordBatch:
            grams = keys.astype(np.int64)
            return pa.RecordBatch.from_pydict({"context": grams >> 8 & 0xFFFFFF, "gram": grams, "n": counts[:, 0].copy(), "m": counts[:, 1].copy()})

        for batch in small(batches, SLAB):
            learned = np.array(batch.column(1).to_pylist(), bool)
            for at, part in _slabs(batch.column(0).to_pylist()):
                every, _ = grams_of(part)
                own = np.repeat(learned[at : at + len(part)], [len(b) + 1 for b in part])
                # Whether a gram is learned is its lowest bit, so that one sort does.
                every = np.sort(every << np.uint64(1) | own)
                first, m = _runs(every >> np.uint64(1))
                new, n = every[first] >> np.uint64(1), np.add.reduceat((every & np.uint64(1)).astype(np.int64), first)
                keys, counts = _summed(np.concatenate((keys, new)), np.concatenate((counts, np.stack((n, m), axis=1))))
                if len(keys) > COUNTED:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(own: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({name: [own[:, i].tobytes()] for i, name in enumerate(("grams", "n", "m"))})

        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)))
            while len(held) >= PACK_GRAMS:
                context = held[:, 0] >> 8 & 0xFFFFFF
                ends = np.flatnonzero(context[1:] != context[:-1]) + 1
                if not len(ends):
                    break
                end = ends[min(np.searchsorted(ends, PACK_GRAMS), len(ends) - 1)]
                yield row(held[:end])
                held = held[end:]
        if len(held):
            yield row(held)

    body = docs.select(docs[text].cast("binary"), F.coalesce(learn, F.lit(False)))
    parts = body.mapInArrow(scan, "context bigint, gram bigint, n bigint, m bigint").repartition("context")
    # Contexts in the order of their hashes, so that a pack has contexts of all sorts to learn from.
    counted = parts.groupBy("context", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    sorted_ = counted.sortWithinPartitions(F.xxhash64("context"), "context", "gram")
    return sorted_.select("gram", "n", "m").mapInArrow(pack, "grams binary, n binary, m binary")


def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            grams, n, m = (np.frombuffer(v, np.int64) for v in row)
            yield grams.astype(np.uint64), n, m


def _sums(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams of an order (its context and a byte), and the sums of the counts before each."""
    keys, n = _summed(keys & np.uint64((1 << 8 * (order + 1)) - 1), n)
    return keys, np.concatenate(([0], np.cumsum(n)))


def low_orders(packs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sums of orders 0 to 2 over all packs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, n, _ in packs_of(batches):
            keys, total = _summed(grams[n > 0] & np.uint64((1 << 24) - 1), n[n > 0])
            yield pa.RecordBatch.from_pydict({"gram": keys.astype(np.int32), "n": total})

    rows = packs.mapInArrow(scan, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    keys, n = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy().astype(np.int64)
    return [_sums(keys, n, order) for order in range(3)]


def _log_count(n: np.ndarray) -> np.ndarray:
    """Counts as 1024ths of powers of two; no 64-bit count fills the two bytes."""
    return np.rint(1024 * np.log2(1.0 + n)).astype(np.uint16)


_COUNT = (2 ** (np.arange(1 << 16) / 1024) - 1).astype(np.float32)


def fill_tables(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logarithmic counts of zeros and ones of every node; 16 nodes a bucket, bounded by BUCKET_BITS."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.uint64)
            n = batch.column(1).to_numpy()
            codes = []
            for order in range(ORDERS):
                high, low = _buckets(keys, order)
                codes += [high * 16 + ((keys >> np.uint64(4)) & np.uint64(15)).astype(np.int64),
                          low * 16 + (keys & np.uint64(15)).astype(np.int64)]
            code, total = _summed(np.concatenate(codes), np.tile(n, 2 * ORDERS))
            yield pa.RecordBatch.from_pydict({"segment": (code >> (SEGMENT_BITS + 4)).astype(np.int32), "code": code, "n": total})

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 16 << SEGMENT_BITS
        for batch in batches:
            segments, code, n = (batch.column(i).to_numpy() for i in range(3))
            for s in np.unique(segments):
                own = segments == s
                total = held.setdefault(int(s), np.zeros(size, np.int64))
                np.add.at(total, code[own] & (size - 1), n[own])
        for s, total in held.items():
            sums = total.reshape(-1, 16)
            zeros, ones = np.zeros_like(sums), np.zeros_like(sums)
            for node in range(1, 16):
                # The leaves below a node: its bits so far, then any.
                depth = node.bit_length() - 1
                width = 16 >> depth
                at = (node - (1 << depth)) * width
                zeros[:, node] = sums[:, at : at + width // 2].sum(axis=1)
                ones[:, node] = sums[:, at + width // 2 : at + width].sum(axis=1)
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([s], pa.int32()), "zeros": [_log_count(zeros).tobytes()], "ones": [_log_count(ones).tobytes()]}
            )

    rows = (
        grams.select("gram", "n")
        .mapInArrow(spread, "segment int, code bigint, n bigint")
        .repartition("segment")
        .mapInArrow(dense, "segment int, zeros binary, ones binary")
    )
    out = np.zeros((2, _SEGMENTS, 16 << SEGMENT_BITS), np.uint16)
    for r in rows.collect():
        out[0, r["segment"]] = np.frombuffer(r["zeros"], np.uint16)
        out[1, r["segment"]] = np.frombuffer(r["ones"], np.uint16)
    return out[0].ravel(), out[1].ravel()


class Bits(NamedTuple):
    """Of one bit of each gram: the mixer's inputs, its gate, the bit itself."""

    inputs: np.ndarray
    gate: np.ndarray
    bit: np.ndarray


def _inputs(counts: list[tuple[np.ndarray, np.ndarray]], bit: np.ndarray, at: int, without: int) -> Bits:
    inputs = np.ones((len(bit), ORDERS + 1), np.float32)
    seen = []
    for order, (n0, n1) in enumerate(counts):
        if without:
            n0 = np.where(bit == 0, np.maximum(n0 - without, 0), n0)
            n1 = np.where(bit == 1, np.maximum(n1 - without, 0), n1)
        inputs[:, order] = np.log((n1 + 0.3) / (n0 + 0.3))
        if order >= ORDERS - 2:
            seen.append(n0 + n1)
    known = np.digitize(seen[1], (0.5, 1.5, 3.5, 15.5)) * 3 + np.digitize(seen[0], (0.5, 3.5))
    return Bits(inputs, known * 8 + at, bit)


def _walk(keys: np.ndarray, known: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of zeros and ones after the context and the bits so far, for each bit of the grams' last bytes."""
    # Grams that end alike are looked up once.
    keys, places = np.unique(keys, return_inverse=True)
    first = keys & ~np.uint64(255)
    low, high = (sums[np.searchsorted(known, v)] for v in (first, first + np.uint64(256)))
    for at in range(8):
        half = np.uint64(128 >> at)
        middle = sums[np.searchsorted(known, first + half)]
        yield (middle - low)[places], (high - middle)[places]
        one = (keys & half) > 0
        first = np.where(one, first + half, first)
        low, high = np.where(one, middle, low), np.where(one, high, middle)


def bits_of(keys: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]], without: int) -> Iterator[Bits]:
    """The eight bits of the grams' last bytes; without: occurrences of its own that a gram does not count."""
    walks = [_walk(keys & np.uint64((1 << 8 * (order + 1)) - 1), *own) for order, own in enumerate(sums)]
    for at, counts in enumerate(zip(*walks, strict=True)):
        yield _inputs(counts, ((keys >> np.uint64(7 - at)) & np.uint64(1)).astype(np.int64), at, without)


def table_bits(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Iterator[Bits]:
    """bits_of by the tables of fixed size."""
    places = [_buckets(keys, order) for order in range(ORDERS)]
    byte = (keys & np.uint64(255)).astype(np.int64)
    for at in range(8):
        if at < 4:
            node = (1 << at) | (byte >> (8 - at))
        else:
            node = (1 << (at - 4)) | ((byte >> (8 - at)) & ((1 << (at - 4)) - 1))
        slots = [own[at >= 4] * 16 + node for own in places]
        yield _inputs([(_COUNT[zeros[slot]], _COUNT[ones[slot]]) for slot in slots], (byte >> (7 - at)) & 1, at, 0)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


def _map_place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin below and share of the bin above for log-odds."""
    place = (np.clip(x, -8, 8) + 8) * ((MAP_BINS - 1) / 16)
    low = np.minimum(place.astype(int), MAP_BINS - 2)
    return low, place - low


def _learn(packs: DataFrame, low) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights and map, a few rounds over all grams; each task learns online, tasks are averaged by what they saw."""
    weights = np.full((GATES, ORDERS + 1), 0.25)
    weights[:, -1] = 0

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Iterator[Bits]]]:
        for keys, n, _ in packs_of(batches):
            keys, n = keys[n > 0], n[n > 0]
            order = np.argsort(_mix(keys), kind="stable")
            sums = [*low.value, *(_sums(keys, n, k) for k in range(3, ORDERS))]
            yield n[order].astype(float), bits_of(keys[order], sums, 1)

    def learn(start: np.ndarray, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, mass = start.copy(), np.zeros(GATES)
            for n, bits in learned(batches):
                for b in bits:
                    mass += np.bincount(b.gate, n, GATES)
                    for at in range(0, len(n), STEP_GRAMS):
                        s = slice(at, at + STEP_GRAMS)
                        x, gate = b.inputs[s], b.gate[s]
                        wrong = b.bit[s] - _squash((x * own[gate]).sum(axis=1))
                        # Frequent grams count more, up to a point that keeps steps small.
                        step = rate * np.minimum(np.sqrt(n[s]), 16) * wrong
                        np.add.at(own, gate, step[:, None] * x / 8)
            yield pa.RecordBatch.from_pydict({"weights": [own.tobytes()], "mass": [mass.tobytes()]})

        return run

    for turn in range(ROUNDS):
        total, mass = np.zeros_like(weights), np.zeros(GATES)
        for r in packs.mapInArrow(learn(weights, RATE / (1 + turn)), "weights binary, mass binary").collect():
            m = np.frombuffer(r["mass"])
            total += np.frombuffer(r["weights"]).reshape(weights.shape) * m[:, None]
            mass += m
        weights = np.where(mass[:, None] > 0, total / np.maximum(mass, 1)[:, None], weights)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((2, GATES, MAP_BINS))
        for n, bits in learned(batches):
            for b in bits:
                at, share = _map_place((b.inputs * weights[b.gate]).sum(axis=1))
                for place, part in ((at, 1 - share), (at + 1, share)):
                    place = b.gate * MAP_BINS + place
                    hits[0] += np.bincount(place, n * part, GATES * MAP_BINS).reshape(GATES, MAP_BINS)
                    hits[1] += np.bincount(place, n * part * b.bit, GATES * MAP_BINS).reshape(GATES, MAP_BINS)
        yield pa.RecordBatch.from_pydict({"hits": [hits.tobytes()]})

    hits = np.zeros((2, GATES, MAP_BINS))
    for r in packs.mapInArrow(observe, "hits binary").collect():
        hits += np.frombuffer(r["hits"]).reshape(hits.shape)
    prior = _squash(np.linspace(-8, 8, MAP_BINS))
    return weights, (hits[1] + 8 * prior) / (hits[0] + 8)


def _log2(bits: Iterator[Bits], size: int, weights: np.ndarray, refine: np.ndarray) -> np.ndarray:
    total = np.zeros(size)
    for b in bits:
        x = (b.inputs * weights[b.gate]).sum(axis=1)
        low, share = _map_place(x)
        refined = refine[b.gate, low] * (1 - share) + refine[b.gate, low + 1] * share
        p = np.clip((_squash(x) + refined) / 2, 1e-6, 1 - 1e-6)
        total += np.log2(np.where(b.bit == 1, p, 1 - p))
    return total


def log2_chances(model: Model, keys: np.ndarray) -> np.ndarray:
    """log2 of the chance of each gram's last byte after those before it, by the tables of fixed size."""
    return _log2(table_bits(keys, model.zeros, model.ones), len(keys), model.weights, model.refine)


def gram_chances(packs: DataFrame) -> DataFrame:
    """(gram, m, bits): how often each distinct gram is there, log2 of its chance."""
    low = packs.sparkSession.sparkContext.broadcast(low_orders(packs))
    weights, refine = _learn(packs, low)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, m in packs_of(batches):
            sums = [*low.value, *(_sums(keys[n > 0], n[n > 0], k) for k in range(3, ORDERS))]
            bits = _log2(bits_of(keys, sums, 0), len(keys), weights, refine)
            yield pa.RecordBatch.from_pydict({"gram": keys.astype(np.int64), "m": m, "bits": bits})

    return packs.mapInArrow(scan, "gram bigint, m bigint, bits double")


def _looked_up(part: list[bytes], grams: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each of a few texts the sum of its known grams' bits and how many others it has; those grams, how often.

    grams is sorted and ends with one that no text has.
    """
    sizes = [len(b) + 1 for b in part]
    # 48 bits of a gram, 16 of its text: sorted, they are searched for in order, each gram once.
    assert len(part) <= 1 << 16
    both = np.sort(grams_of(part)[0] << np.uint64(16) | np.repeat(np.arange(len(part), dtype=np.uint64), sizes))
    first, n = _runs(both)
    own, text = (both[first] >> np.uint64(16)).astype(np.int64), both[first].astype(np.uint16)
    first, copies = _runs(own)
    at = np.searchsorted(grams, own[first])
    known = grams[at] == own[first]
    total = np.bincount(text, n * np.repeat(np.where(known, bits[at], 0.0), copies), len(part))
    rare = np.flatnonzero(~np.repeat(known, copies))
    rare = rare[np.argsort(text[rare], kind="stable")]
    return total, np.bincount(text[rare], minlength=len(part)), own[rare], n[rare]


def tokens(body: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (body or b"").lower().split()


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) of all words of the texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return batch

        for batch in small(batches):
            for body in batch.column(0).to_pylist():
                seen.update(tokens(body))
                if len(seen) >= COUNTED:
                    yield out()
        yield out()

    parts = docs.select(docs[text].cast("binary")).mapInArrow(scan, "token binary, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def score_texts(
    docs: DataFrame, learn: Column, text: str = "text", keep: list[str] | None = None, most_tokens: int = MOST_TOKENS, most_grams: int = MOST_GRAMS
) -> DataFrame:
    """Rows (row, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every text.

    learn marks the rows that are learned from.
    """
    sc = docs.sparkSession.sparkContext
    training = docs.where(learn)
    chances = written(gram_chances(written(pack_grams(docs, learn, text))))
    counts = written(count_tokens(training, text))
    ends = training.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("token")).head()
    n_all, kinds = n_words + ends, n_kinds + (ends > 0)
    below = math.log10(n_all + 0.1 * (kinds + 1))
    frequent = counts.where(F.col("n") >= hot_threshold(counts, "n", most_tokens))
    known = sc.broadcast({bytes(r["token"]): math.log10(r["n"] + 0.1) - below for r in frequent.collect()})
    often = chances.where(F.col("m") >= hot_threshold(chances, "m", most_grams)).select("gram", "bits").toArrow()
    grams, bits_of_gram = often.column(0).to_numpy(), often.column(1).to_numpy()
    order = np.argsort(grams, kind="stable")
    # A last gram that no text has: every search ends inside.
    model = sc.broadcast((np.append(grams[order], 1 << 62), np.append(bits_of_gram[order], 0.0)))
    del often, grams, bits_of_gram, order
    end_score = math.log10(ends + 0.1) - below

    def scan(batches):
        values = known.value
        grams, bits_of_gram = model.value
        for rows, column in batches:
            bodies = column.to_pylist()
            out = {"n_tokens": [], "n_known": [], "base": [], "rare": [], "bits": [], "bytes": []}
            for body in bodies:
                words = tokens(body)
                n = Counter(words)
                rare = [(t, k) for t, k in n.items() if t not in values]
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(words) - sum(k for _, k in rare) + (ends > 0))
                out["base"].append(math.fsum(values[t] * k for t, k in n.items() if t in values) + end_score)
                out["rare"].append([{"token": t, "n": k} for t, k in rare])
            rest = []
            for _, part in _slabs(bodies):
                bits, *rare_grams = _looked_up(part, grams, bits_of_gram)
                out["bits"] += bits.tolist()
                out["bytes"] += [len(b) for b in part]
                rest.append(rare_grams)
            sizes, *pairs = (np.concatenate(v) for v in zip(*rest, strict=True))
            ends_at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            out["rare_grams"] = pa.ListArray.from_arrays(ends_at, pa.StructArray.from_arrays([pa.array(v) for v in pairs], ["gram", "n"]))
            yield rows, out

    fields = "n_tokens bigint, n_known bigint, base double, rare array<struct<token:binary,n:bigint>>, bits double, bytes bigint"
    fields += ", rare_grams array<struct<gram:bigint,n:bigint>>"
    part = written(map_text(docs, scan, fields, text, keep).withColumn("line", F.monotonically_increasing_id()))
    rare = part.select("line", F.explode("rare").alias("r")).select("line", "r.token", F.col("r.n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = (
        rare.join(counts, "token", "left")
        .groupBy("line")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * (F.log10(c + 0.1) - below)).alias("more"),
        )
    )
    rest = part.select("line", F.explode("rare_grams").alias("r")).select("line", "r.gram", F.col("r.n").alias("times"))
    rest = rest.join(chances.select("gram", F.col("bits").alias("own")), "gram").groupBy("line")
    rest = rest.agg(F.sum(F.col("times") * F.col("own")).alias("more_bits"))
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return part.join(rare, "line", "left").join(rest, "line", "left").select(
        "row",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (bits * math.log10(2)).alias("score"),
        (-bits / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' scores of every document, learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda key: remainder(F.col(key), 10) == 0
    return score_texts(docs, ~held_out("doc_id"), keep=["doc_id"]).select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
