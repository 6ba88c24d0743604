"""Suffix-array deduplication: bytes under strings of LENGTH bytes that start elsewhere too.

Whole suffix arrays do not fit, nor do they have to: a string of LENGTH bytes
has its least hashed GRAM-byte piece (its anchor) at the same place wherever it
stands. So only suffixes at anchors are sorted, in buckets of equal anchors, with
the at most LENGTH - GRAM bytes before and LENGTH bytes after that a string with
this anchor can reach. In a bucket a stack scan over the sorted suffixes and their
common prefixes walks the common-prefix intervals from the deepest up. Each
keeps its suffixes sorted by what stands before them; where two intervals meet,
new neighbours in that order show how far the left extensions differ, and all
occurrences of the maximal repeat, not just neighbours in the array, learn how
far it reaches to either side.

Equal surroundings count as one suffix, so crowds of copies are one entry.
Buckets with more than HOT different surroundings are not sorted in one task:
all their strings of LENGTH bytes are hashed and counted over the cluster.

Null texts are empty. Texts shorter than LENGTH keep all bytes. Repeated rows
repeat each other: from LENGTH bytes on both go whole. Very long texts are
hashed in blocks. Extra columns travel in one struct.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, small, table, written

LENGTH, GRAM = 400, 64
#: Different surroundings in a bucket that one task sorts.
HOT = 20_000
#: Bits of the maps that say which anchors and texts matter; what they let through too much is dropped later.
MARK_BITS = 26
#: Texts and surroundings that a task remembers having handed on.
REMEMBERED = 300_000
BLOCK_BITS = 19
#: Keys that hold more than one in MANY of all rows are joined by a broadcast; there are at most MANY of them.
MANY = 5_000

_WINDOW = LENGTH - GRAM + 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, (1 << BLOCK_BITS) + LENGTH + 1)
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            one = np.full(size, base, np.uint64)
            one[0] = 1
            _POWERS[name] = np.multiply.accumulate(one)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * down[: len(raw)], out=total[1:])
    n = len(raw) - size + 1
    return (total[size:] - total[:n]) * up[:n]


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: the leftmost least gram of every LENGTH bytes."""
    if len(body) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(body, np.uint8)
    places, hashes = [], []
    step = 1 << BLOCK_BITS
    for at in range(0, len(body) - LENGTH + 1, step):
        # Blocks overlap so that each string of LENGTH bytes lies in one.
        h = _mix(rolling(raw[at : at + step + LENGTH - 1], GRAM))
        mask = np.uint64((1 << BLOCK_BITS + 1) - 1)
        placed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        own = np.unique(_least_in_windows(placed, _WINDOW) & mask).astype(np.int64)
        places.append(own + at)
        hashes.append(h[own])
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return places, hashes[first]


def text_key(body: bytes | None) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(body or b"")


def _mark(rows: DataFrame, column: str) -> np.ndarray:
    """Packed map, of fixed size, of the classes of a column of hashes or of text keys."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << MARK_BITS - 3, np.uint8)
        for batch in batches:
            keys = batch.column(0)
            at = _class(_numbers(keys.to_pylist()) if pa.types.is_binary(keys.type) else keys.to_numpy().astype(np.uint64))
            np.bitwise_or.at(seen, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for i, part in enumerate(seen.reshape(64, -1)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "bits": [part.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) | np.frombuffer(bits, np.uint8)
        for i, bits in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "bits": [bits.tobytes()]})

    kind = "part int, bits binary"
    out = np.zeros((64, (1 << MARK_BITS) // 512), np.uint8)
    for r in rows.select(column).mapInArrow(mark, kind).repartition("part").mapInArrow(add, kind).collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _numbers(keys: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "big") for k in keys], np.uint64)


def _class(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _class(keys)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _repeated_grams(texts: DataFrame) -> DataFrame:
    """(gram) of anchors that stand in more than one place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in small(batches):
            found = []
            for body in batch.column(0).to_pylist():
                if body and (key := text_key(body)) not in seen:
                    found.append(anchors(body)[1])
                    if len(seen) < REMEMBERED:
                        seen.add(key)
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": grams.astype(np.int64), "n": n.astype(np.int64)})

    counts = texts.mapInArrow(scan, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("gram")


def _reach(body: bytes, place: int) -> tuple[int, int]:
    """Where the first and the last string of LENGTH bytes with an anchor at this place start."""
    return max(0, place + GRAM - LENGTH), min(place, len(body) - LENGTH)


def _surroundings(texts: DataFrame, marks: np.ndarray, whole: bool) -> DataFrame:
    """Marked anchors with hashes of the first and last string around them; with their bytes, if whole, else their places."""
    held = texts.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        seen: set[bytes] = set()
        given: set[int] = set()
        bits = held.value
        for batch in small(batches):
            out: dict[str, list] = {"gram": [], "left": [], "right": [], "back": [], "ahead": [], "text": [], "place": []}
            if whole:
                out = {"gram": [], "left": [], "right": [], "back": [], "around": []}
            for body in batch.column(0).to_pylist():
                if not body or (key := text_key(body)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                places, grams = anchors(body)
                fine = _marked(bits, grams)
                for place, gram in zip(places[fine].tolist(), grams[fine].tolist(), strict=True):
                    first, last = _reach(body, place)
                    left = xxh3_64_intdigest(body[first : first + LENGTH], place - first)
                    right = xxh3_64_intdigest(body[last : last + LENGTH], place - last)
                    if whole:
                        if (mine := hash((gram, left, right))) in given:
                            continue
                        if len(given) < REMEMBERED:
                            given.add(mine)
                        out["around"].append(body[first : last + LENGTH])
                    else:
                        out["ahead"].append(last + LENGTH - place)
                        out["text"].append(key)
                        out["place"].append(place)
                    out["gram"].append(signed(gram))
                    out["left"].append(signed(left))
                    out["right"].append(signed(right))
                    out["back"].append(place - first)
            kinds = {"back": pa.int32(), "ahead": pa.int32(), "text": pa.binary(), "around": pa.binary()}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    base = "gram bigint, left bigint, right bigint, back int, "
    return texts.mapInArrow(scan, base + ("around binary" if whole else "ahead int, text binary, place bigint"))


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def reaches(afters: list[bytes], befores: list[bytes], length: int) -> tuple[list[int], list[int]]:
    """For each suffix how many bytes before and after its anchor repeats of `length` bytes and more cover.

    afters: the bytes from the anchor on, befores: those in front of it, backwards.
    Both are 0 for a suffix without repeat.
    """
    order = sorted(range(len(afters)), key=afters.__getitem__)
    back, ahead = [0] * len(afters), [0] * len(afters)

    def meet(x: int, y: int, right: int) -> None:
        left = common_prefix(befores[x], befores[y])
        if left + right >= length:
            for i in (x, y):
                back[i] = max(back[i], left)
                ahead[i] = max(ahead[i], right)

    def joined(a: list, b: list, right: int) -> list:
        """Suffixes of both intervals by what stands before them; only new neighbours have to be compared."""
        if len(a) < len(b):
            a, b = b, a
        for entry in b:
            at = bisect_left(a, entry)
            if at:
                meet(entry[1], a[at - 1][1], right)
            if at < len(a):
                meet(entry[1], a[at][1], right)
            a.insert(at, entry)
        return a

    # Stack of open intervals: the prefix common with the one below, and the suffixes.
    stack: list[tuple[int, list]] = []
    previous = None
    for i in order:
        shared = 0 if previous is None else common_prefix(afters[previous], afters[i])
        while len(stack) > 1 and stack[-1][0] > shared:
            right, top = stack.pop()
            below = stack.pop()
            stack.append((below[0], joined(below[1], top, right)))
        stack.append((shared, [(befores[i], i)]))
        previous = i
    while len(stack) > 1:
        right, top = stack.pop()
        below = stack.pop()
        stack.append((below[0], joined(below[1], top, right)))
    return back, ahead


_COVER = "gram bigint, left bigint, right bigint, more_back int, more_ahead int"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Different surroundings of equal anchors; rows are sorted by both."""
    own: list[tuple] = []
    for batch in small(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and own[0][0] != row[0]:
                yield own
                own = []
            if not own or own[-1][:3] != row[:3]:
                own.append(row)
    if own:
        yield own


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        g, l, r, b, a = zip(*out, strict=True) if out else ([],) * 5  # noqa: E741
        rows = pa.RecordBatch.from_pydict({
            "gram": pa.array(g, pa.int64()), "left": pa.array(l, pa.int64()), "right": pa.array(r, pa.int64()),
            "more_back": pa.array(b, pa.int32()), "more_ahead": pa.array(a, pa.int32()),
        })
        out.clear()
        return rows

    for bucket in _by_bucket(batches):
        afters = [around[at:] for *_, at, around in bucket]
        befores = [around[:at][::-1] for *_, at, around in bucket]
        back, ahead = reaches(afters, befores, LENGTH)
        out += [(g, l, r, b, a) for (g, l, r, *_), b, a in zip(bucket, back, ahead, strict=True) if a]  # noqa: E741
        if len(out) > 20_000:
            yield batch()
    yield batch()


def _counted_strings(around: DataFrame) -> DataFrame:
    """Reaches in large buckets: every string of LENGTH bytes around an anchor is counted by its hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, left, right, back, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = rolling(np.frombuffer(body, np.uint8), LENGTH)
                before = back - np.arange(len(h))
                keys = _mix(h ^ _mix(np.uint64(gram & ((1 << 64) - 1)) + before.astype(np.uint64)))
                same = lambda v: np.full(len(h), v, np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"key": keys.astype(np.int64), "gram": same(gram), "left": same(left),
                                                  "right": same(right), "before": before.astype(np.int32)})

    strings = around.mapInArrow(scan, "key bigint, gram bigint, left bigint, right bigint, before int")
    again = strings.groupBy("key").agg(F.count("before").alias("n")).where("n > 1")
    return (
        strings.join(again, "key", "left_semi")
        .groupBy("gram", "left", "right")
        .agg(F.max("before").alias("more_back"), (LENGTH - F.min("before")).cast("int").alias("more_ahead"))
    )


def _long_texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(docs[text].cast("binary").alias("body")).where(F.length("body") >= LENGTH)


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, spans): for keys of texts the maximal runs of bytes under strings that start elsewhere too."""
    texts = _long_texts(docs, text)
    sites = written(_surroundings(texts, _mark(_repeated_grams(texts), "gram"), False).distinct())
    one = ["gram", "left", "right"]
    kinds = sites.groupBy(*one).agg(F.count("place").alias("n"))
    buckets = kinds.groupBy("gram").agg(F.sum("n").alias("places"), F.count("n").alias("kinds")).where("places > 1")
    kinds = written(kinds.join(buckets, "gram"))
    around = _surroundings(texts, _mark(kinds.where("kinds > 1"), "gram"), True)
    # At most one in HOT surroundings has a bucket of that size, so these are few.
    hot = F.broadcast(written(kinds.where(F.col("kinds") > HOT).select("gram").distinct()))
    sorted_ = around.join(hot, "gram", "left_anti").select(*around.columns).repartition("gram").sortWithinPartitions(*one)
    found = sorted_.mapInArrow(_sorted_buckets, _COVER)
    if not hot.isEmpty():
        large = around.join(hot, "gram", "left_semi").groupBy(*one).agg(F.min("back").alias("back"), F.min("around").alias("around"))
        found = found.unionByName(_counted_strings(large))
    # Surroundings that stand in several places are covered as far as they go.
    full = kinds.where("n > 1").select(*one, F.lit(LENGTH).alias("more_back"), F.lit(LENGTH).alias("more_ahead"))
    cover = full.unionByName(found).groupBy(*one).agg(F.max("more_back").alias("more_back"), F.max("more_ahead").alias("more_ahead"))
    # What very many places have, as a line that every third text holds, goes to them rather than they to it.
    limit = kinds.agg(F.sum("n")).head()[0] or 0
    hot_kinds = F.broadcast(written(kinds.where(F.col("n") > max(1, limit // MANY)).select(*one)))
    cover = written(cover)
    often = sites.join(F.broadcast(cover.join(hot_kinds, one, "left_semi")), one)
    seldom = sites.join(hot_kinds, one, "left_anti").join(cover, one)
    columns = ["text", "place", "back", "ahead", "more_back", "more_ahead"]
    covered = often.select(*columns).unionByName(seldom.select(*columns)).select(
        "text",
        F.struct(
            (F.col("place") - F.least("back", "more_back")).alias("start"), (F.col("place") + F.least("ahead", "more_ahead")).alias("end")
        ).alias("span"),
    )
    return covered.groupBy("text").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda v: v["start"]):
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (row, n_bytes, removed, kept) for every text: the removed runs of bytes and the bytes that stay."""
    sc = docs.sparkSession.sparkContext
    spans = repeated_spans(docs, text)

    def key_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_pydict({"text": [text_key(b) for b in batch.column(0).to_pylist()]})

    keys = _long_texts(docs, text).mapInArrow(key_only, "text binary")
    copies = written(keys.groupBy("text").agg(F.count("text").alias("n")).where("n > 1"))
    # Texts with very many copies go whole where they are read; at most MANY keys.
    limit = copies.agg(F.sum("n")).head()[0] or 0
    gone = sc.broadcast({bytes(r["text"]) for r in copies.where(F.col("n") > max(1, limit // MANY)).select("text").collect()})
    spans = spans.join(copies, "text", "full").select("text", "spans", (F.coalesce("n", F.lit(0)) > 1).alias("whole"))
    spans = written(spans)
    marks = sc.broadcast(_mark(spans, "text"))

    def split(batches):
        for rows, bodies in batches:
            found = bodies.to_pylist()
            own = [text_key(b) if b and len(b) >= LENGTH else None for b in found]
            lost = np.array([k in gone.value for k in own], bool)
            hit = _marked(marks.value, _numbers([k or b"" for k in own])) & np.array([k is not None for k in own]) & ~lost
            yield rows, {"body": bodies, "text": [k if h else None for k, h in zip(own, hit, strict=True)], "lost": lost}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in small(batches):
            out: dict = {"n_bytes": [], "removed": [], "kept": []}
            for body, own, all_ in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                body = body or b""
                runs = [(0, len(body))] if all_ else _united(own or [])
                edges = [0, *(e for run in runs for e in run), len(body)]
                out["n_bytes"].append(len(body))
                out["removed"].append([{"start": a, "end": b} for a, b in runs])
                out["kept"].append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kinds = {"n_bytes": pa.int64(), "removed": run, "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[n]) for n, v in out.items())], names=["row", *out])

    parts = map_text(docs, split, "body binary, text binary, lost boolean", text, keep)
    # Only texts that may lose something are moved.
    empty = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    none = parts.where("text IS NULL").select("row", "body", empty, F.col("lost").alias("whole"))
    some = parts.where("text IS NOT NULL").join(spans, "text", "left").select("row", "body", "spans", "whole")
    fields = "n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
    schema = T.StructType([parts.schema["row"], *T._parse_datatype_string(fields).fields])
    return none.unionByName(some).mapInArrow(cut, schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the strings of 400 bytes that stand elsewhere too."""
    done = without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "row.doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
