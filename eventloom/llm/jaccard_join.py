"""Exact n-gram Jaccard join: prefixes of rare shingles, groups of equal prefixes, verified members.

A document is the set of its hashed word shingles (lower-cased ASCII; with fewer
words the whole sequence is one). Equal sets are one member. All shingles have
one order, from rare to frequent by a sketch of all texts' shingles, then by
hash; two sets as similar as asked share a shingle among their first ones, the
prefix. Members with the same size and prefix are one group, and groups are
compared by size and by the place of a shared shingle.

Pairs are looked at in two rounds. First every posting's groups meet only the
group that has the shingle earliest, which links crowds of copies in a star.
Then the pairs of groups whose members are not yet all connected are expanded
and verified. So no link between different components is missed, and a crowd of
n copies costs about n pairs. A set's parities, one bit for each class of its
hashes, tell at least how many hashes only one of two sets has: pairs that differ
too much already by that are dropped, and only the others' sets are moved.

Null and wordless texts are empty: no shingles, linked with nothing, a
component of their own. Repeated rows are separate rows of one component. A
component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_text, small, table, written
from .graph import components

#: Counters of the sketch that orders shingles, as a power of two: 2 ** 21 take 8 MB.
SKETCH_BITS, SEGMENT_BITS = 21, 16
#: Longer words are hashed one by one; bytes of a text whose words are hashed together.
LONG_WORD, PIECE = 64, 1 << 17
#: Bits of the map that says which sets are needed; what it lets through too much is dropped later.
NEEDED_BITS = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    out = []
    for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        one = np.full(PIECE + LONG_WORD, base, np.uint64)
        one[0] = 1
        out.append(np.multiply.accumulate(one))
    return out[0], out[1]


def word_hashes(body: bytes) -> np.ndarray:
    """A hash of each word, in lower case: sums of its letters by place, taken for many words together, mixed."""
    import xxhash

    body = body.lower()
    raw = np.frombuffer(body, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        if ends[i] - starts[i] <= LONG_WORD or j > i + 1:
            own = raw[starts[i] : ends[j - 1]]
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_LETTERS[own] * down[: len(own)], out=total[1:])
            at, to = starts[i:j] - starts[i], ends[i:j] - starts[i]
            out[i:j] = _mix((total[to] - total[at]) * up[at] + (to - at).astype(np.uint64))
        i = j
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]])
    return out


def shingle_set(body: bytes | None, size: int) -> np.ndarray:
    """Sorted different hashes of a text's shingles of `size` words."""
    h = word_hashes(body or b"")
    width = min(size, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    total = h[:n] * _ODD + np.uint64(width)
    for i in range(1, width):
        # Powers of an odd number keep the words' places apart.
        total *= _ODD
        total += h[i : n + i]
    total = np.sort(_mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def set_key(own: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def parities(own: np.ndarray) -> bytes:
    """Whether each class of hashes has an odd number of the set's; at least as many classes as hashes."""
    width = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """At least so many hashes are in one of two sets only."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    # The longer one's classes are parts of the shorter one's.
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def shingle_sketch(docs: DataFrame, size: int, text: str = "text") -> np.ndarray:
    """How many documents have a shingle of each class of hashes; an array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in small(batches):
            for body in batch.column(0).to_pylist():
                np.add.at(total, (shingle_set(body, size) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        for i, part in enumerate(total.reshape(-1, 1 << SEGMENT_BITS)):
            if part.any():
                # A task sees few shingles of a class, so this packs well.
                packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "counts": [packed]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = pa.decompress(part, 4 << SEGMENT_BITS, codec="zstd", asbytes=True)
                held[i] = held.get(i, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        for i, part in held.items():
            counts = np.minimum(part, (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "counts": [counts.tobytes()]})

    kind = "segment int, counts binary"
    rows = docs.select(docs[text].cast("binary")).mapInArrow(count, kind).repartition("segment").mapInArrow(add, kind)
    out = np.zeros((1 << SKETCH_BITS - SEGMENT_BITS, 1 << SEGMENT_BITS), np.uint32)
    for r in rows.collect():
        out[r["segment"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _prefixes(docs: DataFrame, size: int, percent: int, text: str, keep: list[str]) -> DataFrame:
    """Rows (row, text_key, n, set_key, prefix, group_key, odd) of every document."""
    sketch = docs.sparkSession.sparkContext.broadcast(shingle_sketch(docs, size, text))

    def scan(batches):
        import xxhash

        counts = sketch.value
        for rows, column in batches:
            out: dict = {"text_key": [], "n": [], "set_key": [], "prefix": [], "group_key": [], "odd": []}
            for body in column.to_pylist():
                own = shingle_set(body, size)
                rare = np.argsort(counts[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix = own[rare[: prefix_length(len(own), percent)]]
                out["text_key"].append(None if body is None else xxhash.xxh3_128_digest(body))
                out["n"].append(len(own))
                out["set_key"].append(set_key(own))
                out["prefix"].append(prefix.astype(np.int64))
                out["odd"].append(parities(own) if len(own) else None)
                out["group_key"].append(xxhash.xxh3_128_digest(prefix.tobytes() + len(own).to_bytes(8, "little")) if len(own) else None)
            yield rows, out

    fields = "text_key binary, n bigint, set_key binary, prefix array<bigint>, group_key binary, odd binary"
    return map_text(docs, scan, fields, text, keep)


def _class(key: bytes) -> int:
    return int.from_bytes(key[:8], "little") >> (64 - NEEDED_BITS)


def _marked(marks: np.ndarray, key: bytes) -> bool:
    at = _class(key)
    return marks[at >> 3] >> (7 - (at & 7)) & 1 == 1


def _marks(keys: DataFrame) -> np.ndarray:
    """Packed map, of fixed size, of the classes of a column of text keys."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << NEEDED_BITS, bool)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                bits[_class(key)] = True
        yield pa.RecordBatch.from_pydict({"at": np.flatnonzero(bits).astype(np.int32)})

    marks = keys.mapInArrow(mark, "at int").distinct()
    bits = np.zeros(1 << NEEDED_BITS, bool)
    for batch in marks.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = True
    return np.packbits(bits)


def _needed_sets(docs: DataFrame, keys: DataFrame, size: int, text: str) -> DataFrame:
    """(text_key, cells) of the wanted texts: they are read again, and only what is needed is split."""
    held = docs.sparkSession.sparkContext.broadcast(_marks(keys))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        marks = held.value
        for batch in small(batches):
            found: dict[bytes, np.ndarray] = {}
            for body in batch.column(0).to_pylist():
                key = xxhash.xxh3_128_digest(body or b"")
                if key not in found and _marked(marks, key):
                    found[key] = shingle_set(body, size).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"text_key": pa.array(list(found), pa.binary()), "cells": pa.array(list(found.values()), pa.list_(pa.int64()))}
            )

    sets = docs.select(docs[text].cast("binary")).mapInArrow(scan, "text_key binary, cells array<bigint>")
    return sets.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.min("cells").alias("cells"))


def _hopeful(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members whose parities leave open that they are similar enough."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            total, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
            apart = np.array([least_difference(*xy) for xy in zip(x, y, strict=True)], np.int64)
            total = np.array(total, np.int64)
            near = pa.array((100 + percent) * (total - apart) >= 2 * percent * total)
            yield batch.select([0, 1]).filter(near)

    own = members.select("member", "n", "odd")
    x = pairs.join(own.select(F.col("member").alias("a"), F.col("n").alias("nx"), F.col("odd").alias("x")), "a")
    xy = x.join(own.select(F.col("member").alias("b"), F.col("n").alias("ny"), F.col("odd").alias("y")), "b")
    return xy.select("a", "b", F.col("nx") + F.col("ny"), "x", "y").mapInArrow(scan, "a bigint, b bigint")


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """The pairs (a, b) of members that are similar enough."""
    spark = docs.sparkSession
    pairs = written(_hopeful(members, pairs, percent))
    if pairs.isEmpty():
        return spark.createDataFrame([], "a bigint, b bigint")
    own = members.select("member", "text_key")
    ids = pairs.select(F.col("a").alias("member")).unionByName(pairs.select(F.col("b").alias("member"))).distinct()
    wanted = written(ids.join(own, "member"))
    sets = _needed_sets(docs, wanted.select("text_key"), size, text).join(wanted, "text_key").select("member", "cells")
    sets = written(sets)
    x = pairs.join(sets.select(F.col("member").alias("a"), F.col("cells").alias("x")), "a")
    xy = x.join(sets.select(F.col("member").alias("b"), F.col("cells").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    return written(xy.where((100 + percent) * shared >= percent * (F.size("x") + F.size("y"))).select("a", "b"))


def jaccard_groups(
    docs: DataFrame, size: int, percent: int, text: str = "text", key: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """Rows (row, text_key, n_shingles, component, first) for every document.

    component is the least id of all that links of percent / 100 and more lead
    to; first marks the rows with the component's least (id, text).
    """
    keep = docs.columns if keep is None else keep
    if key not in keep:
        keep = [*keep, key]
    lines = written(_prefixes(docs, size, percent, text, keep).withColumn("line", F.monotonically_increasing_id()))
    some = lines.where("set_key IS NOT NULL")
    members = written(
        some.groupBy("set_key")
        .agg(F.min(F.struct("line", "text_key")).alias("m"), F.min(F.struct("group_key", "n", "prefix", "odd")).alias("g"))
        .select("set_key", F.col("m.line").alias("member"), "m.text_key", "g.*")
    )
    groups = members.groupBy("group_key").agg(
        F.min("member").alias("g"), F.min("n").alias("n"), F.min("prefix").alias("prefix")
    )
    in_group = written(members.select("group_key", "member").join(groups.select("group_key", "g"), "group_key").select("g", "member"))
    # Dealt by shingle once, for both the sums and the join; most shingles are in one prefix only and go at once.
    # A shingle that very many documents have stands last in their order, so a prefix seldom has it.
    postings = groups.select("g", "n", F.posexplode("prefix").alias("pos", "shingle")).repartition("shingle")
    tops = postings.groupBy("shingle").agg(F.min(F.struct("pos", "g", "n")).alias("p"), F.count("g").alias("many"))
    shared = written(postings.join(tops.where("many > 1").drop("many"), "shingle"))

    def close(a: str, b: str):
        """What the first shared shingle's places allow: no more can be shared than stands from there on."""
        most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
        return (100 + percent) * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    # First round: the group with a posting's earliest place, and the groups with the same prefix.
    stars = (
        shared.select("shingle", F.struct("pos", "g", "n").alias("x"), "p")
        .where("x.g <> p.g")
        .where(close("x", "p"))
        .select(F.least("x.g", "p.g").alias("a"), F.greatest("x.g", "p.g").alias("b"))
    )
    alike = in_group.where("g <> member").select(F.col("g").alias("a"), F.col("member").alias("b"))
    tried = written(stars.unionByName(alike).distinct())
    links = verified(docs, members, tried, size, percent, text)
    roots = components(links)

    # Second round: groups that share a shingle, or single ones, that have members in different components.
    placed = written(
        in_group.join(roots, in_group["member"] == roots["node"], "left").select("g", "member", F.coalesce("root", "member").alias("root"))
    )
    spans = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    marked = shared.drop("p").join(spans, "g")
    open_ = marked.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("shingle")
    marked = written(marked.join(open_, "shingle"))
    near = (
        marked.alias("x")
        .join(marked.alias("y"), "shingle")
        .where("x.g < y.g AND (x.low <> y.low OR x.high <> y.high OR x.low <> x.high)")
        .where(close("x", "y"))
        .select(F.col("x.g").alias("gx"), F.col("y.g").alias("gy"))
        .distinct()
        # Members of one group share all of its prefix, whether or not a second group has any of it.
        .unionByName(spans.where("low <> high").select(F.col("g").alias("gx"), F.col("g").alias("gy")))
    )
    more = (
        near.join(placed.select(F.col("g").alias("gx"), F.col("member").alias("a"), F.col("root").alias("ra")), "gx")
        .join(placed.select(F.col("g").alias("gy"), F.col("member").alias("b"), F.col("root").alias("rb")), "gy")
        .where("ra <> rb")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    found = verified(docs, members, more, size, percent, text)
    if not found.isEmpty():
        roots = components(links.unionByName(found))
    at = members.select("set_key", "member").join(roots, F.col("member") == F.col("node"), "left")
    at = at.select("set_key", F.coalesce("root", "member").alias("root"))
    best = F.min(F.struct(F.col(f"row.{key}").isNull().alias("no_id"), F.col(f"row.{key}").alias("id"), "text_key"))
    by_set = some.groupBy("set_key").agg(best.alias("best")).join(at, "set_key")
    by_root = by_set.groupBy("root").agg(F.min("best").alias("best"))
    by_set = by_set.select("set_key", "root").join(by_root, "root").select("set_key", "best")
    return lines.join(by_set, "set_key", "left").select(
        "row",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("best").isNull(), F.col(f"row.{key}")).otherwise(F.col("best.id")).alias("component"),
        F.when(F.col("best").isNull(), F.lit(True))
        .otherwise(F.col("best.id").eqNullSafe(F.col(f"row.{key}")) & F.col("best.text_key").eqNullSafe(F.col("text_key")))
        .alias("first"),
    )


def rows_by_mark(docs: DataFrame, marks: np.ndarray, marked: bool, text: str = "text") -> DataFrame:
    """Rows (row, __key) whose text's class is marked, and those without text; or all others."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def scan(batches):
        import xxhash

        for rows, column in batches:
            own = [None if b is None else xxhash.xxh3_128_digest(b) for b in column.to_pylist()]
            some = pa.array([(k is None or _marked(held.value, k)) == marked for k in own], pa.bool_())
            yield rows.filter(some), {"__key": pa.array(own, pa.binary()).filter(some)}

    return map_text(docs, scan, "__key binary", text)


def first_rows(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id and text are a first one in found (see jaccard_groups); of repeated rows one.

    Only texts of which some row goes, or that have no key, are moved: all other rows stay where they are read.
    """
    ids = found.groupBy(F.col(f"row.{key}").alias("__id"), F.col("text_key").alias("__key"))
    ids = written(ids.agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first")))
    marks = _marks(ids.where("__key IS NOT NULL AND (n > 1 OR NOT first)").select("__key"))
    own = rows_by_mark(docs, marks, True, text).withColumn("__id", F.col(f"row.{key}"))
    kept = ids.where("first").select("__id", "__key")
    # Rows with the same id and text are told apart by a number.
    same = Window.partitionBy("__id", "__key").orderBy(F.lit(0))
    hit = own["__id"].eqNullSafe(kept["__id"]) & own["__key"].eqNullSafe(kept["__key"])
    some = own.join(kept, hit, "left_semi").withColumn("__n", F.row_number().over(same)).where("__n = 1")
    return rows_by_mark(docs, marks, False, text).select("row.*").unionByName(some.select("row.*"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles have a similarity of .9 and more."""
    found = jaccard_groups(table(spark, sf_dir, "documents"), 3, 90, keep=["doc_id"])
    return found.select("row.doc_id", "n_shingles", F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), keyed AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM s),
one AS (SELECT k, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS d FROM keyed WHERE n > 0 GROUP BY k),
cells AS (SELECT k, n, unnest(s) AS c FROM one),
common AS (
  SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM cells a JOIN cells b ON a.c = b.c AND a.k < b.k AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * shared >= 90 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k, k AS r FROM one UNION SELECT reach.k, e.b FROM reach JOIN edges e ON reach.r = e.a),
least_id AS (SELECT reach.k, min(d) AS component_id FROM reach JOIN one ON one.k = reach.r GROUP BY reach.k)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id
FROM keyed LEFT JOIN least_id USING (k)
"""
