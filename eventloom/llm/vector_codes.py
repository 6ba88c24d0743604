"""Vector code compression: codebooks for parts of vectors, learned over metric trees.

Each batch of rows becomes, per part position, a tree of balls by the anchors
hierarchy: anchors take the points nearest to them, a new one being the
farthest point of the widest anchor, until there are about as many as the root
of the number of points; they are merged in pairs up to the root, and what is
under each is divided in the same way. A ball holds the sum and the number of
its points. The trees are written once.

In each round the entries of a codebook go down from the root as a list of
candidates. A ball hands to its children only entries that can be the nearest
of some point in it: those whose bisector with the entry nearest to the centre
is not farther away than the radius. A ball with one candidate left gives its
sum and number to that entry as a whole; in leaves, distances are exact whole
numbers. Tasks send one sum per entry, not points.

Vectors that are null or hold null or non-finite components are dropped.
Components are floor(scale * x), kept within +-2 ** 50. Shorter vectors are
filled with zeros up to the longest, and that to a multiple of the number of
parts. Null ids are kept and come last, equal ids are ordered by their vectors,
repeated rows count each. With fewer rows than entries the codebooks have as
many entries as rows; an empty table gives no rows. Errors above 2 ** 63 - 1
are given as that. Extra columns travel in one struct.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Rows in a tree, and points in a ball that is not divided.
TREE_ROWS, LEAF = 4096, 24
#: Up to this size of components, squared distances are exact as floating-point numbers.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component, null for vectors that take no part."""
    cells = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = float(1 << 50)
    inside = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(edge)), F.lit(-edge))).cast("bigint")
    return F.when(sound, F.transform(cells, inside))


# -- trees ----------------------------------------------------------------------


class Ball:
    """Points order[low:high] of a tree, their sum and number, and the balls they are divided into."""

    __slots__ = ("low", "high", "total", "centre", "radius", "parts")

    def __init__(self, points: np.ndarray, low: int, high: int, parts: list[Ball]):
        own = points[low:high]
        self.low, self.high, self.parts = low, high, parts
        self.total = own.sum(axis=0) if not parts else sum(p.total for p in parts)
        self.centre = self.total.astype(np.float64) / (high - low)
        self.radius = float(np.sqrt(((own.astype(np.float64) - self.centre) ** 2).sum(axis=1).max()))


def _anchors(points: np.ndarray, many: int) -> list[np.ndarray]:
    """Which points belong to each of at most `many` anchors."""
    away = lambda at, own: np.sqrt(((points[own] - points[at]) ** 2).sum(axis=1))
    first = np.arange(len(points))
    pivots, owned, far = [0], [first], [away(0, first)]
    while len(pivots) < many:
        widest = max(range(len(pivots)), key=lambda i: far[i].max(initial=0.0))
        if far[widest].max(initial=0.0) == 0:
            break
        pivot = owned[widest][int(far[widest].argmax())]
        taken, distances = [], []
        for i, p in enumerate(pivots):
            # Nearer to the old anchor than half the way to the new one: cannot be nearer to the new one.
            between = float(np.sqrt(((points[pivot] - points[p]) ** 2).sum()))
            maybe = np.flatnonzero(far[i] * 2 >= between)
            if not len(maybe):
                continue
            new = away(pivot, owned[i][maybe])
            goes = new < far[i][maybe]
            taken.append(owned[i][maybe[goes]])
            distances.append(new[goes])
            stays = np.ones(len(far[i]), bool)
            stays[maybe[goes]] = False
            owned[i], far[i] = owned[i][stays], far[i][stays]
        pivots.append(pivot)
        owned.append(np.concatenate(taken))
        far.append(np.concatenate(distances))
    return [o for o in owned if len(o)]


def _nested(points: np.ndarray, own: np.ndarray) -> list | np.ndarray:
    """The points `own` as nested pairs down to leaves."""
    if len(own) <= LEAF:
        return own
    groups = _anchors(points[own], max(2, int(np.sqrt(len(own)))))
    if len(groups) < 2:
        return own
    # Middle out: below the anchors by recursion, above them by merging the pair of the smallest ball.
    nodes = [_nested(points, own[g]) for g in groups]
    centres = np.array([points[own[g]].mean(axis=0) for g in groups])
    radii = np.array([np.sqrt(((points[own[g]] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres)])
    sizes = np.array([len(g) for g in groups], np.float64)
    span = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    cover = (span + radii[:, None] + radii[None]) / 2
    np.fill_diagonal(cover, np.inf)
    alive = len(nodes)
    while alive > 1:
        i, j = sorted(divmod(int(cover.argmin()), len(nodes)))
        nodes[i], nodes[j] = [nodes[i], nodes[j]], None
        weight = sizes[i] + sizes[j]
        centre = (centres[i] * sizes[i] + centres[j] * sizes[j]) / weight
        radii[i] = max(np.linalg.norm(centre - centres[x]) + radii[x] for x in (i, j))
        centres[i], sizes[i] = centre, weight
        cover[j, :] = cover[:, j] = np.inf
        here = (np.sqrt(((centres - centre) ** 2).sum(axis=1)) + radii + radii[i]) / 2
        open_ = np.isfinite(cover[i])
        cover[i, open_] = cover[open_, i] = here[open_]
        alive -= 1
    return next(n for n in nodes if n is not None)


def tree_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, Ball]:
    """(order, points in that order, root) of whole-numbered points."""
    nested = _nested(points.astype(np.float64), np.arange(len(points)))
    order: list[np.ndarray] = []
    leaves = lambda n: [n] if isinstance(n, np.ndarray) else leaves(n[0]) + leaves(n[1])
    order = np.concatenate(leaves(nested))
    points = points[order]

    def ball(node, low: int) -> Ball:
        if isinstance(node, np.ndarray):
            return Ball(points, low, low + len(node), [])
        left = ball(node[0], low)
        right = ball(node[1], left.high)
        return Ball(points, low, right.high, [left, right])

    return order, points, ball(nested, 0)


class Codebook:
    """The entries of one part position, with what the search needs of them."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.place = entries, entries.astype(np.float64)
        # Of equal entries only the first can be chosen.
        self.all = np.sort(np.unique(entries, axis=0, return_index=True)[1]) if len(entries) else np.zeros(0, np.int64)


def owners(points: np.ndarray, root: Ball, book: Codebook) -> Iterator[tuple[Ball, int | np.ndarray]]:
    """Balls that part the points, each with its only entry, or with the entry of each point."""
    width = points.shape[1]
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(book.entries).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(width, 1) < EXACT else object
    entries = book.entries.astype(kind)
    norms = (entries * entries).sum(axis=1)
    values = points.astype(kind)
    # What floating-point distances may be off by, relative to the squared extent.
    slack = 1e-9 * (1.0 + float(top) ** 2 * max(width, 1) * 4)
    open_ = [(root, book.all)]
    while open_:
        ball, those = open_.pop()
        own = book.place[those]
        away = ((own - ball.centre) ** 2).sum(axis=1)
        best = int(away.argmin())
        between = np.sqrt(((own - own[best]) ** 2).sum(axis=1))
        those = those[away - away[best] <= 2 * (ball.radius * (1 + 1e-9)) * between + slack]
        if len(those) == 1:
            yield ball, int(those[0])
        elif ball.parts:
            open_ += [(part, those) for part in ball.parts]
        else:
            # Without the points' own norms, which are the same for every entry; the first of equal ones is the lowest.
            score = norms[those][None] - 2 * (values[ball.low : ball.high] @ entries[those].T)
            yield ball, those[np.argmin(score, axis=1)]


# -- rounds ---------------------------------------------------------------------


def trees_of(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """(rows, trees) of batches of rows (row, cells): a pickled tree per part position, made here and read only here."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                matrix = np.zeros((part.num_rows, width), np.int64)
                cells = part.column("cells")
                many = np.diff(cells.offsets.to_numpy())
                flat = cells.flatten().to_numpy(zero_copy_only=False)
                line = np.repeat(np.arange(len(many)), many)
                matrix[line, np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
                trees = [pickle.dumps(tree_of(matrix[:, i * step : (i + 1) * step])) for i in range(parts)]
                offsets = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(offsets, part.column("row")), pa.array([trees], pa.list_(pa.binary()))], names=["rows", "trees"]
                )

    return rows.select("row", "cells").mapInArrow(run, schema)


def _sums(trees: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The next codebooks: floor of the mean of each entry's parts; unused entries stay."""
    spark = trees.sparkSession
    held = spark.sparkContext.broadcast([Codebook(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole numbers of any size: a task's sums of many large components may pass 64 bits.
        total = [[[0] * b.entries.shape[1] for _ in b.entries] for b in held.value]
        count = [[0] * len(b.entries) for b in held.value]
        for batch in batches:
            for blobs in batch.column("trees"):
                for i, blob in enumerate(blobs):
                    _, points, root = pickle.loads(blob.as_py())
                    for ball, entry in owners(points, root, held.value[i]):
                        groups = [(entry, ball.total, ball.high - ball.low)] if isinstance(entry, int) else [
                            (int(e), points[ball.low : ball.high][entry == e].sum(axis=0), int((entry == e).sum())) for e in np.unique(entry)
                        ]
                        for e, add, many in groups:
                            total[i][e] = [a + b for a, b in zip(total[i][e], add.tolist())]
                            count[i][e] += many
        rows = [(i, e, n, c, s) for i, own in enumerate(count) for e, c in enumerate(own) if c for n, s in enumerate(total[i][e])]
        columns = list(zip(*rows)) if rows else [[]] * 5
        columns[4] = [str(s) for s in columns[4]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "entry", "n", "many", "total"])

    found = trees.select("trees").mapInArrow(run, "part int, entry int, n int, many bigint, total string")
    # Decimals add up exactly; at most entries x width rows come to the driver.
    added = found.groupBy("part", "entry", "n").agg(F.sum("many").alias("many"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.copy() for b in books]
    for r in added.collect():
        out[r["part"]][r["entry"], r["n"]] = int(r["total"]) // r["many"]
    held.destroy()
    return out


def learn(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None,
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(trees, codebooks): the written trees and, per part position, the entries after all rounds."""
    keep = vectors.columns if keep is None else keep
    rows = vectors.select(F.struct(*[vectors[c] for c in keep]).alias("row"), vectors[vec_id].alias("id"), quantised(vectors[vector], scale).alias("cells"))
    rows = rows.where("cells IS NOT NULL")
    longest = rows.agg(F.max(F.size("cells"))).head()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    first = [r["cells"] for r in rows.select("id", "cells").orderBy(F.asc_nulls_last("id"), "cells").limit(entries).collect()]
    start = np.zeros((len(first), width), np.int64)
    for i, cells in enumerate(first):
        start[i, : len(cells)] = cells
    step = width // parts
    books = [start[:, i * step : (i + 1) * step].copy() for i in range(parts)]
    trees = written(trees_of(rows, width, parts))
    for _ in range(rounds):
        books = _sums(trees, books, parts)
    return trees, books


def encode(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, codes (an entry per part), error (squared distance over all parts) of every vector of the trees."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", trees.schema["rows"].dataType.elementType),
                           T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    held = trees.sparkSession.sparkContext.broadcast([Codebook(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows, blobs = batch.column("rows")[at].values, batch.column("trees")[at]
                codes = np.zeros((len(rows), len(blobs)), np.int32)
                error = np.zeros(len(rows), object)
                for i, blob in enumerate(blobs):
                    order, points, root = pickle.loads(blob.as_py())
                    found = np.zeros(len(points), np.int64)
                    for ball, entry in owners(points, root, held.value[i]):
                        found[ball.low : ball.high] = entry
                    off = points.astype(object) - held.value[i].entries[found].astype(object)
                    codes[order, i] = found
                    error[order] += (off * off).sum(axis=1)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(blobs))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1))), pa.array([min(e, LARGEST) for e in error], pa.int64())],
                    names=["row", "codes", "error"],
                )

    return trees.mapInArrow(run, schema)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error, the error of its label, and a digest of the codebooks."""
    trees, books = learn(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    text = ",".join(str(x) for b in books for x in b.reshape(-1).tolist())
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    found = written(encode(trees, books).select("row.*", digits.alias("code"), "error"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("bigint")
    by_label = found.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("__label"))
    digest = F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    return found.join(by_label, same).select("vec_id", "code", "error", "label_error", digest)


def _oracle() -> str:
    """The rounds written out: distances of all parts to all entries, the least by (distance, index)."""
    steps = [
        """k AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT (max(len(v)) + 3) // 4 AS step FROM k),
p AS MATERIALIZED (SELECT row, part, list_transform(range(part * step, part * step + step), lambda i: coalesce(v[i + 1], 0.0)) AS x
  FROM k, w, range(4) AS parts(part)),
e0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM k) USING (row) WHERE entry < 256)"""
    ]
    for n in range(5):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT row, part, min({{'d': list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c), 'e': entry}}) AS best
  FROM p JOIN e{n} USING (part) GROUP BY row, part)"""
        )
        if n < 4:
            steps.append(
                f"""e{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM e{n} LEFT JOIN (
  SELECT part, entry, list(m ORDER BY n) AS m FROM (
    SELECT part, a.best.e AS entry, n, floor(sum(x[n + 1]) / count(*)) AS m FROM a{n} a JOIN p USING (row, part), w, range(w.step) AS cells(n) GROUP BY part, a.best.e, n
  ) GROUP BY part, entry) USING (part, entry))"""
            )
    steps.append(
        """r AS (SELECT row, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY row),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e4)"""
    )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (row), s"""


ORACLE = _oracle()
