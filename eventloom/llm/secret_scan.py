"""Secret scans: three patterns, and a battery of randomness tests on what else looks like a key.

Base spans are the matches of three kinds: `assign` (a name such as password,
a sign, a value of 12 and more characters), `access` (AKIA and letters or
digits, 18 and more in all) and `hex` (16 and more of 0-9a-f).

The battery adds spans of kind `random`: runs of 20 and more characters of
base64's alphabets, and of their parts of 20 and more: between `=` that is not
padding, between `/`, `-`, `_` and `+`, and what is left between plain words at
those signs. Every part counts as a run. The encoding (hexadecimal, base32,
base62, base64, base64url) is inferred from the characters. Under it, chi-squared uniformity of the
alphabet, runs about the median and serial correlation must all be what chance
gives (Bonferroni, level CHANCE). How far a run is from ordinary writing is the
binomial tail of its changes between lower case, capitals, digits and signs.
These p-values pass Benjamini-Hochberg control at level FALSE_RATE within
classes of equal length (powers of two), over the runs of the whole table.

Null texts are empty. A text without finds has no spans. Added spans that touch
a base span are left out, and of those that overlap the longest stays. Repeated rows are separate rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, small, table

# Fixed patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api")

KINDS = ["assign", "access", "hex", "random"]
LEAST_RUN = 20
#: A run's fields with the signs after them, what they are cut into, and pieces that are plain words or numbers.
FIELD = re.compile(rb"[^=]+=*")
PIECES = [re.compile(rb"[^/]+"), re.compile(rb"[^_-]+"), re.compile(rb"[^/+_-]+")]
PLAIN = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}")
LEAST_CHANGES = 4
#: How often ordinary writing changes between kinds of characters inside a run.
CHANGE_RATE = 0.12
CHANCE = 0.01
FALSE_RATE = 1e-3
#: -log10 of p-values is counted in bins of a tenth, up to this many.
BINS = 400
#: Bytes looked at together.
SLAB = 4 << 20

_SPANS = "spans array<struct<start:int,end:int,kind:int>>"

#: Kinds of bytes: 0 none, 1 lower case, 2 capitals, 3 digits, 4 signs of base64.
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in "+/_=-"]] = 4
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}


def inferred(run: bytes) -> str | None:
    """The narrowest encoding that has all characters of the run; padding does not count."""
    used = set(run.rstrip(b"=").decode())
    if used <= set(_DIGITS):
        return None
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: bytes, encoding: str) -> float:
    """The least p-value, times three, of the tests of uniformity, runs and serial correlation."""
    alphabet = ENCODINGS[encoding]
    place = {ord(c): i for i, c in enumerate(alphabet)}
    x = np.array([place[b] for b in run.rstrip(b"=")], float)
    n, size = len(x), len(alphabet)
    bins = min(size, max(2, n // 5))
    width = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    seen = np.bincount((x * bins // size).astype(int), minlength=bins)
    chi, free = float(((seen - n * width) ** 2 / (n * width)).sum()), bins - 1
    # Wilson and Hilferty: the cube root of chi-squared is nearly normal.
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    p_uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = x >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        spread = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = _normal_tail((runs - mean) / math.sqrt(spread))
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - x.mean()
    total = float((y * y).sum())
    p_serial = _normal_tail((float((y[1:] * y[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial))


@lru_cache(1 << 16)
def writing_bin(n: int, changes: int) -> int:
    """Tenths of -log10 of the chance that ordinary writing has so many changes in n characters."""
    logs = [
        math.lgamma(n) - math.lgamma(k + 1) - math.lgamma(n - k)
        + k * math.log(CHANGE_RATE) + (n - 1 - k) * math.log(1 - CHANGE_RATE)
        for k in range(changes, min(n, changes + 200))
    ]
    top = max(logs)
    tail = top + math.log(sum(math.exp(v - top) for v in logs))
    return max(0, min(BINS - 1, int(-tail / math.log(10) * 10)))


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.concatenate((edges, [len(mask)]))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _slabs(bodies: list[bytes | None]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts joined by line feeds, some megabytes at a time: number of the first, bytes, where each starts."""
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (end == at or size < SLAB):
            size += len(bodies[end] or b"") + 1
            end += 1
        part = [b or b"" for b in bodies[at:end]]
        starts = np.concatenate(([0], np.cumsum([len(b) + 1 for b in part])))
        yield at, b"\n".join(part) + b"\n", starts
        at = end


def parts_of(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of the long parts of a run that may be a key beside a name, a sign or a path."""
    found = set()
    for field in FIELD.finditer(run):
        # Only signs at the run's end are padding.
        first, body = field.start(), field[0] if field.end() == len(run) else field[0].rstrip(b"=")
        found.add((first, first + len(body)))
        for pieces in PIECES:
            found.update((first + m.start(), first + m.end()) for m in pieces.finditer(body))
        start = end = None
        for m in PIECES[-1].finditer(body):
            if PLAIN.fullmatch(m[0]):
                if start is not None:
                    found.add((first + start, first + end))
                start = None
            else:
                start, end = m.start() if start is None else start, m.end()
        if start is not None:
            found.add((first + start, first + end))
    found.discard((0, len(run)))
    return sorted(v for v in found if v[1] - v[0] >= LEAST_RUN)


def _key_like(slab: bytes, raw: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(start, end, class of length, bin) of runs and parts that the battery lets pass; how many each class has."""
    kind = _KIND[raw]
    starts, ends = _runs(kind > 0, LEAST_RUN)
    signs = np.flatnonzero(kind == 4)
    signed = np.flatnonzero(np.searchsorted(signs, ends) > np.searchsorted(signs, starts))
    parts = [(int(starts[i]) + a, int(starts[i]) + b) for i in signed for a, b in parts_of(slab[starts[i] : ends[i]])]
    if parts:
        more = np.array(parts)
        starts, ends = np.concatenate((starts, more[:, 0])), np.concatenate((ends, more[:, 1]))
    sizes = ends - starts
    classes = np.bincount(np.log2(sizes).astype(int), minlength=64) if len(sizes) else np.zeros(64, int)
    turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    changes = np.searchsorted(turns, ends) - np.searchsorted(turns, starts, side="right")
    found = []
    for i in np.flatnonzero(changes >= LEAST_CHANGES):
        run = slab[starts[i] : ends[i]]
        if (encoding := inferred(run)) and battery(run, encoding) >= CHANCE:
            n = int(sizes[i])
            found.append((int(starts[i]), int(ends[i]), n.bit_length() - 1, writing_bin(n, int(changes[i]))))
    return found, classes


def count_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(length_class, bin, n): runs that passed the battery by bin, and all runs under bin -1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((64, BINS + 1), np.int64)
        for batch in small(batches):
            for _, slab, _ in _slabs(batch.column(0).to_pylist()):
                found, classes = _key_like(slab, np.frombuffer(slab, np.uint8))
                counts[:, 0] += classes
                for _, _, size, at in found:
                    counts[size, at + 1] += 1
        size, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"length_class": size.astype(np.int32), "bin": at.astype(np.int32) - 1, "n": counts[size, at]}
        )

    return (
        docs.select(docs[text].cast("binary").alias("body"))
        .mapInArrow(scan, "length_class int, bin int, n bigint")
        .groupBy("length_class", "bin")
        .agg(F.sum("n").alias("n"))
    )


def thresholds(counts: pd.DataFrame, false_rate: float = FALSE_RATE) -> dict[int, int]:
    """For each class of length the least bin that Benjamini-Hochberg control rejects ordinary writing at."""
    least = {}
    for size, own in counts.groupby("length_class"):
        total = own.loc[own["bin"] < 0, "n"].sum()
        rank = 0
        for at, n in sorted(zip(own["bin"], own["n"], strict=True), reverse=True):
            rank += n
            if at >= 0 and 10 ** (-at / 10) <= false_rate * rank / max(total, rank):
                least[int(size)] = int(at)
    return least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns, by start and kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda v: (v[0], v[2]))


def _may_have_base(slab: bytes, raw: np.ndarray, starts: np.ndarray) -> set[int]:
    """Numbers of the texts in a slab that hold a name, AKIA or a long run of 0-9a-f."""
    places = [*_runs(_HEX[raw], 16)[0]]
    lower = slab.lower()
    for word, line in ((b"AKIA", slab), *((n, lower) for n in NAMES)):
        at = line.find(word)
        while at >= 0:
            places.append(at)
            at = line.find(word, at + 1)
    return set((np.searchsorted(starts, places, side="right") - 1).tolist()) if places else set()


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (row, spans): the spans of every text in code points, by start and kind (a number into KINDS).

    Reads the texts twice: first the p-values of the whole table are counted, at most 64 * 401 rows.
    """
    least = thresholds(count_runs(docs, text).toPandas())

    def scan(batches):
        for rows, column in batches:
            bodies = column.to_pylist()
            out: list[list] = [[] for _ in bodies]
            for first, slab, starts in _slabs(bodies):
                raw = np.frombuffer(slab, np.uint8)
                for i in _may_have_base(slab, raw, starts):
                    out[first + i] = base_spans(bodies[first + i].decode())
                own: dict[int, list] = {}
                for s, e, size, at in _key_like(slab, raw)[0]:
                    if at >= least.get(size, BINS):
                        own.setdefault(int(np.searchsorted(starts, s, side="right")) - 1, []).append((s, e))
                for i, runs in own.items():
                    body = raw[starts[i] : starts[i + 1] - 1]
                    points = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
                    # Longest first: a part only counts where the whole run does not.
                    for s, e in sorted(runs, key=lambda v: (v[0] - v[1], v[0])):
                        a, b = int(points[s - starts[i]]), int(points[e - starts[i]])
                        if all(b <= x or y <= a for x, y, _ in out[first + i]):
                            out[first + i] = [*out[first + i], (a, b, 3)]
                    out[first + i] = sorted(out[first + i], key=lambda v: (v[0], v[2], v[1]))
            yield rows, {"spans": [[{"start": s, "end": e, "kind": k} for s, e, k in one] for one in out]}

    return map_text(docs, scan, _SPANS, text, keep)


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with the spans, united where they overlap, replaced by a mark."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["pieces"], fresh).alias("pieces"))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "row.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
