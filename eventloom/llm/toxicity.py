"""Toxicity: two Kneser-Ney models of letters, of toxic and of ordinary texts, with shared backoff.

A word's letters follow one another up to ORDER - 1 letters back, from a mark
for its beginning to one for its end. In each class a letter's chance comes from
the class's counts after the same letters, discounted; what the discount frees
goes to the Kneser-Ney chance over shorter contexts that both classes share. So
expressions too rare to be counted in one class are as likely in either, and
built ones are known by their beginnings. A text's two log-likelihoods are
compared per word; a logistic curve fitted on other sampled rows makes the
difference a score. It also gets what single words add above a few nats, since
a few words make a long text toxic; the curve is fitted out of fold.

Learned from a bounded sample of labelled rows (SAMPLE of each class, equal
texts once). Null and wordless texts have no evidence: they get the share of
toxic texts among such. Without rows of both classes every score is 0.
Repeated rows are separate rows. Whole texts are read.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table, written
from .language import remainder

ORDER = 6
DISCOUNT = 0.75
#: Labelled rows of each class that are learned from, about.
SAMPLE = 2_500
FOLDS = 3
#: Characters of a sampled row that are learned from at most, from several places.
SAMPLE_CHARS = 20_000
#: Words whose difference a worker keeps.
KEPT_WORDS = 400_000

#: Bytes to what they count as: letters, digits and all that is not ASCII in words, the rest between them.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(_FOLD).split()


class Model(NamedTuple):
    """ln of the toxic chance over the ordinary one."""

    letters: dict[str, float]  # of contexts with a letter that some class has seen
    contexts: dict[str, float]  # of any other letter after a context that some class has seen
    curve: np.ndarray


def _spelled(word: bytes) -> str:
    return "\x02" + word.decode("utf-8", "replace") + "\x03"


def _steps(word: bytes):
    """(context, letter) of every letter of a word but the first mark."""
    s = _spelled(word)
    return ((s[max(0, i - ORDER + 1) : i], s[i]) for i in range(1, len(s)))


def count_class(counts: Counter) -> tuple[dict, dict]:
    """Counts of context with letter, and (letters seen, different ones) of each context."""
    grams: Counter = Counter()
    for word, n in counts.items():
        for context, letter in _steps(word):
            grams[context, letter] += n
    totals: dict = {}
    for (context, _), n in grams.items():
        seen, kinds = totals.get(context, (0, 0))
        totals[context] = (seen + n, kinds + 1)
    return dict(grams), totals


def shared_backoff(classes: list[dict]) -> dict:
    """Kneser-Ney chances below the longest contexts, from both classes' different predecessors.

    Below the longest context, (context, letter) counts how many letters come
    before it; a context that starts a word has no predecessor and keeps 1.
    """
    level = {g for one in classes for g in one}
    below: dict[int, Counter] = {n: Counter() for n in range(ORDER)}
    seen = set(level)
    for context, letter in level:
        while context:
            shorter = (context[1:], letter)
            below[len(context) - 1][shorter] += 1
            if shorter in seen:
                break
            seen.add(shorter)
            context = context[1:]
    return below


def _chances(below: dict[int, Counter]) -> dict:
    """Interpolated chances, from the empty context upwards; contexts hold the share that is left to shorter ones."""
    out: dict = {}
    letters = below[0]
    total = sum(letters.values()) or 1
    for (_, letter), n in letters.items():
        out["", letter] = n / total
    for size in range(1, ORDER - 1):
        totals: dict = {}
        for (context, _), n in below[size].items():
            seen, kinds = totals.get(context, (0, 0))
            totals[context] = (seen + n, kinds + 1)
        for context, (seen, kinds) in totals.items():
            out[context] = DISCOUNT * kinds / seen
        for (context, letter), n in below[size].items():
            seen, _ = totals[context]
            out[context, letter] = (n - DISCOUNT) / seen + out[context] * chance(out, context[1:], letter)
    return out


def chance(shared: dict, context: str, letter: str) -> float:
    """The shared chance of a letter after a context, backing off over contexts that were never seen."""
    share = 1.0
    while True:
        found = shared.get((context, letter))
        if found is not None:
            return share * found
        if not context:
            return share * 1e-6
        share *= shared.get(context, 1.0)
        context = context[1:]


def compare(classes: list[tuple[dict, dict]], shared: dict) -> tuple[dict[str, float], dict[str, float]]:
    """Logarithms of the first class's chances over the second's, of seen letters and of freed shares.

    The chance of a letter that a class has not seen after a context is the
    share that its discount frees times the shared chance, which both have.
    """
    freed = [{c: DISCOUNT * kinds / seen for c, (seen, kinds) in totals.items()} for _, totals in classes]
    contexts = {c: math.log(freed[0].get(c, 1.0) / freed[1].get(c, 1.0)) for c in {*freed[0], *freed[1]}}
    letters = {}
    for context, letter in {*classes[0][0], *classes[1][0]}:
        low = chance(shared, context[1:], letter)
        p = []
        for (counts, totals), free in zip(classes, freed, strict=True):
            seen = totals[context][0] if context in totals else 1
            p.append(max(counts.get((context, letter), 0) - DISCOUNT, 0.0) / seen + free.get(context, 1.0) * low)
        letters[context + letter] = math.log(max(p[0], 1e-12) / max(p[1], 1e-12))
    return letters, contexts


def difference(model: Model, word: bytes) -> float:
    """ln of the word's chance in the toxic class over that in the ordinary one."""
    total, s = 0.0, _spelled(word)
    for i in range(1, len(s)):
        at = max(0, i - ORDER + 1)
        found = model.letters.get(s[at : i + 1])
        total += model.contexts.get(s[at:i], 0.0) if found is None else found
    return total


class Differences(dict):
    """difference by word, of at most KEPT_WORDS words at a time."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = difference(self.model, word)
        return found


def evidence(known: Differences, body: bytes | None) -> list[float]:
    """Per word: the difference, what single words have above one nat and above three; the last also per root."""
    own = words(body)
    if not own:
        return [0.0, 0.0, 0.0, 0.0, 1.0]
    v, n = np.fromiter(map(known.__getitem__, own), float, len(own)), len(own)
    high = float(np.maximum(v - 3, 0).sum())
    return [float(v.mean()), 10 * float(np.maximum(v - 1, 0).mean()), 10 * high / n, high / math.sqrt(n), 0.0]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps, lightly drawn to 0; the last is the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _model(counts: dict[int, Counter]) -> Model:
    classes = [count_class(counts[y]) for y in (1, 0)]
    shared = _chances(shared_backoff([c for c, _ in classes]))
    return Model(*compare(classes, shared), np.zeros(6))


def train(rows: list[tuple[bytes, int]], weights: tuple[float, float]) -> Model | None:
    """rows: texts and labels in a fixed order; weights: how many rows one of each class stands for.

    The curve is fitted on evidence from models that have not seen the row's fold.
    """
    if len({y for _, y in rows}) < 2:
        return None
    seen = [{1: Counter(), 0: Counter()} for _ in range(FOLDS)]
    for i, (body, y) in enumerate(rows):
        seen[i % FOLDS][y].update(words(body))
    x = np.empty((len(rows), 5))
    for fold in range(FOLDS):
        others = {y: sum((seen[f][y] for f in range(FOLDS) if f != fold), Counter()) for y in (1, 0)}
        known = Differences(_model(others))
        for i in range(fold, len(rows), FOLDS):
            x[i] = evidence(known, rows[i][0])
    y = np.array([label for _, label in rows], float)
    curve = fit_curve(x, y, np.where(y == 1, weights[1], weights[0]))
    return _model({y: sum((s[y] for s in seen), Counter()) for y in (1, 0)})._replace(curve=curve)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | None:
    """A model of the labelled rows where learn (of the key) holds; None without both classes."""
    marked = (
        labels.select(labels[key].alias("key"), labels[toxic].alias("toxic"))
        .where("key IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("key")
        .agg(F.max("toxic").alias("toxic"))
    )
    use = docs.where(learn).select(docs[key].alias("key"))
    n = {r["toxic"]: r["count"] for r in marked.join(use, "key", "left_semi").groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    # A hash below this takes part: all rows of a rare class, a share of a common one.
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / n[1])).otherwise(min(1.0, SAMPLE / n[0]))
    chosen = marked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20))
    size = F.length("text")
    third = SAMPLE_CHARS // 3
    body = F.when(size <= SAMPLE_CHARS, F.col("text")).otherwise(
        F.concat_ws(" ", *[F.substring("text", (size - third) / 2 * i + 1, F.lit(third)) for i in range(3)])
    )
    rows = (
        docs.where(learn)
        .select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
        # Some SAMPLE rows of each class: small enough for every worker, while the texts would fill the disks.
        .join(F.broadcast(written(chosen)), "key")
        .select(F.xxhash64("text").alias("h"), body.alias("text"), "toxic")
        .groupBy("h")
        .agg(F.min(F.struct("toxic", "text")).alias("one"))
        .select("h", "one.*")
        .collect()
    )
    rows.sort(key=lambda r: r["h"])
    got = Counter(r["toxic"] for r in rows)
    total = len(rows) / (n[0] + n[1])
    return train(
        [(r["text"].encode(), r["toxic"]) for r in rows],
        (total * n[0] / max(1, got[0]), total * n[1] / max(1, got[1])),
    )


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (row, per_word, score): the difference per word and the chance that a text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = held.value
        known = Differences(m) if m else None
        for rows, column in batches:
            x = np.array([evidence(known, b) if m else [0.0] * 5 for b in column.to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ m.curve, -30, 30))) if m else np.zeros(len(x))
            yield rows, {"per_word": x[:, 0], "score": p}

    return map_text(docs, scan, "per_word double, score double", text, keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return score(docs, model, keep=["doc_id"]).select(
        "row.doc_id",
        (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "per_word",
    )
