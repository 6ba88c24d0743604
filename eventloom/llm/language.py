"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text's features are its byte n-grams of one to four bytes, ASCII in lower
case and runs of other ASCII than letters as one blank, hashed into a table.
Their embeddings are averaged and a linear layer gives the languages' logits.
Both are trained by stochastic gradient descent in numpy, on passages of a
bounded sample of labelled documents. The whole texts of another part of the
sample calibrate a temperature and the rejection: texts are refused below the
confidence under which at least MAX_ERROR of them, LEAST_ERRORS at least, were
taken for another language.

Texts that are null or have no letter get `und`, score 0, and are rejected; so
do all texts if there is nothing to learn from. Whole texts are read. Documents
without a language teach nothing. Ties go to the first language in order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

UNKNOWN = "und"
#: About so many labelled documents of each language are learned from, as PASSAGES passages each.
SAMPLE_PER_LANG = 1_200
PASSAGES, PASSAGE_CHARS = 3, 240
#: Languages with the most documents that are told apart.
MAX_LANGS = 500
BUCKET_BITS, WIDTH, ORDERS = 17, 16, 4
EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 250, 64, 20.0
MAX_ERROR, LEAST_ERRORS = 0.5, 5
#: Bytes looked at together.
SLAB = 1 << 20

#: Bytes to what they count as.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


_NOT_LETTERS = bytes(b for b in range(0x80) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


def has_letter(body: bytes) -> bool:
    rest = body.translate(None, _NOT_LETTERS)
    return min(rest, default=255) < 0x80 or any(c.isalpha() for c in rest.decode())


class Model(NamedTuple):
    langs: list[str]
    logits: np.ndarray  # of each bucket, embeddings times layer
    bias: np.ndarray
    temperature: float
    least: float


def normal(body: bytes) -> bytes:
    return b" " + b" ".join(body.translate(_FOLD).split()) + b" "


def grams(line: bytes, starts: np.ndarray | tuple = ()) -> np.ndarray:
    """Buckets of all n-grams that end at each byte, shape (ORDERS, bytes); before a start there is nothing.

    starts: where texts begin that stand behind one another, ORDERS - 1 bytes apart.
    """
    x = np.frombuffer(line, np.uint8).astype(np.uint32) + np.uint32(1)
    for gap in range(1, ORDERS):
        x[[at - gap for at in starts if at]] = 0
    out = np.empty((ORDERS, len(x)), np.int32)
    h = np.zeros(len(x), np.uint32)
    for n in range(ORDERS):
        back = np.zeros(len(x), np.uint32)
        back[n:] = x[: len(x) - n]
        h = (h + back) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[n] = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(passages: list[tuple[bytes, int]], langs: list[str], seed: int = 1) -> Model:
    """Gradient descent over passages: pairs of text and number of its language."""
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    features = [grams(normal(body)).ravel() for body, _ in passages]
    labels = np.array([y for _, y in passages], int)
    batches = max(1, -(-len(passages) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(passages))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            sizes = np.array([len(features[i]) for i in own])
            ids = np.concatenate([features[i] for i in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(table_[ids], starts, axis=0) / sizes[:, None]
            wrong = _softmax(mean @ layer + bias)
            wrong[np.arange(len(own)), labels[own]] -= 1
            wrong /= len(own)
            back = ((wrong @ layer.T) / sizes[:, None]).astype(np.float32)
            layer -= (rate * 0.1 * mean.T @ wrong).astype(np.float32)
            bias -= (0.01 * rate * wrong.sum(axis=0)).astype(np.float32)
            np.subtract.at(table_, ids, np.repeat(rate * back * WIDTH, sizes, axis=0))
    return Model(langs, (table_ @ layer).astype(np.float32), bias, 1.0, 0.0)


def calibrated(model: Model, z: np.ndarray, truth: np.ndarray) -> Model:
    """The model with the temperature and the refusal that suit logits of texts whose languages are known."""
    if not len(z):
        return model
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 8, 21)}
    temperature = min(loss, key=loss.get)
    p = _softmax(z / temperature)
    top = p.max(axis=1)
    order = np.argsort(top, kind="stable")
    errors = np.cumsum(p.argmax(axis=1)[order] != truth[order])
    wrong = np.flatnonzero((errors >= MAX_ERROR * np.arange(1, len(order) + 1)) & (errors >= LEAST_ERRORS))
    # Nothing is refused if even the least sure ones are mostly right.
    least = float(np.nextafter(top[order][wrong[-1]], 2)) if len(wrong) else 0.0
    return model._replace(temperature=float(temperature), least=least)


def _logits(model: Model, lines: list[bytes]) -> np.ndarray:
    """Logits of several texts, a slab of pieces of them at a time."""
    sums = np.zeros((len(lines), len(model.langs)))
    own, parts, skips, size = [], [], [], 0

    def add() -> None:
        starts = np.cumsum([0, *(len(x) + ORDERS - 1 for x in parts)])[:-1]
        ids = grams(bytes(ORDERS - 1).join(parts), starts.tolist())
        each = np.zeros((ids.shape[1] + 1, len(model.langs)), np.float32)
        for n in range(ORDERS):
            each[:-1] += model.logits[ids[n]]
        # Every other sum is of a gap or of bytes that only give a piece its context.
        bounds = np.column_stack((starts + skips, starts + [len(x) for x in parts])).ravel()
        np.add.at(sums, own, np.add.reduceat(each, bounds, axis=0, dtype=np.float64)[::2])
        own.clear(), parts.clear(), skips.clear()

    piece = max(1 << 12, (SLAB >> 2) // max(1, len(model.langs) // 8))
    for i, line in enumerate(lines):
        for at in range(0, len(line), piece):
            before = max(0, at - ORDERS + 1)
            own.append(i), parts.append(line[before : at + piece]), skips.append(at - before)
            size += len(parts[-1])
            if size >= 4 * piece:
                add()
                size = 0
    if parts:
        add()
    return sums / (ORDERS * np.array([len(x) for x in lines])[:, None]) + model.bias


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of the rows where learn holds; None without any. The sample's share of a language is found by counting."""
    labelled = docs.select(docs[text].alias("text"), docs[lang].alias("lang"), F.xxhash64(docs[key], docs[text]).alias("h"), learn.alias("use")).where(
        "use AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'"
    )
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    # A hash below this takes part: all rows of a small language, a share of a large one.
    shares = {r["lang"]: min(1.0, SAMPLE_PER_LANG / r["count"]) for r in counts}
    limit = F.create_map(*[F.lit(v) for k, share in shares.items() for v in (k, int(share * (1 << 30)))])
    size = F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(0))
    passages = F.array(*[
        F.substring(F.col("text"), (size * at / max(1, PASSAGES - 1)).cast("int") + 1, F.lit(PASSAGE_CHARS)) for at in range(PASSAGES)
    ])
    chosen = labelled.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(limit, "lang"))
    # Most of the sample teaches; whole texts of the rest calibrate.
    teaches = F.pmod(F.shiftright("h", 30), F.lit(5)) > 0
    rows = chosen.where(teaches).select("h", "lang", F.array_distinct(passages).alias("passages")).collect()
    number = {x: i for i, x in enumerate(langs)}
    rows.sort(key=lambda r: r["h"])
    model = train([(p.encode(), number[r["lang"]]) for r in rows for p in r["passages"]], langs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for kept, column in batches:
            yield kept, {"z": _logits(held.value, [normal(b) for b in column.to_pylist()]).tolist()}

    known = map_text(chosen.where(~teaches), scan, "z array<double>", "text", ["lang"]).collect()
    return calibrated(model, np.array([r["z"] for r in known]), np.array([number[r["row"]["lang"]] for r in known], int))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (row, lang_pred, score, rejected) for every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = held.value
        for rows, column in batches:
            bodies = column.to_pylist()
            has = [i for i, b in enumerate(bodies) if b and m and has_letter(b)]
            pred, score, out = [UNKNOWN] * len(bodies), [0.0] * len(bodies), [True] * len(bodies)
            if has:
                p = _softmax(_logits(m, [normal(bodies[i]) for i in has]) / m.temperature)
                for i, best, top in zip(has, p.argmax(axis=1), p.max(axis=1), strict=True):
                    pred[i], score[i], out[i] = m.langs[best], float(top), bool(top < m.least)
            yield rows, {"lang_pred": pred, "score": score, "rejected": out}

    return map_text(docs, scan, "lang_pred string, score double, rejected boolean", text, keep)


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo of; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder(F.col("doc_id"), 3) != 1)
    return identify(docs, model, keep=["doc_id"]).select(
        "row.doc_id", (remainder(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )
