import random

from eventloom.llm import language, toxicity
from eventloom.llm.common import table

from .conftest import RUDE, words


def test_language_of_held_out_texts(spark, tables):
    docs = {r["doc_id"]: (r["lang"], r["text"]) for r in table(spark, tables[0], "documents").collect()}
    got = {r["doc_id"]: r for r in language.op10_language_id(spark, tables[0]).collect()}
    assert len(got) == len(docs)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (200, 201, 202))
    held = [i for i in got if got[i]["held_out"] and i is not None and i < 160]
    assert sum(got[i]["lang_pred"] == docs[i][0] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_rows(spark, tables):
    assert language.op10_language_id(spark, tables[1]).count() == 0
    docs = table(spark, tables[0], "documents")
    out = language.identify(docs, language.fit(table(spark, tables[1], "documents"), language.F.lit(True)))
    assert out.where("lang_pred <> 'und' OR NOT rejected").count() == 0 and out.count() == docs.count()


def test_long_texts_are_read_whole():
    model = language.train([(b"aaaa", 0), (b"bbbb", 1)] * 40, ["a", "b"])
    ends = [language.normal(b"aaaa " * 30_000), language.normal(b"aaaa " * 10_000 + b"bbbb " * 20_000), language.normal(b"bb")]
    z = language._logits(model, ends)
    assert z[:, 1].argmax() == 2 or z[1].argmax() == 1
    alone = [language._logits(model, [x])[0] for x in ends]
    assert all(abs(a - b).max() < 1e-4 for a, b in zip(alone, z, strict=True))
    g = language.grams(ends[2])
    assert abs(model.logits[g].sum(axis=(0, 1)) / g.size + model.bias - z[2]).max() < 1e-4


def test_toxic_texts_are_found(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        body = words(rng, rng.choice(["en", "fr", "de"]), rng.choice([20, 60, 150]))
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(RUDE) if i % 2 else "vil" + words(rng, "fr", 1)[0])
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    rows += [(700, None), (701, ""), (3, rows[3][1])]
    labels += [(800, 1, 1), (None, 1, 1), (4, 1, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)


def test_toxicity_without_rows(spark, tables):
    assert toxicity.op9_toxicity(spark, tables[1]).count() == 0
    docs = table(spark, tables[0], "documents")
    assert toxicity.score(docs, None, keep=["doc_id"]).where("score <> 0").count() == 0


def test_shared_chances_sum_to_one():
    one = toxicity.count_class(toxicity.Counter({b"abc": 3, b"abd": 1, b"b": 2}))
    two = toxicity.count_class(toxicity.Counter({b"abc": 1, b"xbc": 4}))
    shared = toxicity._chances(toxicity.shared_backoff([one[0], two[0]]))
    letters = {g[1] for c in (one[0], two[0]) for g in c}
    for context in ("", "b", "ab", "xb"):
        assert abs(sum(toxicity.chance(shared, context, c) for c in letters) - 1) < 1e-9
