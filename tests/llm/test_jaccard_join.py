from collections import Counter

import numpy as np
import pytest

from eventloom.llm import jaccard_join
from eventloom.llm.common import table
from eventloom.llm.graph import components


def naive(docs, size, percent):
    """Counter of (id, shingles, component)."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return Counter((docs[i][0], len(s), least.get(find(i)) if s else docs[i][0]) for i, s in enumerate(sets))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_as_brute_force(spark, tables, docs, size, percent):
    out = jaccard_join.jaccard_groups(table(spark, tables[0], "documents"), size, percent, keep=["doc_id"]).collect()
    want = naive(docs, size, percent)
    assert Counter((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in out) == want
    assert len({c for *_, c in want}) < len(docs) - 20


def test_query_and_no_rows(spark, tables, docs):
    assert Counter(map(tuple, jaccard_join.op3_jaccard_join(spark, tables[0]).collect())) == naive(docs, 3, 90)
    assert jaccard_join.op3_jaccard_join(spark, tables[1]).count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 2, 0)])
def test_links_inside_a_group_that_shares_no_shingle(spark, order):
    rare = "r1 r2 r3 r4"
    other, same = (" ".join(["x1 x2", *(f"{c}{i}" for i in range(26))]) for c in "ab")
    tails = [f"{other} c", f"{same} c", f"{same} d"]
    rows = [(i, f"{rare} {tails[i]}") for i in order]
    # Repeated rows make all but the rare shingles frequent, so the three texts have one prefix of their own.
    rows += [(10 + i, t) for i, t in enumerate(tails * 5)]
    found = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    out = jaccard_join.jaccard_groups(found, 3, 90, keep=["doc_id"]).collect()
    got = Counter((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in out)
    assert got == naive(rows, 3, 90) and got[2, len(tails[2].split()) + 2, 1] == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_parities_are_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(0, 300, 3)
        both, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in sizes)
        least = jaccard_join.least_difference(*(jaccard_join.parities(np.concatenate((both, own))) for own in (x, y)))
        assert least <= len(x) + len(y) and (least > 0 or len(x) + len(y) != 1)
        assert (len(x) + len(y) - least) % 2 == 0


def test_pairs_that_differ_much_move_no_sets(spark, monkeypatch):
    needed, moved = jaccard_join._needed_sets, []
    monkeypatch.setattr(jaccard_join, "_needed_sets", lambda docs, keys, *more: moved.append(keys.count()) or needed(docs, keys, *more))
    tails = [" ".join(["x1 x2", *(f"{c}{i}" for i in range(24))]) for c in "ab"]
    # Repeated rows make all but the rare shingles frequent, so two texts that share little else have one prefix.
    rows = [(i, f"r1 r2 r3 r4 {t}") for i, t in enumerate(tails)] + [(10 + i, t) for i, t in enumerate(tails * 5)]
    found = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = jaccard_join.jaccard_groups(found, 3, 90, keep=["doc_id"]).collect()
    assert Counter((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in out) == naive(rows, 3, 90)
    assert not moved


def test_first_rows_move_only_texts_that_lose_rows(spark, monkeypatch):
    scanned, by_mark = [], jaccard_join.rows_by_mark
    monkeypatch.setattr(jaccard_join, "rows_by_mark", lambda docs, marks, marked, *more: scanned.append(
        (marked, by_mark(docs, marks, marked, *more).count())) or by_mark(docs, marks, marked, *more))
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [*enumerate(base), (2, base[2]), (50, base[3]), (51, base[4] + " more"), (None, base[5]), (60, None), (60, None), (61, ""), (61, ""),
            (62, "  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = jaccard_join.jaccard_groups(docs, 5, 80, keep=["doc_id"])
    got = Counter(map(tuple, jaccard_join.first_rows(docs, found).collect()))
    assert got == Counter([*enumerate(base), (60, None), (61, ""), (62, "  ")])
    # Rows of texts 2, 3, 5, of one copy of 4, of null, and of the empty text.
    assert dict(scanned) == {True: 2 + 2 + 2 + 1 + 2 + 2, False: len(rows) - 11}


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = np.random.default_rng(6)
    letters = np.frombuffer("aAbB\x1f\x00é \n\t\r\x0b\x0c".encode(), np.uint8)
    texts = [b"", b" \n", b"a", bytes(rng.choice(letters, 20_000)), b"x" * 300 + b" " + b"y" * 64 + b" b " + b"X" * 300]
    for piece in (128, 1 << 17):
        monkeypatch.setattr(jaccard_join, "PIECE", piece)
        jaccard_join._powers.cache_clear()
        known = {}
        for text in texts:
            words = text.lower().split()
            hashes = jaccard_join.word_hashes(text).tolist()
            assert len(hashes) == len(words)
            assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
        assert len(set(known.values())) == len(known) > 500
    jaccard_join._powers.cache_clear()
