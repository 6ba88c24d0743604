import datetime

import naive
import pytest
from pyspark.sql import functions as F

from eventloom.operators.canonical import RANK_STEP, check_order, to_canonical
from eventloom.operators.match import BoundedRatio, match_features, matching_pairs, similar_places, similarity_udf, sizes_of, titles_of, with_evidence, with_title
from eventloom.operators import report
from eventloom.operators.merge import feed_sources, merge_clusters, override_priority
from eventloom.operators.resolve import leader_assignment, membership, merged_assignment

REF = datetime.date(2026, 1, 1)


def match_pairs(canonical, hot_rows=None):
    """All matching pairs (leader_id, other_id) with the rule that holds first."""
    feats = with_title(match_features(canonical, REF)).withColumn("last_rank", F.col("rank"))
    places, titles = similar_places(feats), titles_of(feats)
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "lr" for c in ["rank", "url", "start_dt", "place_n", "lat", "lon"]]
    by_url = feats.filter("url <> ''").alias("l").join(feats.alias("r"), F.expr("l.url = r.url AND l.rank < r.rank")).select(*sides)
    found = matching_pairs(feats, feats, places, sizes_of(feats, hot_rows), titles, keep=sides).unionByName(by_url).distinct()
    texts = feats.select("rank", "title_n")
    found = found.join(texts.toDF("rank_l", "title_n_l"), "rank_l").join(texts.toDF("rank_r", "title_n_r"), "rank_r")
    return with_evidence(found).select(F.col("rank_l").alias("leader_id"), F.col("rank_r").alias("other_id"), "rule")


def raw_of(spark, events):
    fields = naive.MERGED + ["source"]
    schema = ", ".join(f"{f} string" for f in fields) + ", ingest_ord bigint"
    rows = [tuple(e[f] for f in fields) + (e["ingest_ord"],) for e in events]
    return spark.createDataFrame(rows, schema)


def canonical_of(spark, events):
    return to_canonical(raw_of(spark, events)).cache()


def assigned(canonical, **options):
    rows = membership(canonical, leader_assignment(canonical, REF, **options)).collect()
    return {r.event_id % RANK_STEP: r.cluster_id % RANK_STEP for r in rows}


@pytest.mark.parametrize("seed", [1])
def test_pairs_equal_brute_force(spark, seed):
    events = naive.random_events(seed, 150)
    order = naive.ordered(events)
    expected = {}
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            label = naive.rule(a, b)
            if label:
                expected[a["ingest_ord"], b["ingest_ord"]] = label
    canonical = canonical_of(spark, events)
    for hot_rows in (None, 5):
        found = match_pairs(canonical, hot_rows).collect()
        got = {(r.leader_id % RANK_STEP, r.other_id % RANK_STEP): r.rule for r in found}
        assert len(got) == len(found)
        assert got == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_leaders_equal_naive_loop(spark, seed):
    events = naive.random_events(seed, 200)
    assert assigned(canonical_of(spark, events)) == naive.leaders(events)


def test_small_windows_and_split_blocks_change_nothing(spark):
    events = naive.random_events(6, 150)
    canonical = canonical_of(spark, events)
    assert assigned(canonical, window_pairs=300, hot_rows=5) == naive.leaders(events)


def test_one_listing_copied_many_times(spark):
    events = naive.random_events(7, 60)
    copy = next(e for e in events if e["title"] and e["start_date"])
    for i in range(600):
        events.append(dict(copy, ingest_ord=1000 + i, url=f"https://web.example/copy/{i}", source="web:copy"))
    canonical = canonical_of(spark, events)
    expected = naive.leaders(events)
    assert assigned(canonical) == expected
    assert assigned(canonical, window_pairs=200, hot_rows=20) == expected


def test_merge_equals_sequential_fold(spark):
    events = naive.random_events(8, 200)
    canonical = canonical_of(spark, events)
    merged = merge_clusters(canonical, leader_assignment(canonical, REF)).collect()
    expected = {c["head"]["ingest_ord"]: c for c in naive.fold(events)}
    assert {r.cluster_id % RANK_STEP for r in merged} == set(expected)
    for r in merged:
        c = expected[r.cluster_id % RANK_STEP]
        assert {f: r[f] for f in naive.MERGED} == {f: c["now"][f] for f in naive.MERGED}
        assert r.n_members == len(c["members"])
        assert r.confidence == pytest.approx(c["conf"])
        assert r.all_sources == sorted(c["sources"])
        assert r.all_urls == sorted(c["urls"])
        by_ord = {e["ingest_ord"]: naive.source_type(e) for e in events}
        assert r.source_types == sorted({by_ord[m] for m in c["members"]})


def test_provenance_as_lists_and_as_rows(spark):
    events = naive.random_events(9, 80)
    canonical = canonical_of(spark, events)
    assignment = leader_assignment(canonical, REF).cache()
    lists, rows = merge_clusters(canonical, assignment), feed_sources(canonical, assignment)
    by_kind = rows.groupBy("cluster_id", "kind").agg(F.array_sort(F.collect_list("value")).alias("values"))
    found = {(r.cluster_id % RANK_STEP, r.kind): r["values"] for r in by_kind.collect()}
    for c in naive.fold(events):
        key = c["head"]["ingest_ord"]
        assert found[key, "url"] == sorted(c["urls"]) and found[key, "source"] == sorted(c["sources"])
    none = merge_clusters(canonical, assignment, lists=False)
    assert none.filter("all_urls IS NOT NULL OR all_sources IS NOT NULL").count() == 0
    counted = [{tuple(r) for r in report.count_by_source(*a).collect()} for a in ((lists,), (none, rows))]
    assert counted[0] == counted[1]


def test_orders_that_make_no_rank(spark):
    events = naive.random_events(1, 5)
    for bad in (-1, RANK_STEP):
        with pytest.raises(Exception, match="ingest_ord"):
            to_canonical(raw_of(spark, [dict(events[0], ingest_ord=bad)])).collect()
    twice = [dict(e, ingest_ord=7, source="web:1", url="") for e in events[:2]]
    with pytest.raises(ValueError, match="unique"):
        check_order(canonical_of(spark, twice))


def test_no_input(spark):
    assert assigned(canonical_of(spark, naive.random_events(1, 1)).limit(0)) == {}


@pytest.mark.parametrize(
    "seed, n, options",
    [(10, 150, {}), (11, 40, {"chunk_rows": 2, "fold_rows": 0}), (12, 60, {"fold_rows": 10, "hot_rows": 5}), (13, 40, {"window_pairs": 100})],
)
def test_merged_mode_equals_mutating_loop(spark, seed, n, options):
    events = naive.random_events(seed, n)
    canonical = canonical_of(spark, events)
    rounds = []
    assignment = merged_assignment(canonical, REF, override_priority(), rounds=rounds, **options)
    rows = membership(canonical, assignment).collect()
    got = {r.event_id % RANK_STEP: r.cluster_id % RANK_STEP for r in rows}
    expected = {m: c["head"]["ingest_ord"] for c in naive.fold(events, mutate=True) for m in c["members"]}
    assert got == expected
    # A round looks at less than the one before once the clusters come to rest.
    assert len(rounds) < 12


def test_long_titles_cost_little_before_the_ratio():
    import random
    import time

    rnd = random.Random(1)
    parts = ["ka", "lo", "min", "tre", "sul", "qu", "vor", "ex"]
    text = lambda n: "".join(rnd.choice(parts) + " " * (rnd.random() < 0.3) for _ in range(n))
    bounded = BoundedRatio()
    for _ in range(60):
        a, b = text(rnd.choice([20, 60, 200])), text(rnd.choice([20, 60, 200]))
        near = a[: len(a) // 2] + "zz" + a[len(a) // 2 + 3 :]
        for left, right in ((a, b), (a, near), (near, a)):
            exact = naive.ratio(left, right)
            for least in (0.5, 0.8, 0.85):
                assert bounded.above(left, right, least) == (exact if exact > least else 0.0)
    words = [f"{parts[i % 8]}{parts[i // 8 % 8]}" for i in range(64)]
    a, b = (" ".join(rnd.choice(words) for _ in range(3500)) for _ in range(2))
    start = time.time()
    assert bounded.above(a, b, 0.8) == 0.0
    assert time.time() - start < 1


@pytest.mark.parametrize("cell_rows", [7, 40, 32_768])
def test_tiles_of_large_blocks_equal_brute_force(spark, monkeypatch, cell_rows):
    """Few places with many titles: the pairs of a block are compared in tiles, and large blocks in cells."""
    import random

    from eventloom.operators import match

    rnd = random.Random(3)
    monkeypatch.setattr(match, "CELL_ROWS", cell_rows)
    event = dict.fromkeys(naive.MERGED + ["source"], "")
    events, title = [], ""
    for i in range(240):
        # Every third title is a change of the one before.
        title = title[:20] + rnd.choice("abc") + title[21:] if i % 3 else "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([32, 36, 250])))
        events.append(dict(event, title=title, city=rnd.choice(["Cork", "Galway"]), source=f"web:{i}", ingest_ord=i))
    order = naive.ordered(events)
    expected = {(a["ingest_ord"], b["ingest_ord"]) for i, a in enumerate(order) for b in order[i + 1 :] if naive.rule(a, b)}
    assert len(expected) > 50
    found = match_pairs(canonical_of(spark, events), 5).collect()
    assert {(r.leader_id % RANK_STEP, r.other_id % RANK_STEP) for r in found} == expected


def test_ratio_is_taken_once(spark, tmp_path):
    """A filter on the ratio is not moved before the pairs are dealt out to tasks."""
    pairs = spark.createDataFrame([("ab", "abc"), ("x", "y")], "a string, b string").repartition(3, "b")
    scored = pairs.withColumn("s", similarity_udf()("a", "b")).filter("s > 0.5")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert scored.count() == 1


def test_bits_of_many_titles_at_once(spark, monkeypatch):
    """Titles handled in any portions have the same bits: each pair of letters that occurs again counts as another one."""
    import pandas as pd

    from eventloom.operators import match

    texts = pd.Series(["", "a", "aaaa", "abab" * 30, "Ünïcode 🎉🎉", "x" * 300, None])
    bits = lambda: [list(w) for w in match.title_bits_udf().func(texts)]
    together = bits()
    monkeypatch.setattr(match, "TITLE_LETTERS", 0)
    assert together == bits()
    assert together[0] == together[-1] == [0] * 17
    assert sum(bin(int(w) & (2**64 - 1)).count("1") for w in together[2][1:]) == 3


def test_ratios_of_many_pairs_at_once():
    """Blocks of many pairs are found together; the ratio is that of one pair at a time, also next to the bounds."""
    import random

    import numpy as np

    from eventloom.operators.match import plain_ratios, text_codes, text_ratios

    rnd = random.Random(2)
    left, right = [], []
    for i in range(1500):
        letters = rnd.choice(["ab", "abcdefghijklmnop", "ab é日🎉"])
        a = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 20, 33, 199])))
        at = rnd.randrange(len(a) + 1)
        b = a[:at] + "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 2, 30]))) + a[at + rnd.randrange(4) :]
        left.append(a)
        right.append(b[:199] if i % 3 else b[199::-1][:199])
    exact = np.array([naive.ratio(a, b) if a and b else 0.0 for a, b in zip(left, right)])
    alone = lambda a, b: naive.ratio(a, b) if a and b else 0.0
    assert (text_ratios(left, right, other=alone) == exact).all()
    for least in (0.5, 0.8, 0.85):
        bound = np.full(len(left), least)
        assert (text_ratios(left, right, bound, BoundedRatio().above) == np.where(exact > least, exact, 0)).all()
        lengths = np.array([len(t) for t in left + right])
        codes, start, length = text_codes("".join(left + right), lengths)
        n = len(left)
        above = plain_ratios(codes, start[:n], length[:n], start[n:], length[n:], bound, whole=False) > 0
        assert (above == (exact > least)).all()


def test_titles_that_are_not_long_are_scored_where_they_meet(spark):
    """Their pairs need no table of titles, so none is joined to them."""
    from eventloom.operators.match import PLAIN_LETTERS

    event = dict.fromkeys(naive.MERGED + ["source"], "")
    titles = ["summer fair", "summer fairs", "summer fare", "w" * PLAIN_LETTERS + "a", "w" * PLAIN_LETTERS + "b"]
    events = [dict(event, title=t, start_date="2026-05-01", source=f"web:{i}", ingest_ord=i) for i, t in enumerate(titles)]
    feats = with_title(match_features(canonical_of(spark, events), REF))
    places, sizes = similar_places(feats), sizes_of(feats)
    found = lambda titles: {(r.src % RANK_STEP, r.dst % RANK_STEP) for r in matching_pairs(feats, feats, places, sizes, titles).collect()}
    assert found(titles_of(feats)) == {(0, 1), (0, 2), (1, 2), (3, 4)}
    assert found(titles_of(feats).limit(0)) == {(0, 1), (0, 2), (1, 2)}


def test_blocks_are_spread_over_cells(spark):
    """A block that fits one task in rows may still hold most of the pairs; it has several cells, but never very many copies of a row."""
    from eventloom.operators.match import cells_a_side

    rows = spark.createDataFrame([(n,) for n in (1, 4_096, 4_097, 20_000, 32_768, 262_145, 1_800_000)], "n bigint")
    assert [r[0] for r in rows.select(cells_a_side(F.col("n"))).collect()] == [1, 1, 2, 5, 8, 9, 55]


def test_masks_of_titles_reject_no_match(monkeypatch):
    """Two titles share at most the letters that their masks share and what these leave out, also in other portions."""
    import random
    from collections import Counter

    import numpy as np

    from eventloom.operators import match

    rnd = random.Random(4)
    texts = ["".join(rnd.choice(rnd.choice(["abcdefghijklmnop", "aé日🎉x y", "a"])) for _ in range(rnd.choice([0, 1, 20, 32, 63]))) for _ in range(200)]
    made = []
    for letters in (match.TITLE_LETTERS, 100):
        monkeypatch.setattr(match, "TITLE_LETTERS", letters)
        masks, free = match.telling_words(*match.text_codes("".join(texts), np.array([len(t) for t in texts])))
        made.append((masks.tolist(), free.tolist()))
    assert made[0] == made[1]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (Counter(a) & Counter(b)).total() <= min(free[i], free[j]) + (int(masks[i]) & int(masks[j])).bit_count()


def test_large_blocks_of_days_and_positions_equal_brute_force(spark):
    """Titles that are not long bring no signature along; their blocks are compared by one mask, days and positions in bands."""
    import random

    rnd = random.Random(8)
    event = dict.fromkeys(naive.MERGED + ["source"], "")
    events, title = [], ""
    for i in range(300):
        title = title[:8] + "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([1, 4, 9]))) + title[15:] if i % 4 else "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([24, 30, 90])))
        place = {"latitude": rnd.choice(["53.0", "53.03"]), "longitude": "-6.0"} if i % 3 else {}
        day = {"start_date": f"2026-05-{rnd.randrange(1, 9):02d}"} if i % 7 else {}
        events.append(dict(event, title=title, source=f"web:{i}", ingest_ord=i, **place, **day))
    feats = with_title(match_features(canonical_of(spark, events), REF))
    assert feats.filter("(t_bits is null) <> (length(title_n) < 64) or (title_id is null) <> (t_bits is null)").isEmpty()
    order = naive.ordered(events)
    expected = {(a["ingest_ord"], b["ingest_ord"]) for i, a in enumerate(order) for b in order[i + 1 :] if naive.rule(a, b)}
    assert len(expected) > 50
    found = match_pairs(canonical_of(spark, events)).collect()
    assert {(r.leader_id % RANK_STEP, r.other_id % RANK_STEP) for r in found} == expected


def test_written_tables_leave_no_shuffle_files(spark):
    from eventloom.storage import cut_lineage

    files = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(f)}
    before = files()
    rows = cut_lineage(spark.range(1000).repartition(3, "id"))
    assert files() <= before
    assert rows.count() == 1000


def test_blocks_of_titles_that_are_not_long_have_few_cells(spark):
    from eventloom.operators.match import cells_of

    rows = spark.createDataFrame([(100_000, 0), (800_000, 0), (800_000, 20_000), (10, 10)], "n bigint, long bigint")
    assert [r[0] for r in rows.select(cells_of(F.col("n"), F.col("long"))).collect()] == [1, 7, 7, 1]


@pytest.mark.parametrize("alike", [False, True])
def test_one_window_where_few_records_match(spark, monkeypatch, alike):
    """Blocks with many pairs of which few match are compared at once; crowds are still absorbed window by window."""
    from eventloom.operators import resolve

    event = dict.fromkeys(naive.MERGED + ["source"], "")
    title = lambda i: "summer fair on the green " + "abcdefghij"[i % 10] if alike else "".join(chr(97 + (i * 7 + j * (i // 7 + 1)) % 26) for j in range(20))
    events = [dict(event, title=title(i), start_date=f"2026-05-{1 + i // 10 % 3:02d}", source=f"web:{i}", ingest_ord=i) for i in range(120)]
    sides, found = [], resolve.matching_pairs
    monkeypatch.setattr(resolve, "matching_pairs", lambda a, b, *more, **options: sides.append(a is b) or found(a, b, *more, **options))
    assert assigned(canonical_of(spark, events), window_pairs=400) == naive.leaders(events)
    assert (sides == [True, True]) is not alike


def test_place_names_are_compared_as_titles_are(spark, monkeypatch):
    """Names that are not long are scored where they meet, longer ones by pairs; each ordered pair as brute force has it."""
    import random

    from eventloom.operators import match

    rnd = random.Random(6)
    names, name = set(), ""
    for i in range(160):
        name = name[: len(name) - 2] + rnd.choice("abcdef") if i % 3 and len(name) > 3 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([3, 9, 17, 70])))
        names.add(name)
    asked, long = [], match.BoundedRatio.above
    monkeypatch.setattr(match.BoundedRatio, "above", lambda self, a, b, least: asked.append((a, b)) or long(self, a, b, least))
    places = spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "place_n string")
    found = sorted((r.place_l, r.place_r) for r in similar_places(places).collect())
    assert found == sorted((a, b) for a in names for b in names if naive.ratio(a, b) > 0.7)
    similar = similar_places(places, metric=match.edit_similarity).collect()
    assert {(r.place_l, r.place_r) for r in similar} < set(found)
    plan = similar_places(places)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
