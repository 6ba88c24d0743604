import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.operators.changes import apply_changes, change_counts, feed_difference
from eventloom.operators.levels import count_levels, from_sketches, level_sketches
from eventloom.operators.search import search_index, write_index
from eventloom.operators.report import search_text
from eventloom.plans.integrate import pass_through
from eventloom.storage import read_current, replace_feed

SCHEMA = "id int, a string, b string"


def records(rng, n):
    return [(rng.choice([None, *range(12)]), rng.choice([None, "", "x", "y"]), rng.choice([None, "1", "2"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_difference_as_multisets(spark, seed):
    rng = random.Random(seed)
    old, new = records(rng, 80), records(rng, 70)
    df = [spark.createDataFrame(rows, SCHEMA) for rows in (old, new)]
    found = feed_difference(*df, ["id"]).collect()
    gone, came = Counter(old) - Counter(new), Counter(new) - Counter(old)
    for key in {r[0] for r in old + new}:
        less, more = (sum(n for r, n in c.items() if r[0] == key) for c in (gone, came))
        want = {"changed": min(less, more), "removed": max(less - more, 0), "added": max(more - less, 0)}
        got = Counter()
        for r in found:
            if r["id"] == key:
                got[r["change"]] += r["n"]
                assert (r["fields"] != "") == (r["change"] == "changed")
        assert got == Counter({k: v for k, v in want.items() if v})
    parts = [spark.createDataFrame(list(c.elements()), SCHEMA) for c in (came, gone)]
    assert Counter(map(tuple, apply_changes(df[0], *parts).collect())) == Counter(new)


def test_names_of_changed_fields_and_empty_feeds(spark):
    old = spark.createDataFrame([(1, "x", None), (2, "x", "1")], SCHEMA)
    new = spark.createDataFrame([(1, "y", "1"), (2, "x", "1")], SCHEMA)
    assert [tuple(r) for r in feed_difference(old, new, ["id"]).collect()] == [(1, "changed", "a,b", 1)]
    none = old.limit(0)
    assert feed_difference(none, none, ["id"]).count() == 0
    assert [tuple(r) for r in change_counts(feed_difference(none, new, ["id"])).collect()] == [("added", 2)]
    assert [tuple(r) for r in change_counts(feed_difference(old, none, ["id"])).collect()] == [("removed", 2)]


def test_levels_and_their_sketches(spark):
    rows = [(f"t{i % 900}", f"c{i % 3}" if i % 7 else " ", f"d{i % 2}", "web", "", 0.5) for i in range(4000)]
    feed = spark.createDataFrame(rows, "title string, county string, city string, source_type string, start_date string, confidence double")
    exact = {r["county"]: (r["n"], r["n_titles"]) for r in count_levels(feed).filter("level = 1").collect()}
    assert set(exact) == {"c0", "c1", "c2", "Unknown"} and sum(n for n, _ in exact.values()) == 4000
    kept = level_sketches(feed.limit(0)).unionByName(level_sketches(feed))
    for r in from_sketches(kept, "county").collect():
        n, titles = exact[r["county"]]
        assert r["n"] == n and abs(r["n_titles"] - titles) <= 0.05 * titles
    assert count_levels(feed.limit(0)).filter("level > 0").count() == 0


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    rows = [(1, "Big Fair", "music and food"), (2, "fair", None), (3, None, "the FAIRest"), (4, "fa", "ir"), (5, "", ""), (6, "aaaa", "aaa")]
    feed = spark.createDataFrame(rows, "id int, title string, description string")
    write_index(feed, "id", str(tmp_path / "index"))
    for query in ("fair", "Fair", "fairest", "aaa", "aaaaaaaa", "no such", "fa", "", "ir m"):
        found = search_index(spark, str(tmp_path / "index"), feed, "id", query)
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in search_text(feed, query).collect()), query
    plan = search_index(spark, str(tmp_path / "index"), feed, "id", "fair")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_broken_write_leaves_the_old_feed(spark, tmp_path):
    path = str(tmp_path / "feed")
    assert read_current(spark, path).count() == 0
    replace_feed(spark.range(3).select(F.col("id").cast("string").alias("title")), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("cut"))).otherwise(F.lit("x")).cast("string").alias("title"))
    with pytest.raises(Exception, match="cut"):
        replace_feed(broken, path)
    assert read_current(spark, path).count() == 3
    replace_feed(spark.range(2).select(F.col("id").cast("string").alias("title")), path)
    assert read_current(spark, path).count() == 2


def test_pass_through_keeps_rows_and_columns(spark, tmp_path):
    feeds = {1: spark.createDataFrame([("a", None)], "title string, cost string"), 3: spark.createDataFrame([("b",)], "name string")}
    got = pass_through(feeds, str(tmp_path / "out"))
    assert got.columns == ["title", "cost", "tier", "name"]
    assert {tuple(r) for r in got.collect()} == {("a", None, 1, None), (None, None, 3, "b")}
