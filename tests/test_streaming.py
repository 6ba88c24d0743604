import datetime
from collections import Counter

from eventloom.sources.lines import group_events
from eventloom.sources.pages import page_events
from eventloom.streaming.captures import changed_captures, late_rows, once_within
from eventloom.streaming.refresh import refresh

SCRIPT = '<script type="application/ld+json">{"@type": "Event", "name": "%s"}</script>'


def test_refresh_takes_each_capture_once(spark, tmp_path):
    captures, out, progress = (str(tmp_path / n) for n in ("captures", "out", "progress"))
    schema = "page_id int, url string, html string"

    def capture(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(captures)

    capture((1, "https://x/1", SCRIPT % "one"), (2, "https://x/2", "none"))
    assert refresh(spark, captures, schema, page_events, out, progress) == 2
    assert refresh(spark, captures, schema, page_events, out, progress) == 0
    capture((3, "https://x/3", SCRIPT % "three"))
    assert refresh(spark, captures, schema, page_events, out, progress) == 1
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["one", "three"]


def test_page_texts_stream_too(spark, tmp_path):
    schema = "group_id string, html string, visible_text string"
    spark.createDataFrame([("g", "", "Upcoming events\nThu, Jul 23\nParty")], schema).write.parquet(str(tmp_path / "in"))
    refresh(spark, str(tmp_path / "in"), schema, group_events, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).first().title == "Party"


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


def test_only_changed_captures_go_on_over_restarts(spark, tmp_path):
    folder, schema = str(tmp_path), "page int, html string, at timestamp"
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def capture(*rows):
        rows = [(p, html, None if n is None else day(n)) for p, html, n in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        refresh(spark, f"{folder}/in", schema, lambda s: changed_captures(s, "page", ["html"], "at"), f"{folder}/out", f"{folder}/progress")
        return Counter((r.page, r.html, (r.at - day(0)).days) for r in spark.read.parquet(f"{folder}/out").collect())

    first = capture((1, "a", 1), (2, None, 1), (None, "n", 1), (1, "a", 2), (2, "b", 3), (4, "x", None))
    assert first == Counter([(1, "a", 1), (2, None, 1), (2, "b", 3), (None, "n", 1)])
    # Unchanged, late and changed ones, after a restart from the state that was kept.
    second = capture((1, "a", 5), (2, "late", 2), (None, "m", 4), (3, "", 1))
    assert second - first == Counter([(None, "m", 4), (3, "", 1)])
    # Once another page has been captured long after it, a page counts as new.
    third = capture((1, "a", 6), (3, "", 300))
    assert third == second
    fourth = capture((1, "a", 400))
    assert fourth - third == Counter([(1, "a", 400)])
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_repeats_and_late_captures(spark, tmp_path):
    folder, schema = str(tmp_path), "page int, at timestamp"
    found = []

    def run(*rows):
        spark.createDataFrame([(p, day(d)) for p, d in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = once_within(spark.readStream.schema(schema).parquet(f"{folder}/in"), ["page"], "at")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        found.append(late_rows(query.recentProgress))
        return sorted(r.page for r in spark.read.parquet(f"{folder}/out").collect())

    assert run((1, 1), (1, 2), (2, 10)) == [1, 2]
    assert run((2, 10), (3, 11), (4, 1)) == [1, 2, 3]
    assert found[-1] == 1
