"""Which records belong together: greedy leaders over the match relation.

Records are taken in rank order. Each joins the first earlier leader it
matches, or becomes a leader. The work is laid out so that no group of
records, however large, is turned into all of its pairs:

1.  Records alike in everything the rules look at become one node; a URL
    nobody else has cannot match and is left out of the comparison. A third
    of the table being copies of one listing is one node after one map-side
    combined aggregation.
2.  Nodes are taken in windows of rising rank, sized so that the blocks of a
    window hold a bounded number of pairs. Leaders are settled inside the
    window; then only these leaders meet the remaining nodes, and what they
    match leaves. A crowd of similar records is thus absorbed by a few leaders
    after a small first window. Where a sample says that few records match at
    all, one window takes all: looking at pairs is cheap, holding them is not.
3.  Inside a window the rule "first earlier leader" is the lexicographically
    first maximal independent set of the pair graph, found in few rounds by
    deciding all locally smallest records at once.
"""

from __future__ import annotations

import datetime
from bisect import insort
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.functions.dates import parse_any_date
from eventloom.functions.text import normalize_location, normalize_title, strip, to_degrees

from eventloom.operators.match import (
    CONTENT,
    TITLE,
    Blocks,
    Rules,
    _own_blocks,
    asked_titles,
    match_features,
    matching_pairs,
    similar_places,
    sizes_of,
    with_evidence,
    with_title,
)
from eventloom.operators.graph import components
from eventloom.storage import cut_lineage

WINDOW_PAIRS = 200_000_000
WINDOW_STEPS = 128
#: A state holds while records of a node come in, see `candidate_pairs`.
IN_TIME = (("from_rank", "<", "last_rank"), ("to_rank", ">=", "rank"))


def greedy_leaders(pairs: DataFrame, urls: DataFrame) -> DataFrame:
    """(dst, leader) for every record of `pairs` or `urls` that is not a leader itself.

    `pairs` is a written table of (src, dst), src earlier than dst; `urls` one
    of (rank, url): all with the same URL match, which stays one row per record. A record
    without undecided earlier partners is a leader; whoever matches a leader is
    a member; a member takes the earliest of the leaders it matches. A URL has
    one leader at most.
    """
    live, named, rounds = pairs, urls, []
    has_pairs, has_urls = not live.isEmpty(), not named.isEmpty()
    while has_pairs or has_urls:
        # A record waits if an undecided earlier one matches it; the least undecided record of a URL waits for nobody there.
        seen = live.select(F.col("dst").alias("rank"), F.lit(1).alias("waits")).unionByName(live.select(F.col("src").alias("rank"), F.lit(0).alias("waits")))
        if has_urls:
            later = F.col("rank") > F.min("rank").over(Window.partitionBy("url"))
            seen = seen.unionByName(named.select("rank", later.cast("int").alias("waits")))
        leaders = cut_lineage(seen.groupBy("rank").agg(F.max("waits").alias("waits")).filter("waits = 0").select("rank"))
        members = live.join(leaders.withColumnRenamed("rank", "src"), "src", "left_semi").select("dst")
        if has_urls:
            led = named.join(leaders, "rank", "left_semi").select("url")
            by_url = named.join(led, "url", "left_semi").join(leaders, "rank", "left_anti").select(F.col("rank").alias("dst"))
            members = members.unionByName(by_url)
        members = cut_lineage(members.distinct())
        rounds.append(members)
        gone = members.select(F.col("dst").alias("src"))
        live = cut_lineage(live.join(members, "dst", "left_anti").join(gone, "src", "left_anti"))
        has_pairs = not live.isEmpty()
        if has_urls:
            decided = leaders.unionByName(members.select(F.col("dst").alias("rank")))
            named = cut_lineage(named.join(decided, "rank", "left_anti"))
            has_urls = not named.isEmpty()
    if not rounds:
        return pairs.select("dst", F.col("src").alias("leader")).filter("false")
    members = reduce(DataFrame.unionByName, rounds)
    from_leaders = pairs.join(members.select(F.col("dst").alias("src")), "src", "left_anti").select("dst", F.col("src").alias("leader"))
    heads = urls.join(members.select(F.col("dst").alias("rank")), "rank", "left_anti").select("url", F.col("rank").alias("leader"))
    from_urls = urls.join(heads, "url").filter("leader < rank").select(F.col("rank").alias("dst"), "leader")
    found = from_leaders.unionByName(from_urls).groupBy("dst").agg(F.min("leader").alias("leader"))
    return found.join(members, "dst", "left_semi")


def _urls(nodes: DataFrame) -> DataFrame:
    return nodes.filter("url <> ''").select("rank", "url")


def _keep_shared_urls(records: DataFrame, shared: DataFrame) -> DataFrame:
    """Blank the URLs that are not in `shared`(url)."""
    # Records without URL, maybe most of them, get keys of their own and spread.
    key = F.expr("if(url = '', concat(' ', rank), url)")
    return (
        records.withColumn("_url", key)
        .join(shared.select(F.col("url").alias("_url"), F.col("url").alias("_known")), "_url", "left")
        .withColumn("url", F.coalesce("_known", F.lit("")))
        .drop("_url", "_known")
    )


def match_nodes(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): one node per set of interchangeable records.

    nodes holds the columns of `feats` with the least and the last rank of the
    set and `with_title`; members maps (rank, node) for all records that can match
    anything. The others match
    nobody, not even their own copies, and are in neither.
    """
    shared = feats.filter("url <> ''").groupBy("url").count().filter("count > 1")
    # Records without a URL, maybe most of them, need not be dealt out by it.
    known = _keep_shared_urls(feats.filter("url <> ''"), shared).select(*feats.columns).unionByName(feats.filter("url = ''"))
    # Without a shared URL, a record needs a title and something to go with it.
    by_title = (F.col("title_n") != "") & (F.col("start_dt").isNotNull() | (F.col("place_n") != "") | F.col("lat").isNotNull())
    known = known.filter((F.col("url") != "") | by_title)
    known = cut_lineage(known.withColumn("key", F.unhex(F.md5(F.to_json(F.struct("url", *CONTENT))))))
    nodes = known.groupBy("key", "url", *CONTENT).agg(F.min("rank").alias("rank"), F.max("rank").alias("last_rank"))
    nodes = with_title(nodes)
    nodes = cut_lineage(nodes.withColumn("title_n", F.when(F.col("t_text").isNull(), F.col("title_n"))))
    members = known.select("key", "rank").join(nodes.select("key", F.col("rank").alias("node")), "key").select("rank", "node")
    return nodes.drop("key"), members


def _window_end(nodes: DataFrame, sizes: Blocks, max_pairs: int) -> int | None:
    """Largest rank so that blocks up to it hold about `max_pairs` pairs; None for all.

    Only a histogram of at most WINDOW_STEPS steps per block leaves the
    executors, summed up over the blocks.
    """
    if sizes.pairs <= max_pairs:
        return None
    steps = nodes.approxQuantile("rank", [i / WINDOW_STEPS for i in range(1, WINDOW_STEPS)], 0.001)
    steps = sorted({int(s) for s in steps})
    step = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: n + (F.col("rank") > s).cast("int"))
    per_step = _own_blocks(nodes).groupBy("blk", step.alias("step")).agg(F.count("*").cast("double").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("blk").orderBy("step"))
    added = (
        per_step.withColumn("so_far", so_far)
        .withColumn("added", F.pow("so_far", F.lit(2)) - F.pow(F.col("so_far") - F.col("n"), F.lit(2)))
        .groupBy("step").agg(F.sum("added").alias("added"))
    )
    added = {r["step"]: r["added"] for r in added.collect()}
    total, end = 0.0, None
    for i, s in enumerate(steps):
        total += added.get(i, 0.0)
        if total > max_pairs:
            break
        end = s
    if end is not None:
        return end
    head = nodes.filter(F.col("rank") <= steps[0])
    if head.count() in (0, nodes.count()):
        return steps[0]
    inner = _window_end(head, sizes_of(head), max_pairs)
    return steps[0] if inner is None else inner


def _few_matches(nodes: DataFrame, places: DataFrame, sizes: Blocks, titles: DataFrame, metric, max_pairs: int, hot_rows: int | None) -> bool:
    """Whether all nodes together most likely have few matching pairs, by those among a sample that has about `max_pairs` to look at."""
    step = int((sizes.pairs / max_pairs) ** 0.5) + 1
    some = cut_lineage(nodes.filter(F.pmod(F.xxhash64(F.lit("tried"), "rank"), F.lit(step)) == 0))
    found = matching_pairs(some, some, places, sizes_of(some, hot_rows), titles, metric, extra=(("rank", "<", "last_rank"),))
    return found.count() * step**2 <= min(max_pairs, max(max_pairs // 16, 4 * sizes.rows))


def _settle(
    nodes: DataFrame, members: DataFrame, places: DataFrame, titles: DataFrame, metric, window_pairs: int, hot_rows: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """(rank, leader) of clusters with two or more members, leaders taken as they came in; and the pairs (src, dst).

    The pairs are those of all nodes if one window held them, else None. A pair
    stands for a record of src's, at its first rank, and records of dst's after that.
    """
    todo, joined, complete = nodes, [], None
    while True:
        sizes = sizes_of(todo, hot_rows)
        one = sizes.pairs <= window_pairs or (not joined and _few_matches(todo, places, sizes, titles, metric, window_pairs, hot_rows))
        end = None if one else _window_end(todo, sizes, window_pairs)
        # What is left after a window is sparser, so the next one may be larger.
        window_pairs *= 4
        head = todo if end is None else todo.filter(F.col("rank") <= end)
        after = (("rank", "<", "last_rank"),)
        pairs = cut_lineage(matching_pairs(head, head, places, sizes, titles, metric, extra=after).distinct())
        if end is None and not joined:
            complete = pairs
        settled = cut_lineage(greedy_leaders(pairs.filter("src < dst"), cut_lineage(_urls(head))))
        joined.append(settled)
        if end is None:
            break
        leaders = head.join(settled.select(F.col("dst").alias("rank")), "rank", "left_anti")
        rest = todo.filter(F.col("rank") > end)
        # One leader at most has a URL.
        same = _urls(rest).join(_urls(leaders).withColumnRenamed("rank", "src"), "url").select("src", F.col("rank").alias("dst"))
        hits = matching_pairs(leaders, rest, places, sizes, titles, metric).unionByName(same)
        hits = cut_lineage(hits.groupBy("dst").agg(F.min("src").alias("leader")))
        joined.append(hits)
        todo = cut_lineage(rest.join(hits.select(F.col("dst").alias("rank")), "rank", "left_anti"))
        if todo.isEmpty():
            break

    node_leader = reduce(DataFrame.unionByName, joined).withColumnRenamed("dst", "node")
    found = members.join(node_leader, "node", "left").select("rank", F.coalesce("leader", "node").alias("leader"))
    return _with_heads(found.filter("rank <> leader")), complete


def _with_heads(followers: DataFrame) -> DataFrame:
    followers = cut_lineage(followers)
    heads = followers.select("leader").distinct().select(F.col("leader").alias("rank"), "leader")
    return followers.unionByName(heads)


def leader_assignment(
    canonical: DataFrame,
    ref_date: datetime.date,
    metric=None,
    window_pairs: int = WINDOW_PAIRS,
    hot_rows: int | None = None,
) -> DataFrame:
    """(rank, leader) for the records of clusters with two or more members.

    Each record is compared with the leader as it came in.
    """
    nodes, members = match_nodes(match_features(canonical, ref_date))
    places = cut_lineage(similar_places(nodes, metric=metric, hot_rows=hot_rows))
    return _settle(nodes, members, places, asked_titles(nodes, metric), metric, window_pairs, hot_rows)[0]


# -- comparing with the merged record ------------------------------------------

# Fields the match rules look at, see `_state_values`.
STATE = ["title", "start_date", "city", "venue_name", "latitude", "longitude", "url"]
CHUNK_ROWS = 100_000
MAX_CHUNKS = 4_096
# Records of a component that one task takes in order.
FOLD_ROWS = 5_000


def leader_states(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The merged record of each cluster over time: (rank, from_rank, to_rank, *STATE).

    `rows` holds (rank, leader, priority, *STATE) of the members. A state holds
    for records ranked after from_rank, up to and including to_rank. Only
    members that can change the record are ordered, and these in chunks of
    rank, so a cluster of any size is never ordered by one task.
    """

    def dated(f, condition="true"):
        return f"case when {f} <> '' and {condition} then named_struct('r', rank, 'v', {f}) end"

    per_priority = rows.groupBy("leader", "priority").agg(
        F.min("rank").alias("_r"), *[F.expr(f"min({dated(f)}) as _{f}") for f in STATE]
    )
    firsts = per_priority.groupBy("leader").agg(
        F.min_by("priority", "_r").alias("_head"), *[F.expr(f"min(_{f}) as _first_{f}") for f in STATE]
    )
    fills = " or ".join(f"_first_{f}.r <=> rank" for f in STATE)
    known = cut_lineage(rows.join(firsts, "leader").filter(f"priority > _head or rank = leader or {fills}"))

    chunks = min(MAX_CHUNKS, known.count() // chunk_rows)
    bounds = known.approxQuantile("rank", [i / chunks for i in range(1, chunks)], 0.0001) if chunks > 1 else []
    bounds = ", ".join(f"{int(b)}L" for b in sorted(set(bounds)))
    known = known.withColumn("chunk", F.expr(f"size(filter(array({bounds}), b -> b < rank))") if bounds else F.lit(0))

    inside = "over (partition by leader, chunk order by rank)"
    across = "over (partition by leader order by chunk"
    override = "priority > _head"
    carried = (
        known.groupBy("leader", "chunk")
        .agg(*[F.expr(f"max({dated(f, override)}) as _{f}") for f in STATE])
        .selectExpr(
            "leader",
            "chunk",
            *[
                f"last(_{f}.v, true) {across} rows between unbounded preceding and 1 preceding) as _before_{f}"
                for f in STATE
            ],
        )
    )
    running = [f"last(case when {f} <> '' and {override} then {f} end, true) {inside} as _running_{f}" for f in STATE]
    now = [
        f"coalesce(_running_{f}, _before_{f}, case when _first_{f}.r <= rank then _first_{f}.v end, '') as {f}"
        for f in STATE
    ]
    state = f"struct({', '.join(STATE)})"
    states = (
        known.selectExpr("*", *running)
        .join(carried, ["leader", "chunk"])
        .selectExpr("leader", "chunk", "rank", *now)
        .withColumn("_changed", F.expr(f"not (lag({state}) {inside} <=> {state})"))
        .filter("_changed")
    )
    starts = states.groupBy("leader", "chunk").agg(F.min("rank").alias("_start"))
    starts = starts.selectExpr("leader", "chunk", f"lead(_start) {across}) as _next_chunk")
    return (
        states.join(starts, ["leader", "chunk"])
        .withColumn("to_rank", F.expr(f"coalesce(lead(rank) {inside}, _next_chunk, {2**63 - 1}L)"))
        .select(F.col("leader").alias("rank"), F.col("rank").alias("from_rank"), "to_rank", *STATE)
    )


def _state_values(canonical: DataFrame, shared_urls: DataFrame, priority: Column) -> DataFrame:
    """(rank, priority, *STATE) with values reduced to what matching sees of them.

    A value that is not empty but means nothing to the rules becomes a blank:
    it still fills a field, and exchanging it for another one is no change.
    """

    def seen(field: str, meaning: Column) -> Column:
        return F.when(F.col(field) == "", F.lit("")).otherwise(F.coalesce(F.nullif(meaning, F.lit("")), F.lit(" ")))

    urls = shared_urls.select(F.col("url").alias("_url"))
    rows = canonical.withColumn("_key", F.expr("if(url = '', concat(' ', rank), url)")).join(
        urls, F.col("_key") == F.col("_url"), "left"
    )
    return rows.select(
        "rank",
        priority.alias("priority"),
        seen("title", normalize_title(F.col("title"))).alias("title"),
        seen("start_date", F.col("start_dt").cast("string")).alias("start_date"),
        *[seen(c, normalize_location(F.col(c))).alias(c) for c in ("city", "venue_name")],
        *[seen(c, strip(F.col(c))).alias(c) for c in ("latitude", "longitude")],
        seen("url", F.col("_url")).alias("url"),
    )


def _state_features(states: DataFrame, *keep: str) -> DataFrame:
    """The columns of `match_features` from states."""
    lat, lon = to_degrees(F.col("latitude")), to_degrees(F.expr("if(longitude = '', '0', longitude)"))
    return states.select(
        *keep,
        "rank",
        "from_rank",
        "to_rank",
        F.trim("url").alias("url"),
        F.trim("title").alias("title_n"),
        F.col("start_date").try_cast("date").alias("start_dt"),
        F.expr("trim(if(city <> '', city, venue_name))").alias("place_n"),
        F.when(lon.isNotNull(), lat).alias("lat"),
        F.when(lat.isNotNull(), lon).alias("lon"),
    )


def united_spans(hits: DataFrame, *more: str) -> DataFrame:
    """(leader, *more, from_rank, to_rank, node) with spans that touch or overlap made one."""
    keys = Window.partitionBy("leader", *more, "node").orderBy("from_rank", "to_rank")
    before = F.max("to_rank").over(keys.rowsBetween(Window.unboundedPreceding, -1))
    apart = hits.withColumn("_new", F.when(F.col("from_rank") <= before, 0).otherwise(1))
    return (
        apart.withColumn("_run", F.sum("_new").over(keys.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("leader", *more, "node", "_run")
        .agg(F.min("from_rank").alias("from_rank"), F.max("to_rank").alias("to_rank"))
        .drop("_run")
    )


def first_in_time(members: DataFrame, hits: DataFrame, chunk_rows: int) -> DataFrame:
    """(rank, leader): for each member the least leader with a span of its node's that holds it.

    Members and beginnings of spans are put in one order by rank, and the last
    span's end is carried forward: members plus spans, never their product.
    Members of a node are ordered in chunks of rank; a span that reaches over
    several chunks stands in each.
    """
    spans = united_spans(hits)
    chunks = min(MAX_CHUNKS, members.count() // chunk_rows)
    bounds = members.approxQuantile("rank", [i / chunks for i in range(1, chunks)], 0.0001) if chunks > 1 else []
    bounds = ", ".join(f"{int(b)}L" for b in sorted(set(bounds)))
    placed = members.withColumn("chunk", F.expr(f"size(filter(array({bounds}), b -> b < rank))") if bounds else F.lit(0))
    ends = placed.groupBy("node", "chunk").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    here = cut_lineage(spans.join(ends, "node").filter("from_rank < high and to_rank >= low").drop("low", "high"))
    asked = here.select("leader", "node", "chunk").distinct().join(placed, ["node", "chunk"])
    events = here.select("leader", "node", "chunk", F.col("from_rank").alias("at"), F.lit(1).alias("kind"), "to_rank").unionByName(
        asked.select("leader", "node", "chunk", F.col("rank").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("to_rank"))
    )
    # A span holds ranks after its beginning.
    order = Window.partitionBy("leader", "node", "chunk").orderBy("at", "kind")
    held = events.withColumn("_end", F.last("to_rank", True).over(order)).filter("kind = 0 and at <= _end")
    return held.groupBy(F.col("at").alias("rank")).agg(F.min("leader").alias("leader"))


def _by_rounds(
    nodes: DataFrame, members: DataFrame, values: DataFrame, places: DataFrame, titles: DataFrame, assignment: DataFrame,
    pairs: DataFrame | None, sizes: Blocks, metric, chunk_rows: int, rounds: list[dict] | None,
) -> DataFrame:
    """(rank, leader) of clusters that repeat themselves, from those of `assignment`.

    The clusters give the states of every leader over time, the states give
    every record its first match, and these give the next clusters. What is
    settled for the lowest ranks stays settled. A round costs what it changes:
    states are made for clusters that changed, only states not seen before meet
    the nodes, and their matches are kept. Leaders that look the same all the
    time matched their nodes in the first step.
    """
    features = ["url", "start_dt", "place_n", "lat", "lon", *TITLE]
    by_node = nodes.select(F.col("rank").alias("node"), *features)
    forever = F.lit(2**63 - 1)
    urls = _urls(nodes)
    kept = [F.col(f"l.{c}") for c in ("state", "rank", "from_rank", "to_rank")] + [F.col("r.rank").alias("node")]
    spans, known, hits = None, None, None
    changed = assignment.select("leader").distinct()
    while True:
        # Spans of changed clusters; a cluster whose leader follows now has none.
        mine = cut_lineage(values.join(assignment.join(changed, "leader", "left_semi"), "rank"))
        made = leader_states(mine, chunk_rows)
        made = made.withColumn("moves", F.max(F.col("from_rank") > F.col("rank")).over(Window.partitionBy("rank")))
        if spans is None:
            spans = cut_lineage(made.filter("moves").drop("moves"))
            if spans.isEmpty():
                # Leaders that look the same all the time leave everything as it is.
                return assignment
        else:
            gone = changed.withColumnRenamed("leader", "rank")
            spans = cut_lineage(spans.join(gone, "rank", "left_anti").unionByName(made.filter("moves").drop("moves")))
        moving = spans.select("rank").distinct()
        still = members.join(assignment.filter("rank <> leader"), "rank", "left_anti").join(moving, "rank", "left_anti")
        # What `pairs` does not say about a leader: any, if there were several windows, else those of later copies.
        unknown = still if pairs is None else still.filter("rank <> node")
        unknown = unknown.join(by_node, "node").select("rank", F.col("rank").alias("from_rank"), forever.alias("to_rank"), *features)
        shown = with_title(_state_features(spans)).select(*unknown.columns).unionByName(unknown)
        shown = cut_lineage(shown.withColumn("state", F.xxhash64(*[F.col(c) for c in shown.columns if not c.startswith("t_")])))
        fresh = shown if known is None else shown.join(known, ["state", "rank"], "left_anti")
        found = matching_pairs(fresh, nodes, places, sizes, titles, metric, extra=IN_TIME, keep=kept, carry=["state", "rank", "from_rank", "to_rank"])
        # A leader shows one URL for most of its time: spans of equal ones are united before nodes meet them.
        by_url = united_spans(fresh.filter("url <> ''").select(F.col("rank").alias("leader"), "state", "from_rank", "to_rank", F.col("url").alias("node")), "state")
        same = by_url.join(urls, F.col("node") == F.col("url")).select("state", "leader", "from_rank", "to_rank", F.col("rank").alias("node"))
        found = found.withColumnRenamed("rank", "leader").unionByName(same)
        hits = cut_lineage(found if hits is None else hits.unionByName(found))
        seen = fresh.select("state", "rank")
        known = cut_lineage(seen if known is None else known.unionByName(seen))

        valid = hits.join(shown.select("state", F.col("rank").alias("leader")), ["state", "leader"], "left_semi").drop("state")
        first = first_in_time(members, valid, chunk_rows)
        if pairs is not None:
            alone = still.filter("rank = node").select(F.col("rank").alias("src"))
            least = pairs.join(alone, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("leader"))
            named = urls.join(alone.withColumnRenamed("src", "rank"), "rank", "left_semi").groupBy("url").agg(F.min("rank").alias("leader"))
            least = least.unionByName(urls.join(named, "url").select(F.col("rank").alias("node"), "leader"))
            least = members.join(least, "node").filter("leader < rank").select("rank", "leader")
            first = first.unionByName(least).groupBy("rank").agg(F.min("leader").alias("leader"))
        following = _with_heads(first)
        change = following.alias("n").join(assignment.alias("o"), "rank", "full").filter(~F.col("n.leader").eqNullSafe(F.col("o.leader")))
        moved = change.select(F.explode(F.array("n.leader", "o.leader")).alias("leader")).filter("leader is not null").distinct()
        changed = cut_lineage(moved)
        if rounds is not None:
            rounds.append({"states": shown.count(), "fresh": fresh.count(), "clusters": changed.count()})
        if changed.isEmpty():
            return following
        assignment = following


def merged_assignment(
    canonical: DataFrame,
    ref_date: datetime.date,
    priority: Column,
    metric=None,
    window_pairs: int = WINDOW_PAIRS,
    hot_rows: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fold_rows: int = FOLD_ROWS,
    rounds: list[dict] | None = None,
) -> DataFrame:
    """Like `leader_assignment`, each record compared with its leader as merged by then.

    Records linked by matches of what came in are a component. In one, records
    are taken one after the other as the rule says; components of more than
    fold_rows records are settled in rounds over the cluster, see `_by_rounds`.
    Then all leaders that look different from what came in meet the nodes:
    where one matches a node of another component, both become one, and these
    are settled again until no match leads out. `rounds` gets a row of counts
    per step.
    """
    nodes, members = match_nodes(match_features(canonical, ref_date))
    # A state may show the venue of a record that itself goes by its city.
    names = canonical.select(F.explode(F.array("city", "venue_name")).alias("name")).distinct()
    names = names.select(normalize_location(F.col("name")).alias("place_n"))
    places = cut_lineage(similar_places(names, metric=metric, hot_rows=hot_rows))
    titles = asked_titles(nodes, metric)
    static, pairs = _settle(nodes, members, places, titles, metric, window_pairs, hot_rows)
    if static.isEmpty():
        return static

    shared_urls = nodes.filter("url <> ''").select("url").distinct()
    dated = canonical.withColumn("start_dt", parse_any_date(F.col("start_date"), ref_date))
    values = _state_values(dated, shared_urls, priority).join(members, "rank")
    sizes = sizes_of(nodes, hot_rows)
    if pairs is None or metric is not None:
        # Several windows: which nodes a leader could match besides those it has is not known. A metric works on columns only.
        return _by_rounds(nodes, members, cut_lineage(values.drop("node")), places, titles, static, None, sizes, metric, chunk_rows, rounds)
    values = cut_lineage(values)
    urls = _urls(nodes)
    in_time = (F.col("l.from_rank") < F.col("r.last_rank")) & (F.col("l.to_rank") >= F.col("r.rank"))
    by_url = urls.join(urls.groupBy("url").agg(F.min("rank").alias("b")), "url").select(F.col("rank").alias("a"), "b")
    links = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(by_url)
    roots = components(links)
    todo, settled = None, None
    while True:
        # Nodes without a link are alone with their copies.
        placed = values.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = placed if todo is None else placed.join(todo, "root", "left_semi")
        sized = cut_lineage(placed.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"))
        few = sized.filter(F.col("n") <= fold_rows).select("root")
        small = placed.join(few, "root", "left_semi")
        inside = pairs.join(roots, F.col("src") == F.col("node"), "left").select(F.coalesce("root", "src").alias("root"), "src", "dst")
        inside = inside.join(few, "root", "left_semi")
        # Most components are a few records, so a task takes many.
        tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), sized.agg(F.sum("n")).first()[0] // (4 * FOLD_ROWS))
        small, inside = (df.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(tasks))).repartition(tasks, "bucket") for df in (small, inside))
        done = cut_lineage(small.groupBy("bucket").cogroup(inside.groupBy("bucket")).applyInPandas(_folded, FOLDED))
        large = cut_lineage(sized.filter(F.col("n") > fold_rows).select("root"))
        if not large.isEmpty():
            done = cut_lineage(done.unionByName(_large(nodes, placed.join(large, "root", "left_semi"), places, titles, static, pairs, sizes, metric, chunk_rows, rounds)))
        if settled is not None:
            done = cut_lineage(settled.join(todo, "root", "left_anti").unionByName(done))
        settled = done
        shown = settled if todo is None else settled.join(todo, "root", "left_semi")
        shown = cut_lineage(with_title(_state_features(shown.filter("from_rank is not null"), "root")))
        # Nodes of its own component are settled already.
        others = nodes.join(roots, F.col("rank") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "rank"))
        leads_out = in_time & (F.col("l.root") != F.col("r.root"))
        far = (*IN_TIME, ("root", "!=", "root"))
        keep = [F.col("l.root").alias("a"), F.col("r.root").alias("b")]
        found = matching_pairs(shown, others, places, sizes, titles, metric, extra=far, keep=keep, carry=["root"])
        named = shown.filter("url <> ''").alias("l").join(others.alias("r"), (F.col("l.url") == F.col("r.url")) & leads_out).select(*keep)
        out = cut_lineage(found.unionByName(named).distinct())
        if rounds is not None:
            rounds.append({"states": shown.count(), "links": out.count()})
        if out.isEmpty():
            return settled.filter("from_rank is null").select("rank", "leader")
        # Components that became one have the least root; the others' roots are nodes without results now.
        joined = cut_lineage(components(out))
        moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
        every = nodes.select(F.col("rank").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = cut_lineage(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        todo = joined.select(F.col("node").alias("root"))


def _large(nodes, placed, places, titles, static, pairs, sizes, metric, chunk_rows, rounds) -> DataFrame:
    """What `_folded` gives, for components of any size: nodes and records of these alone, settled in rounds."""
    placed = cut_lineage(placed)
    own = placed.select("node").distinct()
    some = nodes.join(own.withColumnRenamed("node", "rank"), "rank", "left_semi")
    mine = placed.select("rank").distinct()
    inside = pairs.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    values = placed.drop("node", "root")
    found = _by_rounds(
        cut_lineage(some), placed.select("rank", "node"), values, places, titles, cut_lineage(static.join(mine, "rank", "left_semi")),
        cut_lineage(inside), sizes, metric, chunk_rows, rounds,
    )
    found = cut_lineage(found)
    root = placed.select("rank", "root")
    states = leader_states(cut_lineage(values.join(found, "rank")), chunk_rows)
    states = states.withColumn("_moves", F.max(F.col("from_rank") > F.col("rank")).over(Window.partitionBy("rank"))).filter("_moves").drop("_moves")
    columns = [f.split()[0] for f in FOLDED.split(", ")]
    none = {c: F.lit(None).cast("bigint") for c in ("from_rank", "to_rank")} | {f: F.lit(None).cast("string") for f in STATE}
    members = found.join(root, "rank").withColumns(none).select(*columns)
    return members.unionByName(states.withColumn("leader", F.col("rank")).join(root, "rank").select(*columns))


# A record and its leader or, with ranks from and to, a state of a leader.
FOLDED = ", ".join(["root bigint", "rank bigint", "leader bigint", "from_rank bigint", "to_rank bigint", *[f"{f} string" for f in STATE]])


def _folded(rows, pairs):
    """What records of components become when they are taken in order; see `FOLDED`.

    `pairs` are the matches of nodes as they came in, so only leaders that look
    different by now have to be compared.
    """
    import pandas as pd

    matched_by: dict[int, list[int]] = {}
    for src, dst in zip(pairs["src"].tolist(), pairs["dst"].tolist()):
        matched_by.setdefault(dst, []).append(src)
    by_root: dict[int, list[dict]] = {}
    for row in rows.sort_values("rank").to_dict("records"):
        by_root.setdefault(row["root"], []).append(row)
    rules = Rules()
    out = [line for root, own in by_root.items() for line in _taken_in_order(root, own, matched_by, rules)]
    kinds = [f.split() for f in FOLDED.split(", ")]
    columns = zip(*out) if out else [()] * len(kinds)
    return pd.DataFrame({n: pd.array(c, "Int64" if kind == "bigint" else "object") for (n, kind), c in zip(kinds, columns)})


def _taken_in_order(root: int, rows: list[dict], matched_by: dict[int, list[int]], rules: Rules) -> list[tuple]:
    """Rows of `FOLDED` for one component, whose records are sorted by rank."""
    leaders: list[dict] = []
    # Numbers of the leaders that look as they came in, by node and by URL, and of the others.
    same: dict[int | str, list[int]] = {}
    changed: list[int] = []
    out: list[tuple] = []
    for row in rows:
        seen = rules.features(row)
        found = [same[key][0] for key in (*matched_by.get(row["node"], ()), seen[0] or None) if same.get(key)]
        at = min(found, default=len(leaders))
        at = next((i for i in changed if i < at and rules.match(leaders[i]["seen"], seen)), at)
        if at == len(leaders):
            now = {f: row[f] for f in STATE}
            leaders.append({"rank": row["rank"], "priority": row["priority"], "now": now, "seen": seen, "first": seen, "spans": [(row["rank"], now)]})
            leaders[at]["keys"] = [key for key in (row["node"], seen[0]) if key != ""]
            for key in leaders[at]["keys"]:
                same.setdefault(key, []).append(at)
        else:
            hit = leaders[at]
            now = {f: row[f] if row[f] and (not v or row["priority"] > hit["priority"]) else v for f, v in hit["now"].items()}
            if now != hit["now"]:
                hit["now"], hit["seen"] = now, rules.features(now)
                hit["spans"].append((row["rank"], now))
                if hit["keys"] and hit["seen"] != hit["first"]:
                    for key in hit["keys"]:
                        same[key].remove(at)
                    hit["keys"] = []
                    insort(changed, at)
        out.append((root, row["rank"], leaders[at]["rank"], None, None, *[None] * len(STATE)))
    for x in leaders:
        ends = [*[start for start, _ in x["spans"][1:]], 2**63 - 1]
        if len(ends) > 1:
            out += [(root, x["rank"], x["rank"], start, end, *[now[f] for f in STATE]) for (start, now), end in zip(x["spans"], ends)]
    return out


def earliest_matches(canonical: DataFrame, ref_date: datetime.date, metric=None, hot_rows: int | None = None) -> DataFrame:
    """(other_id, earliest_id): the earliest record before it that a record matches."""
    nodes, members = match_nodes(match_features(canonical, ref_date))
    places = cut_lineage(similar_places(nodes, metric=metric, hot_rows=hot_rows))
    least = _urls(nodes).groupBy("url").agg(F.min("rank").alias("src"))
    same = _urls(nodes).join(least, "url").filter("src < rank").select("src", F.col("rank").alias("dst"))
    found = matching_pairs(nodes, nodes, places, sizes_of(nodes, hot_rows), asked_titles(nodes, metric), metric).unionByName(same)
    first = found.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("src"))
    # A copy matches the first of its kind, if nothing earlier.
    own = F.when(F.col("node") < F.col("rank"), F.col("node"))
    return (
        members.join(first, "node", "left")
        .select(F.col("rank").alias("other_id"), F.least("src", own).alias("earliest_id"))
        .filter("earliest_id is not null")
    )


def match_evidence(canonical: DataFrame, matches: DataFrame, ref_date: datetime.date, metric=None) -> DataFrame:
    """`matches` (other_id, earliest_id) with the rule that holds first and the evidence: a row per record, never all pairs."""
    feats = cut_lineage(match_features(canonical, ref_date))
    side = lambda s: feats.select(*[F.col(c).alias(f"{c}_{s}") for c in feats.columns])
    both = matches.join(side("l"), F.col("earliest_id") == F.col("rank_l")).join(side("r"), F.col("other_id") == F.col("rank_r"))
    return with_evidence(both, metric).select("other_id", "earliest_id", "rule", "title_sim", "place_sim", "date_diff", "geo_close", "same_title_and_day")


def membership(canonical: DataFrame, assignment: DataFrame) -> DataFrame:
    """(event_id, cluster_id, is_leader) for every record; ids are ranks."""
    return canonical.select("rank").join(assignment, "rank", "left").select(
        F.col("rank").alias("event_id"),
        F.coalesce("leader", "rank").alias("cluster_id"),
        F.coalesce(F.col("leader") == F.col("rank"), F.lit(True)).alias("is_leader"),
    )
