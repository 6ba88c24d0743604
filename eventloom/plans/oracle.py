"""The catalog's expected results as SQL over the driver tables (DuckDB dialect)."""

from __future__ import annotations

STEP = 10**17

# Fixed values, stated here again so that nothing is shared with what is checked.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"
MARKERS = ["#", "📅", "⏰", "📍", "🎟", "👶", "✨", "👉", "🎉", "🔥", "🎈", "date:", "time:", "location:", "cost:", "age:"]
STOP_WORDS = "the a an at in on for with and or de la du le".split()
# Lines that the renderings add; no text of the tables has other noise. Then the beginnings of date lines.
NOISE = ["log in", "see more", "about", "more"]
DATE_LINES = [
    '(?i)^[\\p{L}\\p{N}_]{2,9},?[\\s\\p{Z}\\x1c-\\x1f\\x85]+(?:[\\p{L}\\p{N}_]{3,9}[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{1,2},?[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{4}|[\\p{L}\\p{N}_]{3,9}[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{1,2}(?:[\\s\\p{Z}\\x1c-\\x1f\\x85]+at[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{1,2}:\\d{2}[\\s\\p{Z}\\x1c-\\x1f\\x85]*(?:AM|PM|IST|GMT|UTC))?|[\\p{L}\\p{N}_]{3,9}\\.?[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{1,2}(?:[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{4})?)',
    '(?i)^[\\p{L}\\p{N}_]{3,9}[,.]?[\\s\\p{Z}\\x1c-\\x1f\\x85]+[\\p{L}\\p{N}_]{2,9}[.,]?[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{1,2}(?:[,:][\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{1,2}:\\d{2}[\\s\\p{Z}\\x1c-\\x1f\\x85]*(?:AM|PM|IST|GMT|UTC))?(?:[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\d{4})?',
    '^[\\p{L}\\p{N}_]{2,3}[,.][\\s\\p{Z}\\x1c-\\x1f\\x85]',
]
DATED = " or ".join(f"regexp_matches(line, '{p}')" for p in DATE_LINES)


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def canonical(x: str) -> str:
    return f"regexp_replace(split_part({x}, '?', 1), '/+$', '')"


def words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^{WORD}]+', ' ', 'g'))"


def caption_title(text: str) -> str:
    plain = " and ".join(f"not contains(lower(x), '{m}')" for m in MARKERS)
    stripped = f"list_transform(string_split({text}, chr(10)), lambda x: {strip('x')})"
    return f"coalesce(list_filter({stripped}, lambda x: x <> '' and {plain})[1][:120], '')"


def page_paths(path_of: str) -> str:
    return f"""
        links as (
            select page_id, unnest(l) as path, generate_subscripts(l, 1) as i, split_part(url, '/', 3) as domain
            from (select page_id, url, regexp_extract_all(html, 'href="(/[^"]+)"', 1) as l from pages)
        ), clean as (select page_id, i, {path_of} as link from links)"""


def numbered(source: str, keys: str) -> str:
    """CTE body: non-empty stripped lines of `t` with their position."""
    return f"""
        select {keys}, row_number() over (partition by {keys} order by i) - 1 as pos, line from (
            select {keys}, i, {strip('l')} as line from (
                select {keys}, unnest(string_split(t, chr(10))) as l,
                       generate_subscripts(string_split(t, chr(10)), 1) as i
                from ({source}))
        ) where line <> ''"""


GROUP_TEXT = """
    select doc_id as group_id, replace(replace(replace(text,
        '. ', '.' || chr(10) || 'Thu, Oct 30' || chr(10) || 'Fri, Oct 31, 2025' || chr(10) || ' More ' || chr(10)),
        ' the ', ' ' || chr(10) || 'Past events (3)' || chr(10) || ' Sat, 1 nov. 2025' || chr(10) || 'ab' || chr(10)),
        ' la ', chr(10) || 'Aanstaande evenementen' || chr(10) || 'do, 30 okt. 2025' || chr(10)) as t
    from documents"""

SECTIONS = f"""
    ln as ({numbered(GROUP_TEXT, 'group_id')}),
    heads as (
        select *, case
            when regexp_matches(lower(line), 'upcoming events|aanstaande|gepland') then 'upcoming'
            when regexp_matches(lower(line), 'past events|verleden|verstreken') then 'past'
            when regexp_matches(lower(line), 'geen') then 'no_upcoming' end as found
        from ln),
    heads2 as (
        select *, coalesce(found, case when pos = 0 and count(found) over (partition by group_id) = 0 then 'all' end) as head
        from heads),
    secs as (
        select *, count(head) over (partition by group_id order by pos) as sec from heads2),
    body as (
        select b.group_id, b.pos, b.line, b.sec, h.head as section
        from secs b join secs h on h.group_id = b.group_id and h.sec = b.sec and h.head is not null
        where b.head is null)"""

ENTRIES = f"""
    {SECTIONS},
    marked as (
        select *, lower(line) in ({quoted(NOISE)}) as noise,
            {DATED} as dated
        from body),
    looked as (
        select *, (dated and not noise) as is_date,
            case when not noise and length(line) > 2 then line end as title_here
        from marked),
    ahead as (
        select *, coalesce(lead(title_here, 1) over w, lead(title_here, 2) over w, lead(title_here, 3) over w, '') as title,
            sum(case when is_date then 0 else 1 end) over w as island
        from looked window w as (partition by group_id, sec order by pos)),
    runs as (
        select *, row_number() over (partition by group_id, sec, island, is_date order by pos) as k from ahead),
    entries as (
        select group_id, row_number() over (partition by group_id order by pos) - 1 as idx, line as date_raw, title, section
        from runs where is_date and k % 2 = 1)"""

ORDER_POSTS = """
    posts as (
        select o_orderkey as k, o_orderdate, cast(o_orderdate as date) as d, o_orderpriority, o_custkey,
            o_orderstatus || '_' || (o_orderkey % 10) as tag,
            case when o_orderkey % 11 = 0 then '#untitled' else 'Order party ' || o_orderkey || '!' end as first_line
        from orders),
    shown as (
        select *, case when k % 7 = 0 then 'see you ' || strftime(d, '%B %-d') || 'th'
                       else '📅 ' || strftime(d, '%b %-d') || 'th 3pm-5:30pm' end as date_line
        from posts),
    fields as (
        select *, case when k % 11 <> 0 then first_line when k % 7 = 0 then date_line else '' end as title,
            first_line || chr(10) || date_line || chr(10) || '📍 ' || o_orderpriority || ', Dublin' || chr(10)
            || '🎟️ €' || o_custkey || ' per child' || chr(10) || '👶 Ages ' || (k % 5) || '-' || (k % 5 + 4)
            || chr(10) || '#kids #' || tag as caption
        from shown)"""

CUSTOMER_FEED = """
    feed as (
        select c_name as title, c_mktsegment as description,
            date '1998-08-25' + cast(c_custkey % 40 as int) as written,
            case c_custkey % 41 when 7 then '1998' when 8 then strftime(written, '%Y-%m') when 9 then ' ' || strftime(written, '%Y-%m-%d')
                when 10 then '1998-9-01T10:00' else strftime(written, '%Y-%m-%d') end as start_date,
            case when c_custkey % 41 not in (7, 8, 9, 10) then written end as day,
            case when c_custkey % 3 <> 0 then 'County ' || n_name when c_custkey % 9 <> 0 then c_mktsegment else 'Unknown' end as place,
            case when c_custkey % 3 = 0 then chr(9) || ' ' else 'County ' || n_name end as county,
            case when c_custkey % 9 = 0 then '' else ' ' || c_mktsegment || ' ' end as city,
            '' as venue_name, 'allevents:' || c_custkey as source, (c_custkey % 10) / 10 as confidence,
            ['allevents', c_mktsegment] as all_sources,
            ['u0/' || c_custkey, 'u1/' || c_custkey, 'u2/' || c_custkey, 'u3/' || c_custkey] as all_urls,
            c_custkey as cluster_id
        from customer join nation on c_nationkey = n_nationkey)"""

WEEKLY = """
    weekly as (
        select md5(cast(o_custkey as varchar)) as title,
            case when o_orderkey % 3 <> 0 then o_orderpriority else '' end as description,
            cast(date '1992-01-01' + cast(7 * (datediff('day', date '1992-01-01', cast(o_orderdate as date)) // 7) as int) as varchar) as start_date,
            case when o_orderkey % 2 = 0 then o_orderstatus else '' end as cost,
            ['yourdaysout', 'allevents', 'facebook', 'instagram'][o_orderkey % 4 + 1] as source_type,
            [100, 90, 50, 30][o_orderkey % 4 + 1] as priority,
            source_type || ':' || o_orderkey as source,
            o_orderkey as k, (100 - priority) * 100000000000000000 + o_orderkey as rank
        from orders)"""

CUSTOMER_CLUSTERS = """
    rows as (
        select c_nationkey || '/' || c_mktsegment as cluster, c_custkey as rank,
            ['allevents:', 'instagram:', 'https://x.example/'][c_custkey % 3 + 1] || (c_custkey % 20) as source,
            [90, 30, 10][c_custkey % 3 + 1] as priority,
            ['allevents', 'instagram', 'https'][c_custkey % 3 + 1] as source_type,
            case when c_custkey % 5 = 0 then '' else c_name end as title,
            case when c_custkey % 3 = 2 then cast(c_acctbal as varchar) else '' end as cost,
            case when c_custkey % 2 = 0 then c_mktsegment else '' end as city,
            'u' || (c_custkey % 30) as url
        from customer),
    headed as (
        select *, min(rank) over (partition by cluster) as leader,
            arg_min(priority, rank) over (partition by cluster) as head_priority
        from rows)"""


def survivor(f: str) -> str:
    return (
        f"coalesce(arg_max({f}, rank) filter (priority > head_priority and {f} <> ''), "
        f"arg_min({f}, rank) filter ({f} <> ''), '') as {f}"
    )


def earlier(rows: str, condition: str) -> str:
    return f"""with t as ({rows})
        select b.k as other_id, min(a.k) as earliest_id from t a join t b on a.k < b.k and {condition} group by b.k"""


# Titles of `worded_orders`: letters at the beginning, letter and length of the run; see there.
WORDED = """
    worded as (
        select o_orderkey as k, o_custkey as g, 14 + k % 19 as p, 1 + (k // 19) % 6 as q, (k // 114) % 3 as letter,
            k % 6 as day, 6 + (k // 7) % 12 as place, k % 3 as step
        from orders),
    paired as (
        select a.k as earliest, b.k as other, a.g, abs(a.day - b.day) as days, abs(a.step - b.step) as steps,
            2.0::double * (least(a.p, b.p) + case when a.letter = b.letter then least(a.q, b.q) else 0 end)
                / (a.p + a.q + b.p + b.q) as ratio,
            2.0::double * least(a.place, b.place) / (a.place + b.place) as place_ratio
        from worded a join worded b on a.g = b.g and a.k < b.k)"""


def worded(rule: str) -> str:
    return f"""
        with {WORDED}, ruled as (select *, {rule} as rule from paired)
        select other as other_id, min(earliest) as earliest_id, arg_min(rule, earliest) as rule, arg_min(ratio, earliest) as ratio
        from ruled where rule is not null group by other"""


AGES = """
    parts as (
        select p_partkey, case p_size % 4 when 0 then 'Ages ' || p_size || '-' || (p_size + 3)
            when 1 then p_size || '+' when 2 then 'age ' || p_size else 'all' end as age_group,
            case when p_size % 4 <> 3 then p_size end as lo,
            case p_size % 4 when 0 then p_size + 3 when 1 then 999 when 2 then p_size end as hi
        from part)"""

ORACLE = {
    "page_links": f"""
        with {page_paths(canonical("'https://' || domain || path"))},
        firsts as (select page_id, link, min(i) as i from clean group by all)
        select page_id, row_number() over (partition by page_id order by i) - 1 as pos, link from firsts""",
    "data_links": """
        select page_id, p.pos, 'https://allevents.in/x/' || page_id || p.tail as link
        from pages, (values (0, '/1'), (1, '/2'), (2, '/3#top')) p(pos, tail)""",
    "url_canonical": f"select page_id, {canonical('url')} as canonical from pages",
    "url_domains": "select page_id, split_part(url, '/', 3) as domain from pages",
    "url_first_seen": f"""
        with {page_paths(canonical('path'))}
        select link as path, min(page_id) as first_pos from clean group by link""",
    "jsonld_events": f"""
        with d as (
            select *, [0, 0, 2, 3, 0, 0, 2, 3][doc_id % 8 + 1] as shape, 'https://allevents.in/dublin/' || doc_id as page,
                split_part(text, chr(10), 1) as title from documents)
        select doc_id as page_id, title, text as description,
            cast(date '2000-01-01' + cast(n_chars as int) as varchar) as start_date, '' as end_date, page as url,
            case shape when 2 then 'Barn' when 3 then 'Town Square' else 'Hall ' || source end as venue_name,
            case shape when 3 then '' else source end as venue_address,
            case when shape in (2, 3) then '' else lang end as city, '' as county,
            case when shape in (2, 3) then '' else 'IE' end as country,
            case when shape = 2 or shape = 3 then '' else cast(53 + cast(doc_id % 7 as double) / 10 as varchar) end as latitude,
            case when shape = 2 or shape = 3 then '' else cast(-6 - cast(doc_id % 3 as double) / 10 as varchar) end as longitude,
            page as source
        from d""",
    "listing_limit": """
        select source, doc_id from documents
        qualify row_number() over (partition by source order by doc_id) <= 5""",
    "monitored_entities": """
        select o_orderkey, o_custkey as c_custkey from orders
        where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
    "feed_union": f"""
        select s_name as title, 'Thu, Oct 30, 2025' as start_date, 'Hall' as venue_name, 'IE' as country, '' as latitude,
            '' as url, 'facebook:' || s_suppkey as source, 'facebook' as source_type, cast(0.5 as double) as confidence,
            50 * {STEP} + s_suppkey as rank
        from supplier
        union all
        select c_name, '', '', 'XX', cast(c_acctbal as varchar), 'https://allevents.in/' || c_custkey, 'allevents', 'allevents',
            cast(0.9 as double), 10 * {STEP} + c_custkey + 1000000000
        from customer""",
    "quarantine": """
        select event_id, case when event_id % 10 not in (3, 4) then cast(json_extract(props, '$.k') as int) end as k,
            event_id % 10 not in (3, 4) as parsed
        from events""",
    "line_table": numbered("select conv_id, turn, text as t from conversations", "conv_id, turn"),
    "noise_filter": f"""
        select * from ({numbered(
            "select conv_id, turn, text || chr(10) || ' Log in ' || chr(10) || 'SEE MORE' || chr(10) || role "
            "|| chr(10) || 'About' as t from conversations", "conv_id, turn")})
        where lower(line) not in ({quoted(NOISE)})""",
    "sections": f"""
        with {SECTIONS}
        select group_id, section, count(*) as n, min(pos) as first_pos, max(line) as last_line from body group by all""",
    "event_ids": """
        select doc_id as group_id, p.pos, p.lead || lpad(cast(doc_id as varchar), 15, '1') as event_id
        from documents, (values (0, '7'), (1, '8'), (2, '9')) p(pos, lead)""",
    "date_title_pairs": f"with {ENTRIES} select * from entries",
    "id_zip": f"""
        with {ENTRIES},
        zipped as (
            select group_id, idx, date_raw, title,
                case when idx < 3 then ['7', '8', '9'][idx + 1] || lpad(cast(group_id as varchar), 15, '1') else '' end as event_id
            from entries)
        select *, case when event_id <> '' then 'https://www.facebook.com/events/' || event_id else '' end as url,
            case when event_id <> '' then 'facebook:' || event_id else '' end as source
        from zipped""",
    "caption_fields": f"""
        with {ORDER_POSTS}
        select k as o_orderkey, title,
            case when k % 7 = 0 then strftime(d, '%B %-d') || 'th' else strftime(d, '%b %-d') || 'th 3pm-5:30pm' end as date_raw,
            case when k % 7 = 0 then '' else '3pm-5:30pm' end as time_raw,
            o_orderpriority || ', Dublin' as location_raw, '€' || o_custkey || ' per child' as cost,
            'Ages ' || (k % 5) || '-' || (k % 5 + 4) as age_group,
            case when k % 11 = 0 then '#untitled|' else '' end || '#kids|#' || tag as hashtags
        from fields""",
    "caption_documents": f"""
        select doc_id, {caption_title('text')} as title,
            '' as date_raw, '' as location_raw, array_to_string(regexp_extract_all(text, '#[{WORD}]+'), '|') as hashtags
        from documents""",
    "hashtags": f"""
        with t as (select doc_id, regexp_extract_all('#' || replace(text, ' ', ' #'), '#[{WORD}]+') as tags from documents)
        select doc_id, len(tags) as n, array_to_string(tags, '|') as tags from t""",
    "post_events": f"""
        with {ORDER_POSTS}, coded as (select *, case when k % 13 <> 0 then cast(k as varchar) else '' end as code from fields)
        select k as ingest_ord, case when title = '' then 'Instagram post #kids' else title end as title, caption[:500] as description,
            'https://www.instagram.com/p/' || code || '/' as url, 'instagram:kids:' || code as source, '' as image_url,
            strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as timestamp
        from coded""",
    "source_types": """
        select doc_id,
            case doc_id % 7 when 0 then 'yourdaysout' when 1 then 'allevents' when 2 then 'facebook' when 3 then 'instagram'
                when 4 then source when 5 then 'unknown' else 'allevents' end as source_type,
            case doc_id % 7 when 0 then 1.0::double when 1 then 0.9::double when 2 then 0.5::double when 3 then 0.3::double
                when 6 then 0.9::double else 0.1::double end as confidence,
            case doc_id % 7 when 2 then 50 when 3 then 30 when 6 then 30 else 10 end as priority
        from documents""",
    "title_norm": f"""
        select doc_id, array_to_string(list_filter(string_split({words('text')}, ' '),
            lambda x: x <> '' and x not in ({quoted(STOP_WORDS)})), ' ') as title_n from documents""",
    "location_norm": f"""
        with t as (
            select c_custkey, {words("['  County ', 'City of ', 'The', 'the county, '][c_custkey % 4 + 1] || n_name || ' - ' || c_mktsegment")} as p
            from customer join nation on c_nationkey = n_nationkey)
        select c_custkey, case when p like 'county %' then p[8:] when p like 'city of %' then p[9:]
            when p like 'the %' then p[5:] else p end as place_n from t""",
    "date_parse": """
        with t as (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 8 as shape from orders)
        select o_orderkey, cast(case
            when shape in (0, 1, 5) then d
            when shape in (4, 6) then try_cast('1998-' || strftime(d, '%m-%d') as date)
            when shape = 7 and month(d) in (4, 9, 11, 12) then d
            when shape = 7 then try_cast('1998-' || strftime(d, '%m-') || strftime(d, '%Y')[:2] as date)
            end as varchar) as parsed
        from t""",
    "decay": """
        with t as (select o_orderkey, datediff('day', cast(o_orderdate as date), date '1998-09-02') as age from orders)
        select o_orderkey, cast(case when age > 30 then 0.3 when age > 14 then 0.6 when age > 7 then 0.8 else 1.0 end as double) as weight
        from t""",
    "match_url": earlier("select event_id as k, user_id from events", "a.user_id = b.user_id"),
    "match_date_band": earlier(
        "select o_orderkey as k, o_custkey % 50 as c, cast(o_orderdate as date) as d from orders",
        "a.c = b.c and abs(datediff('day', a.d, b.d)) <= 3",
    ),
    "match_place": earlier(
        "select o_orderkey as k, o_custkey as c, o_orderpriority as p from orders", "a.c = b.c and a.p = b.p"
    ),
    "match_geo": earlier(
        "select c_custkey as k, c_nationkey as n, c_custkey % 40 as y, c_custkey % 30 as x from customer",
        "a.n = b.n and sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) * 0.01 * 111 < 5",
    ),
    "match_title_date": worded("case when ratio > 0.8 and days <= 3 then 'A' end"),
    "match_title_place": worded(
        "case when ratio > 0.85 and case when g % 20 = 0 then place_ratio > 0.7 else steps < 2 end then 'B' end"
    ),
    # Three hundredths of a degree are 3.33 km.
    "match_nearby": worded(
        "case when ratio > 0.8 and days <= 3 then 'A' when ratio > 0.85 and steps < 2 then 'B' "
        "when ratio > 0.5 and days <= 1 and steps < 2 then 'C' end"
    ),
    "resolve_fuzzy": f"""
        with recursive {WORDED}, numbered as (select *, row_number() over (partition by g order by k) as i from worded),
        walk as (
            select g, i, k, k as lead, [{{'k': k, 'p': p, 'q': q, 'letter': letter, 'day': day}}] as leads from numbered where i = 1
            union all
            select g, i, k, coalesce(hit, k) as lead,
                case when hit is null then list_append(leads, {{'k': k, 'p': p, 'q': q, 'letter': letter, 'day': day}}) else leads end
            from (
                select n.*, w.leads, list_filter(w.leads, lambda x: abs(x.day - n.day) <= 3 and
                    2.0 * (least(x.p, n.p) + case when x.letter = n.letter then least(x.q, n.q) else 0 end)
                    > 0.8 * (x.p + x.q + n.p + n.q))[1].k as hit
                from walk w join numbered n on n.g = w.g and n.i = w.i + 1))
        select k as event_id, lead as cluster_id, lead = k as is_leader from walk""",
    "leaders_url": """
        select event_id, min(event_id) over (partition by user_id) as cluster_id,
            event_id = min(event_id) over (partition by user_id) as is_leader
        from events""",
    "resolve_orders": f"""
        with {WEEKLY},
        grouped as (
            select title, start_date, count(*) as n_members, min(rank) % {STEP} as cluster_id, max(priority) as best,
                coalesce(arg_min(description, rank) filter (description <> ''), '') as description,
                coalesce(arg_min(cost, rank) filter (cost <> ''), '') as cost,
                arg_min(source, rank) as source, arg_min(source_type, rank) as head_type,
                list_sort(list_distinct(list(source) || list(arg_type))) as all_found
            from (select *, first_value(source_type) over (partition by title, start_date order by rank) as arg_type from weekly)
            group by title, start_date)
        select title, description, start_date, cost, source,
            case when n_members = 1 then best / 100 else greatest(best / 100, 0.7::double) end as confidence,
            case when n_members = 1 then head_type else array_to_string(all_found, '|') end as all_sources,
            n_members, cluster_id
        from grouped""",
    "merge_survivorship": f"""
        with {CUSTOMER_CLUSTERS}
        select cluster, {survivor('title')}, {survivor('cost')}, {survivor('city')}, min(rank) as first_rank, count(*) as n_members
        from headed group by cluster""",
    "provenance": f"""
        with {CUSTOMER_CLUSTERS}
        select distinct leader as cluster_id, 'source' as kind, source as value from headed
        union select leader, 'url', url from headed
        union select leader, 'source', source_type from headed where rank = leader""",
    "feed_order": f"""
        with {CUSTOMER_FEED} select start_date, confidence, cluster_id, title from feed
        order by start_date, confidence desc, cluster_id""",
    "feed_output": f"""
        with {WEEKLY}
        select title, start_date, 'IE' as country, source, priority / 100 as confidence, source_type as all_sources, '' as all_urls
        from weekly""",
    "stage_counts": f"""
        with {WEEKLY}
        select 'raw' as stage, count(*) as n from orders union all select 'canonical', count(*) from orders
        union all select 'resolved', count(distinct title || start_date) from weekly""",
    "resolved_by_source": f"""
        with {WEEKLY},
        grouped as (
            select count(*) as n_members, arg_min(source_type, rank) as head_type, list(source) as sources
            from weekly group by title, start_date),
        entries as (
            select unnest(case when n_members = 1 then [head_type] else list_distinct(list_append(sources, head_type)) end) as source
            from grouped)
        select source, count(*) as n from entries group by source""",
    "feed_roundtrip": f"""
        with {CUSTOMER_FEED}
        select start_date, count(*) as n, min(title) as first_title, max(array_to_string(all_urls, '|')) as last_urls,
            round(max(confidence), 2) as best
        from feed group by start_date""",
    "feed_health": "select 'ok' as status, count(*) as events_count from customer",
    "sample_feed": f"""
        with {CUSTOMER_FEED}
        select title, start_date, venue_name, city, county, array_to_string(all_sources, '|') as all_sources,
            array_to_string(all_urls[:3], '|') as all_urls
        from feed order by start_date, confidence desc, cluster_id limit 5""",
    "count_by_source": f"""
        with {CUSTOMER_FEED} select source, count(*) as n from (select unnest(all_sources) as source from feed) group by source""",
    "count_by_location": f"""
        with {CUSTOMER_FEED}
        select place, count(*) as n
        from feed group by 1 order by n desc, min(cluster_id) limit 10""",
    "upcoming": f"""
        with {CUSTOMER_FEED}
        select cluster_id, start_date, title[:60] as title from feed
        where datediff('day', date '1998-09-02', day) between 1 and 15""",
    "upcoming_shown": f"""
        with {CUSTOMER_FEED}
        select start_date, title[:60] as title from feed
        where datediff('day', date '1998-09-02', day) between 1 and 15
        order by start_date, confidence desc, cluster_id limit 10""",
    "search_text": "select doc_id from documents where contains(lower(source) || lower(text), 'tion the')",
    "age_band": f"""
        with {AGES}, bands(band, first, last) as (values ('0-2', 0, 2), ('2-5', 2, 5), ('5-10', 5, 10), ('10+', 10, 999))
        select p_partkey, age_group, band from parts join bands on lo <= last and hi >= first""",
    "county_filter": f"with {CUSTOMER_FEED} select cluster_id, county from feed where county = 'County NATION_7'",
    "display": """
        select event_id, case when event_id % 10 = 0 then 'soon' else strftime(ts, '%a %-d %b %Y') end as date_label,
            event_type as source_badge from events""",
    "search_feed": f"""
        with {CUSTOMER_FEED}
        select cluster_id, title, start_date, coalesce(strftime(day, '%a %-d %b %Y'), start_date) as date_label,
            'allevents' as source_badge
        from feed where county = 'County NATION_3'""",
    "match_same_day": f"""
        with {WORDED}
        select other as other_id, min(earliest) as earliest_id, 'A' as rule, arg_min(ratio > 0.9 and days = 0, earliest) as same_title_and_day
        from paired where ratio > 0.8 and days <= 3 group by other""",
    "match_metric": """
        with titles as (
            select o_orderkey as k, o_custkey as g, o_orderkey % 6 as day,
                translate(md5(cast(o_custkey as varchar)), '0123456789abcdef', 'abcdefghijklmnop')[:14 + o_orderkey % 19]
                || repeat(['q', 'r', 's'][(o_orderkey // 114) % 3 + 1], 1 + (o_orderkey // 19) % 6) as title
            from orders)
        select b.k as other_id, min(a.k) as earliest_id
        from titles a join titles b on a.g = b.g and a.k < b.k and abs(a.day - b.day) <= 3
        where 1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title)) > 0.8 group by b.k""",
    "pass_through_counts": """
        select 1 as tier, count(*) as n, min(s_name) as first_title, max(cast(s_acctbal as varchar)) as last_cost, 0::bigint as cities from supplier
        union all select 2, count(*), min(c_name), null, count(distinct c_mktsegment) from customer""",
    "feed_changes": """
        with kept as (select c_custkey as k, c_custkey % 17 = 0 as gone, c_custkey % 19 = 1 as twice from customer)
        select k as cluster_id, 'removed' as change, '' as fields, 1::bigint as n from kept where gone
        union all select k, 'changed', case when k % 10 = 5 then 'city,confidence' else 'city' end, 1 from kept where not gone and k % 5 = 0
        union all select k, 'added', '', 1 from kept where not gone and twice
        union all select -k, 'added', '', 1 from kept where not gone and twice and k % 2 = 0""",
    "count_by_level": f"""
        with {CUSTOMER_FEED},
        named as (
            select coalesce(nullif(trim(county, ' ' || chr(9)), ''), 'Unknown') as county, coalesce(nullif(trim(city), ''), 'Unknown') as city,
                all_sources[2] as source_type, title[-2:] as title, start_date, confidence
            from feed)
        select cast(3 - grouping(county) - grouping(city) - grouping(source_type) as int) as level, county, city, source_type, count(*) as n,
            count(distinct title) as n_titles, min(nullif(start_date, '')) as first_day, max(confidence) as best
        from named group by rollup (county, city, source_type)""",
    "search_by_index": "select doc_id from documents where contains(lower(source) || lower(text), 'tion the')",
    "replaced_feed": f"""
        with {CUSTOMER_FEED}
        select start_date, count(*) as n, min(title) as first_title from feed where cluster_id % 3 <> 0 group by start_date""",
    "page_changes": """
        select page_id, 1 as day from pages union all select page_id, 2 from pages where page_id % 4 = 0""",
}
