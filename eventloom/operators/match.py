"""Which events are the same: blocked candidate joins and the match rules.

Two records match when any rule holds:

    url  both have the same non-empty URL
    A    title similarity > 0.8, dates at most 3 days apart
    B    title similarity > 0.85, similar places or closer than 5 km
    C    title similarity > 0.5, dates at most 1 day apart, closer than 5 km

Title similarity is the Ratcliff-Obershelp ratio 2M/(la+lb), M being the
number of characters in matching blocks. It is costly and cannot be indexed,
so records meet only in blocks that no match can miss:

    d:some days   p:place   g:grid cell

Equal URLs need no pairs at all: who shares one is settled by the least rank
per URL (see `resolve`).

Rows meet in blocks without their titles, with a signature of fixed size, and a
pair leaves its block only if upper bounds on M allow the ratio the rule asks
for. The rows of a block, or of a cell of a large one, are compared as arrays,
a tile of pairs at a time, so rejected pairs are never written or shuffled.
Titles of fewer than PLAIN_LETTERS letters come along and are scored right
there, many pairs at a time. Of longer ones each pair of different titles is
looked at once, by bounds first and then by the ratio itself.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F, types as T

from eventloom.functions.dates import parse_any_date
from eventloom.functions.text import normalize_location, normalize_title, to_degrees
from eventloom.storage import cut_lineage
from eventloom.schemas import (
    GEO_KM,
    KM_PER_DEGREE,
    NEARBY_DAYS,
    NEARBY_RULE,
    NEARBY_SIM,
    PLACE_SIM,
    SAME_TITLE_SIM,
    TITLE_DATE_DAYS,
    TITLE_DATE_RULE,
    TITLE_DATE_SIM,
    TITLE_PLACE_RULE,
    TITLE_PLACE_SIM,
    URL_RULE,
)

# Blocks wide enough that a record finds all in a few of them.
CELL_DEGREES = 4 * GEO_KM / KM_PER_DEGREE
DAY_STEP = 2 * (TITLE_DATE_DAYS + 1)

# Only a block with more rows may be split over several tasks.
HOT_BLOCK_ROWS = 1_000
TITLE_WORDS = 16

# Long titles of a block are compared in cells of at most about CELL_ROWS rows a side, others in cells of PLAIN_ROWS,
# TILE_PAIRS pairs at a time; a task gets about CELL_PAIRS pairs with a long title, or PLAIN_PAIRS others.
CELL_ROWS, PLAIN_ROWS = 32_768, 131_072
# Blocks of more than SPREAD_ROWS long titles have up to SPREAD cells a side, so that no task has most of the pairs.
SPREAD_ROWS, SPREAD = 4_096, 8
TILE_PAIRS = 1 << 15
CELL_PAIRS, PLAIN_PAIRS = 200_000_000, 2_000_000_000
# Pairs of a large cell that are tried to see which masks let fewer through, and what one let through costs more than a mask of it.
TRIED_PAIRS, PASSED_COST = 4_096, 100
# Words of the masks that a tile looks at first, at most 3: their bits are counted in bytes.
FOLDED_WORDS = 3
# Pairs of titles that a task scores.
SCORED_PAIRS = 100_000

# Letters whose bits are set at a time.
TITLE_LETTERS = 1 << 20

# Titles whose edit distance is worth its time, which grows with the square of the length.
SHORT_TITLE = 256

# Texts of fewer letters are scored many pairs at a time, and without looking at bounds first: a pair costs the
# square of its letters. It must not pass 200, from where on the ratio leaves out frequent letters.
PLAIN_LETTERS = 64
# Letters of one side that are compared at a time.
PLAIN_CELLS = 1 << 17

# What match rules look at; records equal in all of these are interchangeable.
CONTENT = ["title_n", "start_dt", "place_n", "lat", "lon"]


# -- similarity ---------------------------------------------------------------


def longest_blocks(codes, a0, la, b0, lb):
    """(i, j, k) of the longest common run of each pair of texts, the earliest in a and then in b of several.

    A text is a start in `codes` and a length, at most 199 letters for b.
    """
    import numpy as np

    def laid(start, length, none):
        at = np.arange(length.max())[:, None]
        letters = codes[np.minimum(start + at, len(codes) - 1)]
        letters[at >= length] = none
        return letters

    a, b = laid(a0, la, 0), laid(b0, lb, 1)
    width, n = b.shape
    # A run's length and where it ends in one number, so that the greatest is the earliest of the longest ones.
    ends = (255 - np.arange(width)).astype(np.uint16)[:, None]
    runs, before = np.zeros((2, width + 1, n), np.uint8)
    same, keys = np.empty((width, n), bool), np.empty((width, n), np.uint16)
    best, at = np.zeros(n, np.uint16), np.zeros(n, np.int64)
    for i, letter in enumerate(a):
        runs, before = before, runs
        np.equal(b, letter, out=same)
        np.add(before[:-1], 1, out=runs[1:])
        np.multiply(runs[1:], same, out=runs[1:])
        np.left_shift(runs[1:], 8, out=keys, dtype=np.uint16)
        np.bitwise_or(keys, ends, out=keys)
        top = keys.max(axis=0)
        longer = top >> 8 > best >> 8
        best[longer], at[longer] = top[longer], i
    k = (best >> 8).astype(np.int64)
    return at - k + 1, 255 - (best & 255).astype(np.int64) - k + 1, k


def plain_ratios(codes, a0, la, b0, lb, least=None, whole: bool = True):
    """Ratcliff-Obershelp ratios of many pairs of texts, as `longest_blocks` takes them; 0 where not above `least`.

    Unless `whole`, a ratio is only as much as it takes to know that it is above.
    Each round finds one block for every stretch that is still open, and opens those before and after it.
    """
    import numpy as np

    a0, la, b0, lb = (np.asarray(x, np.int64) for x in (a0, la, b0, lb))
    total = np.maximum(la + lb, 1)
    matched, most = np.zeros(len(a0), np.int64), np.minimum(la, lb)
    pair = np.arange(len(a0))
    while True:
        open_ = (la > 0) & (lb > 0)
        if least is not None:
            open_ &= 2.0 * most[pair] / total[pair] > least[pair]
        if not whole:
            open_ &= 2.0 * matched[pair] / total[pair] <= least[pair]
        pair, a0, la, b0, lb = (x[open_] for x in (pair, a0, la, b0, lb))
        if not len(pair):
            break
        # Stretches of like length are looked at together.
        order = np.argsort(np.maximum(la, lb), kind="stable")
        pair, a0, la, b0, lb = (x[order] for x in (pair, a0, la, b0, lb))
        found, start = [], 0
        while start < len(pair):
            end = start + max(1, PLAIN_CELLS // int(max(la[start], lb[start])))
            found.append(longest_blocks(codes, *(x[start:end] for x in (a0, la, b0, lb))))
            start = end
        i, j, k = map(np.concatenate, zip(*found))
        np.add.at(matched, pair, k)
        hit = k > 0
        np.subtract.at(most, pair, np.minimum(la, lb) - k)
        pair, a0, la, b0, lb, i, j, k = (x[hit] for x in (pair, a0, la, b0, lb, i, j, k))
        pair, a0, la, b0, lb = (
            np.concatenate(x)
            for x in ((pair, pair), (a0, a0 + i + k), (i, la - i - k), (b0, b0 + j + k), (j, lb - j - k))
        )
        np.add.at(most, pair, np.minimum(la, lb))
    ratios = 2.0 * matched / total
    return ratios if least is None else np.where(ratios > least, ratios, 0.0)


def text_codes(together: str, lengths):
    """(codes, starts, lengths) for `plain_ratios` of texts that stand together; codes 0 and 1 are no letters."""
    import numpy as np

    codes = np.frombuffer(together.encode("utf-32-le"), np.uint32) + np.uint32(2)
    top = int(codes.max()) if len(codes) else 0
    codes = codes.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
    return codes, np.cumsum(lengths) - lengths, lengths


def content(column) -> bytes:
    """What the values of an Arrow column of strings or binaries hold together."""
    import numpy as np

    width = np.int64 if str(column.type).startswith("large") else np.int32
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return b""
    ends = np.frombuffer(ends, width)
    return data.to_pybytes()[ends[column.offset] : ends[column.offset + len(column)]]


def text_ratios(left: list, right: list, least=None, other=None):
    """Ratios of pairs of texts, 0 when either is empty; `other` scores a pair with a long text."""
    import numpy as np

    short = np.array([len(a or "") < PLAIN_LETTERS and len(b or "") < PLAIN_LETTERS for a, b in zip(left, right)], bool)
    out, at = np.zeros(len(short)), np.flatnonzero(short)
    texts = [left[i] or "" for i in at] + [right[i] or "" for i in at]
    codes, start, length = text_codes("".join(texts), np.array([len(t) for t in texts], np.int64))
    out[at] = plain_ratios(codes, start[: len(at)], length[: len(at)], start[len(at) :], length[len(at) :], None if least is None else least[at])
    for i in np.flatnonzero(~short):
        out[i] = other(left[i], right[i]) if least is None else other(left[i], right[i], least[i])
    return out


def similarity_udf():
    """Ratcliff-Obershelp ratio of two strings, 0 when either is empty.

    The argument order matters: (earlier record, later record).
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(a, b):
        from difflib import SequenceMatcher

        import pandas as pd

        seen = {}
        matcher = SequenceMatcher(None)
        current = None

        def long(left, right):
            nonlocal current
            if (left, right) not in seen:
                if not left or not right:
                    seen[left, right] = 0.0
                elif left == right:
                    seen[left, right] = 1.0
                else:
                    if right != current:
                        matcher.set_seq2(right)
                        current = right
                    matcher.set_seq1(left)
                    seen[left, right] = matcher.ratio()
            return seen[left, right]

        return pd.Series(text_ratios(a.tolist(), b.tolist(), other=long), dtype="float64")

    # A filter on it would be moved before the rows are dealt out, and the ratio taken there a second time.
    return ratio.asNondeterministic()


def common_letters(a: str, where: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of a and a text of n letters, given as bits of each letter's places.

    No matching blocks hold more letters.
    """
    full = (1 << n) - 1
    left = full
    for letter in a:
        here = left & where.get(letter, 0)
        left = ((left + here) | (left - here)) & full
    return n - left.bit_count()


def edit_similarity(a, b) -> Column:
    """One less the share of edits in the longer text, a metric of column functions alone.

    What an alignment leaves alone is a common subsequence, so the bounds on the
    Ratcliff-Obershelp ratio hold for it too. Empty texts are like none.
    """
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def rare_places(text: str) -> dict[str, list[int]] | None:
    """Where the letters stand that a matching block of a long later text must hold one of; None for a short one.

    From 200 letters on, letters that make up more than a hundredth of the later text begin no block.
    """
    n = len(text)
    if n < 200:
        return None
    places: dict[str, list[int]] = {}
    for i, letter in enumerate(text):
        places.setdefault(letter, []).append(i)
    return {x: at for x, at in places.items() if len(at) <= n // 100 + 1}


def most_around_rare(a: str, b: str, rare: dict[str, list[int]], enough: float) -> float:
    """At least the letters in matching blocks of a and a long b, as far as it takes to know that they are not enough.

    Every block but one at the very beginning holds a rare letter of b; blocks
    don't overlap, so the longest common runs around all rare places add up to more.
    """
    n, m = len(a), len(b)
    total = 0
    while total < min(n, m) and a[total] == b[total]:
        total += 1
    for letter, places in rare.items():
        own, at = [], a.find(letter)
        while at >= 0:
            own.append(at)
            at = a.find(letter, at + 1)
        for j in places:
            longest = 0
            for i in own:
                x, y = i, j
                while x and y and a[x - 1] == b[y - 1]:
                    x -= 1
                    y -= 1
                p, q = i + 1, j + 1
                while p < n and q < m and a[p] == b[q]:
                    p += 1
                    q += 1
                if p - x > longest:
                    longest = p - x
            total += longest
        if total > enough:
            break
    return total


class BoundedRatio:
    """The Ratcliff-Obershelp ratio where it exceeds a bound, else 0; what is known of the right text is kept for the next call."""

    def __init__(self):
        from difflib import SequenceMatcher

        self.matcher, self.right, self.matched = SequenceMatcher(None), None, False
        self.where: dict[str, int] = {}
        self.rare: dict[str, list[int]] | None = None

    def above(self, left: str, right: str, bound: float) -> float:
        if left == right:
            return 1.0
        needed = bound * (len(left) + len(right)) / 2
        if min(len(left), len(right)) <= needed:
            return 0.0
        if right != self.right:
            self.right, self.matched, self.rare, self.where = right, False, rare_places(right), {}
            if self.rare is None:
                for i, letter in enumerate(right):
                    self.where[letter] = self.where.get(letter, 0) | 1 << i
        if self.rare is None:
            most = common_letters(left, self.where, len(right))
        else:
            most = most_around_rare(left, right, self.rare, needed)
        if most <= needed:
            return 0.0
        if not self.matched:
            self.matcher.set_seq2(right)
            self.matched = True
        self.matcher.set_seq1(left)
        found = self.matcher.ratio()
        return found if found > bound else 0.0


def bounded_similarity_udf():
    """The ratio of `similarity_udf` where it exceeds the third argument, else 0."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a, b, least):
        import pandas as pd

        return pd.Series(text_ratios(a.tolist(), b.tolist(), least.to_numpy(), BoundedRatio().above), dtype="float64")

    # See `similarity_udf`.
    return ratio.asNondeterministic()


def few_edits(a: str, b: str, least: str) -> Column:
    """Necessary condition for a ratio of short texts > least: at most as many edits as unmatched characters, S - 2M."""
    total = f"(length({a}) + length({b}))"
    edits = f"cast(ceil((1D - {least}) * {total}) - 1 as int)"
    return F.expr(f"{total} > {2 * SHORT_TITLE} OR levenshtein({a}, {b}, {edits}) >= 0")


# -- blocked join -------------------------------------------------------------


@dataclass
class Blocks:
    """Sizes of blocks. `hot` lists those to be split; None when no block is."""

    rows: int
    pairs: float
    hot: DataFrame | None
    long_pairs: float = 0.0


def block_sizes(blocks: DataFrame, hot_rows: int | None = None) -> Blocks:
    """Sizes of the blocks of rows in column `blk`; `long`, if there, says which have long titles.

    At most 10,000 blocks can hold more than a 10,000th of all rows, so `hot`
    is small enough to broadcast at any scale, and none is split into more parts.
    """
    long = F.count_if("long") if "long" in blocks.columns else F.lit(0).cast("bigint")
    sizes = blocks.groupBy("blk").agg(F.count("*").alias("n"), long.alias("long"))
    n = F.col("n").cast("double")
    row = sizes.agg(F.sum("n").alias("rows"), F.sum(n * n).alias("pairs"), F.max("n").alias("largest"), F.sum(n * F.col("long")).alias("long_pairs")).first()
    rows, largest = row["rows"] or 0, row["largest"] or 0
    limit = max(hot_rows or HOT_BLOCK_ROWS, rows // 10_000)
    hot = None
    if largest > limit:
        hot = sizes.filter(F.col("n") > limit).select("blk", "n", "long")
    return Blocks(rows, row["pairs"] or 0.0, hot, row["long_pairs"] or 0.0)


# -- records ------------------------------------------------------------------


def match_features(
    canonical: DataFrame, ref_date: datetime.date, relaxed_dates: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(rank, *keep, url, title_n, start_dt, place_n, lat, lon) of canonical records.

    A missing longitude counts as 0; unparsable coordinates give no position.
    """
    place = F.when(F.col("city") != "", F.col("city")).otherwise(F.col("venue_name"))
    lat = to_degrees(F.col("latitude"))
    lon = to_degrees(F.when(F.col("longitude") == "", F.lit("0")).otherwise(F.col("longitude")))
    return canonical.select(
        "rank",
        *keep,
        "url",
        normalize_title(F.col("title")).alias("title_n"),
        parse_any_date(F.col("start_date"), ref_date, relaxed_dates).alias("start_dt"),
        normalize_location(place).alias("place_n"),
        F.when(lon.isNotNull(), lat).alias("lat"),
        F.when(lat.isNotNull(), lon).alias("lon"),
    )


def words_of(letters, lengths):
    """`title_words` of texts whose letters stand together."""
    import numpy as np

    def mixed(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    letters = letters.astype(np.uint64)
    row = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    words = np.zeros((len(lengths), TITLE_WORDS + 1), np.uint64)
    flat, width, one = words.reshape(-1), np.uint64(TITLE_WORDS + 1), np.uint64(1)
    np.bitwise_or.at(flat, (row * width).astype(np.int64), one << (mixed(letters) & np.uint64(63)))
    # A letter takes 21 bits, which leaves 22 for the row.
    keys = row << np.uint64(42) | letters << np.uint64(21)
    keys = np.sort((keys[:-1] | letters[1:])[row[1:] == row[:-1]])
    at = np.arange(len(keys))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
    hashes = mixed(mixed(keys & np.uint64((1 << 42) - 1)) + (at - first).astype(np.uint64))
    place = (keys >> np.uint64(42)) * width + one + (hashes >> np.uint64(8)) % np.uint64(TITLE_WORDS)
    np.bitwise_or.at(flat, place.astype(np.int64), one << (hashes & np.uint64(63)))
    return words


def portions(lengths):
    """(first, last + 1) of consecutive texts with about TITLE_LETTERS letters."""
    import numpy as np

    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TITLE_LETTERS)))
        yield start, end
        start = end


def title_words(titles):
    """Bit masks of each title's letters (the first) and of its numbered pairs of letters (the others), a row per title."""
    import numpy as np

    out, held, size = [np.zeros((0, TITLE_WORDS + 1), np.uint64)], [], 0

    def of_texts(texts):
        return words_of(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), [len(t) for t in texts])

    for title in titles:
        held.append(title or "")
        size += len(held[-1])
        if size > TITLE_LETTERS:
            out.append(of_texts(held))
            held, size = [], 0
    return np.concatenate([*out, of_texts(held)] if held else out)


def telling_words(codes, starts, lengths):
    """A mask of 64 bits for each of some texts of fewer than 64 letters, and how many of its letters the mask leaves out.

    The second time that a letter occurs it counts as another one, and so on. A
    bit stands for one of these, those that tell most of the texts apart; of what
    is left out two texts share at most as much as either has.
    """
    import numpy as np

    items, counts = [], np.zeros(256 * 64, np.int64)
    # Letters taken for the same one only allow more.
    folded = codes if codes.dtype == np.uint8 else (codes % 251).astype(np.uint8)
    for low, high in portions(lengths):
        own = lengths[low:high]
        row = np.repeat(np.arange(high - low, dtype=np.uint32), own)
        within = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        keys = np.sort(row << np.uint32(8) | folded[np.repeat(starts[low:high], own) + within])
        at = np.arange(len(keys))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
        items.append(((keys & np.uint32(255)) << np.uint32(6) | nth.astype(np.uint32)).astype(np.uint16))
        counts += np.bincount(items[-1], minlength=len(counts))
    best = np.argsort(-counts * (len(lengths) - counts), kind="stable")[:64]
    bit = np.zeros(len(counts), np.uint64)
    bit[best] = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.zeros(len(lengths), np.uint64)
    for (low, high), own in zip(portions(lengths), items):
        some = lengths[low:high] > 0
        first = (np.cumsum(lengths[low:high]) - lengths[low:high])[some]
        if len(first):
            masks[low:high][some] = np.bitwise_or.reduceat(bit[own], first)
    return masks, lengths - np.bitwise_count(masks)


def title_bits_udf():
    """`title_words` as an array of numbers."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bits(titles):
        import numpy as np
        import pandas as pd

        return pd.Series(list(title_words(titles).view(np.int64)), dtype=object)

    return bits


def packed_bits_udf():
    """`title_words` as bytes, NULL for NULL."""

    @F.pandas_udf(T.BinaryType())
    def bits(titles):
        import pandas as pd

        out, at = [None] * len(titles), [i for i, t in enumerate(titles) if t is not None]
        for i, w in zip(at, title_words([titles.iloc[i] for i in at])):
            out[i] = w.tobytes()
        return pd.Series(out, dtype=object)

    return bits


def with_title(feats: DataFrame) -> DataFrame:
    """Features with the title itself or, of a long one, its id and signature: what goes from block to block is bounded.

    The signature is a mask of its letters and TITLE_WORDS words of its pairs of
    letters; every further time that a pair occurs it counts as another one.
    Titles that are not long get theirs where they meet.
    """
    long = F.when(F.length("title_n") >= PLAIN_LETTERS, F.col("title_n"))
    return feats.withColumns({
        "t_len": F.length("title_n"), "title_id": F.unhex(F.md5(long)), "t_bits": packed_bits_udf()(long),
        "t_text": F.when(F.length("title_n") < PLAIN_LETTERS, F.col("title_n")),
    })


def titles_of(feats: DataFrame) -> DataFrame:
    """(title_id, title_n) of every title once."""
    titles = feats.select(F.coalesce("t_text", "title_n").alias("title_n")).filter("title_n <> ''").distinct()
    return titles.select(F.unhex(F.md5("title_n")).alias("title_id"), "title_n")


def asked_titles(nodes: DataFrame, metric=None) -> DataFrame:
    """The titles that pairs are joined to, written: all for a metric, else long ones and those that may match a long one."""
    if metric is None:
        some = not nodes.filter("t_text is null").isEmpty()
        # No rule asks for less than NEARBY_SIM.
        nodes = nodes.filter(F.col("t_len") * ((2 - NEARBY_SIM) / NEARBY_SIM) >= PLAIN_LETTERS) if some else nodes.filter("false")
    return cut_lineage(titles_of(nodes))


TITLE = ["title_id", "t_len", "t_bits", "t_text"]


def _cell(degrees: str, more: str = "") -> str:
    return f"cast(floor(({degrees}{more}) / {CELL_DEGREES}D) as bigint)"


def _day(more: str = "") -> str:
    return f"cast(floor((unix_date(start_dt){more}) / {DAY_STEP}) as int)"


def _own_blocks(df: DataFrame) -> DataFrame:
    """One row per record and block it lives in; a block without all its parts is NULL."""
    blocks = f"""
        array(
            concat('d:', {_day()}),
            if(place_n <> '', concat('p:', place_n), null),
            concat('g:', {_cell("lat")}, '/', {_cell("lon")})
        )"""
    return df.filter("t_len > 0").withColumn("blk", F.expr(f"explode(array_compact({blocks}))"))


def sizes_of(nodes: DataFrame, hot_rows: int | None = None) -> Blocks:
    return block_sizes(_own_blocks(nodes).select("blk", F.col("t_text").isNull().alias("long")), hot_rows)


def _earlier_blocks(df: DataFrame, places: DataFrame) -> DataFrame:
    """Blocks in which an earlier record looks for later ones, with the rule that it asks there.

    The days around its date, the names similar to its place, the cells around its position.
    """
    # A little more than the rules ask, so that rounding loses no cell.
    edge = f"{GEO_KM / KM_PER_DEGREE * 1.001}D"
    days = f"sequence({_day(f' - {TITLE_DATE_DAYS}')}, {_day(f' + {TITLE_DATE_DAYS}')})"
    rows, columns = (f"sequence({_cell(c, f' - {edge}')}, {_cell(c, f' + {edge}')})" for c in ("lat", "lon"))
    around = f"""concat(
        if(start_dt is null, array(), transform({days}, d -> named_struct('blk', concat('d:', d), 'asks', 'd'))),
        if(lat is null, array(), flatten(transform({rows}, y -> transform({columns}, x -> named_struct('blk', concat('g:', y, '/', x), 'asks', 'g'))))))"""
    titled = df.filter("t_len > 0")
    here = titled.withColumn("_b", F.expr(f"explode({around})")).select(*df.columns, "_b.*")
    named = titled.join(places.select(F.col("place_l").alias("place_n"), "place_r"), "place_n").select(
        *df.columns, F.concat(F.lit("p:"), "place_r").alias("blk"), F.lit("p").alias("asks")
    )
    return here.unionByName(named)


def day_distance(a: Column, b: Column) -> Column:
    """Whole days between two dates, 999 when either is unknown."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(999))


def geo_close(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Closer than 5 km, taking every degree as 111 km; false without positions."""
    km = F.sqrt(F.pow(lat1 - lat2, F.lit(2)) + F.pow(lon1 - lon2, F.lit(2))) * KM_PER_DEGREE
    return F.coalesce(km < GEO_KM, F.lit(False))


# A condition of `candidate_pairs`: a column of the earlier side, a comparison, a column of the later side.
LATER = (("rank", "<", "rank"),)
ASKED_SIM = {"d": TITLE_DATE_SIM, "p": TITLE_PLACE_SIM, "g": NEARBY_SIM}
# Sides of a cell: earlier rows by the kind of block, then later ones.
KINDS = ("d", "p", "g")
LATER_SIDE = len(KINDS)


def cells_a_side(n: Column) -> Column:
    """How many cells a side the grid of a block of n rows has."""
    return F.greatest(F.ceil(n / CELL_ROWS), F.least(F.ceil(n / SPREAD_ROWS), F.lit(SPREAD).cast("bigint"))).cast("int")


def cells_of(n: Column, long: Column) -> Column:
    """How many cells a side a block of n rows has, `long` of them with long titles."""
    return F.greatest(F.ceil(n / PLAIN_ROWS).cast("int"), cells_a_side(long))


def in_cells(blocks: DataFrame, side: int, hot: DataFrame | None) -> DataFrame:
    """Add `cell`: a block, or for a hot one each cell of its grid that rows of this side stand in."""
    if hot is None:
        return blocks.withColumn("cell", F.col("blk"))
    own, others = F.pmod(F.xxhash64(F.lit("cell"), "rank"), F.col("splits")).cast("string"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
    split = blocks.join(F.broadcast(hot), "blk", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    split = split.withColumn("_own", own).withColumn("_other", others)
    cell = ("_own", "_other") if side == 0 else ("_other", "_own")
    return split.withColumn("cell", F.concat_ws("/", *cell, "blk")).drop("splits", "_own", "_other")


def set_places(flags):
    """Where few of many flags are set."""
    import numpy as np

    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    at = np.flatnonzero(flags[:whole].reshape(-1, 8)[some].ravel())
    found = some[at >> 3] * 8 + (at & 7)
    return np.append(found, whole + np.flatnonzero(flags[whole:])) if whole < len(flags) else found


class Compared:
    """Pairs of rows of the same cell that may match, cell by cell; see `candidate_pairs`."""

    def __init__(self, rows, ops: list[str], least: float | None = None):
        import numpy as np

        column = {c: rows.column(c) for c in rows.schema.names}
        self.rows, self.ops, self.least = rows, ops, least
        self.values = [column[f"_v{n}"].to_numpy() for n in range(len(ops))]
        self.length = column["t_len"].to_numpy().astype(np.float64)
        self.plain = column["t_text"].is_valid().to_numpy(zero_copy_only=False)
        self.text = content(column["t_text"]).decode()
        self.texts = text_codes(self.text, np.where(self.plain, self.length, 0).astype(np.int64))
        self.day = column["_day"].to_numpy(zero_copy_only=False).astype(np.float64)
        self.at = [column[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("lat", "lon")]
        self.side = column["_side"].to_numpy()

    @cached_property
    def bits(self):
        """`title_words` of all rows."""
        import numpy as np

        out = np.empty((len(self.plain), TITLE_WORDS + 1), np.uint64)
        out[~self.plain] = np.frombuffer(content(self.rows.column("t_bits")), np.uint64).reshape(-1, TITLE_WORDS + 1)
        letters, lengths, at = np.frombuffer(self.text.encode("utf-32-le"), np.uint32), self.texts[2][self.plain], np.flatnonzero(self.plain)
        starts = np.cumsum(lengths) - lengths
        for low, high in portions(lengths):
            out[at[low:high]] = words_of(letters[starts[low] : starts[high - 1] + lengths[high - 1]], lengths[low:high])
        return out

    @cached_property
    def words(self):
        return self.bits[:, 1:]

    @cached_property
    def letters_free(self):
        """What the mask of letters does not account for."""
        import numpy as np

        return self.length - np.bitwise_count(self.bits[:, 0])

    @cached_property
    def pairs_free(self):
        """What the masks of pairs of letters do not account for."""
        import numpy as np

        return self.length - np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)

    @cached_property
    def folded(self):
        """Fewer bits, which allow more: what they reject, all of them would."""
        import numpy as np

        return [np.bitwise_or.reduce(self.words[:, w::FOLDED_WORDS], axis=1) for w in range(FOLDED_WORDS)]

    @cached_property
    def folded_free(self):
        import numpy as np

        return self.length - sum(np.bitwise_count(f).astype(np.float64) for f in self.folded)

    def tiles(self, ends: list[int]):
        """(earlier rows, later rows) that may match; a cell ends before each of `ends`."""
        import numpy as np

        few, size = [], 0
        start = 0
        for end in ends:
            left = start + np.flatnonzero(self.side[start:end] != LATER_SIDE)
            right = start + len(left) + np.arange(end - start - len(left))
            start = end
            if not len(left) or not len(right):
                continue
            for pairs in self._cell(left, right):
                few.append(pairs)
                size += len(pairs[0])
                if size > TILE_PAIRS:
                    yield tuple(map(np.concatenate, zip(*few)))
                    few, size = [], 0
        if few:
            yield tuple(map(np.concatenate, zip(*few)))

    def _cell(self, left, right):
        import numpy as np

        if len(left) * len(right) <= 2048:
            yield np.repeat(left, len(right)), np.tile(right, len(left))
            return
        asks = KINDS[self.side[left[0]]]
        if asks != "g" or self.least is not None:
            yield from self._by_kind(left, right, ASKED_SIM[asks] if self.least is None else self.least, TITLE_DATE_DAYS if asks == "d" else None)
            return
        # Positions ask for less on days next to each other.
        yield from self._next_days(left, right)
        for a, b in self._by_kind(left, right, TITLE_PLACE_SIM, None):
            apart = ~(np.abs(self.day[a] - self.day[b]) <= NEARBY_DAYS)
            yield a[apart], b[apart]

    def _next_days(self, left, right):
        """Pairs at most NEARBY_DAYS apart."""
        import numpy as np

        left, right = (x[~np.isnan(self.day[x])] for x in (left, right))
        right = right[np.argsort(self.day[right], kind="stable")]
        days = self.day[right]
        low = np.searchsorted(days, self.day[left] - NEARBY_DAYS)
        n = np.searchsorted(days, self.day[left] + NEARBY_DAYS, "right") - low
        left, low, n = left[n > 0], low[n > 0], n[n > 0]
        ends, i = np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TILE_PAIRS)))
            many = n[i:j]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            for k in range(0, len(within), TILE_PAIRS):
                part = slice(k, k + TILE_PAIRS)
                yield np.repeat(left[i:j], many)[part], right[(np.repeat(low[i:j], many) + within)[part]]
            i = j

    def _by_kind(self, left, right, least: float, days: int | None):
        """Titles that are not long by the better of two masks, others by pairs of letters."""
        plain, long = [x[self.plain[x]] for x in (left, right)], [x[~self.plain[x]] for x in (left, right)]
        for l, r, both in ((plain[0], plain[1], True), (long[0], right, False), (plain[0], long[1], False)):
            if not len(l) or not len(r):
                continue
            told = self._told(l, r, least) if both else None
            yield from self._large(l, r, least) if told is None else self._telling(l, r, least, days, *told)

    def _told(self, left, right, least: float):
        """`telling_words` of rows, unless masks of pairs of letters let so much less through that they cost less."""
        import numpy as np

        codes, start, length = self.texts
        both = np.concatenate([left, right])
        masks, free = telling_words(codes, start[both], length[both])
        masks, free = (np.split(x, [len(left)]) for x in (masks, free))
        rng = np.random.default_rng(0)
        i, j = (rng.integers(0, len(x), TRIED_PAIRS) for x in (left, right))
        total = least * (self.length[left[i]] + self.length[right[j]])
        passed = 2 * (np.minimum(free[0][i], free[1][j]) + np.bitwise_count(masks[0][i] & masks[1][j])) > total
        if passed.mean() * PASSED_COST > FOLDED_WORDS - 1:
            a, b = left[i], right[j]
            shared = sum(np.bitwise_count(f[a] & f[b]).astype(np.int64) for f in self.folded) + np.minimum(self.folded_free[a], self.folded_free[b])
            if (passed.mean() - (2 * shared > 3 * total - 2 * total / least).mean()) * PASSED_COST > FOLDED_WORDS - 1:
                return None
        return masks, free

    def _telling(self, left, right, least: float, days: int | None, masks, free):
        """Pairs of rows by their `telling_words`, many equally demanding rows of the left at a time."""
        import numpy as np

        # 2 * shared has to exceed what the left and what the right ask for, each with half of what its mask leaves out.
        asked = [least * self.length[x] - f for x, f in zip((left, right), free)]
        near = [self.day[x] if days is not None else np.zeros(len(x)) for x in (left, right)]
        # Ordered by day and by what the first condition compares, whole tiles fail.
        orders = [np.lexsort((*(v[right] for v in self.values[:1]), near[1])), np.lexsort((*(v[left] for v in self.values[:1]), near[0], asked[0]))]
        right, masks_r, asked_r, near_r = (x[orders[0]] for x in (right, masks[1], asked[1], near[1]))
        left, masks_l, asked_l, near_l = (x[orders[1]] for x in (left, masks[0], asked[0], near[0]))
        width = min(-(-len(right) // 8) * 8, 4096)
        height = max(1, 2 * TILE_PAIRS // width)
        # Tiles of the left: their beginnings and ends, the days and the values in them.
        new = np.flatnonzero(np.diff(asked_l, prepend=np.nan) != 0)
        lows = np.concatenate([np.arange(low, high, height) for low, high in zip(new, [*new[1:], len(left)])])
        highs = np.append(lows[1:], len(left))
        span = lambda x: (np.minimum.reduceat(x, lows), np.maximum.reduceat(x, lows))
        first_day, last_day = span(near_l)
        values_l = [span(v[left]) for v in self.values]
        room = width * height
        both, bits, hits = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool)
        for j in range(0, len(right), width):
            r, words, near = right[j : j + width], masks_r[j : j + width], near_r[j : j + width]
            open_ = np.ones(len(lows), bool)
            if days is not None:
                open_ &= (first_day - days <= near[-1]) & (last_day + days >= near[0])
            for op, (low, high), v in zip(self.ops, values_l, self.values):
                if op == "<":
                    open_ &= low < v[r].max()
                elif op == ">=":
                    open_ &= high >= v[r].min()
            asked = None
            for low, high in zip(lows[open_].tolist(), highs[open_].tolist()):
                if asked_l[low] != asked:
                    asked = asked_l[low]
                    # Rounded so that none is rejected that may match.
                    needed = np.clip(np.floor((asked + asked_r[j : j + width] - 1e-6) / 2) + 1, 0, 255).astype(np.uint8)
                size = (high - low) * len(r)
                x, n, ok = (array[:size].reshape(high - low, len(r)) for array in (both, bits, hits))
                np.bitwise_and(masks_l[low:high, None], words, out=x)
                np.bitwise_count(x, out=n)
                np.greater_equal(n, needed, out=ok)
                found = set_places(hits[:size])
                if len(found):
                    a, b = np.divmod(found, len(r))
                    yield left[low + a], r[b]

    def _large(self, left, right, least: float):
        import numpy as np

        # Ordered by what the first condition compares, whole tiles fail it.
        left, right = (x[np.argsort(self.values[0][x], kind="stable")] if self.values else x for x in (left, right))
        scale = 1.5 * least - 1
        width = min(len(right), 4096)
        height = min(len(left), max(1, TILE_PAIRS // width))
        kind = np.int16 if max(self.length[left].max(), self.length[right].max()) < 8000 else np.int32
        both, hits = np.empty((height, width), np.uint64), np.empty((height, width), bool)
        bits, more, most = np.empty((height, width), np.uint8), np.empty((height, width), np.uint8), np.empty((height, width), kind)
        for j in range(0, len(right), width):
            r = right[j : j + width]
            # Rounded down on both sides, so that none is rejected that may match.
            free_r, needed_r = self.folded_free[r].astype(kind), np.floor(scale * self.length[r]).astype(kind)
            words_r = [f[r] for f in self.folded]
            for i in range(0, len(left), height):
                at = left[i : i + height]
                if any(self._never(op, v[at], v[r]) for op, v in zip(self.ops, self.values)):
                    continue
                x, one, two, sums, ok = (array[: len(at), : len(r)] for array in (both, bits, more, most, hits))
                for n, (f, word) in enumerate(zip(self.folded, words_r)):
                    np.bitwise_and(f[at, None], word, out=x)
                    np.bitwise_count(x, out=two if n else one)
                    if n:
                        np.add(one, two, out=one)
                np.minimum(self.folded_free[at].astype(kind)[:, None], free_r, out=sums)
                np.subtract(sums, needed_r, out=sums)
                np.add(sums, one, out=sums)
                np.greater(sums, np.floor(scale * self.length[at]).astype(kind)[:, None], out=ok)
                a, b = np.divmod(np.flatnonzero(ok), len(r))
                if len(a):
                    yield at[a], r[b]

    @staticmethod
    def _never(op: str, left, right) -> bool:
        return left.min() >= right.max() if op == "<" else left.max() < right.min() if op == ">=" else False

    def hold(self, a, b):
        """Which pairs may match, and the ratio that they have to exceed."""
        import numpy as np

        test = {"<": np.less, ">=": np.greater_equal, "!=": np.not_equal}
        ok = np.ones(len(a), bool)
        for op, v in zip(self.ops, self.values):
            ok &= test[op](v[a], v[b])
        a, b = a[ok], b[ok]
        if self.least is None:
            asks = self.side[a]
            days = np.nan_to_num(np.abs(self.day[a] - self.day[b]), nan=999.0)
            north, east = (x[a] - x[b] for x in self.at)
            near = np.sqrt(north * north + east * east) * KM_PER_DEGREE < GEO_KM
            d, p = KINDS.index("d"), KINDS.index("p")
            least = np.where(asks == d, TITLE_DATE_SIM, np.where((asks == p) | (days > NEARBY_DAYS), TITLE_PLACE_SIM, NEARBY_SIM))
            ok = np.where(asks == d, days <= TITLE_DATE_DAYS, (asks == p) | near)
        else:
            least, ok = np.full(len(a), self.least), np.ones(len(a), bool)
        total = self.length[a] + self.length[b]
        ok &= 2 * np.minimum(self.length[a], self.length[b]) > least * total
        a, b, least, total = a[ok], b[ok], least[ok], total[ok]
        if not len(a):
            return a, b, least
        # With S letters together, 2M > least * S. M letters in k blocks hold M - k pairs of letters in common, and blocks are
        # separated by unmatched letters, so k <= 1 + S - 2M; hence 3M <= S + 1 + shared pairs, and a mask leaves out at least one.
        pairs = np.minimum(self.pairs_free[a], self.pairs_free[b])
        pairs += np.bitwise_count(self.words[a] & self.words[b]).sum(axis=1, dtype=np.int64)
        ok = 2 * (pairs + total) > 3 * least * total
        a, b, least, total = a[ok], b[ok], least[ok], total[ok]
        letters = np.minimum(self.letters_free[a], self.letters_free[b]) + np.bitwise_count(self.bits[a, 0] & self.bits[b, 0])
        ok = 2 * letters > least * total
        return a[ok], b[ok], least[ok]

    def scored(self, a, b, least):
        """The pairs without those whose titles, both of them here, are too different; and which are known to match."""
        import numpy as np

        codes, start, length = self.texts
        known = self.plain[a] & self.plain[b]
        at = np.flatnonzero(known)
        match = np.ones(len(a), bool)
        match[at] = plain_ratios(codes, start[a[at]], length[a[at]], start[b[at]], length[b[at]], least[at], False) > 0
        return a[match], b[match], least[match], known[match]

    def ids(self, rows, wanted):
        """An Arrow column with the title's id of each row that is wanted."""
        import hashlib

        import numpy as np
        import pyarrow as pa

        once, where = np.unique(rows[wanted], return_inverse=True)
        _, start, length = self.texts
        known = self.rows.column("title_id")
        made = [hashlib.md5(self.text[start[i] : start[i] + length[i]].encode()).digest() if self.plain[i] else known[i].as_py() for i in once.tolist()]
        at = np.zeros(len(rows), np.int64)
        at[wanted] = where
        return pa.array(made, pa.binary()).take(pa.array(at, mask=~wanted))


def _compare(ops: list[str], plain: bool = True, least_of_all: float | None = None):
    """For mapInArrow over rows sorted by cell and side: pairs (l, r, _a, _b, _least, _known), see `candidate_pairs`. One cell is in memory at a time, and a tile of pairs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def pairs_in(rows, ends):
            rows = rows.combine_chunks().to_batches()[0] if rows.num_rows else None
            if rows is None:
                return
            compared = Compared(rows, ops, least_of_all)
            for a, b in compared.tiles(ends):
                a, b, least = compared.hold(a, b)
                known = np.zeros(len(a), bool)
                if plain:
                    a, b, least, known = compared.scored(a, b, least)
                if len(a):
                    out = [rows.column("l").take(pa.array(a)), rows.column("r").take(pa.array(b)), *(compared.ids(x, ~known) for x in (a, b)), pa.array(least), pa.array(known)]
                    yield pa.RecordBatch.from_arrays(out, ["l", "r", "_a", "_b", "_least", "_known"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            cell = batch.column("cell")
            if len(held) > 1 and held[-2].column("cell")[-1].as_py() == cell[len(cell) - 1].as_py():
                # Still the same cell.
                continue
            rows = pa.Table.from_batches(held)
            cells = rows.column("cell").combine_chunks()
            new = pc.not_equal(cells[1:], cells[:-1]).to_numpy(zero_copy_only=False)
            ends = (np.flatnonzero(new) + 1).tolist()
            if not ends:
                continue
            yield from pairs_in(rows.slice(0, ends[-1]), ends)
            held = rows.slice(ends[-1]).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            cells = rows.column("cell").combine_chunks()
            new = pc.not_equal(cells[1:], cells[:-1]).to_numpy(zero_copy_only=False)
            yield from pairs_in(rows, [*(np.flatnonzero(new) + 1).tolist(), rows.num_rows])

    return run


def candidate_pairs(
    earlier: DataFrame, later: DataFrame, places: DataFrame, sizes: Blocks, extra: tuple, keep: list[Column], carry: list[str] | None = None,
    plain: bool = True,
) -> DataFrame:
    """Pairs that may match: `keep`, the ids of the titles, the ratio to exceed, and whether it is known to be exceeded.

    It is known of titles that are not long, if `plain`.

    Both sides hold the columns of `match_features` but the title, and `with_title`.
    `extra` lists further conditions on bigint columns of l and r, like `LATER`;
    `carry` names the columns of either side that `keep` looks at, by default all.
    """
    found = cell_pairs(_earlier_blocks(earlier, places), _own_blocks(later), sizes, extra, carry, plain)
    return found.select(*keep, "_a", "_b", "_least", "_known")


def cell_pairs(
    earlier: DataFrame, later: DataFrame, sizes: Blocks, extra: tuple = (), carry: list[str] | None = None, plain: bool = True, least: float | None = None
) -> DataFrame:
    """(l, r, _a, _b, _least, _known) of the pairs in column `blk` that may match, see `candidate_pairs`; with `least` by that ratio alone."""
    hot = None if sizes.hot is None else sizes.hot.select("blk", cells_of(F.col("n"), F.col("long")).alias("splits")).filter("splits > 1")
    rows = []
    for side, (blocks, own) in enumerate(((earlier, "l"), (later, "r"))):
        carried = [c for c in blocks.columns if c not in ("title_n", "blk", "asks", *TITLE) and (carry is None or c in carry)]
        kind = F.lit(LATER_SIDE) if side else F.array_position(F.array(*map(F.lit, KINDS)), F.col("asks")).cast("int") - 1
        # Only blocks of positions look at positions, and those of places at no dates.
        of = lambda k: F.col("blk").startswith(f"{k}:")
        seen = [F.when(~of("p"), F.unix_date("start_dt")).alias("_day"), *[F.when(of("g"), F.col(c)).alias(c) for c in ("lat", "lon")]]
        rows.append(
            in_cells(blocks, side, hot).select(
                "cell", kind.alias("_side"), *TITLE, *seen,
                *[F.col(x[2 * side]).cast("bigint").alias(f"_v{n}") for n, x in enumerate(extra)],
                F.struct(*carried).alias(own),
            )
        )
    work = sizes.long_pairs / CELL_PAIRS + sizes.pairs / PLAIN_PAIRS
    tasks = max(int(earlier.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work))
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).repartition(tasks, "cell").sortWithinPartitions("cell", "_side")
    kinds = [f"{own} {df.schema[own].dataType.simpleString()}" for own, df in zip("lr", rows)]
    return both.mapInArrow(_compare([x[1] for x in extra], plain, least), ", ".join([*kinds, "_a binary", "_b binary", "_least double", "_known boolean"]))


# -- places -------------------------------------------------------------------


def similar_places(places: DataFrame, threshold: float = PLACE_SIM, metric=None, hot_rows: int | None = None) -> DataFrame:
    """Ordered pairs (place_l, place_r) of similar distinct place names, each with itself.

    The lengths of two similar names differ by a bounded factor, so they lie in
    bands of length at most two apart. Names of two bands are compared as titles of a block are.
    """
    factor = ((2 - threshold) / threshold) ** 0.5
    names = places.select(F.col("place_n").alias("title_n")).filter("title_n <> ''").distinct()
    names = with_title(names.withColumn("rank", F.xxhash64("title_n"))).withColumn("band", F.floor(F.log(factor, F.col("t_len"))))
    # What a row of this table goes by in the comparison, beside its name.
    none = {"start_dt": F.lit(None).cast("date"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}
    names = cut_lineage(names.withColumnRenamed("title_n", "place")).withColumns(none)
    # A block is a pair of bands, so that no task has most of the names.
    own, others = F.col("band").cast("string"), F.array(*[(F.col("band") + n).cast("string") for n in range(-2, 3)])
    left = names.withColumn("blk", F.explode(F.transform(others, lambda x: F.concat_ws("/", own, x))))
    right = names.withColumn("blk", F.explode(F.transform(others, lambda x: F.concat_ws("/", x, own))))
    sizes = block_sizes(left.select("blk", F.col("t_text").isNull().alias("long")), hot_rows)
    left = left.withColumn("asks", F.lit("p"))
    found = cell_pairs(left, right, sizes, carry=["place"], plain=metric is None, least=threshold)
    found = found.select(F.col("l.place").alias("place_l"), F.col("r.place").alias("place_r"), "_known")
    if metric is None:
        found = cut_lineage(found)
    sure = found.filter("_known").drop("_known")
    open_ = found.filter("NOT _known").drop("_known").filter(few_edits("place_l", "place_r", f"{threshold}D"))
    sim = metric("place_l", "place_r") if metric else bounded_similarity_udf()("place_l", "place_r", F.lit(threshold))
    open_ = open_.withColumn("_sim", sim).filter(F.col("_sim") > threshold).drop("_sim")
    return sure.unionByName(open_)


# -- matches ------------------------------------------------------------------


def matching_pairs(
    earlier: DataFrame,
    later: DataFrame,
    places: DataFrame,
    sizes: Blocks,
    titles: DataFrame,
    metric=None,
    extra: tuple = LATER,
    keep: list[Column] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Rows `keep` of the pairs that match by title; a pair may show up in several blocks.

    By default l comes before r. Each pair of different long titles is scored
    once, however many records have them; so is each pair for a `metric`.
    """
    if keep is None:
        keep, carry = [F.col("l.rank").alias("src"), F.col("r.rank").alias("dst")], ["rank"]
    found = cut_lineage(candidate_pairs(earlier, later, places, sizes, extra, keep, carry, metric is None))
    kept = [c for c in found.columns if c not in ("_a", "_b", "_least", "_known")]
    sure = found.filter("_known OR _a = _b").select(*kept)
    open_ = found.filter("NOT _known AND _a <> _b")
    differ = open_.groupBy("_a", "_b").agg(F.min("_least").alias("_least"))
    text = lambda s: titles.select(F.col("title_id").alias(f"_{s}"), F.col("title_n").alias(f"_title_{s}"))
    # Pairs are few bytes and much work, so they are dealt out before the last text comes to them.
    many = open_.count()
    if not many:
        return sure
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // SCORED_PAIRS)
    asked = differ.join(text("a"), "_a").repartition(tasks, "_b").join(text("b"), "_b")
    asked = asked.filter(few_edits("_title_a", "_title_b", "_least")).sortWithinPartitions("_b")
    sim = metric("_title_a", "_title_b") if metric else bounded_similarity_udf()("_title_a", "_title_b", "_least")
    scored = asked.withColumn("_sim", sim).filter("_sim > _least").select("_a", "_b", "_sim")
    return sure.unionByName(open_.join(scored, ["_a", "_b"]).filter("_sim > _least").select(*kept))


class Rules:
    """The match rules for two records at a time, on values as a merged record shows them."""

    def __init__(self):
        self.ratio = BoundedRatio()
        self.known: dict[tuple[str, str, float], bool] = {}

    @staticmethod
    def features(row: dict) -> tuple:
        """(url, title, date, place, position) of a merged record."""
        lat, lon = (_degrees(row[c] or more) for c, more in (("latitude", ""), ("longitude", "0")))
        try:
            day = datetime.date.fromisoformat(row["start_date"])
        except ValueError:
            day = None
        place = (row["city"] or row["venue_name"]).strip(" ")
        return row["url"].strip(" "), row["title"].strip(" "), day, place, None if lat is None or lon is None else (lat, lon)

    def similar(self, left: str, right: str, least: float) -> bool:
        if not left or not right:
            return False
        key = (left, right, least)
        if key not in self.known:
            self.known[key] = self.ratio.above(left, right, least) > least
        return self.known[key]

    def match(self, one: tuple, other: tuple) -> bool:
        """Whether the earlier record matches the later one."""
        url, title, day, place, at = one
        if url and url == other[0]:
            return True
        days = abs((day - other[2]).days) if day and other[2] else 999
        near = False
        if at and other[4]:
            north, east = at[0] - other[4][0], at[1] - other[4][1]
            near = (north * north + east * east) ** 0.5 * KM_PER_DEGREE < GEO_KM
        if near and days <= NEARBY_DAYS:
            return self.similar(title, other[1], NEARBY_SIM)
        if days <= TITLE_DATE_DAYS:
            return self.similar(title, other[1], TITLE_DATE_SIM)
        return self.similar(title, other[1], TITLE_PLACE_SIM) and (near or self.similar(place, other[3], PLACE_SIM))


def _degrees(text: str) -> float | None:
    return float(text) if re.fullmatch(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) else None


def with_evidence(pairs: DataFrame, metric=None) -> DataFrame:
    """Pairs of records that match (columns ending in _l and _r) with the rule that holds first and what it saw."""
    metric = metric or similarity_udf()
    same_url = (F.col("url_l") != "") & (F.col("url_l") == F.col("url_r"))
    title, date, geo = F.col("title_sim"), F.col("date_diff"), F.col("geo_close")
    return (
        pairs.withColumn("title_sim", metric("title_n_l", "title_n_r"))
        .withColumn("place_sim", metric("place_n_l", "place_n_r"))
        .withColumn("date_diff", day_distance(F.col("start_dt_l"), F.col("start_dt_r")))
        .withColumn("geo_close", geo_close(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r")))
        .withColumn(
            "rule",
            F.when(same_url, F.lit(URL_RULE))
            .when((title > TITLE_DATE_SIM) & (date <= TITLE_DATE_DAYS), F.lit(TITLE_DATE_RULE))
            .when((title > TITLE_PLACE_SIM) & ((F.col("place_sim") > PLACE_SIM) | geo), F.lit(TITLE_PLACE_RULE))
            .otherwise(F.lit(NEARBY_RULE)),
        )
        # Holds only where A does, so it never decides.
        .withColumn("same_title_and_day", (title > SAME_TITLE_SIM) & (date <= 0))
    )
