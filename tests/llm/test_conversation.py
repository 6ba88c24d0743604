import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from eventloom.llm import conversation as c
from eventloom.llm.common import table

SPACES = " \t\n\x0b\x0c\r"


def fitting(initials):
    rest = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.rstrip(SPACES)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else None if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) by trying all edits with at most two rows put in at each place."""
    marks, best = faults(rows), None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    per_row = []
    for (_, role, text), mark in zip(rows, marks):
        more = 5 if mark == "truncated" else 0
        own = [("D", 2, None)]
        if mark not in ("blank", "duplicate"):
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        per_row.append(own)
    for edits in itertools.product(*per_row):
        for put in itertools.product(inserts if len(rows) < 3 else inserts[:3], repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, put))
            if best is not None and cost > best[0]:
                continue
            audit, left = "", []
            for n in range(len(rows) + 1):
                audit, left = audit + "I" * len(put[n]), left + [(r, "") for r in put[n]]
                if n < len(rows):
                    audit += edits[n][0]
                    left += [edits[n][2]] if edits[n][2] else []
            if fitting("".join(r[:1] or "?" for r, _ in left)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, left
    return best


def dynamic(rows):
    """The same by keeping, per state, the whole best string: for long conversations."""
    marks, ways = faults(rows), {0: (0, "")}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(ways):
        for _ in range(4):
            for s, (cost, audit) in list(ways.items()):
                to = 3 if s == 2 else 2
                ways[to] = min(ways.get(to, (1 << 60, "")), (cost + 5, audit + "I"))
        return ways

    for (_, role, _), mark in zip(rows, marks):
        after, more = {}, 5 if mark == "truncated" else 0
        for s, (cost, audit) in inserted(ways).items():
            edits = [("D", s, 2)]
            if mark not in ("blank", "duplicate"):
                edits += [("R", 3 if s == 2 else 2, 1 + more)] + ([("K", step[s, role[:1]], more)] if (s, role[:1]) in step else [])
            for letter, to, price in edits:
                after[to] = min(after.get(to, (1 << 60, "")), (cost + price, audit + letter))
        ways = after
    ways = inserted(ways)
    return min(ways[s] for s in (0, 3) if s in ways)


def searched(rows):
    search, out = c.Search(), []
    for n, ((_, role, _), mark) in enumerate(zip(rows, faults(rows))):
        out += search.row(n, role[:1], mark)
    out += search.end()
    return "".join(e[0] for e in out), out


def price(audit, marks):
    rows, total = iter(marks), 0
    for letter in audit:
        mark = None if letter == "I" else next(rows)
        total += {"D": 2, "I": 5, "R": 1, "K": 0}[letter] + (5 if mark == "truncated" and letter in "KR" else 0)
    return total


def test_short_conversations_as_all_edits():
    rng = random.Random(1)
    kinds = [("user", "a."), ("assistant", "b!"), ("system", "c?"), ("user", "d"), ("assistant", " \t"), ("Other", "e."), ("", "f.")]
    for n in range(5):
        cases = itertools.product(kinds, repeat=n) if n < 3 else [[rng.choice(kinds) for _ in range(n)] for _ in range(60 if n == 3 else 12)]
        for case in cases:
            rows = [(0, *r) for r in case]
            cost, audit, _ = brute(rows)
            assert (price(searched(rows)[0], faults(rows)), searched(rows)[0]) == (cost, audit), case


def test_long_conversations_and_what_is_held():
    rng = random.Random(2)
    for n, roles in [(300, "uas"), (301, "u"), (300, "ua"), (200, "uax"), (77, "a"), (60, "s")]:
        rows = [(i, rng.choice(roles), f"t{rng.randrange(n * 4)}{rng.choice(['.', '.', '!', ''])}") for i in range(n)]
        cost, audit = dynamic(rows)
        assert searched(rows)[0] == audit and price(audit, faults(rows)) == cost
    search, most = c.Search(), 0
    for n in range(20_000):
        list(search.row(n, "ua"[n % 2], None))
        most = max(most, len(search.tree.parent))
    assert most < 100  # settled edits leave; slots of freed nodes are used again


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        out = by.setdefault(conv, [])
        role, text = [" " if x is None else x for x in (role, text)]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks, turns = faults(own), {r[0] for r in own} - {None}
        cost, audit = dynamic(own)
        left, at, state = [], iter(own), 0
        for letter in audit:
            row = None if letter == "I" else next(at)
            if letter != "D":
                state = 3 if state == 2 else 2 if letter in "RI" or row[1][:1] != "s" else 1
                role = row[1] if letter == "K" else {2: "user", 3: "assistant"}[state]
                left.append(f"{role}:{row[2] if row else ''}")
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in c.FAULTS), illegal,
                       cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return found


def check(got, rows):
    want = expected(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_query_as_brute_force(spark, tables):
    got = c.op11_conversation_repair(spark, tables[0])
    assert got.columns == ["conv_id", "gaps", *c.FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    check(got.collect(), [tuple(r) for r in table(spark, tables[0], "conversations").select("conv_id", "turn", "role", "text").collect()])
    assert c.op11_conversation_repair(spark, tables[1]).count() == 0


def test_many_conversations(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 60 if rng.random() < 0.7 else 7, rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", None, "tool"]),
             rng.choice([None, "", " \n", "ok.", "ok", "a ", "x" * 4000 + "?", f"n{rng.randrange(90)}!"])) for i in range(900)]
    rows += [(100 + i, 0, "user", "only.") for i in range(40)]  # some of these lose their only row
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("conv", F.lit(1))
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    check(c.op11_conversation_repair(spark, str(tmp_path)).collect(), rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "q?"), (1, 2, "user", "again?"), (1, 3, "assistant", "cut off")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = c.repair(df).orderBy("at").collect()
    assert "".join(r["edit"] for r in got) == "DKRD"
    assert [(r["role"], r["text"]) for r in got if r["edit"] != "D"] == [("user", "q?"), ("assistant", "again?")]
