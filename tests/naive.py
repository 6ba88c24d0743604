"""Slow, plain-Python statements of the expected results, for small inputs."""

import datetime
import random
import re
from difflib import SequenceMatcher

STOP = set("the a an at in on for with and or de la du le".split())
PRIORITY = {"yourdaysout": 100, "allevents": 90, "facebook": 50, "instagram": 30}
MERGED = (
    "title description start_date end_date venue_name venue_address city county "
    "country latitude longitude url cost age_group"
).split()


def title_words(t):
    return " ".join(w for w in re.sub(r"[^\w\s]", " ", t.lower()).split() if w not in STOP)


def place_words(t):
    return re.sub(r"^(county|city of|the) ", "", " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split()))


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def iso(s):
    return datetime.date.fromisoformat(s) if s else None


def close(a, b):
    if not (a["latitude"] and b["latitude"]):
        return False
    try:
        dy = float(a["latitude"]) - float(b["latitude"])
        dx = float(a["longitude"] or 0) - float(b["longitude"] or 0)
    except ValueError:
        return False
    return (dy * dy + dx * dx) ** 0.5 * 111 < 5


def rule(a, b):
    """First rule by which the earlier record a matches the later record b."""
    if a["url"] and a["url"] == b["url"]:
        return "url"
    title = ratio(title_words(a["title"]), title_words(b["title"]))
    da, db = iso(a["start_date"]), iso(b["start_date"])
    days = abs((da - db).days) if da and db else 999
    place = ratio(*(place_words(x["city"] or x["venue_name"]) for x in (a, b)))
    near = close(a, b)
    if title > 0.8 and days <= 3:
        return "A"
    if title > 0.85 and (place > 0.7 or near):
        return "B"
    if title > 0.5 and days <= 1 and near:
        return "C"
    return None


def source_type(e):
    for name in PRIORITY:
        if name in e["source"] or name in e["url"]:
            return name
    return e["source"].split(":")[0] if ":" in e["source"] else "unknown"


def confidence(e):
    return PRIORITY.get(source_type(e), 10) / 100


def ordered(events):
    return sorted(events, key=lambda e: (-confidence(e), e["ingest_ord"]))


def leaders(events):
    """ingest_ord -> ingest_ord of its leader, leaders compared as they came in."""
    found, out = [], {}
    for e in ordered(events):
        hit = next((x for x in found if rule(x, e)), None)
        if hit is None:
            found.append(e)
        out[e["ingest_ord"]] = (hit or e)["ingest_ord"]
    return out


def fold(events, mutate=False):
    """Clusters as a sequential fold; `mutate` compares with the merged record."""
    clusters = []
    for e in ordered(events):
        hit = next((c for c in clusters if rule(c["now"] if mutate else c["head"], e)), None)
        if hit is None:
            clusters.append(
                {"head": e, "now": dict(e), "conf": confidence(e), "members": [e["ingest_ord"]],
                 "sources": {source_type(e)}, "urls": {e["url"]}}
            )
            continue
        now = hit["now"]
        mine = next((p for s, p in PRIORITY.items() if hit["head"]["source"].startswith(s)), 10)
        theirs = next((p for s, p in PRIORITY.items() if e["source"].startswith(s)), 10)
        for f in MERGED:
            if e[f] and (not now[f] or theirs > mine):
                now[f] = e[f]
        hit["sources"] |= {hit["head"]["source"], e["source"]}
        hit["urls"] |= {e["url"]}
        hit["conf"] = max(hit["conf"], confidence(e), 0.7 if len(hit["sources"]) > 1 else 0.5)
        hit["members"].append(e["ingest_ord"])
    return clusters


WORDS = "halloween kids disco bubble brunch neon painting storytime farm trail santa lego summer camp".split()
CITIES = ["Dublin", "Dublin 2", "County Dublin", "Cork", "York", "Galway", "", ""]


def random_events(seed, n):
    """Listings with near copies, shared URLs, crowded days, cells and places."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.choice(["yourdaysout", "allevents", "facebook", "instagram", "web"])
        if out and rnd.random() < 0.5:
            e = dict(rnd.choice(out))
            if rnd.random() < 0.5:
                t = list(e["title"])
                for _ in range(rnd.randint(0, 6)):
                    if t:
                        t[rnd.randrange(len(t))] = rnd.choice("abc xyz")
                e["title"] = "".join(t)
        else:
            e = {"title": " ".join(rnd.sample(WORDS, rnd.randint(1, 4))) if rnd.random() < 0.95 else ""}
        day = datetime.date(2026, 3, 1) + datetime.timedelta(days=rnd.choice([0, 0, 0, 1, 3, 4, 9, 30]))
        for f in MERGED[1:]:
            e.setdefault(f, "")
        if rnd.random() < 0.7:
            e["start_date"] = day.isoformat() if rnd.random() < 0.9 else ""
        if rnd.random() < 0.6:
            e["city"] = rnd.choice(CITIES)
            e["venue_name"] = rnd.choice(["Town Hall", "Town Hal", "Park", ""])
        if rnd.random() < 0.5:
            e["latitude"] = rnd.choice(["53.34", "53.35", "53.38", "51.9", "x", ""])
            e["longitude"] = rnd.choice(["-6.26", "-6.30", "-8.4", ""])
        e["url"] = rnd.choice(["", f"https://{kind}.example/{i}", f"https://{kind}.example/{rnd.randint(0, 9)}"])
        e["source"] = rnd.choice([e["url"], f"{kind}:{i}", ""])
        e["cost"] = rnd.choice(["", "free", "5"])
        e["description"] = rnd.choice(["", f"text {i}"])
        e["ingest_ord"] = i
        out.append(e)
    return out
