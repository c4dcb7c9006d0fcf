"""Plain one-text-at-a-time versions of what the operators return, and readers of the test tables."""

import re
from collections import Counter

import duckdb

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def documents(sf, table="documents"):
    return duckdb.sql(f"SELECT * FROM '{sf}/{table}.parquet'").df()


def shingle_set(text, size):
    w = solid((text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def component_of(ids_texts, size, percent):
    """Smallest id reachable over links between all pairs of texts."""
    rows = [(i, shingle_set(t, size)) for i, t in ids_texts if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def leaks(texts, items, size=10):
    """For each text: (words, words hit, sorted items) by comparing every window at every place."""
    wins = {}
    for item, text in items:
        w = alnum(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i: i + n]), set()).add(item)
    out = []
    for text in texts:
        w = alnum(text)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                who = wins.get(tuple(w[i: i + n]))
                if who is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in who if x is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def quality_counts(text):
    w = solid(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i: i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def secret_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = []
    for k, (name, rx, ok) in enumerate([("assign", assign, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
                                        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in rx.finditer(text or "") if ok(m)]
    return [x[2] for x in sorted(found)]


def licence_places(text, phrases):
    w = alnum(text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def segments(scores):
    """All maximal scoring segments by their definition: best segment of the text, then left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and b - a < best[1] - best[0])):
                best = (a, b, total)
    if best is None:
        return []
    a, b, _ = best
    return segments(scores[:a]) + [best] + [(x + b + 1, y + b + 1, s) for x, y, s in segments(scores[b + 1:])]
