"""Matches by definition, on plain Python lists: what the Spark plans must equal.

Events are dicts with id, t, kind and key; a pattern is a list of (kind, is one-or-more).
Results are sets of id tuples.
"""

from itertools import combinations, product


def keyed(events):
    out = {}
    for e in sorted(events, key=lambda e: (e["t"], e["id"])):
        out.setdefault(e["key"], []).append(e)
    return out.values()


def ids(*groups):
    return tuple(e["id"] for g in groups for e in (g if isinstance(g, (list, tuple)) else [g]))


def increasing(groups):
    return all(a[-1]["t"] < b[0]["t"] for a, b in zip(groups, groups[1:]))


def any_all(events, pattern, w):
    """Every choice of one event, or one non-empty subset, per step."""
    found = set()
    for es in keyed(events):
        ends = [e for e in es if e["kind"] == pattern[-1][0]]
        for c in ends:
            near = [e for e in es if c["t"] - w <= e["t"] < c["t"]]
            options = []
            for kind, many in pattern[:-1]:
                mine = [e for e in near if e["kind"] == kind]
                sizes = range(1, len(mine) + 1) if many else [1]
                options.append([list(x) for n in sizes for x in combinations(mine, n)])
            for groups in product(*options):
                if increasing([*groups, [c]]):
                    found.add(ids(*groups, c))
    return found


def maximal(events, pattern, w):
    """Matches whose one-or-more sets cannot be extended by any event of their window.

    Between its neighbours a set holds all its events; a first set reaches back to the
    window start, and a set followed by another set ends where that one begins.
    """
    found = set()
    for es in keyed(events):
        for c in [e for e in es if e["kind"] == pattern[-1][0]]:
            near = [e for e in es if c["t"] - w <= e["t"] < c["t"]]

            def rec(i, head, floor, tail):
                if i < 0:
                    found.add(ids(*tail))
                    return
                kind, many = pattern[i]
                mine = [e for e in near if e["kind"] == kind and e["t"] < head]
                if not many:
                    for e in mine:
                        if floor is None or e["t"] >= floor:
                            rec(i - 1, e["t"], None, [e, *tail])
                    return
                if i == 0:
                    if mine:
                        rec(-1, None, None, [mine, *tail])
                    return
                before = [e for e in near if e["kind"] == pattern[i - 1][0]]
                for j in range(len(mine)):
                    lo = mine[j - 1]["t"] if j else None
                    if any(b["t"] < mine[j]["t"] and (lo is None or b["t"] >= lo) for b in before):
                        rec(i - 1, mine[j]["t"], lo, [mine[j:], *tail])

            rec(len(pattern) - 2, c["t"], None, [c])
    return found


def compact(events, a, b, c, w):
    """``A B+ C``: before the first usable b every start, later only the latest start."""
    found = set()
    for es in keyed(events):
        for end in [e for e in es if e["kind"] == c]:
            near = [e for e in es if end["t"] - w <= e["t"] < end["t"]]
            starts = [e for e in near if e["kind"] == a]
            bs = [e for e in near if e["kind"] == b]
            if not starts:
                continue
            b0 = next((x for x in bs if x["t"] > starts[0]["t"]), None)
            for n, s in enumerate(starts):
                rest = [x for x in bs if x["t"] > s["t"]]
                limit = starts[n + 1]["t"] if n + 1 < len(starts) else end["t"]
                latest = any(x["t"] <= limit for x in rest)
                if rest and (s["t"] < b0["t"] or latest):
                    found.add(ids(s, rest, end))
    return found


def following(events, kinds, w):
    """Each start takes the next event of every later step."""
    found = set()
    for es in keyed(events):
        for s in [e for e in es if e["kind"] == kinds[0]]:
            run = [s]
            for kind in kinds[1:]:
                nxt = next((e for e in es if run and e["kind"] == kind and e["t"] > run[-1]["t"]), None)
                run = [*run, nxt] if nxt else []
            if run and run[-1]["t"] - s["t"] <= w:
                found.add(ids(*run))
    return found


def prefixes(events, a, b, c, w):
    found = set()
    for es in keyed(events):
        for s in [e for e in es if e["kind"] == a]:
            bs = [e for e in es if e["kind"] == b and e["t"] > s["t"]]
            for n in range(1, len(bs) + 1):
                end = next((e for e in es if e["kind"] == c and e["t"] > bs[n - 1]["t"]), None)
                if end and end["t"] - s["t"] <= w:
                    found.add(ids(s, bs[:n], end))
    return found


def first_ends(events, matches):
    """Ends in time order; a match goes if a kept one has the same events before its end."""
    t = {e["id"]: e["t"] for e in events}
    kept = []
    for m in sorted(matches, key=lambda m: (t[m[-1]], m[-1], len(m), m)):
        def clash(k):
            n = min(len(k), len(m)) - 1
            return k[:n] == m[:n] and t[k[-1]] < t[m[-1]]

        if not any(clash(k) for k in kept):
            kept.append(m)
    return set(kept)


def adjacent(events, pattern, w):
    found = set()
    for es in keyed(events):
        for p in range(len(es)):
            i, groups = p, []
            for kind, many in pattern:
                group = []
                while i < len(es) and es[i]["kind"] == kind and (many or not group):
                    group.append(es[i])
                    i += 1
                if not group:
                    break
                groups.append(group)
            if len(groups) == len(pattern) and increasing(groups) and groups[-1][0]["t"] - es[p]["t"] <= w:
                found.add(ids(*groups))
    return found


def negation(events, a, n, c, w):
    kept, lost = set(), set()
    for es in keyed(events):
        for s in [e for e in es if e["kind"] == a]:
            for end in [e for e in es if e["kind"] == c and s["t"] < e["t"] <= s["t"] + w]:
                hit = any(e["kind"] == n and s["t"] <= e["t"] <= end["t"] for e in es)
                (lost if hit else kept).add(ids(s, end))
    return kept, lost
