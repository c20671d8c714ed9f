import random

from seqspark import PatternSpec, Step

SCHEMA = "event_id long, ts long, kind string, key long"

# The worked 21-event stream: type and time.
WORKED = "b1 b2 a3 a4 a5 a6 a7 b8 a9 c10 b11 b12 a13 b14 a15 b16 a17 a18 c19 c20 a21".split()
# The order in which its first twenty events arrive in the correction walk.
WALK = "b1 b2 b11 a3 c10 a4 a6 c20 a5 a18 a7 b8 a17 a9 a13 b14 b16 a15 c19 b12".split()


def named(names):
    return [{"id": int(n[1:]), "t": int(n[1:]), "kind": n[0], "key": 0} for n in names]


def random_events(seed, n=120, keys=3, span=None, kinds="abcn"):
    """Events with repeated times, several keys and one key that holds a third of them."""
    r = random.Random(seed)
    span = span or n // 2
    return [
        {"id": i, "t": r.randint(0, span), "kind": r.choice(kinds),
         "key": 0 if r.random() < 0.34 else r.randint(1, keys)}
        for i in range(n)
    ]


def frame(spark, events):
    rows = [(e["id"], e["t"], e["kind"], e["key"]) for e in events]
    return spark.createDataFrame(rows, SCHEMA)


def step(name, kind=None, **kw):
    return Step(name, f"kind = '{kind or name}'", **kw)


def spec(text, w, **kw):
    """``spec("a b+ c", 10)``; a leading ! negates a step."""
    steps = []
    for i, word in enumerate(text.split()):
        kind = word.strip("+!")
        name = kind if all(s.name != kind for s in steps) else f"{kind}{i}"
        steps.append(step(name, kind, kleene=word.endswith("+"), negated=word.startswith("!")))
    kw.setdefault("partition_by", ["key"])
    return PatternSpec(steps, within=w, **kw)


def id_sets(matches):
    rows = [tuple(r.event_ids) for r in matches.select("event_ids").collect()]
    assert len(rows) == len(set(rows)), "a match came out twice"
    return set(rows)
