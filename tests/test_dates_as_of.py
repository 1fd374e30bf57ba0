"""Dated evidence and what follows from it, against plain Python over a hand-made store with relative
and absolute timeline events, explicit times of validity, and nodes without any date."""

import math
import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tests.plain_text import sides, tokens
from turnloom.functions import dates
from turnloom.operators import temporal

DAY = 86400
BASE = 1_700_000_000.0
TEXTS = ["I painted the boat two weeks ago. It was fun!", "We planted roses yesterday.\nThe puppy was adopted last Friday", "No date in this sentence at all.",
         "Short. ago", "The concert in Rome was great", "my sister adopted a puppy", "roses, roses and a boat", "I sold the boat 3 days ago and planted trees"]


def store(n=80, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = BASE + i
        events = [(BASE - rng.randint(1, 90) * DAY, f"l{i}{k}", kind) for k, kind in enumerate(rng.choice([(), ("absolute",), ("relative",), ("ordinal",), ("relative", "absolute"), ("ordinal", "absolute")]))]
        events = [(float(i) if kind == "ordinal" else t, label, kind) for t, label, kind in events]
        valid = rng.choice([None, ts, ts + 0.5, BASE - rng.randint(100, 200) * DAY])
        rows.append((i % 9, i, rng.choice(TEXTS), ts, valid, min(events) if events else None))
    return rows


def frame(spark, rows):
    flat = [(q, i, text, ts, valid, *(e or (None, None, None))) for q, i, text, ts, valid, e in rows]
    return spark.createDataFrame(flat, "query_id long, node_id long, content string, ts double, valid_from double, t_sort double, t_label string, t_kind string")


def plain_dated(spark, rows):
    """(query, node, event, epoch, kind, label); only the phrases themselves are read by the library."""
    asked, out = [], []
    for q, i, text, ts, valid, e in rows:
        explicit = valid if valid is not None and abs(valid - ts) > 1 else None
        anchor = e[0] if e and e[2] == "absolute" else explicit if e is None else None
        if anchor is not None:
            for part in text.replace("! ", "!\n").replace(". ", ".\n").split("\n"):
                if len(part.strip()) >= 12:
                    asked.append((q, i, part.strip(), anchor))
        if e and e[2] in ("absolute", "relative"):
            out.append((q, i, text, e[0], "event" if e[2] == "relative" else "session", e[1]))
        elif explicit is not None:
            out.append((q, i, text, explicit, "session", None))
    found = spark.createDataFrame(asked, "q long, i long, s string, at double").select("*", dates.parse_relative(F.col("s"), F.col("at")).alias("t")).collect()
    return out + [(r.q, r.i, r.s, r.t.epoch, "event", r.t.label) for r in found if r.t is not None]


def stem(t):
    t = t.replace("'s", "").strip("'-")
    return next((t[: -len(e)] for e in ("ing", "ed") if t.endswith(e) and len(t) >= 3 + len(e)), t)[:5]


def hits(words, text):
    return sum(stem(t) in text.lower() for t in words)


def plain_best(words, rivals, events, used):
    need = 1 if rivals is not None else max(1, (len(words) + 1) // 2)
    fit = [e for e in events if words and e[1] != used and hits(words, e[2]) >= need and (rivals is None or hits(words, e[2]) > hits(rivals, e[2]))]
    key = lambda e: (-(hits(words, e[2]) - hits(rivals or [], e[2])), -hits(words, e[2]), e[4] != "event", len(e[2]), e[1], e[2])
    return min(fit, key=key, default=None)


def day(epoch):
    return datetime.fromtimestamp(epoch, timezone.utc).strftime("%Y-%m-%d")


QUESTIONS = ["How many days between painting the boat and planting roses?", "how long ago did we adopt the puppy", "How many weeks ago was the concert in Rome?",
             "Was the boat sold or the puppy adopted?", "How long ago?", "how long ago was the zeppelin launched in Rome", "What happened between  the roses and the boat sale ?",
             "How many days ago did I paint the boat", "Nothing is asked"]


def test_dates_by_precedence(spark):
    rows = store()
    got = sorted((tuple(r) for r in temporal.dated_events(frame(spark, rows)).select("query_id", "node_id", "event", "epoch", "kind", "label").collect()), key=repr)
    want = sorted(plain_dated(spark, rows), key=repr)
    assert got == want
    assert {e[4] for e in want} == {"event", "session"} and len(want) > 60


def test_gaps_and_elapsed_times(spark):
    rows = [(q, i, text, ts, valid, e) for q in range(len(QUESTIONS)) for _, i, text, ts, valid, e in store(60, 5)]
    as_of = {q: None if q == 7 else BASE - 40 * DAY if q == 2 else BASE + 9 * DAY for q in range(len(QUESTIONS))}
    asked = spark.createDataFrame([(q, text, as_of[q]) for q, text in enumerate(QUESTIONS)], "query_id long, query string, as_of double")
    events = temporal.dated_events(frame(spark, rows))
    plain = plain_dated(spark, rows)
    pairs, since = {}, {}
    for q, text in enumerate(QUESTIONS):
        own, named = [e for e in plain if e[0] == q], sides(text)
        if q == 6:
            named = [["roses"], ["boat", "sale"]]
        if len(named) == 2:
            a = plain_best(named[0], named[1], own, None)
            b = plain_best(named[1], named[0], own, a and a[1])
            if a and b:
                pairs[q] = (a, b)
        elif "ago" in text and as_of[q] is not None:
            words = tokens(text.replace("ago", " ago ").split(" ago ", 1)[1] if "ago" in text else text)
            e = plain_best(words, None, own, None)
            if e and e[3] <= as_of[q]:
                since[q] = e
    got = {r.query_id: r for r in temporal.elapsed(asked, events).collect()}
    assert {q: (r.node_id, r.event, r.epoch, r.kind) for q, r in got.items()} == {q: e[1:5] for q, e in since.items()} and 1 in since and 5 not in since
    for q, r in got.items():
        assert r.days == math.floor(as_of[q] / DAY) - math.floor(r.epoch / DAY)
    lines = {r.query_id: r.lines for r in temporal.computed_lines(asked, events).collect()}
    assert set(lines) == set(pairs) | set(since)
    for q, (a, b) in pairs.items():
        assert f"[{day(a[3])}," in lines[q][0] and f"[{day(b[3])}," in lines[q][0]
        if a[4] != b[4]:
            assert "NOT determined" in lines[q][0] and len(lines[q]) == 1
        elif day(a[3]) == day(b[3]):
            assert lines[q][1].startswith("A and B fall on the same date")
        else:
            assert lines[q][1].startswith(f"Event {'A' if a[3] <= b[3] else 'B'} is EARLIER. Gap: ")
    for q, e in since.items():
        assert lines[q][0].endswith(f"before the question date {day(as_of[q])}.") and f"[{day(e[3])}," in lines[q][0]


def test_no_evidence_and_no_questions(spark):
    rows = frame(spark, store(9))
    asked = spark.createDataFrame([(1, QUESTIONS[1], None), (2, QUESTIONS[1], BASE)], "query_id long, query string, as_of double")
    assert temporal.dated_events(rows.limit(0)).count() == 0
    assert temporal.computed_lines(asked, temporal.dated_events(rows.limit(0))).count() == 0
    assert temporal.elapsed(asked.limit(0), temporal.dated_events(rows)).count() == 0
