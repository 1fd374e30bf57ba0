"""What became of each question's evidence, beside plain Python."""

import json
from collections import defaultdict

from pyspark.sql import functions as F

from tests import plain_retrieval as plain
from tests.plain_text import sides
from tests.test_retrieval import stores
from turnloom.functions.text import MENTIONS
from turnloom.operators import retrieval, temporal
from turnloom.plans import lattice


def staged(rows):
    made = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"] or 0):
        made[r.query_id, r.stage].append(r)
    return made


def test_every_stage_of_the_routed_retrieval_equals_plain_python(spark, sf, monkeypatch):
    memory, made = stores(spark, sf)
    said = memory.timeline.where("t_kind = 'absolute'").select(F.col("node_id").alias("id"), F.col("t_sort").alias("said_at"))
    rows = memory.nodes.join(said, "id").select(F.lit(0).alias("query_id"), F.col("id").alias("node_id"), "content", "said_at")
    dated = defaultdict(list)
    for r in temporal.dated_events(rows).collect():
        dated[r.node_id].append((r.event, r.epoch, r.kind))
    sorted_, best = [], plain.best_or_first
    monkeypatch.setattr(plain, "best_or_first", lambda ids, *more: sorted_.append(list(ids)) or best(ids, *more))
    got = staged(lattice.stage_trace(spark, sf).collect())
    ids = lambda q, stage: [r.node_id for r in got[q.query_id, stage]]
    detail = lambda q, stage: json.loads(got[q.query_id, f"route_{stage}"][0].detail)
    compared = sided = 0
    for q in lattice._questions(spark, sf).collect():
        store = made[q.user_id]
        sorted_.clear()
        ability, widened, why, kept = plain.retrieve(store, q.query, dated)
        # a first pass sorts its shortlist's newest nodes, then its candidates
        assert ids(q, "retrieved") == sorted_[1]
        assert ids(q, "kept") == ids(q, "packed") == kept and (set(ids(q, "gathered")) <= set(ids(q, "widened"))) == widened
        for stage, most in {"retrieved": 6000, "kept": 6000, "packed": 2000}.items():
            assert all((r.chars, r.text) == (len(store.content[r.node_id]), store.content[r.node_id][:most]) for r in got[q.query_id, stage])
        assert detail(q, "contract") == {"ability": ability, "satisfied": why is None, "reasons": [why] if why else [], "widened": widened}
        assert len(got[q.query_id, "route_contract_first_pass"]) == widened
        assert detail(q, "prove_pack")["included_ids"] + detail(q, "prove_pack")["dropped_ids"] == kept
        mention = ability == "event_ordering" and bool(plain.re.search(MENTIONS, q.query))
        proof = {"mode": "abstain", "reason": "evidence_gap"} if mention and why else {"mode": "skipped", "reason": "error_open"}
        assert detail(q, "prove") == proof | {"score": 5.0, "gap": why or ""}
        assert bool(got[q.query_id, "route_temporal"]) == (ability in ("event_ordering", "temporal", "default", "extraction") and not mention)
        if ability in ("event_ordering", "temporal"):
            found = detail(q, "timeline")
            if mention:
                assert found["side_hits"] == [len(store.mentions(q.query, 48))] and not found["both_events_present"]
            else:
                assert found["sides"] == sides(q.query) and found["n_hits"] == len(store.timeline_sides(q.query, 48))
                each = [sum(plain.hits(own, store.content[t["node_id"]]) > 0 for t in store.timeline) for own in sides(q.query)]
                assert found["side_hits"] == [min(n, max(1, 48 // len(each))) for n in each]
                sided += found["both_events_present"]
            compared += 1
    assert compared and sided


def test_cuts_of_long_passages_by_hand(spark):
    """Eight passages of 2,500 characters: all are cut for the reader, and a proof reads four whole ones."""
    nodes = [(1, n, "roses " * 415 + f"{n:010d}", float(n), "fact", float(n), None, n, "user", 1) for n in range(1, 9)]
    nodes = spark.createDataFrame(nodes, "user_id long, id long, content string, ts double, tier string, valid_from double, valid_to double, source_position long, source_role string, scope_session long")
    empty = [
        "user_id long, node_id long, t_sort double, t_label string, entity string, t_kind string",
        "user_id long, id long, a_id long, b_id long, topic string, ts double",
        "user_id long, src long, dst long, kind string, score double",
    ]
    memory = retrieval.Memory(nodes, *(spark.createDataFrame([], s) for s in empty))
    asked = spark.createDataFrame([(7, 1, "roses beds")], "query_id long, user_id long, query string")
    got = staged(retrieval.traced(asked, memory).collect())
    kept = [r.id for r in got[7, "kept"]]
    assert sorted(kept) == list(range(1, 9)) and all(len(r.text) == r.chars == 2500 for r in got[7, "kept"])
    assert [(r.id, len(r.text), r.chars) for r in got[7, "packed"]] == [(n, 2000, 2500) for n in kept]
    assert [(r.id, r.chars, r.limit) for r in got[7, "cut_pack"]] == [(n, 2500, 2000) for n in kept]
    # the fifth is cut before it proves too long for what is left
    assert [r.id for r in got[7, "cut_prove"]] == kept[:5]
    assert [(r.id, r.limit) for r in got[7, "cut_prove_budget"]] == [(n, 10_000) for n in kept[4:]]
    head = len("[source=1, position=1, speaker=user, session=1] ")
    assert json.loads(got[7, "route_prove_pack"][0].detail) == {"included_ids": kept[:4], "dropped_ids": kept[4:], "chars": 4 * (head + 2000) + 15, "budget": 10_000}
