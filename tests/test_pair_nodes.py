from turnloom.operators import temporal


def test_second_side_leaves_the_first_sides_node_out(spark):
    day = 86400.0
    rows = [(1, 5, "planted roses", 1 * day, "event"), (1, 5, "adopted a puppy", 2 * day, "event"), (1, 6, "the puppy came home to us", 9 * day, "event")]
    rows += [(2, 5, "adopted a puppy", 2 * day, "event"), (3, 5, "planted roses", day, "event"), (3, 5, "adopted a puppy", 2 * day, "event")]
    events = spark.createDataFrame(rows, "query_id long, node_id long, event string, epoch double, kind string")
    a, b = ["planted", "roses"], ["adopted", "puppy"]
    sides = spark.createDataFrame([(q, s, *((a, b) if s == 0 else (b, a))) for q in (1, 2, 3) for s in (0, 1)], "query_id long, side long, tokens array<string>, rivals array<string>")
    best = temporal.best_events(events, sides)
    assert {(r.query_id, r.side): (r.node_id, r.epoch) for r in best.collect()} == {
        (1, 0): (5, day), (1, 1): (6, 9 * day),  # not the puppy of node 5
        (2, 1): (5, 2 * day),  # no first side: nothing is left out
        (3, 0): (5, day),
    }
    got = temporal.compared(best).collect()
    assert [(r.query_id, r.first_side, r.gap.split(";")[0]) for r in got] == [(1, 0, "8 days")]
