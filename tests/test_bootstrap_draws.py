import numpy as np

from turnloom.operators import evals


def test_draws_resolve_the_tails(spark):
    """Ten equal clusters, five with a difference: a draw is a binomial, whose percentiles are known."""
    rows = [(str(c), int(c < 5), 0) for c in range(10) for _ in range(3)]
    frame = spark.createDataFrame(rows, "cluster string, a int, b int")
    plan = evals.cluster_bootstrap(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 100000" in plan
    r = evals.cluster_bootstrap(frame).first()
    own = np.random.default_rng(1).binomial(10, 0.5, 1_000_000) / 10
    assert (r.low, r.high) == tuple(np.quantile(own, (0.00625, 0.99375)))
