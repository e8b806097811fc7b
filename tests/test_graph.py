from planeweave.operators import graph
from planeweave.operators.graph import connected_components
from planeweave.plans.storage import materialize


def test_components(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(2000, 2000), (3000, 3001), (3001, 3000), (None, 5), (3001, 3002)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    want = {i: 0 for i in range(1001)} | {2000: 2000, 3000: 3000, 3001: 3000, 3002: 3000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_labels_are_not_broadcast(spark, monkeypatch):
    """The driver would hold them."""
    plans = []
    monkeypatch.setattr(graph, "materialize", lambda df, label="step": plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, label))
    graph.connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long"))
    assert sum("Join" in p for p in plans) > 1 and not any("Broadcast" in p for p in plans)
