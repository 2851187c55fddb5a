import json

from pyspark.sql import functions as F

from corvellum.operators import workflow


def test_decisions_of_every_depth(spark):
    """Objects within objects are opened by an expression of a bounded size."""

    def within(said, depth):
        for k in range(depth):
            said = {workflow.DECISION_KEYS[k % 3]: said}
        return json.dumps(said)

    most = workflow.DECISION_DEPTH
    given = {within(" OK ", n): n <= most for n in range(most + 3)} | {within("no", n): False for n in range(most + 1)} | {within(True, n): n <= most for n in range(most + 2)}
    given |= {"yes": True, ' {"approved": null, "decision": "yes"}': False, '{"other": "yes"}': False, "{broken": False, "[true]": False, "": False, None: False, '{"approve": "y", "approved": false}': False}
    df = spark.createDataFrame(list(given.items()), "decision string, expected boolean").withColumn("got", workflow.is_approved(F.col("decision")))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 5000
    assert [r.decision for r in df.where("got is null or got != expected").collect()] == []


def test_last_decision_counts(spark):
    asked = spark.createDataFrame([(t, "web") for t in "abcde"], "thread_id string, route string")
    said = [("a", 1, "no"), ("a", 2, '{"decision": {"approve": " OK "}}'), ("b", 1, "yes"), ("b", 2, '{"approved": false}'), ("c", 1, None), ("e", 1, '"Approved "'), ("z", 1, "yes")]
    got = workflow.approvals(asked, spark.createDataFrame(said, "thread_id string, seq int, decision string"))
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    assert {(r.thread_id, r.status, r.effective_route) for r in got.collect()} == {("a", "approved", "web"), ("b", "denied", "library"), ("c", "denied", "library"), ("d", "awaiting", None), ("e", "approved", "web")}


def test_plan_does_not_grow_with_depth(spark, monkeypatch):
    asked = spark.createDataFrame([("a", "web")], "thread_id string, route string")
    decisions = spark.createDataFrame([("a", 1, "yes")], "thread_id string, seq int, decision string")
    sizes = []
    for depth in (1, 2, 3):
        monkeypatch.setattr(workflow, "DECISION_DEPTH", depth)
        sizes.append(len(workflow.approvals(asked, decisions)._jdf.queryExecution().analyzed().toString()))
    assert max(sizes) < 1.1 * min(sizes), sizes
