"""Messages are dealt in parts that grow in number with the ledger, whatever the number of shuffle partitions."""

from letterspark.operators import scoring as K
from letterspark.plans import shared


def test_parts_grow_with_the_rows(spark):
    assert shared.parts(spark.range(100), 10) == 10
    assert shared.parts(spark.range(3), 10) == spark.sparkContext.defaultParallelism


def test_coverage_is_dealt_by_message_alone(spark):
    ledger = spark.createDataFrame([(1, "a", "t", True), (1, "a", "t", None), (1, None, "t", True), (2, "b", "t", False), (2, "thread", "x", None)], "msg_id long, claim_id string, claim_type string, contradiction boolean")
    claims = spark.createDataFrame([(1, "a"), (1, "z"), (2, "c"), (None, "a")], "msg_id long, claim_id string")
    out = K.coverage_report(spark.createDataFrame([(1,), (2,), (3,)], "msg_id long"), ledger, claims, spark.createDataFrame([], "msg_id long, code string"))
    assert {r.msg_id: (r.claims, r.checked, r.contradicted, r.signals) for r in out.collect()} == {1: (1, 1, 1, 0), 2: (0, 0, 0, 1), 3: (0, 0, 0, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(msg_id" in plan and "ENSURE_REQUIREMENTS" not in plan.split("Initial Plan")[-1]
