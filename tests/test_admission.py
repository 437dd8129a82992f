"""A consumer's path through the deliveries: which are whole, which come next, and what the copy is made of."""

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.operators import admission
from gridloom.plans import integrity

SF = "/root/testdata/sf0.001"
c = F.col


def test_parts_are_counted_once_and_beyond_a_word(spark):
    """Copies, parts 0 to 199, parts below zero and without a number; one altered copy spoils a delivery."""
    got = {1: list(range(200)), 2: list(range(199)), 3: [0, 0, 1], 4: [-1, 63, 64, 63], 5: [None, 0, None], 6: [0, 1], 7: []}
    rows = [(a, p, "w", "x" if a == 6 and p == 1 else "w") for a, parts in got.items() for p in parts] + [(6, 1, "w", "w")]
    want = {1: 200, 2: 200, 3: 2, 4: 3, 5: 2, 6: 2, 7: 0, 8: None}
    d = spark.createDataFrame([(a, 1, a, n) for a, n in want.items()], "arrival long, revision long, seq long, n_parts long")
    p = spark.createDataFrame(rows, "arrival long, part long, want string, got string")
    whole = {r["arrival"] for r in admission.intact(d, p).where("whole").collect()}
    assert whole == {1, 3, 4, 5, 7}
    # Sixty-four parts of a delivery are one row where they meet.
    assert "_word" in admission.intact(d, p)._jdf.queryExecution().optimizedPlan().toString()


def test_crowded_numbers_are_scanned_with_the_same_result(spark):
    """Numbers 0 to 599 with 3 deliveries each, number 300 with 500 more."""
    good = spark.range(1800).select((c("id") * 7919 % 100003 * 10).alias("arrival"), (c("id") % 600).alias("seq")).unionByName(
        spark.range(500).select((c("id") * 2003 + 1).alias("arrival"), F.lit(300).cast("long").alias("seq")))
    at = {}
    for r in good.collect():
        at.setdefault(r["seq"], []).append(r["arrival"])
    want = sorted((a, min(later)) for s, here in at.items() for a in here if (later := [b for b in at.get(s + 1, ()) if b > a]))
    for crowd in (1 << 17, 1600, 0):
        assert sorted(map(tuple, admission.next_delivery(good, crowd).collect())) == want and len(want) > 1500


def test_the_applied_deliveries_are_those_of_the_whole_judgement(spark):
    line = integrity._line(spark, SF)
    want = admission.admit(*line).where("status = 'apply'").select("arrival", "seq", "status").collect()
    got = admission.applied(*line).select("arrival", "seq", "status").collect()
    assert sorted(got) == sorted(want) and len(got) > 900


def test_parts_of_deliveries_need_no_join(spark):
    plan = fx.delivered_parts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_no_table_of_the_log_goes_through_the_driver(spark):
    """Tables that grow with the log are merged, even where the file is so small that they are guessed to be small."""
    judged = admission.admit(*integrity._line(spark, SF))
    for df, joins in ((admission.intact(*integrity._line(spark, SF)[:2]), 1), (admission.copy_after(
            spark.createDataFrame([], "layer_id string, idx long, value long"), fx.delivered_parts(spark, SF), judged), 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= joins
    plan = integrity.consumer_copy(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [arrival" not in plan
