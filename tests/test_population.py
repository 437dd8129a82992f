"""Populations and thinning: nothing that grows with the features goes through the driver."""

from pyspark.sql import functions as F

from gridloom.operators import population

c = F.col


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_drawn_features_are_not_broadcast(spark):
    """Forty bins become many draws; each meets the rims of its own cell only, two on average."""
    draws = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("i")).withColumn("pick", (c("i") * 7919 % 10007) / 10007.0)
    rims = spark.range(5000).select("id", c("id").cast("double").alias("rim_x"), F.lit(0.0).alias("rim_z"), (1.0 + c("id") % 3).alias("radius"))
    got = population.pick_annulus(draws, rims)
    plan = plan_of(got)
    met = [line for line in plan.split("\n") if "Join" in line and "pick#" in line]
    assert len(met) == 1 and "SortMergeJoin" in met[0]
    assert "* 5000.0" in plan  # as many cells as rims
    weight = [(1.0 + i % 3) ** 2 for i in range(5000)]
    total, ends, run = sum(weight), [], 0.0
    for w in weight:
        run += w
        ends.append(run / total)
    picked = {r["i"]: (r["pick"], r["rim_id"]) for r in got.collect()}
    assert len(picked) == 10000
    for pick, rim in picked.values():
        assert (ends[rim - 1] if rim else 0.0) - 1e-12 <= pick < ends[rim] + 1e-12


def test_thinning_broadcasts_no_cells(spark, monkeypatch):
    plans, cut = [], population.cut_lineage

    def seen(df):
        plans.append(plan_of(df))
        return cut(df)

    monkeypatch.setattr(population, "cut_lineage", seen)
    features = spark.range(3000).select(c("id").alias("ord"), (c("id") * 7919 % 997 / 40.0).alias("x"), (c("id") * 104729 % 991 / 40.0).alias("z"),
                                        (0.2 + c("id") % 9 / 4.0).alias("diameter"))
    plans.append(plan_of(population.thin_by_exclusion(features, 1.0, 0.5)))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
