"""What a march over blocks of rows moves."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import horizon, rays

c = F.col


def test_observers_out_of_reach_do_not_copy_a_block(spark, monkeypatch):
    """3 000 observers at one end of a raster of 5 120 rows, 12 m of reach: far blocks stay whole, and so do rows of other layers."""
    n, moved = 5120, []
    layers = spark.sql(f"SELECT 'a' AS layer_id, 0.25D AS res, 8 AS width, {n}L AS height, 0D AS min_x, 0D AS min_z, 1.75D AS max_x, {(n - 1) * 0.25}D AS max_z")
    flat = F.array(*[F.lit(0.5).cast("float")] * 8).alias("heights")
    rows = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("layer_id"), c("id").alias("row"), flat)
    observers = spark.range(3000).select(c("id").alias("observer_id"), F.lit("a").alias("layer_id"), F.lit(0.8).alias("x"), (c("id") % 200 / 10.0 + 1.0).alias("z"))
    sort = type(rows).sortWithinPartitions

    def noted(df, *keys, **kw):
        if "_stored" in df.columns and "_part" in df.columns:
            moved.append(df.where("_tag = 0").groupBy("layer_id", "_block", "_part").count().collect())
        return sort(df, *keys, **kw)

    monkeypatch.setattr(type(rows), "sortWithinPartitions", noted)
    got = horizon.near_skyline(observers, rows, layers, 8, 0.25, 12.0)
    assert got.agg(F.max("angle_deg").alias("a"), F.count("*").alias("n")).first()["n"] == 24_000
    far = [r for r in moved[0] if r["layer_id"] == "b" or r["_block"] > 2]
    assert {r["_part"] for r in far} == {0} and not any(r["layer_id"] == "b" for r in far)
    assert max(r["_part"] for r in moved[0]) == 3000 // rays.CROWD
    assert np.isclose(got.agg(F.max("angle_deg")).first()[0], 0.0)


def test_pairs_of_sites_and_epochs_are_not_exchanged(spark):
    from gridloom.plans import all_queries

    lit = all_queries()[0]["site_illumination"](spark, "/root/testdata/sf0.001")
    plan = lit._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[plan.index("MapInArrow"):plan.index("Join Cross")]
    assert "Repartition" not in pairs and "Join" not in pairs
    assert lit.count() == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
