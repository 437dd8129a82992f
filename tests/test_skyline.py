"""Near skylines: rays are followed in legs, and observers at one place share them."""

from pyspark.sql import functions as F
from test_operators import flat_layer

from gridloom.operators import horizon

c = F.col


def test_only_rays_that_no_hole_ended_go_on(spark, monkeypatch):
    """Three observers, two at one place; a row of holes ends half of the rays in the first leg."""
    n, res = 600, 0.25
    layers, rows = flat_layer(spark, n, res, lambda r, k: 0.01 * (r % 7) + 0.02 * (k % 5))
    holed = rows.withColumn("heights", F.when(c("row") == 290, F.transform("heights", lambda v: F.lit(None).cast("float"))).otherwise(c("heights")))
    seen, march = [], horizon.march

    def counted(observers, rows, bins, steps, *rest, **named):
        seen.append((observers.count(), observers.select(F.sum(F.size("_bins"))).first()[0] if "_bins" in observers.columns else bins * observers.count()))
        return march(observers, rows, bins, steps, *rest, **named)

    monkeypatch.setattr(horizon, "march", counted)
    observers = spark.createDataFrame([(1, "a", 0.1, 0.1), (2, "a", 0.1, 0.1), (3, "a", 5.2, 1.3)], "observer_id long, layer_id string, x double, z double")
    legs = {(r["observer_id"], r["bin"]): r["angle_deg"] for r in horizon.near_skyline(observers, holed, layers, 36, res, 100.0).collect()}
    assert len(seen) > 1 and seen[0] == (2, 72) and 0 < seen[1][1] < 72
    monkeypatch.setattr(horizon, "LEG", 1 << 20)
    whole = {(r["observer_id"], r["bin"]): r["angle_deg"] for r in horizon.near_skyline(observers, holed, layers, 36, res, 100.0).collect()}
    assert len(whole) == 3 * 36 and legs == whole
    assert all(whole[1, b] == whole[2, b] for b in range(36))
