"""Features spread over raster rows: what is exchanged does not follow the rows."""

from test_operators import flat_layer

from gridloom.operators import fold


def test_features_are_dealt_out_in_groups_of_rows(spark):
    layers, _ = flat_layer(spark, 300, 0.25)
    features = spark.createDataFrame([(1, "a", -20.0, 20.0, -30.0, 30.0), (2, "a", 0.0, 0.1, 3.0, 3.1), (3, "a", 90.0, 95.0, 0.0, 1.0)],
                                     "seq long, layer_id string, x0 double, x1 double, z0 double, z1 double")
    spread = fold.box_rows(features, layers, {"min_x": "x0", "max_x": "x1", "min_z": "z0", "max_z": "z1"})
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")  # rows are made behind the exchange
    got = sorted((r["seq"], r["row"]) for r in spread.select("seq", "row").collect())
    lo = -299 * 0.125
    first, last = int((-30 - lo) // 0.25), -int(-(30 - lo) // 0.25)
    assert [v for v in got if v[0] == 1] == [(1, r) for r in range(first, last + 1)]
    assert len([v for v in got if v[0] == 2]) in (2, 3) and len(got) == len(set(got)) and not [v for v in got if v[0] == 3]
