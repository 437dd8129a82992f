"""Folding inside blocks of rows: against the fold by sample, across Arrow batches, and what it moves."""

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.operators import edits, fold
from gridloom.plans import edits as plans

SF = "/root/testdata/sf0.001"
c = F.col


def test_blocks_fold_as_samples_do_across_batches(spark):
    """Seven records a batch, so blocks go on in the next one; a tenth of the stored rows is missing and every 97th sample null."""
    ops, layers = plans.plain_ops(spark, SF)
    rows = fx.with_holes(fx.raster_rows(spark, SF)).where(c("row") % 10 != 3)
    want = fold.ordered_fold(fold.with_base(edits.changes(ops, layers), rows)).select("layer_id", "row", "col", "seq", "before", "dh", "after").collect()
    last = {}
    for r in sorted(want, key=lambda r: r["seq"]):
        at = (r["layer_id"], r["row"], r["col"])
        last[at] = (r["after"], last.get(at, (0, 0))[1] + 1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = edits.folded_changes(ops, rows, layers).select("layer_id", "row", "col", "seq", "before", "dh", "after").collect()
        final = edits.folded_changes(ops, rows, layers, steps=False).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(want) > 10_000 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {(r["layer_id"], r["row"], r["col"]): (r["h"], r["changes"]) for r in final} == last


def test_edits_are_moved_instead_of_their_samples(spark):
    """No join or exchange of the plan comes after samples are made, but the one of the records."""
    for name in ("edit_volumes", "construction_records", "edit_affine_fold"):
        from gridloom.plans import all_queries

        plan = all_queries()[0][name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


def test_stamped_heights_are_those_of_the_fold_by_sample(spark):
    from gridloom.operators import stamping
    from gridloom.plans import features

    seeds, layers = features.craters_on_all_layers(spark, SF)
    rows = fx.raster_rows(spark, SF)
    ch = stamping.crater_changes(seeds, layers)
    want = fold.final_heights(fold.ordered_fold(fold.with_base(ch, rows))).join(stamping.last_zone(ch), ["layer_id", "row", "col"])
    keys = ["layer_id", "row", "col", "h", "changes", "code"]
    got = stamping.stamped_heights(seeds, rows, layers).select(*keys)
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*keys)).isEmpty()
    assert features.crater_stamp_grid(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_crater_seeds_send_no_table_to_the_driver(spark):
    plan = fx.crater_seeds(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_polygon_totals_are_those_of_the_column_expressions(spark):
    from gridloom.functions import brush

    layers = fx.layers(spark, SF)
    ops = edits.valid_ops(fx.operations(spark, SF), layers).where(c("kind").startswith("polygonal"))
    s = fold.explode_boxes(edits.geometry(ops, layers), layers, edits.BOX)
    want = {r["seq"]: r for r in s.groupBy("seq").agg(
        F.count_if(brush.inside_polygon(c("x"), c("z"), c("segments"))).alias("inside"),
        F.sum(brush.boundary_distance(c("x"), c("z"), c("segments"))).alias("d")).collect()}
    got = {r["seq"]: r for r in edits.polygon_totals(ops, layers).collect()}
    assert set(got) == set(want) and len(got) > 50
    for seq, r in got.items():
        assert r["inside"] == want[seq]["inside"] and abs(r["distance_sum"] - want[seq]["d"]) < 1e-9 * max(1, r["distance_sum"])


def test_rock_counts_are_dealt_out(spark):
    from gridloom.plans import all_queries

    plan = all_queries()[0]["rock_sfd"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_large_batches_are_staged_as_several_files(spark, tmp_path):
    from gridloom.streaming import log_stream

    df = spark.range(3000).withColumn("layer_id", F.lit("a"))
    path, files = log_stream.stage_batches(df, f"{tmp_path}/in", "id", 3, file_rows=100)
    assert files == 10 and len(spark.read.parquet(path).inputFiles()) == 30
    seen = []
    log_stream.run(log_stream.file_stream(spark, path, df.schema, files), lambda b, n: seen.append(sorted(r[0] for r in b.select("id").collect())), f"{tmp_path}/ck")
    assert seen == [list(range(1000)), list(range(1000, 2000)), list(range(2000, 3000))]
    # Order values with a gap: an empty group cannot have ten files.
    path, files = log_stream.stage_batches(df.where("id < 900 or id = 2999"), f"{tmp_path}/gap", "id", 3, file_rows=30)
    assert files == 1 and spark.read.parquet(path).count() == 901
