"""Records of the whole log against their SQL, and rows of a replay without its changes."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom import fixtures as fx
from gridloom.operators import edits, fold, replay
from gridloom.plans import generation
from tools.check import norm

SF = "/root/testdata/sf0.001"
c = F.col


@pytest.mark.parametrize("name, kinds", [("edit_volumes", {"slope", "ramp", "smooth"}), ("edit_records", {"slope", "ramp", "smooth"}), ("construction_records", {"ramp"})])
def test_records_hold_every_kind_and_match_sql(spark, name, kinds):
    """Edits that read the ground have records, and what conserving edits give back counts: most of them balance."""
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(norm(r[k]) for k in cols) for r in df.select(*cols).collect()]
    cur = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(k) for k in cols]
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((str(type(v)), str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    ops = {r["seq"]: r for r in fx.operations(spark, SF).select("seq", "kind", "mass_conserving").collect()}
    numbers = [r[cols.index("seq")] for r in got] if "seq" in cols else [int(r[cols.index("feature_id")][-6:]) for r in got]
    assert kinds <= {ops[n]["kind"] for n in numbers}
    if "net" in cols:
        net = [abs(r[cols.index("net")]) for r, n in zip(got, numbers) if ops[n]["mass_conserving"]]
        assert len(net) > 200 and sum(v < 1e-4 for v in net) > 0.9 * len(net)


def test_rows_of_a_replay_count_changes_without_making_them(spark):
    layers, rows = fx.layers(spark, SF), fx.raster_rows(spark, SF)
    ops = edits.valid_ops(fx.operations(spark, SF), layers).where("seq < 300")
    out = replay.replay(ops, rows, layers, windows=2, block=1)
    f = fold.final_heights(out[0])
    want = f.groupBy("layer_id", "row").agg(F.count("*").alias("samples"), F.sum("changes").alias("changes"), F.sum(c("h").cast("double")).alias("height_sum"))
    got = {r["row"]: r for r in replay.touched_rows(out).collect()}
    wanted = want.collect()
    assert len(got) == len(wanted) > 300
    for r in wanted:
        assert (got[r["row"]]["samples"], got[r["row"]]["changes"]) == (r["samples"], r["changes"])
        assert got[r["row"]]["height_sum"] == pytest.approx(r["height_sum"], abs=1e-9)
    plan = generation.replay_log(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate" not in plan
