"""Registered queries against their SQL texts on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom import fixtures as fx
from tools.check import norm

SF = "/root/testdata/sf0.001"
FAST = ["slope_class_summary", "bilinear_points", "quantise_u16", "tile_stride", "polar_roundtrip", "op_validity", "delta_chain",
        "manifest_diff", "grid_estimate", "leap_asof", "rock_ground", "edit_affine_fold", "annulus_pick", "stream_chain"]


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(norm(r[k]) for k in cols) for r in df.select(*cols).collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = [names.index(k) for k in cols]
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((str(type(v)), str(v)) for v in r)
    assert sorted(names) == cols and sorted(got, key=key) == sorted(want, key=key)


def test_merged_skyline_reaches_the_diagonal_in_every_degree(spark):
    """An observer without far site against a plain march from cell to diagonal."""
    df = entry.queries()["horizon_merge"](spark, SF)
    sites = spark.read.parquet(f"{SF}/supplier.parquet").agg(F.max("s_suppkey")).first()[0]
    got = {r["bin"]: r["angle_deg"] for r in df.where(F.col("observer_id") == sites + 40).collect()}
    at = fx.points(spark, SF).where(F.col("id") == sites + 40).first()
    rows = fx.with_holes(fx.raster_rows(spark, SF)).where("layer_id = 'context-0'").orderBy("row").select("heights").collect()
    grid = np.array([[math.nan if v is None else v for v in r["heights"]] for r in rows])
    (n, width), res = grid.shape, 0.25

    def height(x, z):
        col, row = x / res + (width - 1) / 2, z / res + (n - 1) / 2
        if not (0 <= col <= width - 1 and 0 <= row <= n - 1):
            return math.nan
        i, j = min(int(col), width - 2), min(int(row), n - 2)
        f, g = col - i, row - j
        return (grid[j, i] * (1 - f) + grid[j, i + 1] * f) * (1 - g) + (grid[j + 1, i] * (1 - f) + grid[j + 1, i + 1] * f) * g

    eye, reach = height(at["x"], at["z"]), math.hypot(width, n) * res
    want, longest = {}, 0
    for b in range(360):
        best, d = -90.0, res
        while d <= reach:
            h = height(at["x"] + math.sin(math.radians(b)) * d, at["z"] - math.cos(math.radians(b)) * d)
            if math.isnan(h):
                break
            best, longest = max(best, math.degrees(math.atan2(h - eye, d))), max(longest, d)
            d += res * (1 + d / reach * 8)
        want[b] = best
    assert sorted(got) == list(range(360)) and longest > 12
    np.testing.assert_allclose([got[b] for b in range(360)], [want[b] for b in range(360)], atol=1e-4)
