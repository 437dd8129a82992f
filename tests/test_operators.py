"""Closed forms and brute-force comparisons on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import crater, geo, mobility, solar
from gridloom.operators import admission, digests, edits, ephemeris, estimate, fold, horizon, log, population, replay, rules, stencil, validation
from gridloom.operators.ordered import lag_in_order, running_sum_in_order, scan
from gridloom.sources import raster_io

c = F.col


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def flat_layer(spark, n=41, res=0.25, height=lambda r, k: 0.0):
    lo = -(n - 1) * res / 2
    layers = spark.sql(f"SELECT 0 AS ordinal, 'a' AS layer_id, 'context' AS role, {res}D AS res, {n} AS width, {n}L AS height, "
                       f"{lo}D AS min_x, {lo}D AS min_z, {-lo}D AS max_x, {-lo}D AS max_z")
    rows = spark.createDataFrame([("a", r, [float(np.float32(height(r, k))) for k in range(n)]) for r in range(n)],
                                 "layer_id string, row long, heights array<float>")
    return layers, rows


def op(seq, kind, **kw):
    base = dict(cx=0.0, cz=0.0, radius=1.0, strength=0.2, falloff=2.0, target=0.1, heading=30.0, length=2.0, polygon=None,
                noise_seed="s", semantic_class="berm", mass_conserving=False)
    base.update(kw)
    return (seq, kind, "a", *base.values())


OPS = ("seq long, kind string, layer_id string, cx double, cz double, radius double, strength double, falloff double, target double, "
       "heading double, length double, polygon array<struct<x:double,z:double>>, noise_seed string, semantic_class string, mass_conserving boolean")


def test_closed_forms(spark):
    r = one(spark, eq=crater.equilibrium_density(F.lit(3.0)), ratio=crater.fresh_depth_ratio(F.lit(500.0)),
            p1=mobility.pressure_sinkage(F.lit(4000.0), F.lit(0.2)), p2=mobility.pressure_sinkage(F.lit(2000.0), F.lit(0.2)),
            sx=geo.polar_forward(F.lit(-90.0), F.lit(12.0), F.lit(True))[0], leap=solar.leap_seconds(F.lit("2020-01-01").cast("timestamp_ntz")),
            half=solar.disc_fraction(F.lit(0.0), F.lit(0.27)))
    assert r["eq"] * 9 == pytest.approx(0.084)
    assert r["ratio"] == 0.2 and r["leap"] == 37 and r["half"] == pytest.approx(0.5)
    assert r["p2"] == pytest.approx(r["p1"] / 2)
    assert abs(r["sx"]) < 1e-9


def test_sun_at_south_pole_is_minus_sub_solar_latitude(spark):
    d = spark.sql("SELECT CAST('2024-06-21 12:00:00' AS TIMESTAMP) AS epoch")
    r = solar.at_site(solar.sub_solar(d), F.lit(-90.0), F.lit(0.0)).first()
    assert r["elevation_deg"] == pytest.approx(-r["sub_lat"], abs=1e-9)
    assert abs(r["sub_lat"]) < 1.6 and 1.45e11 < r["distance_m"] < 1.53e11


def test_cone_volume(spark):
    layers, rows = flat_layer(spark, n=201, res=0.02)
    ops = spark.createDataFrame([op(1, "spoil_pile", strength=0.3)], OPS)
    ch = fold.with_base(edits.changes(ops, layers), rows)
    v = ch.agg(F.sum(c("w") * 0.02 * 0.02).alias("v")).first()["v"]
    assert v == pytest.approx(math.pi * 0.3 / 3, rel=0.01)


def test_conserving_edit_balances(spark):
    layers, rows = flat_layer(spark)
    ops = spark.createDataFrame([op(1, "raise", mass_conserving=True), op(2, "crater_stamp", mass_conserving=True)], OPS)
    ch = fold.with_base(edits.changes(ops, layers), rows).withColumn("dh", edits.delta_on(c("base")))
    net = ch.groupBy("seq").agg(F.sum(c("dh") * c("res") * c("res")).alias("net"))
    back = edits.ring_changes(ops, net, layers).groupBy("seq").agg(F.sum(c("add") * c("cell")).alias("back"))
    for r in net.join(back, "seq").collect():
        assert r["net"] + r["back"] == pytest.approx(0.0, abs=1e-12)


def serial(n, res, ops, h, conserving=lambda o: False, volumes=None):
    """Plain loop over the log for the kinds used below, with float32 rounding at every write."""
    lo = -(n - 1) * res / 2
    for o in ops:
        seq, kind, _, cx, cz, r, s, p, target, heading, length = o[:11]
        ax, az = math.sin(math.radians(heading)), -math.cos(math.radians(heading))
        old = h.astype(np.float64)
        fall = lambda d, reach: 0.0 if d >= reach else (1 - d / reach) ** p
        fc, fr = (cx - lo) / res, (cz - lo) / res
        c0, r0 = int(fc), int(fr)
        tc, tr = fc - c0, fr - r0
        pivot = (old[r0, c0] * (1 - tc) * (1 - tr) + old[r0, c0 + 1] * tc * (1 - tr) + old[r0 + 1, c0] * (1 - tc) * tr + old[r0 + 1, c0 + 1] * tc * tr)
        near = old[int(math.floor(fr + 0.5)), int(math.floor(fc + 0.5))]
        band = max(2 * res, r * 0.25)
        change = np.zeros((n, n))
        ring = {}
        for row in range(n):
            for col in range(n):
                dx, dz = lo + col * res - cx, lo + row * res - cz
                d, along = math.sqrt(dx * dx + dz * dz), dx * ax + dz * az
                dh = 0.0
                inner = length + r + 2 * band if kind == "ramp" else r
                if inner <= d <= inner * 1.6:
                    ring[row, col] = (1 - (d - inner) / (inner * 0.6)) ** 2
                if kind == "raise":
                    dh = s * fall(d, r)
                elif kind == "flatten":
                    dh = (target - old[row, col]) * fall(d, r)
                elif kind == "slope":
                    dh = (pivot - along * (s / r) - old[row, col]) * fall(d, r)
                elif kind == "smooth" and 0 < row < n - 1 and 0 < col < n - 1:
                    mean = (old[row, col - 1] + old[row, col + 1] + old[row - 1, col] + old[row + 1, col]) / 4
                    dh = (mean - old[row, col]) * fall(d, r) * min(1, s)
                elif kind == "ramp" and 0 < along < length + band:
                    across = abs(dz * ax - dx * az)
                    lat = fall(max(0.0, across - r), band)
                    end = fall(band - along if along < band else max(0.0, along - length), band)
                    dh = (near + min(1, along / length) * (target - near) - old[row, col]) * lat * end
                change[row, col] = dh
        if conserving(o) and ring:
            net = change.sum()
            for at, w in ring.items():
                change[at] -= net * w / sum(ring.values())
        if volumes is not None:
            volumes[seq] = (int((change != 0).sum()), -change[change < 0].sum() * res * res, change[change > 0].sum() * res * res)
        h[:] = (old + change).astype(np.float32)
    return h


def test_replay_equals_serial_log(spark):
    n, res = 25, 0.25
    height = lambda r, k: 0.3 * math.sin(r * 0.7) + 0.1 * math.cos(k * 1.3)
    layers, rows = flat_layer(spark, n, res, height)
    kinds = ["raise", "smooth", "slope", "flatten", "ramp", "smooth", "slope", "raise", "ramp", "smooth"]
    ops = [op(i, k, cx=0.1 + 0.3 * math.sin(i), cz=-0.2 + 0.3 * math.cos(2 * i), radius=0.8 + 0.05 * i, strength=0.2 + 0.05 * i, length=1.0)
           for i, k in enumerate(kinds)]
    folded, rounds, _ = replay.replay(spark.createDataFrame(ops, OPS), rows, layers, conserving=False)
    got = fold.apply_to_rows(rows, fold.final_heights(folded)).orderBy("row").collect()
    want = serial(n, res, ops, np.array([[np.float32(height(r, k)) for k in range(n)] for r in range(n)], dtype=np.float32))
    assert rounds > 1
    np.testing.assert_allclose(np.array([r["heights"] for r in got]), want, atol=2e-7)


@pytest.mark.parametrize("windows", [None, 1, 3])
def test_replay_gives_conserving_edits_back_in_order(spark, windows):
    n, res = 25, 0.25
    height = lambda r, k: 0.3 * math.sin(r * 0.7) + 0.1 * math.cos(k * 1.3)
    layers, rows = flat_layer(spark, n, res, height)
    kinds = ["raise", "smooth", "slope", "flatten", "ramp", "smooth", "slope", "raise"]
    ops = [op(i, k, cx=0.1 + 0.3 * math.sin(i), cz=-0.2 + 0.3 * math.cos(2 * i), radius=0.8 + 0.05 * i, strength=0.2 + 0.05 * i, length=0.5,
              mass_conserving=i % 2 == 0) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(ops, OPS)
    folded, rounds, rejected = replay.replay(df, rows, layers, windows=windows)
    got = fold.apply_to_rows(rows, fold.final_heights(folded)).orderBy("row").collect()
    flag = df.columns.index("mass_conserving")
    start = np.array([[np.float32(height(r, k)) for k in range(n)] for r in range(n)], dtype=np.float32)
    volumes = {}
    want = serial(n, res, ops, start, lambda o: o[flag], volumes)
    assert rejected.isEmpty() and rounds > 2
    np.testing.assert_allclose(np.array([r["heights"] for r in got]), want, atol=4e-7)
    if windows == 3:
        rec = {r["seq"]: r for r in replay.records(folded, df, layers).collect()}
        assert rec.keys() == volumes.keys()
        for seq, (changed, removed, deposited) in volumes.items():
            assert rec[seq]["changed"] == changed
            assert (rec[seq]["removed"], rec[seq]["deposited"]) == pytest.approx((removed, deposited), abs=1e-6)
            assert not ops[seq][flag] or rec[seq]["rel_err"] < 1e-6


def test_replay_log_gives_conserving_edits_back(spark, monkeypatch):
    from gridloom.plans import generation

    seen, cols = [], "layer_id string, row long, col int, seq long, after float"

    def fake(ops, rows, layers, conserving=True):
        seen.append((conserving, ops.where("mass_conserving").isEmpty()))
        return spark.createDataFrame([("a", 0, 0, 1, 1.0)], cols), 1, None

    monkeypatch.setattr(replay, "replay", fake)
    generation.replay_log(spark, "/root/testdata/sf0.001")
    assert seen == [(True, False)]


def test_replay_rejects_an_edit_over_missing_ground_as_a_whole(spark):
    layers, rows = flat_layer(spark, 25, 0.25)
    holed = rows.withColumn("heights", F.when(c("row") == 12, F.transform("heights", lambda v, i: F.when(i != 12, v))).otherwise(c("heights")))
    ops = spark.createDataFrame([op(1, "raise"), op(2, "raise", cx=2.0, radius=0.5), op(3, "flatten", cx=-2.2, radius=0.4)], OPS)
    folded, _, rejected = replay.replay(ops, holed, layers)
    assert [tuple(r) for r in rejected.collect()] == [(1, 12, 12, 1)]
    assert {r["seq"] for r in folded.select("seq").distinct().collect()} == {2, 3}


def test_chains_of_bodies_of_any_length(spark):
    hops = [(i, i - 1) for i in range(1, 13)] + [(50, 51), (51, 52), (52, 50), (60, 61)]
    asked = spark.createDataFrame([(12,), (5,), (0,), (50,), (60,)], "body long")
    got = {r["body"]: (r["hops"], r["chain_status"]) for r in ephemeris.walk_chain(asked, spark.createDataFrame(hops, "target long, center long")).collect()}
    assert got[12] == (12, "ok") and got[5] == (5, "ok") and got[0] == (0, "ok")
    assert got[50][1] == "loop at 50" and got[60][1] == "missing 61"


def test_chain_positions_equal_a_walk(spark):
    """Trees of bodies with loops and ends, each segment with its own constant position, against a walk."""
    rng = random.Random(22)
    up = {i: rng.randrange(i) for i in range(1, 120)} | {i: i - 1 for i in range(120, 180)} | {200: 201, 201: 202, 202: 200, 203: 201, 204: 203, 210: 999}
    place = {b: (b + 0.5, -b * 2.0, b % 7 * 1.0) for b in up}
    segments = spark.createDataFrame(list(up.items()), "target long, center long")
    records = spark.createDataFrame([(b, 0, 5.0, 5.0, *[[v] for v in p]) for b, p in place.items()],
                                    "target long, rec long, mid double, radius double, coef_x array<double>, coef_y array<double>, coef_z array<double>")
    asked = [(i, 3.0, b) for i, b in enumerate([*up, 0, 555])] + [(1000, 99.0, 5)]
    got = {r["id"]: r for r in ephemeris.chain_positions(spark.createDataFrame(asked, "id long, et double, body long"), segments, records, 0.0, 10.0, 1).collect()}
    assert len(got) == len(asked)
    for i, et, b in asked:
        at, seen, total, status = b, set(), [0.0] * 3, "ok"
        while at != 0:
            if at in seen or at not in up:
                status = f"loop at {at}" if at in seen else f"missing {at}"
                break
            seen.add(at)
            total = [x + y for x, y in zip(total, place[at])]
            at = up[at]
        r = got[i]
        assert r["chain_status"] == status and r["covered"] == (et <= 10)
        if status == "ok" and et <= 10:
            assert [r["px"], r["py"], r["pz"]] == pytest.approx(total) and r["hops"] == len(seen)
        else:
            assert r["px"] is None


def test_holes_fill_beyond_many_passes(spark):
    n = 150
    rows = spark.createDataFrame([("a", r, [1.0 if k == 0 else None for k in range(n)]) for r in range(3)], "layer_id string, row long, heights array<float>")
    got = stencil.fill_no_data(rows).collect()
    assert all(v == 1.0 for r in got for v in r["heights"])


def test_rotations_and_configurations(spark):
    df = spark.sql("SELECT array(0D, 0D, sqrt(0.5D), sqrt(0.5D)) AS quaternion UNION ALL SELECT array(0D, 0D, 0D, 0.9D) UNION ALL SELECT array(1D) UNION ALL SELECT null")
    assert [r[0] for r in df.select(rules.bad_rotation()).collect()] == [False, True, True, True]
    text = '{"layers":[{"role":"a","width":9.0,"length":%s,"resolution":1.0,"center_x":%s,"center_z":0.0}],"sun":{"mode":"manual","epoch":%s}}'
    raw = [(i, text % v) for i, v in enumerate([("9.0", "0.0", "null"), ("9.5", "0.0", "null"), ("9.0", "0.25", "null"), ("9.0", "0.0", '"x"'), ("9.0", "0.0", "null")])]
    h = {r["config_id"]: r["hash"] for r in estimate.config_hashes(estimate.read_configs(spark.createDataFrame(raw, "config_id long, json string"))).collect()}
    assert h[0] == h[4] and len(set(h.values())) == 4


def test_fold_streams_a_hot_sample(spark):
    n = 30_000  # several Arrow batches on one sample
    ch = spark.range(n).select(F.lit("a").alias("layer_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), c("id").alias("seq"), F.lit(0).alias("mode"),
                               F.lit(0.0).alias("t"), (c("id") % 7 / 100.0).alias("w"), F.lit(0.5).alias("base"))
    h = np.float32(0.5)
    for i in range(n):
        h = np.float32(float(h) + (i % 7) / 100.0)
    got = fold.final_heights(fold.ordered_fold(ch)).first()
    assert got["changes"] == n and np.float32(got["h"]) == h


def test_thinning_is_greedy(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(rng.uniform(0, 10)), float(rng.uniform(0, 10)), float(rng.uniform(0.2, 3))) for i in range(120)]
    kept = []
    for o, x, z, d in pts:
        if all((x - a) ** 2 + (z - b) ** 2 >= (max(d, e) * 0.5) ** 2 for _, a, b, e in kept):
            kept.append((o, x, z, d))
    df = spark.createDataFrame(pts, "ord long, x double, z double, diameter double")
    got = sorted(r["ord"] for r in population.thin_by_exclusion(df, 1.0, 1.0).collect())
    assert got == [k[0] for k in kept]


def test_thinning_of_a_crowded_spot_lists_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pts = [(i, float(rng.normal(0, 0.2)), float(rng.normal(0, 0.2)), float(rng.uniform(0.01, 0.3))) for i in range(1500)]
    pts += [(i, float(rng.uniform(-40, 40)), float(rng.uniform(-40, 40)), 60.0 if i == 1777 else float(rng.uniform(0.5, 5))) for i in range(1500, 1800)]
    kept = []
    for o, x, z, d in pts:
        if all((x - a) ** 2 + (z - b) ** 2 >= (max(d, e) * 0.5) ** 2 for _, a, b, e in kept):
            kept.append((o, x, z, d))
    sizes, cut = [], population.cut_lineage
    monkeypatch.setattr(population, "HEADS", 40, raising=False)
    monkeypatch.setattr(population, "cut_lineage", lambda df: (out := cut(df), sizes.append(out.count()))[0])
    df = spark.createDataFrame([*pts, (1800, None, 0.0, 1.0)], "ord long, x double, z double, diameter double")
    got = sorted(r["ord"] for r in population.thin_by_exclusion(df, 1.0, 1.0).collect())
    assert got == [k[0] for k in kept] + [1800]
    assert max(sizes) <= 4 * len(pts)


def test_crater_counts_follow_expectation(spark):
    ends = spark.sql("SELECT 1D AS mn, 10D AS mx")
    bins = population.crater_bins(ends, F.lit(3.5), F.lit(250_000.0))
    want = bins.agg(F.sum("expected").alias("e")).first()["e"]
    got = population.craters(bins, (-250.0, 250.0, -250.0, 250.0), "test").count()
    assert abs(got - want) < 5 * math.sqrt(want)


def test_two_level_lag_and_sum(spark):
    df = spark.range(1000).where("id % 3 != 1").select((c("id") % 2).alias("k"), c("id").alias("o"), (c("id") * 2).alias("v"))
    rows = {(r["k"], r["o"]): r for r in lag_in_order(df, ["k"], "o", ["v"], bucket=64).collect()}
    sums = {(r["k"], r["o"]): r["s"] for r in running_sum_in_order(df, ["k"], "o", c("v"), "s", bucket=64).collect()}
    for k in (0, 1):
        order = sorted(o for kk, o in rows if kk == k)
        for i, o in enumerate(order):
            assert rows[k, o]["prev_v"] == (order[i - 1] * 2 if i else None)
            assert sums[k, o] == sum(x * 2 for x in order[: i + 1])


def test_scans_at_any_depth(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), o, rng.choice([None, rng.randrange(99)])) for o in rng.sample(range(-400, 3000), 500)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    names = ["last", "sum", "max", "min"]
    for levels in (1, 2, 5):
        out = df
        for kind in names:
            out = scan(out, ["k"], "o", c("v"), kind, kind, bucket=4, levels=levels)
        for r in out.collect():
            past = [v for k, o, v in sorted(rows, key=lambda x: x[1]) if k == r["k"] and o < r["o"] and v is not None]
            assert [r[n] for n in names] == [past[-1] if past else None, sum(past), max(past, default=None), min(past, default=None)]
    assert scan(df.limit(0), ["k"], "o", c("v"), "sum", "s").count() == 0


def serial_consumer(deliveries, parts, broken, start, revision):
    """Delivery by delivery in arrival order."""
    expected, out = start, {}
    for arrival, rev, seq, n in sorted(deliveries):
        mine = {}
        for a, part, want, got in parts:
            if a == arrival:
                mine[part] = mine.get(part, True) and want == got
        if rev != revision:
            status = "resync"
        elif seq is None or seq < expected:
            status = "ignore"
        elif seq > expected:
            status = "fetch"
        elif seq in broken:
            status = "resync"
        else:
            status = "apply" if len(mine) == n and all(mine.values()) else "roll back"
        out[arrival] = (expected, status)
        expected += status == "apply"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_consumer_equals_a_serial_one(spark, seed):
    rng = random.Random(seed)
    # Number 25 breaks its chain in the second log; a third of all deliveries repeat number 4.
    broken = {25} if seed == 2 else set()
    log_rows = [(s, "ab"[s % 2], f"r{s - 2}" if s not in broken else "wrong", f"r{s}") for s in range(3, 40)]
    deliveries, parts = [], []
    for arrival in range(900):
        seq = 4 if rng.random() < 0.33 else rng.choice([None, 99]) if rng.random() < 0.02 else min(39, max(3, arrival // 24 + rng.randrange(-2, 3)))
        n = rng.randrange(1, 4)
        deliveries.append((arrival, rng.choice([1] * 9 + [2]), seq, n))
        for part in range(n):
            if rng.random() < 0.9:
                parts.append((arrival, part, "x", "x" if rng.random() < 0.9 else rng.choice(["y", None])))
    d = spark.createDataFrame(deliveries, "arrival long, revision long, seq long, n_parts long")
    p = spark.createDataFrame(parts, "arrival long, part long, want string, got string")
    lg = spark.createDataFrame(log_rows, "seq long, layer_id string, previous string, resulting string")
    got = {r["arrival"]: (r["expected"], r["status"]) for r in admission.admit(d, p, lg, 3, 1).collect()}
    want = serial_consumer(deliveries, parts, broken, 3, 1)
    assert got == want and {"apply", "roll back", "fetch", "ignore", "resync"} <= {s for _, s in want.values()}


def test_path_through_ranges(spark):
    rng = random.Random(6)
    step = {n: n + rng.randrange(1, 9) for n in range(600) if n % 150 != 149}
    df = spark.createDataFrame(list(step.items()), "node long, to long")
    for start in (0, 3, 598, 10_000):
        want, n = [start], start
        while n in step:
            n = step[n]
            want.append(n)
        for parts in (1, 7, 40):
            got = admission.on_path(df, spark.createDataFrame([(start,)], "node long"), parts)
            assert sorted(r["node"] for r in got.collect()) == want
    assert admission.on_path(df, spark.createDataFrame([], "node long"), 7).count() == 0


def test_damaged_batch_is_rolled_back(spark):
    d = spark.createDataFrame([(0, 1, 0, 2), (1, 1, 1, 2), (2, 1, 2, 1), (3, 1, 1, 2)], "arrival long, revision long, seq long, n_parts long")
    parts = spark.createDataFrame([(0, 0, "p", "p", 5, 10), (0, 1, "p", "p", 6, 11), (1, 0, "p", "p", 5, 20), (1, 1, "p", "bad", 6, 21), (2, 0, "p", "p", 5, 30),
                                   (3, 0, "p", "p", 5, 20), (3, 1, "p", "p", 7, 22)], "arrival long, part long, want string, got string, idx long, value long").withColumn("layer_id", F.lit("a"))
    lg = spark.createDataFrame([(s, "a", f"r{s - 1}", f"r{s}") for s in range(3)], "seq long, layer_id string, previous string, resulting string")
    base = spark.createDataFrame([("a", i, 1) for i in (5, 6, 7, 8)], "layer_id string, idx long, value long")
    copy = lambda n: {r["idx"]: r["value"] for r in admission.copy_after(
        base, parts, admission.admit(d.where(c("arrival") < n), parts, lg, 0, 1)).collect()}
    assert copy(3) == {5: 10, 6: 11, 7: 1, 8: 1}
    assert copy(4) == {5: 20, 6: 11, 7: 22, 8: 1}
    assert copy(0) == {5: 1, 6: 1, 7: 1, 8: 1}


def test_digest_trees(spark):
    import hashlib

    rng = random.Random(2)
    make = lambda n, w: [[None if rng.random() < 0.1 else float(np.float32(rng.random())) for _ in range(w)] for _ in range(n)]
    data = {"a": make(23, 10), "b": make(5, 3)}
    frame = lambda d, only=None: spark.createDataFrame(
        [(k, r, v, [r % 7] * len(v)) for k, rows in d.items() for r, v in enumerate(rows) if only is None or (k, r) in only],
        "layer_id string, row long, heights array<float>, semantic array<tinyint>")
    flat = lambda levels: [sorted(map(tuple, x.collect())) for x in levels]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one = digests.tree(frame(data), 4)
    # Leaves and one tile against a plain loop.
    part = lambda k, r, t: np.array([np.nan if h is None else h for h in data[k][r][t * 4:t * 4 + 4]], "<f4").tobytes()
    want = {("a", (r // 4 * 3 + t) * 4 + r % 4): sha(part("a", r, t)) for r in range(23) for t in range(3)}
    assert {(x[0], x[1]): x[2] for x in flat(one)[0] if x[0] == "a"} == want
    tile = {(x[0], x[1]): x[2] for x in flat(one)[1]}
    assert tile["a", 2] == sha(",".join(f"{8 + i}:{want['a', 8 + i]}" for i in range(4)).encode())
    assert [x[:2] for x in flat(one)[-1]] == [("a", 0), ("b", 0)]
    # Replacing rows gives the tree of the new rows, and the way down finds exactly their tiles.
    data["a"][9][5], data["a"][22][0], data["b"][4][2] = 7.0, 8.0, 9.0
    two = digests.updated(one, frame(data, {("a", 9), ("a", 22), ("b", 4), ("b", 1)}), 4)
    assert flat(two) == flat(digests.tree(frame(data), 4))
    bad = {(r["layer_id"], r["node"]): (r["status"], r["heights_differ"], r["masks_differ"]) for r in digests.differing(one, two, 4).collect()}
    assert bad == {k: ("changed", True, False) for k in (("a", (2 * 3 + 1) * 4 + 1), ("a", (5 * 3) * 4 + 2), ("b", 4))}
    assert digests.differing(one, digests.tree(frame(data, {("b", r) for r in range(4)}), 4), 4).where("status = 'missing'").count() == 23 * 3 + 1
    # An absent mask is a value of its own; equal trees do not differ; an empty layer has no root.
    assert {x[3] for x in flat(digests.tree(frame(data), 4, mask=None))[0]} == {sha(b"")}
    assert digests.differing(two, digests.tree(frame(data), 4), 4).count() == 0
    assert flat(digests.tree(frame({}), 4)) == [[], []]


def test_chain_break_is_found_across_buckets(spark):
    d = spark.createDataFrame([("a", 1, "x", "r1"), ("a", 9000, "r1", "r2"), ("a", 9001, "bad", "r3")], "layer_id string, seq long, previous string, resulting string")
    assert {r["seq"]: r["broken"] for r in log.chain_breaks(d).collect()} == {1: False, 9000: False, 9001: True}


def test_raw_rasters_round_trip(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(3, 4)
    data[1, 2] = np.nan
    (tmp_path / "a.rf32").write_bytes(data.tobytes())
    got = raster_io.read_float32(spark, str(tmp_path / "a.rf32"), 4, "a").orderBy("row").collect()
    assert [r["row"] for r in got] == [0, 1, 2] and got[1]["heights"] == [4.0, 5.0, None, 7.0]
    ints = np.array([[1, -32768], [3, 4]], dtype=">i2")
    (tmp_path / "b.img").write_bytes(ints.tobytes())
    got = raster_io.read_int16(spark, str(tmp_path / "b.img"), 2, "b", little_endian=False, scale=0.5, missing=-32768).orderBy("row").collect()
    assert [r["heights"] for r in got] == [[0.5, None], [1.5, 2.0]]


def test_fill_converges(spark):
    _, rows = flat_layer(spark, 9, 1.0, lambda r, k: 2.0)
    holed = rows.withColumn("heights", F.transform("heights", lambda v, i: F.when(~(c("row").between(2, 6) & i.between(2, 6)), v)))
    out = stencil.fill_no_data(holed).collect()
    assert all(v == 2.0 for r in out for v in r["heights"])


def test_metadata_and_rules(spark):
    m = spark.sql("SELECT 'right' AS handedness, '+Y' AS up_axis, '+X' AS east_axis, '-Z' AS north_axis, 's' AS master_seed, CAST(NULL AS STRING) AS configuration_hash, array('x') AS synthetic_heuristics")
    got = {r["check_id"]: r["passed"] for r in validation.metadata_checks(m).collect()}
    assert got == {"coordinate_system_declared": True, "provenance_complete": False, "synthetic_labelled": True}
    bal = spark.sql("SELECT 1D AS removed, 3D AS deposited, 2D AS net, 2D/3D AS rel_err")
    assert rules.violations(bal, rules.balance_rules()).first()["violations"] == []


def test_finest_of_ten_thousand_layers(spark):
    """Layers of all sizes, stacks of equal ones and lone points among them, against a scan of all layers."""
    import numpy as np

    from gridloom.operators import sampling

    rng = np.random.default_rng(8)
    n = 10_000
    side = 10 ** rng.uniform(-2, 3, n)
    x0, z0 = rng.uniform(-500, 500, n), rng.uniform(-500, 500, n)
    x0[:2000], z0[:2000], side[:2000] = 40.0, 40.0, 64.0  # one stack
    res = rng.integers(1, 40, n) / 10.0
    rows = [(f"l{i}", i, float(res[i]), float(x0[i]), float(x0[i] + side[i]), float(z0[i]), float(z0[i] + side[i] / 2)) for i in range(n)]
    layers = spark.createDataFrame(rows, "layer_id string, ordinal int, res double, min_x double, max_x double, min_z double, max_z double")
    pts = [(i, float(x), float(z)) for i, (x, z) in enumerate(rng.uniform(-700, 700, (400, 2)))] + [(400, 40.0, 40.0), (401, 104.0, 72.0), (402, None, 1.0)]
    got = {r["id"]: r["layer_id"] for r in sampling.finest_layer(spark.createDataFrame(pts, "id int, x double, z double"), layers).collect()}
    for i, x, z in pts:
        over = [(r[2], r[1], r[0]) for r in rows if x is not None and r[3] <= x <= r[4] and r[5] <= z <= r[6]]
        assert got[i] == (min(over)[2] if over else None)
    stack = sampling.layer_cells(layers.where("ordinal < 2000")).selectExpr("max(size(found)) AS m").first()["m"]
    assert len(got) == 403 and stack <= 2000
    assert sampling.finest_layer(spark.createDataFrame(pts, "id int, x double, z double"), layers.limit(0)).where("layer_id IS NOT NULL").count() == 0


def test_percentiles_by_narrowing_histograms(spark):
    """A third of the rows in one value, ties, signs, infinities of scale, NaN and nulls, against sorted lists."""
    import math

    from gridloom.operators.quantiles import exact_percentiles

    rng = random.Random(16)
    rows = [("hot", 7.25)] * 900 + [("hot", rng.gauss(0, 1e3)) for _ in range(1500)] + [("hot", 7.25 + k * 2.0**-50) for k in range(300)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1.0)] + [("nan", float("nan"))] * 3 + [("nan", 1.0)]
    rows += [("one", 3.0), ("none", None), (None, 2.0), (None, 4.0), ("hot", None)]
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "worst": 1.0, "least": 0.0}
    got = {r["g"]: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares, bins=16).collect()}
    groups = {g: sorted((v for k, v in rows if k == g and v is not None), key=lambda v: (math.isnan(v), v)) for g, _ in rows}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, r in got.items():
        v = groups[g]
        for name, p in shares.items():
            want = v[max(1, math.ceil(p * len(v))) - 1]
            assert r[name] == want or (math.isnan(r[name]) and math.isnan(want)), (g, name, r[name], want)


def test_raw_rasters_by_row_ranges(spark, tmp_path):
    """Files written by ranges, read whole and by window, with digests; bad lengths and values are errors."""
    import hashlib
    import pathlib

    from gridloom.sources import raw_raster

    rng = random.Random(4)
    rows = [(name, r, [None if rng.random() < 0.1 else round(rng.uniform(-9, 9), 2) for _ in range(7)]) for name in ("a", "b b") for r in range(150)]
    df = spark.createDataFrame(rows, "layer_id string, row long, heights array<float>").repartition(6)
    small = {"dtype": "i2", "endian": "big", "scale": 0.01, "missing": -32768}
    for options in ({}, small):
        path = str(tmp_path / f"r{len(options)}")
        raw_raster.write_raw(df, path, 7, **options)
        for name in ("a", "b b"):
            whole = raw_raster.read_raw(spark, f"{path}/{name}", 7, name, partition_rows=11, **options)
            window = whole.where("row >= 40 AND row < 61 AND row <> 50")
            assert whole.rdd.getNumPartitions() > window.rdd.getNumPartitions() > 0
            for got, keep in ((whole, range(150)), (window, [r for r in range(40, 61) if r != 50])):
                want = {r: h for n, r, h in rows if n == name and r in keep}
                seen = {x["row"]: x["heights"] for x in got.collect()}
                assert set(seen) == set(want)
                for r, h in want.items():
                    assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-5) for x, y in zip(seen[r], h))
    files = [p for p in pathlib.Path(tmp_path / "r0").rglob("*.raw")]
    found = {r["path"]: r for r in raw_raster.artifacts(spark, str(tmp_path / "r0")).collect()}
    assert {p: r["sha256"] for p, r in found.items()} == {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    for p, r in ((r["path"], r) for r in raw_raster.artifacts(spark, str(tmp_path / "r0"), 100).collect()):
        body = pathlib.Path(p).read_bytes()
        parts = [hashlib.sha256(body[i:i + 100]).hexdigest() for i in range(0, len(body), 100)]
        assert r["ranges"] == len(parts) and r["sha256"] == (hashlib.sha256("".join(parts).encode()).hexdigest() if len(parts) > 1 else parts[0])
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "none.raw").write_bytes(b"")
    assert [tuple(r)[1:3] for r in raw_raster.artifacts(spark, str(tmp_path / "empty")).collect()] == [(0, False)]
    assert raw_raster.read_raw(spark, str(tmp_path / "absent"), 7, "a").count() == 0
    (tmp_path / "cut.raw").write_bytes(b"x" * 29)
    with pytest.raises(Exception, match="no whole rows"):
        raw_raster.read_raw(spark, str(tmp_path / "cut.raw"), 7, "a").count()
    with pytest.raises(Exception, match="do not fit"):
        raw_raster.write_raw(df, str(tmp_path / "over"), 7, dtype="i2", scale=1e-6, missing=0)


def test_near_rays_over_several_blocks_of_rows(spark):
    n, width, bins, res = 600, 12, 24, 0.5
    height = lambda r, k: math.sin(r * 0.7) + 0.01 * r + 0.3 * k
    hole = lambda r, k: (r, k) in ((300, 5), (300, 6), (40, 2), (590, 7))
    layers = spark.sql(f"SELECT 'a' AS layer_id, {res}D AS res, {width} AS width, {n}L AS height, 0D AS min_x, 0D AS min_z, {(width - 1) * res}D AS max_x, {(n - 1) * res}D AS max_z")
    grid = [[None if hole(r, k) else float(np.float32(height(r, k))) for k in range(width)] for r in range(n)]
    rows = spark.createDataFrame([("a", r, grid[r]) for r in range(n)], "layer_id string, row long, heights array<float>")
    points = [(1, 2.6, 127.9), (2, 2.7, 20.3), (3, 0.0, 0.0), (4, 50.0, 3.0)]
    observers = spark.createDataFrame([(i, "a", x, z) for i, x, z in points], "observer_id long, layer_id string, x double, z double")
    steps = horizon.ladder(res, res, 400.0)

    def read(x, z):
        f, g = x / res, z / res
        if not (0 <= f <= width - 1 and 0 <= g <= n - 1):
            return None
        a, b, u, v = int(f), int(g), f - int(f), g - int(g)
        four = [grid[y][k] for y in (b, min(b + 1, n - 1)) for k in (a, min(a + 1, width - 1))]
        return None if None in four else four[0] * (1 - u) * (1 - v) + four[1] * u * (1 - v) + four[2] * (1 - u) * v + four[3] * u * v

    want = {}
    for i, x, z in points[:3]:
        for k in range(bins):
            az, best = math.radians(k * 15.0), -90.0
            for d in steps:
                h = read(x + math.sin(az) * d, z - math.cos(az) * d)
                if h is None:
                    break
                best = max(best, math.degrees(math.atan2(h - read(x, z), d)))
            want[i, k] = best
    out = horizon.near_skyline(observers, rows, layers, bins, res, 400.0)
    assert {(r["observer_id"], r["bin"]): pytest.approx(r["angle_deg"], abs=1e-9) for r in out.collect()} == want
    # No row per sample: rays are followed inside tasks.
    assert "posexplode" not in out._jdf.queryExecution().toString()


def test_digests_of_many_short_ranges_share_partitions(spark, tmp_path):
    import hashlib

    from gridloom.sources import raw_raster

    bodies = {"a": bytes(range(256)) * 40, "b": b"", "c": b"x" * 5000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    raw_raster.register(spark)
    parts = spark.read.format("file_digests").options(path=str(tmp_path), range_bytes="16").load()
    assert parts.rdd.getNumPartitions() == 1
    want = {(n, i, hashlib.sha256(b[i:i + 16]).hexdigest()) for n, b in bodies.items() for i in range(0, max(len(b), 1), 16)}
    assert {(r["path"].rsplit("/", 1)[1], r["at"], r["sha256"]) for r in parts.collect()} == want
    several = spark.read.format("file_digests").options(path=str(tmp_path), range_bytes="4096", partition_bytes="8192").load()
    assert several.rdd.getNumPartitions() == 3 and several.count() == 6


def test_unlit_runs_across_stretches(spark):
    rng = np.random.default_rng(9)
    light = {1: np.where(rng.random(20000) < 0.5, 0.0, 0.5), 2: np.zeros(13000), 3: np.ones(9000), 4: np.ones(30000), 5: np.array([0.0])}
    light[4][4000:17000] = 0.0
    rows = [(k, i, float(v)) for k, vs in light.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "observer_id long, ord long, fraction double")
    got = {r["observer_id"]: r for r in horizon.illumination(df).collect()}
    for k, vs in light.items():
        longest = run = 0
        for v in vs:
            run = 0 if v > 0 else run + 1
            longest = max(longest, run)
        r = got[k]
        assert (r["longest_dark"], r["epochs"], r["always_dark"]) == (longest, len(vs), not (vs > 0).any())
        assert r["mean_fraction"] == pytest.approx(vs.mean()) and r["lit_share"] == pytest.approx((vs > 0).mean())
    # Every observer at every epoch: the same figures, and no exchange of pairs.
    sites = spark.createDataFrame([(7,), (8,)], "observer_id long")
    both = horizon.illumination_of_all(sites, df.where("observer_id = 1").select("ord", "fraction"), "ord", c("fraction"))
    want = got[1].asDict() | {"observer_id": None}
    assert [r.asDict() | {"observer_id": None} for r in both.collect()] == [want, want]


def test_painted_classes_equal_the_records_of_samples(spark):
    layers, rows = flat_layer(spark)
    rows = rows.withColumn("semantic", F.transform("heights", lambda _h, k: ((c("row") + k) % 12).cast("tinyint")))
    square = [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]
    ops = [op(i, ("semantic_paint", "ramp", "pad", "spoil_pile", "wheel_track", "polygonal_cut", "raise")[i % 7], cx=(i % 5) - 2.0, cz=(i % 9) - 4.0,
              heading=i * 31.0, polygon=square if i % 7 == 5 else None, semantic_class="berm" if i % 2 else edits.SEMANTIC_CLASSES[0]) for i in range(40)]
    df = spark.createDataFrame(ops, OPS)
    want = edits.paint_changes(edits.changes(edits.without_readings(df), layers), rows)
    got = edits.painted(df, rows, layers)
    key = lambda d: sorted(tuple(r) for r in d.select("layer_id", "row", "col", "code", "paints", "old_code").collect())
    assert key(got) == key(want) and any(r[3] == 0 for r in key(got))
