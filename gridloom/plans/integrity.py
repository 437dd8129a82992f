"""Log, manifest, configuration and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.codes import FEATURE_CLASS
from gridloom.fixtures import rnd, with_ctes
from gridloom.operators import admission, digests, estimate, grid, log, rules
from gridloom.operators.quantiles import exact_percentiles
from gridloom.plans.features import _R, FAULTY, ROCKS, craters, faulty_rocks
from gridloom.plans.features import CRATERS as CRATER_SQL
from gridloom.plans.raster import r6
from gridloom.registry import query

c = F.col


# ------------------------------------------------------------------ delta log
@query("delta_chain", with_ctes(
    """SELECT layer_id, count(*) AS deltas, count_if(p IS NOT NULL AND previous<>p) AS broken, min(CASE WHEN p IS NOT NULL AND previous<>p THEN seq END) AS first_broken FROM
       (SELECT *, lag(resulting) OVER (PARTITION BY layer_id ORDER BY seq) AS p FROM deltas) GROUP BY layer_id""", "deltas"))
def delta_chain(spark, sf):
    d = log.chain_breaks(fx.deltas(spark, sf))
    return d.groupBy("layer_id").agg(F.count("*").alias("deltas"), F.count_if("broken").alias("broken"),
                                     F.min(F.when(c("broken"), c("seq"))).alias("first_broken"))


@query("sequence_gaps", with_ctes(
    """SELECT revision, p+1 AS first_missing, seq-1 AS last_missing FROM (SELECT revision, seq, lag(seq) OVER (PARTITION BY revision ORDER BY seq) AS p FROM deltas) WHERE seq>p+1""", "deltas"))
def sequence_gaps(spark, sf):
    return log.sequence_gaps(fx.deltas(spark, sf))


@query("retained_window", with_ctes(
    """SELECT revision, seq, layer_id FROM deltas QUALIFY row_number() OVER (PARTITION BY revision ORDER BY seq DESC)<=256""", "deltas"))
def retained_window(spark, sf):
    return log.retained(fx.deltas(spark, sf)).select("revision", "seq", "layer_id")


@query("fetch_status", with_ctes(
    """SELECT o.revision, o.seq, CASE WHEN o.revision<>1 THEN 'stale_revision' WHEN k.seq IS NOT NULL THEN 'found' WHEN o.seq<(SELECT min(seq) FROM kept) THEN 'pruned' ELSE 'unknown' END AS status
       FROM (SELECT CASE WHEN event_id%17=0 THEN 2 ELSE 1 END::BIGINT AS revision, event_id+event_id%3 AS seq FROM events) o LEFT JOIN kept k ON o.seq=k.seq AND o.revision=1""", "deltas",
    kept="SELECT seq FROM deltas QUALIFY row_number() OVER (ORDER BY seq DESC)<=256"))
def fetch_status(spark, sf):
    e = c("event_id")
    req = fx.table(spark, sf, "events").select(F.when(e % 17 == 0, 2).otherwise(1).cast("long").alias("revision"), (e + e % 3).alias("seq"))
    return log.fetch_status(req, fx.deltas(spark, sf))


@query("changed_since", with_ctes(
    """SELECT layer_id, deltas, changed, reseated, tiles FROM (SELECT layer_id, count(*) AS deltas, sum(changed_count)::BIGINT AS changed, sum(rocks_reseated)::BIGINT AS reseated FROM d GROUP BY 1)
       JOIN (SELECT layer_id, count(DISTINCT t) AS tiles FROM (SELECT layer_id, unnest(changed_tiles) AS t FROM d) GROUP BY 1) USING (layer_id)""", "deltas",
    d="SELECT * FROM deltas WHERE seq>=(SELECT max(event_id)//2 FROM events)"))
def changed_since(spark, sf):
    half = fx.table(spark, sf, "events").agg(F.max("event_id").alias("m")).first()["m"] // 2
    tiles, sums = log.changed_since(fx.deltas(spark, sf), F.lit(half))
    return sums.join(tiles.groupBy("layer_id").agg(F.count("*").alias("tiles")), "layer_id")


@query("terminal_delta", with_ctes(
    """SELECT layer_id, seq, resulting, resulting=sha256(layer_id||':'||last) AS matches FROM (SELECT layer_id, max(seq) AS seq, arg_max(resulting, seq) AS resulting FROM deltas GROUP BY 1)
       JOIN (SELECT (['context-0','mission-1','operational-2'])[user_id%3+1] AS layer_id, max(event_id) AS last FROM events GROUP BY 1) USING (layer_id)""", "deltas"))
def terminal_delta(spark, sf):
    layer = F.element_at(fx.lit_array(["context-0", "mission-1", "operational-2"]), (c("user_id") % 3 + 1).cast("int"))
    state = fx.table(spark, sf, "events").groupBy(layer.alias("layer_id")).agg(F.max("event_id").alias("last"))
    digest = F.sha2(F.concat(c("layer_id"), F.lit(":"), c("last").cast("string")), 256)
    return log.terminal(fx.deltas(spark, sf)).join(state, "layer_id").select("layer_id", "seq", "resulting", (c("resulting") == digest).alias("matches"))


@query("delta_summary", with_ctes(
    """SELECT format('delta-{:06d}', seq) AS delta_id, seq, len(changed_tiles) AS tile_count, rocks_reseated, net, resulting FROM deltas""", "deltas"))
def delta_summary(spark, sf):
    return fx.deltas(spark, sf).select(F.format_string("delta-%06d", c("seq")).alias("delta_id"), "seq",
                                       F.size("changed_tiles").cast("long").alias("tile_count"), "rocks_reseated", "net", "resulting")


@query("delta_validity", with_ctes(
    """SELECT rule, count(*) AS deltas, min(seq) AS first_seq FROM (SELECT seq, unnest(list_filter([CASE WHEN removed<0 OR deposited<0 THEN 'negative_volume' END, CASE WHEN net<>deposited-removed THEN 'net' END,
       CASE WHEN rel_err<>CASE WHEN greatest(removed,deposited)>0 THEN abs(net)/greatest(removed,deposited) ELSE 0 END OR rel_err<0 OR rel_err>1 THEN 'relative_error' END,
       CASE WHEN seq%500=7 THEN 'payload' END, CASE WHEN (rocks_reseated=0)<>(seq%5=0) THEN 'rock_digest' END, CASE WHEN seq%777=1 THEN 'checksum' END], lambda v: v IS NOT NULL)) AS rule FROM deltas) GROUP BY rule""", "deltas"))
def delta_validity(spark, sf):
    s = c("seq")
    d = fx.deltas(spark, sf).withColumn("has_payload", s % 500 != 7).withColumn("rock_before", F.lit("r0")).withColumn(
        "rock_after", F.when(s % 5 == 0, "r0").otherwise("r1")).withColumn("previous", F.when(s % 777 == 1, "xyz").otherwise(c("previous")))
    v = rules.violations(d, rules.delta_rules())
    return v.select("seq", F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("deltas"), F.min("seq").alias("first_seq"))


@query("delta_admission", with_ctes(
    """SELECT action, count(*) AS deltas, min(arrival) AS first_arrival, max(expected) AS last_expected FROM (SELECT *, CASE WHEN revision<>1 THEN 'resync' WHEN seq<expected THEN 'ignore' WHEN seq>expected THEN 'fetch' ELSE 'apply' END AS action FROM
       (SELECT *, coalesce(max(CASE WHEN revision=1 THEN seq END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),-1)+1 AS expected FROM
        (SELECT event_id AS arrival, CASE WHEN event_id%19=4 THEN event_id-3 WHEN event_id%23=6 THEN event_id+2 ELSE event_id END AS seq, CASE WHEN event_id%29=1 THEN 2 ELSE 1 END AS revision FROM events))) GROUP BY action"""))
def delta_admission(spark, sf):
    e = c("event_id")
    a = fx.table(spark, sf, "events").select(
        e.alias("arrival"), F.when(e % 19 == 4, e - 3).when(e % 23 == 6, e + 2).otherwise(e).alias("seq"),
        F.when(e % 29 == 1, 2).otherwise(1).alias("revision"))
    return log.admission(a, 1).groupBy("action").agg(F.count("*").alias("deltas"), F.min("arrival").alias("first_arrival"),
                                                     F.max("expected").alias("last_expected"))


@query("sparse_apply", with_ctes(
    f"""SELECT layer_id, row, {rnd('sum(coalesce(v, h))')} AS total, count(v) AS changed FROM samples LEFT JOIN (SELECT 'context-0' AS layer_id, (event_id*31)%(n*64) AS idx, arg_max(value/1e3, event_id) AS v
        FROM events, n GROUP BY 2) p USING (layer_id) WHERE p.idx=row*64+col OR p.idx IS NULL GROUP BY ALL""".replace(
        "samples LEFT JOIN", "(SELECT *, row*64+col AS idx FROM samples) s LEFT JOIN").replace(" p USING (layer_id) WHERE p.idx=row*64+col OR p.idx IS NULL", " p USING (layer_id, idx)"), "samples"))
def sparse_apply(spark, sf):
    rows = fx.raster_rows(spark, sf)
    n = fx.raster_height(spark, sf)
    base = rows.select("layer_id", F.posexplode("heights").alias("col", "h"), "row").select(
        "layer_id", (c("row") * fx.WIDTH + c("col")).alias("idx"), c("h").cast("double").alias("value"))
    ch = fx.table(spark, sf, "events").select(F.lit("context-0").alias("layer_id"), ((c("event_id") * 31) % (n * fx.WIDTH)).alias("idx"),
                                              (c("value") / 1000.0).alias("value"), c("event_id").alias("seq"))
    touched = ch.select("layer_id", "idx").distinct().withColumn("hit", F.lit(1))
    out = log.latest_values(base, ch).join(touched, ["layer_id", "idx"], "left")
    return out.groupBy("layer_id", F.floor(c("idx") / fx.WIDTH).alias("row")).agg(
        r6(F.sum("value")).alias("total"), F.count("hit").alias("changed"))


@query("sparse_bounds", with_ctes(
    """SELECT seq, min(idx%64) AS c0, max(idx%64) AS c1, min(idx//64) AS r0, max(idx//64) AS r1, bool_and(coalesce(idx>p,true)) AS increasing FROM (SELECT seq, idx, lag(idx) OVER (PARTITION BY seq ORDER BY pos) AS p FROM
       (SELECT event_id AS seq, j AS pos, CASE WHEN event_id%37=0 AND j=3 THEN 0 ELSE (event_id*7)%1000+j*13 END AS idx FROM events, range(0,5) t(j))) GROUP BY seq"""))
def sparse_bounds(spark, sf):
    e = c("event_id")
    d = fx.table(spark, sf, "events").select(e.alias("seq"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.when(
        (e % 37 == 0) & (j == 3), 0).otherwise((e * 7) % 1000 + j * 13)).alias("indices"))
    i = c("indices")
    pick = lambda fn, f: fn(F.transform(i, f))
    return d.select("seq", pick(F.array_min, lambda v: v % 64).alias("c0"), pick(F.array_max, lambda v: v % 64).alias("c1"),
                    pick(F.array_min, lambda v: F.floor(v / 64)).alias("r0"), pick(F.array_max, lambda v: F.floor(v / 64)).alias("r1"),
                    F.forall(F.transform(F.slice(i, 2, 4), lambda v, k: v > F.get(i, k)), lambda ok: ok).alias("increasing"))


_PATH = {
    "good": """SELECT arrival, seq FROM deliveries LEFT JOIN (SELECT arrival, count(DISTINCT part) AS n, bool_and(ok) AS ok FROM delivered_parts GROUP BY 1) p USING (arrival)
        WHERE revision=1 AND n=n_parts AND ok""",
    "step": "SELECT a.arrival, min(b.arrival) AS next FROM good a JOIN good b ON b.seq=a.seq+1 AND b.arrival>a.arrival GROUP BY 1",
    "path": "SELECT min(arrival) AS arrival FROM good WHERE seq=0 UNION ALL SELECT next FROM path JOIN step USING (arrival)",
    "judged": """SELECT *, CASE WHEN revision<>1 THEN 'resync' WHEN seq<expected THEN 'ignore' WHEN seq>expected THEN 'fetch' WHEN applied THEN 'apply' ELSE 'roll back' END AS status FROM
        (SELECT arrival, seq, revision, p.a IS NOT NULL AS applied, coalesce(max(CASE WHEN p.a IS NOT NULL THEN seq END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+1, 0) AS expected
         FROM deliveries LEFT JOIN (SELECT arrival AS a FROM path) p ON a=arrival)""",
}


def _recursive(body, *names, **extra):
    return with_ctes(body, *names, **extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _line(spark, sf):
    return fx.deliveries(spark, sf), fx.delivered_parts(spark, sf), fx.delta_log(spark, sf, faults=False), 0, 1


@query("consumer_admission", _recursive("SELECT arrival, seq, expected, status FROM judged", "deliveries", "delivered_parts", **_PATH))
def consumer_admission(spark, sf):
    """What a consumer does with every delivery of a lossy line: apply, ignore, fetch, roll back or resync."""
    return admission.admit(*_line(spark, sf)).select("arrival", "seq", "expected", "status")


@query("consumer_copy", _recursive(
    """SELECT layer_id, idx, arg_max(value, seq*10+part) AS value, max(seq) AS seq FROM delivered_parts JOIN (SELECT arrival FROM judged WHERE status='apply') USING (arrival) GROUP BY ALL""",
    "deliveries", "delivered_parts", **_PATH))
def consumer_copy(spark, sf):
    """The copy after all deliveries: undone and ignored ones leave nothing behind."""
    nothing = spark.createDataFrame([], "layer_id string, idx long, value long")
    return admission.copy_after(nothing, fx.delivered_parts(spark, sf), admission.applied(*_line(spark, sf)))


@query("log_problems", with_ctes(
    """SELECT problem, count(*) AS n, min(seq) AS first_seq FROM (
       SELECT seq, 'terrain chain' AS problem FROM (SELECT seq, previous, lag(resulting) OVER (PARTITION BY layer_id ORDER BY seq) AS p FROM delta_log) WHERE previous<>p
       UNION ALL SELECT seq, 'rock chain' FROM (SELECT seq, rocks_before, lag(rocks_after) OVER (ORDER BY seq) AS p FROM delta_log) WHERE rocks_before<>p
       UNION ALL SELECT seq, 'sequence' FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM delta_log) WHERE seq<>p+1
       UNION ALL SELECT seq, 'newer revision' FROM delta_log WHERE revision>1
       UNION ALL SELECT d.seq, 'operation differs' FROM delta_log d LEFT JOIN sound_log o USING (seq) WHERE d.op IS DISTINCT FROM o.op
       UNION ALL SELECT NULL, 'operation count' WHERE (SELECT count(*) FROM sound_log)<>(SELECT count(*)+1 FROM events)
       UNION ALL SELECT NULL, 'delta count' WHERE (SELECT count(*) FROM delta_log)>(SELECT count(*)+1 FROM events)
       UNION ALL SELECT NULL, 'last sequence' WHERE (SELECT max(seq) FROM delta_log)<>(SELECT count(*) FROM events)) GROUP BY problem""", "sound_log", "delta_log"))
def log_problems(spark, sf):
    """Every break of a stored log whose next number was recorded one too high."""
    count = fx.table(spark, sf, "events").count() + 1
    found = admission.snapshot_problems(fx.delta_log(spark, sf), fx.delta_log(spark, sf, faults=False).select("seq", "op"), 1, count)
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# ------------------------------------------------------------------ manifests and digests
@query("artifact_manifest", with_ctes(
    """SELECT kind, count(*) AS files, sum(bytes)::BIGINT AS bytes, min(sha256||'  '||path) AS first_line FROM artifacts GROUP BY kind""", "artifacts"))
def artifact_manifest(spark, sf):
    a = fx.artifacts(spark, sf)
    line = F.format_string("%s  %s", c("sha256"), c("path"))
    return a.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min(line).alias("first_line"))


_DIFF = """SELECT coalesce(a.path,p.path) AS path, CASE WHEN p.path IS NULL THEN 'not in prior' WHEN a.path IS NULL THEN 'missing' WHEN a.sha256=p.sha256 THEN 'matched' ELSE 'mismatched' END AS status
    FROM artifacts a FULL JOIN prior_artifacts p ON a.path=p.path"""


def _manifest_diff(spark, sf):
    a, p = fx.artifacts(spark, sf), fx.prior_artifacts(spark, sf).select("path", c("sha256").alias("old"))
    status = (F.when(c("old").isNull(), "not in prior").when(c("sha256").isNull(), "missing")
              .when(c("sha256") == c("old"), "matched").otherwise("mismatched"))
    return a.select("path", "sha256").join(p, "path", "full").select("path", status.alias("status"))


@query("manifest_diff", with_ctes("SELECT status, count(*) AS files FROM diff GROUP BY status", "artifacts", "prior_artifacts", diff=_DIFF))
def manifest_diff(spark, sf):
    return _manifest_diff(spark, sf).groupBy("status").agg(F.count("*").alias("files"))


@query("manifest_mismatches", with_ctes("SELECT path FROM diff WHERE status='mismatched' ORDER BY path LIMIT 20", "artifacts", "prior_artifacts", diff=_DIFF))
def manifest_mismatches(spark, sf):
    return _manifest_diff(spark, sf).where(c("status") == "mismatched").orderBy("path").limit(20).select("path")


@query("layer_digest")
def layer_digest(spark, sf):
    return log.layer_digests(fx.raster_rows(spark, sf))


_TILE = 16


def _edited_rows(spark, sf):
    """Rows of one layer that the events overwrite samples of, with their last values."""
    n = fx.raster_height(spark, sf)
    i = (c("event_id") * 31) % (n * fx.WIDTH)
    last = fx.table(spark, sf, "events").groupBy(i.alias("idx")).agg(F.max_by("value", "event_id").alias("v"))
    new = last.groupBy(F.floor(c("idx") / fx.WIDTH).alias("row")).agg(
        F.map_from_entries(F.collect_list(F.struct((c("idx") % fx.WIDTH).cast("int").alias("k"), (c("v") / 1000.0).cast("float").alias("v")))).alias("new"))
    rows = fx.raster_rows(spark, sf).where(c("layer_id") == "context-0").join(new, "row")
    return rows.withColumn("heights", F.transform("heights", lambda h, k: F.coalesce(F.try_element_at("new", k), h))).drop("new")


@query("digest_update", with_ctes(
    """SELECT layer_id, row//16*4+col//16 AS tile, count(DISTINCT row) AS changed, 0::BIGINT AS missing, 0::BIGINT AS surplus, true AS heights_differ, false AS masks_differ
       FROM samples JOIN (SELECT 'context-0' AS layer_id, (event_id*31)%(n*64)//64 AS row, (event_id*31)%(n*64)%64 AS col, arg_max(value, event_id) AS v FROM events, n GROUP BY ALL)
       USING (layer_id, row, col) WHERE (v/1e3)::FLOAT<>h::FLOAT GROUP BY ALL""", "samples"))
def digest_update(spark, sf):
    """Tiles that a log of sample values changes, read off the digest tree before and after it was brought up to date."""
    before = digests.tree(fx.raster_rows(spark, sf), _TILE)
    after = digests.updated(before, _edited_rows(spark, sf), _TILE)
    return digests.differing_tiles(digests.differing(before, after, _TILE), _TILE)


@query("restore_check", with_ctes(
    """SELECT layer_id, row//16*4+col//16 AS tile, count(DISTINCT row) FILTER (row%211<>7) AS changed, count(DISTINCT row) FILTER (row%211=7) AS missing, 0::BIGINT AS surplus,
       bool_or(row%211=7 OR row%173=5 AND col=20) AS heights_differ, bool_or(row%211=7 OR row%199=3 AND col=50) AS masks_differ
       FROM samples WHERE row%211=7 OR row%173=5 AND col=20 OR row%199=3 AND col=50 GROUP BY ALL""", "samples"))
def restore_check(spark, sf):
    """Tiles in which a stored copy with lost rows, altered heights and altered classes differs from its source."""
    rows = fx.raster_rows(spark, sf)
    r = c("row")
    stored = rows.where(r % 211 != 7).withColumns({
        "heights": F.transform("heights", lambda h, k: F.when((r % 173 == 5) & (k == 20), (F.abs(h) + 1).cast("float")).otherwise(h)),
        "semantic": F.transform("semantic", lambda m, k: F.when((r % 199 == 3) & (k == 50), (m + 1).cast("tinyint")).otherwise(m))})
    return digests.differing_tiles(digests.differing(digests.tree(rows, _TILE), digests.tree(stored, _TILE), _TILE), _TILE)


@query("world_digest", with_ctes(
    """SELECT kind, sha256(string_agg(b, '' ORDER BY blk)) AS digest FROM (SELECT kind, doc//64 AS blk, sha256(string_agg(sha256, '' ORDER BY doc)) AS b FROM (SELECT kind, sha256, regexp_extract(path,'([0-9]+)',1)::BIGINT AS doc FROM artifacts) GROUP BY ALL) GROUP BY kind""", "artifacts"))
def world_digest(spark, sf):
    a = fx.artifacts(spark, sf).withColumn("doc", F.regexp_extract("path", "([0-9]+)", 1).cast("long"))
    join = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), ""), 256)
    blocks = a.groupBy("kind", F.floor(c("doc") / 64).alias("blk")).agg(join("doc", "sha256").alias("b"))
    return blocks.groupBy("kind").agg(join("blk", "b").alias("digest"))


@query("config_hash", with_ctes(
    """SELECT h.config_id, sha256(string_agg(concat_ws(':', center_x::DECIMAL(38,12), center_z::DECIMAL(38,12), length::DECIMAL(38,12), resolution::DECIMAL(38,12), role, width::DECIMAL(38,12)), ',' ORDER BY ord)
         ||'|'||any_value(concat_ws('|', max_bytes::DECIMAL(38,12), max_samples::DECIMAL(38,12), max_tiles::DECIMAL(38,12), coalesce(epoch,'null'), mode, coalesce(tile_size,64)))) AS hash
       FROM config_heads h JOIN config_layers USING (config_id) GROUP BY h.config_id""", "config_heads", "config_layers"))
def config_hash(spark, sf):
    return estimate.config_hashes(estimate.read_configs(fx.configs(spark, sf)))


_BAD = "CASE WHEN resolution>width THEN 'layers.resolution' END"


@query("config_issues", with_ctes(
    """SELECT path, count(*) AS issues, min(config_id) AS first_config FROM (SELECT config_id, 'layers['||ord||'].resolution' AS path FROM config_layers WHERE resolution>least(width,length)
       UNION ALL SELECT config_id, 'sun.epoch' FROM config_heads WHERE mode='ephemeris' AND epoch IS NULL UNION ALL SELECT s_suppkey, 'json' FROM supplier WHERE s_suppkey%31=30) GROUP BY path""", "config_layers", "config_heads"))
def config_issues(spark, sf):
    raw = fx.configs(spark, sf)
    torn = raw.where(c("config_id") % 31 == 30).select("config_id", F.lit("{not json").alias("json"))
    issues = estimate.config_issues(raw).unionByName(estimate.config_issues(torn))
    return issues.groupBy("path").agg(F.count("*").alias("issues"), F.min("config_id").alias("first_config"))


_EST = """SELECT config_id, role, ord, resolution, width, center_x, length, center_z, w, h, w*h AS samples, greatest(1,ceil((w-1)/(tile-1e0)))*greatest(1,ceil((h-1)/(tile-1e0))) AS tiles,
    w*h*10 AS field_bytes, w*h*32+(w-1)*(h-1)*24 AS mesh_bytes FROM (SELECT l.*, floor(width/resolution)::BIGINT+1 AS w, floor(length/resolution)::BIGINT+1 AS h, coalesce(tile_size,64) AS tile FROM config_layers l JOIN config_heads USING (config_id))"""


@query("grid_estimate", with_ctes(
    f"""SELECT config_id, sum(samples)::BIGINT AS samples, sum(tiles)::BIGINT AS tiles, sum(field_bytes)::BIGINT AS field_bytes, sum(mesh_bytes)::BIGINT AS mesh_bytes,
        (sum(samples)*5+floor(sum(mesh_bytes)*0.5e0+0.5e0))::BIGINT AS export_bytes, arg_min(role, resolution) AS finest,
        sum(floor(greatest(0e0,0.084e0*(power(greatest(1e0,resolution*4),-2)-power(50e0,-2))*width*length)+0.5e0)*(greatest(1e0,resolution*4)<50)::INT)::BIGINT AS craters, count_if(samples>250000) AS large_layers FROM est GROUP BY config_id""",
    "config_layers", "config_heads", est=_EST))
def grid_estimate(spark, sf):
    e = estimate.layer_estimates(estimate.read_configs(fx.configs(spark, sf)))
    return estimate.totals(e, large=250_000)


@query("feasibility", with_ctes(
    """SELECT config_id, CASE WHEN fb>max_bytes THEN 'memory_limit' WHEN ms>max_samples THEN 'sample_limit' WHEN tl>max_tiles THEN 'tile_limit' WHEN bad THEN 'layer_bounds' ELSE 'ok' END AS outcome FROM
       (SELECT config_id, sum(field_bytes) AS fb, max(samples) AS ms, sum(tiles) AS tl FROM est GROUP BY 1) JOIN config_heads USING (config_id) JOIN
       (SELECT config_id, bool_or(coalesce(center_x-width/2<px-pw/2-1e-9 OR center_x+width/2>px+pw/2+1e-9 OR center_z-length/2<pz-pl/2-1e-9 OR center_z+length/2>pz+pl/2+1e-9,false)) AS bad FROM
        (SELECT *, lag(center_x) OVER w AS px, lag(width) OVER w AS pw, lag(center_z) OVER w AS pz, lag(length) OVER w AS pl FROM est WINDOW w AS (PARTITION BY config_id ORDER BY resolution DESC, ord)) GROUP BY 1) USING (config_id)""",
    "config_layers", "config_heads", est=_EST))
def feasibility(spark, sf):
    return estimate.feasibility(estimate.read_configs(fx.configs(spark, sf)))


@query("grid_alloc", with_ctes(
    f"""SELECT config_id, role||'-'||ord AS layer_id, floor(width/resolution)::BIGINT+1 AS width_samples, {rnd('center_x-floor(width/resolution)*resolution/2')} AS min_x, {rnd('center_x+floor(width/resolution)*resolution/2')} AS max_x,
        abs(floor(width/resolution)*resolution-width)>1e-9 OR abs(floor(length/resolution)*resolution-length)>1e-9 AS snapped, {rnd('resolution/(5e0/1.01e0)')} AS pixels_per_sample FROM config_layers""", "config_layers"))
def grid_alloc(spark, sf):
    return estimate.allocate(estimate.read_configs(fx.configs(spark, sf)))


@query("nesting", with_ctes(
    """SELECT layer_id, role, lag(layer_id) OVER w AS parent, coalesce(min_x>=lag(min_x) OVER w-1e-6 AND max_x<=lag(max_x) OVER w+1e-6 AND min_z>=lag(min_z) OVER w-1e-6 AND max_z<=lag(max_z) OVER w+1e-6, true) AS inside,
       ordinal=(SELECT arg_min(ordinal, res) FROM layers) AS finest FROM layers WINDOW w AS (ORDER BY res DESC)""", "layers"))
def nesting(spark, sf):
    return estimate.nesting(fx.layers(spark, sf))


@query("relief_gate", with_ctes(
    """SELECT layer_id, count_if(active) AS active, count_if(NOT active) AS suppressed FROM (SELECT layer_id, source_eff_res IS NULL OR wl<source_eff_res AS active FROM layers, (SELECT (p_size/2e1) AS wl FROM part)) GROUP BY layer_id""", "layers"))
def relief_gate(spark, sf):
    spectrum = fx.table(spark, sf, "part").groupBy((c("p_size") / 20.0).alias("wavelength")).agg(F.count("*").alias("n"))
    return estimate.relief_gate(fx.layers(spark, sf), spectrum)


# ------------------------------------------------------------------ feature and restore audits
_AUDIT_F = """SELECT seq AS op_seq, CASE WHEN seq%71=0 THEN 'pad' ELSE kind END AS kind, layer_id, cls AS semantic_class, CASE WHEN seq%73=0 THEN cx+1 ELSE cx END AS cx, radius, CASE WHEN seq%79=0 THEN net+1 ELSE net END AS net
    FROM (SELECT o.*, d.net, CASE kind """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_CLASS.items()) + """ END AS cls FROM operations o JOIN deltas d USING (seq)) WHERE (cls IS NOT NULL OR seq%503=2) AND seq%67<>0"""


@query("audit_features", with_ctes(
    """SELECT problem, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, unnest(list_filter([CASE WHEN f.op_seq IS NULL THEN 'edit without feature' END, CASE WHEN f.op_seq IS NOT NULL AND NOT same_id THEN 'identity differs' END,
       CASE WHEN f.op_seq IS NOT NULL AND same_id AND (f.cx<>o.cx OR f.radius<>o.radius) THEN 'parameters diverge' END, CASE WHEN f.op_seq IS NOT NULL AND same_id AND d_net<>f.net THEN 'balance diverges' END], lambda v: v IS NOT NULL)) AS problem
       FROM (SELECT o.*, f.op_seq, f.cx AS fcx, d.net AS d_net, f.kind=o.kind AND f.layer_id=o.layer_id AND f.semantic_class=o.want AS same_id, f FROM want o LEFT JOIN feats f ON f.op_seq=o.seq LEFT JOIN deltas d ON d.seq=o.seq) o
       UNION ALL SELECT op_seq, 'feature without edit' FROM feats WHERE op_seq NOT IN (SELECT seq FROM want)) GROUP BY problem""".replace("f.op_seq IS", "o.op_seq IS").replace("(f.cx<>o.cx OR f.radius<>o.radius)", "(o.f.cx<>o.cx OR o.f.radius<>o.radius)").replace("d_net<>f.net", "d_net<>o.f.net"),
    "operations", "deltas", feats=_AUDIT_F, want="SELECT * FROM (SELECT *, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_CLASS.items()) + " END AS want FROM operations) WHERE want IS NOT NULL"))
def audit_features(spark, sf):
    ops, d = fx.operations(spark, sf), fx.deltas(spark, sf)
    table = F.create_map(*[F.lit(x) for kv in FEATURE_CLASS.items() for x in kv])
    s = c("seq")
    f = ops.join(d.select("seq", "net"), "seq").withColumn("semantic_class", F.try_element_at(table, c("kind"))).where(
        (c("semantic_class").isNotNull() | (s % 503 == 2)) & (s % 67 != 0)).select(
        s.alias("op_seq"), F.when(s % 71 == 0, "pad").otherwise(c("kind")).alias("kind"), "layer_id", "semantic_class",
        F.when(s % 73 == 0, c("cx") + 1).otherwise(c("cx")).alias("cx"), "radius", F.when(s % 79 == 0, c("net") + 1).otherwise(c("net")).alias("net"))
    return log.audit_features(ops, f, d).groupBy("problem").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("feature_validity", with_ctes(
    """SELECT kind, rule, count(*) AS features FROM (SELECT 'crater' AS kind, unnest(list_filter([CASE WHEN NOT depth>=0 THEN 'depth' END, CASE WHEN ellipticity>1 OR ellipticity<=0 THEN 'ellipticity' END], lambda v: v IS NOT NULL)) AS rule
         FROM (SELECT * REPLACE (CASE WHEN id%211=0 THEN -depth ELSE depth END AS depth, CASE WHEN id%307=0 THEN 1.5e0 ELSE ellipticity END AS ellipticity) FROM craters)
       UNION ALL SELECT 'rock', unnest(list_filter([CASE WHEN y IS NULL THEN 'position' END, CASE WHEN abs(sqrt(list_sum(list_transform(quaternion, lambda v: v*v)))-1)>1e-6 THEN 'quaternion' END], lambda v: v IS NOT NULL)) FROM faulty) GROUP BY ALL""",
    "crater_seeds", *_R, craters=CRATER_SQL, **ROCKS, faulty=FAULTY))
def feature_validity(spark, sf):
    cr = craters(spark, sf).withColumn("depth", F.when(c("id") % 211 == 0, -c("depth")).otherwise(c("depth"))).withColumn(
        "ellipticity", F.when(c("id") % 307 == 0, 1.5).otherwise(c("ellipticity")))
    a = rules.violations(cr, rules.crater_rules()).select(F.lit("crater").alias("kind"), F.explode("violations").alias("rule"))
    b = rules.violations(faulty_rocks(spark, sf), rules.rock_rules()).select(F.lit("rock").alias("kind"), F.explode("violations").alias("rule"))
    return a.unionByName(b).groupBy("kind", "rule").agg(F.count("*").alias("features"))


@query("restore_checks", with_ctes(
    """SELECT problem, count(*) AS rocks, min(rock_id) AS first_rock FROM (SELECT rock_id, CASE WHEN layer_id IS NULL THEN 'outside its layers' WHEN greatest(scale_x,scale_y,scale_z)>greatest(max_x-min_x,max_z-min_z) THEN 'larger than its layer'
       WHEN ground IS NULL THEN 'no surface' WHEN y-scale_y>ground+1e-3 THEN 'floating' WHEN y<ground-ext THEN 'below the terrain' ELSE 'ok' END AS problem FROM faulty LEFT JOIN layers USING (layer_id), (SELECT max(greatest(max_x-min_x,max_z-min_z)) AS ext FROM layers)) GROUP BY problem""",
    *_R, **ROCKS, faulty=FAULTY))
def restore_checks(spark, sf):
    layers = fx.layers(spark, sf)
    span = F.greatest(c("max_x") - c("min_x"), c("max_z") - c("min_z"))
    ext = layers.agg(F.max(span).alias("e")).first()["e"]
    r = faulty_rocks(spark, sf).join(layers.select("layer_id", span.alias("span")), "layer_id", "left")
    problem = (F.when(c("layer_id").isNull(), "outside its layers").when(F.greatest("scale_x", "scale_y", "scale_z") > c("span"), "larger than its layer")
               .when(c("ground").isNull(), "no surface").when(rules.floating(), "floating").when(c("y") < c("ground") - ext, "below the terrain").otherwise("ok"))
    return r.groupBy(problem.alias("problem")).agg(F.count("*").alias("rocks"), F.min("rock_id").alias("first_rock"))


@query("set_diff", with_ctes(
    """SELECT path, 'only current' AS side FROM (SELECT path FROM artifacts EXCEPT SELECT path FROM prior_artifacts) UNION ALL SELECT path, 'only prior' FROM (SELECT path FROM prior_artifacts EXCEPT SELECT path FROM artifacts)
       UNION ALL SELECT lower(source), 'repeated' FROM documents GROUP BY 1 HAVING count(*)>1""", "artifacts", "prior_artifacts"))
def set_diff(spark, sf):
    a, p = fx.artifacts(spark, sf), fx.prior_artifacts(spark, sf)
    only = lambda x, y, side: x.join(y.select("path"), "path", "left_anti").select("path", F.lit(side).alias("side"))
    dup = fx.table(spark, sf, "documents").groupBy(F.lower("source").alias("path")).count().where(c("count") > 1)
    return only(a, p, "only current").unionByName(only(p, a, "only prior")).unionByName(dup.select("path", F.lit("repeated").alias("side")))


@query("finite_guard", with_ctes(
    """SELECT status, count(*) AS edits, count_if(seq%2=0) AS even FROM (SELECT seq, CASE WHEN isnan(target) THEN 'not finite' WHEN abs(v)>3.4028235e38 THEN 'overflow' ELSE 'ok' END AS status FROM
       (SELECT seq, target, strength*CASE WHEN seq%401=0 THEN 1e40 ELSE 1e0 END AS v FROM operations)) GROUP BY status""", "operations"))
def finite_guard(spark, sf):
    v = c("strength") * F.when(c("seq") % 401 == 0, 1e40).otherwise(1.0)
    status = F.when(~rules.finite(c("target")), "not finite").when(F.abs(v) > 3.4028235e38, "overflow").otherwise("ok")
    return fx.operations(spark, sf).groupBy(status.alias("status")).agg(F.count("*").alias("edits"), F.count_if(c("seq") % 2 == 0).alias("even"))


@query("latency_percentiles", """SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS worst FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    """Nearest rank by narrowing histograms: no sort, and no group is gathered to find its percentile."""
    e = fx.table(spark, sf, "events").select("event_type", "value")
    return exact_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "worst": 1.0})


@query("job_progress", """SELECT conv_id AS job_id, max(turn) AS seq, arg_max(role, turn) AS stage, max(turn/8e0) AS progress FROM conversations GROUP BY conv_id""")
def job_progress(spark, sf):
    t = fx.table(spark, sf, "conversations")
    return t.groupBy(c("conv_id").alias("job_id")).agg(F.max("turn").alias("seq"), F.max_by("role", "turn").alias("stage"), F.max(c("turn") / 8.0).alias("progress"))


@query("validation_report", with_ctes(
    """SELECT * FROM (SELECT 'layer_'||layer_id||'_sample_count' AS check_id, count(*)=max(width*height) AS passed, NULL::BIGINT AS found FROM samples JOIN layers USING (layer_id) GROUP BY layer_id
       UNION ALL SELECT 'layer_'||layer_id||'_finite', count(*)=count(h), count(*)-count(h) FROM holes GROUP BY layer_id
       UNION ALL SELECT 'layer_'||layer_id||'_spacing', abs((max_x-min_x)/(width-1)-res)<res*1e-6, NULL FROM layers
       UNION ALL SELECT 'layer_'||layer_id||'_semantic_aligned', true, NULL FROM layers
       UNION ALL SELECT 'nesting_'||layer_id, true, NULL FROM layers WHERE ordinal>0
       UNION ALL SELECT 'rocks_not_floating', count_if(y-scale_y>ground+1e-3)=0, count_if(y-scale_y>ground+1e-3) FROM faulty
       UNION ALL SELECT 'rocks_burial_consistent', count_if(y-(ground+scale_y*(1-2*buried))>greatest(0.05e0,scale_y*0.5e0))=0, count_if(y-(ground+scale_y*(1-2*buried))>greatest(0.05e0,scale_y*0.5e0)) FROM faulty
       UNION ALL SELECT 'crater_geometry_plausible', count_if(d>diameter*0.25e0)=0, count_if(d>diameter*0.25e0) FROM (SELECT diameter, CASE WHEN id%211=0 THEN 0.3e0*diameter ELSE depth END AS d FROM craters)
       UNION ALL SELECT 'artifact_files_present', count_if(p.path IS NULL)=0, count_if(p.path IS NULL) FROM artifacts a LEFT JOIN prior_artifacts p USING (path)
       UNION ALL SELECT 'checksums_match', count_if(a.sha256<>p.sha256)=0, count_if(a.sha256<>p.sha256) FROM artifacts a JOIN prior_artifacts p USING (path))""",
    "samples", "holes", "layers", "artifacts", "prior_artifacts", "crater_seeds", "rock_seeds", craters=CRATER_SQL, **ROCKS, faulty=FAULTY))
def validation_report(spark, sf):
    from gridloom.operators import validation

    rows, layers = fx.raster_rows(spark, sf), fx.layers(spark, sf)
    cr = craters(spark, sf).withColumn("depth", F.when(c("id") % 211 == 0, c("diameter") * 0.3).otherwise(c("depth")))
    checks = (validation.layer_checks(rows, fx.with_holes(rows), layers).unionByName(validation.rock_checks(faulty_rocks(spark, sf)))
              .unionByName(validation.crater_check(cr)).unionByName(validation.artifact_checks(fx.artifacts(spark, sf), fx.prior_artifacts(spark, sf))))
    return checks.select("check_id", "passed", "found")
