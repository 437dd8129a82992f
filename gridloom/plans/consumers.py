"""Consumer-side jobs and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.fixtures import rnd, with_ctes
from gridloom.operators import consumer, rules
from gridloom.plans.features import _R, FAULTY, ROCKS, faulty_rocks
from gridloom.plans.raster import r6
from gridloom.registry import query
from gridloom.session import scratch_path
from gridloom.sources import labels, raster_io

c = F.col
_BANDS = """SELECT layer_id, b.tag AS tag, b.col0 AS col0, b.row0 AS row0, b.w AS w, b.h AS h FROM (SELECT *, unnest([{'tag':'full','ok':fx IS NULL,'col0':0,'row0':0,'w':width,'h':height},{'tag':'north','ok':fx IS NOT NULL AND r0>=1,'col0':0,'row0':0,'w':width,'h':r0+1},
    {'tag':'south','ok':fx IS NOT NULL AND r1<=height-2,'col0':0,'row0':r1,'w':width,'h':height-r1},{'tag':'west','ok':fx IS NOT NULL AND c0>=1,'col0':0,'row0':r0,'w':c0+1,'h':r1-r0+1},{'tag':'east','ok':fx IS NOT NULL AND c1<=width-2,'col0':c1,'row0':r0,'w':width-c1,'h':r1-r0+1}]) AS b FROM
    (SELECT *, least(greatest(floor((fx-min_x)/res),0),width-1)::BIGINT AS c0, least(greatest(ceil((fx1-min_x)/res),0),width-1)::BIGINT AS c1, least(greatest(floor((fz-min_z)/res),0),height-1)::BIGINT AS r0, least(greatest(ceil((fz1-min_z)/res),0),height-1)::BIGINT AS r1 FROM
    (SELECT *, lead(min_x) OVER w AS fx, lead(max_x) OVER w AS fx1, lead(min_z) OVER w AS fz, lead(max_z) OVER w AS fz1 FROM layers WINDOW w AS (ORDER BY res DESC)))) WHERE b.ok"""
_BLOCKS = """SELECT layer_id, tag, bc AS col0, br AS row0, least(65,col0+w-bc) AS w, least(65,row0+h-br) AS h FROM bands, LATERAL (SELECT unnest(range(col0, col0+w-1, 64)) AS bc), LATERAL (SELECT unnest(range(row0, row0+h-1, 64)) AS br)"""


@query("tier_mosaic", with_ctes(
    f"""SELECT b.layer_id, tag, b.col0, b.row0, b.w, b.h, (SELECT count(*) FROM samples s WHERE s.layer_id=b.layer_id AND s.col>=b.col0 AND s.col<b.col0+b.w AND s.row>=b.row0 AND s.row<b.row0+b.h) AS samples FROM bands b""", "layers", "samples", bands=_BANDS))
def tier_mosaic(spark, sf):
    bands = consumer.tier_mosaic(fx.layers(spark, sf)).select("layer_id", "tag", "col0", "row0", "w", "h")
    rows = fx.raster_rows(spark, sf).select("layer_id", "row", F.size("heights").alias("n"))
    wanted = bands.withColumn("row", F.explode(F.sequence(c("row0"), c("row0") + c("h") - 1)))
    got = wanted.join(rows, ["layer_id", "row"]).groupBy("layer_id", "tag", "col0", "row0", "w", "h").agg(
        F.sum(F.least(c("w"), c("n") - c("col0"))).alias("samples"))
    return got


@query("block_split", with_ctes(
    f"""SELECT k.layer_id, k.tag, k.col0, k.row0, k.w, k.h, {rnd("(SELECT sum(h) FROM samples s WHERE s.layer_id=k.layer_id AND s.row=k.row0)", 5)} AS edge_sum FROM blocks k""", "layers", "samples", bands=_BANDS, blocks=_BLOCKS))
def block_split(spark, sf):
    b = consumer.split_blocks(consumer.tier_mosaic(fx.layers(spark, sf)).select("layer_id", "tag", "col0", "row0", "w", "h"), 64)
    edge = fx.raster_rows(spark, sf).select("layer_id", c("row").alias("row0"), r6(F.aggregate("heights", F.lit(0.0), lambda a, v: a + v), 5).alias("edge_sum"))
    return b.join(edge, ["layer_id", "row0"]).select("layer_id", "tag", "col0", "row0", "w", "h", "edge_sum")


@query("lod_indices", with_ctes(
    """SELECT layer_id, tag, col0, row0, step, len(list_filter(range(col0,col0+w), lambda i: (i-col0)%step=0 OR i=col0+w-1)) AS cols, list_sum(list_filter(range(row0,row0+h), lambda i: (i-row0)%step=0 OR i=row0+h-1))::BIGINT AS row_sum,
       (SELECT count(*) FROM raster_rows r WHERE r.layer_id=q.layer_id AND r.row>=row0 AND r.row<row0+q.h) AS stored FROM (SELECT k.*, CASE WHEN power(least(greatest(0.5e0,min_x+col0*res),min_x+(col0+w-1)*res)-0.5e0,2)+power(least(greatest(1e0,min_z+row0*res),min_z+(row0+h-1)*res)-1e0,2)<=9 THEN 1
       ELSE greatest(1,ceil(greatest(l.width,l.height)/1e2))::BIGINT END AS step FROM blocks k JOIN layers l USING (layer_id)) q""", "layers", "raster_rows", bands=_BANDS, blocks=_BLOCKS))
def lod_indices(spark, sf):
    b = consumer.split_blocks(consumer.tier_mosaic(fx.layers(spark, sf)), 64)
    d = consumer.decimation(b, F.lit(0.5), F.lit(1.0), 3.0, 100)
    rows = fx.raster_rows(spark, sf).select("layer_id", "row")
    d = d.withColumn("row", F.explode(F.sequence(c("row0"), c("row0") + c("h") - 1))).join(rows, ["layer_id", "row"])
    d = d.withColumn("n_cols", F.size("cols").cast("long")).withColumn("row_sum", F.aggregate("rows", F.lit(0).cast("long"), lambda a, v: a + v))
    return d.groupBy("layer_id", "tag", "col0", "row0", "step", c("n_cols").alias("cols"), "row_sum").agg(F.count("*").alias("stored"))


@query("rock_cells", with_ctes(
    """SELECT rock_id, floor(x/16)::BIGINT AS cell_x, floor(z/16)::BIGINT AS cell_z, (row_number() OVER (PARTITION BY floor(x/16), floor(z/16) ORDER BY rock_id)-1)//128 AS batch FROM rock_seeds WHERE physical""", "rock_seeds"))
def rock_cells(spark, sf):
    return consumer.rock_cells(fx.rock_seeds(spark, sf).where("physical")).select("rock_id", "cell_x", "cell_z", "batch")


_TBOX = """SELECT seq, CASE WHEN seq%131=0 THEN 'missing-9' ELSE (['context-0','mission-1','operational-2'])[k%3+1] END AS layer_id, cx-radius AS min_x, cx+radius AS max_x, cz-radius AS min_z, cz+radius AS max_z FROM operations"""


def _op_boxes(spark, sf):
    layer = F.element_at(fx.lit_array(["context-0", "mission-1", "operational-2"]), (c("k") % 3 + 1).cast("int"))
    return fx.operations(spark, sf).select(
        "seq", F.when(c("seq") % 131 == 0, "missing-9").otherwise(layer).alias("layer_id"), (c("cx") - c("radius")).alias("min_x"),
        (c("cx") + c("radius")).alias("max_x"), (c("cz") - c("radius")).alias("min_z"), (c("cz") + c("radius")).alias("max_z"))


@query("tile_request", with_ctes(
    """SELECT seq, status, CASE WHEN ok THEN c0 END AS col0, CASE WHEN ok THEN r0 END AS row0, CASE WHEN ok THEN least(greatest(c1,c0),width-1)-c0+1 END AS tile_w, CASE WHEN ok THEN least(greatest(r1,r0),height-1)-r0+1 END AS tile_h FROM (SELECT *, status='ok' AS ok,
       floor((least(greatest(bx0,min_x),max_x)-min_x)/res)::BIGINT AS c0, ceil((least(greatest(bx1,min_x),max_x)-min_x)/res)::BIGINT AS c1, floor((least(greatest(bz0,min_z),max_z)-min_z)/res)::BIGINT AS r0, ceil((least(greatest(bz1,min_z),max_z)-min_z)/res)::BIGINT AS r1 FROM
       (SELECT b.seq, b.min_x AS bx0, b.max_x AS bx1, b.min_z AS bz0, b.max_z AS bz1, l.*, CASE WHEN l.res IS NULL THEN 'no such layer' WHEN b.max_x<b.min_x THEN 'unordered' WHEN b.max_x<l.min_x OR b.min_x>l.max_x OR b.max_z<l.min_z OR b.min_z>l.max_z THEN 'disjoint' ELSE 'ok' END AS status FROM box b LEFT JOIN layers l USING (layer_id)))""",
    "operations", "layers", box=_TBOX))
def tile_request(spark, sf):
    return consumer.tile_requests(_op_boxes(spark, sf), fx.layers(spark, sf)).select("seq", "status", "col0", "row0", "tile_w", "tile_h")


@query("refresh_blocks", with_ctes(
    """SELECT layer_id, bc AS col0, br AS row0, count(*) AS edits FROM (SELECT b.*, l.min_x AS lx, l.min_z AS lz, res, width, height FROM box b JOIN layers l USING (layer_id)), range(0,64,32) a(bc), range(0,100000,32) d(br)
       WHERE bc<width-1 AND br<height-1 AND NOT (lx+least(bc+32,width-1)*res<min_x-0.5e0 OR lx+bc*res>max_x+0.5e0 OR lz+least(br+32,height-1)*res<min_z-0.5e0 OR lz+br*res>max_z+0.5e0) GROUP BY ALL""".replace("range(0,100000,32) d(br)", "(SELECT unnest(range(0,n,32)) AS br FROM n) d"), "operations", "layers", box=_TBOX))
def refresh_blocks(spark, sf):
    hit = consumer.refresh_blocks(_op_boxes(spark, sf), None, fx.layers(spark, sf), 32, 0.5)
    return hit.groupBy("layer_id", "col0", "row0").agg(F.count("*").alias("edits"))


@query("import_rules", with_ctes(
    """SELECT rule, count(*) AS n, min(subject) AS first_subject FROM (SELECT 'duplicate path' AS rule, path AS subject FROM art GROUP BY path HAVING count(*)>1 UNION ALL SELECT 'unsafe path', path FROM art WHERE path LIKE '../%'
       UNION ALL SELECT 'duplicate role', role FROM lay GROUP BY role HAVING count(*)>1 UNION ALL SELECT 'not finer', layer_id FROM (SELECT layer_id, res, lag(res) OVER (ORDER BY res DESC, ordinal) AS p FROM lay) WHERE res>=p UNION ALL SELECT 'off the parent grid', layer_id FROM (SELECT layer_id, (min_x-lag(min_x) OVER w)/lag(res) OVER w AS g FROM lay WINDOW w AS (ORDER BY res DESC, ordinal)) WHERE abs(g-floor(g+0.5e0))>1e-5) GROUP BY rule""", "artifacts", "layers",
    art="SELECT CASE WHEN bytes%50=3 THEN '../'||path ELSE path END AS path FROM artifacts UNION ALL SELECT path FROM artifacts WHERE bytes%70=1",
    lay="SELECT ordinal, layer_id, role, res, min_x FROM layers UNION ALL SELECT 9, 'extra-9', 'mission', 0.125e0, -3.9375e0"))
def import_rules(spark, sf):
    a, layers = fx.artifacts(spark, sf), fx.layers(spark, sf)
    art = a.select(F.when(c("bytes") % 50 == 3, F.concat(F.lit("../"), c("path"))).otherwise(c("path")).alias("path")).unionByName(a.where(c("bytes") % 70 == 1).select("path"))
    extra = layers.where(c("ordinal") == 1).withColumn("ordinal", F.lit(9)).withColumn("layer_id", F.lit("extra-9"))
    return consumer.import_problems(art, layers.unionByName(extra)).groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


@query("rock_payload_rules", with_ctes(
    """SELECT rule, count(*) AS rocks, min(rock_id) AS first_rock FROM (SELECT rock_id, unnest(list_filter([CASE WHEN layer_id IS NULL THEN 'not covered' END, CASE WHEN y IS NULL THEN 'position' END, CASE WHEN abs(sqrt(list_sum(list_transform(quaternion, lambda v: v*v)))-1)>1e-3 THEN 'quaternion' END,
       CASE WHEN ground IS NOT NULL AND y-scale_y>ground+1e-3 THEN 'floating' END], lambda v: v IS NOT NULL)) AS rule FROM faulty) GROUP BY rule""", *_R, **ROCKS, faulty=FAULTY))
def rock_payload_rules(spark, sf):
    extra = [("not covered", c("layer_id").isNull()), ("floating", F.coalesce(rules.floating(), F.lit(False)))]
    v = rules.violations(faulty_rocks(spark, sf), rules.rock_rules(1e-3) + extra)
    return v.select("rock_id", F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("rocks"), F.min("rock_id").alias("first_rock"))


@query("identity_compare", with_ctes(
    """SELECT status, count(*) AS fields, min(field) AS first_field FROM (SELECT coalesce(a.path,p.path) AS field, CASE WHEN p.path IS NULL THEN 'only left' WHEN a.path IS NULL THEN 'only right' ELSE 'differs' END AS status FROM artifacts a FULL JOIN prior_artifacts p ON a.path=p.path WHERE a.sha256 IS DISTINCT FROM p.sha256) GROUP BY status""", "artifacts", "prior_artifacts"))
def identity_compare(spark, sf):
    side = lambda d: d.select(c("path").alias("field"), c("sha256").alias("value"))
    d = consumer.identity_differences(side(fx.artifacts(spark, sf)), side(fx.prior_artifacts(spark, sf)))
    return d.groupBy("status").agg(F.count("*").alias("fields"), F.min("field").alias("first_field"))


# ------------------------------------------------------------------ files
@query("raster_roundtrip", with_ctes(f"SELECT layer_id, row, count(h) AS samples, {rnd('sum(h)', 5)} AS total, sum(semantic)::BIGINT AS mask_sum FROM samples GROUP BY ALL", "samples"))
def raster_roundtrip(spark, sf):
    """Rows written as Parquet partitions and read back."""
    path = scratch_path(spark, "rows")
    raster_io.write_rows(fx.raster_rows(spark, sf), path)
    total = lambda a, zero: F.aggregate(a, zero, lambda s, v: s + v)
    return raster_io.read_rows(spark, path).select(
        c("layer_id").cast("string").alias("layer_id"), "row", F.size("heights").cast("long").alias("samples"), r6(total(c("heights"), F.lit(0.0)), 5).alias("total"),
        total(c("semantic"), F.lit(0).cast("long")).alias("mask_sum"))


@query("label_parse", """SELECT p_partkey AS product_id, CASE WHEN p_partkey%13<>0 THEN (p_partkey*4+8)::DOUBLE END AS lines, (p_size*5)::DOUBLE AS map_scale, p_partkey*2+3.5e0 AS line_offset, CASE WHEN p_partkey%23=0 THEN 6371e3 ELSE 1737400e0 END AS radius_m,
    p_partkey%2=0 AS little_endian, CASE WHEN p_partkey%5=0 THEN -32768e0 END AS missing_constant, (p_partkey%13=0)::BIGINT AS missing_keys FROM part""")
def label_parse(spark, sf):
    t = labels.parse_labels(fx.label_texts(spark, sf))
    return t.select("product_id", "lines", "map_scale", c("line_projection_offset").alias("line_offset"), r6("radius_m", 3).alias("radius_m"),
                    "little_endian", "missing_constant", F.size("missing").cast("long").alias("missing_keys"))


@query("product_rules", """SELECT problem, count(*) AS products, min(p_partkey) AS first_product FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey%13=0 THEN 'missing keywords' END, CASE WHEN p_partkey%17=0 THEN 'projection' END,
    CASE WHEN p_partkey%19=0 THEN 'pole origin' END, CASE WHEN p_partkey%23=0 THEN 'sphere' END], lambda v: v IS NOT NULL)) AS problem FROM part) GROUP BY problem""")
def product_rules(spark, sf):
    p = labels.product_problems(labels.parse_labels(fx.label_texts(spark, sf)))
    return p.groupBy("problem").agg(F.count("*").alias("products"), F.min("product_id").alias("first_product"))


@query("manifests_json", with_ctes(
    f"""SELECT rock_id, {rnd('x', 6)} AS x, {rnd('y', 6)} AS y, physical, n_all, n_physical FROM seated, (SELECT count(*) AS n_all, count_if(physical) AS n_physical FROM seated)""", *_R, **ROCKS))
def manifests_json(spark, sf):
    """Rock manifest as JSON lines with its header counts, written and read back."""
    from gridloom.plans.features import seated_rocks

    rocks = seated_rocks(spark, sf)
    path = scratch_path(spark, "rocks-json")
    rocks.select(F.struct("rock_id", "physical", F.struct("x", "y", "z").alias("position"), F.struct("scale_x", "scale_y", "scale_z").alias("scale")).alias("r")).select(
        "r.*").write.json(path)
    back = spark.read.schema("rock_id string, physical boolean, position struct<x:double,y:double,z:double>").json(path)
    head = back.agg(F.count("*").alias("n"), F.count_if("physical").alias("p")).first()
    return back.select("rock_id", r6("position.x").alias("x"), r6("position.y").alias("y"), "physical",
                       F.lit(head["n"]).cast("long").alias("n_all"), F.lit(head["p"]).cast("long").alias("n_physical"))
