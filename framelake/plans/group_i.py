"""Queries of non-default parameters, masters, names and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import folder, sky, stack
from framelake.operators import pixels as p
from framelake.plans.registry import FILES, MASTERS, PX, RGB, query
from framelake.sources import session_files
from framelake.sources import surrogates as s

_MTF = "CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 ELSE (({m}) - 1) * {x} / ((2 * ({m}) - 1) * {x} - ({m})) END"


@query(f"""WITH {RGB}, b AS (SELECT image, c, y, x, greatest(0, (v - 0.1::DOUBLE) / (1 - 0.1::DOUBLE)) AS v FROM rgb),
l AS (SELECT image, y, x, avg(v) AS v FROM b GROUP BY ALL), md AS (SELECT image, list_sort(list(v))[count(*) // 2 + 1] AS med FROM l GROUP BY image),
ma AS (SELECT image, med, list_sort(list(abs(v - med)))[count(*) // 2 + 1] AS mad FROM l JOIN md USING (image) GROUP BY image, med),
sh AS (SELECT image, med, least(greatest(med - 2.0 * CASE WHEN 1.4826 * mad > 1e-10 THEN 1.4826 * mad ELSE greatest(med, 1e-10) END, 0), 1) AS shadow FROM ma),
r AS (SELECT image, shadow, least(greatest((med - shadow) / greatest(1 - shadow, 1e-9), 1e-9), 1) AS r FROM sh),
mi AS (SELECT image, shadow, least(greatest(({_MTF.format(x="r", m="0.3::DOUBLE")}) * 2::DOUBLE ^ -0.5, 1e-4), 1 - 1e-4) AS midtone FROM r)
SELECT image, c, y, x, round({_MTF.format(x="least(greatest((v - shadow) / greatest(1 - shadow, 1e-9), 0), 1)", m="midtone")}, 6) AS v FROM b JOIN mi USING (image)""")
def black_point_stretch(spark, d):
    return p.auto_stretch(s.rgb(spark, d), ["image"], target=0.3, shadows=2.0, black=0.1, strength=0.5).withColumn("v", F.round("v", 6))


def _sizes(df):
    """Some frames are half as wide, some unreadable."""
    w = F.when(F.col("frame") % 5 == 0, 4).when(F.col("frame") % 7 != 3, 8)
    return df.withColumns({"width": w, "height": F.when(w.isNotNull(), 8), "channels": F.when(w.isNotNull(), 1)})


@query(f"""WITH {PX}, f AS (SELECT DISTINCT frame, session, CASE WHEN frame % 5 = 0 THEN 4 WHEN frame % 7 <> 3 THEN 8 END AS width FROM px WHERE session = 2),
k AS (SELECT frame FROM f WHERE width = (SELECT arg_min(width, frame) FROM f WHERE width IS NOT NULL))
SELECT y, x, round(avg(v), 6) AS v FROM px SEMI JOIN k USING (frame) GROUP BY y, x""")
def master_of_one_size(spark, d):
    px = s.px(spark, d).where("session = 2")
    frames = _sizes(s.table(spark, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("frame")))
    return p.master_mean(p.same_size(px, frames), ["y", "x"]).withColumn("v", F.round("v", 6))


@query(f"""WITH {MASTERS}, l AS (SELECT frame, y, x, v, CASE WHEN frame % 5 = 0 THEN 4 WHEN frame % 7 <> 3 THEN 8 END AS w FROM px WHERE session > 1)
SELECT frame, l.y, l.x, round(CASE WHEN w = 8 THEN least((v - d) / greatest(f, 1.0 / 65535), 1.0) ELSE v END, 6) AS v FROM l JOIN dark USING (y, x) JOIN flat USING (y, x)""")
def calibrate_by_size(spark, d):
    lights = _sizes(s.px(spark, d).where("session > 1").select("frame", "y", "x", "v"))
    out = p.calibrate(lights, s.dark(spark, d), s.flat(spark, d), ["y", "x"], size=("width", "height"))
    return out.select("frame", "y", "x", F.round("v", 6).alias("v"))


@query("""SELECT o_orderkey AS frame, CASE WHEN real THEN x0 ELSE 0 END AS x0, CASE WHEN real THEN y0 ELSE 0 END AS y0, CASE WHEN real THEN x1 ELSE 99 END AS x1, CASE WHEN real THEN y1 ELSE 79 END AS y1, real AS cropped
FROM (SELECT *, NOT (x0 = 0 AND y0 = 0 AND x1 = 99 AND y1 = 79) AND (x1 - x0 + 1) * (y1 - y0 + 1) >= 4800 AS real
FROM (SELECT o_orderkey, o_orderkey % 30 AS x0, o_custkey % 20 AS y0, 99 - o_custkey % 25 AS x1, 79 - o_orderkey % 10 AS y1 FROM orders))""")
def crop_guard(spark, d):
    o = s.table(spark, d, "orders")
    rect = o.select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 30).alias("x0"), (F.col("o_custkey") % 20).alias("y0"), (99 - F.col("o_custkey") % 25).alias("x1"), (79 - F.col("o_orderkey") % 10).alias("y1"))
    return stack.guarded_crop(rect, 100, 80)


@query(f"""WITH {PX}, w AS (SELECT session, y, x, v, CASE WHEN x = 0 OR y = 7 AND session % 2 = 0 OR y > 3 AND session % 3 = 2 THEN CASE WHEN frame % 3 = 0 THEN m ELSE 0 END ELSE m END AS m FROM px),
s AS (SELECT session, y, x, CASE WHEN sum(m) > 0 THEN sum(m * v) / sum(m) ELSE 0 END AS mean, sum(m) AS coverage FROM w GROUP BY session, y, x),
ok AS (SELECT *, (coverage >= 0.9 * max(coverage) OVER (PARTITION BY session))::INT AS ok FROM s),
r AS (SELECT session, min(y) AS y0, max(y) AS y1 FROM (SELECT session, y FROM ok GROUP BY session, y HAVING sum(ok) >= 0.5 * count(*)) GROUP BY session),
c AS (SELECT session, min(x) AS x0, max(x) AS x1 FROM (SELECT session, x FROM ok GROUP BY session, x HAVING sum(ok) >= 0.5 * count(*)) GROUP BY session),
g AS (SELECT session, y0, y1, x0, x1, (x1 - x0 + 1) * (y1 - y0 + 1) >= 38 AS real FROM r JOIN c USING (session)),
k AS (SELECT s.*, CASE WHEN real THEN y0 ELSE 0 END AS y0, CASE WHEN real THEN y1 ELSE 7 END AS y1, CASE WHEN real THEN x0 ELSE 0 END AS x0, CASE WHEN real THEN x1 ELSE 7 END AS x1 FROM s LEFT JOIN g USING (session))
SELECT session::BIGINT AS session, (y - y0)::BIGINT AS y, (x - x0)::BIGINT AS x, round(mean, 6) AS mean FROM k WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""")
def master_crop(spark, d):
    n = F.col("session")
    thin = (F.col("x") == 0) | (F.col("y") == 7) & (n % 2 == 0) | (F.col("y") > 3) & (n % 3 == 2)
    px = s.px(spark, d).withColumn("m", F.when(thin & (F.col("frame") % 3 != 0), 0).otherwise(F.col("m")))
    return stack.master(px, ["session"], 8, 8).select("session", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("mean", 6).alias("mean"))


@query("""SELECT frame, CASE WHEN small THEN w ELSE round(w * c + h * s)::BIGINT END AS out_width, CASE WHEN small THEN h ELSE round(w * s + h * c)::BIGINT END AS out_height,
round(CASE WHEN small THEN c + greatest(w / h, h / w) * s ELSE 1 END, 6) AS zoom
FROM (SELECT *, abs(cos(radians(deg))) AS c, abs(sin(radians(deg))) AS s, abs(CASE WHEN deg > 180 THEN deg - 360 ELSE deg END) <= 15 AS small
FROM (SELECT o_orderkey AS frame, (o_orderkey % 360)::DOUBLE AS deg, 100 + o_custkey % 50 AS w, 80 + o_orderkey % 40 AS h FROM orders))""")
def north_up(spark, d):
    o = s.table(spark, d, "orders")
    out = sky.north_up((F.col("o_orderkey") % 360).cast("double"), 100 + F.col("o_custkey") % 50, 80 + F.col("o_orderkey") % 40)
    return o.select(F.col("o_orderkey").alias("frame"), out.alias("r")).select("frame", "r.out_width", "r.out_height", F.round("r.zoom", 6).alias("zoom"))


@query(f"WITH {FILES} SELECT name FROM files WHERE size < 2 UNION SELECT name FROM files WHERE size > 4")
def union_of_names(spark, d):
    f = s.files(spark, d)
    return folder.union_of_names(f.where("size < 2"), f.where("size > 4"))


@query("""SELECT session, bool_and(u IS NULL) AS disjoint FROM (SELECT user_id AS session, event_type AS t FROM events WHERE event_id % 9 = 0) a
LEFT JOIN (SELECT DISTINCT event_type AS u FROM events WHERE event_id < 3) b ON t = u GROUP BY session""")
def disjoint_sets(spark, d):
    e = s.table(spark, d, "events").select(F.col("user_id").alias("session"), "event_type", "event_id")
    return folder.disjoint(e.where("event_id % 9 = 0"), e.where("event_id < 3"), "session", "event_type")


@query("""WITH f AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderdate AS t, o_orderpriority || ', "' || o_orderstatus || '"' AS p, o_orderstatus AS st, o_orderkey AS k FROM orders)
SELECT session, n AS index, n || ',' || strftime(t::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%g') || 'Z,"' || replace(p, '"', '""') || '",' || st || ',' || k || ',' || n * 20 || ',8,' || k % 9 || ',,' || k % 7 || ',' AS line FROM f
UNION ALL SELECT DISTINCT session, 0, 'index,timestamp,source_file,snapshot_file,estimated_integration_seconds,sub_exposure_seconds,width,height,mean,median,stddev' FROM f""")
def frame_csv_document(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    k = F.col("o_orderkey")
    snaps = s.table(spark, d, "orders").select(
        F.col("o_custkey").alias("session"), n.alias("index"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("source_file"),
        F.col("o_orderstatus").alias("snapshot_file"), k.alias("estimated_integration_seconds"), (n * 20).alias("sub_exposure_seconds"), F.lit(8).alias("width"), (k % 9).alias("height"),
        F.lit(None).cast("double").alias("mean"), (k % 7).alias("median"), F.lit(None).cast("double").alias("stddev"),
    )
    return session_files.frame_csv(snaps, "session")
