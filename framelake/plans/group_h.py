"""Queries of footprints, device folders, reseeds, masks and small formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import folder, pixels, sky, stack
from framelake.plans.registry import FILES, PX, STARS, query
from framelake.sources import config
from framelake.sources import surrogates as s


@query(f"""WITH {FILES}, h AS (SELECT session, size, CASE WHEN event_id % 9 = 0 THEN '.' || name ELSE name END AS name FROM files)
SELECT session, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM h WHERE NOT starts_with(name, '.') GROUP BY session""")
def footprint(spark, d):
    name = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("."), "name")).otherwise(F.col("name"))
    return folder.footprint(s.files(spark, d).withColumn("name", name), ["session"], "name", "size")


@query(f"""WITH {FILES}, v AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS device FROM files)
SELECT session, device, arg_max(name, (mtime, name)) AS name, max(mtime) AS mtime FROM v WHERE device IS NOT NULL GROUP BY session, device""")
def device_folders(spark, d):
    k = F.col("event_id") % 4
    return folder.device_folders(s.files(spark, d), ["session"], F.when(k == 0, "alpha").when(k == 1, "beta"), "mtime", ["name"])


@query("""WITH a AS (SELECT user_id AS session, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN NULL WHEN user_id % 5 = 0 THEN 'not_native' WHEN event_id % 7 = 0 THEN 'importing' WHEN event_id % 11 = 0 THEN 'finalizing' ELSE 'done' END AS answer FROM events)
SELECT session, event_id, answer, (sum(CASE WHEN answer = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS epoch FROM a""")
def manual_reseed(spark, d):
    e = s.table(spark, d, "events").withColumn("session", F.col("user_id"))
    asked, native, importing, claimed = F.col("event_id") % 3 == 0, F.col("user_id") % 5 != 0, F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0
    return stack.manual_reseeds(e, "session", ["ts", "event_id"], asked, native, importing, claimed).select("session", "event_id", "answer", "epoch")


@query(f"""WITH {PX}, b AS (SELECT frame, y, x FROM px WHERE v > 0.7), o AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) c(dx) WHERE abs(dy) + abs(dx) <= 2)
SELECT DISTINCT frame, (y + dy)::BIGINT AS y, (x + dx)::BIGINT AS x FROM b, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7""")
def dilate_mask(spark, d):
    grown = pixels.dilate(s.px(spark, d).where("v > 0.7"), ["frame"], 8, 8, times=2)
    return grown.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query(f"""WITH {STARS} SELECT frame, star::BIGINT AS star, round(flux, 6) AS flux FROM stars WHERE star < 5""")
def top_stars(spark, d):
    return s.stars(spark, d, 5).select("frame", "star", F.round("flux", 6).alias("flux"))


@query("""SELECT c_custkey, base64(unhex(sha256(base64(unhex(sha256(c_name || c_mktsegment))) || c_custkey::VARCHAR))) AS response FROM customer""")
def auth_response(spark, d):
    c = s.table(spark, d, "customer")
    return c.select("c_custkey", config.auth_response(F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("response"))


@query("""SELECT c_custkey, round(180 - ((180 - c_acctbal) - 360 * floor((180 - c_acctbal) / 360)), 6) AS angle, round(pow(10, -0.4 * (c_custkey % 20)), 9) AS flux FROM customer""")
def angles_and_fluxes(spark, d):
    c = s.table(spark, d, "customer")
    return c.select("c_custkey", F.round(sky.wrap_angle(F.col("c_acctbal")), 6).alias("angle"), F.round(sky.magnitude_flux(F.col("c_custkey") % 20), 9).alias("flux"))


@query("""WITH g AS (SELECT user_id AS folder, event_id, ts, CASE WHEN value < 40 THEN 1 ELSE 0 END AS gone FROM events)
SELECT folder, event_id, (sum(gone) OVER (PARTITION BY folder ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS generation FROM g""")
def folder_generation(spark, d):
    e = s.table(spark, d, "events").withColumn("folder", F.col("user_id"))
    w = Window.partitionBy("folder").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("folder", "event_id", F.sum((F.col("value") < 40).cast("int")).over(w).alias("generation"))
