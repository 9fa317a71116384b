"""Stack queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions.stats import clamp
from framelake.operators import stack
from framelake.plans.registry import FRAMES, PX, STARS, query
from framelake.sources import surrogates as s

_WEIGHTED = f"""WITH {FRAMES}, w AS (
  SELECT frame, session, stars, sigma, least(greatest(stars / first_value(stars) OVER win::DOUBLE
         * power(first_value(sigma) OVER win / greatest(sigma, 1e-6), 2), 0.25), 4.0) AS weight
  FROM frames WINDOW win AS (PARTITION BY session ORDER BY frame))"""


@query(f"""{_WEIGHTED}
SELECT px.session::BIGINT AS session, y, x, round(CASE WHEN sum(weight * m) > 0 THEN sum(weight * m * v) / sum(weight * m) ELSE 0 END, 6) AS mean,
       sum(m)::BIGINT AS coverage
FROM px JOIN w USING (frame) GROUP BY px.session, y, x""")
def weighted_stack(spark, d):
    w = stack.frame_weights(s.frames(spark, d)).select("frame", "weight")
    out = stack.weighted_mean(s.px(spark, d).join(w, "frame"), ["session", "y", "x"], weight="weight")
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""{_WEIGHTED} SELECT frame, session::BIGINT AS session, round(weight, 6) AS weight FROM w""")
def frame_weight(spark, d):
    return stack.frame_weights(s.frames(spark, d)).select("frame", "session", F.round("weight", 6).alias("weight"))


@query(f"""WITH {PX} SELECT session::BIGINT AS session, y, x, sum(m)::BIGINT AS coverage, count(DISTINCT frame) FILTER (m > 0)::BIGINT AS n_frames
FROM px GROUP BY session, y, x""")
def coverage(spark, d):
    return s.px(spark, d).groupBy("session", "y", "x").agg(F.sum("m").alias("coverage"), F.countDistinct(F.when(F.col("m") > 0, F.col("frame"))).alias("n_frames"))


@query(f"""WITH {PX}, series AS (SELECT session, y, x, list(v ORDER BY frame) AS s FROM px WHERE m > 0 GROUP BY session, y, x),
folded AS (SELECT session, y, x, list_reduce(s, lambda a, v: struct_pack(
    n := a.n + 1,
    mean := a.mean + ((CASE WHEN a.n >= 8 THEN least(greatest(v.last, a.mean - 2.5 * sqrt(a.m2 / a.n)), a.mean + 2.5 * sqrt(a.m2 / a.n)) ELSE v.last END) - a.mean) / (a.n + 1),
    m2 := a.m2 + ((CASE WHEN a.n >= 8 THEN least(greatest(v.last, a.mean - 2.5 * sqrt(a.m2 / a.n)), a.mean + 2.5 * sqrt(a.m2 / a.n)) ELSE v.last END) - a.mean)
       * ((CASE WHEN a.n >= 8 THEN least(greatest(v.last, a.mean - 2.5 * sqrt(a.m2 / a.n)), a.mean + 2.5 * sqrt(a.m2 / a.n)) ELSE v.last END)
          - (a.mean + ((CASE WHEN a.n >= 8 THEN least(greatest(v.last, a.mean - 2.5 * sqrt(a.m2 / a.n)), a.mean + 2.5 * sqrt(a.m2 / a.n)) ELSE v.last END) - a.mean) / (a.n + 1))),
    last := v.last,
    clipped := a.clipped + CASE WHEN a.n >= 8 AND (v.last < a.mean - 2.5 * sqrt(a.m2 / a.n) OR v.last > a.mean + 2.5 * sqrt(a.m2 / a.n)) THEN 1 ELSE 0 END)) AS f
  FROM (SELECT session, y, x, list_prepend(struct_pack(n := 0::BIGINT, mean := 0::DOUBLE, m2 := 0::DOUBLE, last := 0::DOUBLE, clipped := 0::BIGINT),
        list_transform(s, lambda v: struct_pack(n := 0::BIGINT, mean := 0::DOUBLE, m2 := 0::DOUBLE, last := v, clipped := 0::BIGINT))) AS s FROM series))
SELECT session::BIGINT AS session, y, x, f.n AS n, round(f.mean, 6) AS mean, round(sqrt(f.m2 / f.n), 6) AS sigma, f.clipped::BIGINT AS clipped FROM folded""")
def winsor_clip(spark, d):
    out = stack.winsor_clip(s.px(spark, d), ["session", "y", "x"], "frame", kappa=stack.KAPPA["high"])
    return out.select("session", "y", "x", "n", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 6).alias("sigma"), "clipped")


@query("""WITH f AS (SELECT vec_id AS frame, label::BIGINT AS session, vec_id % 45 AS stars, CASE WHEN vec_id % 13 = 0 THEN 4 ELSE 8 END AS width, CASE WHEN vec_id % 29 = 0 THEN 1 ELSE 8 END AS height, CASE WHEN vec_id % 17 = 0 THEN 3 ELSE 1 END AS channels FROM embeddings),
g AS (SELECT *, first_value(CASE WHEN stars >= 15 AND width >= 2 AND height >= 2 THEN struct_pack(size := width * 1000 + height, channels := channels) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seed FROM f)
SELECT frame, session, CASE WHEN width < 2 OR height < 2 THEN 'too_small' WHEN seed IS NULL THEN CASE WHEN stars >= 15 THEN 'seed' ELSE 'few_seed_stars' END
  WHEN width * 1000 + height <> seed.size THEN 'size_mismatch' WHEN channels <> seed.channels THEN 'channel_mismatch' WHEN stars < 3 THEN 'few_stars' ELSE 'stacked' END AS outcome FROM g""")
def admission(spark, d):
    e = s.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("session"))
    f = e.withColumns({"stars": F.col("frame") % 45, "width": F.when(F.col("frame") % 13 == 0, 4).otherwise(8), "height": F.when(F.col("frame") % 29 == 0, 1).otherwise(8), "channels": F.when(F.col("frame") % 17 == 0, 3).otherwise(1)})
    return stack.admission(f).select("frame", "session", "outcome")


@query(f"""WITH {PX}, cov AS (SELECT session, y, x, sum(m * CASE WHEN x = 0 OR y >= 6 THEN frame % 2 ELSE 1 END) AS coverage FROM px GROUP BY session, y, x),
ok AS (SELECT *, CASE WHEN coverage >= 0.9 * max(coverage) OVER (PARTITION BY session) THEN 1 ELSE 0 END AS ok FROM cov),
r AS (SELECT session, y FROM ok GROUP BY session, y HAVING sum(ok) >= 0.5 * count(*)), c AS (SELECT session, x FROM ok GROUP BY session, x HAVING sum(ok) >= 0.5 * count(*))
SELECT a.session::BIGINT AS session, y0, y1, x0, x1 FROM (SELECT session, min(y) AS y0, max(y) AS y1 FROM r GROUP BY session) a
JOIN (SELECT session, min(x) AS x0, max(x) AS x1 FROM c GROUP BY session) b ON a.session = b.session""")
def crop_rect(spark, d):
    seen = F.when((F.col("x") == 0) | (F.col("y") >= 6), F.col("frame") % 2).otherwise(1)
    cov = s.px(spark, d).groupBy("session", "y", "x").agg(F.sum(F.col("m") * seen).alias("coverage"))
    return stack.crop_rect(cov, ["session"])


@query(f"""WITH {PX}, p AS (SELECT *, CASE WHEN frame % 7 = 0 AND x % 2 = 0 THEN NULL ELSE 0.1 + 0.01 * x END AS surf_sub, 0.12 + 0.005 * y AS surf_ref, 0.5 + (frame % 4) * 0.5 AS scale FROM px),
q AS (SELECT *, bool_and(surf_sub IS NOT NULL) OVER (PARTITION BY frame) AS paired FROM p)
SELECT frame, y, x, round(CASE WHEN surf_sub IS NULL THEN v ELSE least(surf_ref + (v - surf_sub) * CASE WHEN paired THEN scale ELSE 1 END, 1.0) END, 6) AS levelled FROM q""")
def level_apply(spark, d):
    p = s.px(spark, d).withColumns({
        "surf_sub": F.when(~((F.col("frame") % 7 == 0) & (F.col("x") % 2 == 0)), F.lit(0.1) + F.lit(0.01) * F.col("x")),
        "surf_ref": F.lit(0.12) + F.lit(0.005) * F.col("y"), "scale": F.lit(0.5) + (F.col("frame") % 4) * F.lit(0.5),
    })
    return stack.level(p, ["frame"]).select("frame", "y", "x", F.round("levelled", 6).alias("levelled"))


@query(f"""WITH {STARS}, ref AS (SELECT session, star, flux AS ref_flux FROM stars WHERE frame IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
r AS (SELECT frame, CASE WHEN flux <> 0 AND ref_flux / flux > 0 THEN ref_flux / flux END AS q FROM stars JOIN ref USING (session, star) WHERE star < 4 + frame % 16)
SELECT frame, round(CASE WHEN count(q) < 5 THEN 1.0 ELSE least(greatest(median(q), 0.5), 2.0) END, 6) AS scale, count(q)::BIGINT AS n_ratios FROM r GROUP BY frame""")
def scale_factor(spark, d):
    st = s.stars(spark, d)
    first = s.table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("frame")).select("frame")
    ref = st.join(first, "frame", "left_semi").select("session", "star", F.col("flux").alias("ref_flux"))
    pairs = st.join(ref, ["session", "star"]).where(F.col("star") < 4 + F.col("frame") % 16)
    return stack.scale_factor(pairs, ["frame"]).withColumn("scale", F.round("scale", 6))


@query("""WITH e AS (SELECT user_id AS session, ts, event_id, CASE WHEN value < 120 THEN 1 ELSE 0 END AS f FROM events),
i AS (SELECT *, sum(1 - f) OVER (PARTITION BY session ORDER BY ts, event_id) AS island FROM e),
r AS (SELECT *, sum(f) OVER (PARTITION BY session, island ORDER BY ts, event_id) AS run FROM i),
z AS (SELECT *, CASE WHEN f = 1 AND run % 6 = 0 THEN 1 ELSE 0 END AS reseed FROM r)
SELECT session, event_id, (CASE WHEN f = 1 THEN (run - 1) % 6 + 1 ELSE 0 END)::BIGINT AS run,
       coalesce(sum(reseed) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch FROM z""")
def reseed_epochs(spark, d):
    out = stack.reseed_epochs(s.snap(spark, d), "session", ["ts", "event_id"], F.col("median") < 120)
    return out.select("session", "event_id", F.col("run").cast("long").alias("run"), F.col("epoch").cast("long").alias("epoch"))


__all__ = ["clamp"]
