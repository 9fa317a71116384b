"""Registration, sky and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import background, filters, planes, register, replay, sky
from framelake.plans.registry import PX, SQL, STARS, query
from framelake.sources import surrogates as s

_REF = "ref AS (SELECT session, star AS dst, sx AS u, sy AS v, flux AS ref_flux FROM stars WHERE frame IN (SELECT min(vec_id) FROM embeddings GROUP BY label))"


def _reference(spark, d, stars):
    first = s.table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("frame")).select("frame")
    return stars.join(first, "frame", "left_semi")


_BAYER = ", ".join(f"({i}, {r})" for i, r in enumerate(register.bayer_rank(8)))


@query(f"""WITH {PX}, rk(cell, rank) AS (VALUES {_BAYER}), c AS (SELECT frame, y, x, v, row_number() OVER (PARTITION BY frame ORDER BY v DESC, y, x) - 1 AS star,
  least(7, floor(y * 16.0)::BIGINT * 8 // 192) * 8 + least(7, floor(x * 16.0)::BIGINT * 8 // 192) AS cell FROM px),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, cell ORDER BY v DESC, star) AS round FROM c JOIN rk USING (cell)),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round, rank) AS pick FROM r)
SELECT frame, pick::BIGINT AS pick, y, x FROM o WHERE pick <= 30""")
def dispersed_topk(spark, d):
    st = s.stars(spark, d, 64)
    out = register.dispersed(st, ["frame"], 192, 192, 30)
    return out.select("frame", F.col("pick").cast("long").alias("pick"), (F.col("sy") / 16).cast("long").alias("y"), (F.col("sx") / 16).cast("long").alias("x"))


_TRI = """tri AS (SELECT frame, session, s[1].v AS v0, s[2].v AS v1, s[3].v AS v2, s[2].l / s[1].l AS r1, s[3].l / s[2].l AS r2 FROM (
  SELECT a.frame, a.session, list_sort([{'l': sqrt(power(b.sx - c.sx, 2) + power(b.sy - c.sy, 2)), 'i': 0, 'v': a.star}, {'l': sqrt(power(a.sx - c.sx, 2) + power(a.sy - c.sy, 2)), 'i': 1, 'v': b.star},
         {'l': sqrt(power(a.sx - b.sx, 2) + power(a.sy - b.sy, 2)), 'i': 2, 'v': c.star}]) AS s
  FROM st a JOIN st b ON a.frame = b.frame AND a.star < b.star JOIN st c ON b.frame = c.frame AND b.star < c.star)
  WHERE s[1].l > 4 AND s[2].l / s[1].l < 20 AND s[3].l / s[2].l < 20)"""
_VOTES = f"""WITH {STARS}, st AS (SELECT frame, session, star, sx, sy FROM stars WHERE star < 8), {_TRI},
t AS (SELECT * FROM tri WHERE frame IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
m AS (SELECT a.frame, unnest([{{'s': a.v0, 'd': b.v0}}, {{'s': a.v1, 'd': b.v1}}, {{'s': a.v2, 'd': b.v2}}]) AS p FROM tri a JOIN t b ON a.session = b.session
  WHERE abs(a.r1 - b.r1) / greatest(a.r1, 1e-9) < 0.02 AND abs(a.r2 - b.r2) / greatest(a.r2, 1e-9) < 0.02),
votes AS (SELECT frame, p.s AS src, p.d AS dst, count(*) AS votes FROM m GROUP BY ALL)"""


@query(f"{_VOTES} SELECT frame, src, dst, votes FROM votes")
def triangle_votes(spark, d):
    st = s.stars(spark, d, 8)
    src = register.triangles(st, ["frame", "session"])
    dst = register.triangles(_reference(spark, d, st), ["session"])
    return register.triangle_votes(src, dst, ["frame"], ["session"])


@query(f"""{_VOTES}, r AS (SELECT frame, src, dst, row_number() OVER (PARTITION BY frame ORDER BY votes DESC, src * 4096 + dst) AS n FROM votes WHERE votes >= 2),
l AS (SELECT frame, list(struct_pack(s := src, d := dst, us := []::BIGINT[], ud := []::BIGINT[]) ORDER BY n) AS r FROM r GROUP BY frame),
g AS (SELECT frame, list_reduce(list_prepend(struct_pack(s := -1::BIGINT, d := -1::BIGINT, us := []::BIGINT[], ud := []::BIGINT[]), r),
  lambda a, p: CASE WHEN list_contains(a.us, p.s) OR list_contains(a.ud, p.d) THEN a ELSE struct_pack(s := p.s, d := p.d, us := list_append(a.us, p.s), ud := list_append(a.ud, p.d)) END) AS z FROM l)
SELECT frame, unnest(z.us) AS src, unnest(z.ud) AS dst FROM g""")
def greedy_match(spark, d):
    return register.greedy_match(triangle_votes(spark, d), ["frame"])


_PAIRS = f"WITH {STARS}, {_REF}, p AS (SELECT frame, sx AS x, sy AS y, u, v FROM stars JOIN ref ON stars.session = ref.session AND star = dst)"


def _pairs(spark, d):
    st = s.stars(spark, d)
    ref = _reference(spark, d, st).select("session", "star", F.col("sx").alias("u"), F.col("sy").alias("v"))
    return st.join(ref, ["session", "star"]).select("frame", F.col("star").alias("ord"), F.col("sx").alias("x"), F.col("sy").alias("y"), "u", "v")


_FIT = """m AS (SELECT frame, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, x) + covar_pop(y, y) AS d, covar_pop(x, u) + covar_pop(y, v) AS p, covar_pop(x, v) - covar_pop(y, u) AS q FROM p GROUP BY frame),
f AS (SELECT *, CASE WHEN d * n > 1e-9 THEN p / d END AS a, CASE WHEN d * n > 1e-9 THEN q / d END AS b FROM m),
fit AS (SELECT frame, n, a, b, sqrt(a * a + b * b) AS scale, atan2(b, a) AS rotation, mu - (a * mx - b * my) AS tx, mv - (b * mx + a * my) AS ty FROM f WHERE sqrt(a * a + b * b) > 1e-6)"""


@query(f"{_PAIRS}, {_FIT} SELECT frame, n, round(scale, 6) AS scale, round(rotation, 6) AS rotation, round(tx, 6) AS tx, round(ty, 6) AS ty FROM fit")
def umeyama_fit(spark, d):
    f = register.similarity_fit(_pairs(spark, d), ["frame"], ["ord"]).where("scale is not null")
    return f.select("frame", "n", *[F.round(c, 6).alias(c) for c in ("scale", "rotation", "tx", "ty")])


@query(f"""{_PAIRS}, {_FIT} SELECT frame, round(2 * tx + 0.5 * (1 - a + b) + 1e-10, 6) AS tx, round(2 * ty + 0.5 * (1 - b - a) + 1e-10, 6) AS ty FROM fit""")
def transform_lift(spark, d):
    f = register.lift(register.similarity_fit(_pairs(spark, d), ["frame"], ["ord"]).where("scale is not null"))
    # Some values end in an exact half at the seventh decimal; the last bit of a sum must not decide.
    return f.select("frame", F.round(F.col("tx") + 1e-10, 6).alias("tx"), F.round(F.col("ty") + 1e-10, 6).alias("ty"))


def _transform():
    f = F.col("frame")
    return {"scale": F.lit(1.0) + (f % 5) * F.lit(0.01), "rotation": (f % 7) * F.lit(0.02), "tx": (f % 3) * F.lit(0.4), "ty": (f % 4) * F.lit(0.3)}


@query(f"""WITH {PX}, t AS (SELECT frame, 1.0::DOUBLE + (frame % 5) * 0.01 AS s, (frame % 7) * 0.02::DOUBLE AS r, (frame % 3) * 0.4::DOUBLE AS tx, (frame % 4) * 0.3::DOUBLE AS ty FROM px GROUP BY frame),
i AS (SELECT frame, cos(r) / s AS c, sin(r) / s AS n, tx, ty FROM t),
g AS (SELECT frame, y, x, c * (x - tx) + n * (y - ty) AS sx, -n * (x - tx) + c * (y - ty) AS sy FROM i, range(8) a(y), range(8) b(x)),
k AS (SELECT *, sx >= 0 AND sy >= 0 AND sx <= 7 AND sy <= 7 AS inside, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM g)
SELECT k.frame, k.y, k.x, round(CASE WHEN inside THEN (1 - (sx - x0)) * (1 - (sy - y0)) * a.v + (sx - x0) * (1 - (sy - y0)) * b.v + (1 - (sx - x0)) * (sy - y0) * c.v + (sx - x0) * (sy - y0) * e.v ELSE 0 END, 6) AS v, inside::INT AS m
FROM k LEFT JOIN px a ON a.frame = k.frame AND a.y = y0 AND a.x = x0 LEFT JOIN px b ON b.frame = k.frame AND b.y = y0 AND b.x = least(x0 + 1, 7)
LEFT JOIN px c ON c.frame = k.frame AND c.y = least(y0 + 1, 7) AND c.x = x0 LEFT JOIN px e ON e.frame = k.frame AND e.y = least(y0 + 1, 7) AND e.x = least(x0 + 1, 7)""")
def warp_bilinear(spark, d):
    out = planes.long_view(planes.warp_bilinear(s.planes(spark, d).withColumns(_transform())), ["frame"], ["v", "m"])
    return out.withColumn("v", F.round("v", 6))


@query(SQL["warp_bilinear"])
def warp_bilinear_long(spark, d):
    t = s.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame")).withColumns(_transform())
    out = register.warp_bilinear(s.px(spark, d), t, ["frame"], 8, 8)
    return out.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("v", 6).alias("v"), "m")


@query(f"""WITH {PX}, z AS (SELECT frame, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, count(*) AS n FROM px WHERE m > 0 GROUP BY frame),
c AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS b, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS c FROM z)
SELECT frame, n, round(mv - b * mx - c * my, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM c""")
def plane_fit(spark, d):
    out = background.plane_fit(s.px(spark, d).where("m > 0"), ["frame"])
    return out.select("frame", "n", *[F.round(k, 6).alias(k) for k in "abc"])


@query(f"""WITH {PX}, z AS (SELECT frame, y // 4 AS ty, x // 4 AS tx, avg(m) AS share FROM px GROUP BY ALL), g AS (SELECT frame, ty, tx FROM z WHERE share >= 0.92)
SELECT frame, y // 4 AS ty, x // 4 AS tx, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS median FROM px WHERE (frame, y // 4, x // 4) IN (SELECT (frame, ty, tx) FROM g) GROUP BY ALL""")
def mask_gated_tiles(spark, d):
    from framelake.operators import pixels

    p = s.px(spark, d).withColumns({"ty": F.expr("y div 4"), "tx": F.expr("x div 4")})
    good = p.groupBy("frame", "ty", "tx").agg(F.avg("m").alias("share")).where("share >= 0.92")
    kept = p.join(good, ["frame", "ty", "tx"], "left_semi").select("frame", "y", "x", "v")
    return pixels.tile_medians(kept, ["frame"], 8, 8, 2).select("frame", "ty", "tx", F.round("median", 6).alias("median"))


@query(f"""WITH RECURSIVE {PX}, b AS (SELECT frame, list_sort(list(v))[33] AS bg FROM px GROUP BY frame),
sg AS (SELECT px.frame, bg, greatest(1.4826 * list_sort(list(abs(v - bg)))[33], 1e-6) AS sd FROM px JOIN b USING (frame) GROUP BY px.frame, bg),
o AS (SELECT px.frame, y, x, y * 8 + x AS id, v - bg AS f FROM px JOIN sg USING (frame) WHERE v - bg > 1.0 * sd),
l(frame, id, root) AS (SELECT frame, id, id FROM o UNION SELECT n.frame, n.id, l.root FROM l JOIN o a ON a.frame = l.frame AND a.id = l.id JOIN o n ON n.frame = a.frame AND abs(n.y - a.y) + abs(n.x - a.x) = 1),
r AS (SELECT frame, id, min(root) AS root FROM l GROUP BY frame, id)
SELECT o.frame, round(sum(f * x) / sum(f), 6) AS sx, round(sum(f * y) / sum(f), 6) AS sy, round(sum(f), 6) AS flux FROM o JOIN r ON o.frame = r.frame AND o.id = r.id GROUP BY o.frame, root HAVING count(*) BETWEEN 3 AND 400""")
def star_detect(spark, d):
    e = s.table(spark, d, "embeddings")
    planes = e.select(F.col("vec_id").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda v: v.cast("double") + 0.5).alias("pixels"))
    out = register.star_detect(planes, ["frame"], sigma=1.0)
    return out.select("frame", *[F.round(c, 6).alias(c) for c in ("sx", "sy", "flux")])


_CAT = "cat AS (SELECT p_partkey AS star, (p_partkey * 137.508::DOUBLE) % 360 AS ra, (p_partkey * 61.803::DOUBLE) % 180 - 90 AS dec, (p_retailprice - 900) / 10 AS mag FROM part)"


@query(f"""WITH {_CAT} SELECT star, round(ra, 6) AS ra, round(dec, 6) AS dec FROM cat WHERE dec BETWEEN 20 - 15 AND 20 + 15
AND cos(radians(dec)) * cos(radians(ra)) * cos(radians(20)) * cos(radians(359)) + cos(radians(dec)) * sin(radians(ra)) * cos(radians(20)) * sin(radians(359)) + sin(radians(dec)) * sin(radians(20)) >= cos(radians(15))""")
def cone_search(spark, d):
    return sky.cone(s.catalog(spark, d), 359.0, 20.0, 15.0).select("star", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query(f"""WITH {_CAT}, c AS (SELECT *, sin(radians(20)) * sin(radians(dec)) + cos(radians(20)) * cos(radians(dec)) * cos(radians(ra) - radians(100)) AS cc FROM cat)
SELECT star, round(cos(radians(dec)) * sin(radians(ra) - radians(100)) / cc, 6) AS xi, round((cos(radians(20)) * sin(radians(dec)) - sin(radians(20)) * cos(radians(dec)) * cos(radians(ra) - radians(100))) / cc, 6) AS eta,
round(ra, 6) AS ra, round(dec, 6) AS dec FROM c WHERE cc > 0.1""")
def gnomonic(spark, d):
    c = s.catalog(spark, d)
    xi, eta = sky.project(F.col("ra"), F.col("dec"), 100.0, 20.0)
    r, k = F.radians("ra") - F.radians(F.lit(100.0)), F.radians("dec")
    near = F.sin(F.radians(F.lit(20.0))) * F.sin(k) + F.cos(F.radians(F.lit(20.0))) * F.cos(k) * F.cos(r) > 0.1
    p = c.where(near).select("star", xi.alias("xi"), eta.alias("eta"))
    ra, dec = sky.deproject(F.col("xi"), F.col("eta"), 100.0, 20.0)
    return p.select("star", F.round("xi", 6).alias("xi"), F.round("eta", 6).alias("eta"), F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(f"""WITH {_CAT}, pt AS (SELECT c_custkey AS id, (c_custkey * 7.77::DOUBLE) % 360 AS px, (c_custkey * 3.33::DOUBLE) % 180 - 90 AS py FROM customer),
m AS (SELECT id, star, sqrt(power(px - ra, 2) + power(py - dec, 2)) AS dist FROM pt JOIN cat ON sqrt(power(px - ra, 2) + power(py - dec, 2)) < 3)
SELECT id, arg_min(star, dist) AS other, round(min(dist), 6) AS distance FROM m GROUP BY id""")
def nearest_neighbour(spark, d):
    k = F.col("c_custkey").cast("double")
    pts = s.table(spark, d, "customer").select(F.lit(1).alias("one"), F.col("c_custkey").alias("id"), ((k * F.lit(7.77)) % 360.0).alias("px"), ((k * F.lit(3.33)) % 180.0 - 90.0).alias("py"))
    cat = s.catalog(spark, d).select(F.lit(1).alias("one"), F.col("star").alias("other"), F.col("ra").alias("ox"), F.col("dec").alias("oy"))
    return sky.nearest(pts, cat, ["one"], 3.0).select("id", "other", F.round("distance", 6).alias("distance"))


@query("""WITH z AS (SELECT p_partkey, least(1920.0::DOUBLE / (p_size * 10), 1080.0::DOUBLE / (p_partkey % 50 + 1)) AS s, p_size * 10 AS w, p_partkey % 50 + 1 AS h FROM part)
SELECT p_partkey AS part, round((1920 - w * s) / 2, 6) AS x, round((1080 - h * s) / 2, 6) AS y, round(w * s, 6) AS w, round(h * s, 6) AS h FROM z""")
def aspect_fit(spark, d):
    p = s.table(spark, d, "part")
    x, y, w, h = replay.aspect_fit(F.col("p_size") * F.lit(10.0), (F.col("p_partkey") % 50 + 1).cast("double"), 1920.0, 1080.0)
    return p.select(F.col("p_partkey").alias("part"), *[F.round(c, 6).alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


@query(f"""WITH {PX}, h AS (SELECT a.frame, a.y, a.x, sum(b.v) / 5 AS v FROM px a, range(-2, 3) o(o) JOIN px b ON true WHERE b.frame = a.frame AND b.y = a.y AND b.x = least(greatest(a.x + o, 0), 7) GROUP BY ALL),
z AS (SELECT a.frame, a.y, a.x, sum(b.v) / 5 AS v FROM h a, range(-2, 3) o(o) JOIN h b ON true WHERE b.frame = a.frame AND b.x = a.x AND b.y = least(greatest(a.y + o, 0), 7) GROUP BY ALL)
SELECT frame, y, x, round(v, 6) AS v FROM z""")
def box_blur(spark, d):
    return filters.box_blur_long(s.px(spark, d).select("frame", "y", "x", "v"), ["frame"], 2, 8, 8).withColumn("v", F.round("v", 6))


@query(f"""WITH {PX} SELECT frame, y, x, round(coalesce(abs(lead(v) OVER wx - lag(v) OVER wx) / 2, 0) + coalesce(abs(lead(v) OVER wy - lag(v) OVER wy) / 2, 0), 6) AS g
FROM px WINDOW wx AS (PARTITION BY frame, y ORDER BY x), wy AS (PARTITION BY frame, x ORDER BY y)""")
def gradient_l1(spark, d):
    return filters.gradient(s.px(spark, d), ["frame"]).select("frame", "y", "x", F.round("g", 6).alias("g"))


_CH = "CASE WHEN {y} % 2 = 0 AND {x} % 2 = 0 THEN 0 WHEN {y} % 2 = 1 AND {x} % 2 = 1 THEN 2 ELSE 1 END"
_BILINEAR = f"""nb AS (SELECT a.frame, a.y, a.x, b.v, {_CH.format(y="b.y", x="b.x")} AS c, CASE WHEN dy = 0 AND dx = 0 THEN 4 WHEN dy = 0 OR dx = 0 THEN 2 ELSE 1 END AS k, abs(dy) + abs(dx) AS dd
  FROM px a CROSS JOIN range(-1, 2) r(dy) CROSS JOIN range(-1, 2) q(dx) JOIN px b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx),
bl AS (SELECT frame, y, x, sum(k * v) FILTER (c = 0) / sum(k) FILTER (c = 0) AS r, sum(CASE WHEN dd = 0 THEN 4 ELSE 1 END * v) FILTER (c = 1 AND dd < 2) / sum(CASE WHEN dd = 0 THEN 4 ELSE 1 END) FILTER (c = 1 AND dd < 2) AS g,
  sum(k * v) FILTER (c = 2) / sum(k) FILTER (c = 2) AS b FROM nb GROUP BY ALL)"""


@query(f"WITH {PX}, {_BILINEAR} SELECT frame, y, x, round(coalesce(r, 0), 6) AS r, round(coalesce(g, 0), 6) AS g, round(coalesce(b, 0), 6) AS b FROM bl")
def debayer_bilinear(spark, d):
    out = planes.long_view(planes.debayer_bilinear(s.planes(spark, d), "RGGB"), ["frame"], ["r", "g", "b"])
    return out.withColumns({c: F.round(c, 6) for c in "rgb"})


@query(SQL["debayer_bilinear"])
def debayer_bilinear_long(spark, d):
    out = filters.debayer_bilinear(s.px(spark, d), ["frame"], "RGGB", 8, 8)
    return out.withColumns({c: F.round(c, 6) for c in "rgb"})


_MASKS = ", ".join(f"('{n}', {i // 5 - 2}, {i % 5 - 2}, {w / div!r}::DOUBLE)" for n, m, div in (("g", filters.GREEN, 8), ("row", filters.ALONG_ROW, 16), ("diag", filters.DIAGONAL, 16)) for i, w in enumerate(m) if w)


@query(f"""WITH {PX}, {_BILINEAR}, mk(name, dy, dx, w) AS (VALUES {_MASKS}), mm AS (SELECT * FROM mk UNION ALL SELECT 'col', dx, dy, w FROM mk WHERE name = 'row'),
cv AS (SELECT a.frame, a.y, a.x, name, sum(w * b.v) AS s FROM px a CROSS JOIN mm JOIN px b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y BETWEEN 2 AND 5 AND a.x BETWEEN 2 AND 5 GROUP BY ALL),
pv AS (SELECT frame, y, x, max(s) FILTER (name = 'g') AS g, max(s) FILTER (name = 'row') AS rw, max(s) FILTER (name = 'col') AS cl, max(s) FILTER (name = 'diag') AS dg FROM cv GROUP BY ALL),
z AS (SELECT bl.*, px.v, {_CH.format(y="bl.y", x="bl.x")} AS h, {_CH.format(y="bl.y", x="(bl.x + 1)")} AS hb, pv.g AS pg, rw, cl, dg FROM bl JOIN px USING (frame, y, x) LEFT JOIN pv USING (frame, y, x))
SELECT frame, y, x, round(CASE WHEN pg IS NULL THEN coalesce(r, 0) WHEN h = 0 THEN v WHEN h = 1 THEN CASE WHEN hb = 0 THEN rw ELSE cl END ELSE dg END, 6) AS r,
round(CASE WHEN pg IS NULL THEN coalesce(g, 0) WHEN h = 1 THEN v ELSE pg END, 6) AS g,
round(CASE WHEN pg IS NULL THEN coalesce(b, 0) WHEN h = 2 THEN v WHEN h = 1 THEN CASE WHEN hb = 2 THEN rw ELSE cl END ELSE dg END, 6) AS b FROM z""")
def debayer_malvar(spark, d):
    out = planes.long_view(planes.debayer_malvar(s.planes(spark, d), "RGGB", min_rows=8), ["frame"], ["r", "g", "b"])
    return out.withColumns({c: F.round(c, 6) for c in "rgb"})


@query(SQL["debayer_malvar"])
def debayer_malvar_long(spark, d):
    out = filters.debayer_malvar(s.px(spark, d), ["frame"], "RGGB", 8, 8, min_rows=8)
    return out.withColumns({c: F.round(c, 6) for c in "rgb"})


@query(f"""WITH {PX}, a AS (SELECT session, frame, y, x, v FROM px), r AS (SELECT session, y, x, v AS t FROM a WHERE frame IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
j AS (SELECT frame, v, t FROM a JOIN r USING (session, y, x)), f AS (SELECT frame, corr(v, t) AS pearson, coalesce(regr_slope(t, v), 0) AS s, regr_intercept(t, v) AS i FROM j GROUP BY frame)
SELECT frame, round(pearson, 6) AS pearson, round(avg(abs(t - (s * v + i))), 6) AS mae FROM j JOIN f USING (frame) GROUP BY frame, pearson""")
def pearson_parity(spark, d):
    from framelake.operators.parity import parity

    p = s.px(spark, d).select("session", "frame", "y", "x", "v")
    ref = _reference(spark, d, p).select("session", "y", "x", F.col("v").alias("t"))
    return parity(p.join(ref, ["session", "y", "x"]), ["frame"]).select("frame", F.round("pearson", 6).alias("pearson"), F.round("mae", 6).alias("mae"))
