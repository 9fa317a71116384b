"""Queries of whole compositions: surfaces of degree 2, messages, table functions, display and masters."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import markdown, tables
from framelake.operators import background, devices, stack
from framelake.operators import pixels as p
from framelake.plans.group_i import _MTF
from framelake.plans.registry import PX, RGB, SQL, query
from framelake.sources import config
from framelake.sources import surrogates as s


def _elimination(n: int) -> str:
    """CTEs from g(frame, s00, ..., b0, ...), whose matrix is symmetric and positive, to z(frame, z0, ...)."""
    rows = {(i, j): f"s{min(i, j)}{max(i, j)}" if j < n else f"b{i}" for i in range(n) for j in range(n + 1)}
    out, at = "e0 AS (SELECT frame, " + ", ".join(f"{c} AS m{i}{j}" for (i, j), c in rows.items()) + " FROM g)", 0
    for c in range(n):
        cells = ", ".join(f"m{i}{j}" if i <= c else f"m{i}{j} - m{i}{c} / m{c}{c} * m{c}{j} AS m{i}{j}" for i in range(n) for j in range(n + 1))
        out += f",\ne{c + 1} AS (SELECT frame, {cells} FROM e{c})"
        at = c + 1
    out += f",\nz{n} AS (SELECT * FROM e{at})"
    for r in range(n - 1, -1, -1):
        out += f",\nz{r} AS (SELECT *, (m{r}{n} - (0{''.join(f' + m{r}{k} * x{k}' for k in range(r + 1, n))})) / m{r}{r} AS x{r} FROM z{r + 1})"
    return out


_BASIS = ["1.0::DOUBLE", "u", "w", "u * u", "u * w", "w * w"]
_CLIP = """c{k} AS (SELECT frame, y, x, v FROM (
  SELECT *, list_sort(list(abs(v - med)) OVER (PARTITION BY frame))[n // 2 + 1] * 1.4826 AS sigma FROM (
    SELECT *, list_sort(list(v) OVER (PARTITION BY frame))[count(*) OVER (PARTITION BY frame) // 2 + 1] AS med, count(*) OVER (PARTITION BY frame) AS n FROM c{j}))
  WHERE sigma <= 1e-12 OR v <= med + 2.0 * sigma)"""


@query(f"""WITH {PX}, c0 AS (SELECT frame, y, x, v FROM px WHERE frame % 5 <> 0 OR x = 3),
{", ".join(_CLIP.format(k=k, j=k - 1) for k in (1, 2, 3))},
t AS (SELECT frame, x / 8.0::DOUBLE * 2 - 1 AS u, y / 8.0::DOUBLE * 2 - 1 AS w, v FROM c3 WHERE frame % 5 <> 0),
g AS (SELECT frame, {", ".join(f"sum({_BASIS[i]} * {_BASIS[j]}) AS s{i}{j}" for i in range(6) for j in range(i, 6))}, {", ".join(f"sum({b} * v) AS b{i}" for i, b in enumerate(_BASIS))} FROM t GROUP BY frame),
{_elimination(6)}
SELECT frame, {", ".join(f"round(x{i}, 6) AS a{i}" for i in range(6))} FROM (SELECT DISTINCT frame FROM px) LEFT JOIN z0 USING (frame)""")
def surface_fit_2(spark, d):
    """Every fifth frame has one column of pixels only, which fixes no surface."""
    px = s.px(spark, d).where("frame % 5 <> 0 OR x = 3").select("frame", "y", "x", "v")
    fit = background.surface_fit(background.clip_high(px, ["frame"]), ["frame"], 2, 8, 8)
    return fit.select("frame", *[F.round(F.col("coefficients")[i], 6).alias(f"a{i}") for i in range(6)])


_MESSAGE = """CASE event_id % 10
  WHEN 0 THEN '{"op": 0, "d": {"rpcVersion": ' || (event_id % 4) || '}}'
  WHEN 1 THEN '{"op": 0, "d": {"rpcVersion": 1, "authentication": {"challenge": "' || event_type || '"' || CASE WHEN event_id % 20 = 1 THEN ', "salt": "s"' ELSE '' END || '}}}'
  WHEN 2 THEN '{"op": 2, "d": {}}' WHEN 3 THEN '{"op": 5, "d": {"eventType": "' || event_type || '", "eventData": ' || props || '}}'
  WHEN 4 THEN '{"op": 5, "d": ' || props || '}'
  WHEN 5 THEN '{"op": 7, "d": {"requestId": "' || user_id || '", "requestType": "' || event_type || '", "requestStatus": {"result": ' || CASE WHEN event_id % 20 = 5 THEN 'true' ELSE 'false' END || ', "code": ' || (100 + event_id % 500) || '}, "responseData": ' || props || '}}'
  WHEN 6 THEN '{"op": 7, "d": {"requestId": ' || user_id || ', "requestType": "x", "requestStatus": {"result": "true", "code": 1}}}'
  WHEN 7 THEN props WHEN 8 THEN 'op ' || props ELSE '{"op": ' || (3 + event_id % 5) || '.5}' END"""


@query(f"""WITH t AS (SELECT event_id, {_MESSAGE} AS t FROM events), j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM t),
k AS (SELECT event_id, CASE WHEN json_type(j, '$.op') IN ('BIGINT', 'UBIGINT') THEN (j->>'$.op')::BIGINT END AS op, j FROM j),
f AS (SELECT event_id, op, j, CASE WHEN op = 0 AND json_type(j, '$.d.rpcVersion') IN ('BIGINT', 'UBIGINT') AND (json_type(j, '$.d.authentication') IS NULL OR json_type(j, '$.d.authentication.salt') = 'VARCHAR') THEN 'hello'
  WHEN op = 2 THEN 'identified' WHEN op = 5 AND json_type(j, '$.d.eventType') = 'VARCHAR' THEN 'event'
  WHEN op = 7 AND json_type(j, '$.d.requestId') = 'VARCHAR' AND json_type(j, '$.d.requestStatus.result') = 'BOOLEAN' THEN 'response' ELSE 'unknown' END AS kind FROM k)
SELECT event_id, op IS NULL AS malformed, kind, CASE kind WHEN 'hello' THEN (j->>'$.d.rpcVersion')::BIGINT END AS rpc_version, CASE kind WHEN 'hello' THEN j->>'$.d.authentication.challenge' END AS challenge,
CASE kind WHEN 'event' THEN j->>'$.d.eventType' WHEN 'response' THEN j->>'$.d.requestType' END AS type, CASE kind WHEN 'response' THEN (j->>'$.d.requestStatus.code')::BIGINT END AS code,
CASE kind WHEN 'response' THEN (j->>'$.d.requestStatus.result')::BOOLEAN END AS ok, CASE kind WHEN 'event' THEN (j->>'$.d.eventData.k')::BIGINT WHEN 'response' THEN (j->>'$.d.responseData.k')::BIGINT END AS k FROM f""")
def messages(spark, d):
    e = s.table(spark, d, "events").select("event_id", config.message(F.expr(_MESSAGE)).alias("m"))
    out = ["malformed", "kind", "rpc_version", "challenge", "type", "code", "ok"]
    return e.select("event_id", *[F.col(f"m.{c}") for c in out], F.get_json_object("m.data", "$.k").cast("long").alias("k"))


@query(SQL["md_blocks"])
def md_blocks_udtf(spark, d):
    """md_blocks by the table function."""
    r = s.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "t"))
    mark = F.element_at(F.array(*map(F.lit, ("# ", "- ", "1. ", "> ", ""))), (F.expr("pos div 2 % 5") + 1).cast("int"))
    tables.register(spark)
    lines = markdown.lines(r.select("doc", "pos", F.concat(mark, "t").alias("line")), "doc", "pos", "line")
    out = spark.sql("SELECT * FROM md_blocks(TABLE(SELECT * FROM {lines}) PARTITION BY doc ORDER BY pos)", lines=lines)
    joined = F.when(F.col("kind") == "paragraph", F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("@")))
    return out.select("doc", "block", "kind", "level", F.sha2(joined, 256).alias("text_sha256"), "n_lines")


@query(f"""WITH {RGB}, e AS (SELECT t, t * 8 // 4 AS a, (t + 1) * 8 // 4 AS b FROM range(4) r(t)),
t AS (SELECT image, c, ey.t AS ty, ex.t AS tx, median(v) AS med FROM rgb JOIN e ey ON y >= ey.a AND y < ey.b JOIN e ex ON x >= ex.a AND x < ex.b GROUP BY ALL),
bg AS (SELECT image, c, list_sort(list(med))[round(0.2 * (count(*) - 1))::INT + 1] AS bg FROM t GROUP BY ALL),
n1 AS (SELECT image, c, y, x, least(greatest(v - (bg - mn), 0), 1) AS v FROM rgb JOIN (SELECT *, min(bg) OVER (PARTITION BY image) AS mn FROM bg) USING (image, c)),
gm AS (SELECT image, c, median(v) AS med FROM n1 GROUP BY ALL), gg AS (SELECT image, med AS green FROM gm WHERE c = 1),
n2 AS (SELECT image, c, y, x, CASE WHEN c = 1 OR med <= 1e-9 OR green <= 1e-9 THEN v ELSE least(greatest(v * (green / med), 0), 1) END AS v FROM n1 JOIN gm USING (image, c) JOIN gg USING (image)),
b AS (SELECT image, c, y, x, greatest(0, (v - 0.05::DOUBLE) / (1 - 0.05::DOUBLE)) AS v FROM n2),
l AS (SELECT image, y, x, avg(v) AS v FROM b GROUP BY ALL), md AS (SELECT image, list_sort(list(v))[count(*) // 2 + 1] AS med FROM l GROUP BY image),
ma AS (SELECT image, med, list_sort(list(abs(v - med)))[count(*) // 2 + 1] AS mad FROM l JOIN md USING (image) GROUP BY image, med),
sh AS (SELECT image, med, least(greatest(med - 2.8 * CASE WHEN 1.4826 * mad > 1e-10 THEN 1.4826 * mad ELSE greatest(med, 1e-10) END, 0), 1) AS shadow FROM ma),
r AS (SELECT image, shadow, least(greatest((med - shadow) / greatest(1 - shadow, 1e-9), 1e-9), 1) AS r FROM sh),
mi AS (SELECT image, shadow, least(greatest(({_MTF.format(x="r", m="0.25::DOUBLE")}) * 2::DOUBLE ^ -0.25, 1e-4), 1 - 1e-4) AS midtone FROM r),
s AS (SELECT image, c, y, x, {_MTF.format(x="least(greatest((v - shadow) / greatest(1 - shadow, 1e-9), 0), 1)", m="midtone")} AS v FROM b JOIN mi USING (image)),
lu AS (SELECT image, y, x, sum(v * CASE c WHEN 0 THEN 0.2126 WHEN 1 THEN 0.7152 ELSE 0.0722 END) AS luma FROM s GROUP BY ALL),
o AS (SELECT image, c, y, x, round(least(greatest(luma + (v - luma) * 1.4, 0), 1), 6) AS v FROM s JOIN lu USING (image, y, x))
SELECT image, c, y, x, v, floor(v * 255)::INT AS q FROM o""")
def display_order(spark, d):
    """Offset, gain, black point, stretch, saturation and packing in their order; the steps on whole images are in the tests."""
    out = p.display(s.rgb(spark, d), ["image"], 8, 8, factor=1.4, tiles=4, black=0.05, strength=0.25).withColumn("v", F.round("v", 6))
    return out.select("image", F.col("c").cast("long").alias("c"), "y", "x", "v", p.quantize8(F.col("v")).alias("q"))


_MASKED = "CASE WHEN x = 0 OR y = 7 AND session % 2 = 0 THEN CASE WHEN frame % 2 = 0 THEN m ELSE 0 END ELSE m END"


@query(f"""WITH {PX}, w AS (SELECT session, (frame // 10) % 3 AS c, y, x, v, {_MASKED} AS m FROM px),
mean AS (SELECT session, c, y, x, CASE WHEN sum(m) > 0 THEN sum(m * v) / sum(m) ELSE 0 END AS v, sum(m) AS coverage FROM w GROUP BY ALL),
ok AS (SELECT *, (coverage >= 0.9 * max(coverage) OVER (PARTITION BY session))::INT AS ok FROM mean WHERE c = 0),
rr AS (SELECT session, min(y) AS y0, max(y) AS y1 FROM (SELECT session, y FROM ok GROUP BY session, y HAVING sum(ok) >= 0.5 * count(*)) GROUP BY session),
cc AS (SELECT session, min(x) AS x0, max(x) AS x1 FROM (SELECT session, x FROM ok GROUP BY session, x HAVING sum(ok) >= 0.5 * count(*)) GROUP BY session),
g AS (SELECT *, NOT (x0 = 0 AND y0 = 0 AND x1 = 7 AND y1 = 7) AND (x1 - x0 + 1) * (y1 - y0 + 1) >= 38 AS real FROM rr JOIN cc USING (session)),
k AS (SELECT mean.*, CASE WHEN real THEN y0 ELSE 0 END AS a, CASE WHEN real THEN y1 ELSE 7 END AS b, CASE WHEN real THEN x0 ELSE 0 END AS d, CASE WHEN real THEN x1 ELSE 7 END AS e FROM mean LEFT JOIN g USING (session)),
i AS (SELECT session, c, y - a AS y, x - d AS x, e - d + 1 AS width, b - a + 1 AS height, v FROM k WHERE y BETWEEN a AND b AND x BETWEEN d AND e),
t AS (SELECT session, c, median(v) AS med FROM i GROUP BY session, c, ((y + 1) * 4 - 1) // height, ((x + 1) * 4 - 1) // width),
bg AS (SELECT session, c, list_sort(list(med))[round(0.2 * (count(*) - 1))::INT + 1] AS bg FROM t GROUP BY ALL)
SELECT session::BIGINT AS session, c::BIGINT AS c, y::BIGINT AS y, x::BIGINT AS x, width::BIGINT AS width, height::BIGINT AS height, round(least(greatest(v - (bg - mn), 0), 1), 6) AS mean
FROM i JOIN (SELECT *, min(bg) OVER (PARTITION BY session) AS mn FROM bg) USING (session, c)""")
def master_neutral(spark, d):
    px = s.px(spark, d).withColumn("m", F.expr(_MASKED)).withColumn("c", F.expr("cast((frame div 10) % 3 as int)"))
    out = stack.master_image(px, ["session"], 8, 8, tiles=4)
    return out.select("session", *[F.col(c).cast("long").alias(c) for c in ("c", "y", "x", "width", "height")], F.round("mean", 6).alias("mean"))


_CAPTURES = """f AS (SELECT user_id % 10 AS site, event_id, ts AS mtime, CASE event_id % 6 WHEN 0 THEN 'EMMC Images' WHEN 1 THEN 'emmc images-2' WHEN 2 THEN 'Seestar Backup' WHEN 3 THEN 'my-seestar' WHEN 4 THEN 'T7' ELSE 'emmc images-x' END AS volume,
  CASE WHEN event_id % 7 < 4 THEN 'MyWorks' ELSE 'Autorun/Light' END AS parent, 'M' || event_id % 110 || CASE WHEN event_id % 11 < 8 THEN '_sub' ELSE '' END AS name,
  'Light_M_' || (event_id % 30) || '.0s_LP_' || {stamp} || CASE WHEN event_id % 13 = 0 THEN '.FIT' WHEN event_id % 13 = 1 THEN '.txt' ELSE '.fit' END AS file FROM events)"""


@query(f"""WITH {_CAPTURES.format(stamp="strftime(ts, '%Y%m%d-%H%M%S')")},
b AS (SELECT site, arg_max({{'volume': volume, 'name': name}}, (mtime, name, volume)) AS b FROM f
  WHERE NOT regexp_matches(lower(volume), 'backup|archive|clone') AND regexp_matches(lower(volume), '^emmc images(-[0-9]+)?$|seestar') AND parent = 'MyWorks' AND name LIKE '%\\_sub' ESCAPE '\\' GROUP BY site),
n AS (SELECT f.site, arg_max(file, (regexp_extract(file, '[0-9]{{8}}-[0-9]{{6}}'), file)) AS file FROM f JOIN b ON f.site = b.site AND f.volume = b.b.volume AND f.name = b.b.name AND f.parent = 'MyWorks' WHERE lower(file) LIKE '%.fit' GROUP BY f.site)
SELECT site, b.volume AS volume, 'MyWorks/' || b.name AS folder, left(b.name, len(b.name) - 4) AS target, try_cast(regexp_extract(file, '_([0-9.]+)s_', 1) AS DOUBLE) AS exposure FROM b LEFT JOIN n USING (site)""")
def works_folders(spark, d):
    f = _captures(spark, d)
    return devices.works_folder(f.select("site", "volume", "parent", "name", "mtime"), _files_in(f), ["site"])


@query(f"""WITH {_CAPTURES.format(stamp="strftime(ts, '%Y%m%d-%H%M%S')")}, g AS (SELECT DISTINCT site, volume, name FROM f WHERE parent = 'Autorun/Light' AND regexp_matches(lower(file), '\\.(fit|fits)$')),
b AS (SELECT site, arg_max({{'volume': volume, 'name': name}}, (mtime, name, volume)) AS b FROM f SEMI JOIN g USING (site, volume, name) WHERE NOT regexp_matches(lower(volume), 'backup|archive|clone') AND parent = 'Autorun/Light' GROUP BY site)
SELECT site, b.volume AS volume, 'Autorun/Light/' || b.name AS folder, b.name AS target, NULL::DOUBLE AS exposure, 'fit' AS extension FROM b""")
def lights_folders(spark, d):
    f = _captures(spark, d)
    return devices.lights_folder(f.select("site", "volume", "parent", "name", "mtime"), _files_in(f), keys=["site"])


def _captures(spark, d):
    text = _CAPTURES.removeprefix("f AS (").removesuffix(")").format(stamp="date_format(ts, 'yyyyMMdd-HHmmss')")
    return spark.sql(text.replace("event_id % 110", "(event_id % 110)").replace(" FROM events", " FROM {events}"), events=s.table(spark, d, "events"))


def _files_in(f):
    return f.select("site", "volume", F.concat_ws("/", "parent", "name").alias("parent"), F.col("file").alias("name"), "mtime")
