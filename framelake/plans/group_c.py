"""Session and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import pixels, replay, session
from framelake.plans.registry import PX, SNAP, query
from framelake.sources import surrogates as s

_GATE = """list_reduce(list_prepend(struct_pack(i := 0::BIGINT, v := m[1], kept := [0::BIGINT], recent := [m[1]], pend := []::BIGINT[], vals := []::DOUBLE[], sgn := 0),
  list_transform(list_filter(range(1, len(m) - 1), lambda i: i > 0), lambda i: struct_pack(i := i, v := m[i + 1], kept := []::BIGINT[], recent := []::DOUBLE[], pend := []::BIGINT[], vals := []::DOUBLE[], sgn := 0))),
  lambda a, p: CASE WHEN {out} THEN
      CASE WHEN {n} > 5 THEN struct_pack(i := p.i, v := p.v, kept := list_concat(a.kept, {pend}), recent := {tail_vals}, pend := []::BIGINT[], vals := []::DOUBLE[], sgn := 0)
           ELSE struct_pack(i := p.i, v := p.v, kept := a.kept, recent := a.recent, pend := {pend}, vals := {vals}, sgn := {sgn}) END
    ELSE struct_pack(i := p.i, v := p.v, kept := list_append(a.kept, p.i), recent := list_append(a.recent, p.v)[-5:], pend := []::BIGINT[], vals := []::DOUBLE[], sgn := 0) END)"""
_BASE = "list_sort(a.recent)[len(a.recent) // 2 + 1]"
_AWAY = f"((p.v - {_BASE}) / greatest(abs({_BASE}), 0.01))"
_SGN = f"(CASE WHEN {_AWAY} > 0 THEN 1 ELSE -1 END)"
_PEND = f"(CASE WHEN a.sgn = {_SGN} THEN list_append(a.pend, p.i) ELSE [p.i] END)"
_VALS = f"(CASE WHEN a.sgn = {_SGN} THEN list_append(a.vals, p.v) ELSE [p.v] END)"
_FOLD = _GATE.format(out=f"({_AWAY} < -0.8 OR {_AWAY} > 0.5)", n=f"len({_PEND})", pend=_PEND, vals=_VALS, tail_vals=f"list_concat(a.recent, {_VALS})[-5:]", sgn=_SGN)


@query(f"""WITH {SNAP}, g AS (SELECT session, list(median ORDER BY ts, event_id) AS m, list(event_id ORDER BY ts, event_id) AS e FROM snap GROUP BY session),
f AS (SELECT session, m, e, {_FOLD} AS st FROM g WHERE len(m) > 2),
k AS (SELECT session, e, unnest(list_concat(list_concat(st.kept, CASE WHEN st.sgn > 0 THEN st.pend ELSE [] END), [len(m) - 1])) AS i FROM f
      UNION ALL SELECT session, e, unnest(range(len(m))) FROM g WHERE len(m) <= 2)
SELECT session, e[i + 1] AS event_id FROM k""")
def quality_gate(spark, d):
    return replay.quality_gate(s.snap(spark, d), "session", ["ts", "event_id"], ["event_id"])


@query("""WITH n AS (SELECT user_id AS session, count(*) AS n FROM events GROUP BY user_id),
j AS (SELECT session, n, least(greatest(round(power(n::DOUBLE, j / 11.0::DOUBLE) - 1)::INT, 0), n - 1) AS i FROM n, range(12) r(j) WHERE n > 12
      UNION SELECT session, n, unnest([0, n - 1]) FROM n WHERE n > 12 UNION SELECT session, n, unnest(range(n)) FROM n WHERE n <= 12)
SELECT session, i::INT AS keyframe FROM (SELECT DISTINCT session, i FROM j)""")
def log_keyframes(spark, d):
    n = s.snap(spark, d).groupBy("session").agg(F.count("*").alias("n"))
    return n.select("session", F.explode(replay.log_keyframes(F.col("n"), 12)).alias("keyframe"))


@query(f"""WITH {SNAP}, g AS (SELECT session, list(median ORDER BY ts, event_id) AS m, list(event_id ORDER BY ts, event_id) AS e FROM snap GROUP BY session),
f AS (SELECT e, list_reduce(list_prepend(struct_pack(i := -1::BIGINT, v := NULL::DOUBLE, kept := []::BIGINT[]), list_transform(range(len(m)), lambda i: struct_pack(i := i, v := m[i + 1], kept := [len(m)]))),
  lambda a, p: CASE WHEN a.v IS NULL OR abs(p.v - a.v) >= 25 OR p.i = p.kept[1] - 1 THEN struct_pack(i := p.i, v := p.v, kept := list_append(a.kept, p.i)) ELSE a END) AS st, session FROM g)
SELECT session, e[i + 1] AS event_id FROM (SELECT session, e, unnest(st.kept) AS i FROM f)""")
def dedupe_keyframes(spark, d):
    g = s.snap(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "median"))).alias("s"))
    g = g.withColumn("i", F.explode(replay.dedupe(F.transform("s", lambda x: x["median"]), 25.0)))
    return g.select("session", F.element_at("s", F.col("i") + 1)["event_id"].alias("event_id"))


@query(f"""WITH {PX}, t AS (SELECT session, frame, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM px GROUP BY ALL),
l AS (SELECT session, frame, abs(v - lag(v) OVER (PARTITION BY session, y, x ORDER BY frame)) AS df FROM t)
SELECT session::BIGINT AS session, frame, round(avg(df), 6) AS difference FROM l WHERE df IS NOT NULL GROUP BY session, frame""")
def thumb_diff(spark, d):
    t = pixels.half_res(s.px(spark, d), ["session", "frame"])
    return replay.thumb_difference(t, ["session"], "frame", ["y", "x"]).withColumn("difference", F.round("difference", 6))


@query("""WITH c AS (SELECT c_custkey AS session, c_acctbal + 1000 AS seconds, c_custkey % 500 AS frames, CASE WHEN c_custkey % 3 = 0 THEN 2.5 ELSE (c_custkey % 7 + 1)::DOUBLE END AS sub FROM customer),
t AS (SELECT *, round(seconds)::BIGINT AS tot FROM c)
SELECT session, (CASE WHEN tot // 3600 > 0 THEN (tot // 3600) || 'h ' || (tot % 3600 // 60) || 'm' WHEN tot % 3600 // 60 > 0 THEN (tot % 3600 // 60) || 'm' || CASE WHEN tot % 60 > 0 THEN ' ' || (tot % 60) || 's' ELSE '' END ELSE (tot % 60) || 's' END)
  || ' · ' || frames || ' × ' || CASE WHEN sub % 1 = 0 THEN (sub::BIGINT)::VARCHAR ELSE sub::VARCHAR END || 's' AS caption FROM t""")
def caption(spark, d):
    k = F.col("c_custkey")
    sub = F.when(k % 3 == 0, 2.5).otherwise((k % 7 + 1).cast("double"))
    return s.table(spark, d, "customer").select(k.alias("session"), session.caption(F.col("c_acctbal") + 1000, k % 500, sub).alias("caption"))


@query("""WITH f AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderstatus, o_orderpriority, o_totalprice FROM orders)
SELECT o_orderkey AS frame, o_custkey || ',' || n || ',' || CASE WHEN regexp_matches(p, '[,"\\n\\r]') THEN '"' || replace(p, '"', '""') || '"' ELSE p END || ',' || o_orderstatus || ',' || printf('%.2f', o_totalprice) AS line
FROM (SELECT *, o_orderpriority || ', "' || o_orderstatus || '"' AS p FROM f)""".replace("\\n", chr(10)).replace("\\r", chr(13)))
def frame_csv(spark, d):
    from pyspark.sql import Window

    o = s.table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    field = session.csv_field(F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')))
    return o.select(F.col("o_orderkey").alias("frame"), F.concat_ws(",", F.col("o_custkey").cast("string"), n.cast("string"), field, "o_orderstatus", F.format_string("%.2f", "o_totalprice")).alias("line"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '[,"@@]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""".replace("@@", chr(10) + chr(13)))
def csv_escape(spark, d):
    t = s.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return t.select("doc_id", session.csv_field(F.col("t")).alias("field"))


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS a, count(*) FILTER (o_orderstatus = 'P') AS r FROM orders GROUP BY o_custkey)
SELECT c_custkey AS session, '| ' || replace(replace(c_name, '\\', '\\\\'), '|', '\\|') || ' | ' || coalesce(nullif(trim(c_mktsegment), ''), '—') || ' | ' || replace(n_name, '|', '\\|') || ' | ' || coalesce(a, 0) || ' | ' || coalesce(r, 0) || ' |' AS line
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey""")
def summary_rows(spark, d):
    acc = F.col("o_orderstatus") != "P"
    o = session.totals(s.table(spark, d, "orders"), "o_custkey", acc, F.lit(1.0))
    c = s.table(spark, d, "customer").join(F.broadcast(s.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    cells = [session.markdown_cell(F.col("c_name")), session.value_or_dash(F.col("c_mktsegment")), session.markdown_cell(F.col("n_name")), F.coalesce("accepted", F.lit(0)).cast("string"), F.coalesce("rejected", F.lit(0)).cast("string")]
    return c.select(F.col("c_custkey").alias("session"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


@query("""SELECT o_custkey AS session, count(*) FILTER (o_orderstatus <> 'P')::BIGINT AS accepted, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS rejected,
round(count(*) FILTER (o_orderstatus <> 'P') * 20.0, 6)::DOUBLE AS integration FROM orders GROUP BY o_custkey""")
def session_totals(spark, d):
    out = session.totals(s.table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") != "P", F.lit(20.0))
    return out.withColumnRenamed("o_custkey", "session")


@query("""WITH p AS (SELECT p_partkey, DATE '2024-01-01' + (p_partkey % 3)::INT AS day, regexp_replace(regexp_replace(lower(p_name || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ' #' || p_brand END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part),
b AS (SELECT p_partkey, strftime(day, '%Y-%m-%d') || '-' || CASE WHEN z = '' THEN 'session' ELSE z END AS base FROM (SELECT *, regexp_replace(substr(s, 1, 24), '-+$', '') AS z FROM p)),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b)
SELECT p_partkey AS part, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM n""")
def session_slug(spark, d):
    k = F.col("p_partkey")
    p = s.table(spark, d, "part").withColumns({"day": F.date_add(F.lit("2024-01-01").cast("date"), (k % 3).cast("int")), "target": F.concat("p_name", F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(" #"), "p_brand")))})
    return session.session_ids(p, "day", "target", "p_partkey").select(k.alias("part"), "id")


@query("""SELECT c_custkey AS session, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END), ''), n_name) AS location
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fill_blank(spark, d):
    k = F.col("c_custkey")
    c = s.table(spark, d, "customer").join(F.broadcast(s.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    user = F.when(k % 3 == 0, "  ").when(k % 3 == 2, F.col("c_mktsegment"))
    return c.select(k.alias("session"), session.fill_blank(user, F.col("n_name")).alias("location"))


@query("""WITH n AS (SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS tot FROM events)
SELECT session, event_id, i = 1 OR i % greatest(1, round(tot / 12)::BIGINT) = 0 OR i = tot AS rendered FROM n""")
def render_cadence(spark, d):
    return session.render_cadence(s.snap(spark, d), "session", ["ts", "event_id"], 12).select("session", "event_id", "rendered")


@query("""WITH p AS (SELECT f, f / (1350 / 12.0::DOUBLE) AS pos FROM range(1350) r(f)), q AS (SELECT f, pos, least(floor(pos)::BIGINT, 11) AS i FROM p),
b AS (SELECT f, i, least(i + 1, 11) AS j, least(greatest(0.0, (pos - i - (1 - 15 / (1350 / 12.0::DOUBLE))) / (15 / (1350 / 12.0::DOUBLE))), 1.0) AS blend FROM q)
SELECT f, i, j, round(blend, 6) AS blend, CASE WHEN blend >= 0.5 THEN j ELSE i END AS caption_of FROM b""")
def replay_plan(spark, d):
    out = replay.replay_plan(spark.range(1350).withColumnRenamed("id", "f"), 12)
    return out.select("f", "i", F.col("j").cast("long").alias("j"), F.round("blend", 6).alias("blend"), F.col("caption_of").cast("long").alias("caption_of"))


@query("""WITH e AS (SELECT event_id, ts, event_id % 24 AS h, event_id % 60 AS m FROM events), t AS (SELECT *, date_trunc('day', ts)::TIMESTAMP + to_hours(h::INT) + to_minutes(m::INT) AS today FROM e)
SELECT event_id, CASE WHEN today >= ts THEN today ELSE today + INTERVAL 1 DAY END AS stop FROM t""")
def planned_stop(spark, d):
    e = s.snap(spark, d)
    h, m = (F.col("event_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int")
    return e.select("event_id", session.planned_stop(F.col("ts"), h, m).cast("timestamp_ntz").alias("stop"))


@query("""WITH f AS (SELECT event_id, 'relay_' || strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 5 = 0 THEN '' ELSE '_to_' || strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') END AS name FROM events UNION ALL SELECT -event_id, 'incoming_' || event_id FROM events WHERE event_id % 100 = 0),
l AS (SELECT event_id, name, regexp_extract_all(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS ds FROM f)
SELECT event_id, name FROM l WHERE len(ds) > 0 AND ds[-1]::DATE < DATE '2024-01-31' - 14 AND name NOT LIKE 'incoming%'""")
def retention_prune(spark, d):
    from framelake.operators.folder import prunable

    e = s.table(spark, d, "events")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    name = F.concat(F.lit("relay_"), day(F.col("ts")), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("_to_"), day(F.col("ts") + F.expr("interval 2 days")))))
    dirs = e.select("event_id", name.alias("name")).unionByName(e.where("event_id % 100 = 0").select((-F.col("event_id")).alias("event_id"), F.concat(F.lit("incoming_"), "event_id").alias("name")))
    return prunable(dirs, F.lit("2024-01-31").cast("date"), 14, exclude="^incoming").select("event_id", "name")


@query("""SELECT user_id AS session, round(CASE WHEN sum(event_id % 50) > 0 THEN sum(event_id % 3)::DOUBLE / sum(event_id % 50) END, 6) AS dropped, round(least(greatest(max(value) / 400 - 0.2, 0), 1), 6) AS congestion FROM events GROUP BY user_id""")
def dropped_fraction(spark, d):
    from framelake.functions.stats import clamp

    g = s.table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.sum(F.col("event_id") % 3).alias("skipped"), F.sum(F.col("event_id") % 50).alias("total"), F.max("value").alias("load"))
    return g.select("session", F.round(F.try_divide(F.col("skipped").cast("double"), F.col("total").cast("double")), 6).alias("dropped"), F.round(clamp(F.col("load") / 400 - 0.2), 6).alias("congestion"))


@query("""WITH l AS (SELECT user_id AS session, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT session, event_id, round(epoch_us(nx) / 1e6 - epoch_us(ts) / 1e6, 3) AS gap FROM l WHERE epoch_us(nx) / 1e6 - epoch_us(ts) / 1e6 > greatest(3 * 20000.0, 90.0)""")
def stalls(spark, d):
    out = session.stalls(s.snap(spark, d), "session", "ts", ["event_id"], F.lit(20_000.0))
    return out.select("session", "event_id", F.round("gap", 3).alias("gap"))


@query("""WITH l AS (SELECT user_id AS session, ts, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) / 1e6 - epoch_us(ts) / 1e6 AS gap FROM events)
SELECT session, ts AS idle_from, round(gap, 3) AS idle_seconds FROM l WHERE gap >= 600 * 60""")
def idle_episodes(spark, d):
    return session.idle_episodes(s.snap(spark, d), "session", "ts", 600).withColumn("idle_seconds", F.round("idle_seconds", 3))


@query("""WITH e AS (SELECT user_id AS session, ts, event_id, CASE WHEN value < 120 THEN 1 ELSE 0 END AS f FROM events),
i AS (SELECT *, sum(1 - f) OVER (PARTITION BY session ORDER BY ts, event_id) AS island FROM e), r AS (SELECT *, sum(f) OVER (PARTITION BY session, island ORDER BY ts, event_id) AS run FROM i),
p AS (SELECT *, coalesce(sum(CASE WHEN f = 1 AND run % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM r),
m AS (SELECT *, max(epoch) OVER (PARTITION BY session) AS last FROM p)
SELECT session, CASE WHEN sum(1 - f) = 0 THEN 'no_frames' WHEN sum(CASE WHEN f = 0 AND epoch = last THEN 1 ELSE 0 END) > 0 THEN 'written' ELSE 'awaiting_seed' END AS outcome FROM m GROUP BY session""")
def master_outcome(spark, d):
    from framelake.operators import stack

    f = stack.reseed_epochs(s.snap(spark, d), "session", ["ts", "event_id"], F.col("median") < 120)
    return session.master_outcome(f.withColumn("accepted", F.col("median") >= 120), "session")


@query("""SELECT o_custkey AS session, o_orderkey AS frame, count(*) OVER w AS processed, (sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER w)::BIGINT AS accepted,
(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER w)::BIGINT AS rejected, count(*) OVER (PARTITION BY o_custkey) AS total
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def progress_counts(spark, d):
    out = session.progress(s.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "P")
    return out.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("frame"), "processed", "accepted", "rejected", "total")


@query("""WITH a AS (SELECT user_id AS session, event_id, ts, event_id % 4 <> 0 AS ok, min(ts) OVER (PARTITION BY user_id) AS began FROM events),
b AS (SELECT *, date_trunc('day', began)::TIMESTAMP + INTERVAL 10 DAY + INTERVAL 22 HOUR AS stop, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM a),
c AS (SELECT *, ts >= stop AND row_number() OVER (PARTITION BY session, ts >= stop ORDER BY ts, event_id) = 1 AS ends FROM b),
d AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(last) >= 36000000000 AND NOT ends, false) AS idle FROM c),
e AS (SELECT *, idle AND row_number() OVER (PARTITION BY session, last, idle ORDER BY ts, event_id) = 1 AS fires FROM d)
SELECT session, event_id, CASE WHEN ends THEN 'end_session' ELSE 'safeguard' END AS action FROM e WHERE ends OR fires""")
def completion(spark, d):
    looks = s.snap(spark, d)
    began = looks.groupBy("session").agg(F.min("ts").alias("_began"))
    stop = F.date_trunc("day", "_began") + F.expr("interval 10 days 22 hours")
    out = session.completion(looks.join(began, "session"), "session", ["ts", "event_id"], F.col("event_id") % 4 != 0, stop.cast("timestamp_ntz"), 600)
    return out.where("action is not null").select("session", "event_id", "action")
