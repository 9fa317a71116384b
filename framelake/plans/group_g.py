"""Folder, text and message queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import markdown
from framelake.operators import folder
from framelake.plans.registry import FILES, query
from framelake.sources import config
from framelake.sources import surrogates as s


@query("""WITH g AS (SELECT user_id AS name, event_id, ts, sha256(event_type || floor(value / 100)::BIGINT) AS d FROM events)
SELECT name, event_id, d IS DISTINCT FROM lag(d) OVER (PARTITION BY name ORDER BY ts, event_id) AS emitted FROM g""")
def digest_dedup(spark, d):
    e = s.table(spark, d, "events").withColumn("name", F.col("user_id"))
    digest = F.sha2(F.concat("event_type", F.floor(F.col("value") / 100).cast("string")), 256)
    return folder.changed(e, "name", ["ts", "event_id"], digest).select("name", "event_id", "emitted")


@query("""WITH r AS (SELECT user_id AS folder, event_id, ts, event_id % 40 AS rev FROM events)
SELECT folder, event_id, max(rev) OVER (PARTITION BY folder ORDER BY ts, event_id) AS high,
coalesce(rev <= max(rev) OVER (PARTITION BY folder ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM r""")
def high_water(spark, d):
    e = s.table(spark, d, "events").withColumn("folder", F.col("user_id"))
    return folder.high_water(e, ["folder"], ["ts", "event_id"], F.col("event_id") % 40).select("folder", "event_id", "high", "late")


@query("""WITH f AS (SELECT user_id, event_id, 'stack_' || CASE WHEN event_id % 3 = 0 THEN '00' ELSE '' END || (event_id % 120) || '.fit' AS name FROM events),
k AS (SELECT *, nullif(regexp_extract(name, '([0-9]+)(?:\\.[A-Za-z]+)?$', 1), '') AS rev FROM f), b AS (SELECT *, regexp_replace(rev, '^0+', '') AS bare FROM k)
SELECT user_id, event_id, name, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(len(bare), -1), coalesce(bare, ''), coalesce(rev, ''), name, event_id) AS pos FROM b""")
def revision_order(spark, d):
    e = s.table(spark, d, "events")
    name = F.concat(F.lit("stack_"), F.when(F.col("event_id") % 3 == 0, "00").otherwise(""), (F.col("event_id") % 120).cast("string"), F.lit(".fit"))
    f = e.select("user_id", "event_id", name.alias("name")).withColumn("key", folder.revision_key(folder.revision(F.col("name"))))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("key", "name", "event_id"))
    return f.select("user_id", "event_id", "name", n.cast("long").alias("pos"))


@query(f"""WITH {FILES}, k AS (SELECT session, event_id, name, array_to_string(list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(regexp_replace(p, '^0+([0-9])', '\\1'), 20, '0') ELSE p END), '') AS key FROM files)
SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY key, name) AS pos FROM k""")
def natural_order(spark, d):
    n = F.row_number().over(Window.partitionBy("session").orderBy(folder.natural_key(F.col("name")), "name"))
    return s.files(spark, d).select("session", "name", n.cast("long").alias("pos"))


@query(f"""WITH {FILES} SELECT DISTINCT name FROM files WHERE size < 5 EXCEPT SELECT name FROM files WHERE size > 2""")
def absent_names(spark, d):
    f = s.files(spark, d)
    return f.where("size < 5").select("name").subtract(f.where("size > 2").select("name"))


@query(f"""WITH {FILES} SELECT name, session FROM files f WHERE NOT EXISTS (SELECT 1 FROM files b WHERE b.name = f.name AND b.mtime < TIMESTAMP '2024-01-10')""")
def baseline_anti(spark, d):
    f = s.files(spark, d)
    return f.join(f.where("mtime < timestamp_ntz '2024-01-10 00:00:00'").select("name"), "name", "left_anti").select("name", "session")


@query(f"""WITH {FILES} SELECT session, arg_max(name, (mtime, name)) AS name, max(mtime) AS mtime FROM files WHERE size >= 4 GROUP BY session""")
def newest_valid(spark, d):
    return folder.newest_valid(s.files(spark, d), ["session"], "mtime", F.col("size") >= 4, ["name", "mtime"])


@query(f"""WITH {FILES} SELECT name FROM files WHERE name LIKE 'Light\\_1%\\_%7.fit' ESCAPE '\\'""")
def glob_filter(spark, d):
    return s.files(spark, d).where(folder.glob(F.col("name"), "Light_1*_*7.fit")).select("name")


@query("""WITH f AS (SELECT event_id, 'Light_M' || (user_id % 110) || '_' || (event_id % 30) || '.0s_LP_' || strftime(ts, '%Y%m%d-%H%M%S') || '.fit' AS name FROM events)
SELECT event_id, try_cast(regexp_extract(name, '_([0-9.]+)s_', 1) AS DOUBLE) AS exposure, nullif(regexp_extract(name, '([0-9]{8}-[0-9]{6})', 1), '') AS captured, split_part(name, '_', 2) AS target FROM f""")
def filename_tokens(spark, d):
    e = s.table(spark, d, "events")
    name = F.concat(F.lit("Light_M"), F.col("user_id") % 110, F.lit("_"), F.col("event_id") % 30, F.lit(".0s_LP_"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".fit"))
    t = F.split(name, "_")
    seconds = F.try_element_at(F.filter(t, lambda x: x.rlike("^[0-9.]+s$")), F.lit(1))
    captured = F.nullif(F.regexp_extract(name, "([0-9]{8}-[0-9]{6})", 1), F.lit(""))
    return e.select("event_id", F.rtrim(seconds, F.lit("s")).try_cast("double").alias("exposure"), captured.alias("captured"), t[1].alias("target"))


@query("""SELECT doc_id, sha256((strlen(coalesce(text, '')))::VARCHAR || coalesce(text, '')) AS digest FROM documents""")
def content_digest(spark, d):
    t = s.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return t.select("doc_id", config.content_digest(F.octet_length("t"), F.col("t")).alias("digest"))


@query("""WITH l AS (SELECT user_id AS doc, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN '[' || event_type || ']' WHEN event_id % 9 = 0 THEN '; note' ELSE 'key' || (event_id % 5) || ' = ' || props END AS line FROM events),
s AS (SELECT *, last_value(nullif(regexp_extract(line, '^\\s*\\[([^\\]]+)\\]\\s*$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS section FROM l)
SELECT doc, coalesce(section, '') AS section, trim(regexp_extract(line, '^([^=]*)=', 1)) AS key, trim(regexp_extract(line, '=(.*)$', 1)) AS value FROM s WHERE line NOT LIKE '[%' AND line NOT LIKE ';%' AND line LIKE '%=%'""")
def ini_section(spark, d):
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.concat(F.lit("["), "event_type", F.lit("]"))).when(k % 9 == 0, "; note").otherwise(F.concat(F.lit("key"), k % 5, F.lit(" = "), "props"))
    lines = s.table(spark, d, "events").select(F.col("user_id").alias("doc"), k.alias("pos"), line.alias("line"))
    return config.ini_values(lines, "doc", "pos", "line")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 10 < 3 THEN substr(props, 1, 1 + event_id % 5) ELSE props END AS t FROM events)
SELECT event_id, CASE WHEN json_valid(t) THEN try_cast(json_extract_string(t, '$.k') AS BIGINT) END AS k, NOT json_valid(t) AS malformed FROM t""")
def json_props(spark, d):
    """Three in ten texts are cut off."""
    text = F.when(F.col("event_id") % 10 < 3, F.substring("props", F.lit(1), (1 + F.col("event_id") % 5).cast("int"))).otherwise(F.col("props"))
    v = F.try_parse_json(text)
    return s.table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), v.isNull().alias("malformed"))


@query("""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (SELECT doc_id AS doc, pos, CASE pos // 2 % 5 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '1. ' WHEN 3 THEN '> ' ELSE '' END || t AS line FROM r),
k AS (SELECT *, trim(line) AS tr FROM l), kd AS (SELECT *, CASE WHEN tr = '' THEN 'blank' WHEN regexp_matches(tr, '^#{1,6} ') THEN 'heading' WHEN tr = '---' THEN 'rule' WHEN starts_with(tr, '>') THEN 'quote'
  WHEN regexp_matches(tr, '^[-*] ') THEN 'bullets' WHEN regexp_matches(tr, '^[0-9]+\\. ') THEN 'numbers' WHEN starts_with(tr, '|') THEN 'table' ELSE 'paragraph' END AS kind FROM k),
b AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc ORDER BY pos) OR kind IN ('heading', 'rule') THEN 1 ELSE 0 END AS fresh FROM kd),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY pos) AS blk FROM b),
t AS (SELECT doc, blk, kind, pos, CASE kind WHEN 'heading' THEN trim(regexp_replace(tr, '^#{1,6} +', '')) WHEN 'quote' THEN trim(regexp_replace(tr, '^>', '')) WHEN 'bullets' THEN trim(regexp_replace(tr, '^[-*] +', ''))
  WHEN 'numbers' THEN trim(regexp_replace(tr, '^[0-9]+\\. +', '')) WHEN 'rule' THEN '' ELSE tr END AS txt FROM c WHERE kind <> 'blank'),
g AS (SELECT doc, blk, kind, count(*) AS n_lines, CASE WHEN kind = 'paragraph' THEN string_agg(txt, ' ' ORDER BY pos) ELSE string_agg(txt, '@' ORDER BY pos) END AS text FROM t GROUP BY doc, blk, kind)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY blk) AS block, kind, CASE WHEN kind = 'heading' THEN 1 ELSE 0 END AS level, sha256(text) AS text_sha256, n_lines FROM g""")
def md_blocks(spark, d):
    r = s.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "t"))
    mark = F.element_at(F.array(*map(F.lit, ("# ", "- ", "1. ", "> ", ""))), (F.expr("pos div 2 % 5") + 1).cast("int"))
    out = markdown.blocks(r.select("doc", "pos", F.concat(mark, "t").alias("line")), "doc", "pos", "line")
    joined = F.when(F.col("kind") == "paragraph", F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("@")))
    return out.select("doc", "block", "kind", "level", F.sha2(joined, 256).alias("text_sha256"), "n_lines")


@query(f"""WITH {FILES} SELECT name, size >= 2 + event_id % 5 AS complete FROM files""")
def completeness(spark, d):
    return s.files(spark, d).select("name", folder.complete(F.col("size"), F.lit(2), F.col("event_id") % 5).alias("complete"))


@query("""WITH f AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '.hidden.fit' WHEN 1 THEN 'light.TMP' WHEN 2 THEN 'LIGHT_1.FITS' WHEN 3 THEN 'light.txt' WHEN 4 THEN 'dark_2.fit' ELSE 'light_3.png' END AS name FROM events)
SELECT event_id, name FROM f WHERE NOT starts_with(name, '.') AND NOT lower(name) LIKE '%.tmp' AND starts_with(lower(name), 'light') AND regexp_extract(lower(name), '\\.([a-z]+)$', 1) IN ('fit', 'fits', 'fts', 'png', 'jpg', 'jpeg', 'tif', 'tiff')""")
def tracked_files(spark, d):
    names = F.array(*map(F.lit, (".hidden.fit", "light.TMP", "LIGHT_1.FITS", "light.txt", "dark_2.fit", "light_3.png")))
    f = s.table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("name"))
    return f.where(folder.tracked(F.col("name"), "Light"))
