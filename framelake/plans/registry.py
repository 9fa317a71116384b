"""Queries register here with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The frames, masks and snapshots that play their parts on the driver's tables.
PX = """px AS (
  SELECT vec_id AS frame, label AS session, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) + 0.5 AS v,
         CASE WHEN (vec_id * 7 + i // 8 + i % 8) % 11 = 0 THEN 0 ELSE 1 END AS m
  FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS i FROM embeddings))"""
FRAMES = f"""{PX}, frames AS (
  SELECT frame, any_value(session) AS session, 15 + frame % 45 AS stars, stddev_pop(v) AS sigma FROM px GROUP BY frame)"""
RGB = f"""{PX}, rgb AS (
  SELECT frame // 3 AS image, frame % 3 AS c, y, x, v FROM px
  WHERE frame // 3 IN (SELECT frame // 3 FROM px GROUP BY frame // 3 HAVING count(DISTINCT frame) = 3))"""
MASTERS = f"""{PX}, dark AS (SELECT y, x, avg(v) AS d FROM px WHERE session = 0 GROUP BY y, x),
  flat AS (SELECT y, x, avg(v) AS f FROM px WHERE session = 1 GROUP BY y, x)"""
STARS = f"""{PX}, stars AS (
  SELECT frame, session, rank - 1 AS star, x * 16.0::DOUBLE AS sx, y * 16.0::DOUBLE AS sy, v AS flux
  FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v DESC, y, x) AS rank FROM px) WHERE rank <= 20)"""
SNAP = "snap AS (SELECT user_id AS session, ts, event_id, event_type, value AS median FROM events)"
FILES = """files AS (
  SELECT 'Light_' || user_id || '_' || event_id || '.fit' AS name, user_id AS session, event_id, ts AS mtime, event_id % 7 AS size FROM events)"""
