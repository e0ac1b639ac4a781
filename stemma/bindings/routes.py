"""Lines and ways through the tree of persons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import routes as A

from .tables import role, sql


def _tree(spark, d):
    return role(spark, d, "person").selectExpr("id", "CASE WHEN id > 3 THEN CAST((id - id % 4) / 4 AS BIGINT) END AS parent_id", "id * 7 % 5 AS ord")


def snap_paths(spark, d):
    return A.snap_paths(_tree(spark, d)).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


def routes(spark, d):
    pairs = role(spark, d, "person").selectExpr("id AS focus", "CASE WHEN id % 10 = 0 THEN id WHEN id % 3 = 0 THEN (id - id % 16) / 16 + 4 ELSE id * 7 % 1000 + 1 END AS me").withColumn("me", F.col("me").cast("long"))
    legs = F.array_join(F.transform("route", lambda x: F.concat_ws(" ", x["step"], x["n"].cast("string"))), ", ")
    return A.routes(_tree(spark, d), pairs).select("focus", "me", "step", "remaining", legs.alias("route"))


QUERIES = {f.__name__: f for f in (snap_paths, routes)}

_LINES = """raw AS (SELECT person.id, known.id AS parent_id, person.id * 7 % 5 AS ord FROM person LEFT JOIN person known ON person.id > 3 AND known.id = (person.id - person.id % 4) / 4),
t AS (SELECT id, parent_id, CASE WHEN parent_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent_id ORDER BY ord, id) - 1 END AS place FROM raw),
p AS (SELECT id, [id] AS path, [place] AS places, parent_id AS at FROM t UNION ALL SELECT p.id, list_prepend(p.at, path), list_prepend(t.place, places), t.parent_id FROM p JOIN t ON t.id = p.at),
up AS (SELECT id, path, places FROM p WHERE p.at IS NULL),
q AS (SELECT id, CAST([] AS BIGINT[]) AS path, id AS last FROM t UNION ALL SELECT q.id, list_append(q.path, t.id), t.id FROM q JOIN t ON t.parent_id = q.last AND t.place = 0),
dn AS (SELECT id, arg_max(path, len(path)) AS path FROM q GROUP BY id),
snap AS (SELECT up.id, list_concat(up.path, dn.path) AS path, len(up.path) - 1 AS depth, list_concat(up.places, list_transform(dn.path, lambda x: 0)) AS places FROM up JOIN dn USING (id))"""

SQL = {
    "snap_paths": sql("person", f"{_LINES} SELECT id, array_to_string(path, '>') AS path, CAST(depth AS INT) AS depth FROM snap", True),
    # In a tree two lines from one root differ everywhere below their last common person, so equal places are counted.
    "routes": sql("person", f"""{_LINES},
ask AS (SELECT id AS focus, CAST(CASE WHEN id % 10 = 0 THEN id WHEN id % 3 = 0 THEN (id - id % 16) / 16 + 4 ELSE id * 7 % 1000 + 1 END AS BIGINT) AS me FROM person),
m AS (SELECT focus, me, s.path AS sp, s.places AS sl, s.depth, u.path AS mp, u.places AS ml, len(list_filter(range(1, least(len(s.path), len(u.path)) + 1), lambda i: s.path[i] = u.path[i])) AS same FROM ask LEFT JOIN snap s ON s.id = focus LEFT JOIN up u ON u.id = me),
w AS (SELECT *, CASE WHEN same = len(mp) THEN len(mp) - 1 WHEN same = len(sp) THEN len(sp) - 1 ELSE same END AS leave, CASE WHEN same IN (len(mp), len(sp)) THEN 0 ELSE ml[same + 1] - sl[same + 1] END AS aside FROM m WHERE same > 0),
v AS (SELECT *, leave - depth AS along, list_transform(range(leave + 2, len(mp) + 1), lambda i: ml[i]) AS turns FROM w),
r AS (SELECT focus, me, abs(along) + abs(aside) + len(turns) + coalesce(list_sum(turns), 0) AS remaining,
  list_filter(list_concat([CASE WHEN along < 0 THEN 'up ' || -along WHEN along > 0 THEN 'down ' || along END, CASE WHEN aside < 0 THEN 'left ' || -aside WHEN aside > 0 THEN 'right ' || aside END],
    flatten(list_transform(turns, lambda x: ['down 1', CASE WHEN x > 0 THEN 'right ' || x END]))), lambda x: x IS NOT NULL) AS legs FROM v)
SELECT ask.focus, ask.me, CASE WHEN remaining = 0 THEN 'arrived' ELSE split_part(legs[1], ' ', 1) END AS step, CAST(remaining AS BIGINT) AS remaining, array_to_string(legs, ', ') AS route FROM ask LEFT JOIN r USING (focus, me)""", True),
}
