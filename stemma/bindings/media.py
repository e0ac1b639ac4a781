"""Media, change-log and state queries on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import media as M

from .tables import role, sql


def duplicate_media(spark, d):
    return M.duplicate_media(role(spark, d, "media"), ["byte_size", "width", "height"])


def media_queues(spark, d):
    return M.media_queues(role(spark, d, "media").withColumn("sha", F.when(F.col("id") % 13 != 0, F.col("sha"))), role(spark, d, "depiction"))


def _stored(spark, d):
    m = role(spark, d, "media")
    objects = m.where("id % 6 <> 1").select(F.concat("path", F.when(F.col("id") % 12 == 0, "x").otherwise("")).alias("path"), "age_days")
    variants = m.where("id % 4 <> 2").select(F.concat("path", F.lit("/t")).alias("path"), F.col("id").alias("media_id"), F.lit("thumb").alias("tier"))
    return objects, variants


def orphan_objects(spark, d):
    objects, variants = _stored(spark, d)
    return M.orphan_objects(objects, role(spark, d, "media").select("path"), 3)


def media_janitor(spark, d):
    objects, variants = _stored(spark, d)
    return M.janitor_report(objects, role(spark, d, "media"), variants, ["thumb", "medium"])


def sha_backfill(spark, d):
    m = role(spark, d, "media")
    part = m.withColumn("sha", F.when(F.col("id") % 3 != 0, F.col("sha")))
    return M.sha_backfill(part, m.where("id % 2 = 0").select("id", F.col("sha").alias("new_sha")))


def portraits(spark, d):
    return M.portraits(role(spark, d, "depiction").withColumn("object_id", F.col("object_id") % 100))


def delete_preview(spark, d):
    return M.delete_preview(*[role(spark, d, n) for n in ("person", "fact", "claim", "relation", "member")])


def log_changes(spark, d):
    p = role(spark, d, "person").select("id", "name", "sex", "died")
    new = p.where("id % 9 <> 4").select("id", F.when(F.col("id") % 10 == 1, "ny").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 15 != 2, F.col("sex")).alias("sex"), "died")
    return M.log_changes(p.where("id % 8 <> 5"), new, "id", ["name", "sex", "died"])


def history(spark, d):
    return M.history(role(spark, d, "change"))


def current_state(spark, d):
    return M.current_state(role(spark, d, "change"))


def undo_change_sets(spark, d):
    c = role(spark, d, "change")
    return M.undo(c, c.where("set_id % 25 = 3"))


def conclusion_upsert(spark, d):
    k = role(spark, d, "conclusion").select("target_id", "chosen_id", "status")
    new = k.where("target_id % 6 = 0").select((F.col("target_id") + F.when(F.col("target_id") % 12 == 0, 1_000_000).otherwise(0)).alias("target_id"), "chosen_id", F.lit("forældet").alias("status"))
    return M.upsert(k, new, ["target_id"])


def conclusion_repoint(spark, d):
    return M.repoint(role(spark, d, "conclusion"), role(spark, d, "claim"), role(spark, d, "claim").where("(id % 10 <= 2 AND target_id % 3 = 0) OR target_id % 7 = 0"))


def not_same_pairs(spark, d):
    return M.ordered_pairs(role(spark, d, "relation").where("subject_id <> object_id").select("subject_id", "object_id"), "subject_id", "object_id")


def event_merge(spark, d):
    m = role(spark, d, "media").select(F.col("path").alias("key"), "id", "sha")
    old = m.where("id % 3 <> 0").select("key", F.when(F.col("id") % 2 == 0, "godkendt").otherwise("foreslået").alias("status"), F.col("sha").alias("text"))
    new = m.where("id % 5 <> 0").select("key", F.when(F.col("id") % 4 == 0, "ny").otherwise(F.col("sha")).alias("text"))
    return M.event_merge(old, new)


def allocated_ids(spark, d):
    new = role(spark, d, "person").select("name")
    return M.allocate_ids(role(spark, d, "person"), new, "id", ["name"])


QUERIES = {f.__name__: f for f in (duplicate_media, media_queues, orphan_objects, media_janitor, sha_backfill, portraits, delete_preview, log_changes, history, current_state, undo_change_sets, conclusion_upsert, conclusion_repoint, not_same_pairs, event_merge, allocated_ids)}

_STORED = """objects AS (SELECT path || CASE WHEN id % 12 = 0 THEN 'x' ELSE '' END AS path, age_days FROM media WHERE id % 6 <> 1),
variants AS (SELECT path || '/t' AS path, id AS media_id, 'thumb' AS tier FROM media WHERE id % 4 <> 2)"""
_HIST = """h AS (SELECT id, set_id, row_id, row_number() OVER w AS seq, op, lag(CASE WHEN op <> 'delete' THEN after_value END) OVER w AS before_value, CASE WHEN op <> 'delete' THEN after_value END AS after_value
  FROM change WINDOW w AS (PARTITION BY row_id ORDER BY made, id))"""

SQL = {
    "duplicate_media": sql("media", """g AS (SELECT byte_size, width, height, count(DISTINCT id) AS n, min(id) AS first_id FROM media WHERE status = 'klar' AND byte_size IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1)
SELECT id, n, first_id FROM media JOIN g USING (byte_size, width, height) WHERE status = 'klar'"""),
    "media_queues": sql("media depiction", """u AS (SELECT media_id, count(DISTINCT (object_type, object_id)) AS n FROM depiction GROUP BY media_id)
SELECT id, coalesce(n, 0) AS n_uses, concat_ws(',', CASE WHEN status <> 'klar' AND age_days > 7 THEN 'strandede' END, CASE WHEN status = 'klar' AND coalesce(n, 0) = 0 THEN 'ubrugte' END,
 CASE WHEN status = 'klar' AND NOT may_publish THEN 'mangler_rettigheder' END, CASE WHEN id % 13 = 0 THEN 'mangler_sha' END) AS queues FROM media LEFT JOIN u ON media_id = id"""),
    "orphan_objects": sql("media", f"{_STORED} SELECT * FROM objects WHERE age_days > 3 AND path NOT IN (SELECT path FROM media)"),
    "media_janitor": sql("media", f"""{_STORED}, r AS (SELECT 'forældreløs' AS category, path, CAST(NULL AS BIGINT) AS media_id FROM objects WHERE age_days > 3 AND path NOT IN (SELECT path FROM media UNION SELECT path FROM variants)
UNION ALL SELECT 'strandet', path, id FROM media WHERE status <> 'klar' AND age_days > 3 UNION ALL SELECT 'mangler fil', path, id FROM media WHERE status = 'klar' AND path NOT IN (SELECT path FROM objects)
UNION ALL SELECT 'mangler variant ' || t, '', id FROM media CROSS JOIN (VALUES ('thumb'), ('medium')) v(t) WHERE status = 'klar' AND (id, t) NOT IN (SELECT (media_id, tier) FROM variants))
SELECT *, row_number() OVER (PARTITION BY category ORDER BY media_id IS NULL, length(CAST(media_id AS VARCHAR)), CAST(media_id AS VARCHAR), path) AS place FROM r"""),
    "sha_backfill": sql("media", """p AS (SELECT id, CASE WHEN id % 3 <> 0 THEN sha END AS sha FROM media)
SELECT m.id, CASE WHEN p.sha IS NOT NULL THEN 'already_set' WHEN m.sha IN (SELECT sha FROM p WHERE sha IS NOT NULL) THEN 'duplicate' ELSE 'update' END AS action FROM media m JOIN p USING (id) WHERE m.id % 2 = 0"""),
    "portraits": sql("depiction", "SELECT object_id % 100 AS object_id, media_id, is_primary FROM depiction QUALIFY row_number() OVER (PARTITION BY object_id % 100 ORDER BY is_primary DESC, media_id) = 1"),
    "delete_preview": sql("person fact claim relation member", """f AS (SELECT subject_id AS id, count(*) AS n FROM fact GROUP BY ALL), c AS (SELECT subject_id AS id, count(*) AS n FROM fact JOIN claim ON target_id = fact.id GROUP BY ALL),
r AS (SELECT p AS id, count(DISTINCT id) AS n FROM (SELECT id, unnest([subject_id, object_id]) AS p FROM relation) GROUP BY p), m AS (SELECT person_id AS id, count(DISTINCT family_id) AS n, count(*) FILTER (role = 'partner') AS k FROM member GROUP BY ALL)
SELECT p.id, coalesce(f.n, 0) AS facts, coalesce(c.n, 0) AS claims, coalesce(r.n, 0) AS relations, coalesce(m.n, 0) AS families, concat_ws(',', CASE WHEN k > 0 THEN 'partner' END, CASE WHEN coalesce(living, true) THEN 'levende' END) AS blockers
FROM person p LEFT JOIN f ON f.id = p.id LEFT JOIN c ON c.id = p.id LEFT JOIN r ON r.id = p.id LEFT JOIN m ON m.id = p.id"""),
    "log_changes": sql("person", """o AS (SELECT id, name, sex, died, true AS h FROM person WHERE id % 8 <> 5), n AS (SELECT id, CASE WHEN id % 10 = 1 THEN 'ny' ELSE name END AS name, CASE WHEN id % 15 <> 2 THEN sex END AS sex, died, true AS h FROM person WHERE id % 9 <> 4),
x AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' ELSE 'update' END AS op,
 concat_ws(',', CASE WHEN o.name IS DISTINCT FROM n.name THEN 'name' END, CASE WHEN o.sex IS DISTINCT FROM n.sex THEN 'sex' END, CASE WHEN o.died IS DISTINCT FROM n.died THEN 'died' END) AS changed FROM o FULL JOIN n ON o.id = n.id)
SELECT * FROM x WHERE op <> 'update' OR changed <> ''"""),
    "history": sql("change", f"{_HIST} SELECT * FROM h"),
    "current_state": sql("change", "SELECT row_id, after_value AS value FROM (SELECT * FROM change QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY made DESC, id DESC) = 1) WHERE op <> 'delete'"),
    "undo_change_sets": sql("change", f"""{_HIST}, s AS (SELECT set_id, row_id, arg_min_null(before_value, seq) AS restored, max(seq) AS last FROM h WHERE set_id % 25 = 3 GROUP BY ALL), n AS (SELECT row_id, max(seq) AS newest FROM h GROUP BY row_id)
SELECT set_id, row_id, CASE WHEN newest > last THEN 'konflikt' ELSE 'fortrudt' END AS status, restored FROM s JOIN n USING (row_id)"""),
    "conclusion_upsert": sql("conclusion", """n AS (SELECT target_id + CASE WHEN target_id % 12 = 0 THEN 1000000 ELSE 0 END AS target_id, chosen_id, 'forældet' AS status FROM conclusion WHERE target_id % 6 = 0)
SELECT target_id, chosen_id, status FROM conclusion WHERE target_id NOT IN (SELECT target_id FROM n) UNION ALL SELECT * FROM n"""),
    "conclusion_repoint": sql("conclusion claim", """g AS (SELECT id FROM claim WHERE (id % 10 <= 2 AND target_id % 3 = 0) OR target_id % 7 = 0), l AS (SELECT target_id, min(id) AS nxt FROM claim WHERE id NOT IN (SELECT id FROM g) GROUP BY target_id)
SELECT k.target_id, CASE WHEN g.id IS NULL THEN chosen_id ELSE nxt END AS chosen_id, CASE WHEN g.id IS NULL THEN 'uændret' WHEN nxt IS NULL THEN 'slettet' ELSE 'flyttet' END AS action FROM conclusion k LEFT JOIN g ON g.id = chosen_id LEFT JOIN l ON l.target_id = k.target_id"""),
    "not_same_pairs": sql("relation", "SELECT DISTINCT least(subject_id, object_id) AS subject_id, greatest(subject_id, object_id) AS object_id FROM relation WHERE subject_id <> object_id"),
    "event_merge": sql("media", """o AS (SELECT path AS key, CASE WHEN id % 2 = 0 THEN 'godkendt' ELSE 'foreslået' END AS s, sha AS t FROM media WHERE id % 3 <> 0), n AS (SELECT path AS key, CASE WHEN id % 4 = 0 THEN 'ny' ELSE sha END AS p FROM media WHERE id % 5 <> 0)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN s IS NULL THEN 'ny' WHEN p IS NULL AND s <> 'foreslået' THEN 'behold' WHEN p IS NULL THEN 'slet' WHEN p = t THEN 'uændret' ELSE 'opdater' END AS action, coalesce(s, 'foreslået') AS status, coalesce(p, t) AS text FROM o FULL JOIN n ON o.key = n.key"""),
    "allocated_ids": sql("person", "SELECT name, (SELECT max(id) FROM person) + row_number() OVER (ORDER BY name) AS id FROM person"),
}
