"""Visibility queries on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions.text import mentions
from stemma.operators import visibility as V

from .tables import role, sql

_TYPE = "CASE ({n}) % 5 WHEN 0 THEN 'place' WHEN 1 THEN 'media' WHEN 2 THEN 'secret' ELSE 'person' END"

def _mention(spark, d):
    m = role(spark, d, "marked_text").select(F.col("id").alias("source_id"), F.explode(mentions(F.col("text"))).alias("m"))
    return m.select("source_id", F.col("m.type").alias("type"), F.col("m.id").alias("target_id"))


def visible_persons(spark, d):
    return V.visible_persons(role(spark, d, "person")).select("id", "name", "sex")


def visible_families(spark, d):
    member = role(spark, d, "member").withColumn("family_id", F.floor(F.col("person_id") / 3))
    ids = role(spark, d, "person").select(F.floor((F.col("id") + 1) / 2).alias("family_id")).distinct()
    return V.visible_families(ids, member, role(spark, d, "person"))


def visible_media(spark, d):
    return V.visible_media(role(spark, d, "media"), role(spark, d, "depiction"), role(spark, d, "person")).select("id", "path")


def visible_media_signed_in(spark, d):
    return V.visible_media(role(spark, d, "media"), role(spark, d, "depiction"), role(spark, d, "person"), signed_in=True).select("id", "path")


def visible_entities(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("person", "place", "media", "secret")]), (F.col("id") % 4 + 1).cast("int"))
    refs = role(spark, d, "relation").select(kind.alias("type"), F.col("object_id").alias("id"), F.col("id").alias("ref_id"))
    return V.visible_entities(refs, {"person": V.visible_persons(role(spark, d, "person")), "media": role(spark, d, "media").where("status = 'klar'")})


def _persons(spark, d):
    return {"person": V.visible_persons(role(spark, d, "person"))}


def person_relations(spark, d):
    """The relations as ties of persons to persons."""
    return role(spark, d, "relation").withColumns({"subject_type": F.lit("person"), "object_type": F.lit("person")})


def _entities(spark, d):
    return _persons(spark, d) | {"media": role(spark, d, "media").where("status = 'klar'")}


def visible_evidence(spark, d):
    return V.visible_evidence(*[role(spark, d, n) for n in ("fact", "claim", "citation")], _persons(spark, d))


def visible_relations(spark, d):
    return V.visible_relations(person_relations(spark, d), _persons(spark, d)).select("id", "subject_id", "object_id")


def typed_relations(spark, d):
    """Relations whose ends are persons, places, media or of a type that nobody knows."""
    r = role(spark, d, "relation").withColumns({"subject_type": F.expr(_TYPE.format(n="id")), "object_type": F.expr(_TYPE.format(n="id + subject_id"))})
    return V.visible_relations(r, _entities(spark, d)).select("id", "subject_type", "subject_id", "object_type", "object_id")


def typed_evidence(spark, d):
    """Citations on facts about persons, places, media or subjects of a type that nobody knows."""
    fact = role(spark, d, "fact").withColumn("subject_type", F.expr(_TYPE.format(n="subject_id + id")))
    return V.visible_evidence(fact, role(spark, d, "claim"), role(spark, d, "citation"), _entities(spark, d))


def mention_index(spark, d):
    return _mention(spark, d)


def visible_mentions(spark, d):
    media = V.visible_media(role(spark, d, "media"), role(spark, d, "depiction"), role(spark, d, "person"))
    return V.visible_mentions(_mention(spark, d), media)


def dead_links(spark, d):
    return V.dead_links(_mention(spark, d), {"person": role(spark, d, "person"), "media": role(spark, d, "media").where("id % 2 = 0")})


def surely_dead(spark, d):
    return V.surely_dead(role(spark, d, "person"), 1900).select("id", "born", "died")


def pairs_without_living(spark, d):
    return V.without_living(role(spark, d, "relation").select("id", "subject_id", "object_id"), role(spark, d, "person"), ["subject_id", "object_id"], 1900)


def visibility_level(spark, d):
    return V.visibility_level(role(spark, d, "person"))


QUERIES = {f.__name__: f for f in (visible_persons, visible_families, visible_media, visible_media_signed_in, visible_entities, visible_evidence, visible_relations, typed_relations, typed_evidence, mention_index, visible_mentions, dead_links, surely_dead, pairs_without_living, visibility_level)}

_SEEN = "seen AS (SELECT id FROM person WHERE living = false AND NOT coalesce(private, false) AND NOT coalesce(staged, false))"
_MENTION = r"""found AS (SELECT id, unnest(regexp_extract_all(text, '\[\[[a-zæøå_]+:\d+')) AS token FROM marked_text),
mention AS (SELECT DISTINCT id AS source_id, regexp_extract(token, '\[\[([a-zæøå_]+):', 1) AS type, CAST(regexp_extract(token, ':(\d+)', 1) AS BIGINT) AS target_id FROM found)"""
_MEDIA = f"""{_SEEN}, shown AS (SELECT id, path FROM media WHERE coalesce(may_publish, false) AND status = 'klar'
  AND id NOT IN (SELECT media_id FROM depiction WHERE object_id NOT IN (SELECT id FROM seen)))"""
_ALIVE = "alive AS (SELECT id FROM person WHERE NOT (died IS NOT NULL OR 1900 - born > 120))"
_OPEN = "open_ AS (SELECT 'person' AS type, id FROM seen UNION ALL SELECT 'media', id FROM media WHERE status = 'klar')"

SQL = {
    "visible_persons": sql("person", f"{_SEEN} SELECT id, name, sex FROM person SEMI JOIN seen USING (id)"),
    "visible_families": sql("person member", f"""{_SEEN}
SELECT DISTINCT CAST(floor((id + 1) / 2) AS BIGINT) AS family_id FROM person WHERE floor((id + 1) / 2) NOT IN (SELECT floor(person_id / 3) FROM member WHERE person_id NOT IN (SELECT id FROM seen))"""),
    "visible_media": sql("person media depiction", f"{_MEDIA} SELECT * FROM shown"),
    "visible_media_signed_in": sql("person media depiction", """SELECT id, path FROM media WHERE coalesce(may_publish, false) AND status = 'klar'
  AND id NOT IN (SELECT media_id FROM depiction JOIN person ON person.id = object_id WHERE coalesce(private, false))"""),
    "visible_entities": sql("person media relation", f"""{_SEEN}, refs AS (SELECT CASE id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'place' WHEN 2 THEN 'media' ELSE 'secret' END AS type, object_id AS id, id AS ref_id FROM relation)
SELECT * FROM refs WHERE type = 'place' OR type = 'person' AND id IN (SELECT id FROM seen) OR type = 'media' AND id IN (SELECT id FROM media WHERE status = 'klar')"""),
    "visible_evidence": sql("person fact claim citation", f"""{_SEEN} SELECT c.id, c.claim_id, f.id AS fact_id FROM citation c JOIN claim a ON a.id = c.claim_id JOIN fact f ON f.id = a.target_id WHERE f.subject_id IN (SELECT id FROM seen)"""),
    "typed_relations": sql("person media relation", f"""{_SEEN}, {_OPEN}, r AS (SELECT *, {_TYPE.format(n="id")} AS subject_type, {_TYPE.format(n="id + subject_id")} AS object_type FROM relation)
SELECT r.id, subject_type, subject_id, object_type, object_id FROM r WHERE (subject_type = 'place' OR (subject_type, subject_id) IN (SELECT (type, id) FROM open_)) AND (object_type = 'place' OR (object_type, object_id) IN (SELECT (type, id) FROM open_))"""),
    "typed_evidence": sql("person media fact claim citation", f"""{_SEEN}, {_OPEN}, f AS (SELECT id, subject_id, {_TYPE.format(n="subject_id + id")} AS subject_type FROM fact)
SELECT c.id, c.claim_id, f.id AS fact_id FROM citation c JOIN claim a ON a.id = c.claim_id JOIN f ON f.id = a.target_id WHERE subject_type = 'place' OR (subject_type, subject_id) IN (SELECT (type, id) FROM open_)"""),
    "visible_relations": sql("person relation", f"{_SEEN} SELECT id, subject_id, object_id FROM relation WHERE subject_id IN (SELECT id FROM seen) AND object_id IN (SELECT id FROM seen)"),
    "mention_index": sql("marked_text", f"{_MENTION} SELECT * FROM mention"),
    "visible_mentions": sql("marked_text person media depiction", f"{_MENTION}, {_MEDIA} SELECT * FROM mention WHERE type <> 'media' OR target_id IN (SELECT id FROM shown)"),
    "dead_links": sql("marked_text person media", f"""{_MENTION} SELECT * FROM mention WHERE type = 'person' AND target_id NOT IN (SELECT id FROM person) OR type = 'media' AND target_id NOT IN (SELECT id FROM media WHERE id % 2 = 0)"""),
    "surely_dead": sql("person", "SELECT id, born, died FROM person WHERE died IS NOT NULL OR 1900 - born > 120"),
    "pairs_without_living": sql("person relation", f"{_ALIVE} SELECT id, subject_id, object_id FROM relation WHERE subject_id NOT IN (SELECT id FROM alive) AND object_id NOT IN (SELECT id FROM alive)"),
    "visibility_level": sql("person", "SELECT id, CASE WHEN coalesce(private, false) THEN 'privat' WHEN coalesce(living, true) THEN 'levende' ELSE 'offentlig' END AS level FROM person"),
}
