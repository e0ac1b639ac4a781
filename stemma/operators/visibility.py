"""Who may see what: predicates as semi and anti joins, never row-wise lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entity types that are visible to everyone.
PUBLIC_TYPES = ["place", "organisation", "estate", "historical_event", "coat_of_arms", "lineage", "source", "repository"]


def visible_persons(person: DataFrame) -> DataFrame:
    """Persons known not to live, neither private nor staged. Unknown life status hides."""
    return person.where("living = false AND NOT coalesce(private, false) AND NOT coalesce(staged, false)")


def visible_families(family_ids: DataFrame, member: DataFrame, person: DataFrame) -> DataFrame:
    """Families without a hidden member; an empty family is visible."""
    hidden = member.join(visible_persons(person).select(F.col("id").alias("person_id")), "person_id", "left_anti")
    return family_ids.join(hidden.select("family_id").distinct(), "family_id", "left_anti")


def visible_media(media: DataFrame, depiction: DataFrame, person: DataFrame, signed_in: bool = False) -> DataFrame:
    """Media that may be published and are ready, and depict no hidden person (signed in: no private one)."""
    if signed_in:
        hidden = person.where("coalesce(private, false)").select(F.col("id").alias("object_id"))
        bad = depiction.where("object_type = 'person'").join(hidden, "object_id", "left_semi")
    else:
        bad = depiction.where("object_type = 'person'").join(visible_persons(person).select(F.col("id").alias("object_id")), "object_id", "left_anti")
    ready = media.where("coalesce(may_publish, false) AND status = 'klar'")
    return ready.join(bad.select(F.col("media_id").alias("id")).distinct(), "id", "left_anti")


def visible_entities(refs: DataFrame, visible: dict[str, DataFrame], type_col: str = "type", id_col: str = "id") -> DataFrame:
    """Rows of refs whose entity may be seen. visible: type -> frame with the visible ids; public types pass, unknown types don't."""
    keys = None
    for kind, ids in visible.items():
        part = ids.select(F.lit(kind).alias(type_col), F.col("id").alias(id_col))
        keys = part if keys is None else keys.unionByName(part)
    open_ = refs.where(F.col(type_col).isin(PUBLIC_TYPES))
    rest = refs.where(~F.col(type_col).isin(PUBLIC_TYPES))
    return open_ if keys is None else open_.unionByName(rest.join(keys.distinct(), [type_col, id_col], "left_semi"))


def visible_evidence(fact: DataFrame, claim: DataFrame, citation: DataFrame, visible: dict[str, DataFrame]) -> DataFrame:
    """Citations of claims about facts whose subject may be seen, by its type: id, claim_id, fact_id. fact: id, subject_type, subject_id; visible as in ``visible_entities``."""
    facts = visible_entities(fact, visible, "subject_type", "subject_id")
    claims = claim.where("target_type = 'fact'").join(facts.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return citation.join(claims.select(F.col("id").alias("claim_id"), F.col("target_id").alias("fact_id")), "claim_id").select("id", "claim_id", "fact_id")


def visible_relations(relation: DataFrame, visible: dict[str, DataFrame]) -> DataFrame:
    """Relations of which both ends may be seen, each by its own type; a null type hides. relation: subject_type, subject_id, object_type, object_id; visible as in ``visible_entities``."""
    seen = visible_entities(relation, visible, "subject_type", "subject_id")
    return visible_entities(seen, visible, "object_type", "object_id").select(*relation.columns)


def visible_mentions(mention: DataFrame, visible_media_ids: DataFrame) -> DataFrame:
    """Mentions whose target is no medium, or a visible one."""
    media = mention.where("type = 'media'").join(visible_media_ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return mention.where("type <> 'media'").unionByName(media.select(*mention.columns))


def dead_links(mention: DataFrame, existing: dict[str, DataFrame]) -> DataFrame:
    """Mentions of entities that don't exist: one anti join against all typed keys. Types without a frame are ignored."""
    keys = None
    for kind, ids in existing.items():
        part = ids.select(F.lit(kind).alias("type"), F.col("id").alias("target_id"))
        keys = part if keys is None else keys.unionByName(part)
    return mention.where(F.col("type").isin(list(existing))).join(keys, ["type", "target_id"], "left_anti")


def surely_dead(person: DataFrame, year: int, limit: int = 120) -> DataFrame:
    """Persons who have died, or were born more than limit years ago."""
    return person.where(F.col("died").isNotNull() | (F.lit(year) - F.col("born") > limit))


def without_living(pairs: DataFrame, person: DataFrame, columns: list[str], year: int) -> DataFrame:
    """Rows none of whose named columns holds a person who may live; a null is no person."""
    alive = person.select("id", "born", "died").join(surely_dead(person, year).select("id"), "id", "left_anti").select("id")
    for c in columns:
        pairs = pairs.join(alive.withColumnRenamed("id", c), c, "left_anti")
    return pairs


def assert_no_living(report: DataFrame, living: DataFrame, text: str = "text") -> DataFrame:
    """The report, unchanged; a row that names the id of a living person fails the job that reads it."""
    ids = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\b(\d+)\b"), 1), lambda x: x.try_cast("long"))
    bad = report.select(F.col(text).alias("_text"), F.explode(ids).alias("id")).join(living.select("id"), "id", "left_semi").select("_text").distinct()
    rows = report.join(bad, F.col(text) == F.col("_text"), "left")
    checked = F.when(F.col("_text").isNotNull(), F.raise_error(F.lit("the report names a living person")).cast("string")).otherwise(F.col(text))
    return rows.withColumn(text, checked).select(*report.columns)


def visibility_level(person: DataFrame) -> DataFrame:
    """id, level: private before living before public."""
    level = F.when(F.coalesce("private", F.lit(False)), "privat").when(F.coalesce("living", F.lit(True)), "levende").otherwise("offentlig")
    return person.select("id", level.alias("level"))


# ---- policies of the tables that hang on entities; readers are visitors and members alike, editors see everything ----


def visible_narratives(narrative: DataFrame, visible: dict[str, DataFrame], editor: bool = False) -> DataFrame:
    """Narratives that are not private, of visible subjects. narrative: subject_type, subject_id, private; visible as in ``visible_entities``."""
    return narrative if editor else visible_entities(narrative.where(~F.coalesce("private", F.lit(False))), visible, "subject_type", "subject_id")


def visible_events(event: DataFrame, narratives: DataFrame, visible: dict[str, DataFrame], editor: bool = False) -> DataFrame:
    """Events that are not hidden, of visible subjects and visible narratives. event: subject_type, subject_id, narrative_id, feed_status; an unknown status hides."""
    if editor:
        return event
    seen = visible_entities(event.where("feed_status <> 'skjult'"), visible, "subject_type", "subject_id")
    return seen.join(narratives.select(F.col("id").alias("narrative_id")), "narrative_id", "left_semi").select(*event.columns)


def visible_targets(rows: DataFrame, facts: DataFrame, relations: DataFrame, editor: bool = False) -> DataFrame:
    """Claims or conclusions on visible facts and relations (their visible ids); any other target hides. rows: target_type, target_id."""
    if editor:
        return rows
    keys = facts.select(F.lit("fact").alias("target_type"), F.col("id").alias("target_id")).unionByName(relations.select(F.lit("relation").alias("target_type"), F.col("id").alias("target_id")))
    return rows.join(keys, ["target_type", "target_id"], "left_semi").select(*rows.columns)


def visible_notes(note: DataFrame, facts: DataFrame, relations: DataFrame, visible: dict[str, DataFrame], editor: bool = False) -> DataFrame:
    """Notes that are not private, on visible facts, relations or entities. note: target_type, target_id, private."""
    if editor:
        return note
    both = visible | {"fact": facts, "relation": relations}
    return visible_entities(note.where(~F.coalesce("private", F.lit(False))), both, "target_type", "target_id")


def visible_stories(story: DataFrame, visible: dict[str, DataFrame], editor: bool = False) -> DataFrame:
    """Published stories that are not private, of visible subjects. story: status, private, subject_type, subject_id."""
    return story if editor else visible_entities(story.where("status = 'publiceret' AND NOT coalesce(private, false)"), visible, "subject_type", "subject_id")


def media_of_objects(path: DataFrame, media: DataFrame, variant: DataFrame) -> DataFrame:
    """path, media_id: the medium that a stored object belongs to, by its own path first, then by that of a variant; null if to none."""
    own = media.groupBy("path").agg(F.min("id").alias("_own"))
    part = variant.groupBy("path").agg(F.min("media_id").alias("_part"))
    return path.join(own, "path", "left").join(part, "path", "left").select("path", F.coalesce("_own", "_part").alias("media_id"))


def app_persons(person: DataFrame, text: DataFrame, with_private: bool = False) -> DataFrame:
    """id, name, sex, text of the persons an application shows: no private ones unless asked for, defaults in place of nulls. text: person_id, text (one row each)."""
    rows = person if with_private else person.where(~F.coalesce("private", F.lit(False)))
    return rows.join(text.select(F.col("person_id").alias("id"), "text"), "id", "left").select("id", F.coalesce("name", F.lit("Ukendt")).alias("name"), F.coalesce("sex", F.lit("ukendt")).alias("sex"), F.coalesce("text", F.lit("")).alias("text"))
