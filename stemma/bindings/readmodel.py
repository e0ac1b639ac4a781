"""Policies, read models, reports and checks on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import display as D
from stemma.functions import text as T
from stemma.operators import family as A
from stemma.operators import feed as K
from stemma.operators import linkage as L
from stemma.operators import readmodel as Q
from stemma.operators import visibility as V

from stemma.operators.evidence import correct_fields as corrections
from stemma.plans.stages import materialise

from . import evidence as E
from .tables import read, role, sql
from .visibility import person_relations


def _visible(spark, d):
    return {"person": V.visible_persons(role(spark, d, "person"))}


def _narrative(spark, d):
    kind = F.when(F.col("id") % 5 == 0, "estate").when(F.col("id") % 7 == 0, "secret").otherwise("person")
    return role(spark, d, "narrative").select("id", kind.alias("subject_type"), F.col("person_id").alias("subject_id"), F.when(F.col("id") % 4 != 0, F.col("id") % 3 == 0).alias("private"), F.char_length("text").alias("n"))


def _facts(spark, d):
    return V.visible_entities(role(spark, d, "fact"), _visible(spark, d), "subject_type", "subject_id")


def visible_narratives(spark, d):
    return V.visible_narratives(_narrative(spark, d), _visible(spark, d))


def visible_events(spark, d):
    events = role(spark, d, "fact").select("id", "subject_type", "subject_id", (F.col("id") % 900).alias("narrative_id"), F.when(F.col("id") % 9 == 0, "skjult").when(F.col("id") % 10 != 0, "godkendt").alias("feed_status"))
    return V.visible_events(events, visible_narratives(spark, d), _visible(spark, d))


def visible_conclusions(spark, d):
    rows = role(spark, d, "conclusion").withColumn("target_type", F.element_at(F.array(F.lit("fact"), F.lit("relation"), F.lit("note")), (F.col("target_id") % 3 + 1).cast("int")))
    return V.visible_targets(rows, _facts(spark, d), V.visible_relations(person_relations(spark, d), {"person": V.visible_persons(role(spark, d, "person"))}))


def visible_notes(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fact", "relation", "person", "place", "secret")]), (F.col("id") % 5 + 1).cast("int"))
    note = role(spark, d, "relation").select("id", kind.alias("target_type"), F.when(F.col("id") % 5 == 2, F.col("subject_id")).otherwise(F.col("id")).alias("target_id"), F.when(F.col("id") % 11 == 0, True).alias("private"))
    return V.visible_notes(note, _facts(spark, d), V.visible_relations(person_relations(spark, d), {"person": V.visible_persons(role(spark, d, "person"))}), _visible(spark, d))


def visible_stories(spark, d):
    story = role(spark, d, "fact").select("id", "subject_type", "subject_id", F.when(F.col("id") % 2 == 0, "publiceret").otherwise("kladde").alias("status"), (F.col("id") % 13 == 0).alias("private"))
    return V.visible_stories(story, _visible(spark, d))


def media_of_objects(spark, d):
    m = role(spark, d, "media")
    paths = m.select(F.when(F.col("id") % 3 == 0, F.concat("path", F.lit("/t"))).when(F.col("id") % 5 == 0, "væk").otherwise(F.col("path")).alias("path")).distinct()
    return V.media_of_objects(paths, m, m.where("id % 2 = 0").select(F.concat("path", F.lit("/t")).alias("path"), F.col("id").alias("media_id")))


def app_persons(spark, d):
    text = role(spark, d, "narrative").groupBy("person_id").agg(F.min("text").alias("text"))
    return V.app_persons(role(spark, d, "person"), text)


def _aliases(spark, d):
    return role(spark, d, "person").where("id % 6 = 1").select("id", (F.col("id") - 1).alias("canonical"))


def canonical_relations(spark, d):
    return Q.canonical_ids(role(spark, d, "relation").select("id", "subject_id", "object_id"), _aliases(spark, d), ["subject_id", "object_id"])


def lineage_descendants(spark, d):
    return Q.lineage_descendants(role(spark, d, "lineage"), role(spark, d, "lineage").where("id BETWEEN 20 AND 39"))


def would_cycle(spark, d):
    return Q.would_cycle(role(spark, d, "lineage"), role(spark, d, "lineage").select("id", F.when(F.col("id") % 3 == 0, F.col("id") * 2).when(F.col("id") % 3 == 1, F.col("id")).otherwise(F.floor(F.col("id") / 4) + 1).alias("parent_id")))


def surname_root(spark, d):
    return Q.surname_root(role(spark, d, "lineage").withColumn("parent_id", F.when(F.col("id") % 4 != 1, F.col("parent_id"))))


def line_markings(spark, d):
    return Q.line_markings(role(spark, d, "fact").select(F.col("subject_id").alias("id"), F.col("id").alias("ord"), F.col("kind").alias("value")), _aliases(spark, d))


def latest_intro(spark, d):
    return Q.latest_intro(role(spark, d, "narrative").select(F.col("person_id").alias("lineage_id"), "id", F.when(F.col("id") % 2 == 0, "intro").otherwise("andet").alias("kind"), "text"))


def family_rows(spark, d):
    rows = Q.family_rows(role(spark, d, "member").withColumn("family_id", F.floor(F.col("person_id") / 7)), role(spark, d, "person"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("person_id", "family_id", "role", text("partners"), text("children"))


def nudged_children(spark, d):
    rows = role(spark, d, "member").select(F.floor(F.col("person_id") / 7).alias("family_id"), F.col("person_id").alias("id"), (F.col("person_id") % 7).cast("int").alias("place"), F.when(F.col("person_id") % 3 != 0, F.col("ordinal")).alias("ordinal"))
    return Q.nudged(rows)


def sex_composition(spark, d):
    return Q.sex_composition(role(spark, d, "person"), "line")


def founders(spark, d):
    people, edges = role(spark, d, "person"), role(spark, d, "parent_child")
    children = edges.groupBy(F.col("father").alias("id")).agg(F.count("*").alias("n_children"))
    return Q.founders(people.where("id % 100 = 3").select("id", (-F.col("id")).alias("ord")), children, V.surely_dead(people, 1900), 25)


def geo_points(spark, d):
    fact = role(spark, d, "fact").select(F.col("subject_id").alias("person_id"), F.element_at(F.array(*[F.lit(x) for x in ("Fødsel", "død", "dåb", "titel")]), (F.col("id") % 4 + 1).cast("int")).alias("kind"), (F.col("id") % 120).alias("place_id"))
    wedding = role(spark, d, "parent_child").select(F.col("child").alias("family_id"), F.col("father").alias("p1"), F.when(F.col("child") % 5 != 0, F.col("mother")).alias("p2"), F.when(F.col("child") % 2 == 0, 1850).alias("year"), (F.col("child") % 90).alias("place_id"))
    estate = role(spark, d, "place").select((F.col("id") + 500).alias("id"), F.col("id").alias("place_id"))
    return Q.geo_points(estate, fact, wedding, role(spark, d, "place"), V.visible_persons(role(spark, d, "person")))


def busiest_estate(spark, d):
    return Q.busiest(role(spark, d, "relation").where("role = 'ejer'").groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("n")))


def row_counts(spark, d):
    return Q.row_counts({n: role(spark, d, n) for n in ("person", "fact", "claim", "relation", "narrative", "media")})


def _queue(spark, d):
    return role(spark, d, "relation").select(F.col("subject_id").alias("a_id"), F.col("object_id").alias("b_id"), F.when(F.col("id") % 3 == 0, "bekræft").when(F.col("id") % 3 == 1, " ").alias("decision"), F.when(F.col("id") % 4 == 0, "bekræftet").alias("status"), F.when(F.col("id") % 5 != 0, F.col("id") % 4).alias("support"), F.col("role").alias("detail"))


def review_progress(spark, d):
    return Q.review_progress(_queue(spark, d))


def family_status(spark, d):
    return Q.family_status(_queue(spark, d))


def one_to_one(spark, d):
    p = role(spark, d, "person").select(F.col("id").alias("key"))
    return Q.one_to_one(p.where("key % 3 <> 0").unionByName(p.where("key % 10 = 0")), p.where("key % 4 <> 0"), "key")


def annotated_queue(spark, d):
    notes = role(spark, d, "person").where("id % 2 = 0").select(F.col("id").alias("a_id"), "name", "born")
    return Q.annotated(_queue(spark, d).select("a_id", "b_id", "detail").distinct(), notes, ["a_id"], {"name": "", "born": 0})


def stratified_sample(spark, d):
    return Q.stratified_sample(role(spark, d, "person").select("id", "line"), "line", "id", 5, 7)


def _tier(spark, d, m):
    r = role(spark, d, "relation").select(F.col("subject_id").alias("a_id"), F.col("object_id").alias("b_id")).distinct()
    key = (F.col("a_id") * 3 + F.col("b_id")) % m
    return r.select("a_id", "b_id", F.element_at(F.array(*[F.lit(x) for x in ("auto", "review", "none")]), (key % 3 + 1).cast("int")).alias("tier"), key.alias("k")).where("k > 0").drop("k")


def tier_changes(spark, d):
    return Q.tier_changes(_tier(spark, d, 5), _tier(spark, d, 7))


def decision_audit(spark, d):
    decision = role(spark, d, "relation").where("id % 2 = 0").select(F.col("subject_id").alias("a_id"), F.col("object_id").alias("b_id"), F.col("role").alias("operation")).distinct()
    sets = role(spark, d, "relation").select("id", F.col("subject_id").alias("person_id"), F.col("role").alias("operation"), F.concat(F.lit("samme som "), F.col("object_id").cast("string")).alias("summary"))
    return Q.decision_audit(decision, sets)


def parent_coverage(spark, d):
    return Q.parent_coverage(role(spark, d, "person"), A.parent_edges(role(spark, d, "parent_child")), _aliases(spark, d))


def weighted_pick(spark, d):
    rows = role(spark, d, "relation").select(F.col("object_id").alias("g"), F.col("id").alias("ord"), (F.col("id") % 4).cast("double").alias("score"))
    return Q.weighted_pick(rows, "g", F.lit(0.4)).select("g", "ord")


def identity_faults(spark, d):
    edge = role(spark, d, "person").where("id % 5 < 2").select(F.col("id").alias("alias"), F.when(F.col("id") % 50 == 0, F.col("id")).when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id") + 3).alias("canonical"))
    edge = edge.unionByName(role(spark, d, "person").where("id % 40 = 6").select(F.col("id").alias("alias"), F.lit(2).cast("long").alias("canonical")))
    union = role(spark, d, "parent_child").select(F.col("child").alias("p1"), (F.col("child") + 3).alias("p2"))
    return Q.identity_faults(edge, union)


def published(spark, d):
    p = role(spark, d, "person").select("id", "staged", (F.col("id") % 4 == 0).alias("stub"))
    member = role(spark, d, "member").withColumn("family_id", F.floor(F.col("person_id") / 5))
    return Q.publish(p, member, p.where("id % 13 = 5").select("id"))


def person_deleted(spark, d):
    gone = role(spark, d, "person").where("id % 17 = 3").select("id")
    rest = Q.delete_person(role(spark, d, "person"), {"relation": (role(spark, d, "relation"), ["subject_id", "object_id"]), "member": (role(spark, d, "member"), ["person_id"])}, gone)
    return Q.row_counts(rest)


def media_merge_plan(spark, d):
    return Q.media_merge_plan(role(spark, d, "media"), role(spark, d, "depiction").withColumn("object_id", F.col("object_id") % 20))


def era_warnings(spark, d):
    p = role(spark, d, "person")
    kin = A.parent_edges(role(spark, d, "parent_child")).select("child", "parent").distinct()
    kin = kin.join(p.select(F.col("id").alias("child"), F.col("born").alias("b")), "child").join(p.select(F.col("id").alias("parent"), F.col("born").alias("pb"), F.col("died").alias("pd")), "parent")
    return kin.select("child", "parent", D.era_warning(F.col("b"), F.col("pb"), F.col("pd")).alias("warning"))


def media_ages(spark, d):
    age = F.when(F.col("id") % 9 != 0, F.col("id") * F.col("id") * 977 % 9_000_000 - 1000)
    return role(spark, d, "media").select("id", D.media_age(age).alias("age"))


def field_statuses(spark, d):
    b = F.when(F.col("id") % 4 == 0, F.upper("name")).when(F.col("id") % 4 == 1, F.concat(F.lit(" "), F.col("name"), F.lit(". "))).when(F.col("id") % 4 == 2, "x")
    return role(spark, d, "person").select("id", D.field_status(F.when(F.col("id") % 5 != 0, F.col("name")), b).alias("status"))


def pair_keys(spark, d):
    return role(spark, d, "relation").select("id", D.pair_key(F.col("subject_id"), F.col("object_id")).alias("pair"))


def verbatim_spans(spark, d):
    t = read(spark, d, "documents")
    spans = F.array(F.substring("text", 5, 30), F.concat(F.substring("text", 1, 9), F.lit("#")), F.lit(""), F.lit(None).cast("string"))
    return t.select("doc_id", D.spans_not_verbatim(spans, F.col("text")).alias("missing"), D.noisy_name(F.col("text")).alias("noisy"))


def name_ratios(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(D.name_ratio(F.col("p_name"), F.col("p_brand")), 9).alias("ratio"))


def archive_cards(spark, d):
    event = role(spark, d, "claim").select("id", (F.col("target_id") % 700).alias("person_id"), F.when(F.col("id") % 3 != 0, F.col("id") % 2 == 0).alias("backbone"), "date_raw", "date_min")
    return K.archive_cards(event, V.visible_persons(role(spark, d, "person")), role(spark, d, "claim").where("id % 5 = 0"))


def estate_cards(spark, d):
    estate = role(spark, d, "place").select("id", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "Hovedgård").alias("type"))
    return K.estate_cards(estate, role(spark, d, "relation").groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("n")))


def union_cards(spark, d):
    union = role(spark, d, "parent_child").select(F.col("child").alias("id"), F.col("father").alias("p1"), F.when(F.col("child") % 5 != 0, F.col("mother")).alias("p2"), F.when(F.col("child") % 2 == 0, 1850).alias("year"))
    return K.union_cards(union, V.visible_persons(role(spark, d, "person")))


def office_cards(spark, d):
    return K.office_cards(role(spark, d, "relation").select(F.col("subject_id").alias("person_id"), F.col("role").alias("label"), "year"), V.visible_persons(role(spark, d, "person")))


def arms_cards(spark, d):
    return K.arms_cards(role(spark, d, "narrative").select("id", F.col("text").alias("blazon")))


def kinship_cards(spark, d):
    pairs = role(spark, d, "person").where("id > 3 AND id < 200").select(F.col("id").alias("a"), (F.col("id") % 50 + 1).alias("b"))
    return K.kinship_cards(A.relationships(pairs, A.parent_edges(role(spark, d, "parent_child")), role(spark, d, "person")))


def partner_faults(spark, d):
    return A.partner_faults(role(spark, d, "member").withColumn("family_id", F.floor(F.col("person_id") / 5)), _aliases(spark, d))


def collapsed_edges(spark, d):
    return A.collapse_edges(A.parent_edges(role(spark, d, "parent_child")), _aliases(spark, d))


def child_faults(spark, d):
    member = role(spark, d, "member").withColumn("family_id", F.floor(F.col("person_id") / 5))
    return A.child_faults(member, role(spark, d, "person").select(F.floor((F.col("id") * 3) / 5 - 20).alias("family_id"), F.col("id").alias("child")))


def compare_parent_child(spark, d):
    ours = A.parent_edges(role(spark, d, "parent_child")).select("child", "parent").distinct()
    theirs = ours.where("(child + parent) % 3 <> 0").select((F.col("child") + 10_000).alias("child"), (F.col("parent") + 10_000).alias("parent"))
    links = role(spark, d, "person").where("id % 4 <> 0").select(F.col("id").alias("a_id"), (F.col("id") + 10_000).alias("b_id"))
    return L.compare_sets(ours, theirs, links, ["child", "parent"])


def corrected_fields(spark, d):
    grid = E._grid(spark, d).select("person_id", "import_key", "record_key", "fingerprints", "imported", "editable")
    grid = materialise(grid, "grid")
    right = F.when(F.col("person_id") % 3 != 0, F.try_element_at("fingerprints", F.lit("koen"))).otherwise("x")
    commands = grid.select("person_id", right.alias("fingerprint")).unionByName(spark.createDataFrame([(-1, "x")], "person_id long, fingerprint string"))
    commands = commands.withColumns({"field": F.lit("koen"), "value": F.lit("kvinde"), "status": F.lit("rettet")})
    return corrections(grid, commands).select("person_id", "outcome")


def parent_slots(spark, d):
    fact = role(spark, d, "fact").where("kind = 'title'")
    claim = role(spark, d, "claim").select("id", "target_id", F.when(F.col("id") % 4 != 0, F.col("id") % 150).alias("family_id"))
    partner = role(spark, d, "member").where("role = 'partner'").select(F.floor(F.col("person_id") / 5).alias("family_id"), "person_id").join(role(spark, d, "person").select(F.col("id").alias("person_id"), F.when(F.col("id") % 9 != 0, F.col("name")).alias("name")), "person_id")
    return Q.parent_slots(fact, claim, role(spark, d, "citation"), role(spark, d, "source"), role(spark, d, "conclusion"), partner)


def grouped_events(spark, d):
    event = role(spark, d, "relation").select("id", F.col("subject_id").alias("person_id"), F.col("year").alias("date_min"), F.col("role").alias("text"))
    rows = Q.grouped_events(event, _aliases(spark, d))
    return rows.select("person_id", F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["id"].cast("string"), x["text"])), ",").alias("events"))


def texts_of(spark, d):
    preferred = role(spark, d, "narrative").where("person_id % 3 <> 0").groupBy("person_id").agg(F.min("text").alias("text"))
    return Q.texts_of(role(spark, d, "person"), _aliases(spark, d), preferred)


def default_edition(spark, d):
    return Q.default_edition(role(spark, d, "source"))


def enriched_queue(spark, d):
    names = role(spark, d, "person").where("id % 5 <> 0").select("id", "name")
    queue = role(spark, d, "relation").groupBy(F.col("subject_id").alias("a_id"), F.col("object_id").alias("b_id")).agg(F.min("id").alias("k"))
    queue = queue.select("a_id", "b_id", F.concat(F.lit("forælder "), (F.col("k") % 900).cast("string"), F.lit("; barn "), (F.col("k") % 70).cast("string"), F.lit("; uden")).alias("detail"))
    return Q.enriched_queue(queue, names, names)


def completeness(spark, d):
    return Q.completeness(role(spark, d, "person").withColumn("note", F.when(F.col("id") % 2 == 0, " ")), ["sex", "died", "status", "note"], "name")


def extraction_score(spark, d):
    t = read(spark, d, "documents")
    extract = t.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0).alias("mention"), F.when(F.col("doc_id") % 6 == 0, "Greve X").otherwise("X").alias("name"), F.array(F.substring("text", 3, 20), F.when(F.col("doc_id") % 4 == 0, F.lit("\x01#")), F.lit("")).alias("spans"))
    truth = t.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 == 0).alias("mention"))
    return Q.extraction_score(extract, truth, t.select(F.col("doc_id").alias("id"), "text"))


def place_keys(spark, d):
    raw = F.concat(F.lit("  Gård  Ø"), (F.col("id") % 7).cast("string"), F.lit(".,  Sønder  Herred; "))
    rows = role(spark, d, "place").select("id", T.place_key(raw).alias("key"), T.place_key(T.place_leaf(raw)).alias("leaf"), T.ascii_form(T.place_key(raw)).alias("ascii"))
    at = F.when(F.col("id") % 4 == 0, "0").when(F.col("id") % 4 == 1, "x").when(F.col("id") % 4 == 2, "95.5").otherwise("55.25")
    return rows.withColumn("lat", T.coordinate(at, 90.0))


QUERIES = {f.__name__: f for f in (
    visible_narratives, visible_events, visible_conclusions, visible_notes, visible_stories, media_of_objects, app_persons, canonical_relations, lineage_descendants, would_cycle, surname_root, line_markings, latest_intro,
    family_rows, nudged_children, sex_composition, founders, geo_points, busiest_estate, row_counts, review_progress, family_status, one_to_one, annotated_queue, stratified_sample, tier_changes, decision_audit, parent_coverage,
    weighted_pick, identity_faults, published, person_deleted, media_merge_plan, era_warnings, media_ages, field_statuses, pair_keys, verbatim_spans, name_ratios,
    archive_cards, estate_cards, union_cards, office_cards, arms_cards, kinship_cards, partner_faults, collapsed_edges, child_faults, compare_parent_child, corrected_fields,
    parent_slots, grouped_events, texts_of, default_edition, enriched_queue, completeness, extraction_score, place_keys)}

_SEEN = "seen AS (SELECT id FROM person WHERE living = false AND NOT coalesce(private, false) AND NOT coalesce(staged, false))"
_NARR = f"""{_SEEN}, nn AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'estate' WHEN id % 7 = 0 THEN 'secret' ELSE 'person' END AS subject_type, person_id AS subject_id, CASE WHEN id % 4 <> 0 THEN id % 3 = 0 END AS private, CAST(length(text) AS INT) AS n FROM narrative),
vn AS (SELECT * FROM nn WHERE NOT coalesce(private, false) AND (subject_type = 'estate' OR subject_type = 'person' AND subject_id IN (SELECT id FROM seen)))"""
_FACT = f"""{_SEEN}, vf AS (SELECT * FROM fact WHERE subject_id IN (SELECT id FROM seen)), vr AS (SELECT * FROM relation WHERE subject_id IN (SELECT id FROM seen) AND object_id IN (SELECT id FROM seen))"""
_ALIAS = "alias AS (SELECT id, id - 1 AS canonical FROM person WHERE id % 6 = 1)"
_TIER = lambda m: f"SELECT a_id, b_id, ['auto', 'review', 'none'][(a_id * 3 + b_id) % {m} % 3 + 1] AS tier FROM (SELECT DISTINCT subject_id AS a_id, object_id AS b_id FROM relation) WHERE (a_id * 3 + b_id) % {m} > 0"
_QUEUE = """queue AS (SELECT subject_id AS a_id, object_id AS b_id, CASE id % 3 WHEN 0 THEN 'bekræft' WHEN 1 THEN ' ' END AS decision, CASE WHEN id % 4 = 0 THEN 'bekræftet' END AS status, CASE WHEN id % 5 <> 0 THEN id % 4 END AS support, role AS detail FROM relation)"""
_EDGE = "edge AS (SELECT DISTINCT child, parent FROM (SELECT child, unnest([father, mother]) AS parent FROM parent_child) WHERE parent <> child)"

SQL = {
    "visible_narratives": sql("person narrative", f"{_NARR} SELECT * FROM vn"),
    "visible_events": sql("person narrative fact", f"""{_NARR} SELECT id, subject_type, subject_id, id % 900 AS narrative_id, 'godkendt' AS feed_status FROM fact WHERE id % 9 <> 0 AND id % 10 <> 0 AND subject_id IN (SELECT id FROM seen) AND id % 900 IN (SELECT id FROM vn)"""),
    "visible_conclusions": sql("person fact relation conclusion", f"""{_FACT}, k AS (SELECT * REPLACE (['fact', 'relation', 'note'][target_id % 3 + 1] AS target_type) FROM conclusion)
SELECT * FROM k WHERE target_type = 'fact' AND target_id IN (SELECT id FROM vf) OR target_type = 'relation' AND target_id IN (SELECT id FROM vr)"""),
    "visible_notes": sql("person fact relation", f"""{_FACT}, n AS (SELECT id, ['fact', 'relation', 'person', 'place', 'secret'][id % 5 + 1] AS target_type, CASE WHEN id % 5 = 2 THEN subject_id ELSE id END AS target_id, CASE WHEN id % 11 = 0 THEN true END AS private FROM relation)
SELECT * FROM n WHERE private IS NULL AND (target_type = 'place' OR target_type = 'fact' AND target_id IN (SELECT id FROM vf) OR target_type = 'relation' AND target_id IN (SELECT id FROM vr) OR target_type = 'person' AND target_id IN (SELECT id FROM seen))"""),
    "visible_stories": sql("person fact", f"{_SEEN} SELECT id, subject_type, subject_id, 'publiceret' AS status, id % 13 = 0 AS private FROM fact WHERE id % 2 = 0 AND id % 13 <> 0 AND subject_id IN (SELECT id FROM seen)"),
    "media_of_objects": sql("media", """p AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN path || '/t' WHEN id % 5 = 0 THEN 'væk' ELSE path END AS path FROM media)
SELECT p.path, coalesce(m.id, v.id) AS media_id FROM p LEFT JOIN media m ON m.path = p.path LEFT JOIN (SELECT path || '/t' AS path, id FROM media WHERE id % 2 = 0) v ON v.path = p.path"""),
    "app_persons": sql("person narrative", """t AS (SELECT person_id, min(text) AS text FROM narrative GROUP BY person_id)
SELECT id, coalesce(name, 'Ukendt') AS name, coalesce(sex, 'ukendt') AS sex, coalesce(text, '') AS text FROM person LEFT JOIN t ON person_id = id WHERE NOT coalesce(private, false)"""),
    "canonical_relations": sql("person relation", f"{_ALIAS} SELECT r.id, coalesce(x.canonical, subject_id) AS subject_id, coalesce(y.canonical, object_id) AS object_id FROM relation r LEFT JOIN alias x ON x.id = subject_id LEFT JOIN alias y ON y.id = object_id"),
    "lineage_descendants": sql("lineage", """w AS (SELECT parent_id AS root, id, 1 AS depth FROM lineage WHERE parent_id BETWEEN 20 AND 39 UNION ALL SELECT w.root, l.id, depth + 1 FROM w JOIN lineage l ON l.parent_id = w.id) SELECT * FROM w""", recursive=True),
    "would_cycle": sql("lineage", """c AS (SELECT id, CASE id % 3 WHEN 0 THEN id * 2 WHEN 1 THEN id ELSE CAST(floor(id / 4) AS BIGINT) + 1 END AS parent_id FROM lineage),
w AS (SELECT id, parent_id AS at FROM c UNION ALL SELECT w.id, l.parent_id FROM w JOIN lineage l ON l.id = w.at WHERE l.parent_id IS NOT NULL)
SELECT id, parent_id, NOT EXISTS (SELECT 1 FROM w WHERE w.id = c.id AND w.at = c.id) AS ok FROM c""", recursive=True),
    "surname_root": sql("lineage", "SELECT min(id) AS id, arg_min(surname, id) AS surname FROM lineage WHERE (id % 4 = 1 OR parent_id IS NULL) AND trim(surname) <> ''"),
    "line_markings": sql("person fact", f"{_ALIAS} SELECT coalesce(canonical, subject_id) AS id, min(f.id) AS ord, arg_min(kind, f.id) AS value FROM fact f LEFT JOIN alias a ON a.id = subject_id GROUP BY 1"),
    "latest_intro": sql("narrative", "SELECT person_id AS lineage_id, max(id) AS id, arg_max(text, id) AS text FROM narrative WHERE id % 2 = 0 AND trim(text) <> '' GROUP BY person_id"),
    "family_rows": sql("person member", """m AS (SELECT CAST(floor(person_id / 7) AS BIGINT) AS family_id, person_id, role, coalesce(ordinal, 0) AS o, CASE sex WHEN 'mand' THEN 0 WHEN 'kvinde' THEN 1 ELSE 2 END AS s FROM member JOIN person ON person.id = person_id),
g AS (SELECT family_id, coalesce(string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY s, o, person_id) FILTER (role = 'partner'), '') AS partners, coalesce(string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY o, person_id) FILTER (role = 'barn'), '') AS children FROM m GROUP BY family_id)
SELECT person_id, family_id, role, partners, children FROM m JOIN g USING (family_id)"""),
    "nudged_children": sql("member", """m AS (SELECT CAST(floor(person_id / 7) AS BIGINT) AS family_id, person_id AS id, CAST(person_id % 7 AS INT) AS place, CASE WHEN person_id % 3 <> 0 THEN ordinal ELSE CAST((person_id % 7 + 1) * 10 AS INT) END AS o FROM member)
SELECT family_id, id, lag(o) OVER w - 1 AS up, lead(o) OVER w + 1 AS down FROM m WINDOW w AS (PARTITION BY family_id ORDER BY place)"""),
    "sex_composition": sql("person", "SELECT line, count(*) FILTER (sex = 'mand') AS men, count(*) FILTER (sex = 'kvinde') AS women, count(*) FILTER (sex IS NULL) AS unknown FROM person GROUP BY line"),
    "founders": sql("person parent_child", """k AS (SELECT father AS id, count(*) AS n FROM parent_child GROUP BY father), r AS (SELECT id, 0 AS p, -id AS key FROM person WHERE id % 100 = 3 UNION ALL SELECT id, 1, -n FROM k),
s AS (SELECT id, min((p, key)) AS x FROM r WHERE id IN (SELECT id FROM person WHERE died IS NOT NULL OR 1900 - born > 120) GROUP BY id) SELECT id, row_number() OVER (ORDER BY x, id) AS place FROM s QUALIFY place <= 25"""),
    "geo_points": sql("person fact parent_child place", f"""{_SEEN}, spot AS (SELECT id AS place_id, lat, lon FROM place WHERE lat IS NOT NULL AND lon IS NOT NULL),
f AS (SELECT subject_id AS person_id, ['fødsel', 'død', 'dåb', 'titel'][id % 4 + 1] AS kind, id % 120 AS place_id FROM fact),
w AS (SELECT child AS family_id, unnest(list_distinct([father, CASE WHEN child % 5 <> 0 THEN mother END])) AS person_id, CASE WHEN child % 2 = 0 THEN 1850 END AS year, child % 90 AS place_id FROM parent_child)
SELECT 'estate' AS kind, place_id, lat, lon, place_id + 500 AS estate_id, NULL::BIGINT AS family_id, NULL::BIGINT AS person_id, NULL::INT AS year FROM spot
UNION ALL SELECT kind, place_id, lat, lon, NULL, NULL, person_id, CASE kind WHEN 'fødsel' THEN born WHEN 'død' THEN died END FROM f JOIN spot USING (place_id) JOIN person ON person.id = person_id WHERE kind <> 'titel' AND person_id IN (SELECT id FROM seen)
UNION ALL SELECT 'vielse', place_id, lat, lon, NULL, family_id, person_id, year FROM w JOIN spot USING (place_id) WHERE person_id IN (SELECT id FROM seen)"""),
    "busiest_estate": sql("relation", "SELECT object_id AS id, count(*) AS n FROM relation WHERE role = 'ejer' GROUP BY object_id ORDER BY n DESC, id LIMIT 1"),
    "row_counts": sql("person fact claim relation narrative media", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("person", "fact", "claim", "relation", "narrative", "media"))),
    "review_progress": sql("relation", f"{_QUEUE} SELECT count(*) AS total, count(*) FILTER (trim(decision) <> '') AS decided, count(*) - count(*) FILTER (trim(decision) <> '') AS remaining FROM queue"),
    "family_status": sql("relation", f"{_QUEUE} SELECT a_id, b_id, bool_or(coalesce(status = 'bekræftet', false)) AS confirmed, CAST(sum(coalesce(support, 0)) AS BIGINT) AS support, string_agg(DISTINCT detail, '; ' ORDER BY detail) AS detail FROM queue GROUP BY a_id, b_id"),
    "one_to_one": sql("person", """a AS (SELECT key, count(*) AS n FROM (SELECT id AS key FROM person WHERE id % 3 <> 0 UNION ALL SELECT id FROM person WHERE id % 10 = 0) GROUP BY key), b AS (SELECT id AS key FROM person WHERE id % 4 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN n > 1 THEN 'flertydig' WHEN b.key IS NULL THEN 'kun_venstre' WHEN a.key IS NULL THEN 'kun_højre' ELSE 'enig' END AS status FROM a FULL JOIN b ON a.key = b.key"""),
    "annotated_queue": sql("person relation", f"{_QUEUE} SELECT DISTINCT a_id, b_id, detail, coalesce(name, '') AS name, coalesce(born, 0) AS born FROM queue LEFT JOIN (SELECT id, name, born FROM person WHERE id % 2 = 0) p ON p.id = a_id"),
    "stratified_sample": sql("person", "SELECT id, line FROM person QUALIFY row_number() OVER (PARTITION BY line ORDER BY md5('7:' || id), id) <= 5"),
    "tier_changes": sql("relation", f"b AS ({_TIER(5)}), a AS ({_TIER(7)}) SELECT coalesce(b.tier, 'skjult') AS \"before\", coalesce(a.tier, 'skjult') AS \"after\", count(*) AS n FROM b FULL JOIN a ON a.a_id = b.a_id AND a.b_id = b.b_id GROUP BY 1, 2"),
    "decision_audit": sql("relation", """d AS (SELECT DISTINCT subject_id AS a_id, object_id AS b_id, role AS operation FROM relation WHERE id % 2 = 0),
h AS (SELECT d.*, min(r.id) AS set_id FROM d JOIN relation r ON r.subject_id = d.a_id AND r.role = d.operation AND contains('samme som ' || r.object_id, CAST(d.b_id AS VARCHAR)) GROUP BY ALL)
SELECT d.a_id, d.b_id, set_id FROM d LEFT JOIN h USING (a_id, b_id, operation)"""),
    "parent_coverage": sql("person parent_child", f"""{_ALIAS}, {_EDGE}, c AS (SELECT p.id, coalesce(canonical, p.id) AS to_ FROM person p LEFT JOIN alias a ON a.id = p.id),
e AS (SELECT coalesce(x.to_, child) AS child, coalesce(y.to_, parent) AS parent FROM edge LEFT JOIN c x ON x.id = child LEFT JOIN c y ON y.id = parent), n AS (SELECT child, count(DISTINCT parent) AS n FROM e WHERE child <> parent GROUP BY child)
SELECT count(*) AS persons, count(*) FILTER (n = 1) AS one, count(*) FILTER (n >= 2) AS two FROM (SELECT DISTINCT to_ AS id FROM c) p LEFT JOIN n ON n.child = p.id"""),
    "weighted_pick": sql("relation", """r AS (SELECT object_id AS g, id AS ord, sum(id % 4) OVER (PARTITION BY object_id ORDER BY id) AS s, sum(id % 4) OVER (PARTITION BY object_id) AS t FROM relation)
SELECT g, min(ord) AS ord FROM r WHERE t > 0 AND s >= 0.4 * t GROUP BY g"""),
    "identity_faults": sql("person parent_child", """e AS (SELECT id AS alias, CASE WHEN id % 50 = 0 THEN id WHEN id % 10 = 1 THEN id - 1 ELSE id + 3 END AS canonical FROM person WHERE id % 5 < 2 UNION SELECT id, 2 FROM person WHERE id % 40 = 6),
u AS (SELECT child AS p1, child + 3 AS p2 FROM parent_child)
SELECT alias, canonical, 'selv' AS fault FROM e WHERE alias = canonical UNION ALL SELECT alias, canonical, 'flere mål' FROM e WHERE alias IN (SELECT alias FROM e GROUP BY alias HAVING count(*) > 1)
UNION ALL SELECT alias, canonical, 'kæde' FROM e WHERE alias IN (SELECT canonical FROM e) UNION ALL SELECT alias, canonical, 'samme union' FROM e WHERE (least(alias, canonical), greatest(alias, canonical)) IN (SELECT (p1, p2) FROM u)"""),
    "published": sql("person member", """m AS (SELECT CAST(floor(person_id / 5) AS BIGINT) AS f, person_id AS id FROM member WHERE role = 'partner'), k AS (SELECT f FROM m WHERE id % 13 = 5)
SELECT id, CASE WHEN id % 13 = 5 OR id % 4 = 0 AND id IN (SELECT id FROM m WHERE f IN (SELECT f FROM k)) THEN false ELSE staged END AS staged, id % 4 = 0 AS stub FROM person"""),
    "person_deleted": sql("person relation member", """SELECT 'person' AS name, count(*) AS n FROM person WHERE id % 17 <> 3 UNION ALL SELECT 'relation', count(*) FROM relation WHERE subject_id NOT IN (SELECT id FROM person WHERE id % 17 = 3) AND object_id NOT IN (SELECT id FROM person WHERE id % 17 = 3)
UNION ALL SELECT 'member', count(*) FROM member WHERE person_id % 17 <> 3"""),
    "media_merge_plan": sql("media depiction", """r AS (SELECT id, min(id) OVER (PARTITION BY sha) AS keep_id FROM media WHERE status = 'klar' AND sha IS NOT NULL), d AS (SELECT keep_id, id AS drop_id FROM r WHERE id <> keep_id),
u AS (SELECT DISTINCT media_id, object_type, object_id % 20 AS object_id FROM depiction), x AS (SELECT keep_id, drop_id, object_type, object_id, min(drop_id) OVER (PARTITION BY keep_id, object_type, object_id) AS f FROM d JOIN u ON media_id = drop_id)
SELECT keep_id, drop_id, object_type, object_id, CASE WHEN drop_id <> f OR (keep_id, object_type, object_id) IN (SELECT (media_id, object_type, object_id) FROM u) THEN 'slet' ELSE 'flyt' END AS step FROM x
UNION ALL SELECT keep_id, drop_id, NULL, NULL, 'slet medie' FROM d"""),
    "era_warnings": sql("person parent_child", f"""{_EDGE} SELECT child, parent, CASE WHEN c.born < p.born THEN '{D.BORN_BEFORE}' WHEN c.born > p.died + 1 THEN '{D.BORN_AFTER}' END AS warning FROM edge JOIN person c ON c.id = child JOIN person p ON p.id = parent"""),
    "media_ages": sql("media", """a AS (SELECT id, CASE WHEN id % 9 <> 0 THEN id * id * 977 % 9000000 - 1000 END AS s FROM media),
u AS (SELECT id, s, CASE WHEN s < 86400 THEN 3600 WHEN s < 604800 THEN 86400 WHEN s < 2592000 THEN 604800 ELSE 2592000 END AS k, CASE WHEN s < 86400 THEN ['time', 'timer'] WHEN s < 604800 THEN ['dag', 'dage'] WHEN s < 2592000 THEN ['uge', 'uger'] ELSE ['måned', 'måneder'] END AS w FROM a)
SELECT id, CASE WHEN s IS NULL OR s < 0 THEN 'ukendt alder' WHEN s < 3600 THEN 'under 1 time — muligvis i gang' ELSE (s // k) || ' ' || CASE WHEN s // k = 1 THEN w[1] ELSE w[2] END END AS age FROM u"""),
    "field_statuses": sql("person", "SELECT id, CASE WHEN id % 20 IN (15) THEN 'neutral' WHEN id % 5 <> 0 AND id % 4 < 2 THEN 'enig' ELSE 'afvigende' END AS status FROM person"),
    "pair_keys": sql("relation", "SELECT id, least(CAST(subject_id AS VARCHAR), CAST(object_id AS VARCHAR)) || '|' || greatest(CAST(subject_id AS VARCHAR), CAST(object_id AS VARCHAR)) AS pair FROM relation"),
    "verbatim_spans": f"""SELECT doc_id, CAST(CASE WHEN contains(text, substr(text, 1, 9) || '#') THEN 0 ELSE 1 END AS INT) AS missing, {' OR '.join(f"contains(text, '{w}')" for w in D.NAME_NOISE)} AS noisy FROM documents""",
    "archive_cards": sql("person claim", f"""{_SEEN} SELECT 'arkiv:' || id AS card, 'arkiv' AS kind, target_id % 700 AS person_id, coalesce(nullif(date_raw, ''), CAST(year(date_min) AS VARCHAR)) AS year FROM claim
WHERE NOT coalesce(CASE WHEN id % 3 <> 0 THEN id % 2 = 0 END, false) AND id % 5 <> 0 AND target_id % 700 IN (SELECT id FROM seen)"""),
    "estate_cards": sql("place relation", """o AS (SELECT object_id AS id, count(*) AS n FROM relation GROUP BY object_id), e AS (SELECT p.id, coalesce(n, 0) AS n, CASE WHEN p.id % 3 = 1 THEN 'Hovedgård' ELSE 'Gods' END AS t FROM place p LEFT JOIN o ON o.id = p.id)
SELECT 'gods:' || id AS card, 'gods' AS kind, t || CASE WHEN n > 0 THEN ' · ' || n || ' ejere' ELSE '' END AS meta, least(n, 7) AS dots FROM e"""),
    "union_cards": sql("person parent_child", f"""{_SEEN} SELECT 'forbundet:' || child AS card, 'forbundet' AS kind, a.name AS a_name, b.name AS b_name, CASE WHEN child % 2 = 0 THEN 'gift 1850' ELSE 'gift' END AS foot
FROM parent_child JOIN person a ON a.id = father JOIN person b ON b.id = mother WHERE child % 5 <> 0 AND father IN (SELECT id FROM seen) AND mother IN (SELECT id FROM seen)"""),
    "office_cards": sql("person relation", f"{_SEEN} SELECT 'embede:' || subject_id || ':' || role || ':' || coalesce(CAST(year AS VARCHAR), '') AS card, 'embede' AS kind, subject_id AS person_id, role AS label FROM relation WHERE subject_id IN (SELECT id FROM seen)"),
    "arms_cards": sql("narrative", "SELECT 'vaaben:' || id AS card, 'vaaben' AS kind, CASE WHEN trim(text) <> '' THEN text ELSE 'Blasoneringen indlæses fra Aarbogen, når våbenet knyttes.' END AS blazon FROM narrative"),
    "partner_faults": sql("person member", f"""{_ALIAS}, p AS (SELECT DISTINCT CAST(floor(person_id / 5) AS BIGINT) AS family_id, person_id FROM member WHERE role = 'partner'),
g AS (SELECT family_id, count(*) AS n, count(DISTINCT coalesce(canonical, person_id)) AS m FROM p LEFT JOIN alias ON alias.id = person_id GROUP BY family_id)
SELECT family_id, 'for mange' AS fault FROM g WHERE n > 2 UNION ALL SELECT family_id, 'samme identitet' FROM g WHERE m < n"""),
    "collapsed_edges": sql("person parent_child", f"""{_ALIAS}, e AS (SELECT DISTINCT child, parent, confidence FROM (SELECT child, unnest([father, mother]) AS parent, confidence FROM parent_child) WHERE child <> parent),
c AS (SELECT coalesce(x.canonical, child) AS child, coalesce(y.canonical, parent) AS parent, confidence, CASE confidence WHEN 'omstridt' THEN 0 WHEN 'formodet' THEN 1 WHEN 'sandsynlig' THEN 2 WHEN 'sikker' THEN 3 ELSE -1 END AS r
 FROM e LEFT JOIN alias x ON x.id = child LEFT JOIN alias y ON y.id = parent)
SELECT child, parent, arg_max_null(confidence, r) AS confidence FROM c WHERE child <> parent GROUP BY child, parent"""),
    "child_faults": sql("person member", """m AS (SELECT CAST(floor(person_id / 5) AS BIGINT) AS family_id, person_id, role, ordinal FROM member), c AS (SELECT CAST(floor((id * 3) / 5 - 20) AS BIGINT) AS family_id, id AS child FROM person),
pr AS (SELECT * FROM m WHERE role = 'partner' QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY ordinal, person_id) <= 2), e AS (SELECT DISTINCT p.person_id AS p, k.person_id AS k FROM pr p JOIN m k ON k.family_id = p.family_id AND k.role = 'barn'),
w AS (SELECT p, k FROM e UNION SELECT w.p, e.k FROM w JOIN e ON e.p = w.k)
SELECT family_id, child, CASE WHEN family_id NOT IN (SELECT family_id FROM m) THEN 'ukendt familie' WHEN (family_id, child) IN (SELECT (family_id, person_id) FROM m WHERE role = 'partner') THEN 'partner'
 WHEN child IN (SELECT person_id FROM m WHERE role = 'barn') THEN 'har fødselsfamilie' WHEN EXISTS (SELECT 1 FROM w JOIN m ON m.person_id = w.k AND m.role = 'partner' WHERE w.p = c.child AND m.family_id = c.family_id) THEN 'kreds' END AS fault FROM c""", recursive=True),
    "compare_parent_child": sql("person parent_child", f"""{_EDGE}, link AS (SELECT id AS a_id, id + 10000 AS b_id FROM person WHERE id % 4 <> 0), t AS (SELECT child + 10000 AS child, parent + 10000 AS parent FROM edge WHERE (child + parent) % 3 <> 0),
m AS (SELECT x.b_id AS child, y.b_id AS parent FROM edge LEFT JOIN link x ON x.a_id = child LEFT JOIN link y ON y.a_id = parent)
SELECT 'uden_for_scope' AS category, child, parent FROM m WHERE child IS NULL OR parent IS NULL
UNION ALL SELECT CASE WHEN m.child IS NULL THEN 'mangler_hos_os' WHEN t.child IS NULL THEN 'ekstra_hos_os' ELSE 'enig' END, coalesce(m.child, t.child), coalesce(m.parent, t.parent) FROM (SELECT * FROM m WHERE child IS NOT NULL AND parent IS NOT NULL) m FULL JOIN t ON m.child = t.child AND m.parent = t.parent"""),
    "corrected_fields": sql(E._GRID_OF, f"""{E._GRID} SELECT person_id, CASE WHEN NOT contains(editable, 'koen=true') THEN 'spærret' WHEN person_id % 3 = 0 THEN 'forældet' ELSE 'ok' END AS outcome FROM grid UNION ALL SELECT -1, 'ukendt person'"""),
    "parent_slots": sql("fact claim citation source conclusion member person", """f AS (SELECT id FROM fact WHERE kind = 'title'), a AS (SELECT id, target_id, id % 150 AS family_id FROM claim WHERE id % 4 <> 0 AND target_id IN (SELECT id FROM f)),
p AS (SELECT CAST(floor(person_id / 5) AS BIGINT) AS family_id, string_agg(CASE WHEN person_id % 9 <> 0 THEN name ELSE '(ukendt)' END, ' · ' ORDER BY person_id) AS parents FROM member JOIN person ON person.id = person_id WHERE role = 'partner' GROUP BY 1),
c AS (SELECT claim_id, coalesce(edition, title) AS edition, page, quote FROM citation LEFT JOIN source s ON s.id = source_id QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY citation.id, edition NULLS FIRST, page NULLS FIRST, quote NULLS FIRST) = 1)
SELECT a.target_id AS fact_id, k.status, a.id AS claim_id, a.family_id, coalesce(parents, '') AS parents, edition, page, quote, coalesce(a.id = chosen_id, false) AS chosen
FROM a LEFT JOIN p USING (family_id) LEFT JOIN c ON c.claim_id = a.id LEFT JOIN conclusion k ON k.target_id = a.target_id"""),
    "grouped_events": sql("person relation", f"""{_ALIAS} SELECT coalesce(canonical, subject_id) AS person_id, string_agg(r.id || ':' || role, ',' ORDER BY year NULLS LAST, r.id) AS events FROM relation r LEFT JOIN alias a ON a.id = subject_id GROUP BY 1"""),
    "texts_of": sql("person narrative", f"""{_ALIAS}, t AS (SELECT person_id, min(text) AS text FROM narrative WHERE person_id % 3 <> 0 GROUP BY person_id),
n AS (SELECT id, canonical FROM alias UNION SELECT id, id FROM person), h AS (SELECT canonical, text FROM n JOIN t ON t.person_id = n.id QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY n.id <> canonical, n.id) = 1)
SELECT id, text FROM person LEFT JOIN h ON canonical = id"""),
    "default_edition": sql("source", "SELECT id, year FROM source ORDER BY coalesce(year, -1) DESC, id LIMIT 1"),
    "enriched_queue": sql("person relation", """q AS (SELECT subject_id AS a_id, object_id AS b_id, min(id) AS k FROM relation GROUP BY ALL), n AS (SELECT id, name FROM person WHERE id % 5 <> 0)
SELECT a_id, b_id, a.name AS a_name, b.name AS b_name, 'forælder ' || coalesce(x.name, CAST(k % 900 AS VARCHAR)) || '; barn ' || coalesce(y.name, CAST(k % 70 AS VARCHAR)) || '; uden' AS detail
FROM q LEFT JOIN n a ON a.id = a_id LEFT JOIN n b ON b.id = b_id LEFT JOIN n x ON x.id = k % 900 LEFT JOIN n y ON y.id = k % 70"""),
    "completeness": sql("person", "SELECT id, CAST((sex IS NOT NULL)::INT + (died IS NOT NULL)::INT + (status IS NOT NULL)::INT AS INT) AS filled, CAST(length(name) AS INT) AS length FROM person"),
    "extraction_score": """WITH e AS (SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS mention, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 = 0 END AS truth FROM documents)
SELECT count(*) AS records, count(truth) AS judged, count(*) FILTER (coalesce(mention, false) = truth) AS "right", count(*) FILTER (coalesce(mention, false) <> truth) AS wrong,
 CAST(sum((substr(text, 3, 20) <> '')::INT + (doc_id % 4 = 0)::INT) AS BIGINT) AS spans, CAST(sum((doc_id % 4 = 0)::INT) AS BIGINT) AS lost, count(*) FILTER (doc_id % 6 = 0) AS impure FROM e""",
    "place_keys": sql("place", """k AS (SELECT id, id % 7 AS n FROM place) SELECT id, 'gård ø' || n || '., sønder herred' AS key, 'gård ø' || n AS leaf, 'gaard oe' || n || '., soender herred' AS ascii, CASE WHEN id % 4 = 3 THEN 55.25::DOUBLE END AS lat FROM k"""),
}
