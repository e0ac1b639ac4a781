"""Family, lineage and identity queries on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import family as A
from stemma.operators import whatif

from .tables import role, sql


def _edges(spark, d):
    return A.parent_edges(role(spark, d, "parent_child"))


def parent_edges(spark, d):
    return _edges(spark, d)


def family_unions(spark, d):
    return A.family_edges(role(spark, d, "member"))[0]


def family_edges(spark, d):
    return A.family_edges(role(spark, d, "member"))[1]


def family_model(spark, d):
    return A.model_index(_edges(spark, d), role(spark, d, "person"))


def siblings(spark, d):
    return A.siblings(_edges(spark, d))


def lineage_paths(spark, d):
    return A.lineage_paths(role(spark, d, "lineage")).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def effective_surnames(spark, d):
    return A.effective_surnames(role(spark, d, "lineage"))


def ancestors(spark, d):
    return A.ancestors(_edges(spark, d))


def relationships(spark, d):
    pairs = role(spark, d, "person").where("id > 3").select(F.col("id").alias("a"), ((F.col("id") * 7) % F.greatest(F.col("id") - 1, F.lit(1)) + 1).alias("b"))
    return A.relationships(pairs, _edges(spark, d), role(spark, d, "person"))


def living_roster(spark, d):
    return A.living_roster(_edges(spark, d), role(spark, d, "person"))


def generation_neighbours(spark, d):
    marks = role(spark, d, "person").select("id", (F.col("id") % 7).alias("source_id"), F.when(F.col("id") % 5 != 0, F.col("nation") % 3).alias("lineage"), (F.col("id") % 11).alias("generation"))
    return A.generation_neighbours(marks)


def _same(spark, d):
    docs = role(spark, d, "media").select("id", "sha")
    first = docs.groupBy("sha").agg(F.min("id").alias("canonical"))
    copies = docs.join(first.hint("merge"), "sha").where("id <> canonical").select(F.col("id").alias("alias"), "canonical")
    extra = docs.where("id % 50 = 3").select(F.col("id").alias("alias"), F.when(F.col("id") % 100 == 3, F.col("id") + 7).otherwise(F.col("id") + 1_000_000).alias("canonical"))
    return copies.unionByName(extra)


def _beings(spark, d):
    """Documents as persons: what an identity's members must agree on."""
    m = role(spark, d, "media")
    return m.select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 9 == 0, "kvinde").when(F.col("id") % 2 == 0, "mand").alias("sex"), (F.lit(1700) + F.col("id") % 90).cast("int").alias("born"), F.when(F.col("id") % 3 == 0, F.lit(1790).cast("int")).alias("died"), (F.col("id") % 6 == 0).alias("private"))


def same_as_groups(spark, d):
    return A.same_as_groups(_same(spark, d), role(spark, d, "media"))


def _parents(spark, d):
    return role(spark, d, "media").where("id % 5 < 2 AND id > 9").select(F.col("id").alias("child"), (F.col("id") % 9).alias("parent"))


def same_as_verdicts(spark, d):
    return A.validate_groups(A.same_as_groups(_same(spark, d), role(spark, d, "media")), _beings(spark, d), _parents(spark, d))


def same_as_collapse(spark, d):
    groups, people = A.same_as_groups(_same(spark, d), role(spark, d, "media")), _beings(spark, d)
    return A.collapse(people, groups, A.validate_groups(groups, people, _parents(spark, d)))


def identity_cycles(spark, d):
    media = role(spark, d, "media")
    ties = media.where("id % 4 <> 1").select(F.col("id").alias("child"), F.expr("id - id % 10 + (id * 3 + 1) % 10").alias("parent"))
    return A.identity_cycles(A.same_as_groups(_same(spark, d), media), ties)


def same_as_whatif(spark, d):
    """Every document with a later one: would its identity stand if this were the one link added?"""
    media = role(spark, d, "media")
    pairs = media.select(F.col("id").alias("alias"), (F.col("id") + 1 + F.col("id") % 6).alias("canonical"))
    return whatif.what_if(pairs, _same(spark, d), media, _beings(spark, d), _parents(spark, d))


def partner_limit(spark, d):
    return A.partner_limit(role(spark, d, "member"), 25)


QUERIES = {f.__name__: f for f in (parent_edges, family_unions, family_edges, family_model, siblings, lineage_paths, effective_surnames, ancestors, relationships, living_roster, generation_neighbours, same_as_groups, same_as_verdicts, same_as_collapse, identity_cycles, same_as_whatif, partner_limit)}

_EDGE = "edge AS (SELECT DISTINCT child, unnest([father, mother]) AS parent, confidence FROM parent_child), e AS (SELECT * FROM edge WHERE parent <> child)"
_ANC = """up AS (SELECT child AS id, parent AS ancestor, 1 AS depth FROM e UNION SELECT up.id, e.parent, depth + 1 FROM up JOIN e ON e.child = up.ancestor),
anc AS (SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY ALL)"""
_PART = """partner AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY ordinal, person_id) AS n FROM member WHERE role = 'partner' QUALIFY n <= 2)"""
_RANK = "CASE confidence WHEN 'omstridt' THEN 0 WHEN 'formodet' THEN 1 WHEN 'sandsynlig' THEN 2 WHEN 'sikker' THEN 3 ELSE -1 END"
_PATH = """p AS (SELECT id, [id] AS path, parent_id AS at FROM lineage UNION ALL SELECT p.id, list_append(path, p.at), l.parent_id FROM p JOIN lineage l ON l.id = p.at)"""
# The groups are stars (copies around the smallest id) and single edges, which may join two stars: two steps of minimum labels reach the whole group.
_GROUP = """doc AS (SELECT id, sha, min(id) OVER (PARTITION BY sha) AS canonical FROM media),
same AS (SELECT DISTINCT id AS alias, canonical FROM doc WHERE id <> canonical UNION SELECT id, CASE WHEN id % 100 = 3 THEN id + 7 ELSE id + 1000000 END FROM doc WHERE id % 50 = 3),
both_ AS (SELECT alias AS x, canonical AS y FROM same UNION SELECT canonical, alias FROM same),
walk AS (SELECT x AS node, x AS seen FROM both_ UNION SELECT walk.node, both_.y FROM walk JOIN both_ ON both_.x = walk.seen),
comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
grp AS (SELECT component, count(*) FILTER (node NOT IN (SELECT alias FROM same)) AS sinks, min(node) FILTER (node NOT IN (SELECT alias FROM same)) AS sink, count(*) FILTER (node NOT IN (SELECT id FROM media)) AS unknown FROM comp GROUP BY component),
groups AS (SELECT component, node AS member, CASE WHEN unknown = 0 AND sinks = 1 THEN sink END AS canonical, CASE WHEN unknown > 0 THEN 'ukendt medlem' WHEN sinks <> 1 THEN 'ikke én kanonisk' END AS reason FROM comp JOIN grp USING (component))"""
_BEING = """being AS (SELECT id, 'p' || id AS name, CASE WHEN id % 9 = 0 THEN 'kvinde' WHEN id % 2 = 0 THEN 'mand' END AS sex, CAST(1700 + id % 90 AS INT) AS born, CASE WHEN id % 3 = 0 THEN CAST(1790 AS INT) END AS died, id % 6 = 0 AS private FROM media)"""
# Parents are ids below 9, none of which is a member's canonical in a group with children, so one round decides.
_VERDICT = f"""{_BEING}, g AS (SELECT * FROM groups WHERE reason IS NULL),
own AS (SELECT component, CASE WHEN count(DISTINCT sex) > 1 THEN 'køn' WHEN max(born) > min(died) + 1 THEN 'født efter død' WHEN max(born) - min(born) > 80 THEN 'fødselsår' END AS reason FROM g JOIN being ON being.id = member GROUP BY component),
canon AS (SELECT member AS id, canonical AS c FROM g JOIN own USING (component) WHERE own.reason IS NULL),
pc AS (SELECT id AS child, id % 9 AS parent FROM media WHERE id % 5 < 2 AND id > 9),
px AS (SELECT DISTINCT g.component, pc.child, coalesce(k.c, pc.parent) AS p2, g.canonical FROM pc JOIN g ON g.member = pc.child JOIN canon ON canon.id = pc.child LEFT JOIN canon k ON k.id = pc.parent),
ps AS (SELECT component, child, string_agg(CAST(p2 AS VARCHAR), ',' ORDER BY p2) AS s, bool_or(p2 = canonical) AS loop FROM px GROUP BY ALL),
pv AS (SELECT component, CASE WHEN count(DISTINCT s) > 1 THEN 'forældre' WHEN bool_or(loop) THEN 'egen forælder' END AS now FROM ps GROUP BY component),
verdict AS (SELECT component, coalesce(own.reason, now) AS reason FROM own LEFT JOIN pv USING (component))"""
_MALE, _FEMALE = "'mand'", "'kvinde'"


def _word(s, w):
    return f"CASE {s} WHEN 'mand' THEN '{w[0]}' WHEN 'kvinde' THEN '{w[1]}' ELSE '{w[2]}' END"


def _both(w):
    return f"CASE WHEN sa = 'mand' AND sb = 'mand' THEN '{w[0]}' WHEN sa = 'kvinde' AND sb = 'kvinde' THEN '{w[1]}' WHEN sa <> sb THEN '{w[2]}' ELSE '{w[3]}' END"


def _pair(w):
    return f"{_word('older', w[0])} || ' & ' || {_word('younger', w[1])}"


_LABEL = f"""CASE WHEN d1 = 0 AND d2 = 0 THEN 'Samme person'
  WHEN low = 0 THEN CASE gap {' '.join(f"WHEN {n} THEN {_pair(w)}" for n, w in A._PARENT.items())} ELSE '{A._FAR}' END
  WHEN low = 1 AND gap = 0 THEN CASE WHEN half THEN {_both(A._SIBLING[True])} ELSE {_both(A._SIBLING[False])} END
  WHEN low = 1 THEN CASE WHEN gap = 1 THEN {_pair(A._UNCLE[1])} ELSE {_pair(A._UNCLE[2])} END || mark
  ELSE (low - 1) || '. grads ' || {_both(A._COUSIN)} || CASE gap WHEN 0 THEN '' WHEN 1 THEN ' · 1 gang forskudt' ELSE ' · ' || gap || ' gange forskudt' END || mark END"""

SQL = {
    "parent_edges": sql("parent_child", f"{_EDGE} SELECT child, parent, confidence FROM e"),
    "family_unions": sql("member", f"{_PART} SELECT family_id, max(person_id) FILTER (n = 1) AS p1, max(person_id) FILTER (n = 2) AS p2 FROM partner GROUP BY family_id"),
    "family_edges": sql("member", f"{_PART} SELECT m.person_id AS child, p.person_id AS parent, family_id FROM member m JOIN partner p USING (family_id) WHERE m.role = 'barn'"),
    "family_model": sql("parent_child person", f"""{_EDGE}, ok AS (SELECT e.* FROM e LEFT JOIN person c ON c.id = e.child LEFT JOIN person p ON p.id = e.parent WHERE NOT (coalesce(c.born < p.born, false) OR coalesce(c.born > p.died + 1, false))),
up AS (SELECT child AS id, min(parent) AS parent_id, count(*) AS n, max({_RANK}) AS r FROM ok GROUP BY child), dn AS (SELECT parent AS id, count(*) AS n FROM ok GROUP BY parent)
SELECT person.id, parent_id, coalesce(up.n, 0) AS n_parents, coalesce(dn.n, 0) AS n_children, CASE r WHEN 0 THEN 'omstridt' WHEN 1 THEN 'formodet' WHEN 2 THEN 'sandsynlig' WHEN 3 THEN 'sikker' END AS confidence
FROM person LEFT JOIN up ON up.id = person.id LEFT JOIN dn ON dn.id = person.id"""),
    "siblings": sql("parent_child", f"{_EDGE} SELECT x.child AS a, y.child AS b, count(*) AS shared FROM e x JOIN e y ON x.parent = y.parent AND x.child < y.child GROUP BY ALL"),
    "lineage_paths": sql("lineage", f"{_PATH} SELECT id, array_to_string(path, '>') AS path FROM p WHERE p.at IS NULL", True),
    "effective_surnames": sql("lineage", f"""{_PATH}, s AS (SELECT id, unnest(path) AS at, generate_subscripts(path, 1) - 1 AS depth FROM p WHERE p.at IS NULL),
b AS (SELECT s.id, arg_min(l.surname, depth) AS surname, min(depth) AS depth FROM s JOIN lineage l ON l.id = s.at WHERE l.surname IS NOT NULL GROUP BY s.id)
SELECT lineage.id, b.surname, CAST(b.depth AS INT) AS depth FROM lineage LEFT JOIN b ON b.id = lineage.id""", True),
    "ancestors": sql("parent_child", f"{_EDGE}, {_ANC} SELECT id, ancestor, depth FROM anc", True),
    "relationships": sql("parent_child person", f"""{_EDGE}, {_ANC},
reach AS (SELECT * FROM anc UNION ALL SELECT id, id, 0 FROM person),
prs AS (SELECT id AS a, (id * 7) % greatest(id - 1, 1) + 1 AS b FROM person WHERE id > 3),
common AS (SELECT a, b, x.ancestor, x.depth AS d1, y.depth AS d2 FROM prs JOIN reach x ON x.id = a JOIN reach y ON y.id = b AND y.ancestor = x.ancestor),
near AS (SELECT * FROM common c WHERE NOT EXISTS (SELECT 1 FROM common o JOIN anc ON anc.id = o.ancestor WHERE o.a = c.a AND o.b = c.b AND anc.ancestor = c.ancestor)),
sa_ AS (SELECT n.a, n.b, n.ancestor, min(e.child) AS xa FROM near n JOIN e ON e.parent = n.ancestor JOIN reach r ON r.id = n.a AND r.ancestor = e.child AND r.depth = n.d1 - 1 GROUP BY ALL),
sb_ AS (SELECT n.a, n.b, n.ancestor, min(e.child) AS xb FROM near n JOIN e ON e.parent = n.ancestor JOIN reach r ON r.id = n.b AND r.ancestor = e.child AND r.depth = n.d2 - 1 GROUP BY ALL),
full_ AS (SELECT n.*, xa, xb FROM near n LEFT JOIN sa_ USING (a, b, ancestor) LEFT JOIN sb_ USING (a, b, ancestor)),
lines AS (SELECT a, b, count(DISTINCT (d1, d2, CASE WHEN xa IS NULL OR xb IS NULL THEN 's' || ancestor ELSE xa || '-' || xb END)) AS n_lines FROM full_ GROUP BY a, b),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d1 + d2, greatest(d1, d2), ancestor) AS k FROM full_),
ps AS (SELECT child, list(DISTINCT parent) AS ps FROM e GROUP BY child),
h AS (SELECT f.a, f.b, ancestor, d1, d2, n_lines, coalesce(xa <> xb AND len(list_filter(pa.ps, lambda z: z <> ancestor)) > 0 AND len(list_filter(pb.ps, lambda z: z <> ancestor)) > 0
   AND NOT list_has_any(list_filter(pa.ps, lambda z: z <> ancestor), list_filter(pb.ps, lambda z: z <> ancestor)), false) AS half,
   least(d1, d2) AS low, abs(d1 - d2) AS gap, p1.sex AS sa, p2.sex AS sb
  FROM f JOIN lines ON lines.a = f.a AND lines.b = f.b LEFT JOIN ps pa ON pa.child = xa LEFT JOIN ps pb ON pb.child = xb LEFT JOIN person p1 ON p1.id = f.a LEFT JOIN person p2 ON p2.id = f.b WHERE k = 1),
w AS (SELECT *, CASE WHEN d1 < d2 THEN sa ELSE sb END AS older, CASE WHEN d1 < d2 THEN sb ELSE sa END AS younger, CASE WHEN half THEN ' (halv)' ELSE '' END AS mark FROM h)
SELECT a, b, ancestor, d1, d2, n_lines, half, {_LABEL} AS label FROM w""", True),
    "living_roster": sql("parent_child person", f"""{_EDGE}, {_ANC}, v AS (SELECT ancestor AS id, min(anc.id) AS via FROM anc JOIN person ON person.id = anc.id AND living GROUP BY ancestor)
SELECT person.id, coalesce(living, false) AS living, via FROM person LEFT JOIN v ON v.id = person.id WHERE living OR via IS NOT NULL""", True),
    "generation_neighbours": sql("person", """m AS (SELECT id, id % 7 AS s, CASE WHEN id % 5 <> 0 THEN nation % 3 END AS l, id % 11 AS g FROM person)
SELECT id, (SELECT count(*) FROM m b WHERE b.s = m.s AND b.l IS NOT DISTINCT FROM m.l AND b.g = m.g - 1) AS n_before, (SELECT count(*) FROM m b WHERE b.s = m.s AND b.l IS NOT DISTINCT FROM m.l AND b.g = m.g + 1) AS n_after FROM m"""),
    "same_as_groups": sql("media", f"{_GROUP} SELECT * FROM groups", True),
    "same_as_verdicts": sql("media", f"{_GROUP}, {_VERDICT} SELECT * FROM verdict", True),
    "same_as_collapse": sql("media", f"""{_GROUP}, {_VERDICT}, ok AS (SELECT member, canonical FROM groups JOIN verdict USING (component) WHERE groups.reason IS NULL AND verdict.reason IS NULL),
r AS (SELECT being.*, coalesce(canonical, id) AS to_, (CASE WHEN coalesce(canonical, id) = id THEN '0' ELSE '1' END) || id AS o FROM being LEFT JOIN ok ON ok.member = id)
SELECT to_ AS id, arg_min(name, o) AS name, arg_min(born, o) AS born, arg_min(died, o) AS died, arg_min(sex, o) AS sex, bool_or(private) AS private, count(*) AS n_merged FROM r GROUP BY to_""", True),
    "identity_cycles": sql("media", f"""{_GROUP}, to_ AS (SELECT member, canonical FROM groups WHERE canonical IS NOT NULL),
arc AS (SELECT DISTINCT coalesce(c.canonical, t.child) AS x, coalesce(p.canonical, t.parent) AS y FROM (SELECT id AS child, id - id % 10 + (id * 3 + 1) % 10 AS parent FROM media WHERE id % 4 <> 1) t LEFT JOIN to_ c ON c.member = t.child LEFT JOIN to_ p ON p.member = t.parent),
far AS (SELECT x, y FROM arc UNION SELECT far.x, arc.y FROM far JOIN arc ON arc.x = far.y)
SELECT a.x AS node, min(a.y) AS cycle FROM far a JOIN far b ON b.x = a.y AND b.y = a.x GROUP BY a.x""", True),
    "partner_limit": sql("member", "SELECT family_id, count(DISTINCT person_id) AS n FROM member WHERE role = 'partner' GROUP BY family_id HAVING count(DISTINCT person_id) > 25"),
}
