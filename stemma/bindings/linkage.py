"""Record-linkage queries on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions.text import match_key
from stemma.operators import family as A
from stemma.operators import linkage as L
from stemma.plans.stages import materialise

from .tables import read, role, sql

CFG = L.Config()


def _tiers(spark, d, normalised=False):
    cfg = L.Config(normalised=normalised)
    found = L.candidates(role(spark, d, "record_a"), role(spark, d, "record_b"), cfg, L.edit_similarity)
    return L.assign_tiers(found, cfg)


def _truth(spark, d):
    return role(spark, d, "record_a").select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))


def match_keys(spark, d):
    words = ["Komtesse Sophia von", "Friedrich", "Cathrina af", "Detleff", "Wilhelm", "Kay"]
    name = F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), match_key(name).alias("name_key"))


def linkage_candidates(spark, d):
    return L.candidates(role(spark, d, "record_a"), role(spark, d, "record_b"), CFG, L.edit_similarity)


def linkage_jaro(spark, d):
    return L.assign_tiers(L.candidates(role(spark, d, "record_a"), role(spark, d, "record_b")))


def linkage_tiers(spark, d):
    return _tiers(spark, d).select("a_id", "b_id", "score", "tier")


def linkage_tiers_normalised(spark, d):
    return _tiers(spark, d, True).select("a_id", "b_id", "score", "tier")


def tier_counts(spark, d):
    return L.tier_counts(_tiers(spark, d))


def linkage_quality(spark, d):
    return L.precision_recall(_tiers(spark, d).where("tier = 'review'").select("a_id", "b_id"), _truth(spark, d))


def linkage_sweep(spark, d):
    return L.sweep(_tiers(spark, d), _truth(spark, d), [0.85, 0.9, 0.95], [0.65, 0.7, 0.75])


def _links(spark, d):
    return role(spark, d, "person").where("id % 4 <> 0").select(F.col("id").alias("a_id"), (F.col("id") + 10_000).alias("b_id"))


def compare_marriages(spark, d):
    r = role(spark, d, "relation")
    ours = r.where("role = 'ejer'").select(F.col("subject_id").alias("p1"), F.col("object_id").alias("p2")).distinct()
    theirs = r.where("id % 2 = 0").select((F.col("subject_id") + 10_000).alias("p1"), (F.col("object_id") + 10_000).alias("p2"))
    return L.compare_sets(ours, theirs, _links(spark, d), ["p1", "p2"])


def compare_facts(spark, d):
    return L.compare_facts(role(spark, d, "record_a"), role(spark, d, "record_b"), _truth(spark, d))


def corroboration(spark, d):
    ours = A.parent_edges(role(spark, d, "parent_child")).select("child", "parent")
    theirs = ours.where("child % 3 <> 0").select((F.col("child") + 10_000).alias("child"), (F.col("parent") + 10_000).alias("parent"))
    review = role(spark, d, "person").where("id % 4 = 0").select(F.col("id").alias("a_id"), (F.col("id") + 10_000).alias("b_id"))
    return L.corroborate(review, _links(spark, d), ours, theirs)


def _decisions(spark, d):
    kind = F.element_at(F.array(F.lit("bekræft"), F.lit("afvis"), F.lit("ny-id")), (F.col("a_id") % 3 + 1).cast("int"))
    return _tiers(spark, d).where("b_id % 4 = 1").select("a_id", "b_id", kind.alias("decision"), (F.col("b_id") + 5).alias("new_id"))


def review_merge(spark, d):
    return L.merge_decisions(_tiers(spark, d), _decisions(spark, d))


def review_worklist(spark, d):
    tiers = materialise(_tiers(spark, d))
    linked = tiers.where("a_id % 70 = 0").select("a_id")
    rejected = tiers.where("(a_id + b_id) % 5 = 0").select("a_id", "b_id")
    return L.worklist(tiers, linked, rejected)


def inherited_sources(spark, d):
    own = role(spark, d, "anchor").where("person_id % 3 = 0").select(F.col("person_id").alias("person"), F.col("source_id").alias("source"))
    unions = role(spark, d, "parent_child").select(F.col("father").alias("p1"), F.col("child").alias("p2"))
    return L.inherit_sources(own, unions)


def match_records(spark, d):
    fact, claim = role(spark, d, "fact"), role(spark, d, "claim")
    names = fact.join(claim.select(F.col("target_id").alias("id"), F.col("id").alias("ord"), "value", "date_raw"), "id").select(F.col("subject_id").alias("person"), "ord", F.when(F.col("kind") == "title", F.col("value")).alias("title"), F.when(F.col("kind") == "birth", F.col("date_raw")).alias("birth"), F.when(F.col("kind") == "death", F.col("date_raw")).alias("death"))
    return L.match_records(names, role(spark, d, "anchor").select(F.col("person_id").alias("person"), "line", "nr"))


def identity_register(spark, d):
    m = role(spark, d, "media")
    register = m.where("id % 3 <> 0").select((F.col("byte_size") % 400).alias("page"), F.col("width").alias("edition"), "id")
    batch = m.where("id % 2 = 0").select((F.col("byte_size") % 400).alias("page"), F.col("width").alias("edition"))
    return L.reconcile(register, batch, ["edition", "page"])


def duplicate_records(spark, d):
    rows = role(spark, d, "media").select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("year"), "sha", "byte_size", "width")
    return L.duplicates(rows, {"text": ["sha"], "size": ["byte_size", "width"]})


def place_matches(spark, d):
    key = F.concat(F.lit("gaard"), (F.col("id") % 40).cast("string"))
    index = role(spark, d, "place").select(key.alias("key"), F.col("name").alias("place"), F.when(F.col("id") % 3 == 0, 55.5).otherwise(F.coalesce("lat", F.lit(0.0))).alias("lat"), F.when(F.col("id") % 3 == 0, 9.5).otherwise(F.coalesce("lon", F.lit(0.0))).alias("lon"))
    texts = role(spark, d, "person").select("id", F.concat(F.when((F.col("id") % 2 == 0) & (F.col("id") % 60 < 40), F.lit("gård")).otherwise(F.lit("gaard")), (F.col("id") % 60).cast("string")).alias("key"))
    return L.match_places(texts, index)


def first_matches(spark, d):
    right = role(spark, d, "relation").select(F.col("subject_id").alias("id"), F.col("id").alias("ord"), "role")
    return L.first_match(role(spark, d, "person").select("id", "name"), right, "id", "ord")


QUERIES = {f.__name__: f for f in (match_keys, linkage_candidates, linkage_jaro, linkage_tiers, linkage_tiers_normalised, tier_counts, linkage_quality, linkage_sweep, compare_marriages, compare_facts, corroboration, review_merge, review_worklist, inherited_sources, match_records, identity_register, duplicate_records, place_matches, first_matches)}

_OVER = lambda a, b, w=0: f"coalesce(a.{a}_min - {w} <= b.{b}_max, true) AND coalesce(b.{b}_min <= a.{a}_max + {w}, true)"
_KNOWN = lambda x: f"((a.{x}_min IS NOT NULL OR a.{x}_max IS NOT NULL) AND (b.{x}_min IS NOT NULL OR b.{x}_max IS NOT NULL))"
_CAND = f"""pair AS (SELECT a.id AS a_id, b.id AS b_id, round(1 - CAST(levenshtein(a.name_key, b.name_key) AS DOUBLE) / greatest(length(a.name_key), length(b.name_key), 1), 9) AS name_sim,
  {_KNOWN('birth')} AS birth_known, {_KNOWN('birth')} AND {_OVER('birth', 'birth')} AS birth_eq, {_KNOWN('death')} AS death_known, {_KNOWN('death')} AND {_OVER('death', 'death')} AS death_eq,
  a.sex <> 'ukendt' AND b.sex <> 'ukendt' AS sex_known, a.sex = b.sex AND a.sex <> 'ukendt' AS sex_eq
  FROM record_a a JOIN record_b b ON a.name_key[1] = b.name_key[1] AND {_OVER('birth', 'birth', 5)}),
ok AS (SELECT *, round(CAST(0.6 AS DOUBLE) * name_sim + CASE WHEN birth_eq THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN death_eq THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN sex_eq THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 9) AS score
  FROM pair WHERE name_sim >= CAST({CFG.name_floor!r} AS DOUBLE)),
cand AS (SELECT *, count(*) OVER (PARTITION BY a_id) = 1 AS unique_block FROM ok QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 10)"""
_NORM = """round((CAST(0.6 AS DOUBLE) * name_sim + CASE WHEN birth_eq THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN death_eq THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN sex_eq THEN CAST(0.1 AS DOUBLE) ELSE 0 END)
  / (CAST(0.6 AS DOUBLE) + CASE WHEN birth_known THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN death_known THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN sex_known THEN CAST(0.1 AS DOUBLE) ELSE 0 END), 9)"""


def _tier_sql(normalised=False):
    score, extra = (_NORM, "AND (birth_known OR death_known)") if normalised else ("score", "")
    return f"""{_CAND}, sc AS (SELECT * REPLACE ({score} AS score) FROM cand),
r AS (SELECT *, row_number() OVER w = 1 AS top, lead(score) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY a_id ORDER BY score DESC, a_id, b_id)),
e AS (SELECT *, score >= 0.9 AND top AND (nxt IS NULL OR round(score - nxt, 9) >= 0.05) {extra} AS ok FROM r),
g AS (SELECT *, ok AND row_number() OVER (PARTITION BY b_id, ok ORDER BY score DESC, a_id, b_id) = 1 AS win, row_number() OVER (ORDER BY score DESC, a_id, b_id) AS pos FROM e),
t AS (SELECT *, CASE WHEN win THEN 'auto' WHEN pos > min(CASE WHEN win THEN pos END) OVER (PARTITION BY a_id) OR pos > min(CASE WHEN win THEN pos END) OVER (PARTITION BY b_id) THEN 'none'
  WHEN score >= 0.7 THEN 'review' ELSE 'none' END AS tier FROM g)"""


_AB = "record_a record_b"
_TRUE = "truth AS (SELECT id AS a_id, id + 1 AS b_id FROM record_a)"
_LINK = "link AS (SELECT id AS a_id, id + 10000 AS b_id FROM person WHERE id % 4 <> 0)"


def _fold_sql(x):
    """The spelling rules, written out."""
    from stemma.functions.text import FOLDS, TITLES, spelling_classes

    x = f"regexp_replace(lower({x}), '\\b(?:{'|'.join(TITLES)})\\b', ' ', 'g')"
    word = "w"
    for pattern, by in FOLDS:
        if "(?=" in pattern:
            pattern, by = "c([aoulr])", "k\\1"
        elif "\\1" in pattern:
            for c in "bcdfghjklmnpqrstvxz":
                word = f"regexp_replace({word}, '{c}{c}+', '{c}', 'g')"
            continue
        word = f"regexp_replace({word}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spelling_classes().items())
    return f"array_to_string(list_filter(list_transform(list_transform(string_split_regex(trim({x}), '\\s+'), lambda w: {word}), lambda w: CASE w {cases} ELSE w END), lambda w: w <> ''), ' ')"


SQL = {
    "match_keys": f"""WITH n AS (SELECT p_partkey AS id, ['Komtesse Sophia von', 'Friedrich', 'Cathrina af', 'Detleff', 'Wilhelm', 'Kay'][p_partkey % 6 + 1] || ' ' || p_name AS name FROM part)
SELECT id, {_fold_sql('name')} AS name_key FROM n""",
    "linkage_candidates": sql(_AB, f"{_CAND} SELECT a_id, b_id, name_sim, birth_eq, death_eq, sex_eq, birth_known, death_known, sex_known, unique_block FROM cand"),
    "linkage_tiers": sql(_AB, f"{_tier_sql()} SELECT a_id, b_id, score, tier FROM t"),
    "linkage_tiers_normalised": sql(_AB, f"{_tier_sql(True)} SELECT a_id, b_id, score, tier FROM t"),
    "tier_counts": sql(_AB, f"{_tier_sql()} SELECT v.tier, count(t.tier) AS n FROM (VALUES ('auto'), ('review'), ('none')) v(tier) LEFT JOIN t ON t.tier = v.tier GROUP BY v.tier"),
    "linkage_quality": sql(_AB, f"""{_tier_sql()}, {_TRUE}, f AS (SELECT a_id, b_id FROM t WHERE tier = 'review'),
n AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM truth) AS truth, (SELECT count(*) FROM f SEMI JOIN truth USING (a_id, b_id)) AS hits)
SELECT *, round(CASE WHEN found > 0 THEN hits / found ELSE 0 END, 9) AS precision, round(CASE WHEN truth > 0 THEN hits / truth ELSE 0 END, 9) AS recall FROM n"""),
    "linkage_sweep": sql(_AB, f"""{_tier_sql()}, {_TRUE}
SELECT CAST(x AS DOUBLE) AS auto_cut, CAST(y AS DOUBLE) AS review_cut, count(*) FILTER (score >= x) AS n_auto, count(*) FILTER (score >= y AND score < x) AS n_review, count(*) FILTER (score >= x AND truth.a_id IS NOT NULL) AS hits
FROM t LEFT JOIN truth USING (a_id, b_id) CROSS JOIN (VALUES (CAST(0.85 AS DOUBLE)), (0.9), (0.95)) u(x) CROSS JOIN (VALUES (CAST(0.65 AS DOUBLE)), (0.7), (0.75)) v(y) GROUP BY x, y"""),
    "compare_marriages": sql("relation person", f"""{_LINK}, ours AS (SELECT DISTINCT subject_id AS p1, object_id AS p2 FROM relation WHERE role = 'ejer'),
theirs AS (SELECT DISTINCT subject_id + 10000 AS p1, object_id + 10000 AS p2 FROM relation WHERE id % 2 = 0),
m AS (SELECT x.b_id AS p1, y.b_id AS p2 FROM ours LEFT JOIN link x ON x.a_id = p1 LEFT JOIN link y ON y.a_id = p2)
SELECT 'uden_for_scope' AS category, p1, p2 FROM m WHERE p1 IS NULL OR p2 IS NULL
UNION ALL SELECT CASE WHEN m.p1 IS NULL THEN 'mangler_hos_os' WHEN t.p1 IS NULL THEN 'ekstra_hos_os' ELSE 'enig' END, coalesce(m.p1, t.p1), coalesce(m.p2, t.p2) FROM (SELECT * FROM m WHERE p1 IS NOT NULL AND p2 IS NOT NULL) m FULL JOIN theirs t ON m.p1 = t.p1 AND m.p2 = t.p2"""),
    "compare_facts": sql(_AB, f"""x AS (SELECT a.id AS a_id, b.id AS b_id, NOT ({_OVER('birth', 'birth')}) OR NOT ({_OVER('death', 'death')}) AS d, a.sex <> 'ukendt' AND b.sex <> 'ukendt' AND a.sex <> b.sex AS s FROM record_a a JOIN record_b b ON b.id = a.id + 1)
SELECT a_id, b_id, 'dato_uenig' AS problem FROM x WHERE d UNION ALL SELECT a_id, b_id, 'køn_uenig' FROM x WHERE s"""),
    "corroboration": sql("parent_child person", f"""{_LINK}, o AS (SELECT DISTINCT child, parent FROM (SELECT child, unnest([father, mother]) AS parent FROM parent_child) WHERE child <> parent),
t AS (SELECT child + 10000 AS child, parent + 10000 AS parent FROM o WHERE child % 3 <> 0),
oa AS (SELECT child AS a_id, parent AS k, 'forælder' AS kind FROM o UNION SELECT parent, child, 'barn' FROM o), ta AS (SELECT child AS b_id, parent AS k, 'forælder' AS kind FROM t UNION SELECT parent, child, 'barn' FROM t),
r AS (SELECT id AS a_id, id + 10000 AS b_id FROM person WHERE id % 4 = 0),
h AS (SELECT r.a_id, r.b_id, oa.kind || ' ' || oa.k AS s FROM r JOIN oa USING (a_id) JOIN link ON link.a_id = oa.k JOIN ta ON ta.b_id = r.b_id AND ta.k = link.b_id AND ta.kind = oa.kind)
SELECT r.a_id, r.b_id, count(s) AS support, coalesce(string_agg(s, '; ' ORDER BY s), '') AS detail FROM r LEFT JOIN h USING (a_id, b_id) GROUP BY ALL"""),
    "review_merge": sql(_AB, f"""{_tier_sql()}, x AS (SELECT *, CASE WHEN b_id % 4 = 1 THEN ['bekræft', 'afvis', 'ny-id'][a_id % 3 + 1] END AS dec FROM t WHERE tier IN ('auto', 'review'))
SELECT a_id, CASE WHEN dec = 'ny-id' THEN b_id + 5 ELSE b_id END AS b_id, coalesce(dec, 'auto') AS origin FROM x WHERE dec IN ('bekræft', 'ny-id') OR dec IS NULL AND tier = 'auto'"""),
    "review_worklist": sql(_AB, f"""{_tier_sql()}, o AS (SELECT * FROM t WHERE score >= 0.7 AND (a_id + b_id) % 5 <> 0),
s AS (SELECT a_id, count(*) FILTER (score >= 0.9) AS strong, count(*) FILTER (score < 0.9) AS weak, first(b_id ORDER BY score DESC, b_id) AS best FROM o GROUP BY a_id)
SELECT p.a_id, CASE WHEN p.a_id % 70 = 0 THEN 'afklaret' WHEN s.a_id IS NOT NULL THEN 'aaben' ELSE 'formodet_ny' END AS status, coalesce(strong, 0) AS strong, coalesce(weak, 0) AS weak, best FROM (SELECT DISTINCT a_id FROM t) p LEFT JOIN s ON s.a_id = p.a_id"""),
    "inherited_sources": sql("anchor parent_child", """own AS (SELECT person_id AS person, source_id AS source FROM anchor WHERE person_id % 3 = 0),
p AS (SELECT father AS person, child AS partner FROM parent_child UNION ALL SELECT child, father FROM parent_child)
SELECT p.person, min(source) AS source FROM p JOIN own ON own.person = p.partner WHERE p.person NOT IN (SELECT person FROM own) GROUP BY p.person HAVING count(DISTINCT source) = 1"""),
    "match_records": sql("fact claim anchor", """n AS (SELECT f.subject_id AS person, c.id AS ord, CASE WHEN kind = 'title' THEN value END AS title, CASE WHEN kind = 'birth' THEN date_raw END AS birth, CASE WHEN kind = 'death' THEN date_raw END AS death FROM fact f JOIN claim c ON c.target_id = f.id),
t AS (SELECT person, coalesce(string_agg(DISTINCT title, ' · ' ORDER BY title), '') AS titles, arg_max(birth, ord) AS birth, arg_max(death, ord) AS death FROM n GROUP BY person),
r AS (SELECT person_id AS person, string_agg(line || ' ' || nr, ', ' ORDER BY line, nr) AS refs FROM (SELECT DISTINCT person_id, line, nr FROM anchor) GROUP BY person_id)
SELECT t.*, coalesce(refs, '') AS refs FROM t LEFT JOIN r USING (person)"""),
    "identity_register": sql("media", """r AS (SELECT width AS edition, byte_size % 400 AS page, count(*) AS n, min(id) AS id FROM media WHERE id % 3 <> 0 GROUP BY ALL), b AS (SELECT width AS edition, byte_size % 400 AS page, count(*) AS m FROM media WHERE id % 2 = 0 GROUP BY ALL),
x AS (SELECT coalesce(r.edition, b.edition) AS edition, coalesce(r.page, b.page) AS page, CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'new' WHEN n > 1 OR m > 1 THEN 'ambiguous' ELSE 'reuse' END AS action, id FROM r FULL JOIN b ON r.edition = b.edition AND r.page = b.page)
SELECT edition, page, action, CASE WHEN action = 'reuse' THEN id END AS id FROM x"""),
    "duplicate_records": sql("media", """m AS (SELECT id, CASE WHEN id % 4 <> 0 THEN id % 3 END AS year, sha, byte_size, width FROM media),
k AS (SELECT id, year, sha AS key, 'text' AS det FROM m UNION ALL SELECT id, year, byte_size || ':' || width, 'size' FROM m), c AS (SELECT *, min(id) OVER (PARTITION BY det, key, year) AS rep FROM k),
p AS (SELECT rep AS a, id AS b, det FROM c WHERE rep <> id UNION SELECT least(x.rep, y.rep), greatest(x.rep, y.rep), x.det FROM c x JOIN c y ON x.det = y.det AND x.key = y.key AND x.year IS NULL AND y.year IS NOT NULL)
SELECT a, b, string_agg(det, ',' ORDER BY det) AS detectors FROM p GROUP BY a, b"""),
    "place_matches": sql("place person", """ix AS (SELECT 'gaard' || id % 40 AS key, name AS place, CASE WHEN id % 3 = 0 THEN 55.5 ELSE lat END AS lat, CASE WHEN id % 3 = 0 THEN 9.5 ELSE lon END AS lon FROM place WHERE id % 3 = 0 OR lat IS NOT NULL),
tx AS (SELECT id, CASE WHEN id % 2 = 0 AND id % 60 < 40 THEN 'gård' ELSE 'gaard' END || id % 60 AS key FROM person),
sp AS (SELECT key, min(place) AS place, count(DISTINCT (round(lat, 3), round(lon, 3))) AS n FROM ix GROUP BY key),
ex AS (SELECT tx.id, tx.key, sp.place, n FROM tx LEFT JOIN sp USING (key)), tr AS (SELECT ex.id, ex.key, coalesce(ex.place, sp.place) AS place, coalesce(ex.n, sp.n) AS n, CASE WHEN ex.place IS NOT NULL THEN 'eksakt' WHEN sp.place IS NOT NULL THEN 'translit' END AS method
  FROM ex LEFT JOIN sp ON ex.place IS NULL AND replace(ex.key, 'å', 'aa') = replace(sp.key, 'å', 'aa')),
fz AS (SELECT t.key, sp.place, round(jaro_similarity(t.key, sp.key), 9) AS score FROM (SELECT DISTINCT key FROM tr WHERE method IS NULL) t JOIN sp ON jaro_similarity(t.key, sp.key) >= 0.92 QUALIFY row_number() OVER (PARTITION BY t.key ORDER BY score DESC, sp.place) = 1)
SELECT id, coalesce(tr.place, fz.place) AS place, CASE WHEN n = 1 THEN 'auto' WHEN n > 1 OR fz.place IS NOT NULL THEN 'review' ELSE 'none' END AS status,
 coalesce(method, CASE WHEN fz.place IS NOT NULL THEN 'fuzzy' END) AS method, CASE WHEN method IS NOT NULL THEN 1.0 ELSE score END AS score FROM tr LEFT JOIN fz USING (key)"""),
    "first_matches": sql("person relation", "SELECT p.id, p.name, r.role FROM person p LEFT JOIN (SELECT subject_id, role FROM relation QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY id) = 1) r ON r.subject_id = p.id"),
}
