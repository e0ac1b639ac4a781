"""Evidence queries on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.dates import fuzzy_date
from stemma.operators import evidence as E

from .tables import role, sql


def _roles(spark, d, names):
    return [role(spark, d, n) for n in names.split()]


def evidence_display(spark, d):
    fact, conclusion, claim = _roles(spark, d, "fact conclusion claim")
    bad = E.conflicts(fact, claim, ["name", "title"]).groupBy("subject_id").agg(F.count("*").alias("n_conflicts"))
    return E.display(fact, conclusion, claim).join(bad, "subject_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))


def evidence_conflicts(spark, d):
    fact, claim = _roles(spark, d, "fact claim")
    return E.conflicts(fact, claim, ["name", "title"])


def evidence_settled(spark, d):
    return E.settled_rollup(E.settled(*_roles(spark, d, "fact conclusion claim")))


def evidence_claims(spark, d):
    return E.claims_per_fact(*_roles(spark, d, "fact claim conclusion"))


def evidence_provenance(spark, d):
    return E.provenance(*_roles(spark, d, "fact claim citation source"))


def evidence_merge_sources(spark, d):
    fact, claim, citation, source = _roles(spark, d, "fact claim citation source")
    n = role(spark, d, "narrative").select("person_id", "source_id", "text").groupBy("person_id", "source_id").agg(F.max("text").alias("text"))
    m = role(spark, d, "relation").select(F.col("object_id").alias("person_id"), (F.col("id") % 7).alias("source_id"), F.col("role").alias("text")).groupBy("person_id", "source_id").agg(F.max("text").alias("text"))
    return E.merge_sources(n, m, ["person_id", "source_id"], "text")


def full_names(spark, d):
    names = E.display(*_roles(spark, d, "fact conclusion claim")).select("subject_id", "name")
    names = names.withColumn("name", F.when(F.col("subject_id") % 4 == 0, F.concat("name", F.lit(" Von–Berg"))).otherwise(F.col("name")))
    surnames = role(spark, d, "anchor").select(F.col("person_id").alias("subject_id"), F.when(F.col("line") < "3", "von-berg").otherwise("von  Lund").alias("surname"))
    return E.full_names(names, surnames)


def preferred_text(spark, d):
    return E.preferred_text(role(spark, d, "narrative"))


def text_versions(spark, d):
    return E.text_versions(role(spark, d, "narrative"))


def fuzzy_dates(spark, d):
    return role(spark, d, "raw_date").select("id", fuzzy_date(F.col("raw")).alias("f")).select("id", F.col("f.min").alias("min_day"), F.col("f.max").alias("max_day"), F.col("f.qualifier").alias("qualifier"), F.col("f.certainty").alias("certainty"), F.col("f.understood").alias("understood"))


def _grid(spark, d):
    frames = _roles(spark, d, "person anchor source fact conclusion claim citation")
    same = role(spark, d, "person").where("id % 20 = 7").select(F.col("id").alias("alias"), (F.col("id") - 1).alias("canonical"))
    journal = role(spark, d, "anchor").join(frames[2].select(F.col("id").alias("source_id"), "import_key"), "source_id").where("nr % 3 = 0 AND record_key IS NOT NULL AND import_key IS NOT NULL")
    journal = journal.select("import_key", "record_key", F.lit("koen").alias("field"), F.md5(F.concat_ws("\x1f", "import_key", "record_key", F.lit("koen"), F.lit("mand"), F.lit(""))).alias("fingerprint"), F.lit("mand").alias("imported"), F.when(F.col("nr") % 2 == 0, "kvinde").alias("corrected"), F.when(F.col("nr") % 2 == 0, "rettet").otherwise("godkendt").alias("status"))
    return E.quality_grid(*frames, same, journal, role(spark, d, "member"), role(spark, d, "relation"))


def _flat(grid):
    """Maps and lists as text, for comparison."""
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")
    maps = ("fingerprints", "imported", "corrected", "contexts", "pages", "states", "editable", "blockers")
    return grid.withColumns({m: text(m) for m in maps} | {"codes": F.array_join("codes", ";")})


def quality_grid(spark, d):
    return _flat(_grid(spark, d))


def quality_grid_open(spark, d):
    return E.filter_grid(_grid(spark, d), "aabne", query="#0", same_as=False, staged=False).select("person_id", F.array_join("codes", ";").alias("codes"))


def quality_grid_sorted(spark, d):
    rows = E.sort_grid(_grid(spark, d), "born_min", descending=True).select("person_id", "born_min").limit(100)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("born_min"), "person_id")).cast("long"))  # a page of 100


def parent_conflicts(spark, d):
    fact = role(spark, d, "fact").withColumn("kind", F.when(F.col("kind") == "title", "parents").otherwise(F.col("kind")))
    claim = role(spark, d, "claim").select("target_id", F.when(F.col("id") % 4 != 0, F.col("id") % 5).alias("family_id"))
    return E.parent_conflicts(fact, claim, role(spark, d, "conclusion"))


QUERIES = {f.__name__: f for f in (evidence_display, evidence_conflicts, evidence_settled, evidence_claims, evidence_provenance, evidence_merge_sources, full_names, preferred_text, text_versions, fuzzy_dates, quality_grid, quality_grid_open, quality_grid_sorted, parent_conflicts)}

_CHAIN = """chain AS (SELECT f.id AS fact_id, f.subject_id, f.kind, k.status, a.id AS claim_id, a.value, a.date_raw, a.date_min, a.date_max, a.qualifier
  FROM fact f JOIN conclusion k ON k.target_type = 'fact' AND k.target_id = f.id JOIN claim a ON a.id = k.chosen_id)"""
_CONFLICT = """conflict AS (SELECT f.id AS fact_id, f.subject_id, f.kind, count(DISTINCT a.value) AS n_values
  FROM fact f JOIN claim a ON a.target_type = 'fact' AND a.target_id = f.id WHERE f.kind IN ('name', 'title') GROUP BY ALL HAVING count(DISTINCT a.value) > 1)"""
_SHOWN = """SELECT subject_id, max(value) FILTER (kind = 'name') AS name, max(coalesce(date_raw, value)) FILTER (kind = 'birth') AS born,
  max(coalesce(date_raw, value)) FILTER (kind = 'death') AS died, max(value) FILTER (kind = 'title') AS title FROM chain GROUP BY subject_id"""
_SETTLED = """settled AS (SELECT subject_id AS person_id, CASE kind WHEN 'name' THEN 'navn' WHEN 'birth' THEN 'foedsel' ELSE 'doed' END AS field, claim_id, value, date_raw, date_min, date_max, qualifier
  FROM chain WHERE status = 'afklaret' AND kind IN ('name', 'birth', 'death'))"""
_ONE = lambda c: f"CASE WHEN count(DISTINCT claim_id) = 1 THEN min({c}) END AS {c}"
_YEAR = "CAST(year(o_orderdate) AS VARCHAR)"

_GRID = f"""{_CHAIN}, {_SETTLED},
found AS (SELECT person_id, count(*) AS anchors, count(*) FILTER (s.import_key IS NOT NULL AND record_key IS NOT NULL) AS stable, max(s.import_key) AS import_key, max(record_key) AS record_key,
  max(source_id) AS source_id, max(s.title) AS source_title, max(s.edition) AS source_edition, max(line) AS line, max(nr) AS nr, max(generation) AS generation FROM anchor a LEFT JOIN source s ON s.id = a.source_id GROUP BY person_id),
people AS (SELECT p.id AS person_id, p.sex, p.living, p.private, p.staged, p.status, coalesce(anchors, 0) AS anchors, coalesce(stable, 0) AS stable, import_key, record_key, source_id, source_title, source_edition, f.line, nr, generation
  FROM person p LEFT JOIN found f ON f.person_id = p.id),
cited AS (SELECT claim_id, source_id, arg_min_null(quote, id) AS context, arg_min(page, id) AS page, bool_or(coalesce(trim(quote) <> '', false)) AS told FROM citation GROUP BY ALL),
at_anchor AS (SELECT s.*, c.context, c.page, c.told FROM settled s JOIN people p ON p.person_id = s.person_id AND p.anchors = 1 AND p.stable = 1
  LEFT JOIN cited c ON c.claim_id = s.claim_id AND c.source_id = p.source_id),
cand AS (SELECT person_id, field, count(DISTINCT claim_id) AS candidates, {', '.join(_ONE(c) for c in ('value', 'date_raw', 'date_min', 'date_max', 'qualifier', 'context', 'page'))},
  CASE WHEN count(DISTINCT claim_id) = 1 THEN min(claim_id) END AS one_id FROM at_anchor WHERE told IS NOT NULL GROUP BY person_id, field),
shown AS (SELECT person_id, field, {', '.join(_ONE(c) for c in ('value', 'date_raw', 'date_min', 'date_max', 'qualifier'))} FROM settled GROUP BY person_id, field),
journal AS (SELECT s.import_key, a.record_key, 'koen' AS field, md5(concat_ws(chr(31), s.import_key, a.record_key, 'koen', 'mand', '')) AS noted, CASE WHEN nr % 2 = 0 THEN 'rettet' ELSE 'godkendt' END AS noted_status, 'mand' AS imported, CASE WHEN nr % 2 = 0 THEN 'kvinde' END AS corrected
  FROM anchor a JOIN source s ON s.id = a.source_id WHERE nr % 3 = 0 AND record_key IS NOT NULL AND s.import_key IS NOT NULL),
x AS (SELECT p.*, v.field, CASE WHEN v.field = 'koen' THEN p.sex ELSE c.value END AS value, c.candidates, c.date_raw, c.date_min, c.date_max, c.qualifier, c.context, c.page, c.one_id,
  sh.value AS s_value, sh.date_raw AS s_raw, sh.date_min AS s_min, sh.date_max AS s_max, sh.qualifier AS s_qualifier, j.noted, j.noted_status, j.corrected,
  coalesce(j.imported, CASE WHEN v.field = 'koen' THEN p.sex WHEN v.field = 'navn' THEN c.value WHEN c.candidates = 1 THEN concat_ws('/', c.date_raw, CAST(c.date_min AS VARCHAR), CAST(c.date_max AS VARCHAR)) END) AS imported
  FROM people p CROSS JOIN (VALUES ('navn'), ('foedsel'), ('doed'), ('koen')) v(field) LEFT JOIN cand c ON c.person_id = p.person_id AND c.field = v.field
  LEFT JOIN shown sh ON sh.person_id = p.person_id AND sh.field = v.field LEFT JOIN journal j ON j.import_key = p.import_key AND j.record_key = p.record_key AND j.field = v.field),
y AS (SELECT *, CASE WHEN anchors = 1 AND stable = 1 AND (field = 'koen' OR candidates = 1) THEN md5(concat_ws(chr(31), coalesce(import_key, ''), coalesce(record_key, ''), field, coalesce(imported, ''), coalesce(context, ''))) END AS print FROM x),
st AS (SELECT *, CASE WHEN noted_status IS NULL THEN 'aaben' WHEN print IS DISTINCT FROM noted THEN 'stale' ELSE noted_status END AS state,
  CASE WHEN anchors = 0 THEN 'ingen_importanker' WHEN anchors <> 1 THEN 'flere_importankre' WHEN stable <> 1 AND import_key IS NULL THEN 'import_key_mangler' WHEN stable <> 1 THEN 'record_key_mangler'
    WHEN field = 'koen' THEN NULL WHEN coalesce(candidates, 0) = 0 THEN 'ingen_kildebelagt_assertion' WHEN candidates > 1 THEN 'flere_importerede_facts' END AS blocker FROM y),
g AS (SELECT person_id, {', '.join(f"coalesce(max({a}) FILTER (field = '{f}'), max(s_{b}) FILTER (field = '{f}')) AS {out}" for f, out, a, b in [('navn', 'name', 'value', 'value')] + [(f, t + '_' + b, a, b) for f, t in (('foedsel', 'born'), ('doed', 'died')) for a, b in (('date_raw', 'raw'), ('date_min', 'min'), ('date_max', 'max'), ('qualifier', 'qualifier'))])},
  {', '.join(f"max(one_id) FILTER (field = '{f}') AS {t}_claim" for f, t in (('navn', 'name'), ('foedsel', 'born'), ('doed', 'died')))},
  {', '.join(f"coalesce(string_agg(field || '=' || {c}, ';' ORDER BY field || '=' || {c}), '') AS {out}" for c, out in (('print', 'fingerprints'), ('imported', 'imported'), ('corrected', 'corrected'), ('context', 'contexts'), ('page', 'pages'), ('state', 'states'), ("CAST(blocker IS NULL AS VARCHAR)", 'editable'), ('blocker', 'blockers')))},
  bool_or(coalesce(regexp_matches(context, '[?]'), false)) AS r1, coalesce(max(date_min) FILTER (field = 'foedsel') > max(date_max) FILTER (field = 'doed'), false) AS r3, bool_or(field = 'navn' AND coalesce(trim(value) <> trim(context), false)) AS r4,
  bool_or(anchors = 1 AND stable = 0 AND record_key IS NULL) AS r6, bool_or(coalesce(candidates > 1, false)) AS r8, bool_or(state = 'stale') AS r9 FROM st GROUP BY person_id),
vague AS (SELECT person_id, bool_or(date_raw IS NOT NULL AND date_min IS NULL AND date_max IS NULL) AS r2 FROM settled WHERE field <> 'navn' GROUP BY person_id),
untold AS (SELECT person_id, bool_or(NOT coalesce(told, false)) AS r7 FROM at_anchor GROUP BY person_id),
same AS (SELECT person_id, canonical, CASE prio WHEN 1 THEN 'alias' ELSE 'kanonisk' END AS same_as FROM (SELECT id AS person_id, id - 1 AS canonical, 1 AS prio FROM person WHERE id % 20 = 7
  UNION ALL SELECT id - 1, id - 1, 2 FROM person WHERE id % 20 = 7) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY prio, canonical) = 1),
titles AS (SELECT subject_id AS person_id, count(*) AS titles FROM fact WHERE kind = 'title' GROUP BY subject_id),
families AS (SELECT person_id, count(DISTINCT family_id) AS families FROM member GROUP BY person_id),
relations AS (SELECT person_id, count(DISTINCT id) AS relations FROM (SELECT subject_id AS person_id, id FROM relation UNION ALL SELECT object_id, id FROM relation) GROUP BY person_id),
told AS (SELECT f.subject_id AS person_id, count(DISTINCT a.id) AS cited_claims FROM fact f JOIN claim a ON a.target_id = f.id JOIN citation c ON c.claim_id = a.id GROUP BY f.subject_id),
q AS (SELECT g.*, canonical, same_as, coalesce(titles, 0) AS titles, coalesce(families, 0) AS families, coalesce(relations, 0) AS relations, CAST(coalesce(cited_claims, 0) AS BIGINT) AS cited_claims,
  list_sort(list_filter([CASE WHEN r1 THEN 'mistænkeligt_ocr_tegn' END, CASE WHEN coalesce(r2, false) THEN 'dato_ufortolkelig' END, CASE WHEN r3 THEN 'foedt_efter_doed' END, CASE WHEN r4 THEN 'struktureret_afviger_fra_ocr' END,
   CASE WHEN coalesce(trim(name), '') = '' THEN 'navn_mangler' END, CASE WHEN r6 THEN 'record_key_mangler' END, CASE WHEN coalesce(r7, false) THEN 'ocr_kontekst_mangler' END, CASE WHEN r8 THEN 'flere_importerede_facts' END, CASE WHEN r9 THEN 'kilde_aendret' END], lambda z: z IS NOT NULL)) AS c,
  coalesce(r2, false) OR r3 OR coalesce(trim(name), '') = '' OR r6 OR r8 AS bad
  FROM g LEFT JOIN vague USING (person_id) LEFT JOIN untold USING (person_id) LEFT JOIN same USING (person_id) LEFT JOIN titles USING (person_id) LEFT JOIN families USING (person_id) LEFT JOIN relations USING (person_id) LEFT JOIN told USING (person_id)),
grid AS (SELECT person_id, import_key, record_key, source_id, source_title, source_edition, line, nr, generation, name, name_claim, born_raw, born_min, born_max, born_qualifier, born_claim, died_raw, died_min, died_max, died_qualifier, died_claim,
  fingerprints, imported, corrected, contexts, pages, sex, living, private, staged, status, canonical, same_as, titles, families, relations, cited_claims, array_to_string(c, ';') AS codes, CASE WHEN bad THEN 'fejl' WHEN len(c) > 0 THEN 'advarsel' END AS severity, states, editable, blockers
  FROM q JOIN (SELECT person_id, import_key, record_key, source_id, source_title, source_edition, line, nr, generation, sex, living, private, staged, status FROM people) USING (person_id))"""
_GRID_OF = "person anchor source fact conclusion claim citation member relation"

SQL = {
    "evidence_display": sql("fact conclusion claim", f"""{_CHAIN}, {_CONFLICT}, shown AS ({_SHOWN}),
bad AS (SELECT subject_id, count(*) AS n_conflicts FROM conflict GROUP BY subject_id)
SELECT shown.*, coalesce(n_conflicts, 0) AS n_conflicts FROM shown LEFT JOIN bad USING (subject_id)"""),
    "evidence_conflicts": sql("fact claim", f"{_CONFLICT} SELECT * FROM conflict"),
    "evidence_settled": sql("fact conclusion claim", f"{_CHAIN}, {_SETTLED} SELECT person_id, field, {_ONE('value')}, {_ONE('date_raw')}, {_ONE('date_min')}, {_ONE('date_max')} FROM settled GROUP BY person_id, field"),
    "evidence_claims": sql("fact claim conclusion", """c AS (SELECT target_id, count(*) AS n, string_agg(DISTINCT nullif(trim(value), ''), '|' ORDER BY nullif(trim(value), '')) AS v FROM claim GROUP BY target_id)
SELECT f.id AS fact_id, f.subject_id, f.kind, coalesce(n, 0) AS n_claims, coalesce(contains(v, '|'), false) AS disagree, k.chosen_id, coalesce(v, '') AS "values"
FROM fact f LEFT JOIN c ON c.target_id = f.id LEFT JOIN conclusion k ON k.target_id = f.id"""),
    "evidence_provenance": sql("fact claim citation source", """r AS (SELECT DISTINCT f.subject_id, concat_ws(', ', s.title, s.edition) AS work, c.page AS ref
  FROM fact f JOIN claim a ON a.target_id = f.id JOIN citation c ON c.claim_id = a.id JOIN source s ON s.id = c.source_id)
SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY work, coalesce(TRY_CAST(regexp_extract(ref, '\\d+') AS BIGINT), 4611686018427387904), ref) AS place FROM r"""),
    "evidence_merge_sources": sql("narrative relation", """a AS (SELECT person_id, source_id, max(text) AS t FROM narrative GROUP BY ALL),
b AS (SELECT object_id AS person_id, id % 7 AS source_id, max(role) AS t FROM relation GROUP BY ALL)
SELECT coalesce(a.person_id, b.person_id) AS person_id, coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN trim(a.t) <> '' THEN a.t ELSE b.t END AS text
FROM a FULL JOIN b ON a.person_id = b.person_id AND a.source_id = b.source_id"""),
    "full_names": sql("fact conclusion claim anchor", f"""{_CHAIN}, shown AS ({_SHOWN}),
n AS (SELECT subject_id, CASE WHEN subject_id % 4 = 0 THEN name || ' Von–Berg' ELSE name END AS name FROM shown),
s AS (SELECT person_id AS subject_id, count(DISTINCT line < '3') AS k, min(CASE WHEN line < '3' THEN 'von-berg' ELSE 'von  Lund' END) AS surname FROM anchor GROUP BY person_id),
x AS (SELECT n.*, k, surname, name IS NOT NULL AND k = 1 AND NOT (surname = 'von-berg' AND subject_id % 4 = 0) AS add_it FROM n LEFT JOIN s USING (subject_id))
SELECT subject_id, CASE WHEN add_it THEN surname END AS surname, CASE WHEN add_it THEN name || ' ' || surname ELSE name END AS full_name, coalesce(k, 0) > 1 AS quarantined FROM x"""),
    "preferred_text": sql("narrative", """SELECT person_id, id, source_id, year, text FROM narrative WHERE source_kind = 'edition' AND trim(text) <> ''
QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY year DESC NULLS LAST, source_id DESC, id DESC) = 1"""),
    "text_versions": sql("narrative", """r AS (SELECT person_id, source_id, trim(text) AS text, min(id) AS id FROM narrative WHERE trim(text) <> '' GROUP BY ALL)
SELECT person_id, source_id, string_agg(text, chr(10) || chr(10) ORDER BY id) AS text, count(*) AS n_texts FROM r GROUP BY person_id, source_id"""),
    "fuzzy_dates": f"""WITH y AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, {_YEAR} AS y, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS dd, CAST(year(o_orderdate) + 3 AS VARCHAR) AS y3 FROM orders)
SELECT id, CASE k WHEN 0 THEN day WHEN 2 THEN NULL WHEN 6 THEN y || '-05-' || dd WHEN 7 THEN '1905-01-01' ELSE y || '-01-01' END AS min_day,
  CASE k WHEN 0 THEN day WHEN 3 THEN NULL WHEN 4 THEN y3 || '-12-31' WHEN 6 THEN y || '-05-' || dd WHEN 7 THEN '1995-12-31' ELSE y || '-12-31' END AS max_day,
  CASE k WHEN 1 THEN 'about' WHEN 2 THEN 'before' WHEN 3 THEN 'after' WHEN 4 THEN 'between' WHEN 5 THEN 'floruit' END AS qualifier,
  CASE WHEN k = 7 THEN 'uncertain' END AS certainty, true AS understood FROM y""",
    "quality_grid": sql(_GRID_OF, f"{_GRID} SELECT * FROM grid"),
    "quality_grid_open": sql(_GRID_OF, f"""{_GRID} SELECT person_id, codes FROM grid WHERE codes <> '' AND regexp_matches(states, '=(aaben|stale)') AND same_as IS NULL AND NOT staged
 AND (contains(lower(coalesce(name, '')), '#0') OR contains(lower(coalesce(record_key, '')), '#0') OR contains(lower(coalesce(source_title, '')), '#0') OR contains(lower(coalesce(line, '')), '#0') OR contains(CAST(person_id AS VARCHAR), '#0'))"""),
    "quality_grid_sorted": sql(_GRID_OF, f"{_GRID} SELECT person_id, born_min, row_number() OVER (ORDER BY born_min DESC NULLS LAST, person_id) AS place FROM grid QUALIFY place <= 100"),
    "parent_conflicts": sql("fact claim conclusion", """n AS (SELECT f.subject_id AS person_id, f.id AS fact_id, count(DISTINCT a.id % 5) AS n_families, count(*) AS n_claims FROM fact f JOIN claim a ON a.target_id = f.id AND a.id % 4 <> 0 WHERE f.kind = 'title' GROUP BY ALL HAVING count(DISTINCT a.id % 5) > 1)
SELECT n.*, k.status FROM n LEFT JOIN (SELECT target_id, max(status) AS status FROM conclusion GROUP BY target_id) k ON k.target_id = n.fact_id"""),
}
