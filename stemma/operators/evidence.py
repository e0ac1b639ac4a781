"""Competing claims about facts: concluded values, conflicts, provenance and the quality grid.

All operators take role-mapped frames: fact (id, subject_type, subject_id,
kind), claim (id, target_type, target_id, value, date_raw, date_min, date_max),
conclusion (target_type, target_id, chosen_id, status), citation (id, claim_id,
source_id, page, quote), source (id, title, edition, year, import_key), anchor
(person_id, source_id, record_key, line, nr).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import danish_key, ends_with_words, fingerprint
from stemma.plans.stages import keep_first, materialise

# The grid's fields, and rule names with their severity.
FIELDS = {"name": "navn", "birth": "foedsel", "death": "doed"}
RULES = {
    "mistænkeligt_ocr_tegn": "advarsel", "dato_ufortolkelig": "fejl", "foedt_efter_doed": "fejl", "struktureret_afviger_fra_ocr": "advarsel",
    "navn_mangler": "fejl", "record_key_mangler": "fejl", "ocr_kontekst_mangler": "advarsel", "flere_importerede_facts": "fejl", "kilde_aendret": "advarsel",
}


def concluded(fact: DataFrame, conclusion: DataFrame, claim: DataFrame) -> DataFrame:
    """fact_id, subject_id, kind, status and the chosen claim's columns: the evidence chain."""
    f = fact.select(F.col("id").alias("fact_id"), "subject_id", "kind")
    c = conclusion.where("target_type = 'fact'").select(F.col("target_id").alias("fact_id"), F.col("chosen_id").alias("claim_id"), "status")
    a = claim.select(F.col("id").alias("claim_id"), "value", "date_raw", "date_min", "date_max", "qualifier")
    return f.join(c, "fact_id").join(a, "claim_id")


def conflicts(fact: DataFrame, claim: DataFrame, kinds: list[str]) -> DataFrame:
    """Facts of the kinds whose claims differ: fact_id, subject_id, kind, n_values. Null values don't count."""
    n = claim.where("target_type = 'fact'").groupBy(F.col("target_id").alias("fact_id")).agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
    return fact.where(F.col("kind").isin(kinds)).select(F.col("id").alias("fact_id"), "subject_id", "kind").join(n, "fact_id")


def display(fact: DataFrame, conclusion: DataFrame, claim: DataFrame) -> DataFrame:
    """One row per subject: the largest concluded value of every kind, whatever the conclusion's status. Dates show as written, or else as the value."""
    said = F.coalesce("date_raw", "value")
    of = lambda kind, what: F.max(F.when(F.col("kind") == kind, what))
    return concluded(fact, conclusion, claim).groupBy("subject_id").agg(
        of("name", F.col("value")).alias("name"), of("birth", said).alias("born"), of("death", said).alias("died"), of("title", F.col("value")).alias("title"))


def full_names(names: DataFrame, surnames: DataFrame) -> DataFrame:
    """names: subject_id, name; surnames: subject_id, surname (any number). A single surname is added unless the name ends with it; several are a reason for quarantine."""
    s = surnames.groupBy("subject_id").agg(F.count_distinct("surname").alias("n"), F.min("surname").alias("surname"))
    add = F.col("name").isNotNull() & (F.col("n") == 1) & ~ends_with_words(F.col("name"), F.col("surname"))
    return names.join(s, "subject_id", "left").select(
        "subject_id", F.when(add, F.col("surname")).alias("surname"), F.when(add, F.concat_ws(" ", "name", "surname")).otherwise(F.col("name")).alias("full_name"),
        (F.coalesce("n", F.lit(0)) > 1).alias("quarantined"))


def _single(what: str) -> Column:
    return F.when(F.count_distinct("claim_id") == 1, F.min(what)).alias(what)


def settled(fact: DataFrame, conclusion: DataFrame, claim: DataFrame) -> DataFrame:
    """Per subject and field the settled value, where exactly one claim is settled on; null where there are several."""
    rows = concluded(fact, conclusion, claim).where((F.col("status") == "afklaret") & F.col("kind").isin(list(FIELDS)))
    field = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in FIELDS.items()])
    return rows.select(F.col("subject_id").alias("person_id"), field.alias("field"), "claim_id", "value", "date_raw", "date_min", "date_max", "qualifier")


def settled_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("person_id", "field").agg(*[_single(c) for c in ("value", "date_raw", "date_min", "date_max")])


def claims_per_fact(fact: DataFrame, claim: DataFrame, conclusion: DataFrame) -> DataFrame:
    """fact_id, subject_id, kind, n_claims, disagree (more than one different non-blank value), chosen_id, values (sorted)."""
    text = F.nullif(F.trim("value"), F.lit(""))
    c = claim.where("target_type = 'fact'").groupBy(F.col("target_id").alias("fact_id")).agg(F.count("*").alias("n_claims"), F.array_join(F.array_sort(F.collect_set(text)), "|").alias("values"))
    k = conclusion.where("target_type = 'fact'").select(F.col("target_id").alias("fact_id"), "chosen_id")
    f = fact.select(F.col("id").alias("fact_id"), "subject_id", "kind")
    return f.join(c, "fact_id", "left").join(k, "fact_id", "left").select(
        "fact_id", "subject_id", "kind", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce(F.instr("values", "|") > 0, F.lit(False)).alias("disagree"), "chosen_id", F.coalesce("values", F.lit("")).alias("values"))


def provenance(fact: DataFrame, claim: DataFrame, citation: DataFrame, source: DataFrame) -> DataFrame:
    """subject_id, work, ref, place: the works that any claim about a subject cites, once each, by work, page number and reference."""
    from pyspark.sql.window import Window

    f = fact.select(F.col("id").alias("target_id"), "subject_id")
    a = claim.select(F.col("id").alias("claim_id"), "target_id")
    s = source.select(F.col("id").alias("source_id"), F.concat_ws(", ", "title", "edition").alias("work"))
    rows = f.join(a, "target_id").join(citation.select("claim_id", "source_id", F.col("page").alias("ref")), "claim_id").join(s, "source_id")
    page = F.coalesce(F.nullif(F.regexp_extract("ref", r"\d+", 0), F.lit("")).cast("long"), F.lit((1 << 62)))
    by = Window.partitionBy("subject_id").orderBy("work", page, "ref")
    # Equal rows are peers of the sort, and only the first has its rank as its number: no hash table of nearly all rows.
    placed = rows.select("subject_id", "work", "ref", F.dense_rank().over(by).cast("long").alias("place"), (F.rank().over(by) == F.row_number().over(by)).alias("_first"))
    return placed.where("_first").drop("_first")


def merge_sources(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The first frame's value where it isn't blank, else the second's."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.when(F.trim("_a") != "", F.col("_a")).otherwise(F.col("_b")).alias(value))


def preferred_text(narrative: DataFrame) -> DataFrame:
    """One narrative per person: of the editions' non-blank texts the newest year, then the largest source and id."""
    rows = narrative.where("source_kind = 'edition' AND trim(text) <> ''")
    return keep_first(rows, ["person_id"], F.desc_nulls_last("year"), F.desc("source_id"), F.desc("id")).select("person_id", "id", "source_id", "year", "text")


def text_versions(narrative: DataFrame) -> DataFrame:
    """One row per person and source: the different texts in order of arrival, joined by a blank line."""
    rows = narrative.where("trim(text) <> ''").groupBy("person_id", "source_id", F.trim("text").alias("text")).agg(F.min("id").alias("id"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
    return rows.groupBy("person_id", "source_id").agg(F.array_join(texts, "\n\n").alias("text"), F.count("*").alias("n_texts"))


def parent_conflicts(fact: DataFrame, claim: DataFrame, conclusion: DataFrame, kind: str = "parents") -> DataFrame:
    """Facts about the parents whose claims name more than one family: person_id, fact_id, n_families, n_claims, status. claim: target_id, family_id (null: names none)."""
    named = claim.where("family_id IS NOT NULL").groupBy(F.col("target_id").alias("fact_id")).agg(F.count_distinct("family_id").alias("n_families"), F.count("*").alias("n_claims")).where("n_families > 1")
    status = conclusion.where("target_type = 'fact'").groupBy(F.col("target_id").alias("fact_id")).agg(F.max("status").alias("status"))
    rows = fact.where(F.col("kind") == kind).select(F.col("id").alias("fact_id"), F.col("subject_id").alias("person_id")).join(named, "fact_id")
    return rows.join(status, "fact_id", "left").select("person_id", "fact_id", "n_families", "n_claims", "status")


#: What is shown of a field, and what else its candidate has.
_SHOWN = ["value", "date_raw", "date_min", "date_max", "qualifier"]


def quality_grid(person: DataFrame, anchor: DataFrame, source: DataFrame, fact: DataFrame, conclusion: DataFrame, claim: DataFrame, citation: DataFrame, same_as: DataFrame, journal: DataFrame, member: DataFrame, relation: DataFrame) -> DataFrame:
    """One row per person: shown values, editability, review state and quality rules; the columns with a value per field are maps.

    claim has a qualifier, anchor a generation, person a status. same_as:
    alias, canonical. journal: import_key, record_key, field, fingerprint,
    imported, corrected, status. member: family_id, person_id. relation: id,
    subject_id, object_id, of persons. A field can be corrected only for a
    person with one anchor, a stable one, and one cited claim of the anchor's
    source. One aggregate per person holds all that claims say about its
    fields; every other side is aggregated to a row per person before it is
    joined, so no join multiplies rows.
    """
    c = F.col
    s = source.select(c("id").alias("source_id"), "import_key", "title", "edition")
    found = anchor.join(s, "source_id", "left").groupBy("person_id").agg(
        F.count("*").alias("anchors"), F.count_if(c("import_key").isNotNull() & c("record_key").isNotNull()).alias("stable"), F.max("import_key").alias("import_key"), F.max("record_key").alias("record_key"), F.max("source_id").alias("source_id"),
        F.max("title").alias("source_title"), F.max("edition").alias("source_edition"), F.max("line").alias("line"), F.max("nr").alias("nr"), F.max("generation").alias("generation"))
    people = person.select(c("id").alias("person_id"), "sex", "living", "private", "staged", "status").join(found, "person_id", "left").fillna(0, ["anchors", "stable"])
    people = materialise(people, "grid-people")

    # What the settled claims say, and what their citations in the anchor's source add.
    quoted = materialise(citation.groupBy("claim_id", "source_id").agg(F.min_by("quote", "id").alias("context"), F.min_by("page", "id").alias("page"), F.max(F.coalesce(F.trim("quote") != "", F.lit(False))).alias("told")), "grid-cited")
    chosen = settled(fact, conclusion, claim).join(people.where("anchors = 1 AND stable = 1").select("person_id", c("source_id").alias("anchor_id")), "person_id", "left")
    at = quoted.select(c("claim_id").alias("_c"), c("source_id").alias("_s"), "context", "page", "told")
    chosen = chosen.join(at, (c("claim_id") == c("_c")) & (c("anchor_id") == c("_s")), "left")
    sums = []
    for f in FIELDS.values():
        here, cited = c("field") == f, (c("field") == f) & c("told").isNotNull()
        for tag, when, columns in (("s", here, _SHOWN), ("c", cited, [*_SHOWN, "context", "page"])):
            sums += [F.min(F.when(when, c("claim_id"))).alias(f"{f}_{tag}_lo"), F.max(F.when(when, c("claim_id"))).alias(f"{f}_{tag}_hi"), *[F.min(F.when(when, c(x))).alias(f"{f}_{tag}_{x}") for x in columns]]
    vague = (c("field") != "navn") & c("date_raw").isNotNull() & c("date_min").isNull() & c("date_max").isNull()
    said = chosen.groupBy("person_id").agg(*sums, F.max(vague).alias("vague"), F.max(c("anchor_id").isNotNull() & ~F.coalesce("told", F.lit(False))).alias("untold"))

    alias = same_as.select(c("alias").alias("person_id"), "canonical", F.lit(1).alias("prio")).union(same_as.select("canonical", "canonical", F.lit(2)))
    identity = alias.groupBy("person_id").agg(F.min(F.struct("prio", "canonical")).alias("x")).select("person_id", "x.canonical", F.when(c("x.prio") == 1, "alias").otherwise("kanonisk").alias("same_as"))
    titles = fact.where("kind = 'title'").groupBy(c("subject_id").alias("person_id")).agg(F.count("*").alias("titles"))
    families = member.groupBy("person_id").agg(F.count_distinct("family_id").alias("families"))
    ends = relation.select("id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("person_id")).where("person_id IS NOT NULL")
    relations = ends.groupBy("person_id").agg(F.count_distinct("id").alias("relations"))
    told = claim.select("target_id", c("id").alias("claim_id")).join(quoted.select("claim_id"), "claim_id", "left_semi").groupBy("target_id").agg(F.count("*").alias("n"))
    told = told.join(fact.select(c("id").alias("target_id"), c("subject_id").alias("person_id")), "target_id").groupBy("person_id").agg(F.sum("n").alias("cited_claims"))
    notes = journal.groupBy("import_key", "record_key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("fingerprint", "imported", "corrected", "status")))).alias("notes"))
    rows = people
    for side in (said, identity, titles, families, relations, told):
        rows = rows.join(side, "person_id", "left")
    rows = rows.join(notes, ["import_key", "record_key"], "left")

    one = lambda f, tag: c(f"{f}_{tag}_lo") == c(f"{f}_{tag}_hi")
    own = lambda f, x: F.when(one(f, "c"), c(f"{f}_c_{x}"))
    shown = lambda f, x: F.coalesce(own(f, x), F.when(one(f, "s"), c(f"{f}_s_{x}")))
    anchored = (c("anchors") == 1) & (c("stable") == 1)
    states, blockers, prints, imported, corrected, contexts, pages = {}, {}, {}, {}, {}, {}, {}
    for f in [*FIELDS.values(), "koen"]:
        sex, note = f == "koen", F.try_element_at("notes", F.lit(f))
        contexts[f], pages[f] = (F.lit(None).cast("string"),) * 2 if sex else (own(f, "context"), own(f, "page"))
        dates = None if sex or f == "navn" else F.concat_ws("/", own(f, "date_raw"), own(f, "date_min").cast("string"), own(f, "date_max").cast("string"))
        base = c("sex") if sex else own(f, "value") if f == "navn" else F.when(one(f, "c"), dates)
        imported[f] = F.coalesce(note["imported"], base)
        corrected[f] = note["corrected"]
        ready = anchored if sex else anchored & one(f, "c")
        prints[f] = F.when(ready, fingerprint(c("import_key"), c("record_key"), F.lit(f), imported[f], context=contexts[f]))
        states[f] = F.when(note["status"].isNull(), "aaben").when(~prints[f].eqNullSafe(note["fingerprint"]), "stale").otherwise(note["status"])
        block = F.when(c("anchors") == 0, "ingen_importanker").when(c("anchors") != 1, "flere_importankre").when((c("stable") != 1) & c("import_key").isNull(), "import_key_mangler").when(c("stable") != 1, "record_key_mangler")
        blockers[f] = block if sex else block.when(c(f"{f}_c_lo").isNull(), "ingen_kildebelagt_assertion").when(~one(f, "c"), "flere_importerede_facts")

    no = lambda x: F.coalesce(x, F.lit(False))
    any_ = lambda xs: reduce(lambda x, y: x | y, map(no, xs))
    hits = {
        "mistænkeligt_ocr_tegn": any_(x.rlike("[?�]") for x in contexts.values()), "dato_ufortolkelig": no(c("vague")), "foedt_efter_doed": no(own("foedsel", "date_min") > own("doed", "date_max")),
        "struktureret_afviger_fra_ocr": no(F.trim(own("navn", "value")) != F.trim(contexts["navn"])), "navn_mangler": F.coalesce(F.trim(shown("navn", "value")), F.lit("")) == "",
        "record_key_mangler": (c("anchors") == 1) & (c("stable") == 0) & c("record_key").isNull(), "ocr_kontekst_mangler": no(c("untold")),
        "flere_importerede_facts": any_(~one(f, "c") for f in FIELDS.values()), "kilde_aendret": any_(x == "stale" for x in states.values()),
    }
    codes = F.array_sort(F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in hits.items()])))
    bad = any_(hit for code, hit in hits.items() if RULES[code] == "fejl")
    by_field = lambda values: F.create_map(*[x for f, v in values.items() for x in (F.lit(f), v)])
    known = lambda values: F.map_filter(by_field(values), lambda _, v: v.isNotNull())
    number = lambda x: F.coalesce(x, F.lit(0))
    day = lambda f, tag: [shown(f, x).alias(f"{tag}_{y}") for x, y in (("date_raw", "raw"), ("date_min", "min"), ("date_max", "max"), ("qualifier", "qualifier"))]
    claim_of = lambda f: F.when(one(f, "c"), c(f"{f}_c_lo"))
    return rows.select(
        "person_id", "import_key", "record_key", "source_id", "source_title", "source_edition", "line", "nr", "generation", shown("navn", "value").alias("name"), claim_of("navn").alias("name_claim"),
        *day("foedsel", "born"), claim_of("foedsel").alias("born_claim"), *day("doed", "died"), claim_of("doed").alias("died_claim"),
        known(prints).alias("fingerprints"), known(imported).alias("imported"), known(corrected).alias("corrected"), known(contexts).alias("contexts"), known(pages).alias("pages"),
        "sex", "living", "private", "staged", "status", "canonical", "same_as", number(c("titles")).alias("titles"), number(c("families")).alias("families"), number(c("relations")).alias("relations"), number(c("cited_claims")).alias("cited_claims"),
        codes.alias("codes"), F.when(bad, "fejl").when(F.size(codes) > 0, "advarsel").alias("severity"),
        by_field(states).alias("states"), by_field({f: b.isNull() for f, b in blockers.items()}).alias("editable"), known(blockers).alias("blockers"))


def filter_grid(grid: DataFrame, preset: str = "alle", query: str = "", source: str | None = None, line: str | None = None, staged: bool | None = None, same_as: bool | None = None, field: str | None = None, status: str | None = None) -> DataFrame:
    """Rows of the grid that meet all conditions; None asks for nothing.

    preset: alle, aabne (rules are broken and not every recorded field is
    settled), rettede, godkendte, udskudte, stale. query is looked for in name,
    record key, source title, line and id, without regard to case.
    """
    c, ok = F.col, F.lit(True)
    has = lambda x: F.exists(F.map_values("states"), lambda v: v == x)
    presets = {
        "aabne": (F.size("codes") > 0) & ((F.size("states") == 0) | F.exists(F.map_values("states"), lambda v: ~v.isin("rettet", "godkendt", "udskudt"))),
        "rettede": has("rettet"), "godkendte": has("godkendt"), "udskudte": has("udskudt"), "stale": has("stale"),
    }
    ok = presets.get(preset, ok)
    if q := query.strip().lower():
        told = [F.lower(c(x).cast("string")).contains(q) for x in ("name", "record_key", "source_title", "line", "person_id")]
        ok = ok & reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in told])
    for column, value in (("source_title", source), ("line", line), ("staged", staged)):
        ok = ok if value is None else ok & (c(column) == value)
    if same_as is not None:
        ok = ok & (c("same_as").isNotNull() == same_as)
    if field is not None:
        state = F.try_element_at("states", F.lit(field))
        ok = ok & (state.isNotNull() if status is None else state == status)
    elif status is not None:
        ok = ok & has(status)
    return grid.where(ok)


def sort_grid(grid: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """The grid in the order of name, born_min, died_min, sex, line or severity; nulls last in both directions, then the smaller id."""
    rank = F.when(F.col("severity") == "fejl", 0).when(F.col("severity") == "advarsel", 1).when(F.col("severity") == "info", 2).when(F.col("severity").isNotNull(), 3)
    by = rank if key == "severity" else danish_key(F.col(key)) if key in ("name", "sex", "line") else F.col(key)
    by = F.when(F.col(key).isNotNull(), by)
    return grid.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "person_id")


def correct_fields(grid: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (person_id, field, fingerprint, value, status) with the journal row that each would write, and outcome: ok, ukendt person, spærret (the field cannot be corrected) or forældet (the row has changed since it was read)."""
    rows = commands.join(grid.select("person_id", "import_key", "record_key", "fingerprints", "imported", "editable"), "person_id", "left")
    now, open_ = F.try_element_at("fingerprints", F.col("field")), F.try_element_at("editable", F.col("field"))
    outcome = F.when(F.col("editable").isNull(), "ukendt person").when(~F.coalesce(open_, F.lit(False)), "spærret").when(~now.eqNullSafe(F.col("fingerprint")), "forældet").otherwise("ok")
    return rows.select("person_id", "field", "import_key", "record_key", F.try_element_at("imported", F.col("field")).alias("imported"), F.col("value").alias("corrected"), "status", outcome.alias("outcome"))
