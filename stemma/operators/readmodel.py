"""Read models and reports: grouped rows, geography, choices, totals, samples and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.plans.stages import closure, keep_first


def canonical_ids(df: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """df with the named person columns led to their canonical id. aliases: id, canonical; ids without one stay."""
    names = df.columns
    for c in columns:
        df = df.join(aliases.select(F.col("id").alias(c), F.col("canonical").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df.select(*names)


# ---- lineages ----


def lineage_descendants(lineage: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """root, id, depth: all lineages below each root (column id). With a limit, more than that below one root fails the job."""
    below = closure(lineage, "parent_id", "id", sources=roots.select("id")).select(F.col("node").alias("root"), F.col("reached").alias("id"), "depth")
    if limit is None:
        return below
    sizes = below.groupBy("root").agg(F.count("*").alias("n")).select("root", F.when(F.col("n") > limit, F.raise_error(F.concat(F.lit("too many lineages below "), F.col("root").cast("string"))).cast("long")).otherwise(F.col("n")).alias("n"))
    return below.join(sizes, "root").where("n > 0").drop("n")


def would_cycle(lineage: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, parent_id) and ok: false where the new parent is the lineage itself or lies below it. Each change is judged by itself."""
    below = closure(lineage, "parent_id", "id", sources=changes.select("id")).select(F.col("node").alias("id"), F.col("reached").alias("parent_id"), F.lit(True).alias("_below"))
    rows = changes.join(below, ["id", "parent_id"], "left")
    bad = F.coalesce(F.col("_below"), F.lit(False)) | F.coalesce(F.col("id") == F.col("parent_id"), F.lit(False))
    return rows.select("id", "parent_id", (~bad).alias("ok"))


def surname_root(lineage: DataFrame) -> DataFrame:
    """One row: the smallest root with a surname."""
    return lineage.where("parent_id IS NULL AND trim(surname) <> ''").agg(F.min("id").alias("id"), F.min_by("surname", "id").alias("surname"))


def line_markings(marking: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, ord, value: each person's first concluded marking (by ord), under its canonical id. marking: id, ord, value."""
    return canonical_ids(marking, aliases, ["id"]).groupBy("id").agg(F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"))


def latest_intro(text: DataFrame) -> DataFrame:
    """lineage_id, id, text: of each lineage the non-blank intro with the largest id. text: lineage_id, id, kind, text."""
    return text.where("kind = 'intro' AND trim(text) <> ''").groupBy("lineage_id").agg(F.max("id").alias("id"), F.max_by("text", "id").alias("text"))


# ---- families ----


def family_rows(member: DataFrame, person: DataFrame) -> DataFrame:
    """person_id, family_id, role, partners, children: each member's families. Partners come men first, then women, then others; both sides by ordinal (none: 0) and id."""
    sex = F.when(F.col("sex") == "mand", 0).when(F.col("sex") == "kvinde", 1).otherwise(2)
    rows = member.join(person.select(F.col("id").alias("person_id"), sex.alias("_sex")), "person_id", "left")
    place = F.coalesce("ordinal", F.lit(0))
    ids = lambda role, *by: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)], F.col("person_id").alias("id"))))), lambda x: x["id"])
    sides = rows.groupBy("family_id").agg(ids("partner", F.coalesce("_sex", F.lit(2)), place).alias("partners"), ids("barn", place).alias("children"))
    return member.select("person_id", "family_id", "role").join(sides, "family_id").select("person_id", "family_id", "role", "partners", "children")


def nudged(children: DataFrame) -> DataFrame:
    """family_id, id, up, down: the ordinal that moves a child one place up or down; null at the edges. children: family_id, id, place (from 0), ordinal; a missing ordinal is (place + 1) * 10."""
    w = Window.partitionBy("family_id").orderBy("place")
    own = F.coalesce("ordinal", (F.col("place") + 1) * 10)
    return children.select("family_id", "id", (F.lag(own).over(w) - 1).alias("up"), (F.lead(own).over(w) + 1).alias("down"))


def sex_composition(person: DataFrame, by: str) -> DataFrame:
    """by, men, women, unknown."""
    return person.groupBy(by).agg(F.count_if(F.col("sex") == "mand").alias("men"), F.count_if(F.col("sex") == "kvinde").alias("women"), F.count_if(~F.coalesce(F.col("sex").isin("mand", "kvinde"), F.lit(False))).alias("unknown"))


def founders(heads: DataFrame, children: DataFrame, eligible: DataFrame, n: int) -> DataFrame:
    """id, place: n persons of the front page, line heads in their order first, then those with the most children. heads: id, ord; children: id, n_children; eligible: id."""
    a = heads.select("id", F.lit(0).alias("prio"), F.col("ord").cast("long").alias("key"))
    b = children.where("n_children > 0").select("id", F.lit(1).alias("prio"), (-F.col("n_children")).cast("long").alias("key"))
    rows = a.unionByName(b).join(eligible.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("prio", "key")).alias("k"))
    top = rows.orderBy("k.prio", "k.key", "id").limit(n)  # n rows from here on
    return top.select("id", F.row_number().over(Window.orderBy("k.prio", "k.key", "id")).cast("long").alias("place"))


# ---- geography ----

# The facts of persons that are points on the map.
POINT_FACTS = ["fødsel", "dåb", "død", "begravelse", "bisættelse"]


def geo_points(estate: DataFrame, fact: DataFrame, wedding: DataFrame, place: DataFrame, person: DataFrame) -> DataFrame:
    """kind, place_id, lat, lon, estate_id, family_id, person_id, year: what the map shows.

    estate: id, place_id; fact: person_id, kind, place_id; wedding: family_id,
    p1, p2, year, place_id; person: the visible persons with id, born, died.
    Estates are public; a fact is shown for a visible person only, with the
    year of a birth or death; a wedding has one row for each visible partner,
    and none without one. Places without coordinates give no points.
    """
    spots = place.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("place_id"), "lat", "lon")
    none, year = F.lit(None).cast("long"), F.lit(None).cast("int")
    columns = ["kind", "place_id", "lat", "lon", "estate_id", "family_id", "person_id", "year"]
    a = estate.join(spots, "place_id").select(F.lit("estate").alias("kind"), "place_id", "lat", "lon", F.col("id").alias("estate_id"), none.alias("family_id"), none.alias("person_id"), year.alias("year"))
    who = person.select(F.col("id").alias("person_id"), "born", "died")
    at = F.when(F.col("kind") == "fødsel", F.col("born")).when(F.col("kind") == "død", F.col("died"))
    b = fact.withColumn("kind", F.lower("kind")).where(F.col("kind").isin(POINT_FACTS)).join(spots, "place_id").join(who, "person_id")
    b = b.select("kind", "place_id", "lat", "lon", none.alias("estate_id"), none.alias("family_id"), "person_id", at.cast("int").alias("year"))
    c = wedding.join(spots, "place_id").withColumn("person_id", F.explode(F.array_distinct(F.array_compact(F.array("p1", "p2"))))).join(who.select("person_id"), "person_id", "left_semi")
    c = c.select(F.lit("vielse").alias("kind"), "place_id", "lat", "lon", none.alias("estate_id"), "family_id", "person_id", F.col("year").cast("int").alias("year"))
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in (a, b, c)])


def busiest(owners: DataFrame) -> DataFrame:
    """One row: the estate with the most owners, then the smallest id. owners: id, n."""
    return owners.agg(F.max(F.struct("n", (-F.col("id")).alias("i"))).alias("x")).select((-F.col("x.i")).alias("id"), F.col("x.n").alias("n"))


# ---- totals, samples and checks ----


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """name, n for each frame."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()])


def review_progress(queue: DataFrame) -> DataFrame:
    """One row: total, decided and remaining rows of a queue (decision null or blank: open)."""
    done = F.count_if(F.coalesce(F.trim("decision"), F.lit("")) != "")
    return queue.agg(F.count("*").alias("total"), done.alias("decided")).withColumn("remaining", F.col("total") - F.col("decided"))


def family_status(rows: DataFrame) -> DataFrame:
    """a_id, b_id, confirmed, support, detail: a pair's rows rolled up. rows: a_id, b_id, status, support, detail."""
    text = F.array_join(F.array_sort(F.collect_set(F.when(F.trim("detail") != "", F.col("detail")))), "; ")
    return rows.groupBy("a_id", "b_id").agg(F.max(F.coalesce(F.col("status") == "bekræftet", F.lit(False))).alias("confirmed"), F.sum(F.coalesce("support", F.lit(0))).alias("support"), text.alias("detail"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, status of a join that must be one to one: enig, kun_venstre, kun_højre, or flertydig where a side repeats the key."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    status = F.when((F.col("_a") > 1) | (F.col("_b") > 1), "flertydig").when(F.col("_b").isNull(), "kun_venstre").when(F.col("_a").isNull(), "kun_højre").otherwise("enig")
    return a.join(b, key, "full").select(key, status.alias("status"))


def annotated(queue: DataFrame, notes: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """Every row of the queue with the columns of its note, or what fill says."""
    return queue.join(notes, keys, "left").fillna(fill)


def stratified_sample(rows: DataFrame, by: str, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows of each stratum, by a seeded hash of the id."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    return keep_first_k(hashed, [by], k, "_h", id_col).drop("_h")


def keep_first_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key; the limit is applied in every task before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def tier_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, n: how many pairs went from tier to tier; a missing pair is 'skjult'."""
    a, b = (df.select("a_id", "b_id", F.col("tier").alias(name)) for df, name in ((before, "before"), (after, "after")))
    return a.join(b, ["a_id", "b_id"], "full").fillna("skjult", ["before", "after"]).groupBy("before", "after").agg(F.count("*").alias("n"))


def decision_audit(decision: DataFrame, change_set: DataFrame) -> DataFrame:
    """a_id, b_id, set_id: for each decision the first change set of its person and operation whose summary names the other id. decision: a_id, b_id, operation; change_set: id, person_id, operation, summary."""
    c = change_set.select(F.col("id").alias("set_id"), F.col("person_id").alias("a_id"), "operation", "summary")
    hits = decision.join(c, ["a_id", "operation"]).where(F.contains("summary", F.col("b_id").cast("string"))).groupBy("a_id", "b_id", "operation").agg(F.min("set_id").alias("set_id"))
    return decision.join(hits, ["a_id", "b_id", "operation"], "left").select("a_id", "b_id", "set_id")


def parent_coverage(person: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: identities, and how many of them have one parent, and two or more, once aliases are folded."""
    people = canonical_ids(person.select("id"), aliases, ["id"]).distinct()
    up = canonical_ids(edges.select("child", "parent"), aliases, ["child", "parent"]).where("child <> parent").groupBy(F.col("child").alias("id")).agg(F.count_distinct("parent").alias("n"))
    return people.join(up, "id", "left").agg(F.count("*").alias("persons"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") >= 2).alias("two"))


def weighted_pick(rows: DataFrame, group: str, u: Column) -> DataFrame:
    """One row of each group, drawn by score: the first whose running sum reaches u of the total. rows: group, ord, score; groups without a positive total give none."""
    w = Window.partitionBy(group).orderBy("ord")
    total = F.sum("score").over(Window.partitionBy(group))
    got = rows.withColumn("_t", total).withColumn("_s", F.sum("score").over(w)).withColumn("_l", F.lead("ord").over(w).isNull())
    return keep_first(got.where((F.col("_t") > 0) & ((F.col("_s") >= u * F.col("_t")) | F.col("_l"))), [group], "ord").drop("_t", "_s", "_l")


def identity_faults(edge: DataFrame, union: DataFrame) -> DataFrame:
    """alias, canonical, fault: same-as edges that break a rule: selv, flere mål (an alias of two), kæde (an alias that is canonical elsewhere), samme union. union: p1, p2."""
    e = edge.select("alias", "canonical").distinct()
    many = e.groupBy("alias").agg(F.count("*").alias("n"))
    goals = e.select(F.col("canonical").alias("alias")).distinct().withColumn("chain", F.lit(True))
    pairs = union.where("p1 IS NOT NULL AND p2 IS NOT NULL").select(F.least("p1", "p2").alias("lo"), F.greatest("p1", "p2").alias("hi")).distinct().withColumn("wed", F.lit(True))
    rows = e.join(many, "alias").join(goals, "alias", "left").withColumn("lo", F.least("alias", "canonical")).withColumn("hi", F.greatest("alias", "canonical")).join(pairs, ["lo", "hi"], "left")
    faults = F.array_compact(F.array(F.when(F.col("alias") == F.col("canonical"), "selv"), F.when(F.col("n") > 1, "flere mål"), F.when(F.col("chain"), "kæde"), F.when(F.col("wed"), "samme union")))
    return rows.select("alias", "canonical", F.explode(faults).alias("fault"))


def publish(person: DataFrame, member: DataFrame, chosen: DataFrame) -> DataFrame:
    """person with staged lifted for the chosen ids and for staged stubs that are partners in a chosen one's family. A stub has no record of its own (stub true)."""
    own = chosen.select("id").distinct()
    partner = member.where("role = 'partner'").select("family_id", "person_id")
    near = partner.join(own.select(F.col("id").alias("person_id")), "person_id", "left_semi").select("family_id").distinct()
    stubs = partner.join(near, "family_id", "left_semi").select(F.col("person_id").alias("id")).join(person.where("stub").select("id"), "id", "left_semi")
    go = own.unionByName(stubs).distinct().withColumn("_go", F.lit(True))
    return person.join(go, "id", "left").withColumn("staged", F.when(F.col("_go"), False).otherwise(F.col("staged"))).drop("_go")


def delete_person(person: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the persons and all rows that name them. tables: name -> (frame, its person columns)."""
    gone = ids.select("id").distinct()
    out = {"person": person.join(gone, "id", "left_anti")}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone.withColumnRenamed("id", c), c, "left_anti")
        out[name] = df
    return out


def media_merge_plan(media: DataFrame, depiction: DataFrame) -> DataFrame:
    """keep_id, drop_id, object_type, object_id, step: how media of one digest become one. The smallest ready id stays; a picture's relation moves ('flyt') unless the kept one has it ('slet'); a medium without relations is 'slet medie'."""
    ready = media.where("status = 'klar' AND sha IS NOT NULL")
    keep = ready.groupBy("sha").agg(F.min("id").alias("keep_id"))
    drop = ready.join(keep, "sha").where("id <> keep_id").select("keep_id", F.col("id").alias("drop_id"))
    uses = depiction.select("media_id", "object_type", "object_id").distinct()
    moved = drop.join(uses.withColumnRenamed("media_id", "drop_id"), "drop_id")
    has = uses.select(F.col("media_id").alias("keep_id"), "object_type", "object_id", F.lit(True).alias("has"))
    first = moved.groupBy("keep_id", "object_type", "object_id").agg(F.min("drop_id").alias("first"))
    moved = moved.join(has, ["keep_id", "object_type", "object_id"], "left").join(first, ["keep_id", "object_type", "object_id"])
    moved = moved.select("keep_id", "drop_id", "object_type", "object_id", F.when(F.col("has") | (F.col("drop_id") != F.col("first")), "slet").otherwise("flyt").alias("step"))
    last = drop.select("keep_id", "drop_id", F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("long").alias("object_id"), F.lit("slet medie").alias("step"))
    return moved.unionByName(last)


# ---- evidence and editions ----


def parent_slots(fact: DataFrame, claim: DataFrame, citation: DataFrame, source: DataFrame, conclusion: DataFrame, partner: DataFrame) -> DataFrame:
    """fact_id, status, claim_id, family_id, parents, edition, page, quote, chosen: every claim about a person's parents.

    claim: id, target_id, family_id; the first citation by id counts; the
    edition is the source's, or else its title; partner: family_id, person_id,
    name, whose families' parents are listed by id.
    """
    parents = partner.groupBy("family_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("person_id", F.coalesce("name", F.lit("(ukendt)")).alias("name")))), lambda x: x["name"]), " · ").alias("parents"))
    said = citation.join(source.select(F.col("id").alias("source_id"), F.coalesce("edition", "title").alias("edition")), "source_id", "left")
    said = said.groupBy(F.col("claim_id")).agg(F.min(F.struct("id", "edition", "page", "quote")).alias("c"))
    said = said.select("claim_id", "c.edition", "c.page", "c.quote")
    done = conclusion.where("target_type = 'fact'").select(F.col("target_id").alias("fact_id"), "status", "chosen_id")
    rows = claim.where("family_id IS NOT NULL").select(F.col("target_id").alias("fact_id"), F.col("id").alias("claim_id"), "family_id").join(fact.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    rows = rows.join(parents, "family_id", "left").join(said, "claim_id", "left").join(done, "fact_id", "left")
    return rows.select("fact_id", "status", "claim_id", "family_id", F.coalesce("parents", F.lit("")).alias("parents"), "edition", "page", "quote", F.coalesce(F.col("claim_id") == F.col("chosen_id"), F.lit(False)).alias("chosen"))


def grouped_events(event: DataFrame, aliases: DataFrame) -> DataFrame:
    """person_id, events: each person's events under the canonical id, earliest first (unknown dates last), then by id. event: id, person_id, date_min, text."""
    rows = canonical_ids(event, aliases, ["person_id"])
    item = F.struct(F.col("date_min").isNull().alias("a"), F.col("date_min").alias("b"), F.col("id").alias("id"), "text")
    return rows.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("events"))


def texts_of(people: DataFrame, aliases: DataFrame, preferred: DataFrame) -> DataFrame:
    """id, text: the preferred text of each person, or of the first alias (by id) that has one. people: id; preferred: person_id, text."""
    names = aliases.select("id", "canonical").unionByName(people.select("id", F.col("id").alias("canonical"))).distinct()
    held = names.join(preferred.select(F.col("person_id").alias("id"), "text"), "id").groupBy("canonical").agg(F.min(F.struct((F.col("id") != F.col("canonical")).alias("a"), F.col("id").alias("b"), "text")).alias("x"))
    return people.select("id").join(held.select(F.col("canonical").alias("id"), F.col("x.text").alias("text")), "id", "left")


def default_edition(source: DataFrame) -> DataFrame:
    """One row: the source of the newest year, or without any year the first by id."""
    return source.agg(F.max(F.struct(F.coalesce("year", F.lit(-1)).alias("y"), (-F.col("id")).alias("i"))).alias("x")).select((-F.col("x.i")).alias("id"), F.nullif(F.col("x.y"), F.lit(-1)).alias("year"))


def enriched_queue(queue: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """A review queue with the names of both sides, and the ids in its detail text (kind id; kind id) replaced by names. a, b: id, name."""
    rows = queue.join(a.select(F.col("id").alias("a_id"), F.col("name").alias("a_name")), "a_id", "left").join(b.select(F.col("id").alias("b_id"), F.col("name").alias("b_name")), "b_id", "left")
    parts = rows.select("a_id", "b_id", F.posexplode(F.split("detail", "; ")).alias("i", "part")).withColumn("id", F.regexp_extract("part", r"(\d+)$", 1).try_cast("long"))
    parts = parts.join(a.select("id", "name"), "id", "left").withColumn("part", F.when(F.col("name").isNotNull(), F.concat(F.regexp_replace("part", r"\d+$", ""), "name")).otherwise(F.col("part")))
    said = parts.groupBy("a_id", "b_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "; ").alias("told"))
    return rows.join(said, ["a_id", "b_id"], "left").select("a_id", "b_id", "a_name", "b_name", F.coalesce("told", F.lit("")).alias("detail"))


def completeness(record: DataFrame, columns: list[str], text: str) -> DataFrame:
    """id, filled, length: what is compared to decide which of two copies is kept: filled columns first, then the length of the text."""
    filled = reduce(lambda x, y: x + y, [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", 1).otherwise(0) for c in columns])
    return record.select("id", filled.alias("filled"), F.char_length(F.coalesce(text, F.lit(""))).alias("length"))


def extraction_score(extract: DataFrame, truth: DataFrame, batch: DataFrame) -> DataFrame:
    """One row of counts over extracted records: right and wrong mentions against the truth, spans that are not in the text, impure names. extract: id, mention, name, spans; truth: id, mention; batch: id, text."""
    from stemma.functions.display import noisy_name, spans_not_verbatim

    rows = extract.join(truth.select("id", F.col("mention").alias("true")), "id", "left").join(batch.select("id", "text"), "id", "left")
    lost = spans_not_verbatim(F.col("spans"), F.coalesce("text", F.lit("")))
    said = F.size(F.filter("spans", lambda x: F.coalesce(x, F.lit("")) != ""))
    known, same = F.col("true").isNotNull(), F.coalesce("mention", F.lit(False)) == F.col("true")
    return rows.agg(F.count("*").alias("records"), F.count_if(known).alias("judged"), F.count_if(known & same).alias("right"), F.count_if(known & ~same).alias("wrong"), F.sum(said).alias("spans"), F.sum(lost).alias("lost"), F.count_if(noisy_name(F.col("name"))).alias("impure"))
