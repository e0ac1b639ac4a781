"""Family graphs: edges, lineages, kinship, rosters and same-as identities.

A frame of edges has child, parent and (where needed) confidence. Fixpoints go
over frontiers of new pairs and cut their lineage in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.plans.stages import closure, components, cycles, keep_first, materialise

# Confidence from weak to strong.
CONFIDENCE = {"omstridt": 0, "formodet": 1, "sandsynlig": 2, "sikker": 3}


def confidence_rank(c: Column, missing: int = -1) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(missing))


def parent_edges(parent_child: DataFrame) -> DataFrame:
    """child, parent, confidence from rows of child, father, mother."""
    rows = parent_child.select("child", "confidence", F.explode(F.array_distinct(F.array("father", "mother"))).alias("parent"))
    return rows.where("parent IS NOT NULL AND parent <> child").select("child", "parent", "confidence")


def family_edges(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unions (family_id, p1, p2: the first two partners) and edges (child, parent, family_id)."""
    by = Window.partitionBy("family_id").orderBy("ordinal", "person_id")
    partner = member.where("role = 'partner'").withColumn("n", F.row_number().over(by)).where("n <= 2")
    unions = partner.groupBy("family_id").agg(F.max(F.when(F.col("n") == 1, F.col("person_id"))).alias("p1"), F.max(F.when(F.col("n") == 2, F.col("person_id"))).alias("p2"))
    child = member.where("role = 'barn'").select("family_id", F.col("person_id").alias("child"))
    return unions, child.join(partner.select("family_id", F.col("person_id").alias("parent")), "family_id").select("child", "parent", "family_id")


def possible_edges(edges: DataFrame, person: DataFrame) -> DataFrame:
    """Edges but those to a child born before its parent, or more than a year after the parent's death."""
    c = person.select(F.col("id").alias("child"), F.col("born").alias("_c"))
    p = person.select(F.col("id").alias("parent"), F.col("born").alias("_p"), F.col("died").alias("_d"))
    wrong = F.coalesce(F.col("_c") < F.col("_p"), F.lit(False)) | F.coalesce(F.col("_c") > F.col("_d") + 1, F.lit(False))
    return edges.join(c, "child", "left").join(p, "parent", "left").where(~wrong).drop("_c", "_p", "_d")


def model_index(edges: DataFrame, person: DataFrame) -> DataFrame:
    """id, parent_id (the smallest possible parent), n_parents, n_children, confidence (the strongest on an edge to a parent)."""
    ok = materialise(possible_edges(edges, person), "possible")
    up = ok.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent_id"), F.count("*").alias("n_parents"), F.max(confidence_rank(F.col("confidence"))).alias("rank"))
    down = ok.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    name = F.coalesce(*[F.when(F.col("rank") == v, F.lit(k)) for k, v in CONFIDENCE.items()])
    return person.select("id").join(up, "id", "left").join(down, "id", "left").select("id", "parent_id", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"), name.alias("confidence"))


def siblings(edges: DataFrame) -> DataFrame:
    """a, b, shared: pairs a < b with a common parent. A parent's children meet each other; a person's children are few."""
    e = edges.select("child", "parent").distinct()
    return e.select(F.col("child").alias("a"), "parent").join(e.select(F.col("child").alias("b"), "parent"), "parent").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def lineage_paths(lineage: DataFrame, max_depth: int = 50) -> DataFrame:
    """id, path: the ids from a lineage up to its root. A cycle, or a path longer than max_depth, fails the job.

    Doubling: every round puts the path of a path's end behind it, so the
    rounds grow with the logarithm of the depth. The joins are by sorting: a
    broadcast of all paths would pass the driver in every round.
    """
    rows = materialise(lineage.select("id", F.array("id").alias("path"), F.col("parent_id").alias("at")), "paths")
    done = []
    while True:
        done.append(rows.where("at IS NULL").select("id", "path"))
        open_ = rows.where("at IS NOT NULL")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        ahead = reduce(DataFrame.unionByName, [d.withColumn("at", F.lit(None).cast(rows.schema["at"].dataType)) for d in done] + [open_])
        ahead = ahead.select(F.col("id").alias("at"), F.col("path").alias("more"), F.col("at").alias("then"))
        joined = open_.join(ahead.hint("merge"), "at", "left").select("id", F.concat("path", F.coalesce("more", F.array("at"))).alias("path"), F.col("then").alias("at"))
        again = F.size(F.array_distinct("path")) < F.size("path")
        fault = F.when(again, F.concat(F.lit("cycle at lineage "), F.col("id").cast("string"))).when(F.size("path") > max_depth, F.lit(f"lineages deeper than {max_depth}"))
        rows = materialise(joined.withColumn("path", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("path"))), "paths")


def effective_surnames(lineage: DataFrame, max_depth: int = 50) -> DataFrame:
    """id, surname, depth: the nearest surname on the way to the root; blank is none.

    Pointer jumping: a lineage without a name points at its parent, and every
    round takes over the name or the pointer of what it points at, so the
    rounds grow with the logarithm of the depth. Longer ways than max_depth,
    and so all cycles without a name, fail the job.
    """
    name = F.when(F.trim("surname") != "", F.col("surname"))
    rows = lineage.select("id", name.alias("surname"), F.when(name.isNull(), F.col("parent_id")).alias("at"), F.when(name.isNull(), 1).otherwise(0).alias("depth"))
    rows = materialise(rows, "surnames")
    while not rows.where("at IS NOT NULL").isEmpty():
        ahead = rows.select(F.col("id").alias("at"), F.col("surname").alias("_s"), F.col("at").alias("_a"), F.col("depth").alias("_d"))
        far = F.col("depth") + F.coalesce("_d", F.lit(0))
        checked = F.when(F.col("_a").isNotNull() & (far > max_depth), F.raise_error(F.concat(F.lit("cycle or too long a way from lineage "), F.col("id").cast("string"))).cast("int")).otherwise(far)
        moved = rows.where("at IS NOT NULL").join(ahead, "at", "left").select("id", F.col("_s").alias("surname"), F.col("_a").alias("at"), checked.alias("depth"))
        rows = materialise(rows.where("at IS NULL").unionByName(moved), "surnames")
    return rows.select("id", "surname", F.when(F.col("surname").isNotNull(), F.col("depth")).alias("depth"))


def ancestors(edges: DataFrame, max_depth: int = 50, of: DataFrame | None = None) -> DataFrame:
    """id, ancestor, depth (least), for the persons in ``of`` (one column) or for all."""
    return closure(edges, "child", "parent", max_depth, of).select(F.col("node").alias("id"), F.col("reached").alias("ancestor"), "depth")


# Kinship words by sex (m, f, unknown).
_PARENT = {1: (("Far", "Mor", "Forælder"), ("søn", "datter", "barn")), 2: (("Bedstefar", "Bedstemor", "Bedsteforælder"), ("barnebarn",) * 3), 3: (("Oldefar", "Oldemor", "Oldeforælder"), ("oldebarn",) * 3), 4: (("Tipoldefar", "Tipoldemor", "Tipoldeforælder"), ("tipoldebarn",) * 3)}
_SIBLING = {False: ("Brødre", "Søstre", "Bror & søster", "Søskende"), True: ("Halvbrødre", "Halvsøstre", "Halvbror & halvsøster", "Halvsøskende")}
_UNCLE = {1: (("Onkel", "Tante", "Onkel/tante"), ("nevø", "niece", "niece/nevø")), 2: (("Grandonkel", "Grandtante", "Grandonkel/-tante"), ("grandnevø", "grandniece", "grandniece/-nevø"))}
_COUSIN = ("fætre", "kusiner", "fætter & kusine", "fætter/kusine")
_FAR = "Tip-tipoldeforælder & efterkommer"


def kinship_label(d1: Column, d2: Column, sex_a: Column, sex_b: Column, half: Column) -> Column:
    """The kinship of two persons at distances d1 and d2 from their nearest common ancestor."""
    word = lambda s, w: F.when(s == "mand", w[0]).when(s == "kvinde", w[1]).otherwise(w[2])
    both = lambda w: F.when((sex_a == "mand") & (sex_b == "mand"), w[0]).when((sex_a == "kvinde") & (sex_b == "kvinde"), w[1]).when(sex_a.isNotNull() & sex_b.isNotNull() & (sex_a != sex_b), w[2]).otherwise(w[3])
    a_first = d1 < d2
    older, younger = F.when(a_first, sex_a).otherwise(sex_b), F.when(a_first, sex_b).otherwise(sex_a)
    pair = lambda w: F.concat(word(older, w[0]), F.lit(" & "), word(younger, w[1]))
    low, gap = F.least(d1, d2), F.abs(d1 - d2)
    direct = F.lit(_FAR)
    for n, w in _PARENT.items():
        direct = F.when(gap == n, pair(w)).otherwise(direct)
    mark = F.when(half, " (halv)").otherwise("")
    sibling = F.when(half, both(_SIBLING[True])).otherwise(both(_SIBLING[False]))
    uncle = F.concat(F.when(gap == 1, pair(_UNCLE[1])).otherwise(pair(_UNCLE[2])), mark)
    shifted = F.when(gap == 0, "").when(gap == 1, " · 1 gang forskudt").otherwise(F.concat(F.lit(" · "), gap.cast("string"), F.lit(" gange forskudt")))
    cousin = F.concat((low - 1).cast("string"), F.lit(". grads "), both(_COUSIN), shifted, mark)
    return F.when((d1 == 0) & (d2 == 0), "Samme person").when(low == 0, direct).when((low == 1) & (gap == 0), sibling).when(low == 1, uncle).otherwise(cousin)


def relationships(pairs: DataFrame, edges: DataFrame, person: DataFrame) -> DataFrame:
    """a, b, ancestor, d1, d2, n_lines, half, label: for each pair its nearest relationship.

    Common ancestors (a person counts as an own one at distance 0) of which no
    descendant is common too are the nearest; a couple of them, at equal
    distances and with a common child on both lines, is one. The first by
    d1 + d2, then the larger distance, then id names the relationship, and
    n_lines counts the couples. Pairs without a common ancestor are left out.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # The child of an ancestor on each side's line, the smallest on a shortest one, comes with the closure.
    anc = closure(edges, "child", "parent", sources=asked, last=True).select(F.col("node").alias("id"), F.col("reached").alias("ancestor"), "depth", "last")
    reach = anc.unionByName(asked.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.lit(None).cast(anc.schema["last"].dataType).alias("last")))
    side = lambda who, d, x: reach.select(F.col("id").alias(who), "ancestor", F.col("depth").alias(d), F.col("last").alias(x))
    common = pairs.select("a", "b").join(side("a", "d1", "xa"), "a")
    common = materialise(common.join(side("b", "d2", "xb"), ["b", "ancestor"]), "common")
    # If a descendant is common, so is the child on the way to it: one step down tells.
    covered = common.select("a", "b", F.col("ancestor").alias("child")).join(edges.select("child", F.col("parent").alias("ancestor")).distinct(), "child").select("a", "b", "ancestor").distinct()
    near = common.join(covered, ["a", "b", "ancestor"], "left_anti")
    # A person on a cycle is its own ancestor at two distances; both have the child of the longer.
    same = Window.partitionBy("a", "b", "ancestor")
    near = near.withColumn("xa", F.min("xa").over(same)).withColumn("xb", F.min("xb").over(same))
    near = materialise(near, "nearest")
    couple = F.when(F.col("xa").isNull() | F.col("xb").isNull(), F.concat(F.lit("s"), F.col("ancestor").cast("string"))).otherwise(F.concat_ws("-", "xa", "xb"))
    lines = near.groupBy("a", "b").agg(F.count_distinct("d1", "d2", couple).alias("n_lines"))
    first = keep_first(near, ["a", "b"], F.col("d1") + F.col("d2"), F.greatest("d1", "d2"), "ancestor")
    parents = edges.select("child", "parent").distinct().groupBy("child").agg(F.collect_set("parent").alias("ps"))
    other = lambda ps: F.array_remove(F.coalesce(ps, F.array().cast("array<bigint>")), F.col("ancestor"))
    first = first.join(parents.select(F.col("child").alias("xa"), F.col("ps").alias("pa")), "xa", "left").join(parents.select(F.col("child").alias("xb"), F.col("ps").alias("pb")), "xb", "left")
    half = F.coalesce((F.col("xa") != F.col("xb")) & (F.size(other(F.col("pa"))) > 0) & (F.size(other(F.col("pb"))) > 0) & ~F.arrays_overlap(other(F.col("pa")), other(F.col("pb"))), F.lit(False))
    sex = person.select("id", "sex")
    rows = first.withColumn("half", half).join(lines, ["a", "b"]).join(sex.select(F.col("id").alias("a"), F.col("sex").alias("sa")), "a", "left").join(sex.select(F.col("id").alias("b"), F.col("sex").alias("sb")), "b", "left")
    return rows.select("a", "b", "ancestor", "d1", "d2", "n_lines", "half", kinship_label(F.col("d1"), F.col("d2"), F.col("sa"), F.col("sb"), F.col("half")).alias("label"))


def living_roster(edges: DataFrame, person: DataFrame, max_depth: int = 50) -> DataFrame:
    """id, living, via: the living and everyone with a living descendant (via: the smallest of them). The smallest id climbs from child to parent, one row per person; a cycle ends when nothing gets smaller."""
    e = materialise(edges.select(F.col("child").alias("id"), "parent").distinct(), "roster-edges")
    news = person.where("living").select("id", F.col("id").alias("via"))
    best = None
    for _ in range(max_depth * 2):
        told = news.join(e, "id").groupBy(F.col("parent").alias("id")).agg(F.min("via").alias("via"))
        if best is not None:
            told = told.join(best.select("id", F.col("via").alias("old")), "id", "left").where("old IS NULL OR via < old").drop("old")
        news = materialise(told, "roster-news")
        if news.isEmpty():
            break
        best = news if best is None else materialise(best.unionByName(news).groupBy("id").agg(F.min("via").alias("via")), "roster")
    best = news if best is None else best
    return person.select("id", F.coalesce("living", F.lit(False)).alias("living")).join(best, "id", "left").where("living OR via IS NOT NULL")


def generation_neighbours(marks: DataFrame) -> DataFrame:
    """id, n_before, n_after from marks (id, source_id, lineage, generation): persons one generation up and down in the same source and lineage; a null lineage equals itself."""
    sizes = marks.groupBy("source_id", "lineage", "generation").agg(F.count("*").alias("n"))
    at = lambda step, out: sizes.select(F.col("source_id").alias("_s"), F.col("lineage").alias("_l"), (F.col("generation") - step).alias("_g"), F.col("n").alias(out))
    meet = lambda t: (F.col("source_id") == t["_s"]) & F.col("lineage").eqNullSafe(t["_l"]) & (F.col("generation") == t["_g"])
    up, down = at(-1, "n_before"), at(1, "n_after")
    out = marks.join(up, meet(up), "left").drop("_s", "_l", "_g").join(down, meet(down), "left")
    return out.select("id", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


# ---- same-as identities ----


def same_as_groups(edges: DataFrame, known: DataFrame) -> DataFrame:
    """component, member, canonical, reason: groups of alias -> canonical edges.

    Self loops and repeated edges are dropped. A group is quarantined (canonical null) if it has
    an unknown member, or not exactly one member that is no alias.
    """
    edges = edges.select("alias", "canonical").where("alias <> canonical").distinct()
    nodes = components(edges, "alias", "canonical")
    is_alias = edges.select(F.col("alias").alias("node")).distinct().withColumn("is_alias", F.lit(True))
    there = known.select(F.col("id").alias("node")).distinct().withColumn("there", F.lit(True))
    rows = materialise(nodes.join(is_alias.hint("merge"), "node", "left").join(there.hint("merge"), "node", "left"), "same-as")
    sums = rows.groupBy("component").agg(F.count_if(F.col("is_alias").isNull()).alias("sinks"), F.min(F.when(F.col("is_alias").isNull(), F.col("node"))).alias("sink"), F.count_if(F.col("there").isNull()).alias("unknown"))
    reason = F.when(F.col("unknown") > 0, "ukendt medlem").when(F.col("sinks") != 1, "ikke én kanonisk")
    return rows.join(sums.withColumn("reason", reason).hint("merge"), "component").select("component", F.col("node").alias("member"), F.when(F.col("reason").isNull(), F.col("sink")).alias("canonical"), "reason")


def _renamed(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """rows with the identity (to: id, to) in place of the ids of a column."""
    names = to.select(F.col("id").alias(column), F.col("to").alias("_to"))
    return rows.join(names.hint("merge"), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def validate_groups(groups: DataFrame, person: DataFrame, edges: DataFrame, spread: int = 80, unions: DataFrame | None = None) -> DataFrame:
    """component, reason (null: accepted), to a fixpoint.

    A group is rejected for sexes that differ, a birth after a death (by more
    than a year), births more than spread years apart, different known parents,
    a member that becomes its own parent or, by unions (p1, p2), its own partner,
    or a place on a cycle of parents, which may run through other groups and
    through persons of no group. All are judged under the groups accepted so
    far, so rounds go on until none is rejected.
    """
    facts = person.select(F.col("id").alias("member"), "sex", "born", "died")
    known = materialise(groups.where("reason IS NULL").select("component", "member", "canonical").join(facts, "member", "left"), "groups")
    plain = known.groupBy("component").agg(F.count_distinct("sex").alias("sexes"), F.max("born").alias("b1"), F.min("born").alias("b0"), F.min("died").alias("d0"))
    own = F.when(F.col("sexes") > 1, "køn").when(F.col("b1") > F.col("d0") + 1, "født efter død").when(F.col("b1") - F.col("b0") > spread, "fødselsår")
    verdict = materialise(plain.select("component", own.alias("reason")), "verdicts")
    while True:
        open_ = verdict.where("reason IS NULL").select("component")
        canon = known.join(open_, "component", "left_semi").select(F.col("member").alias("id"), F.col("canonical").alias("to"), "component")
        e = edges.select("child", "parent").distinct()
        e = e.join(canon.select(F.col("id").alias("child"), F.col("to").alias("c2"), "component"), "child").join(canon.select(F.col("id").alias("parent"), F.col("to").alias("p2")), "parent", "left")
        e = e.select("component", "child", "c2", F.coalesce("p2", "parent").alias("p2")).distinct()
        sets = e.groupBy("component", "child").agg(F.array_join(F.array_sort(F.collect_set("p2")), ",").alias("set"), F.max(F.col("c2") == F.col("p2")).alias("loop"))
        new = sets.groupBy("component").agg(F.count_distinct("set").alias("sets"), F.max("loop").alias("loop"))
        new = new.select("component", F.when(F.col("sets") > 1, "forældre").when(F.col("loop"), "egen forælder").alias("now"))
        to = materialise(canon.select("id", "to"), "identities")
        arcs = _renamed(_renamed(edges.select("child", "parent"), "child", to), "parent", to)
        ring = cycles(arcs.where("child <> parent"), "child", "parent").select(F.col("node").alias("to"))
        faults = [canon.join(ring, "to", "left_semi").select("component", F.lit("kreds").alias("fault"))]
        if unions is not None:
            pairs = _renamed(_renamed(unions.select("p1", "p2"), "p1", to), "p2", to).where("p1 = p2").select(F.col("p1").alias("to"))
            faults.append(canon.join(pairs, "to", "left_semi").select("component", F.lit("egen ægtefælle").alias("fault")))
        more = reduce(DataFrame.unionByName, faults).groupBy("component").agg(F.min("fault").alias("fault"))
        new = new.join(more, "component", "full").select("component", F.coalesce("now", "fault").alias("now"))
        joined = materialise(verdict.join(new, "component", "left").select("component", F.coalesce("reason", "now").alias("reason"), (F.col("reason").isNull() & F.col("now").isNotNull()).alias("new")), "verdicts")
        verdict = joined.select("component", "reason")
        if joined.where("new").isEmpty():
            return verdict


def identity_cycles(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """node, cycle: identities on a cycle of parents once the groups with a canonical member are merged, with the smallest identity of the cycle's component; an identity that is its own parent too."""
    to = groups.where("canonical is not null").select(F.col("member").alias("id"), F.col("canonical").alias("to"))
    return cycles(_renamed(_renamed(edges.select("child", "parent"), "child", to), "parent", to), "child", "parent")


def collapse(person: DataFrame, groups: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row per identity: the canonical row's values, else the others' by the text order of their ids; private if one is."""
    ok = groups.where("reason IS NULL").join(verdict.where("reason IS NULL").select("component"), "component", "left_semi").select(F.col("member").alias("id"), "canonical")
    rows = person.join(ok, "id", "left").withColumn("to", F.coalesce("canonical", "id"))
    order = F.struct((F.col("id") != F.col("to")).alias("a"), F.col("id").cast("string").alias("b"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return rows.groupBy(F.col("to").alias("id")).agg(first("name"), first("born"), first("died"), first("sex"), F.max("private").alias("private"), F.count("*").alias("n_merged"))


def partner_limit(member: DataFrame, limit: int = 2) -> DataFrame:
    """Families with more partners than allowed: family_id, n."""
    return member.where("role = 'partner'").groupBy("family_id").agg(F.count_distinct("person_id").alias("n")).where(F.col("n") > limit)


def partner_faults(member: DataFrame, aliases: DataFrame, limit: int = 2) -> DataFrame:
    """family_id, fault: families with more partners than allowed (for mange), or with two partners of one identity (samme identitet). aliases: id, canonical."""
    p = member.where("role = 'partner'").select("family_id", F.col("person_id").alias("id")).distinct().join(aliases.select("id", "canonical"), "id", "left")
    sums = p.groupBy("family_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("canonical", "id")).alias("m"))
    return sums.select("family_id", F.explode(F.array_compact(F.array(F.when(F.col("n") > limit, "for mange"), F.when(F.col("m") < F.col("n"), "samme identitet")))).alias("fault"))


def collapse_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """child, parent, confidence of the identities: ends become canonical, an edge onto itself goes, and of equal edges the strongest confidence stays. aliases: id, canonical."""
    to = lambda c: aliases.select(F.col("id").alias(c), F.col("canonical").alias(f"_{c}"))
    e = edges.join(to("child"), "child", "left").join(to("parent"), "parent", "left")
    e = e.select(F.coalesce("_child", "child").alias("child"), F.coalesce("_parent", "parent").alias("parent"), "confidence").where("child <> parent")
    rank = F.coalesce(confidence_rank(F.col("confidence")), F.lit(-1))
    return e.groupBy("child", "parent").agg(F.max_by("confidence", rank).alias("confidence"))


def preview_same_as(edges: DataFrame, known: DataFrame, person: DataFrame, parents: DataFrame, alias: int, canonical: int) -> DataFrame:
    """component, member, canonical, reason of the group that one more edge alias -> canonical would make, judged among all groups."""
    one = edges.sparkSession.createDataFrame([(alias, canonical)], "alias long, canonical long")
    groups = materialise(same_as_groups(edges.select("alias", "canonical").unionByName(one), known), "preview")
    verdict = validate_groups(groups, person, parents).withColumnRenamed("reason", "rejected")
    mine = groups.where(F.col("member") == alias).select("component")
    return groups.join(mine, "component", "left_semi").join(verdict, "component", "left").select("component", "member", "canonical", F.coalesce("reason", "rejected").alias("reason"))


def quarantine_cascade(groups: DataFrame, verdict: DataFrame, edges: DataFrame) -> DataFrame:
    """component, reason, cascade for rejected groups: cascade is true where the parents that differ would agree if no group had been rejected, so that another rejection caused this one."""
    bad = verdict.where("reason IS NOT NULL")
    all_ = groups.where("reason IS NULL").select(F.col("member").alias("id"), "canonical", "component")
    e = edges.select("child", "parent").distinct().join(all_.select(F.col("id").alias("child"), "component"), "child").join(all_.select(F.col("id").alias("parent"), F.col("canonical").alias("to")), "parent", "left")
    sets = e.groupBy("component", "child").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("to", "parent"))), ",").alias("set"))
    agree = sets.groupBy("component").agg((F.count_distinct("set") == 1).alias("agree"))
    return bad.join(agree, "component", "left").select("component", "reason", ((F.col("reason") == "forældre") & F.coalesce("agree", F.lit(False))).alias("cascade"))


def child_faults(member: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (family_id, child) and fault: why a child cannot be added, or null. ukendt familie, partner, har fødselsfamilie, or kreds (a partner descends from the child)."""
    partner = member.where("role = 'partner'").select("family_id", F.col("person_id").alias("partner")).distinct()
    birth = member.where("role = 'barn'").select(F.col("person_id").alias("child"), F.col("family_id").alias("_f")).distinct()
    _, edges = family_edges(member)
    below = closure(edges.select(F.col("parent").alias("p"), F.col("child").alias("c")), "p", "c", sources=commands.select("child"))
    near = commands.select("family_id", "child").distinct().join(partner, "family_id")
    ring = near.join(below.select(F.col("node").alias("child"), F.col("reached").alias("partner")), ["child", "partner"], "left_semi").select("family_id", "child").distinct().withColumn("ring", F.lit(True))
    self_ = near.where("partner = child").select("family_id", "child").distinct().withColumn("self", F.lit(True))
    there = member.select("family_id").distinct().withColumn("there", F.lit(True))
    has = birth.groupBy("child").agg(F.lit(True).alias("born"))
    rows = commands.join(there, "family_id", "left").join(self_, ["family_id", "child"], "left").join(has, "child", "left").join(ring, ["family_id", "child"], "left")
    return rows.select("family_id", "child", F.when(F.col("there").isNull(), "ukendt familie").when(F.col("self"), "partner").when(F.col("born"), "har fødselsfamilie").when(F.col("ring"), "kreds").alias("fault"))
