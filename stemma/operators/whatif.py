"""What-if of identity links: many candidate edges judged at once, each by itself.

A scenario is one candidate edge added to the edges that stand; it merges the
groups of its two ends. No scenario is built: it is judged from one row per
group and one full run of the group fixpoint over the edges that stand.

- Members known, canonical ends, sexes and years come from sums per group.
- In the first round of the fixpoint, all groups stand that these do not rule
  out. Under its identities the merged group has other parents, a parent or
  partner of its own, or a place on a cycle, or it has none of these. Later
  rounds only take identities apart, so that no cycle comes about after that.
- A merged group on no cycle is not its own ancestor. So its ancestors fare as
  they do without the scenario, and only whether its members' parents agree
  under the final identities is left to ask: where they do, they did in all
  rounds before.

Scenarios that merge the same two groups share a verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.family import same_as_groups, validate_groups
from stemma.plans.stages import closure, materialise

#: Sets of identities that can become one when two identities become one: with the first, with the second, with both.
_MERGING = 3


def _summaries(people: DataFrame, stand: DataFrame, known: DataFrame, person: DataFrame) -> DataFrame:
    """One row per component of people (component, member, grouped): what its members are in sum."""
    alias = stand.select(F.col("alias").alias("member")).distinct().withColumn("is_alias", F.lit(True))
    there = known.select(F.col("id").alias("member")).distinct().withColumn("there", F.lit(True))
    facts = person.groupBy(F.col("id").alias("member")).agg(F.min("sex").alias("s0"), F.max("sex").alias("s1"), F.min("born").alias("b0"), F.max("born").alias("b1"), F.min("died").alias("d0"))
    rows = people.join(alias.hint("merge"), "member", "left").join(there.hint("merge"), "member", "left").join(facts.hint("merge"), "member", "left")
    return rows.groupBy("component").agg(
        F.max("grouped").alias("grouped"), F.count_if(F.col("is_alias").isNull()).alias("sinks"), F.count_if(F.col("there").isNull()).alias("unknown"),
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("d0").alias("d0"))


def _own_fault(s0, s1, b0, b1, d0, spread: int):
    return F.when(s0 != s1, "køn").when(b1 > d0 + 1, "født efter død").when(b1 - b0 > spread, "fødselsår")


def _on_cycle(classes: DataFrame, kin: DataFrame, place: DataFrame, max_depth: int) -> DataFrame:
    """x, y of the classes whose merged group lies on a cycle under the first identities.

    A group that stands is one node, '=' and its identity. One that only the
    scenario makes valid is the node '>' on the way up from its members and '<'
    on the way up to them; its members are nodes of their own besides.
    """
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    arcs = kin.where("child_first <> parent_first").select(name("=", "child_first").alias("n"), name("=", "parent_first").alias("m"))
    out = kin.where("child_shut").select(name(">", "component").alias("n"), name("=", "parent_first").alias("m"))
    into = kin.where("parent_shut").select(name("=", "child_first").alias("n"), name("<", "parent_component").alias("m"))
    arcs = materialise(arcs.unionByName(out).unionByName(into).distinct(), "arcs")
    node = place.groupBy("component").agg(F.first("shut").alias("shut"), F.first("first").alias("first"))
    node = node.select("component", *[F.when(F.col("shut"), name(mark, "component")).otherwise(name("=", "first")).alias(to) for mark, to in ((">", "up"), ("<", "down"))])
    ends = classes.select("x", "y", F.explode(F.array("x", "y")).alias("component")).distinct().join(node, "component")
    ends = materialise(ends.select("x", "y", "up", "down"), "ends")
    # Only who has parents, and only who is one, can be an end of a way.
    ways = ends.select("x", "y", "up").join(ends.select("x", "y", "down"), ["x", "y"])
    ways = ways.join(arcs.select(F.col("n").alias("up")).distinct().hint("merge"), "up", "left_semi").join(arcs.select(F.col("m").alias("down")).distinct().hint("merge"), "down", "left_semi")
    ways = materialise(ways.select("x", "y", "up", "down"), "ways")
    far = closure(arcs, "n", "m", max_depth, sources=ways.select("up"))
    return ways.join(far.select(F.col("node").alias("up"), F.col("reached").alias("down")), ["up", "down"], "left_semi").select("x", "y").distinct()


def what_if(pairs: DataFrame, edges: DataFrame, known: DataFrame, person: DataFrame, parents: DataFrame, unions: DataFrame | None = None, spread: int = 80, max_depth: int = 200) -> DataFrame:
    """alias, canonical, accepted, reason for each distinct candidate pair, as if it were the only edge added.

    edges (alias, canonical) stand already; known (id), person (id, sex, born,
    died), parents (child, parent) and unions (p1, p2) as for
    ``validate_groups``. accepted is false, with the reason, where the group
    of the pair would be quarantined or rejected. A pair of one id adds nothing
    and is judged by the group that stands. A pair with a null end, or an end
    that nobody knows, is 'ukendt medlem'. No pairs: no rows. Ancestor lines
    longer than max_depth fail the job where a cycle has to be looked for.
    """
    asked = materialise(pairs.select("alias", "canonical").distinct(), "asked")
    whole = asked.where("alias IS NOT NULL AND canonical IS NOT NULL")
    stand = materialise(edges.select("alias", "canonical").where("alias <> canonical").distinct(), "edges")
    parents = parents.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    groups = materialise(same_as_groups(stand, known), "groups")
    verdict = validate_groups(groups, person, parents, spread, unions).select("component", F.col("reason").alias("rejected"))

    grouped = groups.select("component", "member", F.lit(True).alias("grouped"))
    alone = whole.select(F.explode(F.array("alias", "canonical")).alias("member")).distinct().join(groups.select("member").hint("merge"), "member", "left_anti")
    people = materialise(grouped.unionByName(alone.select(F.col("member").alias("component"), "member", F.lit(False).alias("grouped"))), "people")
    sums = materialise(_summaries(people, stand, known, person), "summaries")
    fault = sums.select("component", _own_fault(*[F.col(c) for c in ("s0", "s1", "b0", "b1", "d0")], spread).alias("fault"))
    # first, final: the identity in the first round and at the end. shut: not canonical as it stands.
    fates = groups.join(fault.hint("merge"), "component").join(verdict.hint("merge"), "component", "left")
    place = fates.select("component", "member", F.col("reason").isNotNull().alias("shut"), F.when(F.col("reason").isNull() & F.col("fault").isNull(), F.col("canonical")).otherwise(F.col("member")).alias("first"), F.when(F.col("reason").isNull() & F.col("rejected").isNull(), F.col("canonical")).otherwise(F.col("member")).alias("final"))
    single = people.where("NOT grouped").select("component", "member", F.lit(False).alias("shut"), F.col("member").alias("first"), F.col("member").alias("final"))
    place = materialise(place.unionByName(single), "places")

    # What sums tell of each pair.
    of = lambda x, side: [F.col(c).alias(f"{c}_{side}") for c in x.columns if c != "component"]
    sinks = people.join(stand.select(F.col("alias").alias("member")).distinct().hint("merge"), "member", "left_anti").select(F.col("member").alias("alias"), F.lit(1).alias("sink"))
    home = people.select("component", "member")
    rows = whole.join(home.select(F.col("member").alias("alias"), F.col("component").alias("a")).hint("merge"), "alias").join(home.select(F.col("member").alias("canonical"), F.col("component").alias("c")).hint("merge"), "canonical").join(sinks.hint("merge"), "alias", "left")
    rows = rows.join(sums.select(F.col("component").alias("a"), *of(sums, "a")).hint("merge"), "a").join(sums.select(F.col("component").alias("c"), *of(sums, "c")).hint("merge"), "c")
    left = F.col("sinks_a") + F.when(F.col("a") != F.col("c"), F.col("sinks_c")).otherwise(0) - F.when(F.col("alias") != F.col("canonical"), F.coalesce("sink", F.lit(0))).otherwise(0)
    both = [f(f"{c}_a", f"{c}_c") for c, f in (("s0", F.least), ("s1", F.greatest), ("b0", F.least), ("b1", F.greatest), ("d0", F.least))]
    told = F.when(F.col("unknown_a") + F.col("unknown_c") > 0, "ukendt medlem").when(left != 1, "ikke én kanonisk").otherwise(_own_fault(*both, spread))
    nothing = (F.col("alias") == F.col("canonical")) & ~F.col("grouped_a")
    rows = rows.select("alias", "canonical", F.least("a", "c").alias("x"), F.greatest("a", "c").alias("y"), nothing.alias("nothing"), F.when(~nothing, told).alias("told"))
    rows = materialise(rows, "told")
    classes = materialise(rows.where("told IS NULL AND NOT nothing").select("x", "y").distinct(), "classes")

    # The parents of the members, as identities; one's own group is null.
    up = place.select(F.col("member").alias("parent"), F.col("component").alias("pc"), F.col("shut").alias("ps"), F.col("first").alias("p1"), F.col("final").alias("p2"))
    kin = parents.join(place.select(F.col("member").alias("child"), F.col("component").alias("cc"), F.col("shut").alias("cs"), F.col("first").alias("c1")).hint("merge"), "child", "left").join(up.hint("merge"), "parent", "left")
    kin = kin.select(
        F.coalesce("cc", "child").alias("component"), "child", F.coalesce("c1", "child").alias("child_first"), F.coalesce("cs", F.lit(False)).alias("child_shut"), F.coalesce("pc", "parent").alias("parent_component"),
        F.coalesce("p1", "parent").alias("parent_first"), F.coalesce("p2", "parent").alias("parent_final"), F.coalesce("ps", F.lit(False)).alias("parent_shut"))
    kin = materialise(kin, "kin")
    asked_of = classes.select(F.explode(F.array("x", "y")).alias("component")).distinct()
    mine = kin.join(asked_of.hint("merge"), "component", "left_semi")
    identity = F.struct(F.col("parent_component").alias("of"), F.when(F.col("parent_component") != F.col("component"), F.col("parent_first")).alias("as"))
    sets = materialise(mine.groupBy("component", "child").agg(F.array_sort(F.collect_set(identity)).alias("first"), F.array_sort(F.collect_set("parent_final")).alias("final")), "parent-sets")
    firsts = materialise(sets.select("component", "first").distinct(), "first-sets")
    finals = sets.groupBy("component").agg(F.min("final").alias("least"), F.max("final").alias("most"))
    shut = place.groupBy("component").agg(F.max("shut").alias("shut"))
    heads = asked_of.join(firsts.groupBy("component").agg(F.count("*").alias("n")), "component", "left").join(finals, "component", "left").join(shut, "component").select("component", F.coalesce("n", F.lit(0)).alias("n"), "least", "most", "shut")
    heads = materialise(heads, "heads")
    facts = classes.join(heads.select(F.col("component").alias("x"), *of(heads, "x")).hint("merge"), "x").join(heads.select(F.col("component").alias("y"), *of(heads, "y")).hint("merge"), "y")
    # More sets than can become one, unless members of a group that does not stand yet become one.
    many = ((F.col("n_x") > _MERGING) & ~F.col("shut_y")) | ((F.col("n_y") > _MERGING) & ~F.col("shut_x"))
    differ = (F.least("least_x", "least_y") != F.greatest("most_x", "most_y"))
    facts = materialise(facts.select("x", "y", many.alias("many"), F.coalesce(differ, F.lit(False)).alias("differ")), "class-facts")
    met = facts.where("NOT many").select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("component")).join(firsts.hint("merge"), "component")
    merged = F.array_sort(F.array_distinct(F.transform("first", lambda e: F.when(~e["of"].isin(F.col("x"), F.col("y")), e["as"]))))
    met = met.select("x", "y", merged.alias("set")).groupBy("x", "y").agg(F.count_distinct("set").alias("sets"), F.max(F.exists("set", lambda e: e.isNull())).alias("loop"))
    now = F.when(F.col("many") | (F.col("sets") > 1), "forældre").when(F.col("loop"), "egen forælder")
    facts = facts.join(met.hint("merge"), ["x", "y"], "left").select("x", "y", "differ", now.alias("now"))
    if unions is not None:
        side = lambda p, c: home.select(F.col("member").alias(p), F.col("component").alias(c)).hint("merge")
        wed = unions.select("p1", "p2").where("p1 IS NOT NULL AND p2 IS NOT NULL").join(side("p1", "u"), "p1", "left").join(side("p2", "v"), "p2", "left").select(F.coalesce("u", "p1").alias("u"), F.coalesce("v", "p2").alias("v"))
        wed = wed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        ends = classes.select("x", "y", F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ("xx", "xy", "yy")])).alias("e")).select("x", "y", "e.*")
        wed = ends.join(wed.hint("merge"), ["u", "v"], "left_semi").select("x", "y", F.lit("egen ægtefælle").alias("wed")).distinct()
        facts = facts.join(wed.hint("merge"), ["x", "y"], "left").select("x", "y", "differ", F.coalesce("now", "wed").alias("now"))
    facts = materialise(facts, "first-round")
    ring = _on_cycle(facts.where("now IS NULL"), kin, place, max_depth).withColumn("ring", F.lit(True))
    fate = facts.join(ring.hint("merge"), ["x", "y"], "left").select("x", "y", F.coalesce("now", F.when(F.col("ring"), "kreds").when(F.col("differ"), "forældre")).alias("fate"))

    out = rows.join(fate.hint("merge"), ["x", "y"], "left").select("alias", "canonical", F.when(~F.col("nothing"), F.coalesce("told", "fate")).alias("reason"))
    out = out.unionByName(asked.where("alias IS NULL OR canonical IS NULL").select("alias", "canonical", F.lit("ukendt medlem").alias("reason")))
    return out.select("alias", "canonical", F.col("reason").isNull().alias("accepted"), "reason")
