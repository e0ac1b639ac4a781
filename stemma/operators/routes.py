"""Lines and ways through a forest in which every person has one parent at most.

Lines go by doubling: a person's line of 2n is its line of n and that of the
person at its end, so 40 generations take six joins. A line is bounded by its
limit, so it is an array; the way between two persons compares two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.plans.stages import materialise, ranked

#: Generations of a line, itself included; older ones are left out, and a cycle ends there.
GENERATIONS = 40


def places(tree: DataFrame) -> DataFrame:
    """id, parent_id, place from tree (id, parent_id, ord; id unique): a parent that is no person is null; place is that among the parent's children by ord, then id, from 0 (without a parent: 0). Children of one parent may be any number."""
    ids = tree.select(F.col("id").alias("parent_id")).distinct()
    with_parent = tree.select("id", "parent_id", "ord").join(ids, "parent_id", "left_semi")
    placed = ranked(with_parent.select("id", "parent_id", "ord"), ["parent_id"], ["ord", "id"]).select("id", "parent_id", (F.col("place") - 1).alias("place"))
    return tree.select("id").join(placed, "id", "left").select("id", "parent_id", F.coalesce("place", F.lit(0)).alias("place"))


def lines(steps: DataFrame, limit: int) -> DataFrame:
    """id, line from steps (id, next, item): the items of a person, its next, that one's next and so on, limit at most."""
    rows = materialise(steps.select("id", F.array("item").alias("line"), "next"), "lines")
    size = 1
    while size < limit:
        # Ended lines are kept out of the join: their null would be one hot key.
        open_ = rows.where("next IS NOT NULL")
        if open_.isEmpty():
            break
        ahead = rows.select(F.col("id").alias("next"), F.col("line").alias("more"), F.col("next").alias("then"))
        joined = open_.join(ahead, "next", "left").select("id", F.when(F.col("more").isNull(), F.col("line")).otherwise(F.concat("line", "more")).alias("line"), F.col("then").alias("next"))
        rows = materialise(joined.unionByName(rows.where("next IS NULL")), "lines")
        size *= 2
    return rows.select("id", F.slice("line", 1, limit).alias("line"))


def _two_lines(tree: DataFrame) -> DataFrame:
    """id, up (itself last, the oldest first), down (its first child, that one's first child and so on); items are structs of id and place."""
    t = materialise(places(tree), "places")
    item = F.struct("id", "place").alias("item")
    up = lines(t.select("id", F.col("parent_id").alias("next"), item), GENERATIONS)
    first = t.where("parent_id IS NOT NULL AND place = 0").select(F.col("parent_id").alias("id"), F.col("id").alias("next"))
    down = lines(t.join(first, "id", "left").select("id", "next", item), GENERATIONS + 1)
    return up.join(down.withColumnRenamed("line", "down"), "id").select("id", F.reverse("line").alias("up"), F.slice("down", 2, GENERATIONS).alias("down"))


def snap_paths(tree: DataFrame) -> DataFrame:
    """id, path, depth: the line from the oldest ancestor down to a person and on through first children; depth is the person's place in it, from 0. tree: id, parent_id, ord."""
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return _two_lines(tree).select("id", F.concat(ids("up"), ids("down")).alias("path"), (F.size("up") - 1).alias("depth"))


def _common(a: Column, b: Column) -> Column:
    """How many items two lines share from their beginning."""
    least = F.least(F.size(a), F.size(b))
    unlike = F.array_position(F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, least), lambda x: x["a"]["id"] == x["b"]["id"]), False)
    return F.when(unlike == 0, least).otherwise((unlike - 1).cast("int"))


def routes(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """focus, me, step, remaining, route: the way from one person to another along the focus's line.

    Up or down the line to where the other's ancestors leave it, sideways among
    siblings, then down, each generation entered at its first child. route
    is an array of (step, n) with steps up, down, left, right; step is the
    first, or 'arrived', and remaining their sum. Without a common oldest
    ancestor, or with an end that is null or no person, step, remaining and
    route are null. pairs: focus, me; repeated pairs give repeated rows.
    """
    both = materialise(_two_lines(tree), "lines")
    here = both.select(F.col("id").alias("focus"), F.concat("up", "down").alias("snap"), (F.size("up") - 1).alias("depth"))
    there = both.select(F.col("id").alias("me"), F.col("up").alias("own"))
    # Left joins on a null end would meet in one task: such pairs are set aside.
    whole, rest = pairs.select("focus", "me").where("focus IS NOT NULL AND me IS NOT NULL"), pairs.select("focus", "me").where("focus IS NULL OR me IS NULL")
    c = F.col
    rows = whole.join(here, "focus", "left").join(there, "me", "left").withColumn("same", _common(c("snap"), c("own")))
    n_own, n_snap = F.size("own"), F.size("snap")
    on_line, past_end = c("same") == n_own, c("same") >= n_snap
    leave = F.when(on_line, n_own - 1).when(past_end, n_snap - 1).otherwise(c("same"))
    at = lambda line: F.try_element_at(line, c("same") + 1)["place"]
    aside = F.when(on_line | past_end, F.lit(0)).otherwise(at(c("own")) - at(c("snap"))).cast("long")
    rows = rows.select("focus", "me", "same", "own", leave.alias("leave"), (leave - c("depth")).cast("long").alias("along"), aside.alias("aside"))
    leg = lambda step, n: F.struct(step.alias("step"), n.cast("long").alias("n"))
    down = F.flatten(F.transform(F.slice("own", c("leave") + 2, GENERATIONS), lambda x: F.array(leg(F.lit("down"), F.lit(1)), leg(F.lit("right"), x["place"]))))
    ends = F.array(leg(F.when(c("along") < 0, "up").otherwise("down"), F.abs("along")), leg(F.when(c("aside") < 0, "left").otherwise("right"), F.abs("aside")))
    route = F.when(c("focus") == c("me"), F.slice(ends, 1, 0)).when(c("same") > 0, F.filter(F.concat(ends, down), lambda x: x["n"] > 0))
    known = c("own").isNotNull() & c("leave").isNotNull()
    out = rows.select("focus", "me", F.when(known, route).alias("route"))
    out = out.unionByName(rest.withColumn("route", F.lit(None).cast(out.schema["route"].dataType)))
    remaining = F.aggregate("route", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    step = F.when(F.size("route") == 0, "arrived").when(F.size("route") > 0, c("route")[0]["step"])
    return out.select("focus", "me", step.alias("step"), remaining.alias("remaining"), "route")
