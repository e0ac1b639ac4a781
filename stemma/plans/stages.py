"""Cutting long plans, and the fixpoints that graph operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the session names none, a temporary one on a single machine; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stemma-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


#: The lists of the scratch blocks that are open.
_NOTED: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to fresh paths inside the block is deleted at its end; only results written elsewhere may be read after it."""
    made: list[str] = []
    _NOTED.append(made)
    try:
        yield
    finally:
        _NOTED.remove(made)
        for path in made:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; the file system drops it when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _NOTED:
        _NOTED[-1].append(path)
    return path


def materialise(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no earlier work."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], order: list, out: str = "place", buckets: int = 64) -> DataFrame:
    """Adds the place (from 1) of every row within its key, without sorting a key in one task.

    The rows are dealt out by ranges of (keys, order), so that a hot key lies in
    many partitions, and numbered within each; the counts of the partitions
    before, one row per key and partition, are added. order should be unique.
    """
    rows = df.repartitionByRange(buckets, *keys, *order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows, "ranked")
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part")
    ahead = sizes.select(*keys, "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    meet = (F.col("r._part") == F.col("s._part"))
    for k in keys:
        meet = meet & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    rows = rows.withColumn("_own", own).alias("r").join(ahead.alias("s"), meet)
    return rows.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_own") + F.col("_ahead")).cast("long").alias(out))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component for every node of the undirected edges; component is the smallest node reachable.

    Label propagation with pointer jumping: a round is a map-side minimum over
    the neighbours and a join, and the number of rounds grows with the
    logarithm of a component's diameter. The joins are by sorting: a broadcast
    of the labels would pass the driver in every round.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    pairs = materialise(pairs.union(pairs.select("y", "x")).distinct(), "links")
    label = materialise(pairs.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")), "labels")
    while True:
        heard = pairs.join(label.select(F.col("node").alias("y"), "component").hint("merge"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("heard"))
        mid = label.join(heard.hint("merge"), "node").select("node", "component", F.least("component", "heard").alias("via"))
        jump = label.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = mid.join(jump.hint("merge"), "via").select("node", F.least("via", "far").alias("next"), "component")
        new = materialise(new, "labels")
        label = new.select("node", F.col("next").alias("component"))
        if new.where("next <> component").isEmpty():
            return label


#: Depths of a closure between two comparisons with all pairs found before.
COMPARE_EVERY = 8


def closure(edges: DataFrame, start: str, end: str, max_depth: int = 50, sources: DataFrame | None = None, last: bool = False) -> DataFrame:
    """node, reached, depth: everything reachable along the edges, at its least depth (1 and up).

    A depth holds each pair once, so a graph in which paths meet again costs its
    pairs, not its paths. What was found at a lesser depth is taken out every
    ``COMPARE_EVERY`` depths, not at each, since that moves all pairs found so
    far. A pair that returns to its own node is kept: it shows a cycle. Deeper
    than max_depth fails the job.
    sources: the nodes (one column) to start from; without it, all.
    last: also the column last, the smallest node before reached on a shortest path.
    """
    edges = materialise(edges.select(F.col(start).alias("node"), F.col(end).alias("reached")).where("node is not null and reached is not null").distinct(), "edges")
    frontier = edges.withColumn("depth", F.lit(1))
    if last:
        frontier = frontier.withColumn("last", F.col("node"))
    if sources is not None:
        nodes = sources.select(F.col(sources.columns[0]).alias("node")).distinct()
        frontier = materialise(frontier.join(nodes, "node", "left_semi"), "frontier")
    found, recent, depth = [], [frontier], 1
    step = edges.select(F.col("node").alias("via"), F.col("reached").alias("further"))
    while True:
        ahead = frontier.select("node", F.col("reached").alias("via")).join(step, "via")
        if last:
            ahead = ahead.groupBy("node", F.col("further").alias("reached")).agg(F.min("via").alias("last"))
            ahead = ahead.select("node", "reached", F.lit(depth + 1).alias("depth"), "last")
        else:
            ahead = ahead.select("node", F.col("further").alias("reached")).distinct().withColumn("depth", F.lit(depth + 1))
        frontier = materialise(ahead, "frontier")
        ended = frontier.isEmpty()
        if not ended:
            depth += 1
            recent.append(frontier)
            if depth % COMPARE_EVERY and depth <= max_depth:
                continue
        elif not recent:
            return reduce(DataFrame.unionByName, found)
        new = reduce(DataFrame.unionByName, recent)
        if len(recent) > 1:
            what = F.min(F.struct("depth", "last")).alias("_least") if last else F.min("depth").alias("depth")
            new = new.groupBy("node", "reached").agg(what)
            new = new.select("node", "reached", "_least.*") if last else new
        if found:
            new = new.join(reduce(DataFrame.unionByName, found).select("node", "reached"), ["node", "reached"], "left_anti")
        new = materialise(new, "found")
        found.append(new)
        frontier, recent = new.where(F.col("depth") == depth), []
        if ended or frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)
        if depth > max_depth:
            raise ValueError(f"paths longer than {max_depth}")


def _spread(colour: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, c: every node's least c among those that reach it along pairs (x, y), itself included."""
    while True:
        told = pairs.join(colour.withColumnRenamed("node", "x").hint("merge"), "x").groupBy(F.col("y").alias("node")).agg(F.min("c").alias("told"))
        new = materialise(colour.join(told.hint("merge"), "node", "left").select("node", F.least("c", "told").alias("c"), (F.col("told") < F.col("c")).alias("less")), "colours")
        colour = new.select("node", "c")
        if new.where("less").isEmpty():
            return colour


def cycles(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, cycle for every node on a directed cycle; cycle is the smallest node of its strongly connected component.

    Edges whose start has no edge in, or whose end has none out, are trimmed
    until none is left to trim, a layer from both sides a round. What remains is
    coloured forward by the least node that reaches each node; the nodes of a
    colour that reach its namesake are a component. They go, and so on. Edges
    with a null end lie on no cycle. The joins are by sorting, as in ``components``.
    """
    e = materialise(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null").distinct(), "arcs")
    loops = e.where("x = y").select(F.col("x").alias("node"), F.col("x").alias("cycle"))
    rest, found = e.where("x <> y"), loops.where("false")
    while True:
        size = rest.count()
        while size:
            kept = rest.join(rest.select(F.col("y").alias("x")).distinct().hint("merge"), "x", "left_semi").join(rest.select(F.col("x").alias("y")).distinct().hint("merge"), "y", "left_semi")
            rest = materialise(kept.select("x", "y"), "arcs")
            now = rest.count()
            if now == size:
                break
            size = now
        if not size:
            break
        nodes = rest.select(F.col("x").alias("node")).distinct()
        colour = _spread(nodes.select("node", F.col("node").alias("c")), rest)
        one = rest.join(colour.select(F.col("node").alias("x"), F.col("c").alias("cx")).hint("merge"), "x").join(colour.select(F.col("node").alias("y"), F.col("c").alias("cy")).hint("merge"), "y").where("cx = cy")
        one = materialise(one.select("x", "y"), "colour-arcs")
        # Backwards from the namesakes: 0 spreads, all others start at 1.
        back = _spread(colour.select("node", F.when(F.col("node") == F.col("c"), 0).otherwise(1).alias("c")), one.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ring = colour.withColumnRenamed("c", "cycle").join(back.where("c = 0").select("node").hint("merge"), "node", "left_semi")
        ring = materialise(ring, "rings")
        found = found.unionByName(ring)
        rest = rest.join(ring.select(F.col("node").alias("x")).hint("merge"), "x", "left_anti").join(ring.select(F.col("node").alias("y")).hint("merge"), "y", "left_anti")
        rest = materialise(rest, "arcs")
    # A node that was a component by itself is on a cycle only if it has a loop.
    wide = found.join(found.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle").hint("merge"), "cycle", "left_semi").select("node", "cycle")
    return wide.unionByName(loops.join(wide.hint("merge"), "node", "left_anti")).distinct()


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order (a distinct-on)."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
