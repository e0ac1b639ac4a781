"""The prefix trie of conversations, summed by heavy-path decomposition.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. Of a node's children the one with most members is heavy, so
a light child has at most half its parent's members and a way down from the
root meets at most log2(conversations) light edges. Every path of heavy edges
is an array of nodes by depth: sums over subtrees are suffix sums along it, and
the sum of a whole path is attached to the parent of its head. The paths are
done by levels (light edges above them), the deepest first, one round a level.

Nothing walks a conversation or a path in one task: running values go by blocks
of ``BLOCK`` rows (within a block, then over the sums of the blocks before), so
a conversation may hold a third of all turns. Texts never leave the first scan;
a turn travels as the SHA-256 of its role and text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.plans.stages import ranked

from .common import fresh_path, materialise, table

#: Rows that a running value covers in one step.
BLOCK = 4096
#: Conversations c share turns with c - c % FAMILY; the first crc32(c) % SHARED turns at most.
FAMILY, SHARED = 100, 6

_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_MAX = (F.max, F.greatest)
_SUM = (F.sum, lambda a, b: a + b)


def _running(rows: DataFrame, keys: list[str], at: str, values: dict[str, tuple[tuple, Column]], last_first: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds running values (inclusive) along ``at`` within the keys; values maps a name to (an associative pair of aggregate and combination, its input)."""
    turn_round = (lambda c: F.col(c).desc()) if last_first else F.col
    rows = rows.withColumn("_block", F.floor(F.col(at) / block)).select("*", *[v.alias(f"_in_{n}") for n, (_, v) in values.items()])
    within = Window.partitionBy(*keys, "_block").orderBy(turn_round(at)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(turn_round("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_block").agg(*[agg(f"_in_{n}").alias(f"_in_{n}") for n, ((agg, _), _) in values.items()])
    ahead = sums.select(*keys, "_block", *[agg(f"_in_{n}").over(before).alias(f"_far_{n}") for n, ((agg, _), _) in values.items()])
    near = rows.select("*", *[agg(f"_in_{n}").over(within).alias(f"_near_{n}") for n, ((agg, _), _) in values.items()])

    def joined(name: str, combine) -> Column:
        far, own = F.col(f"_far_{name}"), F.col(f"_near_{name}")
        return F.when(far.isNull(), own).when(own.isNull(), far).otherwise(combine(far, own)).alias(name)

    kept = [c for c in rows.columns if c != "_block" and not c.startswith("_in_")]
    return near.join(ahead, [*keys, "_block"]).select(*kept, *[joined(n, combine) for n, ((_, combine), _) in values.items()])


def share_openings(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turn_sha, chars: conversation c opens with the first h turns of conversation c - c % 100 (h = crc32(c) % 6) and goes on with its own turns after its first h. Takes numbered turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    heads = turns.where(F.col("place") < SHARED).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "turn_sha", "chars")
    opening = convs.join(heads, "base").where("depth <= h").select("conv_id", "depth", "turn_sha", "chars")
    size = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shift = convs.join(size, "base", "left").select("conv_id", "h", (F.least(F.col("h"), F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where("place > h").select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "turn_sha", "chars")
    return opening.unionByName(own)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1, by turn, null first; equal turns by digest), turn_sha, chars. Null role and text are empty; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_sha"),
        F.length(text).cast("long").alias("chars"),
    )
    return ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_sha")]).select("conv_id", "place", "turn_sha", "chars")


def _key(lanes: list[Column], depth: Column) -> Column:
    return F.sha2(F.concat_ws(",", *[x.cast("string") for x in lanes], depth.cast("string")), 256)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds key and parent, the names of the sequences that end with a turn and before it: four lanes of the XOR of digests of (depth, turn)."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_sha")), 256)
    lanes = [f"lane{i}" for i in range(4)]
    rows = turns.withColumn("_d", digest).select("*", *[F.conv(F.substring("_d", 16 * i + 1, 15), 16, 10).cast("long").alias(f"own{i}") for i in range(4)])
    rows = _running(rows, ["conv_id"], "depth", {x: (_XOR, F.col(f"own{i}")) for i, x in enumerate(lanes)})
    before = [F.col(x).bitwiseXOR(F.col(f"own{i}")) for i, x in enumerate(lanes)]
    return rows.select("conv_id", "depth", "turn_sha", "chars", _key([F.col(x) for x in lanes], F.col("depth")).alias("key"), _key(before, F.col("depth") - 1).alias("parent"))


#: The name of the node without turns.
ROOT = "root"


def _ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """key, ends_sha256. The digest of a list is sequential by nature: blocks of ids are joined to strings in parallel, and only these strings pass the task of their node, one after another."""
    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("key", F.lit(ROOT)).alias("key"))
    placed = ranked(ends, ["key"], ["conv_id"]).withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    blocks = placed.groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
        at, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if key == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], schema=schema)

    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(digest, "key string, ends_sha256 string")


def _nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node. Different sequences under one key fail the job: every key has one parent and one last turn, which by induction over depth makes it one sequence."""
    def one(c: str) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two sequences share a key")))

    inner = rows.groupBy("key").agg(
        one("parent").alias("parent"), one("turn_sha").alias("turn_sha"), one("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
    ).select("key", F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(F.col("parent")).alias("parent"), "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.col("turn_sha").isNotNull().alias("whole"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("saved"), F.lit(True).alias("whole"))
    return inner.unionByName(root)


def prefix_trie(rebuilt: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row per node of the trie of the given turns (conv_id, depth, turn_sha, chars; depth from 1 without gaps).

    conv_ids: one column, every conversation once, those without turns too.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. No conversations: no rows.
    """
    spark = rebuilt.sparkSession
    convs = conv_ids.select(F.col(conv_ids.columns[0]).alias("conv_id"))
    rows = materialise(_prefixes(rebuilt), "trie-rows")
    nodes = materialise(_nodes(convs, rows), "trie-nodes")
    below = nodes.where("parent is not null").groupBy("parent").agg(
        F.count("*").alias("n_children"),
        F.max(F.struct("n_convs", (-F.col("conv_id")).alias("first"), F.col("key").alias("heavy"))).getField("heavy").alias("heavy"),
    ).withColumnRenamed("parent", "key")
    below = materialise(below, "trie-children")
    # Heads of light paths, laid along the conversations: the last one at or above a node names its path.
    heads = nodes.where("parent is not null").select("key", "parent").join(below.select(F.col("heavy").alias("key"), F.lit(1).alias("h")), "key", "left_anti").select("key", F.lit(1).alias("light"))
    own = rows.join(nodes.select("key", "conv_id"), ["key", "conv_id"], "left_semi").select("key", "conv_id", "depth")
    # Only conversations that are the smallest member of a node are walked.
    walked = rows.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "depth", "key").join(heads, "key", "left")
    walked = _running(walked, ["conv_id"], "depth", {
        "head": (_MAX, F.when(F.col("light") == 1, F.struct("depth", "key"))),
        "level": (_SUM, F.coalesce("light", F.lit(0)).cast("long")),
    }).select("conv_id", "key", F.coalesce(F.col("head.key"), F.lit(ROOT)).alias("path"), "level")
    placed = own.join(walked, ["conv_id", "key"]).select("key", "path", "level").unionByName(
        convs.limit(1).select(F.lit(ROOT).alias("key"), F.lit(ROOT).alias("path"), F.lit(0).cast("long").alias("level")))
    named = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.drop("whole").join(below.drop("heavy"), "key", "left").join(placed, "key").join(named, "parent", "left")
    full = full.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    where = fresh_path(spark, "trie-paths")
    full.write.partitionBy("level").parquet(where)
    full = spark.read.schema(full.schema).parquet(where)

    levels = full.agg(F.max("level")).first()[0]
    attached, parts = None, []
    for level in range(levels if levels is not None else 0, -1, -1):
        here = full.where(F.col("level") == level).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
        if attached is None:
            here = here.withColumn("light_leaves", F.lit(0).cast("long")).withColumn("light_saved", F.lit(0).cast("long"))
        else:
            here = here.join(attached, "key", "left")
        here = materialise(here.select(
            "key", "parent", "path", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
            (F.col("leaf") + F.coalesce("light_leaves", F.lit(0))).alias("own_leaves"), (F.col("saved") + F.coalesce("light_saved", F.lit(0))).alias("own_saved"),
        ), "trie-path-values")
        summed = _running(here, ["path"], "depth", {"n_leaves": (_SUM, F.col("own_leaves")), "saved_tokens": (_SUM, F.col("own_saved"))}, last_first=True)
        summed = materialise(summed.drop("own_leaves", "own_saved"), "trie-level")
        parts.append(summed)
        attached = summed.where("key = path and parent is not null").groupBy(F.col("parent").alias("key")).agg(F.sum("n_leaves").alias("light_leaves"), F.sum("saved_tokens").alias("light_saved"))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    ends = materialise(_ends(convs, rows), "trie-ends")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return total.join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_trie(table(spark, sf_dir, "conversations"))


def shared_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared openings (see share_openings). Rows without conv_id take no part; repeated rows are turns of their own; other columns are ignored; an empty table gives no rows."""
    turns = materialise(numbered_turns(conversations.select("conv_id", "turn", "role", "text")), "trie-turns")
    rebuilt = materialise(share_openings(turns), "trie-rebuilt")
    return prefix_trie(rebuilt, materialise(turns.select("conv_id").distinct(), "trie-convs"))
