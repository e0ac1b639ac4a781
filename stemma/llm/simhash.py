"""SimHash near-duplicates, found with BK-trees.

Fingerprints that differ in at most ``radius`` bits are linked. The distinct
fingerprints are sharded by the pigeonhole rule: the 64 bits are cut into
radius + 1 blocks, and two linked fingerprints agree in one block at least, so
each fingerprint goes to one shard per block and no link is lost. A shard
holds a BK-tree: a node's children are keyed by their integer Hamming distance
to it, and a search at distance d follows only the edges from d - radius to
d + radius. Each shard's tree is built once, in the task that its fingerprints
are sent to, and its queries run there. Shards above ``heavy`` fingerprints are
cut again over their remaining bits (same rule, same exactness) until the bits
left bound their size.

A task reports a spanning tree of every linked group in a shard, not the
group's pairs. The components of all reported edges come from label
propagation with pointer jumping; every round is a set of joins.

``similar_groups`` links texts by exact Jaccard similarity instead. The
two such pairs of sf0.001 lie 11 and 17 bits apart, and shards for such radii
would each hold a good part of the table, so the BK-trees give the first candidates and MinHash bands
the others; every candidate is verified on its texts before it is a link.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_slices

RADIUS = 2
SHINGLE = 3
SEED = 42
#: A shard above so many distinct fingerprints is cut again.
HEAVY = 20_000
#: Rows of whole shards that are turned into trees at a time.
_ROWS = 200_000
#: Pairs of a search and a tree node that are compared at a time, and children per node of the reported spanning trees.
_VISITS, _FAN = 200_000, 16
#: Bands of so many minima. A pair of similarity s shares no band with probability (1 - s ** 4) ** 24: 3e-6 at 0.8.
BANDS, MINIMA = 24, 4
#: Shingles that are hashed for all bands at a time.
_GRAMS = 4096


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as a signed long. Bit i is bit i of the XXH64 values."""
    import numpy as np
    import xxhash

    # bytes.lower() touches A-Z alone, bytes.split() cuts at space and U+0009 to U+000D.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        part = words[at : min(at + (1 << 15), count) + shingle - 1]
        n = max(1, len(part) - shingle + 1)
        grams = map(b" ".join, zip(*(part[i : i + n] for i in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(part)]
        h = np.fromiter((hash64(g, SEED) for g in grams), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long): one row per input row."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def fingerprint(texts):
        return texts.map(lambda t: text_fingerprint(t, shingle), na_action=None).astype("int64")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def shards(distinct: DataFrame, radius: int = RADIUS, heavy: int = HEAVY, levels: int = 3) -> DataFrame:
    """mask, value, fp: every fingerprint once per shard; a shard is the fingerprints whose bits under mask are value. distinct: a frame with fp."""
    fixed = [[]]
    out, rest = None, distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(levels):
        split, grown = [], []
        for bits in fixed:
            left = [b for b in range(64) if b not in bits]
            new = [sorted(bits + block) for block in _blocks(left, radius + 1)]
            split.append((F.lit(_mask(bits)), F.array(*[F.lit(_mask(b)).cast("long") for b in new])))
            grown += new
        options = F.lit(None).cast("array<bigint>")
        for mask, new in split:
            options = F.when(F.col("mask") == mask, new).otherwise(options)
        keyed = rest.select("fp", F.explode(options).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if level:
            keyed = keyed.distinct()
        fixed = [list(x) for x in {tuple(b) for b in grown}]
        big = materialise(keyed.groupBy("mask", "value").count().where(F.col("count") > heavy).select("mask", "value"), "simhash-heavy")
        if level == levels - 1 or big.isEmpty():
            return keyed if out is None else out.unionByName(keyed)
        light = keyed.join(big, ["mask", "value"], "left_anti")
        out = light if out is None else out.unionByName(light)
        rest = keyed.join(big, ["mask", "value"], "left_semi").select("fp", "mask")
    return out


def _forest(fp, root_of):
    """BK-trees of all runs at once. root_of: for each item, the index of its run's first item. Returns (item order, sorted parent * 65 + distance keys)."""
    import numpy as np

    items = np.flatnonzero(root_of != np.arange(len(fp)))
    at = root_of[items]
    child, key = [], []
    while items.size:
        k = at * 65 + np.bitwise_count(fp[items] ^ fp[at])
        order = np.argsort(k, kind="stable")
        items, k = items[order], k[order]
        first = np.empty(len(k), bool)
        first[0], first[1:] = True, k[1:] != k[:-1]
        heads = items[first]
        child.append(heads)
        key.append(k[first])
        at = heads[np.cumsum(first) - 1][~first]
        items = items[~first]
    if not child:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    child, key = np.concatenate(child), np.concatenate(key)
    order = np.argsort(key, kind="stable")
    return child[order], key[order]


def _groups(fp, run, radius: int):
    """A label for each item: the smallest index linked to it, directly or not, within its run."""
    import numpy as np

    n = len(fp)
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    root_of = np.repeat(start, np.diff(np.r_[start, n]))
    child, key = _forest(fp, root_of)
    label = np.arange(n)
    waiting = [(np.arange(lo, min(n, lo + _VISITS)), root_of[lo : lo + _VISITS]) for lo in range(0, n, _VISITS)]
    while waiting:  # a stack of bounded slices: the walk goes down before it goes on
        q, node = waiting.pop()
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (q != node)
        a, b = q[hit], node[hit]
        while True:  # union of the hits
            a1, b1 = label[a], label[b]
            open_ = a1 != b1
            if not open_.any():
                break
            a, b, a1, b1 = a[open_], b[open_], a1[open_], b1[open_]
            np.minimum.at(label, np.maximum(a1, b1), np.minimum(a1, b1))
            while (label != (up := label[label])).any():
                label = up
        first = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
        count = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right") - first
        end = np.cumsum(count)
        if not len(end) or not end[-1]:
            continue
        pos = np.repeat(first - (end - count), count) + np.arange(end[-1])
        q, node = np.repeat(q, count), child[pos]
        waiting += [(q[lo : lo + _VISITS], node[lo : lo + _VISITS]) for lo in range(0, len(q), _VISITS)]
    return label


def _tree_edges(fp, label):
    """Spanning trees of bounded degree: the i-th member of a group hangs on the member (i - 1) // _FAN, so that no node becomes a hot key."""
    import numpy as np

    order = np.lexsort((fp, label))
    fp, label = fp[order], label[order]
    start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    base = np.repeat(start, np.diff(np.r_[start, len(fp)]))
    i = np.arange(len(fp)) - base
    down = i > 0
    return fp[down], fp[base[down] + (i[down] - 1) // _FAN]


def shard_links(batches: Iterator, radius: int = RADIUS) -> Iterator:
    """Arrow batches of mask, value, fp, sorted by mask and value, to batches of linked pairs a, b."""
    import numpy as np
    import pyarrow as pa

    def links(mask, value, fp):
        new = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        run = np.cumsum(new)
        alone = np.bincount(run)[run] == 1
        run, fp = run[~alone], fp[~alone]
        if not len(fp):
            return None
        a, b = _tree_edges(fp, _groups(fp.view(np.uint64), run, radius))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        rows += batch.num_rows
        if rows >= _ROWS:
            mask, value, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1] + 1) if ((mask != mask[-1]) | (value != value[-1])).any() else 0
            if whole and (out := links(mask[:whole], value[:whole], fp[:whole])) is not None:
                yield out
            held, rows = [[mask[whole:], value[whole:], fp[whole:]]], len(fp) - whole
    if rows:
        if (out := links(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield out


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long): root is the smallest node of its component."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("up"))
        moved = materialise(stepped.join(up, "next").select("node", F.least("next", "up").alias("root"), (F.least("next", "up") != F.col("root")).alias("changed")), "labels")
        labels = moved.select("node", "root")
        if moved.where("changed").isEmpty():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, root) of ``components`` after further edges (a, b), found over the roots that these connect."""
    of = {c: labels.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}")) for c in "ab"}
    ends = edges.select("a", "b").join(of["a"], "a", "left").join(of["b"], "b", "left")
    further = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = labels.join(further.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialise(moved.unionByName(further.join(labels, "node", "left_anti")), "joined-labels")


def links(nodes: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """a, b: spanning trees of the linked groups of every shard. nodes: distinct fp."""
    sharded = shards(nodes, radius, heavy).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return materialise(sharded.select("mask", "value", "fp").mapInArrow(lambda it: shard_links(it, radius), "a long, b long").distinct(), "shard-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; shingles are runs of
    ``shingle`` words, repeats included (fewer words: the whole sequence; none,
    or null: fingerprint zero, which links like any other). A bit is one if it
    is set in more than half of the shingles' XXH64 values (seed 42).
    component_id is the smallest id reachable over links; null only where every
    id of the component is null. Rows that repeat an id are judged each. An
    empty table gives an empty result; other columns are ignored.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    labels = components(links(nodes, radius, heavy))
    linked = nodes.join(labels, F.col("fp") == F.col("node")).select("fp", "first", "root")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    merged = linked.join(smallest, "root").select("fp", "least")
    classes = nodes.join(merged, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    classes = materialise(classes, "fingerprint-classes")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_shingles(text: str | None, shingle: int) -> set[bytes]:
    """The different shingles of one text; none without words."""
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def _sketches(batches: Iterator, shingle: int) -> Iterator:
    """Batches of doc_id, text to doc_id, text, fp, grams (a hash of the set of shingles), n (its size) and keys (of the bands)."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    rng = np.random.default_rng(SEED)
    add, times = (rng.integers(0, 1 << 63, (BANDS * MINIMA, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    band = np.arange(BANDS, dtype=np.uint64)[:, None]
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column(1)):
            prints, sets, sizes, keys = [], [], [], []
            for t in texts:
                grams = text_shingles(t, shingle)
                h = np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))
                least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
                for at in range(0, len(h), _GRAMS):
                    np.minimum(least, ((h[at : at + _GRAMS] ^ add) * times).min(axis=1), out=least)
                rows = np.hstack([band, least.reshape(BANDS, MINIMA)])
                prints.append(text_fingerprint(t, shingle))
                sets.append(_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)))
                sizes.append(len(h))
                keys.append([_signed(xxhash.xxh64_intdigest(r.tobytes(), SEED)) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(prints, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text", "fp", "grams", "n", "keys"],
            )


def centre_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): each set of a large group with the group's centre, where their roots differ and their sizes allow ``similarity``. held: as for ``prefix_pairs``.

    The centre of an element is the one of its sets whose elements are the most
    frequent: in a group of near copies the text that they vary, or the one
    closest to it. A set goes to the centre of most of its elements. Only
    elements of more than ``_FAN`` sets count: where a group is small, so are
    its pairs.
    """
    often = held.groupBy("h").agg(F.count("*").alias("often")).where(F.col("often") > _FAN)
    common = materialise(held.join(often, "h"), "centre-elements")
    weight = common.groupBy("grams").agg((F.sum("often") / F.first("n")).alias("weight"))
    centre = common.join(weight, "grams").groupBy("h").agg(F.max(F.struct("weight", "grams", "n", "root")).alias("centre"))
    votes = common.join(centre, "h").groupBy("grams", "n", "root", "centre").agg(F.count("*").alias("votes"))
    own = votes.groupBy("grams", "n", "root").agg(F.max(F.struct("votes", "centre"))["centre"].alias("centre"))
    near = F.least("n", "centre.n") >= F.lit(float(similarity) - 1e-9) * F.greatest("n", "centre.n")
    return own.where((F.col("root") != F.col("centre.root")) & near).select(F.least("grams", "centre.grams").alias("a"), F.greatest("grams", "centre.grams").alias("b")).distinct()


def prefix_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): all pairs of different roots whose sets may have a Jaccard similarity of ``similarity`` or more. held: grams, n (size), root and h, a row for each element of the set grams.

    Such sets share ``similarity`` of each other's elements, so in any order
    of the elements their first common one is among the first n - similarity *
    n + 1 of both. In the order by frequency these are the rarest, and a set
    with more elements of its own alone than that has no partner. From the
    first common element on, enough must be left in both. Where an element's
    sets are mostly of one root, the others meet them and each other; those of
    that root don't meet.
    """
    from pyspark.sql.window import Window

    least = float(similarity) - 1e-9
    often = held.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    common = held.join(often, "h")
    own = Window.partitionBy("grams")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "h"))
    first = common.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    first = materialise(first.select("h", "grams", "n", "root", "place"), "similar-prefixes")
    roots = first.groupBy("h", "root").agg(F.count("*").alias("sets"))
    major = roots.groupBy("h").agg(F.count("*").alias("roots"), F.max(F.struct("sets", "root"))["root"].alias("major")).where("roots > 1").select("h", "major")
    first = materialise(first.join(major, "h"), "similar-mixed")
    x = first.where("root <> major").select("h", F.col("grams").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"), F.col("place").alias("at_a"))
    y = first.select("h", F.col("grams").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r_b"), F.col("place").alias("at_b"), "major")
    near = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")
    enough = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b"))
    once = (F.col("r_b") == F.col("major")) | (F.col("a") < F.col("b"))
    return x.join(y, "h").where((F.col("r_a") != F.col("r_b")) & once & near & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, component_id: one row per input row; linked are texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Words, shingles, ids and empty tables are as in ``near_duplicates``; texts
    without words are alike. Candidates are the links of the BK-trees and trees
    of bounded degree over the texts of each band. Once these are verified,
    texts that share a band and are not yet in one component are compared with
    the centre of their group (``centre_pairs``, one pair for each text); those
    that are still apart where they share one of their rarest shingles
    (``prefix_pairs``, which loses none), so a group whose members stay unlike
    costs the members that have partners, not all pairs.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.window import Window

    @pandas_udf("double")
    def jaccard(a, b):
        import pandas as pd

        def one(x, y):
            x, y = text_shingles(x, shingle), text_shingles(y, shingle)
            return len(x & y) / len(x | y) if x or y else 1.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], index=a.index, dtype="float64")

    @pandas_udf("array<long>")
    def hashes(texts):
        import xxhash

        return texts.map(lambda t: list({_signed(xxhash.xxh64_intdigest(g, SEED)) for g in text_shingles(t, shingle)}))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialise(rows.mapInArrow(lambda it: _sketches(it, shingle), "doc_id long, text string, fp long, grams long, n long, keys array<long>"), "sketches")
    nodes = materialise(marked.groupBy("grams").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys")), "sketch-nodes")
    met = nodes.select("grams", "n", F.explode("keys").alias("key"))
    shared = met.groupBy("key").count().where("count > 1").select("key")
    met = materialise(met.join(shared, "key"), "sketch-bands")

    def verified(pairs: DataFrame, tag: str = "similar-candidates") -> DataFrame:
        """The pairs a, b and whether their texts are similar."""
        pairs = materialise(pairs, tag)
        wanted = pairs.select(F.col("a").alias("grams")).union(pairs.select("b")).distinct()
        texts = materialise(marked.join(wanted, "grams", "left_semi").groupBy("grams").agg(F.min("text").alias("text")), "similar-texts")
        both = pairs.join(texts.select(F.col("grams").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("grams").alias("b"), F.col("text").alias("text_b")), "b")
        return materialise(both.select("a", "b", (jaccard("text_a", "text_b") >= F.lit(float(similarity))).alias("alike")), "similar-verified")

    # First candidates: the i-th member of a band hangs on its member (i - 1) / _FAN, and linked fingerprints on each other.
    placed = materialise(met.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("grams")) - 1), "sketch-places")
    up = placed.select("key", F.col("i").alias("up"), F.col("grams").alias("a"))
    trees = placed.where("i > 0").select("key", F.floor((F.col("i") - 1) / _FAN).alias("up"), F.col("grams").alias("b")).join(up, ["key", "up"]).select("a", "b")
    holder = materialise(nodes.groupBy("fp").agg(F.min("grams").alias("grams")), "sketch-fingerprints")
    close = links(holder, radius, heavy).join(holder.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(holder.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    tried = verified(trees.unionByName(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())
    labels = components(tried.where("alike"))

    def apart(labels: DataFrame) -> DataFrame:
        """grams, n, root of the texts that share a band across components."""
        own = met.join(labels.select(F.col("node").alias("grams"), "root"), "grams", "left").withColumn("root", F.coalesce("root", "grams"))
        mixed = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return materialise(own.join(mixed, "key").select("grams", "n", "root").distinct(), "sketch-apart")

    # The centres first: what they link needs no other pair.
    first = apart(labels)
    texts = marked.join(first, "grams", "left_semi").groupBy("grams").agg(F.min("text").alias("text"))
    held = materialise(first.join(texts, "grams").select("grams", "n", "root", F.explode(hashes("text")).alias("h")), "similar-elements")
    central = verified(centre_pairs(held, similarity).join(tried, ["a", "b"], "left_anti"), "similar-centres")
    labels = joined(labels, central.where("alike"))
    rest = held.select("grams", "h").join(apart(labels), "grams")
    cross = prefix_pairs(rest, similarity).join(tried.unionByName(central), ["a", "b"], "left_anti")
    labels = joined(labels, verified(cross).where("alike"))

    linked = nodes.join(labels, F.col("grams") == F.col("node")).select("grams", "first", "root")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = nodes.select("grams", "first").join(linked.join(smallest, "root").select("grams", "least"), "grams", "left")
    classes = materialise(classes.select("grams", F.coalesce("least", "first").alias("component_id")), "similar-classes")
    return marked.select("doc_id", "grams").join(classes, "grams").select("doc_id", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
