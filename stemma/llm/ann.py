"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` vectors (those with the smallest hash
of their id): every inner node cuts its part into ``BRANCH`` clusters, and the
number of leaves grows with the table until a leaf has about ``LEAF`` rows.
Every row is indexed: it descends to one leaf. A query visits leaves best bin
first: a priority queue holds the nodes seen so far by their distance, and the
nearest is opened next. How many leaves a query visits is calibrated: for
``CALIBRATION`` rows the true neighbours are found by brute force over all
rows, and the visits are widened until ``RECALL`` of those neighbours lie in
visited leaves.

Copies of a vector are the same point: of each distinct vector only the k + 1
smallest ids can be among anyone's k nearest, so a vector that fills a third of
the table is k + 1 rows, and equal queries are searched once. Leaves are cut
into blocks of bounded size on both sides, so no group grows with the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

K = 5
SAMPLE = 32_768
BRANCH, LEAF = 12, 256
#: Leaves have this many sample rows at least, which bounds the tree by the sample.
LEAST = 16
CALIBRATION, RECALL = 256, 0.97
#: Rows and queries that meet in one group.
BLOCK, QUERIES = 8_192, 2_048
#: Cells of a block's rough cosines, and candidates whose exact cosine is computed at a time.
_CELLS, _EXACT = 1 << 21, 1 << 17
#: How far a rough cosine may be from the exact one, for each component.
_ERROR = 1e-15


@dataclass
class Tree:
    """children[i]: the child nodes of node i; leaf[i]: its leaf number, -1 for an inner node; centre: unit vectors."""

    centre: object
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x):
        """The leaf of every row of x (unit vectors): at each node the nearest child."""
        import numpy as np

        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centre[self.children[node]].T).argmax(axis=1)
            for j, child in enumerate(self.children[node]):
                if len(mine := rows[near == j]):
                    todo.append((child, mine))
        return out

    def visit(self, q) -> Iterator[int]:
        """Leaves for the unit vector q, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            for child, s in zip(self.children[node], self.centre[self.children[node]] @ q, strict=True):
                heapq.heappush(queue, (-float(s), child))


def _kmeans(x, k: int, rng, rounds: int = 8):
    """Spherical k-means with far-apart seeds. Returns unit centres and each row's cluster; empty clusters are dropped."""
    import numpy as np

    at, near = [int(rng.integers(len(x)))], None
    for _ in range(k - 1):
        gap = np.maximum(0, 1 - x @ x[at[-1]])
        near = gap if near is None else np.minimum(near, gap)
        if not near.sum() > 1e-9:
            break
        at.append(int(rng.choice(len(x), p=near / near.sum())))
    c = x[at]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, mine, x)
        norm = np.linalg.norm(sums, axis=1)
        c = sums[norm > 1e-12] / norm[norm > 1e-12, None]
        if not len(c):
            return x[at[:1]], np.zeros(len(x), np.int64)
    return c, (x @ c.T).argmax(axis=1)


def fit_tree(x, leaves: int, branch: int = BRANCH, least: int = LEAST, seed: int = 42) -> Tree:
    """A tree over the unit vectors x with about ``leaves`` leaves: the largest leaf is cut until there are enough."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres, tree = [np.zeros(x.shape[1]) if len(x) == 0 else x.mean(axis=0)], Tree(None, [[]], [-1])
    queue, done, n = [(-len(x), 0, np.arange(len(x)))], [], 1
    while queue and n < leaves:
        size, node, rows = heapq.heappop(queue)
        if -size < 2 * least:
            done.append(node)
            continue
        c, mine = _kmeans(x[rows], min(branch, leaves - n + 1, max(2, -size // least)), rng)
        if len(c) < 2 or len(np.unique(mine)) < 2:
            done.append(node)
            continue
        for j in range(len(c)):
            if len(part := rows[mine == j]):
                centres.append(c[j])
                tree.children.append([])
                tree.leaf.append(-1)
                tree.children[node].append(len(centres) - 1)
                heapq.heappush(queue, (-len(part), len(centres) - 1, part))
        n += len(tree.children[node]) - 1
    ends = sorted(done + [node for _, node, _ in queue])
    for i, node in enumerate(ends):
        tree.leaf[node] = i
    tree.centre = np.array(centres)
    return tree


def _matrix(column):
    """An Arrow column of equally long lists of doubles as a matrix."""
    import numpy as np

    whole = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x):
    import numpy as np

    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _best(q, q_norm, x, x_norm, ids, k: int):
    """For every query its k best rows by exact cosine, then id: (query index, row index, score)."""
    import numpy as np

    rough = (q / q_norm[:, None]) @ (x / x_norm[:, None]).T
    # All rows that rounding alone could keep from the k best: equal cosines of different vectors are ties by id.
    least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if k < len(x) else np.full(len(q), -np.inf)
    who, row = np.nonzero(rough >= least[:, None] - _ERROR * (x.shape[1] + 8))
    # Equal vectors get equal scores wherever they lie: each is summed by itself, in the order of its components.
    score = np.empty(len(who))
    for lo in range(0, len(who), _EXACT):
        a, b = who[lo : lo + _EXACT], row[lo : lo + _EXACT]
        score[lo : lo + _EXACT] = (q[a] * x[b]).sum(axis=1) / (q_norm[a] * x_norm[b])
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], row[rank < k], score[rank < k]


def _norms(x):
    import numpy as np

    return np.sqrt((x * x).sum(axis=1))


def usable(vector):
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def index_rows(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows: vec_id, vector. Adds the column leaf."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            leaf = held.value.assign(_unit(_matrix(b.column(1)))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int64())], ["vec_id", "vector", "leaf"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, leaf long")


def calibrate(indexed: DataFrame, tree: Tree, ids, q, k: int, recall: float) -> int:
    """The visits that reach ``recall`` for the probes (ids, vectors): their true neighbours come from a scan of all rows."""
    import numpy as np

    held = indexed.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches):
        import pyarrow as pa

        ids, q = held.value
        for b in batches:
            if not b.num_rows:
                continue
            every, leaf, vec = _matrix(b.column(1)), b.column(2).to_numpy(), b.column(0).to_numpy()
            step = max(1, _CELLS // max(1, len(q)))
            for lo in range(0, len(every), step):
                x = every[lo : lo + step]
                who, row, score = _best(q, _norms(q), x, _norms(x), vec[lo : lo + step], k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(vec[lo + row]), pa.array(leaf[lo + row]), pa.array(score)], ["probe", "vec_id", "leaf", "score"])

    found = indexed.select("vec_id", "vector", "leaf").mapInArrow(scan, "probe long, vec_id long, leaf long, score double")
    by = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    true = found.where("probe <> vec_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).collect()  # k rows per probe
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["probe"], []).append(r["leaf"])
    places = []
    for i, vec in zip(ids.tolist(), _unit(q), strict=True):
        left = wanted.get(i, [])
        for n, leaf in enumerate(tree.visit(vec), 1):
            places += [n] * left.count(leaf)
            left = [x for x in left if x != leaf]
            if not left:
                break
    visits, places = 1, np.array(places or [1])
    while (places <= visits).mean() < recall:
        visits += 1
    return min(visits, tree.leaves)


def _probe(queries: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """One row per query and leaf to visit."""
    held = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        import itertools

        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else []
            leaves = [list(itertools.islice(held.value.visit(v), visits)) for v in (_unit(x) if b.num_rows else [])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int64()))], ["rep", "vector", "leaves"])

    rows = queries.select("rep", "vector").mapInArrow(run, "rep long, vector array<double>, leaves array<long>")
    return rows.select("rep", "vector", F.explode("leaves").alias("leaf"))


def _search(rows: DataFrame, queries: DataFrame, k: int, sample: int, leaf_rows: int, recall: float, calibration: int) -> DataFrame:
    """rep, vec_id, score: the k + 1 best rows found for each distinct query vector. rows: vec_id, vector, at most k + 1 per distinct vector."""
    by_hash = [F.xxhash64("vec_id"), F.col("vec_id")]
    n = rows.count()
    import numpy as np

    got = rows.select("vec_id", "vector").orderBy(*by_hash).limit(sample).toArrow()
    ids, x = got.column(0).to_numpy(), _matrix(got.column(1))
    tree = fit_tree(_unit(x), max(1, min(n // leaf_rows, len(x) // LEAST)))
    indexed = materialise(index_rows(rows, tree), "ann-index")
    visits = calibrate(indexed, tree, ids[:calibration], x[:calibration], k, recall)
    return _meet(indexed, _probe(queries, tree, visits), k)


def _meet(indexed: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """rep, vec_id, score: the k + 1 best rows for each query among those of the leaves that it visits."""
    import numpy as np

    probes = materialise(probes, "ann-probes")
    # One row per leaf: bounded by the tree.
    size = indexed.groupBy("leaf").agg(F.count("*").alias("n")).join(probes.groupBy("leaf").agg(F.count("*").alias("q")), "leaf")
    size = size.select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("parts"))
    size = F.broadcast(materialise(size, "ann-leaves"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = indexed.join(size, "leaf").select("leaf", F.pmod(F.hash("vector"), F.col("blocks")).alias("block"), every("parts").alias("part"), "vec_id", "vector")
    right = probes.join(size, "leaf").select("leaf", every("blocks").alias("block"), F.pmod(F.hash("rep"), F.col("parts")).alias("part"), "rep", "vector")

    def meet(a, b):
        import pyarrow as pa

        if not a.num_rows or not b.num_rows:
            none = pa.array([], pa.int64())
            return pa.table([none, none, pa.array([], pa.float64())], ["rep", "vec_id", "score"])
        x, q = _matrix(a.column("vector")), _matrix(b.column("vector"))
        ids, reps = a.column("vec_id").to_numpy(), b.column("rep").to_numpy()
        out = []
        step = max(1, _CELLS // len(x))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            who, row, score = _best(part, _norms(part), x, _norms(x), ids, k + 1)
            out.append((reps[lo + who], ids[row], score))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["rep", "vec_id", "score"])

    keys = ["leaf", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "rep long, vec_id long, score double")
    by = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1).drop("place")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF, recall: float = RECALL, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors that were found, by cosine, ties to the smaller id.

    A row is never its own neighbour (same id). Vectors that are null, zero or
    hold null or non-finite components take no part, nor do null ids; vectors
    of different lengths are never compared, and may be of any number of
    lengths. Repeated ids with the same vector
    count once, with different vectors as often as they have vectors. With
    fewer candidates than k all of them are returned. Empty tables give an
    empty result; other columns are ignored.
    """

    def clean(df):
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    # A hot vector leaves each task as k + 1 rows: the window's limit is applied before its shuffle.
    first = Window.partitionBy("vector").orderBy("vec_id")
    rows = clean(vectors).withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    rows = materialise(rows.dropDuplicates(["vec_id", "vector"]), "ann-rows")
    asked = clean(queries).dropDuplicates(["vec_id", "vector"])
    reps = materialise(asked.select("vector").distinct().withColumn("rep", F.monotonically_increasing_id()), "ann-queries")
    named = asked.join(reps, "vector").select(F.col("vec_id").alias("query_id"), "rep")
    # A length with too few rows for two leaves is one leaf; all of these are searched together, the others by a tree each.
    d, one = F.size("vector"), 2 * leaf_rows
    sizes = rows.groupBy(d.alias("d")).agg(F.count("*").alias("n")).agg(F.collect_list(F.when(F.col("n") >= one, F.col("d"))).alias("large"), F.count_if(F.col("n") < one).alias("small")).first()
    out = [_search(rows.where(d == x), reps.where(d == x), k, sample, leaf_rows, recall, calibration) for x in sorted(sizes["large"])]
    if sizes["small"]:
        few = lambda df: df.where(~d.isin(sizes["large"])) if sizes["large"] else df
        out.append(_meet(few(rows).withColumn("leaf", d.cast("long")), few(reps).withColumn("leaf", d.cast("long")), k))
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by = Window.partitionBy("query_id", "rep").orderBy(F.desc("score"), "vec_id")
    pairs = named.join(materialise(reduce(DataFrame.unionByName, out), "ann-found"), "rep").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
