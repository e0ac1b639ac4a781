"""Spelling variants: a self-join of the vocabulary's trie at distance one.

The trie is partitioned by prefix: a prefix with more than ``WORDS`` words (or
``LETTERS`` code points of them) below it is wide, and a word belongs to its
shortest prefix that is not wide. Within a partition one task walks the trie
with the set of active nodes, those within distance one of the node at hand,
handed from parent to child; a terminal's active terminals are its near words.

At the wide prefixes above, the same step is a join. The active nodes that
leave a wide prefix u at distance one are u's other children (replacement) and
u itself (deletion); below them the bound is used up, so the remainders of
both words must be equal. Rows meet on (u, remainder), and such a group holds
one word per letter at most, whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

#: A partition of the trie holds this many words at most, and this many code points unless it is a single word.
WORDS, LETTERS = 1024, 1 << 18
#: Words are at least so long and so frequent.
MIN_LENGTH, MIN_COUNT = 5, 3
#: One of so many occurrences loses a letter.
TYPOS = 97
RUN = "[A-Za-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n over whole texts. Null text has no words, a null doc_id reads as 'null'; counts are combined before the shuffle."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % TYPOS == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _partitions(words: DataFrame, limit: int, letters: int) -> DataFrame:
    """word, part: the length of its shortest prefix that is not wide; null where all its prefixes are wide. One round per depth that has wide prefixes."""
    done, open_, depth = None, words.select("word"), 0
    while True:
        prefix = F.substring("word", 1, depth)
        sizes = open_.groupBy(prefix.alias("u")).agg(F.count("*").alias("k"), F.sum(F.length("word")).alias("letters"))
        wide = sizes.where((F.col("k") > limit) | ((F.col("k") > 1) & (F.col("letters") > letters))).select("u", F.lit(True).alias("wide"))
        marked = materialise(open_.withColumn("u", prefix).join(wide, "u", "left").select("word", F.coalesce("wide", F.lit(False)).alias("wide")), "trie-depth")
        closed = marked.where(~F.col("wide")).select("word", F.lit(depth).alias("part"))
        ended = marked.where(F.col("wide") & (F.length("word") == depth)).select("word", F.lit(None).cast("int").alias("part"))
        here = closed.unionByName(ended)
        done = here if done is None else done.unionByName(here)
        open_ = marked.where(F.col("wide") & (F.length("word") > depth)).select("word")
        if open_.isEmpty():
            return materialise(done, "trie-partitions")
        depth += 1


def _near_below(words: list[str]) -> list[tuple[str, str]]:
    """All ordered pairs of the words at distance one, by active-node sets over their trie."""
    children: list[dict[str, int]] = [{}]
    ends: list[str | None] = [None]
    for word in words:
        node = 0
        for c in word:
            node = children[node].setdefault(c, len(children))
            if node == len(children):
                children.append({})
                ends.append(None)
        ends[node] = word
    out = []
    stack = [(0, {0: 0} | dict.fromkeys(children[0].values(), 1))]
    while stack:
        node, active = stack.pop()
        if ends[node] is not None:
            out.extend((ends[node], ends[v]) for v, k in active.items() if k == 1 and ends[v] is not None)
        for c, child in children[node].items():
            exact, one = set(), set()
            for v, k in active.items():
                if k == 0:
                    one.add(v)
                    one.update(children[v].values())
                match = children[v].get(c)
                if match is not None:
                    (one if k else exact).add(match)
            for v in exact:
                one.update(children[v].values())
            stack.append((child, dict.fromkeys(one, 1) | dict.fromkeys(exact, 0)))
    return out


def near_pairs(words: DataFrame, limit: int = WORDS, letters: int = LETTERS) -> DataFrame:
    """word, other: every ordered pair of the distinct words (column word) at distance one. No words: no pairs."""
    placed = _partitions(words, limit, letters)

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        at, held = None, []
        for pdf in batches:
            out = []
            for u, word in zip(pdf["u"], pdf["word"]):
                if u != at:
                    out += _near_below(held)
                    at, held = u, []
                held.append(word)
            yield pd.DataFrame(out, columns=["word", "other"])
        yield pd.DataFrame(_near_below(held), columns=["word", "other"])

    # The same letters are one partition at one length only: below a prefix that is not wide there is no other.
    parts = placed.where("part is not null").select(F.concat(F.lit("^"), F.expr("substring(word, 1, part)")).alias("u"), "word")
    below = parts.repartition("u").sortWithinPartitions("u").mapInPandas(walk, "word string, other string")

    wide = placed.where("part is null or part > 0").select("word", F.explode(F.expr("sequence(0, coalesce(part - 1, length(word)))")).alias("d"))
    through = wide.where("d < length(word)").selectExpr("substring(word, 1, d) AS u", "substring(word, d + 2) AS rest", "substring(word, d + 1, 1) AS c", "word")
    past = wide.selectExpr("substring(word, 1, d) AS u", "substring(word, d + 1) AS rest", "'' AS c", "word")
    # A group has one word per letter and one without: bounded by the alphabet.
    met = through.unionByName(past).groupBy("u", "rest").agg(F.collect_set(F.struct("c", "word")).alias("group")).where("size(group) > 1")
    above = met.select(F.explode("group").alias("a"), "group").select("a", F.explode("group").alias("b")).where("a.c <> b.c and a.word <> b.word").selectExpr("a.word AS word", "b.word AS other")
    return below.unionByName(above).distinct()


def spelling_forms(words: DataFrame, limit: int = WORDS, letters: int = LETTERS) -> DataFrame:
    """word, n -> word, form, root, n, n_near, form_n (see op12_spelling). A form is at least twice as frequent as its word, so chains end; roots are found by doubling the step."""
    near = near_pairs(words, limit, letters)
    counted = near.join(words.select(F.col("word").alias("other"), F.col("n").alias("n_other")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= 2 * F.col("n")
    forms = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    ), "forms")
    step = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
    return forms.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(materialise(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")), "vocabulary"))
