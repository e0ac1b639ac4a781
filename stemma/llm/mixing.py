"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by one grouped sum;
everything after that works on the cells. Raking scales the cells' weights to
the target of each source, language and topic in turn until all three marginals
agree within ``TOLERANCE``. A cell can keep no more tokens than it has: a weight
above that counts as the cell's tokens, and the factors of the other cells make
up for it. A target beyond all tokens of its value becomes these, and the other
values share the rest of the budget. Documents are kept with their cell's
probability, its raked weight over its tokens. Targets that no weights can meet
at once are reported as a warning.

All of it is DataFrame operations. A hot source is a handful of cells, so no
group grows with the documents; the cells go through the shared folder after
every step, which keeps the plans short. What the driver reads are sums and the
largest gap.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

DIMENSIONS = ("source", "lang", "topic")
#: Without explicit targets a marginal's shares are in proportion to its tokens to this power: below 1 it lifts the rare values.
TEMPER = {"source": 0.7, "lang": 0.9, "topic": 1.0}
#: Share of all tokens that the mixture may keep.
BUDGET = 0.8
#: The largest gap of a marginal, as a share of the budget, at which raking ends; and the sweeps after which it reports instead.
TOLERANCE, SWEEPS = 1e-10, 60
SEED = 42

#: topic -> lower-case words that speak for it. Callers pass their own, or the name of a column that holds the topic.
TOPICS = {
    "law": ["license", "licensed", "copyright", "rights", "reserved"],
    "contact": ["mail", "email", "phone", "tel", "call"],
    "computing": ["token", "key", "password", "secret", "http", "https"],
}
_WORD = r"(?:^|[^\p{L}])(?:%s)(?:[^\p{L}]|$)"


def tokens(text: Column) -> Column:
    """White-space separated words, one at least, so that an empty document has a weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def topic(text: Column, topics: dict[str, list[str]]) -> Column:
    """The topic whose words occur most; of equal ones the first listed; 'other' without any. Most texts are read once."""
    topics = {name: words for name, words in topics.items() if words}
    if not topics:
        return F.lit("other")
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.regexp_count(low, F.lit(_WORD % "|".join(words))) for words in topics.values()]
    best, chosen = F.greatest(*hits, F.lit(0)), F.lit("other")
    for name, n in reversed(list(zip(topics, hits, strict=True))):
        chosen = F.when(n == best, F.lit(name)).otherwise(chosen)
    return F.when(low.rlike(_WORD % "|".join(w for words in topics.values() for w in words)), chosen).otherwise(F.lit("other"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    word = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(word, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _goals(cells: DataFrame, dimension: str, targets: dict[str, float] | None, temper: float, budget: float) -> DataFrame:
    """dimension, goal: tokens to keep of each value, all of its own at most."""
    n = F.sum("tokens").alias("n")
    if targets is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temper)))
    else:
        share = F.lit(0.0)
        for value, x in targets.items():
            share = F.when(F.col(dimension) == value, F.lit(float(x))).otherwise(share)
    goal = materialise(cells.groupBy(dimension).agg(n).select(dimension, "n", share.alias("share")), "rake-goal")
    scale, capped = 0.0, -1
    while True:
        full = F.col("n") < F.lit(scale) * F.col("share")
        got = goal.agg(F.count_if(full), F.sum(F.when(full, F.col("n")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first()
        if got[0] == capped or not got[2]:
            break
        capped, scale = got[0], (budget - got[1]) / got[2]
    return goal.select(dimension, F.when(full, F.col("n")).otherwise(F.lit(scale) * F.col("share")).cast("double").alias(f"goal_{dimension}"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, budget: float = BUDGET, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """cells: source, lang, topic, tokens. Adds ``weight``: the tokens to keep of each cell, whose marginals meet the targets.

    targets: dimension -> value -> share; shares are scaled to sum to 1 over
    the values that the cells have, and a value without a target gets 0. A
    dimension without targets takes its tempered token shares. Each step is a
    map-side sum by one dimension and a join with the few sums.
    """
    targets, temper = targets or {}, TEMPER | (temper or {})
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("raw", F.col("tokens") * F.lit(float(budget)))
    for d in DIMENSIONS:
        cells = cells.join(_goals(cells.select(d, "tokens"), d, targets.get(d), temper[d], budget * total), d)
    columns = [*DIMENSIONS, "tokens", *(f"goal_{d}" for d in DIMENSIONS)]
    cells = materialise(cells.select(*columns, "raw"), "rake")
    weight = F.least("raw", F.col("tokens").cast("double"))
    ways = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("value"), F.col(f"goal_{d}").alias("goal"), weight.alias("weight")) for d in DIMENSIONS])).alias("x")
    gap, sweep = 0.0, 0
    while total:
        sums = cells.select(ways).groupBy("x.d", "x.value").agg((F.sum("x.weight") - F.first("x.goal")).alias("gap"))
        gap = sums.agg(F.max(F.abs("gap"))).first()[0] / max(1.0, budget * total)
        if gap <= tolerance or sweep == sweeps:
            break
        sweep += 1
        for d in DIMENSIONS:
            own, goal = F.col("tokens").cast("double"), F.col("goal")
            full = F.coalesce(F.sum(F.when(F.col("raw") >= own, own)), F.lit(0.0)).alias("full")
            free = F.coalesce(F.sum(F.when(F.col("raw") < own, F.col("raw"))), F.lit(0.0)).alias("free")
            reached = F.col("full") + F.col("free")
            factor = F.when((F.col("free") > 0) & (goal > F.col("full")), (goal - F.col("full")) / F.col("free")).when(reached > goal, goal / reached).otherwise(F.lit(1.0))
            found = cells.groupBy(d).agg(full, free, F.first(f"goal_{d}").alias("goal")).select(d, factor.alias("factor"))
            cells = materialise(cells.join(found, d).select(*columns, (F.col("raw") * F.col("factor")).alias("raw")), "rake")
    if gap > max(tolerance, 1e-6):
        warnings.warn(f"no weights meet all targets: the largest gap of a marginal is {gap:.2g} of the budget", stacklevel=2)
    return cells.select(*DIMENSIONS, "tokens", weight.alias("weight"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, budget: float = BUDGET, topics: dict[str, list[str]] | None = None, seed: int = SEED, tolerance: float = TOLERANCE, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept: one row per input row.

    topic_col: a column that holds the topic; else it is told by ``topics``. A
    null source, language or topic is the value '' of its dimension; null text
    counts as empty (one token, topic 'other'); a null id is drawn like the
    empty string. Rows that repeat an id get the same draw. A very long text is
    read whole. An empty table gives an empty result; other columns are ignored.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), value(source_col).alias("source"), value(lang_col).alias("lang"),
        (value(topic_col) if topic_col else topic(F.col(text_col), TOPICS if topics is None else topics)).alias("topic"),
        tokens(F.col(text_col)).alias("tokens"),
    )
    rows = materialise(rows, "mix-rows")
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    raked = rake(cells, targets, temper, budget, tolerance, sweeps)
    chance = raked.select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("probability"))
    return rows.join(chance, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "tokens", F.round("probability", 5).alias("probability"),
        (draw(F.col("doc_id"), seed) < F.col("probability")).alias("kept"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same mixture in SQL, with the sweeps written out, one relation per step: more of them than the tables need, since a sweep changes nothing once the marginals agree."""
    low = "lower(coalesce(text, ''))"
    word = lambda words: "'" + _WORD % "|".join(words) + "'"
    hits = {t: f"len(regexp_extract_all({low}, {word(words)}))" for t, words in TOPICS.items()}
    best = f"greatest({', '.join(hits.values())})"
    chosen = "CASE " + f"WHEN {best} = 0 THEN 'other' " + " ".join(f"WHEN {h} = {best} THEN '{t}'" for t, h in hits.items()) + " END"
    parts = [
        f"""r AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {chosen} AS topic,
          CAST(greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS BIGINT) AS tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL)",
        f"b AS (SELECT {BUDGET} * sum(tokens) AS b FROM c)",
    ]
    for d in DIMENSIONS:
        parts.append(f"s_{d}_0 AS MATERIALIZED (SELECT {d}, sum(tokens) AS n, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER[d]}) AS share, 0.0::DOUBLE AS x FROM c GROUP BY {d})")
        for k in range(5):  # as many values as are capped one after the other
            parts.append(f"""s_{d}_{k + 1} AS MATERIALIZED (SELECT {d}, n, share, (SELECT (b - sum(CASE WHEN n < x * share THEN n ELSE 0 END)) / sum(CASE WHEN n < x * share THEN 0 ELSE share END)
              FROM s_{d}_{k}, b GROUP BY b) AS x FROM s_{d}_{k})""")
        parts.append(f"g_{d} AS MATERIALIZED (SELECT {d}, least(n, x * share) AS goal FROM s_{d}_5)")
    parts.append(f"w0 AS MATERIALIZED (SELECT *, tokens * {BUDGET}::DOUBLE AS raw FROM c)")
    n = 0
    for _ in range(40):
        for d in DIMENSIONS:
            parts.append(f"f{n} AS (SELECT {d}, sum(CASE WHEN raw >= tokens THEN tokens ELSE 0 END)::DOUBLE AS ful, sum(CASE WHEN raw < tokens THEN raw ELSE 0 END) AS free FROM w{n} GROUP BY {d})")
            factor = "CASE WHEN free > 0 AND goal > ful THEN (goal - ful) / free WHEN ful + free > goal THEN goal / (ful + free) ELSE 1 END"
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, raw * {factor} AS raw FROM w{n} JOIN f{n} USING ({d}) JOIN g_{d} USING ({d}))")
            n += 1
    parts.append(f"p AS (SELECT source, lang, topic, least(raw, tokens) / tokens AS probability FROM w{n})")
    drawn = f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, 12) AS BIGINT)"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, tokens, round(probability, 5) AS probability,
       {drawn} / {float(1 << 48)} < probability AS kept
FROM r JOIN p USING (source, lang, topic)"""


OP7_SQL = _sql()
