"""Record linkage: blocked candidates, scores, tiers, comparison and review.

Frames to be linked have id, name_key, birth_min, birth_max, death_min,
death_max and sex. Candidates meet by an equal block (the first letter of the
key) and a common band of years, as classes of equal records; a hot class is a
skewed equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.dates import known, overlaps
from stemma.plans.stages import keep_first, materialise


#: Pairs of names whose similarity a worker remembers.
_PAIRS = 1 << 19


@dataclass(frozen=True)
class Config:
    year_window: int = 5
    #: Years of a band of the blocking key.
    band: int = 16
    name: float = 0.6
    birth: float = 0.2
    death: float = 0.1
    sex: float = 0.1
    auto: float = 0.9
    review: float = 0.7
    margin: float = 0.05
    top: int = 10
    #: Divide by the weights of what is known on both sides; then a name alone is never enough for an automatic link.
    normalised: bool = False

    @property
    def name_floor(self) -> float:
        """Below this similarity no pair can reach a review."""
        return max(0.0, (self.review - (self.birth + self.death + self.sex)) / self.name)


def letter_places(text: str) -> dict[str, int]:
    """Letter -> the places where it stands, as bits."""
    places: dict[str, int] = {}
    bit = 1
    for c in text:
        places[c] = places.get(c, 0) | bit
        bit <<= 1
    return places


def jaro_winkler(a: str, b: str, p: float = 0.1, longest: int = 4, places: dict[str, int] | None = None) -> float:
    """Similarity of two strings. The bonus for a common beginning always counts, and half transpositions do too. places: ``letter_places(b)``, if at hand.

    Each letter of a takes the first free equal letter of b within reach, which
    is the lowest bit of a few numbers.
    """
    if a == b:
        return 1.0 if a else 0.0
    places = letter_places(b) if places is None else places
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    near, free, taken, found = (1 << (reach + 1)) - 1, (1 << len(b)) - 1, [], []
    for i, c in enumerate(a):
        if hit := places.get(c, 0) & free & near:
            bit = hit & -hit
            free ^= bit
            taken.append(bit)
            found.append(c)
        near = near << 1 | (i < reach)
    m = len(taken)
    if not m:
        return 0.0
    there = [found[k] for k in sorted(range(m), key=taken.__getitem__)]
    moved = 0.0 if there == found else sum(map(str.__ne__, found, there)) / 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(longest, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return score + same * p * (1 - score)


def jaro_winkler_column(a: Column, b: Column, p: float = 0.1) -> Column:
    """Spark has no such function: an Arrow-batched UDF, after all cheaper filters. p = 0 is plain Jaro."""

    known_: dict[tuple, float] = {}  # names repeat; a worker remembers a bounded number of pairs

    @F.pandas_udf("double")
    def similar(x, y):
        import pandas as pd

        pairs = list(zip(x, y, strict=True))
        new = set(pairs).difference(known_)
        if len(known_) + len(new) > _PAIRS:
            known_.clear()
            new = set(pairs)
        places = {t: letter_places(t or "") for _, t in new}
        known_.update((st, jaro_winkler(st[0] or "", st[1] or "", p, places=places[st[1]])) for st in new)
        return pd.Series(list(map(known_.__getitem__, pairs)), index=x.index, dtype="float64")

    return similar(a, b)


def _bands(lo: Column, hi: Column, known_: str, unknown: str, more: str | None, years: int) -> Column:
    """The bands of an interval with both ends, and those that stand for unknown ends; first: an interval's first band."""
    at = lambda y: F.floor(y / F.lit(years)).cast("int")
    there = F.transform(F.sequence(at(lo), F.greatest(at(lo), at(hi))), lambda b: F.concat(F.lit("b"), b.cast("string")))
    both = F.concat(there, F.array(*[F.lit(x) for x in (known_, more) if x]))
    return F.when(lo.isNotNull() & hi.isNotNull(), both).otherwise(F.array(*[F.lit(x) for x in (unknown, more) if x]))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)), 9)


def score(cfg: Config) -> Column:
    """The weighted score of a candidate frame's columns."""
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    plain = F.lit(cfg.name) * F.col("name_sim") + F.lit(cfg.birth) * flag("birth_eq") + F.lit(cfg.death) * flag("death_eq") + F.lit(cfg.sex) * flag("sex_eq")
    if not cfg.normalised:
        return F.round(plain, 9)
    weight = F.lit(cfg.name) + F.lit(cfg.birth) * flag("birth_known") + F.lit(cfg.death) * flag("death_known") + F.lit(cfg.sex) * flag("sex_known")
    return F.round(plain / weight, 9)


def candidates(a: DataFrame, b: DataFrame, cfg: Config = Config(), similarity: Callable[[Column, Column], Column] = jaro_winkler_column) -> DataFrame:
    """a_id, b_id, name_sim, agreement flags and unique_block: at most ``cfg.top`` candidates a record, the best by score, then smaller id.

    An empty key matches nothing. Years only exclude where a's are known; a
    candidate without years stays. unique_block counts all candidates above the
    name floor, before the top is taken.

    Records with the same key, years and sex are one class. Keys that share a
    block and a band are compared once, classes of similar keys are scored once,
    and a class stands for its first ids, as many as can reach the top: so work
    grows with the classes, and with the records only by their own candidates.
    """
    cols = ["name_key", "birth_min", "birth_max", "death_min", "death_max", "sex"]
    side = lambda df, s: df.where("name_key <> ''").select(F.substring("name_key", 1, 1).alias("block"), F.col("id").alias(f"{s}_id"), *[F.col(x).alias(f"{s}_{x}") for x in cols])
    of_a, of_b = [f"a_{x}" for x in cols], [f"b_{x}" for x in cols]
    c = F.col
    keep = max(2, cfg.top)  # two at least, until it is known whether there is one only
    records = side(a, "a")
    # Few bytes make many pairs: adaptive execution would leave the classes to one task.
    spread = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = materialise(records.select("block", *of_a).distinct().repartition(spread).withColumn("_a", F.monotonically_increasing_id()), "classes")
    firsts = side(b, "b").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*of_b).orderBy("b_id"))).where(c("_r") <= keep)
    right = materialise(firsts.groupBy("block", *of_b).agg(F.array_sort(F.collect_list("b_id")).alias("_ids")), "classes")

    w = F.lit(cfg.year_window)
    near = overlaps(c("a_birth_min") - w, c("a_birth_max") + w, c("b_birth_min"), c("b_birth_max"))
    # a with known years meets b by bands, once at their first common one, and all b without; a without known years meets every b.
    first = lambda y: F.floor(y / F.lit(cfg.band)).cast("int")
    left_at = left.withColumn("band", F.explode(_bands(c("a_birth_min") - w, c("a_birth_max") + w, "open", "every", None, cfg.band)))
    right_at = right.withColumn("band", F.explode(_bands(c("b_birth_min"), c("b_birth_max"), "", "open", "every", cfg.band)))
    once = ~c("band").startswith("b") | (c("band") == F.concat(F.lit("b"), F.greatest(first(c("a_birth_min") - w), first(c("b_birth_min"))).cast("string")))
    meet = left_at.select("block", "band", "a_name_key").distinct().join(right_at.select("block", "band", "b_name_key").distinct(), ["block", "band"])
    names = meet.select("a_name_key", "b_name_key").distinct().withColumn("name_sim", similarity(c("a_name_key"), c("b_name_key"))).where(c("name_sim") >= cfg.name_floor)
    names = materialise(names, "names")
    pairs = left_at.drop("block").join(names, "a_name_key").join(right_at.drop("block"), ["b_name_key", "band"]).where(once & near)

    def both(what: str) -> tuple[Column, Column]:
        lo, hi = (lambda s: c(f"{s}_{what}_min")), (lambda s: c(f"{s}_{what}_max"))
        there = known(lo("a"), hi("a")) & known(lo("b"), hi("b"))
        return there, there & overlaps(lo("a"), hi("a"), lo("b"), hi("b"))

    (birth_known, birth_eq), (death_known, death_eq) = both("birth"), both("death")
    sex_known = (c("a_sex") != "ukendt") & (c("b_sex") != "ukendt")
    rows = pairs.select(
        "_a", "_ids", "name_sim", birth_eq.alias("birth_eq"), death_eq.alias("death_eq"), ((c("a_sex") == c("b_sex")) & sex_known).alias("sex_eq"),
        birth_known.alias("birth_known"), death_known.alias("death_known"), sex_known.alias("sex_known"))
    per = Window.partitionBy("_a")
    plain = score(Config(**{**cfg.__dict__, "normalised": False}))
    # Of classes in the order of score and first id, those after the top add no candidate; the limit is applied before the shuffle.
    rows = rows.withColumn("_r", F.row_number().over(per.orderBy(F.desc(plain), c("_ids")[0]))).where(c("_r") <= keep)
    rows = rows.withColumn("unique_block", (F.count("*").over(per) == 1) & (F.size("_ids") == 1)).withColumn("b_id", F.explode("_ids"))
    rows = rows.withColumn("_r", F.row_number().over(per.orderBy(F.desc(plain), "b_id"))).where(c("_r") <= cfg.top).drop("_r", "_ids")
    same = c("r.a_name_key") == c("k.a_name_key")
    for x in of_a[1:]:
        same = same & c(f"r.{x}").eqNullSafe(c(f"k.{x}"))
    own = records.alias("r").join(left.alias("k"), same).select("a_id", "_a")
    return own.join(rows, "_a").select("a_id", "b_id", *[x for x in rows.columns if x not in ("_a", "b_id")])


def assign_tiers(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds score and tier (auto, review, none); automatic links are one to one.

    A record's best candidate is eligible if it is good enough and far enough
    ahead of its next. Of eligible rows for one b the best wins; every row that
    comes after a winner and shares its a or b is none. Windows replace the
    walk down the ranking: an a has one eligible row at most. Ties go to the
    smaller ids.
    """
    c = F.col
    rank = [F.desc("score"), F.asc("a_id"), F.asc("b_id")]
    per_a = Window.partitionBy("a_id").orderBy(*rank)
    rows = scored.withColumn("score", score(cfg)).withColumn("_top", F.row_number().over(per_a) == 1).withColumn("_next", F.lead("score").over(per_a))
    enough = (c("score") >= cfg.auto) & c("_top") & (c("_next").isNull() | (F.round(c("score") - c("_next"), 9) >= cfg.margin))
    if cfg.normalised:
        enough = enough & (c("birth_known") | c("death_known"))
    rows = rows.withColumn("_ok", enough)
    first_b = Window.partitionBy("b_id", "_ok").orderBy(*rank)
    rows = rows.withColumn("_win", c("_ok") & (F.row_number().over(first_b) == 1))
    mark = F.when(c("_win"), F.struct(-c("score"), c("a_id"), c("b_id")))
    rows = rows.withColumn("_wa", F.min(mark).over(Window.partitionBy("a_id"))).withColumn("_wb", F.min(mark).over(Window.partitionBy("b_id")))
    here = F.struct(-c("score"), c("a_id"), c("b_id"))
    after = F.coalesce(here > c("_wa"), F.lit(False)) | F.coalesce(here > c("_wb"), F.lit(False))
    tier = F.when(c("_win"), "auto").when(after, "none").when(c("score") >= cfg.review, "review").otherwise("none")
    return rows.withColumn("tier", tier).drop("_top", "_next", "_ok", "_win", "_wa", "_wb")


def tier_counts(tiers: DataFrame) -> DataFrame:
    """Pairs per tier, missing tiers as 0."""
    spark = tiers.sparkSession
    domain = spark.range(3).select(F.element_at(F.array(*[F.lit(x) for x in ("auto", "review", "none")]), (F.col("id") + 1).cast("int")).alias("tier"))
    return domain.join(tiers.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision and recall of found (a_id, b_id) against truth (a_id, b_id); 0 where nothing is there."""
    hit = found.join(truth, ["a_id", "b_id"], "left_semi").agg(F.count("*").alias("hits"))
    sums = found.agg(F.count("*").alias("found")).crossJoin(truth.agg(F.count("*").alias("truth"))).crossJoin(hit)  # single rows
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(0.0)
    return sums.select("found", "truth", "hits", F.round(share("found"), 9).alias("precision"), F.round(share("truth"), 9).alias("recall"))


def sweep(tiers: DataFrame, truth: DataFrame, autos: list[float], reviews: list[float]) -> DataFrame:
    """auto_cut, review_cut, n_auto, n_review, hits for every combination of the cuts: one pass, each pair expanded by the few combinations."""
    marked = tiers.join(truth.select("a_id", "b_id", F.lit(True).alias("true")), ["a_id", "b_id"], "left")
    cuts = F.explode(F.array(*[F.struct(F.lit(a).alias("auto_cut"), F.lit(r).alias("review_cut")) for a in autos for r in reviews])).alias("cut")
    rows = marked.select("score", F.coalesce("true", F.lit(False)).alias("true"), cuts).select("*", "cut.*")
    return rows.groupBy("auto_cut", "review_cut").agg(
        F.count_if(F.col("score") >= F.col("auto_cut")).alias("n_auto"), F.count_if(F.col("score").between(F.col("review_cut"), F.col("auto_cut")) & (F.col("score") < F.col("auto_cut"))).alias("n_review"),
        F.count_if((F.col("score") >= F.col("auto_cut")) & F.col("true")).alias("hits"))


def compare_sets(ours: DataFrame, theirs: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of persons on both sides under the accepted links (a_id, b_id): category and the pair in their ids.

    enig: in both; mangler_hos_os: only theirs; ekstra_hos_os: only ours, both
    ends linked; uden_for_scope: ours with an end that has no link.
    """
    mapped = ours
    for x in columns:
        link = links.select(F.col("a_id").alias(x), F.col("b_id").alias(f"_{x}"))
        mapped = mapped.join(link, x, "left").drop(x).withColumnRenamed(f"_{x}", x)
    lost = F.lit(False)
    for x in columns:
        lost = lost | F.col(x).isNull()
    inside, outside = mapped.where(~lost).select(*columns).distinct(), mapped.where(lost).select(*columns)
    both = inside.withColumn("_o", F.lit(1)).join(theirs.select(*columns).distinct().withColumn("_t", F.lit(1)), columns, "full")
    kind = F.when(F.col("_o").isNotNull() & F.col("_t").isNotNull(), "enig").when(F.col("_t").isNotNull(), "mangler_hos_os").otherwise("ekstra_hos_os")
    return both.select(kind.alias("category"), *columns).unionByName(outside.select(F.lit("uden_for_scope").alias("category"), *columns))


def compare_facts(a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """a_id, b_id, problem: linked records whose years don't meet (dato_uenig) or whose known sexes differ (køn_uenig)."""
    x = links.select("a_id", "b_id").join(a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), "a_id").join(b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]), "b_id")
    c = F.col
    apart = lambda w: ~overlaps(c(f"a_{w}_min"), c(f"a_{w}_max"), c(f"b_{w}_min"), c(f"b_{w}_max"))
    sex = (c("a_sex") != "ukendt") & (c("b_sex") != "ukendt") & (c("a_sex") != c("b_sex"))
    problems = F.array_compact(F.array(F.when(apart("birth") | apart("death"), "dato_uenig"), F.when(sex, "køn_uenig")))
    return x.select("a_id", "b_id", F.explode(problems).alias("problem"))


def corroborate(review: DataFrame, accepted: DataFrame, our_edges: DataFrame, their_edges: DataFrame) -> DataFrame:
    """a_id, b_id, support, detail: how many accepted parent or child pairs stand behind a pair under review. Edges have child, parent."""
    def around(side: DataFrame, own: str, kin: str) -> DataFrame:
        up = side.select(F.col("child").alias(own), F.col("parent").alias(kin), F.lit("forælder").alias("kind"))
        return up.unionByName(side.select(F.col("parent").alias(own), F.col("child").alias(kin), F.lit("barn").alias("kind"))).distinct()

    ours, theirs = around(our_edges, "a_id", "a_kin"), around(their_edges, "b_id", "b_kin")
    link = accepted.select(F.col("a_id").alias("a_kin"), F.col("b_id").alias("b_kin"))
    hits = review.select("a_id", "b_id").join(ours, "a_id").join(link, "a_kin").join(theirs, ["b_id", "b_kin", "kind"], "left_semi")
    sums = hits.groupBy("a_id", "b_id").agg(F.count("*").alias("support"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "a_kin"))), "; ").alias("detail"))
    return review.select("a_id", "b_id").join(sums, ["a_id", "b_id"], "left").select("a_id", "b_id", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("detail", F.lit("")).alias("detail"))


def merge_decisions(tiers: DataFrame, decisions: DataFrame) -> DataFrame:
    """a_id, b_id, origin: the accepted links. decisions: a_id, b_id, decision (bekræft, afvis, ny-id), new_id. Automatic links stand unless rejected."""
    d = decisions.select("a_id", "b_id", "decision", "new_id")
    rows = tiers.where("tier IN ('auto', 'review')").join(d, ["a_id", "b_id"], "left")
    c = F.col("decision")
    target = F.when(c == "ny-id", F.col("new_id")).when((c == "bekræft") | (c.isNull() & (F.col("tier") == "auto")), F.col("b_id"))
    return rows.select("a_id", target.alias("b_id"), F.when(c.isNull(), "auto").otherwise(c).alias("origin")).where("b_id IS NOT NULL")


def worklist(tiers: DataFrame, linked: DataFrame, rejected: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per record a: status, strong and weak candidate counts, best candidate. linked: a_id; rejected: a_id, b_id pairs."""
    open_ = tiers.where(F.col("score") >= cfg.review).join(rejected.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    sums = open_.groupBy("a_id").agg(F.count_if(F.col("score") >= cfg.auto).alias("strong"), F.count_if(F.col("score") < cfg.auto).alias("weak"), F.min_by("b_id", F.struct(-F.col("score"), F.col("b_id"))).alias("best"))
    people = tiers.select("a_id").distinct()
    done = linked.select("a_id", F.lit(True).alias("done")).distinct()
    status = F.when(F.col("done"), "afklaret").when(F.coalesce(F.col("strong") + F.col("weak"), F.lit(0)) > 0, "aaben").otherwise("formodet_ny")
    rows = people.join(sums, "a_id", "left").join(done, "a_id", "left")
    return rows.select("a_id", status.alias("status"), F.coalesce("strong", F.lit(0)).alias("strong"), F.coalesce("weak", F.lit(0)).alias("weak"), "best")


def inherit_sources(own: DataFrame, unions: DataFrame) -> DataFrame:
    """person, source: persons without a source take their partners', if these have exactly one between them. own: person, source; unions: p1, p2."""
    pairs = unions.where("p2 IS NOT NULL").select(F.col("p1").alias("person"), F.col("p2").alias("partner"))
    pairs = pairs.unionByName(pairs.select(F.col("partner").alias("person"), F.col("person").alias("partner")))
    seen = pairs.join(own.select(F.col("person").alias("partner"), "source"), "partner").groupBy("person").agg(F.count_distinct("source").alias("n"), F.min("source").alias("source"))
    return seen.where("n = 1").join(own.select("person").distinct(), "person", "left_anti").select("person", "source")


def match_records(names: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per person: titles joined, last birth and death, book references in order. names: person, ord, title, birth, death; anchors: person, line, nr."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    told = names.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("title")), " · ").alias("titles"), last("birth"), last("death"))
    refs = anchors.groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line", "nr"))), lambda x: F.concat_ws(" ", x["line"], x["nr"].cast("string"))), ", ").alias("refs"))
    return told.join(refs, "person", "left").select("person", "titles", "birth", "death", F.coalesce("refs", F.lit("")).alias("refs"))


def reconcile(register: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, action and id of an identity register against a new batch: reuse, ambiguous, new or missing. register: keys, id; one row per key and id."""
    r = register.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("id").alias("id"))
    b = batch.groupBy(*keys).agg(F.count("*").alias("_m"))
    rows = r.join(b, keys, "full")
    action = F.when(F.col("_m").isNull(), "missing").when(F.col("_n").isNull(), "new").when((F.col("_n") > 1) | (F.col("_m") > 1), "ambiguous").otherwise("reuse")
    return rows.select(*keys, action.alias("action"), F.when(action == "reuse", F.col("id")).alias("id"))


def duplicates(rows: DataFrame, detectors: dict[str, list[str]]) -> DataFrame:
    """a, b, detectors: pairs of rows that agree on all columns of a detector, unless their known years differ. rows: id, year and the detectors' columns.

    Rows of one key and year are a class, those of unknown year another; each
    class hangs on its smallest id, and that of unknown year on every other
    class of its key. So no link is lost, and n rows give about n pairs.
    """
    found = None
    for name, keys in detectors.items():
        keyed = rows
        for k in keys:
            keyed = keyed.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
        keyed = keyed.select("id", "year", *keys)
        classes = keyed.groupBy(*keys, "year").agg(F.min("id").alias("rep"))
        same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
        meet = F.col("x.year").eqNullSafe(F.col("y.year"))
        for e in same:
            meet = meet & e
        inner = keyed.alias("x").join(classes.alias("y"), meet).where(F.col("x.id") != F.col("y.rep")).select(F.col("y.rep").alias("a"), F.col("x.id").alias("b"))
        open_ = classes.where("year IS NULL").select(*keys, F.col("rep").alias("o"))
        across = classes.where("year IS NOT NULL").join(open_, keys).select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b"))
        part = inner.unionByName(across).withColumn("detector", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"))


def fuzzy_keys(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score: keys (column key) whose plain Jaro similarity is at least ``least``.

    Such keys share a certain number of letters, so in an order of all letters
    (with the number of the occurrence) they share one of the first few: a join
    by that letter loses no pair. Only candidates of a fitting length and with
    enough shared letters go to Python.
    """
    ratio = 3 * least - 2  # of the shorter to the longer length, and of the shared letters to a length

    def prefix(df: DataFrame, out: str) -> DataFrame:
        letters = F.filter(F.split(F.col("key"), ""), lambda x: x != "")
        seen = F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string")))
        rows = df.select("key").where("key <> ''").distinct().withColumn("n", F.char_length("key")).withColumn("bag", F.array_sort(seen))
        take = F.col("n") - F.ceil(F.col("n") * F.lit(ratio) - F.lit(1e-9)) + 1
        return rows.select(F.col("key").alias(out), F.col("n").alias(f"n_{out}"), F.col("bag").alias(f"bag_{out}"), F.explode(F.slice("bag", 1, take.cast("int"))).alias("letter"))

    pairs = prefix(left, "a").join(prefix(right, "b"), "letter")
    pairs = pairs.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(ratio) - F.lit(1e-9)).drop("letter").distinct()
    m = F.size(F.array_intersect("bag_a", "bag_b"))
    pairs = pairs.where((m / F.col("n_a") + m / F.col("n_b") + 1) / 3 >= F.lit(least - 1e-9))
    return pairs.select("a", "b", jaro_winkler_column(F.col("a"), F.col("b"), 0.0).alias("score")).where(F.col("score") >= least)


def match_places(texts: DataFrame, index: DataFrame, least: float = 0.92) -> DataFrame:
    """id, place, status, method, score: one row per text. texts: id, key; index: key, place, lat, lon.

    The exact key comes before its plain-letter form, and that before the most
    similar key. Exact and plain matches are auto if the coordinates of all of
    them agree to three decimals, else review; similar ones are always review;
    a text without any is none. Of equal ones the first place by name counts.
    """
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("oe")), F.lit("å"), F.lit("aa"))
    ok = index.where("lat <> 0 AND lon <> 0")

    def spots(key: Column) -> DataFrame:
        return ok.groupBy(key.alias("_k")).agg(F.min("place").alias("place"), F.count_distinct(F.round("lat", 3), F.round("lon", 3)).alias("spots"))

    status = F.when(F.col("spots") == 1, "auto").otherwise("review")
    keyed = texts.withColumn("_k", F.col("key"))
    one = keyed.join(spots(F.col("key")), "_k").select("id", "place", status.alias("status"), F.lit("eksakt").alias("method"), F.lit(1.0).alias("score"))
    rest = keyed.join(one, "id", "left_anti").withColumn("_k", plain(F.col("key")))
    two = rest.join(spots(plain(F.col("key"))), "_k").select("id", "place", status.alias("status"), F.lit("translit").alias("method"), F.lit(1.0).alias("score"))
    rest = materialise(rest.join(two, "id", "left_anti").select("id", "key"), "places")
    places = ok.groupBy("key").agg(F.min("place").alias("place"))
    found = fuzzy_keys(rest, places, least).withColumn("score", F.round("score", 9)).join(places.withColumnRenamed("key", "b"), "b")
    best = keep_first(found, ["a"], F.desc("score"), "place").select(F.col("a").alias("key"), "place", "score")
    three = rest.join(best, "key", "left").select("id", "place", F.when(F.col("place").isNull(), "none").otherwise("review").alias("status"), F.when(F.col("place").isNotNull(), "fuzzy").alias("method"), "score")
    return one.unionByName(two).unionByName(three)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """A left join to the first right row of each key."""
    return left.join(keep_first(right, [key], order).drop(order), key, "left")
