"""Media inventories, janitor findings, the change log and the transforms that change state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.plans.stages import keep_first, ranked


def duplicate_media(media: DataFrame, keys: list[str]) -> DataFrame:
    """Ready media that share all (known) keys with another id: id, n, first_id."""
    ready = media.where("status = 'klar'")
    for k in keys:
        ready = ready.where(F.col(k).isNotNull())
    groups = ready.groupBy(*keys).agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    return ready.join(groups, keys).select("id", "n", "first_id").distinct()


def media_queues(media: DataFrame, usage: DataFrame, stale_days: int = 7) -> DataFrame:
    """id, n_uses, queues: the work queues a medium is in. usage: media_id, object_type, object_id."""
    n = usage.groupBy(F.col("media_id").alias("id")).agg(F.count_distinct("object_type", "object_id").alias("n_uses"))
    rows = media.join(n, "id", "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))
    ready = F.col("status") == "klar"
    queues = F.array_compact(F.array(
        F.when(~ready & (F.col("age_days") > stale_days), "strandede"), F.when(ready & (F.col("n_uses") == 0), "ubrugte"),
        F.when(ready & ~F.coalesce("may_publish", F.lit(False)), "mangler_rettigheder"), F.when(F.col("sha").isNull(), "mangler_sha")))
    return rows.select("id", "n_uses", F.array_join(queues, ",").alias("queues"))


def orphan_objects(objects: DataFrame, known: DataFrame, min_days: int) -> DataFrame:
    """Stored objects that no row knows, older than min_days. A null age is never old enough."""
    return objects.where(F.col("age_days") > min_days).join(known.select("path").distinct(), "path", "left_anti")


def janitor_report(objects: DataFrame, media: DataFrame, variants: DataFrame, tiers: list[str], min_days: int = 3) -> DataFrame:
    """category, path, media_id, place: orphans, stranded reservations, missing files and missing variants in the report's order."""
    known = media.select("path").unionByName(variants.select("path"))
    none = F.lit(None).cast("long")
    orphan = orphan_objects(objects, known, min_days).select(F.lit("forældreløs").alias("category"), "path", none.alias("media_id"))
    stranded = media.where((F.col("status") != "klar") & (F.col("age_days") > min_days)).select(F.lit("strandet").alias("category"), "path", F.col("id").alias("media_id"))
    ready = media.where("status = 'klar'")
    lost = ready.join(objects.select("path").distinct(), "path", "left_anti").select(F.lit("mangler fil").alias("category"), "path", F.col("id").alias("media_id"))
    wanted = ready.select("id", F.explode(F.array(*[F.lit(t) for t in tiers])).alias("tier"))
    gaps = wanted.join(variants.select(F.col("media_id").alias("id"), "tier"), ["id", "tier"], "left_anti").select(F.concat(F.lit("mangler variant "), "tier").alias("category"), F.lit("").alias("path"), F.col("id").alias("media_id"))
    rows = orphan.unionByName(stranded).unionByName(lost).unionByName(gaps)
    order = [F.col("media_id").isNull(), F.length(F.col("media_id").cast("string")), F.col("media_id").cast("string"), F.col("path")]
    return ranked(rows, ["category"], order)


def sha_backfill(media: DataFrame, computed: DataFrame) -> DataFrame:
    """id, action for media without a digest: already_set, duplicate (another row has it) or update. computed: id, new_sha."""
    owner = media.where("sha IS NOT NULL").groupBy(F.col("sha").alias("new_sha")).agg(F.min("id").alias("owner"))
    rows = computed.join(media.select("id", "sha"), "id").join(owner, "new_sha", "left")
    return rows.select("id", F.when(F.col("sha").isNotNull(), "already_set").when(F.col("owner").isNotNull(), "duplicate").otherwise("update").alias("action"))


def portraits(depiction: DataFrame) -> DataFrame:
    """object_id, media_id: one picture per object, primary ones first, then the smallest id."""
    return keep_first(depiction, ["object_id"], F.desc("is_primary"), "media_id").select("object_id", "media_id", "is_primary")


def delete_preview(person: DataFrame, fact: DataFrame, claim: DataFrame, relation: DataFrame, member: DataFrame) -> DataFrame:
    """id, facts, claims, relations, families, blockers: what deleting a person would take along."""
    facts = fact.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("facts"))
    claims = fact.select(F.col("subject_id").alias("id"), F.col("id").alias("target_id")).join(claim.select("target_id"), "target_id").groupBy("id").agg(F.count("*").alias("claims"))
    ends = relation.select(F.col("subject_id").alias("id"), F.col("id").alias("r")).unionByName(relation.select(F.col("object_id").alias("id"), F.col("id").alias("r")))
    relations = ends.groupBy("id").agg(F.count_distinct("r").alias("relations"))
    families = member.groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("family_id").alias("families"), F.count_if(F.col("role") == "partner").alias("_p"))
    out = person.select("id", "living")
    for side in (facts, claims, relations, families):
        out = out.join(side, "id", "left")
    out = out.fillna(0, ["facts", "claims", "relations", "families", "_p"])
    blockers = F.array_compact(F.array(F.when(F.col("_p") > 0, "partner"), F.when(F.coalesce("living", F.lit(True)), "levende")))
    return out.select("id", "facts", "claims", "relations", "families", F.array_join(blockers, ",").alias("blockers"))


# ---- change log ----


def changed(before: Column, after: Column) -> Column:
    """Null-safe difference: what a log entry needs."""
    return ~before.eqNullSafe(after)


def log_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, op, changed (column names): the entries that lead from old to new; rows without a difference give none."""
    o, n = old.select(F.col(key), F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in columns]), new.select(F.col(key), F.lit(True).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    rows = o.join(n, key, "full")
    diff = F.array_compact(F.array(*[F.when(changed(F.col(f"_o_{c}"), F.col(f"_n_{c}")), F.lit(c)) for c in columns]))
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("update")
    return rows.select(key, op.alias("op"), F.array_join(diff, ",").alias("changed")).where("op <> 'update' OR changed <> ''")


def history(change: DataFrame) -> DataFrame:
    """Entries of each row in order, each with the value before it: id, row_id, seq, op, before_value, after_value."""
    by = Window.partitionBy("row_id").orderBy("made", "id")
    after = F.when(F.col("op") != "delete", F.col("after_value"))
    rows = change.withColumn("after_value", after).withColumn("seq", F.row_number().over(by).cast("long")).withColumn("before_value", F.lag("after_value").over(by))
    return rows.select("id", "set_id", "row_id", "seq", "op", "before_value", "after_value")


def current_state(change: DataFrame) -> DataFrame:
    """row_id, value: the last entry of each row, deleted ones left out. A latest-wins upsert."""
    last = change.groupBy("row_id").agg(F.max_by(F.struct("op", "after_value"), F.struct("made", "id")).alias("x"))
    return last.where("x.op <> 'delete'").select("row_id", F.col("x.after_value").alias("value"))


def undo(change: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, row_id, status, restored: what undoing each change set would do to each of its rows.

    The value before the set's first entry is restored; 'konflikt' if the row
    was changed after the set's last entry by another set.
    """
    h = history(change)
    mine = h.join(sets.select("set_id").distinct(), "set_id", "left_semi")
    span = mine.groupBy("set_id", "row_id").agg(F.min_by("before_value", "seq").alias("restored"), F.max("seq").alias("last"))
    newest = h.groupBy("row_id").agg(F.max("seq").alias("newest"))
    return span.join(newest, "row_id").select("set_id", "row_id", F.when(F.col("newest") > F.col("last"), "konflikt").otherwise("fortrudt").alias("status"), "restored")


def upsert(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """State with rows put in: a key of rows replaces the state's. Keys of rows must be unique."""
    return state.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def repoint(conclusion: DataFrame, claim: DataFrame, deleted: DataFrame) -> DataFrame:
    """target_id, chosen_id, action: conclusions after claims were deleted. A conclusion whose claim is gone takes the smallest that remains, or goes."""
    left = claim.join(deleted.select("id"), "id", "left_anti").groupBy("target_id").agg(F.min("id").alias("next"))
    gone = deleted.select(F.col("id").alias("chosen_id"), F.lit(True).alias("gone"))
    rows = conclusion.select("target_id", "chosen_id").join(gone, "chosen_id", "left").join(left, "target_id", "left")
    action = F.when(F.col("gone").isNull(), "uændret").when(F.col("next").isNull(), "slettet").otherwise("flyttet")
    return rows.select("target_id", F.when(F.col("gone").isNull(), F.col("chosen_id")).otherwise(F.col("next")).alias("chosen_id"), action.alias("action"))


def ordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """'Not the same' pairs, smaller id first, once each; a pair of equal ids is refused."""
    rows = pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return rows.withColumn(a, F.when(F.col(a) == F.col(b), F.raise_error(F.lit("a person is itself"))).otherwise(F.col(a)))


def event_merge(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """key, action, status, text: events of a new extraction against the stored ones. A known key keeps its editorial status; stored keys that the plan lacks are kept if edited ('behold'), else dropped ('slet')."""
    e = existing.select("key", F.col("status").alias("_s"), F.col("text").alias("_t"))
    rows = e.join(planned.select("key", F.col("text").alias("_p")), "key", "full")
    action = F.when(F.col("_s").isNull(), "ny").when(F.col("_p").isNull() & (F.col("_s") != "foreslået"), "behold").when(F.col("_p").isNull(), "slet").when(F.col("_p") == F.col("_t"), "uændret").otherwise("opdater")
    return rows.select("key", action.alias("action"), F.coalesce("_s", F.lit("foreslået")).alias("status"), F.coalesce("_p", "_t").alias("text"))


def allocate_ids(state: DataFrame, new: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """New rows with ids after the state's largest, in the given order. They are numbered by ranges, not in one task."""
    top = state.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = ranked(new.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in order], "_n").drop("_all")
    return numbered.crossJoin(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.col("_n")).drop("_top", "_n")  # a single row
