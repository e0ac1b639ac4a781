"""Feed pools, scores and order; geography; search and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.text import danish_key, distance_km, draw, first_quotable, fnv1a, initial
from stemma.plans.stages import keep_first

# Base scores of the card kinds.
BASE = {"historie": 1.2, "portrait": 1.0, "paadennedag": 1.0, "dagensperson": 1.0, "jubilaeum": 0.9, "slaegt": 0.8, "gods": 0.6, "embede": 0.6, "forbundet": 0.5, "arkiv": 0.5, "citat": 0.4, "vaaben": 0.3, "samle": 0.0}


def portrait_or_quote(texts: DataFrame, min_bio: int = 120) -> DataFrame:
    """One card per person with a usable text: a quote for a quarter of them (by hash) if a sentence fits, else a portrait. texts: person_id, text."""
    quote = first_quotable(F.col("text"))
    rows = texts.where(F.char_length(F.trim("text")) >= min_bio).withColumn("quote", F.when(fnv1a(F.col("person_id").cast("string")) % 4 == 0, quote))
    kind = F.when(F.col("quote").isNotNull(), "citat").otherwise("portrait")
    return rows.select(F.concat_ws(":", kind, "person_id").alias("card"), kind.alias("kind"), "person_id", "quote")


def archive_cards(event: DataFrame, person: DataFrame, used: DataFrame) -> DataFrame:
    """Events that no fact stands for and no other card tells: card, kind, person_id, year. event: id, person_id, backbone, date_raw, date_min; used: id."""
    rows = event.where(~F.coalesce("backbone", F.lit(False))).join(used.select("id"), "id", "left_anti").join(person.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    year = F.coalesce(F.when(F.col("date_raw") != "", F.col("date_raw")), F.date_format("date_min", "yyyy"))
    return rows.select(F.concat_ws(":", F.lit("arkiv"), "id").alias("card"), F.lit("arkiv").alias("kind"), "person_id", year.alias("year"))


def estate_cards(estate: DataFrame, owners: DataFrame) -> DataFrame:
    """card, kind, meta, dots. estate: id, type; owners: id, n."""
    rows = estate.join(owners, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    label = F.coalesce(F.nullif("type", F.lit("")), F.lit("Gods"))
    meta = F.when(F.col("n") > 0, F.concat(label, F.lit(" · "), F.col("n").cast("string"), F.lit(" ejere"))).otherwise(label)
    return rows.select(F.concat_ws(":", F.lit("gods"), "id").alias("card"), F.lit("gods").alias("kind"), meta.alias("meta"), F.least("n", F.lit(7)).alias("dots"))


def union_cards(union: DataFrame, person: DataFrame) -> DataFrame:
    """card, kind, a_name, b_name, foot: marriages of two known persons. union: id, p1, p2, year."""
    named = lambda c, out: person.select(F.col("id").alias(c), F.col("name").alias(out))
    rows = union.where("p2 IS NOT NULL").join(named("p1", "a_name"), "p1").join(named("p2", "b_name"), "p2")
    return rows.select(F.concat_ws(":", F.lit("forbundet"), "id").alias("card"), F.lit("forbundet").alias("kind"), "a_name", "b_name", F.concat_ws(" ", F.lit("gift"), F.col("year").cast("string")).alias("foot"))


def office_cards(office: DataFrame, person: DataFrame) -> DataFrame:
    """card, kind, person_id, label. office: person_id, label, year."""
    rows = office.join(person.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return rows.select(F.concat_ws(":", F.lit("embede"), "person_id", "label", F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("card"), F.lit("embede").alias("kind"), "person_id", "label")


def arms_cards(arms: DataFrame) -> DataFrame:
    """card, kind, blazon. arms: id, blazon."""
    told = F.when(F.trim("blazon") != "", F.col("blazon")).otherwise(F.lit("Blasoneringen indlæses fra Aarbogen, når våbenet knyttes."))
    return arms.select(F.concat_ws(":", F.lit("vaaben"), "id").alias("card"), F.lit("vaaben").alias("kind"), told.alias("blazon"))


def kinship_cards(relationships: DataFrame) -> DataFrame:
    """card, kind, label for pairs (a, b, label) that are related."""
    return relationships.where("a <> b").select(F.concat_ws(":", F.lit("slaegt"), "a", "b").alias("card"), F.lit("slaegt").alias("kind"), "label")


def anniversaries(person: DataFrame, year: int) -> DataFrame:
    """Round jubilees: births and deaths at least 100 years ago, by fifties."""
    rows = person.select("id", F.explode(F.array(F.struct(F.lit("født").alias("what"), F.col("born").alias("y")), F.struct(F.lit("død").alias("what"), F.col("died").alias("y")))).alias("x"))
    n = F.lit(year) - F.col("x.y")
    return rows.where((n >= 100) & (n % 50 == 0)).select(F.concat_ws(":", F.lit("jubilaeum"), "x.what", "id").alias("card"), F.lit("jubilaeum").alias("kind"), F.col("id").alias("person_id"), n.alias("years"))


def on_this_day(days: DataFrame, month_day: str) -> DataFrame:
    """Events of that day of the year, or of its month if there is none at all. days: id, day (exact date)."""
    rows = days.select("id", "day", (F.date_format("day", "MM-dd") == month_day).alias("hit"), (F.date_format("day", "MM") == month_day[:2]).alias("near"))
    any_ = rows.where("hit").groupBy().agg(F.count("*").alias("n"))  # one row
    chosen = rows.where("near").crossJoin(F.broadcast(any_)).where("hit OR n = 0")
    return chosen.select("id", "day", F.when(F.col("hit"), "dag").otherwise("maaned").alias("precision"))


def person_of_the_day(person: DataFrame, today: str) -> DataFrame:
    """The person at place hash(today) modulo N: a rank by buckets, so no task sorts everyone."""
    n = person.groupBy().agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("id") / 4096).alias("b")
    sizes = person.groupBy(bucket).agg(F.count("*").alias("k"))
    ahead = sizes.withColumn("ahead", F.sum("k").over(Window.orderBy("b")) - F.col("k"))  # one row per 4096 ids
    at = fnv1a(F.lit(today)) % F.col("n")
    spot = ahead.crossJoin(F.broadcast(n)).where((F.col("ahead") <= at) & (at < F.col("ahead") + F.col("k"))).select("b", (at - F.col("ahead")).alias("at"))
    rows = person.select("id", "name", bucket).join(F.broadcast(spot), "b")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1).where("r = at").select("id", "name")


def seen_weight(days: Column) -> Column:
    """Cards seen recently count less."""
    return F.when(days < 3, 0.25).when(days < 7, 0.5).when(days < 14, 0.75).otherwise(1.0)


def scores(cards: DataFrame, bookmarks: DataFrame, seen: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """cards with score. cards: card, kind, person_id, boost; bookmarks: person_id; seen: card, days."""
    base = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in BASE.items()], F.lit(0.0))
    rows = cards.join(bookmarks.select("person_id", F.lit(1.5).alias("_b")).distinct(), "person_id", "left").join(seen.groupBy("card").agg(F.min("days").alias("_d")), "card", "left")
    s = base * F.col("boost") * F.coalesce("_b", F.lit(1.0)) * F.when(F.col("_d").isNull(), 1.0).otherwise(seen_weight(F.col("_d")))
    return rows.withColumn("score", F.when(F.col("kind").isin(disabled or []), 0.0).otherwise(s)).drop("_b", "_d")


def weighted_order(cards: DataFrame, seed: int) -> DataFrame:
    """cards with draw (-ln(1 - u) / score): sorting by it draws without replacement in proportion to the scores. Every row computes its own u. cards: ordinal (from 1), score."""
    u = draw(F.lit(seed), F.col("ordinal"))
    return cards.where("score > 0").withColumn("draw", -F.log(1 - u) / F.col("score"))


# Kinds that count as a portrait of a person.
_PORTRAITS = ("portrait", "dagensperson")


def walk(cards: list[dict], lead: list[dict] | None = None, locked: list[tuple[int, dict]] | None = None, recent: int = 8, probes: int = 20, lookback: int = 5) -> list[str]:
    """The last step over one page's cards in order of draw.

    lead comes first; locked cards take their positions (from 0) or, where the
    others have run out, the end. Else a card must not be of the kind before
    it, and its person not among the last ``recent``, looking at ``probes``
    cards at most; the person rule gives way first, then the other. Without a
    portrait in the last ``lookback`` cards only portraits may be drawn; so too
    one place before a locked card that is none. Until it is placed, a locked
    person's other cards wait.
    """
    left, out, locked = list(cards), list(lead or []), sorted(locked or [], key=lambda x: x[0])
    while left or locked:
        due = next((x for x in locked if x[0] == len(out)), locked[0] if locked and not left else None)
        if due:
            locked.remove(due)
            out.append(due[1])
            continue
        last, people = (out[-1]["kind"] if out else None), {c["person_id"] for c in out[-recent:] if c["person_id"] is not None}
        seen = lambda n: any(c["kind"] in _PORTRAITS for c in out[-n:])
        ahead = any(at == len(out) + 1 and c["kind"] not in _PORTRAITS for at, c in locked)
        pool = left
        if not seen(lookback) or (ahead and not seen(lookback - 1)):
            pool = [c for c in left if c["kind"] == "portrait"] or left
        waiting = {c["person_id"] for _, c in locked if c["kind"] == "dagensperson"}
        pool = [c for c in pool if c["person_id"] is None or c["person_id"] not in waiting] or pool
        near = pool[:probes]
        pick = next((c for c in near if c["kind"] != last and c["person_id"] not in people), None) or next((c for c in near if c["kind"] != last), None) or near[0]
        left.remove(pick)
        out.append(pick)
    return [c["card"] for c in out]


def feed_page(cards: DataFrame, pins: DataFrame, seed: int, size: int = 60, probes: int = 20) -> DataFrame:
    """place, card: a page of the feed. Pinned cards lead, hidden ones are left out; the person of the day and the kinship card have a slot each, drawn by the seed (0 to 2 and 3 to 9 places after the pins); the rest is a top-k by draw, of a page's length, and as many portraits, in which the rules are walked. pins: card, action, created."""
    hidden = pins.where("action = 'skjul'").select("card")
    columns = ["card", "kind", "person_id"]
    first = pins.where("action = 'pin'").join(cards, "card").orderBy(F.asc_nulls_last("created"), "card").select(*columns).limit(size)
    rest = weighted_order(cards.join(pins.select("card"), "card", "left_anti").join(hidden, "card", "left_anti"), seed)
    slots = ["dagensperson", "slaegt"]
    free = rest.where(~F.col("kind").isin(slots))
    by_draw = lambda df, n: [r.asDict() for r in df.orderBy("draw", "card").select(*columns, "draw").limit(n).collect()]
    top = by_draw(free, size)  # a page
    top += [c for c in by_draw(free.where("kind = 'portrait'"), size) if c["draw"] > top[-1]["draw"]] if len(top) == size else []
    lead = [r.asDict() for r in first.collect()]
    u = cards.sparkSession.range(1).select(draw(F.lit(seed), F.lit((1 << 32) - 1)).alias("a"), draw(F.lit(seed), F.lit((1 << 32) - 2)).alias("b")).first()
    locked, spans = [], {"dagensperson": int(u["a"] * 3), "slaegt": 3 + int(u["b"] * 7)}
    for kind in slots:
        if card := by_draw(rest.where(F.col("kind") == kind), 1):
            locked.append((len(lead) + spans[kind], card[0]))
    order = walk(top, lead, locked, probes=probes)[:size]
    return cards.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(order)], "place long, card string")


def resume(page: DataFrame, shown: DataFrame, start: int, n: int) -> DataFrame:
    """The next n cards from a cursor, without those shown."""
    rows = page.where(F.col("place") > start).join(shown.select("card"), "card", "left_anti")
    return rows.orderBy("place").limit(n)


def media_rotation(media: DataFrame, session: str, limit: int = 4) -> DataFrame:
    """object_id, media_id, place: primary pictures lead; the others follow in an order turned by a hash of session and object."""
    rows = media.groupBy("object_id", "media_id").agg(F.max("is_primary").alias("is_primary"))
    per = Window.partitionBy("object_id")
    others = rows.where("NOT is_primary").withColumn("i", F.row_number().over(per.orderBy("media_id")) - 1).withColumn("n", F.count("*").over(per))
    turn = fnv1a(F.concat_ws(":", F.lit(session), F.col("object_id").cast("string")))
    others = others.withColumn("o", F.pmod(F.col("i") - turn, F.col("n")))
    both = rows.where("is_primary").withColumn("o", F.lit(0).cast("long")).select("object_id", "media_id", "is_primary", "o").unionByName(others.select("object_id", "media_id", "is_primary", "o"))
    return both.withColumn("place", F.row_number().over(per.orderBy(F.desc("is_primary"), "o", "media_id")).cast("long")).where(F.col("place") <= limit).select("object_id", "media_id", "place")


# ---- geography ----


def nearby(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Points within km of a place, with their distance. A band of latitudes, which the scan can prune by, comes before the exact distance."""
    band = km / 111.0
    rows = points.where(F.col("lat").between(lat - band, lat + band)).withColumn("km", F.round(distance_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), 6))
    return rows.where(F.col("km") <= km)


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def journey(points: DataFrame) -> DataFrame:
    """person_id, place_id, kind, step: the places of a life, by kind of event, then year (unknown last). points: person_id, place_id, kind, year."""
    order = ["fødsel", "dåb", "vielse", "død", "bisættelse", "begravelse"]
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))
    by = Window.partitionBy("person_id").orderBy(rank, F.asc_nulls_last("year"), "place_id")
    return points.withColumn("step", F.row_number().over(by).cast("long")).select("person_id", "place_id", "kind", "step")


def in_years(points: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Points whose year lies within the bounds; one without a year only if there are none."""
    if low is None and high is None:
        return points
    return points.where(F.col("year").between(low if low is not None else -10**9, high if high is not None else 10**9))


def fill_coordinates(place: DataFrame, found: DataFrame) -> DataFrame:
    """Coordinates are filled in only where a place has none at all. found: id, new_lat, new_lon."""
    rows = place.join(found, "id", "left")
    empty = F.col("lat").isNull() & F.col("lon").isNull()
    return rows.select("id", F.when(empty, F.col("new_lat")).otherwise(F.col("lat")).alias("lat"), F.when(empty, F.col("new_lon")).otherwise(F.col("lon")).alias("lon"))


# ---- search and rankings ----


def search(rows: DataFrame, text: str, query: str, line: str | None = None) -> DataFrame:
    """Rows whose text contains the query, in any case; of one line, if given."""
    hit = rows.where(F.contains(F.lower(text), F.lit(query.lower())))
    return hit if line is None else hit.where(F.col("line") == line)


def letter_index(rows: DataFrame, name: str) -> DataFrame:
    """letter, n, place: how many names start each letter, in alphabetic order."""
    n = rows.groupBy(initial(F.col(name)).alias("letter")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(danish_key(F.col("letter")), "letter")).cast("long"))  # one row per letter


def alphabetic_place(rows: DataFrame, name: str, group: str) -> DataFrame:
    """id and its place within a group by the alphabet's order."""
    by = Window.partitionBy(group).orderBy(danish_key(F.col(name)), name, "id")
    return rows.withColumn("place", F.row_number().over(by).cast("long")).select("id", group, "place")


def owners(relation: DataFrame, only_owners: bool) -> DataFrame:
    """object_id, n, first_id: relations to each estate; with only_owners those of owners alone, the first by year (unknown as 9999), then id."""
    rows = relation.where("role = 'ejer'") if only_owners else relation
    return rows.groupBy("object_id").agg(F.count("*").alias("n"), F.min_by("id", F.struct(F.coalesce("year", F.lit(9999)), F.col("id"))).alias("first_id"))


def line_heads(anchor: DataFrame) -> DataFrame:
    """line, n_persons, head: different persons of each line and the one with the lowest number (none counts as 9999)."""
    return anchor.groupBy("line").agg(F.count_distinct("person_id").alias("n_persons"), F.min_by("person_id", F.struct(F.coalesce("nr", F.lit(9999)), F.col("person_id"))).alias("head"))


def timeline(facts: DataFrame, events: DataFrame) -> DataFrame:
    """person_id, kind, ref, day, place: facts and events of a person in order. An event linked to a fact is left out. facts: person_id, ref, day; events: person_id, ref, day, fact_ref."""
    free = events.join(facts.select(F.col("ref").alias("fact_ref")), "fact_ref", "left_anti")
    rows = facts.select("person_id", F.lit("fact").alias("kind"), "ref", "day").unionByName(free.select("person_id", F.lit("haendelse").alias("kind"), "ref", "day"))
    by = Window.partitionBy("person_id").orderBy(F.asc_nulls_last("day"), "ref", "kind")
    return rows.withColumn("place", F.row_number().over(by).cast("long"))


def grouped_bookmarks(bookmarks: DataFrame, person: DataFrame, lines: DataFrame) -> DataFrame:
    """line, n: bookmarked persons by their first line, '' without one."""
    first = keep_first(lines, ["person_id"], "line")
    rows = bookmarks.select("person_id").distinct().join(person.select(F.col("id").alias("person_id")), "person_id", "left_semi").join(first.select("person_id", "line"), "person_id", "left")
    return rows.groupBy(F.coalesce("line", F.lit("")).alias("line")).agg(F.count("*").alias("n"))
