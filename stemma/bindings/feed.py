"""Feed, geography and search queries on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.dates import life_span, parse_year, year_interval
from stemma.functions.text import danish_key, draw, fnv1a
from stemma.operators import feed as K

from .tables import read, role, sql


def hashes(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), fnv1a(F.col("p_name")).alias("hash"))


def draws(spark, d):
    return role(spark, d, "person").select("id", draw(F.lit(20260101), F.col("id") + 1).alias("u"))


def life_spans(spark, d):
    p = role(spark, d, "person")
    return p.select("id", life_span(F.concat(F.lit("*"), F.when(F.col("id") % 4 != 0, F.col("born")).cast("string")), F.col("died").cast("string")).alias("span"), parse_year(F.concat(F.lit("født "), F.col("born").cast("string"))).alias("year"))


def year_intervals(spark, d):
    return role(spark, d, "raw_date").select("id", year_interval(F.col("raw")).alias("y")).select("id", F.col("y.lo").alias("lo"), F.col("y.hi").alias("hi"))


def portrait_or_quote(spark, d):
    return K.portrait_or_quote(read(spark, d, "documents").select(F.col("doc_id").alias("person_id"), "text"))


def anniversaries(spark, d):
    return K.anniversaries(role(spark, d, "person"), 1950)


def on_this_day(spark, d):
    return K.on_this_day(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day")), "02-29")


def on_this_month(spark, d):
    return K.on_this_day(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day")), "06-31")


def person_of_the_day(spark, d):
    return K.person_of_the_day(role(spark, d, "person"), "2026-06-01")


def _cards(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in K.BASE]), (F.col("id") % len(K.BASE) + 1).cast("int"))
    rows = role(spark, d, "relation").select(F.concat_ws(":", kind, "id").alias("card"), kind.alias("kind"), F.col("subject_id").alias("person_id"), F.when(F.col("id") % 5 == 0, 4.0).otherwise(1.0).alias("boost"), (F.col("id") + 1).alias("ordinal"))
    seen = rows.where("ordinal % 4 = 0").select("card", (F.col("ordinal") % 20).alias("days"))
    return K.scores(rows, role(spark, d, "person").where("id % 6 = 0").select(F.col("id").alias("person_id")), seen, ["arkiv"])


def feed_scores(spark, d):
    return _cards(spark, d).select("card", F.round("score", 9).alias("score"))


def feed_draws(spark, d):
    return K.weighted_order(_cards(spark, d), 42).select("card", F.round("draw", 6).alias("draw"))


def feed_page(spark, d):
    cards = _cards(spark, d)
    pins = cards.where("ordinal % 1000 IN (7, 8)").select("card", F.when(F.col("ordinal") % 2 == 0, "skjul").otherwise("pin").alias("action"), F.when(F.col("ordinal") % 3 != 0, F.col("ordinal")).alias("created"))
    return K.feed_page(cards, pins, 42)


def feed_media(spark, d):
    return K.media_rotation(role(spark, d, "depiction").withColumn("object_id", F.col("object_id") % 50), "session")


def nearby_points(spark, d):
    return K.nearby(role(spark, d, "place"), 55.5, 10.0, 90.0).select("id", "km")


def point_bounds(spark, d):
    return K.bounds(role(spark, d, "place"))


def life_journeys(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("død", "fødsel", "gods", "dåb", "vielse")]), (F.col("id") % 5 + 1).cast("int"))
    return K.journey(role(spark, d, "relation").select(F.col("subject_id").alias("person_id"), (F.col("id") % 100).alias("place_id"), kind.alias("kind"), "year").distinct())


def points_in_years(spark, d):
    return K.in_years(role(spark, d, "relation"), 1996, 1998).select("id", "year")


def filled_coordinates(spark, d):
    found = role(spark, d, "place").where("id % 2 = 1").select("id", F.lit(55.0).alias("new_lat"), F.lit(9.0).alias("new_lon"))
    return K.fill_coordinates(role(spark, d, "place"), found)


def search(spark, d):
    return K.search(read(spark, d, "part").select("p_partkey", "p_name", F.col("p_brand").alias("line")), "p_name", "RING", "Brand#2").select("p_partkey", "p_name")


def letter_index(spark, d):
    return K.letter_index(read(spark, d, "part"), "p_name")


def alphabetic_places(spark, d):
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Øl", "Aa", "Ål", "Zar", "Ære", "ab")]), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    return K.alphabetic_place(read(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("brand")), "name", "brand")


def estate_relations(spark, d):
    return K.owners(role(spark, d, "relation"), False)


def estate_owners(spark, d):
    return K.owners(role(spark, d, "relation"), True)


def line_heads(spark, d):
    return K.line_heads(role(spark, d, "anchor"))


def timelines(spark, d):
    fact = role(spark, d, "fact")
    days = role(spark, d, "claim").groupBy(F.col("target_id").alias("id")).agg(F.min("date_min").alias("day"))
    facts = fact.where("id % 3 <> 1").join(days, "id", "left").select(F.col("subject_id").alias("person_id"), F.col("id").alias("ref"), "day")
    events = role(spark, d, "relation").select(F.col("subject_id").alias("person_id"), F.col("id").alias("ref"), F.make_date("year", F.lit(1), F.lit(1)).alias("day"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("fact_ref"))
    return K.timeline(facts, events)


def grouped_bookmarks(spark, d):
    marks = role(spark, d, "person").where("id % 4 = 0").select(F.col("id").alias("person_id"))
    return K.grouped_bookmarks(marks, role(spark, d, "person"), role(spark, d, "anchor"))


QUERIES = {f.__name__: f for f in (hashes, draws, life_spans, year_intervals, portrait_or_quote, anniversaries, on_this_day, on_this_month, person_of_the_day, feed_scores, feed_draws, feed_page, feed_media, nearby_points, point_bounds, life_journeys, points_in_years, filled_coordinates, search, letter_index, alphabetic_places, estate_relations, estate_owners, line_heads, timelines, grouped_bookmarks)}

_FNV = lambda s: f"list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split({s}, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_M = "4294967296"


def _u(seed, k):
    return f"""(SELECT CAST(xor(t2, t2 >> 14) AS DOUBLE) / {_M} FROM (SELECT xor(t, (t + (xor(t, t >> 7) * (t | 61)) % {_M}) % {_M}) AS t2 FROM
 (SELECT (xor(a, a >> 15) * (a | 1)) % {_M} AS t FROM (SELECT (CAST({seed} AS HUGEINT) + CAST({k} AS HUGEINT) * 1831565813) % {_M} AS a))))"""


_CARD = f"""card AS (SELECT [{', '.join(repr(k) for k in K.BASE)}][id % {len(K.BASE)} + 1] AS kind, [{', '.join(str(v) for v in K.BASE.values())}][id % {len(K.BASE)} + 1] AS base, subject_id AS person_id, id, id + 1 AS ordinal FROM relation),
scored AS (SELECT kind || ':' || id AS card, ordinal, CASE WHEN kind = 'arkiv' THEN 0 ELSE CAST(base AS DOUBLE) * CASE WHEN id % 5 = 0 THEN 4 ELSE 1 END * CASE WHEN person_id % 6 = 0 THEN CAST(1.5 AS DOUBLE) ELSE 1 END
  * CASE WHEN ordinal % 4 <> 0 THEN CAST(1 AS DOUBLE) WHEN ordinal % 20 < 3 THEN 0.25 WHEN ordinal % 20 < 7 THEN 0.5 WHEN ordinal % 20 < 14 THEN 0.75 ELSE 1 END END AS score FROM card)"""

SQL = {
    "hashes": f"SELECT p_partkey AS id, CAST({_FNV('p_name')} AS BIGINT) AS hash FROM part",
    "draws": f"SELECT c_custkey AS id, {_u(20260101, 'c_custkey + 1')} AS u FROM customer",
    "life_spans": sql("person", """SELECT id, CASE WHEN id % 4 <> 0 AND died IS NOT NULL THEN born || '–' || died WHEN id % 4 <> 0 THEN '* ' || born WHEN died IS NOT NULL THEN '† ' || died ELSE '' END AS span, born AS year FROM person"""),
    "year_intervals": """WITH y AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, CAST(year(o_orderdate) AS INT) AS y FROM orders)
SELECT id, CAST(CASE k WHEN 1 THEN y - 5 WHEN 2 THEN NULL WHEN 7 THEN NULL ELSE y END AS INT) AS lo, CAST(CASE k WHEN 1 THEN y + 5 WHEN 3 THEN NULL WHEN 7 THEN NULL WHEN 4 THEN y + 3 ELSE y END AS INT) AS hi FROM y""",
    "portrait_or_quote": f"""WITH t AS (SELECT doc_id AS person_id, CAST({_FNV('CAST(doc_id AS VARCHAR)')} AS BIGINT) AS h, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 40 AND 180)[1] AS q
 FROM documents WHERE length(trim(text, ' ')) >= 120), r AS (SELECT person_id, CASE WHEN h % 4 = 0 THEN q END AS quote FROM t)
SELECT CASE WHEN quote IS NULL THEN 'portrait' ELSE 'citat' END || ':' || person_id AS card, CASE WHEN quote IS NULL THEN 'portrait' ELSE 'citat' END AS kind, person_id, quote FROM r""",
    "anniversaries": sql("person", """x AS (SELECT id, 'født' AS what, 1950 - born AS n FROM person UNION ALL SELECT id, 'død', 1950 - died FROM person)
SELECT 'jubilaeum:' || what || ':' || id AS card, 'jubilaeum' AS kind, id AS person_id, CAST(n AS INT) AS years FROM x WHERE n >= 100 AND n % 50 = 0"""),
    "on_this_day": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'dag' AS precision FROM orders WHERE month(o_orderdate) = 2 AND day(o_orderdate) = 29",
    "on_this_month": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'maaned' AS precision FROM orders WHERE month(o_orderdate) = 6",
    "person_of_the_day": f"""WITH p AS (SELECT c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) SELECT id, name FROM p WHERE r = {_FNV("'2026-06-01'")} % (SELECT count(*) FROM customer)""",
    "feed_scores": sql("relation", f"{_CARD} SELECT card, round(score, 9) AS score FROM scored"),
    "feed_draws": sql("relation", f"{_CARD}, v AS (SELECT card, score, {_u(42, 'ordinal')} AS u FROM scored WHERE score > 0) SELECT card, round(-ln(1 - u) / score, 6) AS draw FROM v"),
    "feed_media": sql("depiction", f"""r AS (SELECT object_id % 50 AS object_id, media_id, bool_or(is_primary) AS p FROM depiction GROUP BY ALL), o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY object_id) AS n FROM r WHERE NOT p WINDOW w AS (PARTITION BY object_id ORDER BY media_id)),
b AS (SELECT object_id, media_id, p, 0 AS o FROM r WHERE p UNION ALL SELECT object_id, media_id, p, ((i - CAST({_FNV("'session:' || object_id")} AS BIGINT)) % n + n) % n FROM o)
SELECT object_id, media_id, row_number() OVER (PARTITION BY object_id ORDER BY p DESC, o, media_id) AS place FROM b QUALIFY place <= 4"""),
    "nearby_points": sql("place", """k AS (SELECT id, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat - 55.5) / 2), 2) + cos(radians(55.5)) * cos(radians(lat)) * pow(sin(radians(lon - 10.0) / 2), 2)))), 6) AS km FROM place WHERE lat IS NOT NULL) SELECT * FROM k WHERE km <= 90"""),
    "point_bounds": sql("place", "SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM place"),
    "life_journeys": sql("relation", """p AS (SELECT DISTINCT subject_id AS person_id, id % 100 AS place_id, ['død', 'fødsel', 'gods', 'dåb', 'vielse'][id % 5 + 1] AS kind, year FROM relation)
SELECT person_id, place_id, kind, row_number() OVER (PARTITION BY person_id ORDER BY CASE kind WHEN 'fødsel' THEN 0 WHEN 'dåb' THEN 1 WHEN 'vielse' THEN 2 WHEN 'død' THEN 3 ELSE 6 END, year NULLS LAST, place_id) AS step FROM p"""),
    "points_in_years": sql("relation", "SELECT id, CAST(year AS INT) AS year FROM relation WHERE year BETWEEN 1996 AND 1998"),
    "filled_coordinates": sql("place", "SELECT id, CASE WHEN lat IS NULL AND id % 2 = 1 THEN 55 ELSE lat END AS lat, CASE WHEN lon IS NULL AND id % 2 = 1 THEN 9 ELSE lon END AS lon FROM place"),
    "search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_brand = 'Brand#2'",
    "letter_index": "WITH l AS (SELECT upper(regexp_extract(string_split(p_name, ' ')[-1], '[a-zA-Z]')) AS letter, count(*) AS n FROM part GROUP BY ALL) SELECT letter, n, row_number() OVER (ORDER BY letter) AS place FROM l",
    "alphabetic_places": """WITH n AS (SELECT p_partkey AS id, ['Øl', 'Aa', 'Ål', 'Zar', 'Ære', 'ab'][p_partkey % 6 + 1] || p_name AS name, p_brand AS brand FROM part),
k AS (SELECT *, list_transform(string_split(name, ''), lambda c: printf('%02d%05X', CASE WHEN strpos('AÁBCDEÉFGHIÍJKLMNOÓPQRSTUÚVWXYZÆØÅ', upper(c)) > 0 THEN strpos('AÁBCDEÉFGHIÍJKLMNOÓPQRSTUÚVWXYZÆØÅ', upper(c)) ELSE 99 END, ord(c))) AS key FROM n)
SELECT id, brand, row_number() OVER (PARTITION BY brand ORDER BY array_to_string(key, ''), name, id) AS place FROM k""",
    "estate_relations": sql("relation", "SELECT object_id, count(*) AS n, arg_min(id, (coalesce(year, 9999), id)) AS first_id FROM relation GROUP BY object_id"),
    "estate_owners": sql("relation", "SELECT object_id, count(*) AS n, arg_min(id, (coalesce(year, 9999), id)) AS first_id FROM relation WHERE role = 'ejer' GROUP BY object_id"),
    "line_heads": sql("anchor", "SELECT line, count(DISTINCT person_id) AS n_persons, arg_min(person_id, (coalesce(nr, 9999), person_id)) AS head FROM anchor GROUP BY line"),
    "timelines": sql("fact claim relation", """d AS (SELECT target_id AS id, min(date_min) AS day FROM claim GROUP BY ALL), f AS (SELECT subject_id AS person_id, fact.id AS ref, day FROM fact LEFT JOIN d USING (id) WHERE fact.id % 3 <> 1),
r AS (SELECT person_id, 'fact' AS kind, ref, day FROM f UNION ALL SELECT subject_id, 'haendelse', id, make_date(CAST(year AS BIGINT), 1, 1) FROM relation WHERE NOT (id % 2 = 0 AND id IN (SELECT ref FROM f)))
SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY day NULLS LAST, ref, kind) AS place FROM r"""),
    "grouped_bookmarks": sql("person anchor", "l AS (SELECT person_id, min(line) AS line FROM anchor GROUP BY person_id) SELECT coalesce(l.line, '') AS line, count(*) AS n FROM person LEFT JOIN l ON l.person_id = person.id WHERE person.id % 4 = 0 GROUP BY ALL"),
}
