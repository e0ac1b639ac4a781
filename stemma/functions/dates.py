"""Fuzzy dates and years, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the source texts use.
MONTHS = {"jan": 1, "jän": 1, "jaen": 1, "feb": 2, "mar": 3, "mär": 3, "maer": 3, "apr": 4, "maj": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dec": 12, "dez": 12}
ROMAN = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
_BEFORE, _AFTER, _BETWEEN = r"(?<![a-z0-9_])(?:før|inden|senest)(?![a-z0-9_])", r"(?<![a-z0-9_])efter(?![a-z0-9_])", r"(?<![a-z0-9_])mellem(?![a-z0-9_])"
_ABOUT = r"(?<![a-z0-9_])(?:ca|circa|omkr|omkring|um)(?![a-z0-9_])|(?<![a-z0-9_])o\."
_FLORUIT = r"[-–]\s*\d{3,4}(?:\s*[-–]\s*\d{3,4})?\s*[-–](?!\s*\d)"
_ROMAN_FORM = r"^m{0,4}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})$"


def parse_year(text: Column) -> Column:
    """The first run of three or four digits, or null."""
    return F.nullif(F.regexp_extract(text, r"\d{3,4}", 0), F.lit("")).cast("int")


def life_span(born: Column, died: Column) -> Column:
    """``a–b``; with one side only ``* a`` or ``† b``; '' without any. Leading marks of the inputs are dropped."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*[*†]\s*", ""))
    b, d = clean(born), clean(died)
    return F.when((b != "") & (d != ""), F.concat(b, F.lit("–"), d)).when(b != "", F.concat(F.lit("* "), b)).when(d != "", F.concat(F.lit("† "), d)).otherwise("")


def strip_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\([^)]*\)", ""))


def roman_value(token: Column) -> Column:
    """The value of a lower-case Roman numeral of a valid form; null otherwise."""
    digits = F.transform(F.split(token, ""), lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in ROMAN.items()], F.lit(0)))
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(token.rlike(_ROMAN_FORM) & (token != ""), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def _month(word: Column) -> Column:
    at = lambda n: F.coalesce(*[F.when(F.substring(word, 1, n) == k, F.lit(v)) for k, v in MONTHS.items() if len(k) == n])
    return F.coalesce(at(4), at(3))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def fuzzy_date(raw: Column) -> Column:
    """A struct of min, max (ISO strings, null: open), qualifier, certainty and understood.

    Marks of doubt are read first: ``147(5?)`` and ``1475?`` are best readings,
    ``14?5`` stands for all ten. Then years: four digits, or else one Roman
    numeral from 1000 to 2100. None, or more than two, is not understood. Two
    years are a range; one year is a day, a whole year, or a bound, as its
    qualifier says (floruit before 'before' before 'after' before 'about').
    Null reads as an empty text.
    """
    text, null = F.lit, F.lit(None).cast("string")
    first, last = (lambda x: F.concat(x, F.lit("-01-01"))), (lambda x: F.concat(x, F.lit("-12-31")))
    hole, day_form, iso_form = r"(?<![\d?])(\d{1,3})\?(\d{0,2})(?![\d?])", r"(\d{1,2})\.\s*([a-zæøåäöü]+)", r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"

    def features(x: Column) -> Column:
        """What the patterns find, each evaluated once. x: t (marks of doubt read) and doubt."""
        t = x["t"]
        arabic = F.regexp_extract_all(t, F.lit(r"(\d{4})"), 1)
        roman = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?<![a-z0-9_])([mdclxvi]{4,})(?![a-z0-9_])"), 1), roman_value), lambda y: y.between(1000, 2100))
        years = F.when(t.rlike(r"\d{4}"), arabic).when(F.size(roman) == 1, F.transform(roman, lambda y: y.cast("string"))).otherwise(F.array().cast("array<string>"))
        y = F.get(years, F.lit(0))
        ahead = lambda word: F.instr(F.get(F.split(t, word, 2), F.lit(0)), y) > 0
        return F.struct(
            x["doubt"].alias("doubt"), years.alias("years"), F.regexp_extract(t, hole, 1).alias("head"), F.regexp_extract(t, hole, 2).alias("tail"),
            t.rlike(_BETWEEN).alias("between"), t.rlike(_BEFORE).alias("before"), t.rlike(_AFTER).alias("after"), t.rlike(_ABOUT).alias("about"), t.rlike(_FLORUIT).alias("floruit"),
            F.when(t.rlike(_BEFORE), ahead(_BEFORE)).alias("year_before"), F.when(t.rlike(_AFTER), ahead(_AFTER)).alias("year_after"),
            F.nullif(F.regexp_extract(t, day_form, 1), F.lit("")).cast("int").alias("day"), _month(F.regexp_extract(t, day_form, 2)).alias("month"), F.nullif(F.regexp_extract(t, iso_form, 0), F.lit("")).alias("iso"),
        )

    def spans(f: Column) -> Column:
        """The span of one or two years, and the bounds of an unreadable digit. f: features."""
        y = F.get(f["years"], F.lit(0))
        point = F.coalesce(
            F.when(f["day"].between(1, 31) & f["month"].isNotNull(), F.concat(y, F.lit("-"), _padded(f["month"]), F.lit("-"), _padded(f["day"]))),
            F.when(F.substring(f["iso"], 1, 4) == y, f["iso"]),
        )
        wild = F.char_length(f["head"]) + F.char_length(f["tail"]) == 3
        year = lambda q: F.struct(first(y).alias("min"), last(y).alias("max"), q.alias("qualifier"))
        one = (
            F.when(f["floruit"], year(text("floruit")))
            .when(f["before"], F.struct(F.when(f["year_before"], first(y)).alias("min"), F.coalesce(point, last(y)).alias("max"), text("before").alias("qualifier")))
            .when(f["after"], F.struct(F.coalesce(point, first(y)).alias("min"), F.when(f["year_after"], last(y)).alias("max"), text("after").alias("qualifier")))
            .when(f["about"], year(text("about")))
            .when(point.isNotNull(), F.struct(point.alias("min"), point.alias("max"), null.alias("qualifier")))
            .otherwise(year(null))
        )
        two = F.struct(
            first(F.array_min(f["years"])).alias("min"), last(F.array_max(f["years"])).alias("max"),
            F.when(f["between"] | (f["before"] & f["after"]), text("between")).when(f["floruit"], text("floruit")).when(f["about"], text("about")).alias("qualifier"),
        )
        open_ = F.struct(F.concat(f["head"], F.lit("0"), f["tail"], F.lit("-01-01")).alias("min"), F.concat(f["head"], F.lit("9"), f["tail"], F.lit("-12-31")).alias("max"), null.alias("qualifier"))
        span = F.when(wild, open_).when(F.size(f["years"]) == 1, one).when(F.size(f["years"]) == 2, two)
        return F.struct(span.alias("span"), F.when(wild | f["doubt"], text("uncertain")).alias("certainty"))

    def result(r: Column) -> Column:
        s = r["span"]
        return F.struct(s["min"].alias("min"), s["max"].alias("max"), s["qualifier"].alias("qualifier"), r["certainty"].alias("certainty"), (s["min"].isNotNull() | s["max"].isNotNull()).alias("understood"))

    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    read = lambda x: F.regexp_replace(F.regexp_replace(x, r"\((\d{1,2})\s*\?\)", "$1"), r"(\d{4})\s*\?", "$1")
    marked = lambda x: F.struct(read(x).alias("t"), (read(x) != x).alias("doubt"))
    return _let(low, lambda x: _let(marked(x), lambda m: _let(features(m), lambda f: _let(spans(f), result))))


def year_interval(raw: Column, slack: int = 5) -> Column:
    """A struct of lo, hi (int, null: open): 'ca.' widens by slack, 'før' and 'efter' open one side, two years are a range."""
    t = F.lower(F.coalesce(raw, F.lit("")))
    years = F.transform(F.regexp_extract_all(t, F.lit(r"(\d{4})"), 1), lambda y: y.cast("int"))
    lo, hi = F.array_min(years), F.array_max(years)
    wide = F.when(t.rlike(_ABOUT), F.lit(slack)).otherwise(F.lit(0))
    return F.struct(
        F.when(~(t.rlike(_BEFORE) & (F.size(years) == 1)), lo - wide).alias("lo"),
        F.when(~(t.rlike(_AFTER) & (F.size(years) == 1)), hi + wide).alias("hi"),
    )


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Do two intervals meet? A null bound is open."""
    return F.coalesce(a_lo <= b_hi, F.lit(True)) & F.coalesce(b_lo <= a_hi, F.lit(True))


def known(lo: Column, hi: Column) -> Column:
    return lo.isNotNull() | hi.isNotNull()


def is_exact_day(lo: Column, hi: Column, qualifier: Column) -> Column:
    return F.coalesce(lo == hi, F.lit(False)) & qualifier.isNull()
