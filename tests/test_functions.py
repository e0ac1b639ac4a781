import pytest
from pyspark.sql import functions as F

from stemma.functions import dates, text
from stemma.operators.family import kinship_label
from stemma.operators.linkage import jaro_winkler

DATES = [
    ("26. juli 1261", "1261-07-26", "1261-07-26", None), ("1645-01-01", "1645-01-01", "1645-01-01", None), ("1475", "1475-01-01", "1475-12-31", None),
    ("ca. 1500", "1500-01-01", "1500-12-31", "about"), ("før 1261", None, "1261-12-31", "before"), ("1496, før 10. okt.", "1496-01-01", "1496-10-10", "before"),
    ("efter 1300", "1300-01-01", None, "after"), ("mellem 1300 og 1310", "1300-01-01", "1310-12-31", "between"), ("1712-1783", "1712-01-01", "1783-12-31", None),
    ("(-1223-1247-)", "1223-01-01", "1247-12-31", "floruit"), ("14?5", "1405-01-01", "1495-12-31", None), ("147(5?)", "1475-01-01", "1475-12-31", None),
    ("MDCXLV", "1645-01-01", "1645-12-31", None), ("1300 1301 1302", None, None, None), ("", None, None, None), (None, None, None, None),
]


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_fuzzy_dates(spark):
    df = spark.createDataFrame([(d[0],) for d in DATES], "raw string").select("raw", dates.fuzzy_date(F.col("raw")).alias("f"))
    got = [(r["raw"], r["f"]["min"], r["f"]["max"], r["f"]["qualifier"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(DATES, key=str)


def test_years(spark):
    assert one(spark, dates.parse_year(F.lit("omkring 987 e.Kr.")), dates.parse_year(F.lit("12"))) == [987, None]
    assert one(spark, dates.life_span(F.lit("*1700"), F.lit("†1750")), dates.life_span(F.lit(None), F.lit("1750")), dates.life_span(F.lit(None), F.lit(None))) == ["1700–1750", "† 1750", ""]
    assert one(spark, dates.overlaps(*[F.lit(x).cast("int") for x in (None, 5, 5, None)]), dates.overlaps(*[F.lit(x) for x in (1, 2, 3, 4)])) == [True, False]


def test_names(spark):
    keys = one(spark, *[text.match_key(F.lit(n)) for n in ("Komtesse Friedrich Wilhelm", "Frederik Vilhelm", "Katharina", "Cathrina", "de von af")])
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == ""
    assert one(spark, *[text.ends_with_words(F.lit(a), F.lit(b)) for a, b in (("Anna Von  Berg", "von berg"), ("Berg Anna", "berg"), ("A-B", "a–b"), ("x", "y x"), ("A", None))]) == [True, False, True, False, False]
    order = spark.createDataFrame([(x,) for x in ("Ål", "Zar", "Øl", "Ære", "Aa", "1x", "Á")], "n string").orderBy(text.danish_key(F.col("n")))
    assert [r["n"] for r in order.collect()] == ["Aa", "Á", "Zar", "Ære", "Øl", "Ål", "1x"]
    assert one(spark, text.initial(F.lit("Anna [Øster]")), text.initial(F.lit(" "))) == ["Ø", "#"]


def test_hash_and_draws(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        return h

    assert one(spark, *[text.fnv1a(F.lit(s)) for s in ("", "abc", "æøå")]) == [fnv(s) for s in ("", "abc", "æøå")]
    u = [r[0] for r in spark.range(1, 200).select(text.draw(F.lit(7), F.col("id"))).collect()]
    assert all(0 <= x < 1 for x in u) and len(set(u)) == len(u) and 0.35 < sum(u) / len(u) < 0.65


def test_jaro_winkler():
    assert jaro_winkler("", "") == 0 and jaro_winkler("abc", "abc") == 1 and jaro_winkler("abc", "xyz") == 0
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)


def test_kinship_labels(spark):
    cases = [
        (0, 0, None, None, False, "Samme person"), (0, 1, "mand", "kvinde", False, "Far & datter"), (2, 0, "kvinde", "kvinde", False, "Bedstemor & barnebarn"), (0, 6, None, None, False, "Tip-tipoldeforælder & efterkommer"),
        (1, 1, "mand", "mand", False, "Brødre"), (1, 1, "mand", "kvinde", True, "Halvbror & halvsøster"), (1, 2, "kvinde", "mand", False, "Tante & nevø"), (3, 1, None, "mand", True, "Grandonkel & grandniece/-nevø (halv)"),
        (2, 2, "kvinde", "kvinde", False, "1. grads kusiner"), (2, 3, None, None, False, "1. grads fætter/kusine · 1 gang forskudt"), (5, 3, "mand", "kvinde", False, "2. grads fætter & kusine · 2 gange forskudt"),
    ]
    df = spark.createDataFrame(cases, "d1 int, d2 int, a string, b string, half boolean, want string")
    for r in df.withColumn("got", kinship_label(F.col("d1"), F.col("d2"), F.col("a"), F.col("b"), F.col("half"))).collect():
        assert r["got"] == r["want"]
