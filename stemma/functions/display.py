"""Small texts, checks and comparisons for people who review records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Warnings, age units and the words that don't belong in a bare name.
BORN_BEFORE, BORN_AFTER = "Barn født før forælder — tjek kilder.", "Barn født efter forælders død — tjek kilder."
NAME_NOISE = ["til ", "Greve", "Grevinde", "Comtesse", "Baron", "Kammerherre", "Geheime", "General", "Oberst", "Amtmand", "("]
_HOUR, _DAY, _WEEK, _MONTH = 3_600, 86_400, 604_800, 2_592_000


def era_warning(child_born: Column, parent_born: Column, parent_died: Column, margin: int = 1) -> Column:
    """What is wrong with a child's year against a parent's, or null."""
    return F.when(child_born < parent_born, F.lit(BORN_BEFORE)).when(child_born > parent_died + margin, F.lit(BORN_AFTER))


def media_age(seconds: Column) -> Column:
    """The age of an upload in words; unknown for null and for the future."""
    n = lambda unit: F.floor(seconds / F.lit(unit)).cast("long")
    said = lambda unit, one, more: F.concat(n(unit).cast("string"), F.when(n(unit) == 1, f" {one}").otherwise(f" {more}"))
    return (
        F.when(seconds.isNull() | (seconds < 0), "ukendt alder").when(seconds < _HOUR, "under 1 time — muligvis i gang").when(seconds < _DAY, said(_HOUR, "time", "timer"))
        .when(seconds < _WEEK, said(_DAY, "dag", "dage")).when(seconds < _MONTH, said(_WEEK, "uge", "uger")).otherwise(said(_MONTH, "måned", "måneder"))
    )


def pair_key(a: Column, b: Column) -> Column:
    """One key for both orders of a pair of ids; ids are ordered as text."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def field_status(a: Column, b: Column) -> Column:
    """neutral (nothing on either side), enig or afvigende, without regard to case, full stops and white space."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"\.", ""), r"\s+", " "))
    return F.when((bare(a) == "") & (bare(b) == ""), "neutral").when(bare(a) == bare(b), "enig").otherwise("afvigende")


def noisy_name(name: Column) -> Column:
    """Does a name hold a title, an estate or a bracket?"""
    out = F.lit(False)
    for word in NAME_NOISE:
        out = out | F.coalesce(F.contains(name, F.lit(word)), F.lit(False))
    return out


def spans_not_verbatim(spans: Column, text: Column) -> Column:
    """How many of the non-blank spans are not in the text word for word."""
    return F.size(F.filter(spans, lambda s: (F.coalesce(s, F.lit("")) != "") & ~F.coalesce(F.contains(text, s), F.lit(False))))


def name_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all, by longest matching blocks; null reads as empty. An Arrow-batched UDF."""

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        import pandas as pd

        return pd.Series([SequenceMatcher(None, s or "", t or "").ratio() for s, t in zip(x, y, strict=True)], index=x.index, dtype="float64")

    return ratio(a, b)
