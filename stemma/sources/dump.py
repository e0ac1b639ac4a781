"""Tables out of MySQL dump files.

A dump is read as statements (the text source splits at ``;`` and a line
break; dumps write line breaks inside literals as escapes), so a large file is
read by many tasks. All columns are strings, named by the dump's own CREATE
TABLE; NULL is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = re.compile(r"""\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()'\s][^,()]*))\s*([,)])""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unescape(literal: str) -> str:
    """The text of a quoted literal's inside."""
    return re.sub(r"\\(.)|''", lambda m: "'" if m.group(0) == "''" else _ESCAPES.get(m.group(1), m.group(1)), literal, flags=re.S)


def tuples(text: str) -> Iterator[list[str | None]]:
    """The rows of an INSERT statement's VALUES."""
    at, row = text.find("("), []
    while at >= 0:
        m = _VALUE.match(text, at + 1)
        if not m:
            raise ValueError(f"unreadable values at {text[at : at + 40]!r}")
        quoted, bare, end = m.groups()
        row.append(unescape(quoted) if quoted is not None else None if bare.strip().upper() == "NULL" else bare.strip())
        at = m.end() - 1
        if end == ")":
            yield row
            row, at = [], text.find("(", m.end())


def statements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", ";\n").text(path).select(F.regexp_replace("value", r"(?m)^(--.*|/\*.*?\*/)?\s*$\n?", "").alias("value"))


def columns(spark: SparkSession, path: str, table: str) -> list[str]:
    """Column names from the dump's CREATE TABLE."""
    form = rf"(?si)^\s*CREATE TABLE (IF NOT EXISTS )?`?{re.escape(table)}`?\s*\("
    found = statements(spark, path).where(F.col("value").rlike(form)).limit(1).collect()
    if not found:
        raise ValueError(f"no CREATE TABLE {table}")
    return re.findall(r"(?m)^\s*`(\w+)`\s", found[0]["value"].split("(", 1)[1])


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table's rows from all its INSERTs, with or without a column list; columns that an INSERT leaves out are null."""
    names = columns(spark, path, table)
    head = rf"(?si)^\s*INSERT INTO `?{re.escape(table)}`?\s*(\(([^()]*)\))?\s*VALUES\s*(.*)$"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for listed, values in zip(pdf["listed"], pdf["vals"], strict=True):
                given = [c.strip(" `\n") for c in listed.split(",")] if listed else names
                out += [dict(zip(given, row, strict=True)) for row in tuples(values)]
            yield pd.DataFrame(out, columns=names, dtype="object")

    rows = statements(spark, path).where(F.col("value").rlike(head)).select(F.regexp_extract("value", head, 2).alias("listed"), F.regexp_extract("value", head, 3).alias("vals"))
    return rows.mapInPandas(run, ", ".join(f"`{c}` string" for c in names))
