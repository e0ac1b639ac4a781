"""JSON book records, CSV exchange files and the Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FACT = "faktatype string, vaerdi string, date_raw string, date_min string, date_max string, date_qualifier string, sted string, kilde_span string, calendar string, date_certainty string"
_MARRIAGE = "ordinal int, partner_navn string, partner_ekstern_ref string, type string, dato_raw string, date_min string, date_max string, sted string, skilt boolean, note string"
RECORD = f"linje string, nr int, nr_label string, usikker boolean, navn string, tilnavn string, koen string, facts array<struct<{_FACT.replace(' string', ':string')}>>, godser array<struct<navn:string, periode_raw:string, period_type:string, sted:string>>, embeder array<struct<organisation:string, rolle:string, dato_raw:string>>, aegteskaber array<struct<{_MARRIAGE.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, narrative string, sider array<string>"
PAIR = ["a_id", "b_id", "name_sim", "score", "tier"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extracted records, one JSON object per file, under a fixed schema: unknown keys are ignored and missing ones null. A record that isn't JSON fails the job."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def record_facts(records: DataFrame) -> DataFrame:
    """linje, nr, ordinal and the fields of each fact."""
    rows = records.select("linje", "nr", F.posexplode("facts").alias("ordinal", "f"))
    return rows.select("linje", "nr", "ordinal", "f.*")


def write_pairs(pairs: DataFrame, path: str) -> str:
    """Scored pairs as CSV files with a header."""
    pairs.select(*PAIR).write.option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def report(rows: DataFrame, category: str, line: str, title: str, limit: int = 1000) -> str:
    """A Markdown report: rows per category, then up to ``limit`` listed lines (the report's feature; the counts cover all rows)."""
    counts = rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(category).collect()  # one row per category
    listed = rows.orderBy(category, line).limit(limit).collect()
    out = [f"# {title}", ""] + [f"- {r[category]}: {r['n']}" for r in counts]
    for r in counts:
        out += ["", f"## {r[category]}", ""] + [f"- {x[line]}" for x in listed if x[category] == r[category]]
    return "\n".join(out) + "\n"


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """table, n: what a load has written."""
    out = None
    for name, df in frames.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def write_json(df: DataFrame, path: str, ids: list[str], defaults: dict) -> str:
    """An extract for other tools: JSON lines, ids as text, nulls replaced by defaults, other nulls left out."""
    rows = df.fillna(defaults)
    for c in ids:
        rows = rows.withColumn(c, F.col(c).cast("string"))
    rows.write.json(path)
    return path


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, changed of every object under path, in any depth. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def snapshot(spark: SparkSession, url: str, tables: list[str], options: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a database over JDBC, each a frame that reads within a read-only transaction. options: of the reader, such as user, driver or partitionColumn."""
    read = spark.read.format("jdbc").option("url", url).option("sessionInitStatement", "SET default_transaction_read_only = on").options(**(options or {}))
    return {t: read.option("dbtable", t).load() for t in tables}
