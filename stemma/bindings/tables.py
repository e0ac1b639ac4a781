"""The generic tables in the roles of the data model.

A role is a list of expressions over one table that Spark and DuckDB read
alike, so the frame and the SQL relation of a role come from one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "l_orderkey * 10 + l_linenumber"
#: The source of a person's entry: a third of the persons have entries in two.
_SOURCE = "o_custkey % 50 + CASE WHEN o_custkey % 3 = 1 THEN o_orderkey % 2 ELSE 0 END + 1"
_RAW = """CASE o_orderkey % 8
  WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 1 THEN concat('ca. ', CAST(year(o_orderdate) AS STRING))
  WHEN 2 THEN concat('før ', CAST(year(o_orderdate) AS STRING))
  WHEN 3 THEN concat('efter ', CAST(year(o_orderdate) AS STRING))
  WHEN 4 THEN concat('mellem ', CAST(year(o_orderdate) AS STRING), ' og ', CAST(year(o_orderdate) + 3 AS STRING))
  WHEN 5 THEN concat('(-', CAST(year(o_orderdate) AS STRING), '-)')
  WHEN 6 THEN concat(CAST(day(o_orderdate) AS STRING), '. maj ', CAST(year(o_orderdate) AS STRING))
  ELSE '19?5' END"""

#: role -> (table, expressions, condition, group by)
ROLES: dict[str, tuple[str, list[str], str | None, str | None]] = {
    "person": ("customer", [
        "c_custkey AS id", "c_name AS name",
        "CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE c_custkey % 7 = 0 END AS living",
        "c_mktsegment = 'MACHINERY' AS private", "c_custkey % 13 = 5 AS staged",
        "CASE c_custkey % 3 WHEN 0 THEN 'mand' WHEN 1 THEN 'kvinde' END AS sex",
        "CAST(1700 + (c_custkey * 37) % 200 AS INT) AS born",
        "CASE WHEN c_custkey % 5 <> 0 THEN CAST(1715 + (c_custkey * 37) % 200 + c_custkey % 70 AS INT) END AS died",
        "c_nationkey AS nation", "c_mktsegment AS line", "CASE WHEN c_custkey % 6 = 0 THEN 'udkast' END AS status",
    ], None, None),
    "fact": ("orders", [
        "o_orderkey AS id", "'person' AS subject_type", "o_custkey AS subject_id",
        "CASE o_orderkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'birth' WHEN 2 THEN 'death' ELSE 'title' END AS kind",
    ], None, None),
    "claim": ("lineitem", [
        f"{_ID} AS id", "'fact' AS target_type", "l_orderkey AS target_id",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE min(concat(l_returnflag, l_linestatus)) END AS value",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(CAST(min(l_shipdate) AS DATE) AS STRING) END AS date_raw",
        "CASE WHEN l_linenumber >= 5 THEN NULL ELSE CAST(min(l_shipdate) AS DATE) END AS date_min",
        "CASE WHEN l_linenumber >= 5 THEN NULL ELSE CAST(max(l_shipdate) AS DATE) END AS date_max",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'about' END AS qualifier",
    ], None, "l_orderkey, l_linenumber"),
    "conclusion": ("lineitem", [
        "l_orderkey AS id", "'fact' AS target_type", "l_orderkey AS target_id", f"min({_ID}) AS chosen_id",
        "CASE WHEN l_orderkey % 5 = 4 THEN 'omstridt' ELSE 'afklaret' END AS status",
    ], None, "l_orderkey"),
    "citation": ("lineitem", [
        f"({_ID}) * 1000000 + l_partkey AS id", f"{_ID} AS claim_id", "l_suppkey AS source_id",
        "CAST(l_partkey % 500 AS STRING) AS page",
        "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN concat(l_returnflag, '?') ELSE concat(l_returnflag, l_linestatus) END AS quote",
    ], "l_linenumber <> 4", None),
    "source": ("supplier", [
        "s_suppkey AS id", "s_name AS title", "CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE concat('Udg. ', CAST(s_nationkey AS STRING)) END AS edition",
        "1900 + s_nationkey AS year", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('k', CAST(s_suppkey AS STRING)) END AS import_key",
    ], None, None),
    "anchor": ("orders", [
        "o_custkey AS person_id", f"{_SOURCE} AS source_id", "min(CAST(o_orderkey AS INT)) AS nr", "min(substring(o_orderpriority, 1, 1)) AS line", "CAST(min(o_orderkey) % 12 AS INT) AS generation",
        "CASE WHEN min(o_orderkey) % 9 = 0 THEN NULL ELSE concat('r', CAST(min(o_orderkey) AS STRING)) END AS record_key",
    ], None, f"o_custkey, {_SOURCE}"),
    "parent_child": ("customer", [
        "c_custkey AS child", "CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) AS father", "CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS mother",
        "CASE c_custkey % 4 WHEN 0 THEN 'sikker' WHEN 1 THEN 'sandsynlig' WHEN 2 THEN 'formodet' END AS confidence",
    ], "c_custkey > 3", None),
    "member": ("customer", ["c_nationkey AS family_id", "c_custkey AS person_id", "CASE WHEN c_custkey % 4 < 2 THEN 'partner' ELSE 'barn' END AS role", "CAST(c_custkey % 50 AS INT) AS ordinal"], None, None),
    "lineage": ("customer", [
        "c_custkey AS id", "CASE WHEN c_custkey > 1 THEN CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) END AS parent_id",
        "CASE WHEN c_custkey % 17 = 0 OR c_custkey = 1 THEN concat('von ', substring(c_name, 10, 9)) END AS surname",
    ], "c_custkey > 0", None),
    "raw_date": ("orders", ["o_orderkey AS id", f"{_RAW} AS raw"], None, None),
    "narrative": ("documents", [
        "doc_id AS id", "CAST(floor(doc_id / 6) AS BIGINT) AS person_id", "doc_id % 3 AS source_id", "CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text",
        "CASE WHEN doc_id % 3 < 2 THEN 'edition' ELSE 'other' END AS source_kind", "CASE WHEN doc_id % 3 = 1 THEN NULL ELSE 1900 + doc_id % 3 END AS year",
    ], None, None),
    "marked_text": ("documents", [
        "doc_id AS id",
        "concat(text, ' [[person:', CAST(doc_id % 1800 AS STRING), '|x]] og [[', CASE WHEN doc_id % 3 = 0 THEN 'media' ELSE 'person' END, ':', CAST((doc_id * 7) % 300 AS STRING)) AS text",
    ], None, None),
    "media": ("documents", [
        "doc_id AS id", "concat('m/', CAST(doc_id AS STRING)) AS path", "md5(text) AS sha", "n_chars AS byte_size", "lang AS width", "source AS height",
        "CASE doc_id % 5 WHEN 0 THEN 'reserveret' ELSE 'klar' END AS status", "doc_id % 4 <> 0 AS may_publish", "CAST(doc_id % 20 AS INT) AS age_days",
    ], None, None),
    "depiction": ("documents", ["doc_id AS media_id", "'person' AS object_type", "doc_id % 1500 AS object_id", "doc_id % 3 = 0 AS is_primary"], "doc_id % 3 <> 1", None),
    "place": ("supplier", [
        "s_suppkey AS id", "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(54.5 + (s_suppkey * 13 % 300) / 100.0 AS DOUBLE) END AS lat",
        "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(8.0 + (s_suppkey * 29 % 500) / 100.0 AS DOUBLE) END AS lon", "s_name AS name", "s_nationkey AS kind",
    ], None, None),
    "relation": ("orders", [
        "o_orderkey AS id", "o_custkey AS subject_id", "o_custkey % 30 AS object_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'ejer' WHEN 1 THEN 'beboer' ELSE 'nævnt' END AS role",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) END AS year",
    ], None, None),
    "change": ("events", [
        "event_id AS id", "user_id AS row_id", "ts AS made", "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op",
        "value AS after_value", "CAST(event_id % 500 AS BIGINT) AS set_id", "event_type AS kind",
    ], None, None),
    "record_a": ("part", [
        "p_partkey AS id", "p_name AS name_key", "CAST(1700 + p_size * 3 AS INT) AS birth_min", "CAST(1702 + p_size * 3 AS INT) AS birth_max",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(1760 + p_size AS INT) END AS death_min", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(1760 + p_size AS INT) END AS death_max",
        "CASE p_partkey % 5 WHEN 0 THEN 'ukendt' WHEN 1 THEN 'm' ELSE 'k' END AS sex",
    ], None, None),
    "record_b": ("part", [
        "p_partkey AS id", "p_name AS name_key", "CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE CAST(1701 + p_size * 3 AS INT) END AS birth_min",
        "CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE CAST(1701 + p_size * 3 AS INT) END AS birth_max", "CAST(1755 + p_size AS INT) AS death_min", "CAST(1765 + p_size AS INT) AS death_max",
        "CASE p_partkey % 5 WHEN 0 THEN 'ukendt' WHEN 1 THEN 'm' ELSE 'k' END AS sex",
    ], None, None),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from pyspark.sql import functions as F

    table, exprs, where, group = ROLES[name]
    df = read(spark, sf_dir, table)
    if where:
        df = df.where(where)
    if not group:
        return df.selectExpr(*exprs)
    keys = [F.expr(k.strip()) for k in group.split(",")]
    names = [e.rsplit(" AS ", 1) for e in exprs]
    sums = [(e, a) for e, a in names if any(f in e for f in ("min(", "max("))]
    plain = [(e, a) for e, a in names if (e, a) not in sums]
    grouped = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], *[F.expr(e).alias(f"_p_{a}") for e, a in plain], *[F.expr("l_linenumber").alias("l_linenumber")] if "l_linenumber" in group else [])
    out = grouped.agg(*[F.expr(e).alias(a) for e, a in sums])
    return out.select(*[F.col(f"_p_{a}").alias(a) if (e, a) in plain else F.col(a) for e, a in names])


def relation(name: str) -> str:
    table, exprs, where, group = ROLES[name]
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {table}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {group}" if group else "") + ")"


def sql(names: str, body: str, recursive: bool = False) -> str:
    """body, a query or ``name AS (...)`` relations and a query, over the named roles."""
    body = body.strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(relation(n) for n in names.split()) + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
