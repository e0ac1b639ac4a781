"""URL filtering by a Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that
level 1 accepts without their being listed, level 3 the listed keys that level
2 accepts, and so on until a level has no false positive. A key of the corpus
is listed exactly if the first level that rejects it is an even one, so the
answer is exact over the complete key universe and judging a url is a chain of
bit tests: no join and no shuffle. The universe is swept once, for level 1;
every later level works on the few keys left over.

A filter is an array of 64-bit words held in the plan as a literal; its size
is proven: level 1 has ``bits_per_key`` bits per listed key, the false
positives of level 1 are a fraction ``2 ** -HASHES`` of the universe, and the
build stops with an error beyond ``max_words`` words in a level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

HASHES = 7


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


@dataclass
class Cascade:
    """levels: the words of each level's bit array."""

    levels: list[list[int]] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels), 0, -1):
            hit = _hit(key, self.levels[n - 1], n)
            answer = F.when(hit, answer).otherwise(F.lit(n % 2 == 0))
        return answer


def _positions(key: Column, bits: int, level: int) -> list[Column]:
    one, two = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(one + F.lit(i) * (two % F.lit(1 << 40)), F.lit(bits)) for i in range(HASHES)]


def _hit(key: Column, words: list[int], level: int) -> Column:
    bits, held = 64 * len(words), F.lit(words).cast("array<bigint>")
    found = F.lit(True)
    for at in _positions(key, bits, level):
        word = F.get(held, F.shiftright(at, 6).cast("int"))
        found = found & (F.getbit(word, (at % 64).cast("int")) == 1)
    return found


def _encode(keys: DataFrame, count: int, level: int, bits_per_key: int, max_words: int) -> list[int]:
    """keys: a frame with the column key. The bits are gathered by word on the executors; the driver gets the finished words."""
    size = max(1, -(-count * bits_per_key // 64))
    if size > max_words:
        raise ValueError(f"level {level} of the cascade would take {size} words; max_words is {max_words}")
    at = F.explode(F.array(*_positions(F.col("key"), 64 * size, level))).alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    rows = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * size
    for r in rows:
        words[r["word"]] = r["bits"]
    return words


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 12, max_words: int = 1 << 22) -> Cascade:
    """listed, universe: frames with a string column ``key``; nulls and repeats are ignored. An empty list gives a cascade that holds nothing."""
    inside = materialise(listed.select("key").where(F.col("key").isNotNull()).distinct(), "cascade-listed")
    cascade, size = Cascade(), inside.count()
    if not size:
        return cascade
    keep, level = inside, 1
    cascade.levels.append(_encode(keep, size, level, bits_per_key, max_words))
    rest = universe.select("key").where(F.col("key").isNotNull() & _hit(F.col("key"), cascade.levels[0], 1)).distinct().join(inside, "key", "left_anti")
    while True:
        rest = materialise(rest, f"cascade-{level}")
        size = rest.count()
        if not size:
            return cascade
        level += 1
        cascade.levels.append(_encode(rest, size, level, bits_per_key, max_words))
        keep, rest = rest, keep.where(_hit(F.col("key"), cascade.levels[-1], level))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Null, or without ``://``: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys that could be a fitting rule: host suffixes with as many labels, and path prefixes as long, as some rule has. Longest first."""
    labels = sorted({r.host.count(".") + 1 for r in rules}, reverse=True)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    parts = F.split(host, r"\.", -1)
    made = [
        F.when((F.size(parts) >= n) & (F.char_length(path) >= k), F.concat(F.array_join(F.slice(parts, -n, n), "."), F.substring(path, 1, k)))
        for n in labels
        for k in lengths
        if any(r.host.count(".") + 1 == n and len(r.path) == k for r in rules)
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int = 12, max_words: int = 1 << 22) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest fitting rule wins (of equally long ones a blocking
    rule, then the smaller string). Where none fits, rule is null and the
    verdict is ``default``: neither cascade holds any key of the url. A null
    url, or one without ``://``, has an empty host and path, which no rule
    fits. Repeated rows are judged each; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    universe = split.select(F.explode(candidate_keys(F.col("host"), F.col("path"), rules)).alias("key")).distinct()
    held = {}
    for verdict in ("block", "allow"):
        keys = sorted({r.key for r in rules if r.verdict == verdict})
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        held[verdict] = build_cascade(listed, universe, bits_per_key, max_words)

    def order(a: Column, b: Column) -> Column:
        longer = F.char_length(b["key"]) - F.char_length(a["key"])
        blocking = F.when(a["verdict"] == b["verdict"], 0).when(a["verdict"] == "block", -1).otherwise(1)
        text = F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.when(longer != 0, longer).when(blocking != 0, blocking).otherwise(text)

    def fitting(verdict: str) -> Column:
        listed = F.filter("keys", lambda k: held[verdict].contains(k))
        return F.transform(listed, lambda k: F.struct(k.alias("key"), F.lit(verdict).alias("verdict")))

    fits = F.array_sort(F.concat(fitting("block"), fitting("allow")), order)
    keyed = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules)).withColumn("best", F.get(fits, F.lit(0)))
    return keyed.select(
        F.col(id_col).alias("page_id"), "host", "path",
        F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
f AS (
  SELECT u.page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost || rpath) DESC) AS n
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id AND f.n = 1
"""
