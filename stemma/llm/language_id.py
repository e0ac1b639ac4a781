"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page:

* the text: a naive Bayes likelihood of its letter trigrams, counted over every
  labelled document;
* the language that the markup declares;
* the address suffix (the last label of the host);
* a prior of the host, smoothed towards its domain, and that towards all pages.

How far a declaration, a suffix or a host is to be believed comes from grouped
sums of the texts' own posteriors over all pages. A page's own share is taken
out of every sum before it is used for that page, so that no evidence counts
twice. Sums are partial in every task before they meet by key, and the domain
and suffix sums are made from the host sums; pages meet the host table and the
declaration table in one join each, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .url_filter import host_and_path

BUCKETS = 1 << 16
#: Overlapping trigrams count a third each, and a text's evidence grows up to so many letters.
OVERLAP, LETTERS = 3, 600
#: Pages that the level above is worth: of a host's prior its domain, of a domain's all pages; and of a likelihood its overall share.
HOST_WEIGHT, DOMAIN_WEIGHT, LIKELIHOOD_WEIGHT = 4.0, 8.0, 10.0
#: Languages whose counts a task holds at a time.
_HELD = 64
#: Characters that are turned into trigrams at a time.
_CHARS = 1 << 22
_LETTER: list = []

_TAG, _RAW = re.compile(r"<[^<>]*>"), re.compile(r"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_ENTITY = re.compile(r"&(#\d+|#x[0-9a-f]+|\w+);", re.I)


def _last(pattern: re.Pattern, text: str) -> int:
    at = -1
    for m in pattern.finditer(text):
        at = m.start()
    return at


def visible_text(html: str | None) -> str:
    """The page's text: no comments, scripts, styles or tags; entities are white space unless they are characters of a text. An opener that is never closed is a tag. Linear in the page."""
    from html import unescape

    html = html or ""
    parts, start, at, last = [], 0, 0, {"-->": html.rfind("-->")}
    while (i := html.find("<", at)) >= 0:
        end = -1
        if html.startswith("<!--", i):
            if i + 4 <= last["-->"]:
                end = html.index("-->", i + 4) + 3
        elif m := _RAW.match(html, i):
            name = m[1].lower()
            if name not in last:
                last[name] = _last(_CLOSE[name], html)
            if m.end() <= last[name]:
                end = _CLOSE[name].search(html, m.end()).end()
        if end < 0:
            end = m.end() if (m := _TAG.match(html, i)) else -1
        if end < 0:
            at = i + 1
            continue
        parts.append(html[start:i])
        start = at = end
    return _ENTITY.sub(lambda m: unescape(m.group(0)), " ".join([*parts, html[start:]]))


def trigrams(texts: list[str]):
    """Buckets of all texts' trigrams, one after the other (one per letter, with what stands beside it), and how many each text has."""
    import numpy as np

    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _LETTER[0][code]
    code = np.where(letter, code, 0)
    at = np.flatnonzero(letter)
    key = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1] * np.uint64(0x165667B19E3779F9)
    key ^= key >> np.uint64(29)
    bucket = ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    end = np.cumsum([len(t) + 1 for t in low]) + 1
    upto = np.searchsorted(at, end)
    return bucket, np.diff(np.r_[0, upto])


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded size."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < _CHARS:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _count(batches: Iterator) -> Iterator:
    """Batches of lang, text to lang, bucket, n: sums of the task."""
    import numpy as np
    import pyarrow as pa

    held: dict = {}

    def flush():
        for lang, n in held.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b), pa.array(n[b])], ["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in _slices(texts):
            bucket, sizes = trigrams(texts[lo:hi])
            names, which = np.unique(langs[lo:hi], return_inverse=True)
            which = np.repeat(which, sizes)
            for i, lang in enumerate(names.tolist()):
                if lang not in held:
                    if len(held) >= _HELD:
                        yield from flush()
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(bucket[which == i], minlength=BUCKETS)
    yield from flush()


@dataclass
class TextModel:
    """logp[l, b]: the log-probability of bucket b in language l."""

    langs: list[str]
    logp: object

    def evidence(self, texts: list[str]):
        """A row of tempered log-likelihoods per text, highest 0; zeros for a text without letters."""
        import numpy as np

        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi in _slices(texts):
            bucket, n = trigrams(texts[lo:hi])
            which = np.repeat(np.arange(hi - lo), n)
            for j in range(len(self.langs)):
                total = np.bincount(which, weights=self.logp[j][bucket], minlength=hi - lo)
                out[lo:hi, j] = total / np.maximum(n, 1) * np.minimum(n, LETTERS) / OVERLAP
        return out - out.max(axis=1, keepdims=True) if len(self.langs) else out


def fit_text_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """Rows with a null or empty language are not learned from. Every language with a labelled letter is known; one takes ``BUCKETS`` counts at most on the driver, and 256 KB of the model."""
    import numpy as np

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang <> '' and text <> ''")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-counts")
    got = counts.toArrow().to_pandas()
    langs = sorted(got["lang"].unique().tolist())
    n = np.zeros((len(langs), BUCKETS))
    n[[langs.index(x) for x in got["lang"]], got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    n += 0.5
    return TextModel(langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))


def declared_language(html: Column) -> Column:
    """The primary subtag that the html element, or else a content-language header, declares; '' without any."""
    # Possessive and atomic: a run of white space or attributes is tried once.
    tag = r"""(?i)<html\b[^<>]*?\blang\s*+=\s*+["']?\s*+([a-z]+)"""
    meta = r"""(?i)<meta\b(?>[^<>]*?http-equiv\s*+=\s*+["']?content-language)["']?[^<>]*?\bcontent\s*+=\s*+["']?\s*+([a-z]+)"""
    html = F.coalesce(html, F.lit(""))
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(html, tag, 1), F.lit("")), F.regexp_extract(html, meta, 1)))


def _sums(langs: list[str], of=lambda i: F.get("own", F.lit(i))) -> Column:
    """The sums of an array column, component by component."""
    return F.array(*[F.sum(of(i)) for i in range(len(langs))])


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, probability: one row per input row.

    lang has the highest posterior (ties: the first in alphabetic order) and
    text_lang the highest likelihood of the text alone. Null html counts as
    empty and gives the posterior of host, suffix and (no) declaration; a null
    url, or one without a host, is the host ''. Rows that repeat an id are
    judged each. Without a known language lang and probability are null. An
    empty table gives an empty result; other columns are ignored. A very long
    page is read whole, in one pass.
    """
    langs = model.langs
    held = pages.sparkSession.sparkContext.broadcast(model)
    host = host_and_path(F.col(url_col))[0]
    rows = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(host, r"^.*@|:\d*$", "").alias("host"), declared_language(F.col(html_col)).alias("declared"), F.col(html_col).cast("string").alias("html"))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", F.substring_index("host", ".", -1).alias("suffix"), "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def evidence(html):
        import pandas as pd

        return pd.Series(list(held.value.evidence([visible_text(x) for x in html])), index=html.index)

    rows = rows.select("page_id", "host", "declared", evidence("html").alias("text"))
    weight = F.transform("text", lambda x: F.exp(x))
    rows = rows.withColumn("own", F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, b: a + b)))
    rows = materialise(rows, "language-pages")

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    part = lambda name: (lambda i: F.get(name, F.lit(i)))

    # Grouped sums of the texts' posteriors: by host, from these by domain and suffix; by declaration.
    hosts = rows.groupBy("host").agg(_sums(langs).alias("at_host"))
    hosts = hosts.select("host", F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"), "at_host")
    hosts = materialise(hosts, "language-hosts")
    domains = hosts.groupBy("domain").agg(_sums(langs, part("at_host")).alias("at_domain"))
    suffixes = hosts.groupBy("suffix").agg(_sums(langs, part("at_host")).alias("at_suffix"))
    hosts = materialise(hosts.join(domains, "domain").join(suffixes, "suffix").drop("domain"), "language-priors")
    declared = materialise(rows.groupBy("declared").agg(_sums(langs).alias("at_declared")), "language-declared")
    everywhere = declared.agg(_sums(langs, part("at_declared")).alias("a")).first()
    everywhere = F.array(*[F.lit(float(x or 0.0)) for x in everywhere["a"]])

    def likelihood(at: str) -> Column:
        """P(value | language) from the other pages, smoothed with the value's share."""
        own = F.col("own")
        mine, all_ = less(F.col(at), own), less(everywhere, own)
        share = (total(mine) + 1) / (total(all_) + 2)
        return F.zip_with(mine, all_, lambda x, n: F.log((x + F.lit(LIKELIHOOD_WEIGHT) * share) / (n + F.lit(LIKELIHOOD_WEIGHT))))

    def smoothed(at: str, above: Column, weight: float) -> Column:
        mine = less(F.col(at), F.col("own"))
        return F.zip_with(mine, above, lambda x, p: (x + F.lit(weight) * p) / (total(mine) + F.lit(weight)))

    met = rows.join(hosts, "host").join(declared, "declared")
    met = met.withColumn("base", F.transform(less(everywhere, F.col("own")), lambda x: (x + 1) / (total(less(everywhere, F.col("own"))) + len(langs))))
    met = met.withColumn("prior", smoothed("at_host", smoothed("at_domain", F.col("base"), DOMAIN_WEIGHT), HOST_WEIGHT))
    met = met.withColumn("logs", add(add(F.col("text"), F.transform("prior", lambda x: F.log(x))), add(likelihood("at_suffix"), likelihood("at_declared"))))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    top = F.array_max("logs")
    return met.select(
        "page_id", "host", "suffix", "declared", best(F.col("text")).alias("text_lang"), best(F.col("logs")).alias("lang"),
        F.round(1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top)), 6).alias("probability"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), fit_text_model(table(spark, sf_dir, "documents")))
