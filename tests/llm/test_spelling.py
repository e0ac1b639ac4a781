"""Spelling variants against counts and deletion variants in plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from stemma.llm import spelling
from tests.conftest import DATA, SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= 5
    return {w: n for w, n in seen.items() if n >= 3}


def near(words):
    out, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                out[w].add(shorter)
                out[shorter].add(w)
            holes[i, shorter].add(w)
    for group in holes.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute(counts):
    pairs, form = near(counts), {}
    for w in counts:
        best = min(pairs[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w] or "", root, counts[w], len(pairs[w]), counts[form[w]] if form[w] else -1))
    return sorted(out)


def plain(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("sf_dir", [SMALL, DATA])
def test_whole_tables_agree_with_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(spelling.op12_spelling(spark, sf_dir)) == brute(count(rows))


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_every_partitioning_finds_the_same_pairs(spark, limit):
    import itertools

    counts = {"".join(w): 3 + i * i for i, w in enumerate(itertools.product("abé", repeat=5))}
    counts |= {"aaaa" + "b" * i: 5 * i for i in range(1, 9)} | {"xabab" + "a" * 300: 7, "abab" + "a" * 300: 3, "aabab": 900, "zzzzzz": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert plain(spelling.spelling_forms(words, limit)) == brute(counts)


def test_awkward_rows(spark):
    rows = [(None, "Wordy WORDY wordy wordi"), (1, None), (2, ""), (2, "Ärger ärger ÄRGER Ärger×x 1word2words words words wordss"), (2, "words " * 50), (2, "a" * 5000 + " "), (3, "a" * 5000), (4, "A" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    words = spelling.vocabulary(docs)
    assert plain(spelling.spelling_forms(words)) == brute(count(rows))
    assert spelling.spelling_forms(spelling.vocabulary(docs.where("false"))).count() == 0
