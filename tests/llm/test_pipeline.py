"""The pipeline's stages against plain Python on what the stage before kept."""

import corpus_pipeline as P
import duckdb
from pyspark.sql import functions as F

from stemma.llm import mixing

from ..conftest import SMALL
from .test_operators import brute_fingerprint, check_packing


def brute_shingles(text):
    """The different runs of five words, or the whole text if it is shorter."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name != "packing":
            assert out.columns == P.COLUMNS
        kept[name] = (docs, out)
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = kept["toxicity"]
    assert ids(after) <= ids(before) and len(ids(after)) >= 0.9 * before.count()

    before, after = kept["exact_dedup"]
    best = {}
    for r in before.collect():
        key = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert ids(after) == {i for _, i in best.values()}

    before, after = kept["simhash_near_dedup"]
    sets = {r["doc_id"]: brute_shingles(r["text"]) for r in before.collect()}
    least = {i: i for i in sets}
    while True:  # each takes the least label among those it is alike to
        new = {i: min(least[j] for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
        if new == least:
            break
        least = new
    assert ids(after) == set(least.values())

    before, after = kept["mixing"]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    assert ids(after) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.OP7_SQL}) WHERE kept").fetchall()}
    assert 0.6 < after.agg(F.sum("n_chars")).first()[0] / before.agg(F.sum("n_chars")).first()[0] < 0.95

    before, after = kept["packing"]
    check_packing(after, [(r["doc_id"], r["text"]) for r in before.collect()], 2048)


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    """Planted in one document of four; their labels are known for some. The scores themselves are tested by brute force beside the operator."""
    import random

    rng = random.Random(9)
    words = ["alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine", "rowan", "willow"]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for at in rng.sample(range(60), 6):
                text[at] = rng.choice(["wretchedscum", "vilegrub"])
        rows.append((i, " ".join(text), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(i % 4 == 0)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.drop_toxic(spark, docs, str(tmp_path)).collect()} == {i for i in range(240) if i % 4}


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "one two three four", "en", None, 1), (1, "five six seven eight", None, "s", None), (1, "five six seven eight", None, "s", None), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_id int")
    for stage in (P.exact_duplicates, P.near_duplicates):
        assert sorted((r["doc_id"] for r in stage(spark, docs, SMALL).collect()), key=str) == [1, 1, 2, None]
    assert sorted((r["doc_id"] for r in P.drop_toxic(spark, docs, SMALL).collect()), key=str) == [1, 1, 2, None]
    mixed = [r["doc_id"] for r in P.mix_sources(spark, docs, SMALL).collect()]
    assert mixed.count(1) in (0, 2) and set(mixed) <= {1, 2, None}
    pieces = P.pack_sequences(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] for r in pieces), key=str) == [1, 1, 2, None] and sum(r["length"] for r in pieces) == 16
    for _, stage in P.STAGES:
        stage(spark, docs.limit(0), SMALL).count()


def test_planted_near_copies(spark):
    """Copies with some words changed: linked by five-word Jaccard similarity, most of them far beyond two bits of a fingerprint."""
    import random

    from stemma.llm import simhash

    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(50_000)}"
    texts = []
    for n in (40, 100, 400):
        for changes in (1, 2, 4, 8, 20):
            base = [word() for _ in range(n)]
            copy = list(base)
            for at in rng.sample(range(n), changes):
                copy[at] = word()
            texts += [" ".join(base), " ".join(copy)]
    hub = [word() for _ in range(300)]
    texts += [" ".join([*hub[:at], word(), *hub[at + 1 :]]) for at in range(60)] + ["a b", "a b", "", None, "a b c"]
    sets = [simhash.text_shingles(t, 5) for t in texts]
    alike = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    want = list(range(len(texts)))
    while True:  # each takes the least label among those it is linked to
        new = [min(want[j] for j in range(len(texts)) if alike[i][j]) for i in range(len(texts))]
        if new == want:
            break
        want = new
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, SMALL).collect()} == set(want)
    assert any(want[i] != i and (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[want[i]])).bit_count() > 2 for i in range(len(texts)))


def test_a_group_of_unlike_texts_costs_its_members(spark, monkeypatch):
    """Texts that share a passage but are no near-copies: their number, not their pairs, is compared, and the two that are alike are found."""
    from stemma.llm import simhash
    from stemma.plans.stages import materialise

    tried = []

    def counted(df, tag="stage"):
        out = materialise(df, tag)
        if tag == "similar-candidates":
            tried.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    n, passage = 200, [f"p{i}" for i in range(90)]
    texts = [" ".join([*passage, *(f"w{d}x{i}" for i in range(30))]) for d in range(n)] + [" ".join([*passage, *(f"w7x{i}" for i in range(29)), "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == {d: 7 if d == n else d for d in range(n + 1)}
    assert len(tried) == 2 and tried[1] <= n


def test_a_group_of_near_copies_costs_its_members(spark, monkeypatch):
    """Copies of one text with some words changed, alike to it but mostly not to each other: each is compared with it, and few pairs are left."""
    import random

    from stemma.llm import simhash
    from stemma.plans.stages import materialise

    tried = {}

    def counted(df, tag="stage"):
        out = materialise(df, tag)
        if tag in ("similar-centres", "similar-candidates"):
            tried.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    rng, n = random.Random(11), 240
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for d in range(n):
        copy = list(base)
        for at in rng.sample(range(2, 148), 3):
            copy[at] = f"c{d}x{at}"
        texts.append(" ".join(copy))
    sets = [simhash.text_shingles(t, 5) for t in texts]
    assert all(len(s & sets[0]) >= 0.8 * len(s | sets[0]) for s in sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)
    assert sum(tried.get("similar-centres", [])) <= n and tried["similar-candidates"][1] <= n


def test_joined_labels_are_those_of_all_edges(spark):
    import random

    from stemma.llm import simhash

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    of = lambda e: spark.createDataFrame(e, "a long, b long")
    labels = lambda df: {(r["node"], r["root"]) for r in df.collect()}
    want = labels(simhash.components(of(edges)))
    for cut in (0, 10, 25, 40, 50):
        assert labels(simhash.joined(simhash.components(of(edges[:cut])), of(edges[cut:]))) == want


def test_prefix_pairs_lose_none(spark):
    import random

    from stemma.llm import simhash

    rng = random.Random(5)
    sets = [set(range(rng.randrange(8), 40)) - set(rng.sample(range(40), rng.randrange(9))) | set(rng.sample(range(40, 60), rng.randrange(4))) for _ in range(60)]
    root = [rng.randrange(6) for _ in sets]
    held = spark.createDataFrame([(i, len(s), root[i], h) for i, s in enumerate(sets) for h in s], "grams long, n long, root long, h long")
    got = {(r["a"], r["b"]) for r in simhash.prefix_pairs(held, 0.8).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 20 and want <= got


def test_stages_leave_only_their_results(spark):
    import os

    from stemma.plans.stages import shared_dir

    where = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(where))
    rows = P.run(spark, SMALL).count()
    left = set(os.listdir(where)) - before
    assert rows and len(left) == len(P.STAGES) and all(x.startswith("pipeline-") for x in left)
