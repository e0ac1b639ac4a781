"""Each operator on small tables with every awkward case, against plain Python or SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stemma.llm import ann, exact_dedup, language_id, mixing, packing, registry, simhash, token_counts, toxicity, url_filter, warc

from ..conftest import DATA, SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, group_size string, score string, host string, digest string"
HUGE = "word ændre Straße 12,5% naïve " * 5000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    texts = [None, "", " \t\n", "a b c", "abc", "a  b  c", HUGE, HUGE, HUGE + "!", "the cat sat on the mat and ran", "the cat sat on the mat and ran", "x" * 70_000, "😀 é\u0301 \u2028 tail <s> <|endoftext|>", "Aa\x0bBb\x1fCc", "word"]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 2}", None) for i, t in enumerate(texts)] + [(9, texts[9], "en", "s1", 5), (None, "abc", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).cache()


def collect(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, same_rows, name):
    same_rows(registry.QUERIES[name](spark, SMALL), registry.SQL[name], SMALL)


# ---- 1 ----


def test_exact_dedup(docs):
    squeeze = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    rows = collect(docs.select("doc_id", "text"))
    groups = {}
    for r in rows:
        groups.setdefault(squeeze(r["text"]), []).append(r)
    got = collect(exact_dedup.exact_dedup(docs))
    assert len(got) == len(rows)
    for g in got:
        group = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == g["text_sha256"])
        best = min(group, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        assert g["keep_id"] == best["doc_id"] and g["group_size"] == len(group) and g["kept"] == (g["doc_id"] == g["keep_id"])


def test_exact_dedup_empty(docs):
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


# ---- 2 ----


def brute(rows, queries, k):
    import numpy as np

    out = {}
    for qid, q in queries:
        scored = [(-(float((np.array(q) * np.array(v)).sum()) / (np.sqrt((np.array(q) ** 2).sum()) * np.sqrt((np.array(v) ** 2).sum()))), i) for i, v in rows if i != qid]
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


def test_neighbours_with_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (None, [1.0, 1.0]), (9, []), (0, [1.0, 0.0]), (50, [0.9, 0.1]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = collect(ann.nearest(df, df.where("vec_id % 50 = 0")))
    per = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100)}
    assert per == {0: [1, 2, 50, 3], 50: [0, 1, 2, 3], 100: []}
    assert all(abs(r["score"]) <= 1 + 1e-12 for r in got)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_ties_of_parallel_vectors_and_many_lengths(spark):
    """Forty vectors of one direction, larger ids first, are ties by id; each of twenty lengths is searched among its own."""
    rows = [(60 - i, [float(2**i % 1021) or 1.0, 0.0]) for i in range(40)] + [(0, [2.0, 0.0])]
    rows += [(1000 * n + i, [float((i * 7 + j * j) % 5 + 1) for j in range(n)]) for n in range(3, 23) for i in range(50, 57)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(ann.nearest(df, df.where("vec_id % 50 = 0")))
    per = lambda q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert per(0) == [21, 22, 23, 24, 25]
    for n in range(3, 23):
        mine = [r for r in rows if len(r[1]) == n]
        assert per(1000 * n + 50) == brute(mine, [r for r in mine if r[0] % 50 == 0], 5)[1000 * n + 50]


def test_neighbours_recall_with_hot_copies(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(ann.nearest(df, df.where("vec_id % 50 = 0"), leaf_rows=64))
    want = brute(rows, [rows[i] for i in range(0, 3000, 50)], 5)
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    assert all(found[q] == want[q] for q in want if q % 3 == 0)  # copies: ties by the smaller id


def test_neighbours_recall_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = collect(ann.op2_ann(spark, DATA))
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.97 * 5 * len(want)


# ---- 3 ----


def test_language_by_brute_force(spark):
    import math

    train = [("en", "the cat sat on the mat"), ("en", "this is the other thing"), ("de", "der hund und die katze"), ("de", "ich bin nicht hier"), (None, "zzz"), ("", "yyy")]
    d = spark.createDataFrame(train, "lang string, text string")
    model = language_id.fit_text_model(d)
    assert model.langs == ["de", "en"]
    pages = [(1, "http://a.x.de/1", "<html lang=de><p>der hund</p>"), (2, "http://a.x.de/2", "<html lang='en'>die katze ist nicht hier"), (3, "http://b.y.com/", "<script>der die das</script>the other cat"), (4, None, None), (5, "http://a.x.de/3", ""), (5, "http://a.x.de/3", ""), (6, "nohost", "12 34")]
    p = spark.createDataFrame([(*x, "k") for x in pages], "page_id long, url string, html string, probability string")
    got = collect(language_id.identify(p, model))
    assert len(got) == len(pages)
    # the same fusion in plain Python
    text = model.evidence([language_id.visible_text(x[2]) for x in pages]).tolist()
    own = [[math.exp(v) / sum(map(math.exp, t)) for v in t] for t in text]
    keys = {(r["page_id"]): (r["host"], r["declared"]) for r in got}
    rows = [(x[0], *keys[x[0]], t, o) for x, t, o in zip(pages, text, own, strict=True)]
    dom, suf = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])

    def total(pick):
        return [sum(r[4][j] for r in rows if pick(r)) for j in range(2)]

    for r in rows:
        less = lambda a, r=r: [max(a[j] - r[4][j], 0) for j in range(2)]
        everyone = less(total(lambda _: True))
        base = [(v + 1) / (sum(everyone) + 2) for v in everyone]
        d_, h_ = less(total(lambda q, r=r: dom(q[1]) == dom(r[1]))), less(total(lambda q, r=r: q[1] == r[1]))
        pd = [(d_[j] + 8 * base[j]) / (sum(d_) + 8) for j in range(2)]
        prior = [(h_[j] + 4 * pd[j]) / (sum(h_) + 4) for j in range(2)]

        def like(a, everyone=everyone, less=less):
            a = less(a)
            share = (sum(a) + 1) / (sum(everyone) + 2)
            return [math.log((a[j] + 10 * share) / (everyone[j] + 10)) for j in range(2)]

        s, c = like(total(lambda q, r=r: suf(q[1]) == suf(r[1]))), like(total(lambda q, r=r: q[2] == r[2]))
        logs = [r[3][j] + math.log(prior[j]) + s[j] + c[j] for j in range(2)]
        best = max(range(2), key=lambda j: logs[j])
        want = 1 / sum(math.exp(v - logs[best]) for v in logs)
        g = next(x for x in got if x["page_id"] == r[0])
        assert g["lang"] == model.langs[best] and g["probability"] == pytest.approx(want, abs=1e-5)


def test_language_accuracy_and_empty_tables(spark):
    got = language_id.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", F.regexp_extract("url", r"://[^/]*/(\w\w)/", 1).alias("spoken")), "page_id")
    assert got.where("text_lang = spoken").count() >= 0.97 * got.count() and got.where("lang = spoken").count() >= 0.97 * got.count()
    none = language_id.fit_text_model(spark.createDataFrame([], "lang string, text string"))
    one = spark.createDataFrame([(1, "http://x.de/", "<b>der")], "page_id long, url string, html string")
    assert [r["lang"] for r in language_id.identify(one, none).collect()] == [None]
    assert language_id.identify(one.limit(0), none).count() == 0


def test_text_likelihood_by_brute_force(spark):
    """Letter trigrams counted in plain Python."""
    import math

    train = [("en", "The cat sat on the mat"), ("de", "Der Hund, und die Katze"), ("de", "ich bin's nicht")]
    model = language_id.fit_text_model(spark.createDataFrame(train, "lang string, text string"))

    def grams(text):
        t = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()} ")
        return [t[i - 1 : i + 2] for i in range(1, len(t) - 1) if t[i] != "\0"]

    counts = {x: [g for lang, t in train if lang == x for g in grams(t)] for x in ("de", "en")}
    tests = ["die Katze", "the other cat", "12", "nicht mat " * 300]
    for text, got in zip(tests, model.evidence(tests).tolist(), strict=True):
        g = grams(text)
        logs = [sum(math.log((counts[x].count(y) + 0.5) / (len(counts[x]) + 0.5 * language_id.BUCKETS)) for y in g) / max(len(g), 1) * min(len(g), language_id.LETTERS) / language_id.OVERLAP for x in ("de", "en")]
        assert got == pytest.approx([x - max(logs) for x in logs], rel=1e-4, abs=1e-4)


def test_visible_text_is_linear():
    import re
    import time

    old = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^<>]*>", re.S | re.I)
    for html in ("a<!-- b > c", "<!-->x-->y", "<script>a</SCRIPT >b<style c<style>d</style>e", "<p<b>x</p", "<!-- a --><script x", "a<b", "<scripted>q</script>", ""):
        assert language_id.visible_text(html) == old.sub(" ", html)
    began = time.time()
    for opener in ("<script>", "<!--", "<style ", "<", "<script></style>", "&a"):
        language_id.visible_text(opener * (5_000_000 // len(opener)))
    assert time.time() - began < 60


def test_rare_language_is_known(spark):
    """Danish has 0.2 % of the labelled letters."""
    train = [("en", "the cat sat on the mat and this is the other thing " * 400), ("da", "rødgrød med fløde på øen ")]
    model = language_id.fit_text_model(spark.createDataFrame(train, "lang string, text string"))
    assert model.langs == ["da", "en"]
    pages = spark.createDataFrame([(1, "http://a.dk/", "<p>rødgrød på øen"), (2, "http://b.com/", "<p>the other cat")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text_lang"] for r in language_id.identify(pages, model).collect()} == {1: "da", 2: "en"}


# ---- 4 ----


def check_packing(df, texts, size, max_padding=None):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary_path())
    want = {}
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append(ids)
    pieces = collect(df)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for i, docs_ in want.items():
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) == sum(map(len, docs_))
        for p in mine:
            parts = [d[p["start"] : p["start"] + p["length"]] for d in docs_ if len(d) == p["doc_tokens"]]
            assert any(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in d)) == p["ids_crc32"] for d in parts)
        if len(docs_) == 1:
            at = 0
            for p in mine:
                assert p["start"] == at
                at += p["length"]
    used = [sum(n for _, n in parts) for parts in seqs.values()]
    padding = sum(0 if n & (n - 1) == 0 else size - n for n in used)
    if max_padding is not None:
        assert padding <= max_padding * sum(used)
    return pieces


def test_packing(docs):
    rows = docs.select("doc_id", "text")
    check_packing(packing.pack(docs, size=64), [(r["doc_id"], r["text"]) for r in rows.collect()], 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_column_generation_reaches_known_optima():
    """From one column per length, 34 sequences; 7 + 3 and 6 + 4 need 24. And where nothing fits together pricing proves that no plan is better than the trivial one."""
    lengths, counts = [3, 4, 6, 7], [12] * 4
    trivial = [{i: 10 // n} for i, n in enumerate(lengths)]
    assert sum(c / (10 // n) for n, c in zip(lengths, counts, strict=True)) == 34
    patterns, uses, bound = packing.solve(lengths, counts, 10, start=trivial)
    assert sum(uses) == pytest.approx(24) and bound == pytest.approx(24)
    assert all(sum(lengths[i] * c for i, c in p.items()) <= 10 for p in patterns)
    for i, c in enumerate(counts):
        assert sum(x * p.get(i, 0) for p, x in zip(patterns, uses, strict=True)) == pytest.approx(c)
    patterns, uses, bound = packing.solve([6, 7], [5, 5], 10)
    assert sum(uses) == pytest.approx(10) and bound == pytest.approx(10)


def test_pricing_lowers_the_longest_first_plan():
    """Longest first needs 65 sequences; the optimum is 62.5, and the bound that pricing proves is the same."""
    lengths, counts, size = [10, 17, 24, 48], [40, 30, 30, 40], 63
    assert sum(packing.first_patterns(lengths, counts, size)[1]) == pytest.approx(65)
    _, uses, bound = packing.solve(lengths, counts, size)
    assert sum(uses) == pytest.approx(62.5) and bound == pytest.approx(62.5)
    ranges, _, _ = packing.plan(dict(zip(lengths, counts, strict=True)), size)
    assert sum(past - first for _, first, past, *_ in ranges) == sum(counts)


def test_packing_of_one_length_and_of_another_vocabulary(spark):
    """A hot length that leaves padding is cut; a vocabulary that the memory of words doesn't know goes to its library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(i, "the cat sat on the mat and ran off") for i in range(50)], "doc_id long, text string")
    check_packing(packing.pack(docs, size=16), [(i, "the cat sat on the mat and ran off") for i in range(50)], 16, 0.01)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, lib = packing.Tokenizer(path), Tokenizer.from_file(path)
    own, words = packing.Tokenizer(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    assert own.known and not coder.known
    for t in ("The Cat, sat.  On\n\nthe mat!", "", "Straße <|endoftext|> 12.5%", "it's we've 'round"):
        assert coder.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own.ids(t).tolist() == words.encode(t, add_special_tokens=False).ids


def test_what_a_worker_remembers_is_bounded():
    """Half a million different words, in one long text and in many short ones: the ids stay the library's, the memory within 64 MB and what one look-up adds, and a word of every text is encoded once."""
    coder = packing.Tokenizer(packing.vocabulary_path())
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "qzqzqzqzqzqzqzqz"
    most, learned, learn = 0, [], coder._learn
    coder._learn = lambda new: (learned.append((len(new), "the" in new)), learn(new))
    held = lambda: sum(packing._ENTRY + len(k) + len(v) for x in vars(coder).values() if isinstance(x, dict) for k, v in x.items())
    texts = ["the " + " ".join(map(word, range(100_000)))] + ["the " + " ".join(map(word, range(i, i + 20_000))) for i in range(100_000, 450_000, 20_000)]
    for t in texts:
        ids = coder.ids(t)
        most = max(most, held())
    assert ids.tolist() == coder.library.encode(t, add_special_tokens=False).ids
    assert coder.ids(texts[0]).tolist() == coder.library.encode(texts[0], add_special_tokens=False).ids
    assert most < 84 << 20
    assert max(n for n, _ in learned) <= 1 << 16
    assert sum(the for _, the in learned) == 1


def test_packing_on_the_table(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_packing(packing.op4_packing(spark, SMALL), [(r["doc_id"], r["text"]) for r in d.collect()], 2048, 0.01)


# ---- 5 ----


def test_token_counts(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(lib.encode(r["text"] or ""))) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None}
    for chunk, overlap in ((32_768, 256), (500, 8)):
        got = collect(token_counts.token_counts(docs, chunk=chunk, overlap=overlap))
        assert len(got) == docs.count()
        for g in got:
            if g["doc_id"] is not None:
                assert (g["n_bytes"], g["n_tokens"]) == want[g["doc_id"]] and g["over_limit"] == (g["n_tokens"] > 4096)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_token_counts_of_a_huge_document(spark):
    """Cut in one pass: chunks, offsets and overlaps, and the same count as the library's."""
    import sentencepiece

    text = ("naïve Straße 12,5% 😀  und\n" * 40_000)[:1_000_003]
    df = spark.createDataFrame([(1, text), (2, text)], "digest string, text string")
    rows = sorted(token_counts._cut(df.where("digest = 1"), 32_768, 256).collect(), key=lambda r: r["chunk"])
    assert len(rows) == rows[0]["chunks"] == 31 and rows[-1]["own_to"] == len(text.encode())
    for a, b in zip(rows, rows[1:], strict=False):
        assert a["own_to"] == b["own_from"] and text.encode()[b["base"] :].startswith(b["part"].encode())
    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())
    got = token_counts.token_counts(df, id_col="digest").collect()
    assert [r["n_tokens"] for r in got] == [len(lib.encode(text))] * 2


def test_token_counts_on_the_table(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: len(lib.encode(r["text"] or "")) for r in d.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d, chunk=700, overlap=16).collect()} == want


# ---- 6 ----


def test_warc_round_trip(spark, tmp_path):
    big, small = "é<p>" * 60, "tiny"
    rows = [(3, "http://a/\r\nX: y", big), (1, "http://b", big), (2, None, big), (4, "http://c", small), (5, "http://d", small), (6, "http://e", None), (None, "http://f", big), (1, "http://b", big)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    archive = warc.write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == 3
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.parse_records(warc.read_archive(spark, archive)).collect()), key=str)
    n = len(big.encode())
    assert got == sorted([(3, "revisit", 1, n), (1, "response", None, n), (2, "revisit", 1, n), (4, "response", None, 4), (5, "response", None, 4), (6, "response", None, 0), (None, "revisit", 1, n), (1, "response", None, n)], key=str)
    path = warc.export_warc(spark, archive, str(tmp_path / "w"))
    back = warc.import_warc(spark, path)
    assert sorted(bytes(r["payload"]).decode() for r in back.collect()) == sorted(x[2] or "" for x in rows)
    empty = warc.write_archive(pages.limit(0))
    assert warc.parse_records(warc.read_archive(spark, empty)).count() == 0


# ---- 7 ----


def brute_rake(cells, goals, budget, rounds=3000):
    """Scaling in plain Python: for each value the factor, found by bisection, at which its cells, none above its tokens, reach the goal."""
    raw = {c: budget * n for c, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            for value, goal in goals[d].items():
                mine = [c for c in cells if c[d] == value]
                low, high = 0.0, 1e6
                for _ in range(100):
                    mid = (low + high) / 2
                    if sum(min(cells[c], raw[c] * mid) for c in mine) < goal:
                        low = mid
                    else:
                        high = mid
                for c in mine:
                    raw[c] *= low
    return {c: min(raw[c], n) for c, n in cells.items()}


def test_mixing(docs, spark):
    got = collect(mixing.mix(docs))
    assert len(got) == docs.count() and all(0 <= r["probability"] <= 1 for r in got)
    one = {r["doc_id"]: r for r in got}
    assert one[0]["tokens"] == one[1]["tokens"] == 1 and one[0]["topic"] == "other" and one[6]["tokens"] == 25_000
    assert one[3]["lang"] == "" and one[4]["source"] == "" and len({(r["probability"], r["kept"]) for r in got if r["doc_id"] == 9}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_raking_with_full_cells(spark):
    """A cell that would keep more tokens than it has keeps all of them, and the others make up for it."""
    cells = {("a", "x", "t"): 100, ("a", "y", "t"): 300, ("b", "x", "t"): 500, ("b", "y", "u"): 100, ("b", "x", "u"): 50, ("a", "x", "u"): 20}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    goals = [{"a": 101.0, "b": 502.5}, {"x": 548.5, "y": 55.0}, {"t": 510.0, "u": 93.5}]
    budget = 603.5 / sum(cells.values())
    targets = dict(zip(mixing.DIMENSIONS, goals, strict=True))  # shares may be of any sum
    want = brute_rake(cells, goals, budget, 300)
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(df, targets, budget=budget).collect()}
    assert any(got[c] == n for c, n in cells.items())  # a cell is full
    for c in cells:
        assert got[c] == pytest.approx(want[c], abs=1e-5)
    for d in range(3):
        for v, goal in goals[d].items():
            assert sum(w for c, w in got.items() if c[d] == v) == pytest.approx(goal, abs=1e-6)


def test_mixing_with_a_hot_source_and_unreachable_targets(spark):
    """A rare source that is lifted beyond what it has keeps all of it, and the budget still holds."""
    docs = spark.createDataFrame([(i, "w " * 10, "rare" if i < 10 else "hot", "en") for i in range(400)], "doc_id long, text string, source string, lang string")
    got = collect(mixing.mix(docs, {"source": {"rare": 0.5, "hot": 0.5}}, budget=0.5))
    assert all(r["probability"] == 1 for r in got if r["source"] == "rare")
    assert sum(r["probability"] * r["tokens"] for r in got) == pytest.approx(0.5 * 4000, abs=0.1)
    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="no weights meet all targets"):
        mixing.rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.3, "y": 0.7}}, budget=0.5, sweeps=5)



# ---- 8 ----


def test_toxicity_held_out(spark):
    """On rows whose labels were never learned from. The smaller tables hold too few toxic documents to measure by."""
    sf_dir = "/root/testdata/sf0.1"
    got = toxicity.op8_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    yes, no = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    ahead = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert ahead >= 0.93 and sum(r["predicted"] == r["toxic"] for r in got) >= 0.92 * len(got)


def brute_toxicity(rows, labels):
    """The models in plain Python: P(symbol | three before it) of both classes, and the peak of each text."""
    import math
    from collections import defaultdict

    def grams(text):
        words = ["".join(c for c in w if c.isalpha()) for w in (text or "").lower().split()]
        s = "\0\0 " + "".join(w + " " for w in words if w)
        return [(s[i - 3 : i], s[i]) for i in range(3, len(s))]

    part = lambda i: zlib.crc32(str(i).encode()) % 5
    counts = {0: defaultdict(int), 1: defaultdict(int)}
    every = set()
    for i, text in rows:
        every |= set(grams(text))
        if part(i) >= 2 and i in labels:
            for g in grams(text):
                counts[labels[i]][g] += 1

    def discount(values):
        once, twice = list(values).count(1), list(values).count(2)
        return once / (once + 2 * twice) if once and twice else 0.5

    levels, longer = [], every
    for n in (2, 1, 0):
        shorter = defaultdict(set)
        for c, s in longer:
            shorter[(c[len(c) - n :], s)].add(c[0])
        levels.append({k: len(v) for k, v in shorter.items()})
        longer = set(shorter)
    size = len(levels[2])

    def high_and_rest(table, context, symbol, d):
        own = [n for (c, _), n in table.items() if c == context]
        if not own:
            return 0.0, 1.0
        return max(table.get((context, symbol), 0) - d if (context, symbol) in table else 0, 0) / sum(own), d * len(own) / sum(own)

    ds, dc = [discount(t.values()) for t in levels], [discount(counts[y].values()) for y in (0, 1)]

    def ratio(context, symbol):
        p = 1 / (size + 1)
        for n in (0, 1, 2):
            high, rest = high_and_rest(levels[2 - n], context[3 - n :], symbol, ds[2 - n])
            p = high + rest * p
        logs = []
        for y in (0, 1):
            high, rest = high_and_rest(counts[y], context, symbol, dc[y])
            logs.append(math.log(high + rest * p))
        return logs[1] - logs[0]

    out = {}
    for i, text in rows:
        r = [ratio(*g) for g in grams(text)]
        k = min(toxicity.WINDOW, len(r))
        out[i] = max((sum(r[j : j + k]) for j in range(len(r) - k + 1)), default=0.0) / toxicity.WINDOW if r else 0.0
    return out, dc


def test_toxicity_by_brute_force(spark):
    """Discounts between 0 and 1 from counts of counts, exact continuation counts, and the same ratios to 1e-9."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    plain, bad = ["lore", "ipsum", "dolor", "Sit", "amet", "naïve", "a1b2", "x"], ["grubby", "sludge"]
    rows, labels = [], {}
    for i in range(60):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(bad if toxic and rng.random() < 0.3 else plain) + rng.choice(["", ",", ".\n"]) for _ in range(rng.choice([1, 3, 40])))))
        if i % 7:
            labels[i] = int(toxic)
    rows += [(100, None), (101, ""), (102, "12 34"), (103, "grubbygrubby sludge")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    want, discounts = brute_toxicity(rows, labels)
    assert all(0 < d < 1 for d in discounts)
    memory = toxicity._Memory()
    for _ in range(2):  # also from memory
        got = model.features(pa.array([t for _, t in rows]), memory)
        assert got.tolist() == pytest.approx([want[i] for i, _ in rows], abs=1e-9)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rising = [scores[i] for i in sorted(scores, key=lambda i: want[i])]
    assert all(b >= a - 1e-9 for a, b in zip(rising, rising[1:], strict=False))
    # A smaller model is one of fewer labelled rows, never a failure.
    assert len(toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), rows=50).keys) < len(model.keys)


def test_toxicity_of_very_long_words(spark):
    docs = spark.createDataFrame([(1, "é" * 3_000_000), (2, "a " * 1_000_000), (3, "ab")], "doc_id long, text string")
    assert toxicity.toxicity(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")).count() == 3


def test_toxicity_awkward_rows(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(None, 1), (3, None), (7, 0), (7, 1)], "doc_id long, toxic int")
    got = collect(toxicity.toxicity(docs, labels))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in collect(toxicity.toxicity(docs, labels.limit(0)))} == {0}


# ---- 9 ----


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if (d is not None or find(i) in least) else None
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("heavy", [20_000, 5])
def test_simhash(docs, spark, heavy):
    more = spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    df = docs.select("doc_id", "text").where("doc_id is not null").unionByName(more)
    rows = df.collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    want = sorted((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, heavy=heavy).collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs).count() == docs.count()


# ---- 10 ----


def test_url_filters(spark):
    urls = [None, "", "nohost", "http://COM/en/x", "http://a.example.com/en/7/z", "http://xcom/en/", "https://example.net/de/88", "ftp://b.net/de/1", "http://c.org/es/?q", "http://c.org/es#", "http://org/fr/", "http://u@d.com:80/en/", "x://y://com/en/"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[3] == got[len(urls)] == ("com/en/", "block") and got[4] == ("example.com/en/7", "allow") and got[5] == (None, "allow")
    assert got[6] == ("example.net/de/8", "block") and got[7] == ("net/de/", "allow") and got[8][1] == "block" and got[9][1] == "allow" and got[0] == (None, "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0 and url_filter.filter_urls(df, rules=[]).where("verdict = 'block'").count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("hash(key) % 10 = 0")
    cascade = url_filter.build_cascade(listed, universe, bits_per_key=3)
    assert len(cascade.levels) > 2
    got = universe.where(cascade.contains(F.col("key")))
    assert got.exceptAll(listed).count() == 0 and listed.exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        url_filter.build_cascade(listed, universe, max_words=1)


def test_long_texts_by_pieces_are_as_whole_ones(monkeypatch):
    """The same symbols, and the same peak, for pieces of any size."""
    import random

    import numpy as np
    import pyarrow as pa

    class Plain(toxicity.Model):
        def __init__(self):
            pass

        def ratios(self, context, symbol, memory):
            return (context % 1009 + symbol % 13) / 1000 - 0.5

    rng = random.Random(1)
    texts = ["".join(rng.choice("abc  ,9é\n") for _ in range(n)) for n in (0, 5, 100, 2999, 3000, 3001, 9000)] + ["1" * 5000 + "ab", "9" * 5000]
    symbols, peaks = toxicity.symbols(texts), Plain().features(pa.array(texts), None)
    monkeypatch.setattr(toxicity, "_PIECE", 1000)
    monkeypatch.setattr(toxicity, "_SLICE", 1)
    assert (toxicity.symbols(texts) == symbols).all() and np.allclose(Plain().features(pa.array(texts), None), peaks)
