import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import evidence, family, feed, linkage, media, visibility
from stemma.plans.stages import closure, components
from stemma.sources import dump, files
from stemma.streaming import changes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_and_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7)], "a long, b long")
    assert rows(components(e, "a", "b")) == [(1, 1), (10, 10), (11, 10), (2, 1), (3, 1), (4, 1)]
    assert (1, 4, 3) in rows(closure(e, "a", "b"))
    assert components(e.limit(0), "a", "b").count() == 0 and closure(e.limit(0), "a", "b").count() == 0
    with pytest.raises(ValueError):
        closure(spark.range(20).select("id", (F.col("id") + 1).alias("up")), "id", "up", max_depth=5)


def test_lineage_cycle_fails(spark):
    bad = spark.createDataFrame([(1, 2, None), (2, 1, "x")], "id long, parent_id long, surname string")
    with pytest.raises(Exception, match="cycle"):
        family.lineage_paths(bad)


def test_double_cousins_and_half_siblings(spark):
    # 1+2 -> 5, 6; 3+4 -> 7, 8; 5+7 -> 9; 6+8 -> 10; 9's half brother 11 by 5 and 12
    pc = [(5, 1), (5, 2), (6, 1), (6, 2), (7, 3), (7, 4), (8, 3), (8, 4), (9, 5), (9, 7), (10, 6), (10, 8), (11, 5), (11, 12)]
    edges = spark.createDataFrame([(*x, None) for x in pc], "child long, parent long, confidence string")
    person = spark.createDataFrame([(i, "mand") for i in range(1, 13)], "id long, sex string")
    pairs = spark.createDataFrame([(9, 10), (9, 11), (1, 3), (5, 5)], "a long, b long")
    got = {(r["a"], r["b"]): r for r in family.relationships(pairs, edges, person).collect()}
    assert got[9, 10]["label"] == "1. grads fætre" and got[9, 10]["n_lines"] == 2
    assert got[9, 11]["label"] == "Halvbrødre" and got[9, 11]["half"]
    assert (1, 3) not in got and got[5, 5]["label"] == "Samme person"


def test_same_as_groups(spark):
    known = spark.range(1, 10)
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 99), (5, 6), (5, 7), (8, 8)], "alias long, canonical long")
    got = {(r["member"]): (r["canonical"], r["reason"]) for r in family.same_as_groups(e, known).collect()}
    assert got[1] == (3, None) and got[4] == (None, "ukendt medlem") and got[6] == (None, "ikke én kanonisk") and 8 not in got


def test_validation_goes_on_to_a_fixpoint(spark):
    # Group A (1, 2) is rejected for its sexes; then group B's parents 1 and 2 differ, which they would not if A stood.
    groups = spark.createDataFrame([(1, 1, 2, None), (1, 2, 2, None), (3, 3, 4, None), (3, 4, 4, None)], "component long, member long, canonical long, reason string")
    person = spark.createDataFrame([(1, "mand", 1700, None), (2, "kvinde", 1700, None), (3, None, 1730, None), (4, None, 1731, None)], "id long, sex string, born int, died int")
    edges = spark.createDataFrame([(3, 1), (4, 2)], "child long, parent long")
    assert rows(family.validate_groups(groups, person, edges)) == [(1, "køn"), (3, "forældre")]
    ok = person.withColumn("sex", F.lit("mand"))
    assert rows(family.validate_groups(groups, ok, edges)) == [(1, None), (3, None)]


def test_tiers_are_one_to_one(spark):
    flags = (True, True, True, True, True, True, True)
    got = spark.createDataFrame([(1, 10, 1.0, *flags), (2, 10, 0.95, *flags), (3, 11, 0.99, *flags), (3, 12, 0.98, *flags), (4, 13, 0.6, *flags)], "a_id long, b_id long, name_sim double, birth_eq boolean, death_eq boolean, sex_eq boolean, birth_known boolean, death_known boolean, sex_known boolean, unique_block boolean")
    tiers = {(r["a_id"], r["b_id"]): r["tier"] for r in linkage.assign_tiers(got).collect()}
    assert tiers == {(1, 10): "auto", (2, 10): "none", (3, 11): "review", (3, 12): "review", (4, 13): "review"}


def test_conflicts_ignore_nulls_and_equal_values(spark):
    fact = spark.createDataFrame([(1, "person", 5, "name"), (2, "person", 5, "name"), (3, "person", 6, "birth")], "id long, subject_type string, subject_id long, kind string")
    claim = spark.createDataFrame([(1, "fact", 1, "a"), (2, "fact", 1, "b"), (3, "fact", 2, "a"), (4, "fact", 2, None), (5, "fact", 2, "a"), (6, "fact", 3, "x"), (7, "fact", 3, "y")], "id long, target_type string, target_id long, value string")
    assert rows(evidence.conflicts(fact, claim, ["name"])) == [(1, 5, "name", 2)]


def test_unknown_life_hides(spark):
    p = spark.createDataFrame([(1, False, None, None), (2, None, False, False), (3, True, False, False), (4, False, True, False)], "id long, living boolean, private boolean, staged boolean")
    assert [r["id"] for r in visibility.visible_persons(p).collect()] == [1]
    living = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(Exception, match="living person"):
        visibility.assert_no_living(spark.createDataFrame([("see 3",)], "text string"), living).collect()
    assert visibility.assert_no_living(spark.createDataFrame([("see 33",), (None,), ("none",)], "text string"), living).count() == 3


def test_undo_and_state(spark):
    c = spark.createDataFrame([(1, 7, 1, "insert", 1.0, 1), (2, 7, 2, "update", 2.0, 2), (3, 7, 3, "update", 3.0, 3), (4, 8, 1, "insert", 5.0, 2), (5, 8, 2, "delete", None, 4)], "id long, row_id long, made int, op string, after_value double, set_id long")
    assert rows(media.current_state(c)) == [(7, 3.0)]
    assert rows(media.undo(c, spark.createDataFrame([(3,), (2,), (4,)], "set_id long"))) == [(2, 7, "konflikt", 1.0), (2, 8, "konflikt", None), (3, 7, "fortrudt", 2.0), (4, 8, "fortrudt", 5.0)]
    with pytest.raises(Exception, match="itself"):
        media.ordered_pairs(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").collect()


def test_walk_keeps_kinds_and_persons_apart():
    cards = [{"card": f"c{i}", "kind": "xy"[i // 5 % 2], "person_id": i % 7} for i in range(20)]
    order = feed.walk(cards)
    assert sorted(order) == sorted(c["card"] for c in cards)
    kinds = {c["card"]: c["kind"] for c in cards}
    assert all(kinds[a] != kinds[b] for a, b in zip(order[:10], order[1:10], strict=False))


def test_dump(spark, tmp_path):
    f = tmp_path / "d.sql"
    f.write_text("-- dump\nCREATE TABLE `p` (\n  `id` int,\n  `name` varchar(10),\n  `born` date\n) ENGINE=x;\nINSERT INTO `p` VALUES (1,'O\\'Neil; (x)','0000-00-00'),\n(2,NULL,'1700-01-01');\nINSERT INTO `p` (`id`, `name`) VALUES (3,'a\\\\b''c');\nINSERT INTO `q` VALUES (9,'z');\n")
    assert rows(dump.load_table(spark, str(f), "p")) == [("1", "O'Neil; (x)", "0000-00-00"), ("2", None, "1700-01-01"), ("3", "a\\b'c", None)]
    with pytest.raises(ValueError):
        dump.columns(spark, str(f), "nope")


def test_records_and_reports(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"linje": "I", "nr": 1, "extra": 3, "facts": [{"faktatype": "død", "date_raw": "ca. 1500"}, {"faktatype": "navn", "vaerdi": "N"}]}, indent=1))
    facts = files.record_facts(files.read_records(spark, str(tmp_path / "r")))
    assert [(r["linje"], r["nr"], r["ordinal"], r["faktatype"], r["date_raw"]) for r in facts.orderBy("ordinal").collect()] == [("I", 1, 0, "død", "ca. 1500"), ("I", 1, 1, "navn", None)]
    pairs = spark.createDataFrame([(1, 2, 0.5, 0.6, "none")], "a_id long, b_id long, name_sim double, score double, tier string")
    back = files.read_csv(spark, files.write_pairs(pairs, str(tmp_path / "p")), "a_id long, b_id long, name_sim double, score double, tier string")
    assert rows(back) == rows(pairs)
    assert files.report(pairs.withColumn("line", F.lit("x")), "tier", "line", "T") == "# T\n\n- none: 1\n\n## none\n\n- x\n"
    assert rows(files.row_counts({"a": pairs, "b": pairs.limit(0)})) == [("a", 1), ("b", 0)]


def test_change_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "row_id long, v string").write.parquet(log)
    keys = changes.changed_keys(spark, log, "row_id long, v string")
    changes.keep_current(keys, lambda k: k.withColumn("n", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r["row_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_similar_keys_lose_no_pair(spark):
    """Against every pair in plain Python."""
    import random

    rng = random.Random(5)
    keys = ["".join(rng.choice("abcdeå") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    keys += [k[:2] + k[3:] for k in keys if len(k) > 5] + [k[:1] + k[2:3] + k[1:2] + k[3:] for k in keys if len(k) > 5]
    a, b = (spark.createDataFrame([(k,) for k in part], "key string") for part in (keys[::2], keys[1::2]))
    want = {(x, y) for x in keys[::2] for y in keys[1::2] if linkage.jaro_winkler(x, y, 0.0) >= 0.92}
    got = [(r["a"], r["b"]) for r in linkage.fuzzy_keys(a, b, 0.92).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_by_classes_keep_the_first_ids(spark):
    """Equal records are one class: the top ten and whether a candidate is the only one are those of the records."""
    import random

    rng = random.Random(7)
    rows = lambda n: [(i, rng.choice(["anna", "anne", "bodil"]), *[rng.choice([None, 1700])] * 2, None, None, rng.choice(["m", "ukendt"])) for i in rng.sample(range(900), n)]
    schema = "id long, name_key string, birth_min int, birth_max int, death_min int, death_max int, sex string"
    left, right = rows(40), rows(300) + [(5000, "carl", 1700, 1700, None, None, "m")]
    left.append((5001, "carl", 1700, 1700, None, None, "m"))
    cfg = linkage.Config(top=3)
    got = {(r["a_id"], r["b_id"], r["unique_block"]) for r in linkage.candidates(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), cfg).collect()}

    def points(x, y):
        born = x[2] is not None and y[2] is not None
        sex = x[6] == y[6] != "ukendt"
        return round(cfg.name * linkage.jaro_winkler(x[1], y[1]) + cfg.birth * born + cfg.sex * sex, 9)

    want = set()
    for x in left:
        all_ = [y for y in right if y[1][0] == x[1][0] and linkage.jaro_winkler(x[1], y[1]) >= cfg.name_floor]
        want |= {(x[0], y[0], len(all_) == 1) for y in sorted(all_, key=lambda y: (-points(x, y), y[0]))[:3]}
    assert got == want and (5001, 5000, True) in got


def test_candidates_by_bands_lose_no_pair(spark):
    import random

    rng = random.Random(6)

    def side(n):
        out = []
        for i in range(n):
            lo = rng.choice([None, rng.randint(1600, 1900)])
            hi = rng.choice([None, (lo or 1700) + rng.randint(0, 40)])
            out.append((i, rng.choice(["anna", "anne", "bo", ""]), lo, hi, None, None, "m"))
        return out

    schema = "id long, name_key string, birth_min int, birth_max int, death_min int, death_max int, sex string"
    left, right = side(60), side(60)
    cfg = linkage.Config(top=1000)
    got = [(r["a_id"], r["b_id"]) for r in linkage.candidates(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), cfg).collect()]
    near = lambda a, b: (a[2] is None or b[3] is None or a[2] - 5 <= b[3]) and (b[2] is None or a[3] is None or b[2] <= a[3] + 5)
    want = {(a[0], b[0]) for a in left for b in right if a[1] and b[1] and a[1][0] == b[1][0] and near(a, b) and linkage.jaro_winkler(a[1], b[1]) >= cfg.name_floor}
    assert len(got) == len(set(got)) and set(got) == want


def test_duplicates_link_rows_that_agree_with_each_other_only(spark):
    rows = spark.createDataFrame([(1, 1700, "x"), (2, 1800, "x"), (3, 1800, "x"), (4, None, "x"), (5, None, "x"), (6, None, "y")], "id long, year int, key string")
    got = {(r["a"], r["b"]) for r in linkage.duplicates(rows, {"key": ["key"]}).collect()}
    assert got == {(2, 3), (4, 5), (1, 4), (2, 4)}


def test_ranked_over_ranges(spark):
    from stemma.plans.stages import ranked

    df = spark.range(1000).selectExpr("id", "case when id < 900 then 'hot' end as k")
    got = {r["id"]: r["place"] for r in ranked(df, ["k"], [F.desc("id")]).collect()}
    assert all(got[i] == 900 - i for i in range(900)) and all(got[i] == 1000 - i for i in range(900, 1000))


def test_hash_over_utf16_units(spark):
    from stemma.functions.text import fnv1a

    def want(t):
        h, data = 2166136261, t.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2])) * 16777619) % 2**32
        return h

    texts = ["", "a", "Øre", "😀 x", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == {t: want(t) for t in texts}


def test_walk_with_slots_and_portraits():
    card = lambda i, kind, person=None: {"card": f"c{i}", "kind": kind, "person_id": person}
    cards = [card(i, "gods") for i in range(4)] + [card(10 + i, "embede") for i in range(4)] + [card(20 + i, "portrait", i) for i in range(3)]
    day, kin = card(90, "dagensperson", 1), card(91, "slaegt")
    order = feed.walk(cards, [card(80, "historie")], [(2, day), (5, kin)])
    assert order[0] == "c80" and order[2] == "c90" and order[5] == "c91" and sorted(order) == sorted([c["card"] for c in cards] + ["c80", "c90", "c91"])
    assert order[1] in ("c20", "c22")  # a portrait is due, but not of the person of the day
    assert feed.walk([], [], [(3, kin)]) == ["c91"]


def test_cascade_and_preview(spark):
    known = spark.range(1, 20).selectExpr("id")
    person = known.selectExpr("id", "cast(null as string) sex", "cast(if(id = 3, 1700, if(id = 4, 1850, null)) as int) born", "cast(null as int) died")
    parents = spark.createDataFrame([(1, 3), (2, 4)], "child long, parent long")
    edges = spark.createDataFrame([(2, 1), (4, 3)], "alias long, canonical long")
    groups = family.same_as_groups(edges, known)
    verdict = family.validate_groups(groups, person, parents)
    got = {r["component"]: (r["reason"], r["cascade"]) for r in family.quarantine_cascade(groups, verdict, parents).collect()}
    assert got == {3: ("fødselsår", False), 1: ("forældre", True)}
    rows = {r["member"]: (r["canonical"], r["reason"]) for r in family.preview_same_as(edges, known, person, parents, 7, 8).collect()}
    assert rows == {7: (8, None), 8: (8, None)}
    assert {r["reason"] for r in family.preview_same_as(edges, known, person, parents, 7, 99).collect()} == {"ukendt medlem"}


def test_json_extract_and_object_list(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None)], "id long, year int, name string")
    files.write_json(df, f"{tmp_path}/out", ["id"], {"year": 0})
    assert sorted((r["id"], r["year"], r["name"]) for r in spark.read.schema("id string, year int, name string").json(f"{tmp_path}/out").collect()) == [("1", 0, "x"), ("2", 5, None)]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "c.bin").write_bytes(b"12345")
    (tmp_path / "a" / "d.bin").write_bytes(b"1")
    assert sorted((r["path"].rsplit("/a/", 1)[1], r["bytes"]) for r in files.list_objects(spark, f"{tmp_path}/a").collect()) == [("b/c.bin", 5), ("d.bin", 1)]


def test_jaro_winkler_by_the_definition():
    """Against letters marked one by one."""
    import random

    def plain(a, b, p):
        if a == b:
            return 1.0 if a else 0.0
        reach, free, pairs = max(0, max(len(a), len(b)) // 2 - 1), [True] * len(b), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] and b[j] == c:
                    free[j] = False
                    pairs.append((i, j))
                    break
        if not pairs:
            return 0.0
        m, js = len(pairs), sorted(j for _, j in pairs)
        t = sum(a[i] != b[j] for (i, _), j in zip(pairs, js, strict=True)) / 2
        s = (m / len(a) + m / len(b) + (m - t) / m) / 3
        n = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
        return s + n * p * (1 - s)

    rng = random.Random(2)
    for _ in range(5000):
        a, b = ("".join(rng.choice("abcæ ") for _ in range(rng.choice([0, 1, 2, 5, 12, 70]))) for _ in range(2))
        for p in (0.0, 0.1):
            assert linkage.jaro_winkler(a, b, p) == plain(a, b, p)
    assert linkage.jaro_winkler("abcdef", "bcadef", 0.0) == pytest.approx(0.9167, abs=1e-4)


def test_cycles_agree_with_reachability(spark):
    import random

    from stemma.plans.stages import cycles

    rng = random.Random(5)
    arcs, base = [], 0
    for _ in range(25):
        n = rng.randrange(2, 9)
        arcs += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]
        base += n
    far = set(arcs)
    while True:
        more = far | {(a, d) for a, b in far for c, d in arcs if b == c}
        if more == far:
            break
        far = more
    want = {(x, min(y for y in range(base) if (x, y) in far and (y, x) in far)) for x in range(base) if (x, x) in far}
    df = spark.createDataFrame([*arcs, (None, 1), (1, None)], "a long, b long")
    assert {tuple(r) for r in cycles(df, "a", "b").collect()} == want
    assert cycles(df.where("false"), "a", "b").count() == 0


def test_groups_on_a_cycle_of_parents_and_self_spouses_are_rejected(spark):
    groups = spark.createDataFrame([(1, 1, 2, None), (1, 2, 2, None), (3, 3, 4, None), (3, 4, 4, None), (5, 5, 5, None), (5, 6, 5, None), (7, 7, 7, None), (7, 8, 7, None)], "component long, member long, canonical long, reason string")
    person = spark.range(1, 12).selectExpr("id", "cast(null as string) sex", "cast(null as int) born", "cast(null as int) died")
    # 1 -> 3 and 4 -> 9 -> 2 close a ring over two groups and a person; 5 hangs below it, innocent; 7 and 8 are a couple.
    edges = spark.createDataFrame([(1, 3), (4, 9), (9, 2), (5, 1)], "child long, parent long")
    unions = spark.createDataFrame([(7, 8), (5, 10)], "p1 long, p2 long")
    assert rows(family.validate_groups(groups, person, edges, unions=unions)) == [(1, "kreds"), (3, "kreds"), (5, None), (7, "egen ægtefælle")]


def test_more_than_500_lineages_below_a_root(spark):
    from stemma.operators import readmodel

    lineage = spark.range(1, 1401).selectExpr("id", "CASE WHEN id > 1 THEN id DIV 2 END AS parent_id")
    got = rows(readmodel.lineage_descendants(lineage, spark.createDataFrame([(1,), (2,)], "id long")).select("root", "id", "depth"))
    want = [(r, i, d) for i in range(2, 1401) for d in range(1, 12) for r in [i >> d] if r in (1, 2)]
    assert got == sorted(want, key=str)
    with pytest.raises(Exception, match="too many"):
        readmodel.lineage_descendants(lineage, spark.createDataFrame([(1,)], "id long"), limit=500).collect()


def test_closure_takes_the_least_depth_and_the_smallest_last_step(spark):
    from stemma.plans.stages import COMPARE_EVERY

    # A chain with a short cut, and a ring: pairs come again at larger depths, before and after a comparison.
    n = 2 * COMPARE_EVERY + 3
    arcs = [(i, i + 1) for i in range(n)] + [(0, 5), (2, COMPARE_EVERY + 4), (50, 51), (51, 52), (52, 50), (52, 53), (3, 54), (54, 5)]
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
    want = []
    for a in near:
        seen, level, depth = {}, {a}, 0
        while level:
            depth += 1
            ahead = {}
            for x in level:
                for y in near.get(x, ()):
                    ahead[y] = min(x, ahead.get(y, x))
            level = {y for y in ahead if y not in seen}
            seen |= {y: (depth, ahead[y]) for y in level}
        want += [(a, y, d, x) for y, (d, x) in seen.items()]
    e = spark.createDataFrame(arcs, "a long, b long")
    assert rows(closure(e, "a", "b", last=True).select("node", "reached", "depth", "last")) == sorted(want, key=str)
    some = closure(e, "a", "b", sources=spark.createDataFrame([(1,), (50,)], "id long"))
    assert rows(some.select("node", "reached", "depth")) == sorted([w[:3] for w in want if w[0] in (1, 50)], key=str)
    for depth in (COMPARE_EVERY, 2 * COMPARE_EVERY):
        chain = spark.range(depth).select("id", (F.col("id") + 1).alias("up"))
        assert closure(chain, "id", "up", max_depth=depth).count() == depth * (depth + 1) // 2
        with pytest.raises(ValueError):
            closure(chain, "id", "up", max_depth=depth - 1)


def test_closure_does_not_move_all_pairs_at_every_depth(spark):
    # The plan of the last frames: all found so far are read a few times, not once for each of 20 depths.
    found = closure(spark.range(20).select("id", (F.col("id") + 1).alias("up")), "id", "up")
    assert len(found.inputFiles()) > 0 and found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4


def test_paths_by_doubling(spark):
    line = spark.range(1, 41).selectExpr("id", "CASE WHEN id > 1 THEN id - 1 END AS parent_id").union(spark.createDataFrame([(90, 99)], "id long, parent_id long"))
    want = [(i, list(range(i, 0, -1))) for i in range(1, 41)] + [(90, [90, 99])]
    df = family.lineage_paths(line)
    assert rows(df) == sorted(want, key=str)
    # Forty steps took as many frames; doubling takes eight.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 8
    with pytest.raises(Exception, match="deeper"):
        family.lineage_paths(line, max_depth=39)
    with pytest.raises(Exception, match="cycle"):
        family.lineage_paths(spark.createDataFrame([(1, 1)], "id long, parent_id long"))


def test_graph_fixpoints_broadcast_nothing(spark, monkeypatch):
    from stemma.plans import stages

    plans, write = [], stages.materialise

    def noted(df, tag="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(stages, "materialise", noted)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 1)], "a long, b long")
    assert components(e, "a", "b").count() == 5 and stages.cycles(e, "a", "b").count() == 3
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_provenance_sorts_each_subject_once(spark):
    fact = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, subject_id long")
    claim = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3)], "id long, target_id long")
    cited = [(10, 1, "s. 12"), (10, 1, "s. 12"), (11, 1, "s. 3"), (11, 2, "s. 12"), (20, 1, None), (20, 2, None), (20, 3, "x"), (30, 1, "s. 12")]
    citation = spark.createDataFrame(cited, "claim_id long, source_id long, page string")
    # Sources 1 and 2 are one work.
    source = spark.createDataFrame([(1, "A", None), (2, "A", None), (3, "A", "2")], "id long, title string, edition string")
    df = evidence.provenance(fact, claim, citation, source)
    assert rows(df) == sorted([(7, "A", "s. 3", 1), (7, "A", "s. 12", 2), (7, "A", None, 3), (7, "A, 2", "x", 4), (8, "A", "s. 12", 1)], key=str)
    assert "HashAggregate" not in df._jdf.queryExecution().executedPlan().toString()
