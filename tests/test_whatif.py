"""Many candidate identity links at once, against one full run for each pair in plain Python."""

import random

from stemma.operators import whatif
from stemma.plans.stages import materialise


def _groups(edges, known):
    near = {}
    for a, c in edges:
        if a != c:
            near.setdefault(a, set()).add(c)
            near.setdefault(c, set()).add(a)
    aliases, seen = {a for a, c in edges if a != c}, set()
    for start in sorted(near):
        if start in seen:
            continue
        members, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in members:
                members.add(x)
                todo += near[x]
        seen |= members
        sinks = members - aliases
        reason = "ukendt medlem" if members - known else "ikke én kanonisk" if len(sinks) != 1 else None
        yield members, min(sinks) if reason is None else None, reason


def full_run(edges, people, parents, unions, spread=80):
    """person -> reason of its group, for every person of a group."""
    groups = list(_groups(edges, set(people)))
    reasons = [r for _, _, r in groups]
    while True:
        to = {m: sink for (members, sink, _), r in zip(groups, reasons, strict=True) if r is None for m in members}
        arcs = {}
        for c, p in parents:
            if to.get(c, c) != to.get(p, p):
                arcs.setdefault(to.get(c, c), set()).add(to.get(p, p))

        def above(x):
            found, todo = set(), list(arcs.get(x, ()))
            while todo:
                y = todo.pop()
                if y not in found:
                    found.add(y)
                    todo += arcs.get(y, ())
            return found

        now = list(reasons)
        for i, (members, sink, _) in enumerate(groups):
            if reasons[i] is not None:
                continue
            rows = [people[m] for m in members]
            born, died = [r[1] for r in rows if r[1] is not None], [r[2] for r in rows if r[2] is not None]
            sets = {frozenset(to.get(p, p) for c, p in parents if c == m) for m in members} - {frozenset()}
            if len({r[0] for r in rows if r[0]}) > 1:
                now[i] = "køn"
            elif born and died and max(born) > min(died) + 1:
                now[i] = "født efter død"
            elif born and max(born) - min(born) > spread:
                now[i] = "fødselsår"
            elif len(sets) > 1:
                now[i] = "forældre"
            elif any(c in members and to.get(p, p) == sink for c, p in parents):
                now[i] = "egen forælder"
            elif any(x is not None and y is not None and to.get(x, x) == sink == to.get(y, y) for x, y in unions):
                now[i] = "egen ægtefælle"
            elif sink in above(sink):
                now[i] = "kreds"
        if now == reasons:
            return {m: r for (members, _, _), r in zip(groups, reasons, strict=True) for m in members}
        reasons = now


def _frames(spark, edges, people, parents, unions):
    person = spark.createDataFrame([(i, *p) for i, p in people.items()], "id long, sex string, born int, died int")
    return spark.createDataFrame(edges, "alias long, canonical long"), person.select("id"), person, spark.createDataFrame(parents, "child long, parent long"), spark.createDataFrame(unions, "p1 long, p2 long")


def test_every_pair_as_its_own_full_run(spark):
    rng = random.Random(11)
    people = {i: (rng.choice([None, None, None, "m", "k"]), rng.choice([None, None, 1700 + i, 1600]), rng.choice([None, None, None, 1760])) for i in range(36)}
    parents = [(rng.randint(9, 35), rng.randint(0, 35)) for _ in range(16)] + [(20, 3), (21, 3), (20, 3)]
    parents = [(c, p) for c, p in parents if c != p]
    edges = [(1, 2), (2, 3), (4, 5), (7, 8), (7, 9), (30, 31), (32, 99), (6, 6), (20, 21)]
    unions = [(10, 11), (12, 1), (2, 13), (14, None)]
    pairs = [(a, a + rng.randint(0, 5)) for a in range(34)] + [(rng.randint(0, 35), rng.randint(0, 35)) for _ in range(60)] + [(3, 500), (3, 500)]
    got = whatif.what_if(spark.createDataFrame(pairs + [(None, 4)], "alias long, canonical long"), *_frames(spark, edges, people, parents, unions)).collect()
    want = {(a, c): full_run([*edges, (a, c)], people, parents, unions).get(a) for a, c in pairs} | {(None, 4): "ukendt medlem"}
    assert {(r["alias"], r["canonical"]): r["reason"] for r in got} == want and len(got) == len(want)
    assert all(r["accepted"] == (r["reason"] is None) for r in got)
    assert {None, "forældre", "kreds", "ikke én kanonisk", "ukendt medlem"} <= set(want.values())


def test_a_cycle_far_above_and_no_pairs(spark):
    people = {i: (None, None, None) for i in range(12)}
    parents = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 7)]
    frames = _frames(spark, [(7, 8)], people, parents, [(0, 9)])
    pairs = [(5, 0), (0, 5), (8, 6), (9, 0), (10, 11)]
    got = {(r["alias"], r["canonical"]): r["reason"] for r in whatif.what_if(spark.createDataFrame(pairs, "alias long, canonical long"), *frames).collect()}
    assert got == {(5, 0): "kreds", (0, 5): "kreds", (8, 6): "egen forælder", (9, 0): "egen ægtefælle", (10, 11): None}
    assert whatif.what_if(spark.createDataFrame([], "alias long, canonical long"), *frames).count() == 0


def test_query_as_a_full_run_for_each_pair(spark):
    from stemma.bindings import family

    from .conftest import SMALL

    rows = lambda df: [tuple(r) for r in df.collect()]
    people = {r["id"]: (r["sex"], r["born"], r["died"]) for r in family._beings(spark, SMALL).collect()}
    edges, parents = rows(family._same(spark, SMALL)), rows(family._parents(spark, SMALL))
    got = {(r["alias"], r["canonical"]): r["reason"] for r in family.same_as_whatif(spark, SMALL).collect()}
    assert len(got) == len(people)
    assert got == {(a, c): full_run([*edges, (a, c)], people, parents, []).get(a) for a, c in got}
    assert len(set(got.values())) > 3


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """A third of all pairs lead into one group of copies; nothing that is written is larger than a few times the input."""
    sizes = []

    def counted(df, tag="stage"):
        out = materialise(df, tag)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(whatif, "materialise", counted)
    n = 900
    people = {i: (None, None, None) for i in range(n)}
    edges, parents = [(i, 0) for i in range(3, n, 3)], [(i, 1) for i in range(3, n, 3)]
    frames = _frames(spark, edges, people, parents, [])
    pairs = spark.range(n).selectExpr("id AS alias", "id + 1 AS canonical").where(f"canonical < {n}")
    got = {r["alias"]: r["reason"] for r in whatif.what_if(pairs, *frames).collect()}
    assert {got[i] for i in range(3, n - 1, 3)} == {"ikke én kanonisk"}
    assert got[2] is None and got[5] is None and got[0] == "egen forælder" and max(sizes) <= 4 * n
