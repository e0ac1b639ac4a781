"""Lines and ways through a forest, against walking it step by step."""

import random

from stemma.operators import routes


def _forest(rng, n):
    return [(i, None if i % 17 == 0 else rng.randint(0, i - 1) if rng.random() < 0.6 else i - 1, rng.randint(0, 3)) for i in range(n)]


def _kids(rows):
    kids = {}
    for i, parent, ord_ in sorted(rows, key=lambda r: (r[2], r[0])):
        kids.setdefault(parent, []).append(i)
    return kids


def _line(rows, x):
    parent, out = {i: p for i, p, _ in rows}, []
    while x in parent and len(out) < 40:
        out.append(x)
        x = parent[x]
    return out[::-1]


def _snap(rows, x):
    kids, out = _kids(rows), _line(rows, x)
    depth, n = len(out) - 1, 0
    while kids.get(out[-1]) and n < 40:
        out.append(kids[out[-1]][0])
        n += 1
    return out, depth


def follow(rows, focus, route):
    """Where the gestures lead: up and down the line of the place where one stands, sideways among siblings."""
    kids, parent = _kids(rows), {i: p for i, p, _ in rows}
    line, at = _snap(rows, focus)
    for step, n in route:
        for _ in range(n):
            if step in ("up", "down"):
                at += 1 if step == "down" else -1
            else:
                own = kids[parent[line[at]]]
                line, at = _snap(rows, own[own.index(line[at]) + (1 if step == "right" else -1)])
    return line[at]


def test_lines_and_routes_of_a_forest(spark):
    rng = random.Random(4)
    rows = _forest(rng, 90) + [(200, 999, 1)]
    tree = spark.createDataFrame(rows, "id long, parent_id long, ord int")
    ids = [r[0] for r in rows]
    got = {r["id"]: (r["path"], r["depth"]) for r in routes.snap_paths(tree).collect()}
    assert got == {i: _snap(rows, i) for i in ids}
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(300)] + [(5, 5), (None, 3), (3, None), (3, 12345), (12345, 3), (12345, 12345)]
    out = routes.routes(tree, spark.createDataFrame(pairs, "focus long, me long")).collect()
    assert len(out) == len(pairs)
    for r in out:
        a, b = r["focus"], r["me"]
        if a not in ids or b not in ids or _line(rows, a)[0] != _line(rows, b)[0]:
            assert a == b == 5 or (r["step"], r["remaining"], r["route"]) == (None, None, None)
            continue
        assert follow(rows, a, r["route"]) == b
        assert r["remaining"] == sum(n for _, n in r["route"]) and r["step"] == (r["route"][0]["step"] if r["route"] else "arrived")
    assert {r["step"] for r in out} == {None, "arrived", "up", "down", "left", "right"}


def test_long_lines_end_after_forty_and_cycles_too(spark):
    rows = [(i, i - 1 if i else None, 0) for i in range(100)] + [(200, 201, 0), (201, 200, 0)]
    tree = spark.createDataFrame(rows, "id long, parent_id long, ord int")
    got = {r["id"]: (r["path"], r["depth"]) for r in routes.snap_paths(tree).collect()}
    assert got[50] == (list(range(11, 91)), 39) and got[3] == (list(range(44)), 3) and len(got[200][0]) == 80
    out = {(r["focus"], r["me"]): (r["step"], r["remaining"]) for r in routes.routes(tree, spark.createDataFrame([(10, 30), (30, 10), (60, 70), (70, 70)], "focus long, me long")).collect()}
    assert out == {(10, 30): ("down", 20), (30, 10): ("up", 20), (60, 70): (None, None), (70, 70): ("arrived", 0)}


def test_empty_tree(spark):
    tree = spark.createDataFrame([], "id long, parent_id long, ord int")
    assert routes.snap_paths(tree).count() == 0
    assert [tuple(r) for r in routes.routes(tree, spark.createDataFrame([(1, 1)], "focus long, me long")).collect()] == [(1, 1, None, None, None)]
