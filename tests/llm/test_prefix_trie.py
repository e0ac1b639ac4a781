"""The conversation trie against a trie built of Python dicts."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from stemma.llm import prefix_trie
from tests.conftest import SMALL, DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, sha, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def plain(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("sf_dir", [SMALL, DATA])
def test_whole_tables_agree_with_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(prefix_trie.op13_prefix_trie(spark, sf_dir)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else None, ["", "hällo", None, "x" * 3000][(c * t) % 4]) for c in range(230) for t in range(c % 9)]
    rows += [(7, None, None, None), (7, None, "user", "first"), (None, 1, "user", "lost"), (300, 0, "a", "b"), (300, 0, "a", "b"), (301, 0, "a", "b"), (100, 2, "😀", "😀")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS depth", "2 AS place")
    assert plain(prefix_trie.shared_trie(df)) == brute(rows)
    assert prefix_trie.shared_trie(df.where("false")).count() == 0


def test_long_conversations_and_many_equal_ones_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie._running, "__defaults__", (False, 4))
    rows = [(5, t, "u", f"t{t % 3}") for t in range(60)] + [(205, t, "u", f"t{t % 3}") for t in range(33)] + [(c, 0, "u", "same") for c in range(1000, 1090)]
    assert plain(prefix_trie.shared_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
