from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyspark.llm import queries, tries

TURN = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract in plain Python: rows (conv_id, turn, role, text) without ties of turns."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple([*own.get(c - c % 5, [])[:h], *turns[h:]])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def found(spark, rows, **options):
    turns = tries.with_shared_heads(tries.conversation_turns(spark.createDataFrame(rows, TURN).repartition(3)))
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in tries.prefix_trie(turns, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["é", "ja", "no", "well", "日本"]) for _ in range(rng.randint(0, 2)))
    rows = []
    for c in [*range(160), 10_000, 5000, 5004, 1 << 40]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t if rng.random() < 0.9 or t else None, rng.choice(["user", "bot", None]), rng.choice([None, text()])))
    hot = [("user", "hello"), ("bot", "hi"), ("user", "x" * 3000), ("bot", "bye")]
    rows += [(c, k, *hot[k]) for c in range(200, 300) for k in range(4)]
    rows += [(c, k, "user", f"deep {k}") for c in (300, 301, 305, 310) for k in range(130)]
    return rows + [(None, 1, "user", "lost"), (400, None, None, None)]


@pytest.mark.parametrize("shard_turns", [200_000, 40, 0])
def test_equals_brute_force(spark, rows, monkeypatch, shard_turns):
    """Down to shards of one sequence: then nearly every prefix is heavy and the upper trie holds most of the levels."""
    if shard_turns < 200_000:
        monkeypatch.setattr(tries, "SHARD_SEQUENCES", 0)
    assert found(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_query_and_empty_table(spark, sf_dir):
    rows = list(map(tuple, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    got = queries.QUERIES["op11_prefix_trie"](spark, sf_dir).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == brute(rows)
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_other_columns_and_repeated_rows(spark):
    rows = [(1, 1, "user", "a", 9), (1, 1, "user", "a", 9), (2, 1, "user", "a", 9)]
    turns = tries.conversation_turns(spark.createDataFrame(rows, TURN + ", n long"))
    got = sorted((r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["saved_tokens"]) for r in tries.prefix_trie(turns).collect())
    assert got == [(0, 1, 2, 1, 1), (1, 1, 2, 1, 1), (2, 1, 1, 0, 0)]


def test_louds_navigation():
    parents = np.array([0, 0, 1, 1, 2, 4])  # of nodes 1 to 6
    trie = tries.Louds(parents, [1, 3, 6, 7])
    assert trie.parents().tolist() == [0, *parents.tolist()] and trie.degrees().tolist() == [2, 2, 1, 0, 1, 0, 0]
