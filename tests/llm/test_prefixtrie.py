"""Prefix nodes beside a trie of Python tuples."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cohort.llm import prefixtrie as trie

SCHEMA = "conv_id long, turn long, role string, text string, n int, token string, seg long"


def brute(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    convs = {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        base = c - int(np.fmod(c, 5))
        h = 0 if base == c else zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items())


def rows_of(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def made(seed, n_convs, longest, words=3):
    draw = random.Random(seed)
    shared = [("user", draw.choice("abc") * draw.randint(0, 4)) for _ in range(longest)]
    rows = []
    for c in range(-7, n_convs):
        if draw.random() < 0.1:
            continue
        keep = draw.randint(0, longest)
        own = shared[:keep] + [(draw.choice(["user", None, ""]), draw.choice(["", None, "é", "x" * draw.randint(0, words)])) for _ in range(draw.randint(0, longest - keep + 1))]
        rows += [(c, k, *t, 1, "t", 2) for k, t in enumerate(own)]
    return rows


EDGES = [(None, 0, "user", "lost", 1, "", 1), (5, None, "b", "z", 1, "", 1), (5, None, "a", "y", 1, "", 1), (5, 0, None, None, 1, "", 1), (6, 0, "u", "only", 1, "", 1), (6, 0, "u", "only", 1, "", 1),
         (12, 3, "", "", 1, "", 1), (-3, 1, "u", "q", 1, "", 1), (20, 1, "u", "long " * 40_000, 1, "", 1), (21, 1, "u", "long " * 40_000, 1, "", 1)]


def test_query_at_the_edges(spark, tmp_path):
    rows = EDGES + [(30, 0, "u", "same", 1, "", 1)] * 50
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(trie.op11_prefix_double_arrays(spark, str(tmp_path))) == brute(rows)


def test_empty_table(spark):
    assert trie.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    only_null = spark.createDataFrame(EDGES[:1], SCHEMA)
    assert trie.prefix_nodes(only_null).count() == 0


@pytest.mark.parametrize("shard_turns, segment", [(100_000, 32), (20, 3), (60, 4)])
def test_shards_and_segments_agree(spark, shard_turns, segment):
    """Small shards force several rounds; small segments cut heads from chains."""
    rows = made(3, 160, 14)
    rows += [(c, k, "u", f"copy {k}", 1, "", 1) for c in range(200, 230, 5) for k in range(23)]  # equal and long
    rows += [(c, k, "u", f"copy {min(k, 17 + c % 3)}", 1, "", 1) for c in range(300, 330, 5) for k in range(20)]  # part late
    rows += [(400, k, "u", f"copy {k}", 1, "", 1) for k in range(12)] + [(405, k, "u", f"copy {k}", 1, "", 1) for k in range(9)]  # end inside
    assert rows_of(trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA), shard_turns=shard_turns, segment=segment)) == brute(rows)


def test_a_conversation_over_many_partitions(spark):
    rows = [(10, k, "u", f"t{k % 7}", 1, "", 1) for k in range(3000)] + [(11, k, "u", "x", 1, "", 1) for k in range(5)] + [(15, 0, "u", "r", 1, "", 1)] * 5000
    found = trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert rows_of(found) == brute(rows)


def test_double_array_holds_its_sequences():
    draw = np.random.default_rng(5)
    seqs = sorted({tuple(draw.integers(0, 9, draw.integers(0, 7))) for _ in range(400)})
    edges = np.r_[0, np.cumsum([len(s) for s in seqs])]
    ids = np.array([x for s in seqs for x in s], np.int64)
    array = trie.DoubleArray(ids, edges)
    states = array.walk(ids, edges)
    named = {}
    for k, s in enumerate(seqs):
        for d in range(len(s)):
            assert named.setdefault(s[: d + 1], states[edges[k] + d]) == states[edges[k] + d]
    assert len(set(named.values())) == len(named) == (array.check[: array.end] >= 0).sum()
    with pytest.raises(KeyError):
        array.walk(np.array([99]), np.array([0, 1]))
