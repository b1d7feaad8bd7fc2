"""Ranked search beside scores of all documents in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohort.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, key int, n string, terms int"


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, most=10):
    own = [(key, Counter(words(text)), len(words(text))) for key, text, *_ in docs]
    own = [d for d in own if d[2]]
    n_docs, n_terms = len(own), sum(d[2] for d in own)
    held = Counter(t for d in own for t in d[1])
    out = []
    for item, text, *_ in items:
        scored = []
        for key, tf, n in own:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:most])]
    return sorted(out, key=str)


def rows(frame):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()], key=str)


def made(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Straße", "日本"]
    return [(k, draw.choice([" ", ", ", "--"]).join(draw.choices(vocabulary, weights=[1 / (r + 1) for r in range(63)], k=draw.randint(0, 60))), 1, "x", 2) for k in range(n)]


ITEMS = [(1, "w0 w1 W2, w2 w59"), (2, "straße É w7 w7 w7"), (3, None), (4, " ?! "), (None, "w3 w4"), (6, "w3 w4"), (6, "w3 w4"), (7, "absent"), (8, "日本 w20")]


@pytest.fixture(scope="module")
def docs():
    return made(1, 300) + [(500, None, 1, "x", 2), (501, "", 1, "x", 2), (None, "w0 w1 w2", 1, "x", 2), (502, "w59 " * 50, 1, "x", 2), (502, "w59 " * 50, 1, "x", 2), (503, "w59 " * 50, 1, "x", 2), (504, "w1 " * 40_000, 1, "x", 2)]


def test_query_beside_brute_force(spark, tmp_path, docs):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, score int").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(lexical.op13_lexical_ball_tree(spark, str(tmp_path))) == brute(docs, ITEMS)


@pytest.mark.parametrize("block, tree, leaf, most", [(8, 64, 4, 10), (1 << 18, 33, 1, 3), (40, 2048, 32, 1)])
def test_blocks_trees_and_leaves_agree(spark, docs, block, tree, leaf, most):
    found = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string"), most=most, block_bytes=block, tree=tree, leaf=leaf)
    assert rows(found) == brute(docs, ITEMS, most)


def test_empty_tables(spark, docs):
    some, items = spark.createDataFrame(docs[:20], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(some.limit(0), items).count() == 0
    assert lexical.ranked(some, items.limit(0)).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, None, 1, "", 1)], DOCS), items).count() == 0


def test_pieces_of_a_long_text_count_alike():
    text = ("alpha beta " + "x" * 37 + " gamma,") * 500
    block = lexical.block_of(["alpha gamma", "x" * 37])
    raw, offsets = np.frombuffer((text + "beta alpha").encode(), np.uint8), np.array([0, len(text), len(text) + 10])
    whole = lexical.term_counts(raw, offsets, block.vocabulary)
    for most in (7, 64, 1000):
        assert all((a == b).all() for a, b in zip(whole, lexical.term_counts(raw, offsets, block.vocabulary, most)))
    assert whole[0].tolist() == [2000, 2]


def test_bounds_hold_and_prune():
    """Clustered documents: no bound below a score in the tree, and most leaves are left out."""
    draw = np.random.default_rng(2)
    rows_ = [np.unique(draw.integers(40 * (k % 20), 40 * (k % 20) + 40, 30)) for k in range(2000)]
    place, edges = np.concatenate(rows_), np.r_[0, np.cumsum([len(r) for r in rows_])]
    values = draw.integers(1, 10**10, len(place))
    tree, dense = lexical.BallTree(place, values, edges, 800), np.zeros(800, np.int64)
    terms, times = np.arange(45, 60), draw.integers(1, 4, 15)
    dense[terms] = times
    scores = np.add.reduceat(dense[place] * values, edges[:-1])
    ordered = scores[tree.order]
    bounds = np.minimum(tree.centres[:, terms] @ times + math.sqrt(float(times @ times)) * tree.radii, tree.tops[:, terms] @ times)
    assert all(ordered[a:b].max() <= bound * (1 + 1e-9) + 1 for (a, b), bound in zip(tree.spans, bounds))
    dense[terms] = 0
    best = np.sort(scores)[-10]
    seen = [(r, s) for r, s in tree.search(terms, times, 10, int(best), dense)]
    assert sorted(np.concatenate([r for r, _ in seen]).tolist()) == np.flatnonzero(scores >= best).tolist()
    assert len(seen) < len([b for b in tree.below if not b]) / 5 and not dense.any()
