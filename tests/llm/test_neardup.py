import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from cohort.llm import neardup
from cohort.llm.text import utf8


def shingles(text, size):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent=80):
    sets = [(k, shingles(t, size)) for k, t in rows]
    up = {k: k for k, _ in sets if k is not None}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return sorted([(k, len(s), find(k) if k is not None else None) for k, s in sets], key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    texts = []
    for family in range(12):
        base = rng.choices(words, k=rng.choice([3, 12, 60, 200]))
        for copy in range(rng.choice([1, 2, 30])):
            changed = [w if rng.random() > rng.choice([0.0, 0.02, 0.06]) else rng.choice(words) for w in base]
            texts.append(" ".join(changed))
    texts += [None, "", " \n", "one", "ONE", "one two", "É one", "é one", "x " * 9, "x x", "long " + " ".join(rng.choices(words, k=30000))]
    rng.shuffle(texts)
    return [(3 * k, t) for k, t in enumerate(texts)]


def run(spark, rows, size):
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, n string").repartition(3)
    return sorted([tuple(r) for r in neardup.groups(docs, shingle=size).collect()], key=str)


def test_groups_match_brute_force(spark):
    rows = corpus()
    for size in (2, 5):
        assert run(spark, rows, size) == brute(rows, size)


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, None), (9, None)]
    assert run(spark, rows, 2) == sorted([(7, 5, 2), (7, 5, 2), (None, 5, None), (2, 5, 2), (2, 0, 2), (9, 0, 9)], key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    assert sorted(str(r.doc_id) for r in neardup.deduplicated(docs, shingle=2).collect()) == ["2", "2", "9", "None"]
    assert neardup.groups(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    texts = ["solo", "", " ".join(f"a{k}" for k in range(40)), " ".join(f"a{k}" for k in range(20000)), " ".join(f"a{k}" for k in range(4000, 20000))]
    row, key = neardup.shingle_sets(*utf8(pa.array(texts)), 1)
    cells = neardup.sketch(row, key, len(texts), 512)
    filled = (cells != neardup._EMPTY).all(axis=1)
    assert filled.tolist() == [True, False, True, True, True]
    assert abs(np.mean(cells[3] == cells[4]) - 0.8) < 0.08


def test_a_drifting_group_is_joined_as_brute_force_does(spark, monkeypatch):
    rng = random.Random(12)
    words = ["w%d" % k for k in range(4000)]
    base, texts = rng.choices(words, k=120), []
    for _ in range(220):
        share = rng.choice([0.01, 0.05, 0.09, 0.14, 0.2])
        texts.append(" ".join(w if rng.random() > share else rng.choice(words) for w in base))
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    assert run(spark, rows, 2) == brute(rows, 2)


def test_a_pair_meets_in_its_first_common_bucket_though_bytes_agree_before(spark):
    rng = np.random.default_rng(5)
    look = rng.integers(0, 256, neardup.COORDINATES, dtype=np.uint8).tobytes()
    bands = np.arange(100, 132)
    other = np.where(np.isin(np.arange(32), (3, 7)), bands, bands + 1000)  # sketch bytes agree everywhere, keys in two bands
    third = rng.integers(0, 256, neardup.COORDINATES, dtype=np.uint8)
    for band in (3, 7):
        third[band * neardup.BAND:(band + 1) * neardup.BAND] = np.frombuffer(look, np.uint8)[band * neardup.BAND:(band + 1) * neardup.BAND]
    rows = [(int(bucket), rep, rep, 1, own_look, own.tolist()) for bucket in (103, 107) for rep, own_look, own in ((1, look, bands), (2, look, other), (3, third.tobytes(), other))]
    frame = spark.createDataFrame(rows, "bucket long, rep long, root long, size long, sketch binary, bands array<long>")
    found = neardup._candidates(frame, frame.filter("rep = 2"), 80, "long").collect()
    assert [tuple(r) for r in found] == [(2, 1)]


def test_every_text_of_a_key_is_compared(spark):
    rng = random.Random(8)
    words = ["w%d" % k for k in range(4000)]
    one, two, rows = rng.choices(words, k=150), rng.choices(words, k=150), []
    for k in range(60):
        for base in (one, two):
            share = rng.choice([0.01, 0.05, 0.09, 0.14])
            rows.append((k if k % 7 == 0 else 100 + len(rows), " ".join(w if rng.random() > share else rng.choice(words) for w in base)))
    assert run(spark, rows, 2) == brute(rows, 2)
