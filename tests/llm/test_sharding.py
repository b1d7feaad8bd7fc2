"""Laws of the shards, and how many links they cut."""

import zlib
from collections import Counter

import pytest

from cohort.llm import sharding

SCHEMA = "doc_id long, text string, part int, home string, n long"


def placed(spark, texts, keys=None, **more):
    rows = [(k if keys is None else keys[k], t, 1, "x", 2) for k, t in enumerate(texts)]
    return [r.asDict() for r in sharding.balanced(spark.createDataFrame(rows, SCHEMA), **more).collect()]


def lawful(rows, texts, shards=16):
    assert Counter(r["text_crc32"] for r in rows) == Counter(zlib.crc32((t or "").encode()) for t in texts)
    assert Counter(r["size"] for r in rows) == Counter(len((t or "").encode()) + 1 for t in texts)
    counts = Counter(r["shard"] for r in rows)
    n = [counts.get(s, 0) for s in range(shards)]
    assert sum(n) == len(texts) and max(n) - min(n) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def spread(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    return groups


def test_groups_stay_together(spark):
    texts = [f"one of {k}" for k in range(700)] + [f"pair {k}" for k in range(100)] * 2 + [f"ten {k}" for k in range(10)] * 10
    rows = placed(spark, texts)
    lawful(rows, texts)
    assert max(len(s) for s in spread(rows).values()) == 1


def test_group_of_a_third_takes_as_few_shards_as_it_needs(spark):
    texts = ["hot"] * 1000 + [f"one {k}" for k in range(1700)] + [f"pair {k}" for k in range(150)] * 2
    rows = placed(spark, texts)
    lawful(rows, texts)
    shards = spread(rows)
    assert len(shards.pop((4, zlib.crc32(b"hot")))) <= 8  # 1000 rows in shards of 187 or 188 need six
    assert sum(len(s) > 1 for s in shards.values()) <= 5


def test_no_free_rows_to_fill_with(spark):
    texts = [f"pair {k}" for k in range(800)] * 2
    rows = placed(spark, texts)
    lawful(rows, texts)
    assert sum(len(s) > 1 for s in spread(rows).values()) < 160  # by hash alone about 750 of 800 pairs are cut


def test_nulls_repeats_and_clashing_names(spark):
    texts, keys = [None, None, "", "", "a", "a", "b", "long " * 50_000], [1, 1, None, 2, 3, 3, None, 4]
    rows = placed(spark, texts, keys)
    lawful(rows, texts)
    assert Counter(r["doc_id"] for r in rows) == Counter(keys)
    assert sorted(r["group_size"] for r in rows) == [1, 1, 1, 1, 2, 2, 2, 2]  # null texts link with nothing


def test_all_rows_equal_and_few_shards(spark):
    lawful(placed(spark, ["same"] * 50, [7] * 50, shards=3), ["same"] * 50, 3)


def test_empty_table(spark):
    assert sharding.balanced(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_links_and_cut(spark):
    rows = [(k, f"t{k}", k % 300, "x" if k % 3 else None, 2) for k in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = sharding.balanced(frame, linked_by=["part"]).join(frame.select("doc_id", "part"), "doc_id")
    links = sharding.cut_links(out, ["part"]).first()
    assert links.n_links == 2700 and links.n_cut <= 900  # by hash alone about 2,000
    assert sharding.balanced(frame, linked_by=["part", "home"]).filter("group_size = 1").count() == frame.filter("home is null").count()


@pytest.mark.parametrize("asked, quota", [({(0, 0): 5, (0, 1): 4, (1, 0): 3, (1, 1): 2}, [10, 10]), ({(0, 1): 9, (1, 1): 8}, [8, 9])])
def test_limits_keep_quotas(asked, quota):
    limits = sharding._limits(asked, quota)
    held = [sum(n for (s, _), n in asked.items() if s == k) for k in range(2)]
    after = [held[t] + limits[(1 - t) * 2 + t] - limits[t * 2 + 1 - t] for t in range(2)]
    assert all(a <= max(q, h) for a, q, h in zip(after, quota, held))
    assert all(limits[s * 2 + t] <= asked.get((s, t), 0) for s in range(2) for t in range(2) if s != t)


def test_query(spark, sf):
    out = sharding.op12_balanced_label_propagation(spark, sf)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = [r.asDict() for r in out.collect()]
    lawful(rows, texts)
    assert max(len(s) for s in spread(rows).values()) == 1
