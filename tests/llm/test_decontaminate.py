import hashlib
import re

from cohort.llm import decontaminate as dec


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        words, hit, names = tokens(text), set(), set()
        for name, item in items:
            w = tokens(item)
            k = min(len(w), window)
            for p in range(len(w) - k + 1) if w else []:
                for q in range(len(words) - k + 1):
                    if words[q:q + k] == w[p:p + k]:
                        hit.update(range(q, q + k))
                        names.add(str(name))
        out.append((key, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(frame):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in frame.collect()], key=str)


def write(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, hits string, key int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, n_words int").write.parquet(f"{path}/benchmark.parquet")


W = [f"w{n}" for n in range(40)]
ITEMS = [(1, " ".join(W[:14])), (2, "One two THREE"), (3, " ".join(W[4:20])), (11, "solo"), (5, None), (6, " .,; "), (7, "é ß straße")]
DOCS = [
    (1, "x " + " ".join(W[:14]) + " y"), (2, "one, two. three one two three four solo"), (3, " ".join(W[5:14])), (4, " ".join(W[2:25]) + " " + " ".join(W[3:13])),
    (5, None), (6, ""), (7, "É é ß straße"), (8, "filler " * 30000 + " ".join(W[:10]) + " solo" * 3), (8, "solo"), (9, "one two"), (10, " ".join(W[:9])), (12, " ".join(W[9:14])), (12, " ".join(W[9:14])),
]


def test_against_brute_force(spark, tmp_path):
    write(spark, tmp_path, [(a, b, "x", 1) for a, b in DOCS], [(a, b, 3) for a, b in ITEMS])
    assert rows(dec.op7_decontaminate_suffix_arrays(spark, str(tmp_path))) == brute(DOCS, ITEMS)


def test_blocks_agree_with_one_block(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    size = "aggregate(hits, 0L, (n, h) -> n + h.end - h.start) as n"
    one = dec.find_matches(docs, items).selectExpr("doc_id", "n_words", size, "array_sort(items) as items").collect()
    more = dec.find_matches(docs, items, block_bytes=40).selectExpr("doc_id", "n_words", size, "array_sort(items) as items").collect()
    assert sorted(one, key=str) == sorted(more, key=str)


def test_longest_matches(spark):
    docs, items = spark.createDataFrame([(4, DOCS[3][1])], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {i["item_id"]: tuple(i)[1:] for i in dec.find_matches(docs, items).first()["items"]}
    assert found == {"1": (12, 0, 2), "3": (16, 2, 0)}


def test_empty_tables_and_clean(spark, tmp_path):
    docs = spark.createDataFrame([(None, "solo", 1), (2, "fine", 2), (3, None, 3)], "doc_id long, text string, print int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.print for r in dec.clean(docs, items).collect()) == [2, 3]
    assert dec.clean(docs, items).columns == docs.columns
    assert dec.clean(docs, items.limit(0)).count() == 3
    assert dec.find_matches(docs.limit(0), items).count() == 0


def test_query_beside_brute_force_on_a_tail(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("n_chars").limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    mine = {r[0]: r for r in rows(dec.op7_decontaminate_suffix_arrays(spark, sf))}
    assert all(mine[r[0]] == r for r in brute(docs, items))
