import hashlib
import random

from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cohort.llm import bpe, queries
from tests.llm import test_decontaminate, test_neardup, test_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    rng = random.Random(8)
    words = {"en": ["the", "house", "and", "water", "with", "other", "thing"], "de": ["das", "haus", "und", "wasser", "mit", "ander", "straße"]}
    leak = " ".join(rng.choices(words["en"], k=15))
    rows = []
    for k in range(90):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choices(words[lang], k=rng.randint(20, 70)))
        if k % 9 == 0:
            text += " " + leak
        if k % 10 == 1:
            text += ' token = "0123456789abcdef0123" end'
        rows.append((k, text, lang, "s", len(text)))
    rows += [(100 + k, rows[k][1] + (" more" if k % 2 else ""), rows[k][2], "s", 1) for k in range(0, 30, 4)]
    rows += [(200, None, "en", "s", None), (201, "", "en", "s", 0), (202, "12 34 !!", "en", "s", 8), (203, "password: hunter2hunter2 and the house with water " + "other " * 9000, "en", "s", 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    items = [(1, leak), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def brute(rows, items):
    """The same decisions with the plain versions of the single tests."""
    docs = [(k, t) for k, t, *_ in rows if t and any(c.isalpha() for c in t)]
    keep = {k for k, _, root in test_neardup.brute(docs, 5) if k == root}
    docs = [(k, t) for k, t in docs if k in keep]
    clean = {k for k, _, hit, _, _ in test_decontaminate.brute(docs, items) if not hit}
    inner = Tokenizer.from_file(bpe.default_tokenizer())
    out = []
    for k, t in docs:
        if k in clean:
            spans = [s.split(":") for s in test_secrets.brute(t).split(",") if s]
            at, text = 0, ""
            for _, a, b in spans:
                if int(a) >= at:
                    text, at = text + t[at:int(a)] + "[secret]", int(b)
                at = max(at, int(b))
            text += t[at:]
            ids = inner.encode(text, add_special_tokens=False).ids
            out.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(inner.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_stages_and_run_match_brute_force(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(rows, items)
    assert got == want and 0 < len(want) < 92
    masked = corpus_pipeline.mask_secrets(spark, docs, str(tmp_path)).collect()
    assert all(r.text is None or r.n_chars == len(r.text) and "0123456789abcdef" not in r.text for r in masked)


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and len(queries.QUERIES) == 10
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
