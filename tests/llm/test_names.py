"""Documents whose own columns are called like the operators' helpers, and what workers keep."""

import numpy as np
import pyarrow as pa
import pytest

from cohort.llm import bpe, decontaminate, langid, neardup, toxicity

NAMES = ["_print", "_bad", "_of", "_dropped", "_key", "id", "text_", "component_id"]


@pytest.fixture
def docs(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(k, " ".join(words[(k * j + j) % 6] + str(k * j % 7) for j in range(1, 25)), "en", *range(len(NAMES))) for k in range(40)]
    rows += [(100, rows[0][1], "en", *range(len(NAMES))), (101, None, None, *range(len(NAMES)))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in NAMES))


def test_filters_keep_columns_of_any_name(spark, docs):
    items = spark.createDataFrame([(1, " ".join(docs.first().text.split()[2:14]))], "item_id long, text string")
    for out in (neardup.deduplicated(docs), decontaminate.clean(docs, items), langid.accepted(docs)):
        assert out.columns == docs.columns
        assert all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in out.collect())
    assert {r.doc_id for r in neardup.deduplicated(docs).collect()}.isdisjoint({100})
    assert {0, 100}.isdisjoint({r.doc_id for r in decontaminate.clean(docs, items).collect()})


def test_what_a_coder_remembers_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50_000)
    coder = bpe.Coder(open(bpe.default_tokenizer(), encoding="utf-8").read())
    for k in range(60):
        text = " ".join(f"word{k}x{j}" for j in range(50)) + " " + "z" * 3000
        assert coder.ids_of(text) == coder.inner.encode(text, add_special_tokens=False).ids
        assert sum(len(w) + bpe._OVERHEAD for w in coder.known) < 50_000 + 30_000


def test_words_of_texts_with_punctuation_of_other_scripts():
    texts = pa.array(["«Été» — “No”, naïve ÉTÉ", None, "。日本、語", "ª"])
    row, key = toxicity.words_of(texts)
    assert np.bincount(row, minlength=4).tolist() == [3, 0, 2, 1]


def test_logistic_model_meets_its_optimality_conditions():
    draw = np.random.default_rng(0)
    n, size = 400, 12
    held = draw.random((n, size)) < draw.random(size)
    dense, weight = draw.random((n, 1)), draw.integers(1, 4, n).astype(float)
    y = (draw.random(n) < 1 / (1 + np.exp(-(held @ draw.normal(size=size) + dense[:, 0] - 0.5)))).astype(float)
    row, word = np.nonzero(held)
    found = toxicity.elastic_logistic(row, word, size, dense, y, weight)
    x, share = np.column_stack([held, dense]), weight / weight.sum()
    spread = np.sqrt(share @ (x - share @ x) ** 2)
    slope = share * (1 / (1 + np.exp(-(found[0] + x @ found[1:]))) - y)
    beta = found[1:] * spread
    grad = ((x - share @ x) / spread).T @ slope + toxicity.PENALTY * (1 - toxicity.MIXING) * beta
    lasso = toxicity.PENALTY * toxicity.MIXING
    assert abs(slope.sum()) < 1e-4
    assert all(abs(g + lasso * np.sign(b)) < 1e-4 if b else abs(g) <= lasso + 1e-4 for g, b in zip(grad, beta))


def test_scores_beside_brute_force(spark):
    frame = spark.createDataFrame([(1, "bad Bad word"), (2, "fine"), (3, None), (4, "bad fine « bad»")], "doc_id long, text string")
    row, key = toxicity.words_of(pa.array(["bad", "fine", "word"]))
    order = np.argsort(key)
    weights = np.array([2.0, -1.0, 0.5])
    models = [np.r_[0.1, weights[order]], np.r_[-0.2, -weights[order], 3.0]]
    chain = toxicity.Chain(["a", "b"], key[order], models, [0.5, 0.5])
    words = {1: {0, 2}, 2: {1}, 3: set(), 4: {0, 1}}
    for r in toxicity.score(frame, chain, ["a", "b"]).collect():
        own = sum(weights[k] for k in words[r.doc_id])
        a = 1 / (1 + np.exp(-(0.1 + own)))
        b = 1 / (1 + np.exp(-(-0.2 - own + 3 * a)))
        assert abs(r.p_a - a) < 1e-12 and abs(r.p_b - b) < 1e-12 and r.is_a == (a >= 0.5) and r.is_b == (b >= 0.5)
