import random
import zlib

import numpy as np

from cohort.llm import langid

WORDS = {
    "aa": ["the", "and", "with", "thing", "house", "water", "other", "where"],
    "bb": ["der", "und", "mit", "haus", "wasser", "ander", "straße", "über"],
    "cc": ["да", "мир", "вода", "дом", "другой", "где", "это", "они"],
}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang) for k in range(n) for lang in [rng.choice(list(WORDS))]]


def brute_model(rows):
    """Interpolated Kneser-Ney over strings, with one discount per order."""
    out = {}
    for lang in {r[1] for r in rows}:
        top: dict = {}
        for text, own in rows:
            if own == lang:
                folded = "".join(c.lower() if c.isalpha() else " " for c in text)
                while "  " in folded:
                    folded = folded.replace("  ", " ")
                padded = "\1\1\1" + folded
                for k in range(3, len(padded)):
                    g = padded[k - 3:k + 1]
                    top[g] = top.get(g, 0) + 1
        tables = {4: top}
        for order in (3, 2, 1):
            tables[order] = {}
            for g in tables[order + 1]:
                tables[order][g[1:]] = tables[order].get(g[1:], 0) + 1
        out[lang] = tables
    return out


def brute_bits(tables, text):
    folded = "".join(c.lower() if c.isalpha() else " " for c in text)
    while "  " in folded:
        folded = folded.replace("  ", " ")
    padded, total = "\1\1\1" + folded, 0.0
    for k in range(3, len(padded)):
        g = padded[k - 3:k + 1]
        p = 1.0 / (len(tables[1]) + 1.0)
        for order in (1, 2, 3, 4):
            own, table = g[-order:], tables[order]
            same = [v for h, v in table.items() if h[:-1] == own[:-1]]
            once, twice = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
            d = once / (once + 2 * twice) if once and twice else 0.5
            if same:
                p = min(1.0, (max(table.get(own, 0) - d, 0) + d * len(same) * p) / sum(same))
        total -= np.log2(p)
    return total / max(1, len(folded))


def test_cross_entropy_matches_brute_force(spark):
    rows = [(t, lang) for _, t, lang in corpus(40)]
    model = langid.fit(spark.createDataFrame([(lang, t) for t, lang in rows], "lang string, text string"))
    tables = brute_model(rows)
    texts = ["The water, and!  others", "der Über mir", "zq", "мир"]
    bits, letters = langid.cross_entropies(model, texts)
    assert letters.tolist() == [len([c for c in t if c.isalpha()]) for t in texts]
    for row, text in zip(bits, texts):
        for lang, value in zip(model.langs, row):
            assert abs(value - brute_bits(tables[lang], text)) < 0.02, (text, lang)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.createDataFrame([(k, t, lang, "s", 1) for k, t, lang in corpus()] + [(900, "ᚠᚢᚦᚨᚱᚲ " * 30, None, "s", 1), (901, "", "aa", "s", 1), (902, "12 34 !!", "aa", "s", 1), (903, None, None, "s", 1), (None, "the house", "bb", "s", 1)],
                                 "doc_id long, text string, lang string, source string, part int")
    out = {r.doc_id: r for r in langid.predict(docs).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    truth = {k: lang for k, _, lang in corpus()}
    assert all(out[k].held_out == (k in held) for k in range(300))
    assert np.mean([out[k].lang_pred == truth[k] for k in held]) > 0.98
    assert not any(out[k].rejected for k in range(300)) and out[900].rejected
    assert [out[k].lang_pred for k in (901, 902, 903)] == ["und"] * 3 and out[None].lang_pred == "aa"
    assert all(0.0 <= r.score <= 1.0 for r in out.values())
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 301


def test_prediction_ignores_the_label_and_empty_tables(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(k, t, lang) for k, t, lang in rows], "doc_id long, text string, lang string")
    other = spark.createDataFrame([(k, t, lang if zlib.crc32(str(k).encode()) % 4 != 2 else None) for k, t, lang in rows], "doc_id long, text string, lang string")
    assert sorted(map(tuple, langid.predict(docs).collect())) == sorted(map(tuple, langid.predict(other).collect()))
    assert langid.predict(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_many_grams_keep_their_own_counts(spark):
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(30000)) for _ in range(20)]
    model = langid.fit(spark.createDataFrame([("zz", t) for t in texts], "lang string, text string"))
    learned = {t[k:k + 4] for t in texts for k in range(len(t) - 3)}
    fresh = [g for g in ("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(4)) for _ in range(5000)) if g not in learned]
    codes = np.array([sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(g)) for g in fresh], np.uint64)
    (n,) = langid._lookup(model.grams[3], codes)
    assert not n.any() and len(model.grams[3][0]) > 590_000


def test_blocks_give_the_scores_of_one_model(spark, monkeypatch):
    rows = corpus(150) + [(7, "the house", "aa"), (7, "the house", "aa"), (None, "мир", None), (8, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted([tuple(r) for r in langid.predict(docs).collect()], key=str)
    monkeypatch.setattr(langid, "CELLS", 400)
    parts = sorted([tuple(r) for r in langid.predict(docs).collect()], key=str)
    assert len(whole) == len(parts) == len(rows)
    for a, b in zip(whole, parts):
        assert a[:3] == b[:3] and a[5] == b[5] and np.allclose([x or 0.0 for x in a[3:5]], [x or 0.0 for x in b[3:5]])


def test_long_texts_of_an_unlearned_language_are_rejected_on_a_sparse_table(spark):
    rng = random.Random(4)
    junk = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 4 == 3][:3]  # calibration rows
    rows = corpus(300) + [(k, "the with ᚠᚢᚦᚱᚲᚠᚦᚢᚱᚲᚲᚱ", "aa") for k in junk]
    long = [(2000 + k, " ".join("".join(rng.choices("theandwrsogi", k=rng.randint(3, 9))) for _ in range(600)), None) for k in range(5)]
    own = [(3000 + k, " ".join(rng.choices(WORDS[lang], k=600)), None) for k, lang in enumerate(WORDS)]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows + long + own, "doc_id long, text string, lang string")).collect()}
    assert all(out[k].rejected for k, _, _ in long)
    assert not any(out[k].rejected for k, _, _ in own)
    assert not any(out[k].rejected for k in range(300))


def test_limits_follow_one_rule_and_never_borrow_from_shorter_texts():
    long = [("aa", 8, 40, 2.0, 0.1), ("bb", 8, 300, 2.2, 0.1)]
    with_short = langid._limits(long + [("aa", 0, 500, 9.0, 2.0)], ["aa", "bb", "cc"])
    assert all(with_short[cell] == langid._limits(long, ["aa", "bb"])[cell] for cell in ("aa:8", "bb:8"))
    assert with_short["cc:8"] < 4 < with_short["aa:0"]
    few, more = (langid._limits([("aa", 8, n, 2.0, 0.1), ("bb", 8, 300, 2.2, 0.1)], ["aa"])["aa:8"] for n in (99, 100))
    assert abs(few - more) < 0.01
