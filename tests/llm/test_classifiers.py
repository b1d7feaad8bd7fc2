import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohort.llm import labelled, quality, toxicity
from cohort.llm.text import utf8

BAD = ["idiot", "scum", "trash", "moron"]


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = ["w%d" % int(rng.paretovariate(0.6) % 3000) for _ in range(rng.randint(20, 80))]
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if low:
            text = " | ".join(w.upper() + "!!" for w in words)
        docs.append((k, text, "site%d" % (k % 7 if not low else 7), "x"))
        labels.append((k, 1 - int(low), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, features string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_held_out_rows(spark):
    docs, labels = corpus()
    frame, marks = frames(spark, docs, labels)
    marks = marks.select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    chain = toxicity.fit(frame, marks.filter("doc_id < 400"), ["low", "toxic"])
    assert len(chain.models) == 2 and len(chain.models[1]) == len(chain.models[0]) + 1
    out = {r.doc_id: r for r in toxicity.score(frame, chain, ["low", "toxic"]).collect()}
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if k >= 400]
    assert np.mean([out[k].is_toxic == bool(truth[k]) for k in held]) > 0.97


def test_out_of_fold_probabilities_feed_the_next_model(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choices([f"v{n}" for n in range(4000)], k=30))) for k in range(240)]
    labels = [(k, k % 2, k % 2) for k, _ in docs]  # the words say nothing, so only leaked probabilities could help
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, first int, second int")
    chain = toxicity.fit(frame, marks, ["first", "second"])
    assert abs(chain.models[1][-1]) < 5.0


def test_chain_edges(spark):
    docs, labels = corpus(60)
    docs += [(900, None, "s", "x"), (901, "", "s", "x"), (None, "idiot", "s", "x"), (902, "word " * 40000, "s", "x"), (5, docs[5][1], "s", "x")]
    frame, marks = frames(spark, docs, labels + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)])
    out = toxicity.score(frame, toxicity.fit(frame, marks, ["toxic"]), ["toxic"]).collect()
    assert len(out) == 65 and all(0 <= r.p_toxic <= 1 for r in out)
    assert toxicity.fit(frame, marks.limit(0), ["toxic"]) is None
    none = toxicity.score(frame, None, ["toxic"])
    assert none.filter("p_toxic is null and not is_toxic").count() == 65
    assert toxicity.score(frame.limit(0), toxicity.fit(frame, marks, ["toxic"]), ["toxic"]).count() == 0


def test_statistics_match_plain_python():
    text = "The Café, 12 ## is.\nis is"
    got = dict(zip(quality.STATISTICS, quality.statistics(*utf8(pa.array(["", text])))[1]))
    words = text.split()
    assert abs(got["log_words"] - np.log1p(len(words))) < 1e-12
    assert abs(got["distinct_words"] - len({w.lower() for w in words}) / len(words)) < 1e-12
    assert abs(got["upper"] - 2 / len(text)) < 1e-12 and abs(got["digits"] - 2 / len(text)) < 1e-12 and abs(got["symbols"] - 2 / len(text)) < 1e-12
    assert abs(got["line_ends"] - 1 / len(text)) < 1e-12 and abs(got["beyond_ascii"] - 1 / len(text)) < 1e-12 and abs(got["word_ends"] - 2 / len(words)) < 1e-12
    assert (quality.statistics(*utf8(pa.array(["", " \n"]))) == 0).all()


def test_posteriors_match_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{h}", f"h{h}/{p}", float(np.clip(rng.normal(0.3 + 0.1 * h, 0.1), 0, 1))) for h in range(5) for p in range(3) for _ in range(rng.integers(1, 30))] + [(None, None, 0.5)]
    got, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.path: r for r in got.collect()}
    hosts = {}
    for h, _, p in rows:
        hosts.setdefault(h, []).append(p)
    every = [p for _, _, p in rows]
    assert abs(mean - np.mean(every)) < 1e-12

    def strength(groups, means):
        n = np.array([len(g) for g in groups])
        within = sum(np.sum((np.array(g) - np.mean(g)) ** 2) for g in groups) / (n.sum() - len(n))
        between = (sum(k * (np.mean(g) - m) ** 2 for k, g, m in zip(n, groups, means)) - (len(n) - 1) * within) / (n.sum() - (n ** 2).sum() / n.sum())
        return within / max(between, within * 1e-4)

    top = strength(list(hosts.values()), [mean] * len(hosts))
    host = {h: (top * mean + sum(g)) / (top + len(g)) for h, g in hosts.items()}
    assert all(abs(got[p].host_mean - host[got[p].host]) < 1e-9 for p in got)
    paths = {}
    for h, p, v in rows:
        paths.setdefault((h, p), []).append(v)
    inner = strength(list(paths.values()), [host[h] for h, _ in paths])
    assert abs(got["h0/0"].weight - inner) < 1e-6 * inner


def test_quality_separates_and_shrinks(spark):
    docs, labels = corpus()
    frame, marks = frames(spark, docs, labels)
    out = {r.doc_id: r for r in quality.judge(frame, marks.filter("doc_id < 300"), F.col("source"), F.concat_ws("/", "source", "features")).collect()}
    truth = {k: q for k, q, _ in labels}
    held = [k for k in truth if k >= 300]
    assert np.mean([out[k].keep == bool(truth[k]) for k in held]) > 0.97
    low, high = out[next(k for k in held if truth[k] == 0)], out[next(k for k in held if truth[k] == 1)]
    assert low.host_posterior < high.host_posterior


def test_quality_edges(spark):
    docs, labels = corpus(60)
    docs += [(900, None, None, None), (901, "", "s", "x"), (None, "some words", "s", "x"), (902, "word " * 40000, "lonely", "x")]
    frame, marks = frames(spark, docs, labels)
    out = quality.judge(frame, marks, F.col("source"), F.col("features")).collect()
    assert len(out) == 64 and all(0 <= r.p_quality <= 1 for r in out)
    assert quality.judge(frame, marks.limit(0), F.col("source"), F.col("features")).filter("p_document = 0.5").count() == 64
    assert quality.judge(frame.limit(0), marks, F.col("source"), F.col("features")).count() == 0


def test_samples_and_cuts(spark):
    marks = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, y int")
    some = labelled.labelled(marks, "doc_id", ["y"], 1000)
    assert 800 < some.count() < 1200 and labelled.labelled(marks, "doc_id", ["y"], 4000).count() == 4000
    scored = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.7, 1.0), (0.9, 1.0)], "p double, y double")
    assert 0.2 < labelled.best_cut(scored, "p", "y") <= 0.7
    assert labelled.best_cut(scored.filter("y = 1"), "p", "y") == 0.5
