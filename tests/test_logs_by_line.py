"""Metrics of logs line by line, beside a plain loop, and of a log of a million lines."""

import random
import re

import pytest

from cohort.operators import logs

ROC, F1 = re.compile(logs.ROC), re.compile(logs.F1)


def loop(body):
    now, out = None, {}
    for line in re.split("\r\n|\n|\r", body):
        low = line.lower()
        named = [m for m, hit in (("logistic", "logistic" in low), ("catboost", "catboost" in low), ("gam", re.search(r"\bgam\b", low)), ("dummy", "dummy" in low)) if hit]
        now = named[0] if named else now
        here = [float(m.group(1)) if m else None for m in (ROC.search(line), F1.search(line))]
        if now and any(v is not None for v in here):
            own = out.setdefault(now, [None, None])
            own[:] = [a if a is not None else b for a, b in zip(own, here)]
    return {m: tuple(v) for m, v in out.items()}


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_carried_model_beside_a_loop(spark, size):
    draw = random.Random(6)
    parts = ["Logistic model", "the GAM", "gamma ray", "catboost", "dummy baseline", "roc_auc: 0.71", "ROC-AUC=0.8 f1 0.5", "f1: 0.33", "", "nothing", "logistic roc auc 0.91"]
    bodies = {f"log{k}": "\n".join(draw.choice(parts) + (f" {draw.random():.2f}" if draw.random() < 0.1 else "") for _ in range(draw.randint(0, 40))) for k in range(25)}
    frame = spark.createDataFrame([*bodies.items(), ("none", None)], "path string, body string")
    got = {}
    for r in logs.model_metrics(frame, carry_lines=size).collect():
        got.setdefault(r.path, {})[r.model] = (r.roc_auc, r.f1)
    assert got == {k: v for k, v in ((k, loop(b)) for k, b in bodies.items()) if v}


def test_printed_dicts_come_before_prose(spark):
    body = "gam roc_auc: 0.9\nLogistic: {'holdout': {'roc_auc': 0.5, 'f1': None}}\nlogistic: {'roc_auc': 0.6, 'f1': 0.7}\nother: {}"
    out = logs.model_metrics(spark.createDataFrame([("a", body), ("b", "gam f1 0.4")], "path string, body string")).collect()
    assert sorted((r.path, r.model, r.roc_auc, r.f1) for r in out) == [("a", "logistic", 0.6, 0.7), ("b", "gam", None, 0.4)]


def test_a_log_of_a_million_lines(spark):
    lines = ["gam starts"] + ["filler"] * 500_000 + ["ROC-AUC: 0.75"] + ["filler"] * 499_998 + ["f1: 0.5", "logistic f1: 0.25"]
    out = logs.model_metrics(spark.createDataFrame([("big", "\n".join(lines))], "path string, body string")).collect()
    assert sorted((r.model, r.roc_auc, r.f1) for r in out) == [("gam", 0.75, 0.5), ("logistic", None, 0.25)]
