import base64
import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from cohort.llm import secrets

RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
]


def brute(text):
    found = []
    for order, (kind, rule, good) in enumerate(RULES):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(rule, text, flags) if good(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def base(text):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.find_spans([text], [0] * 49)[0] if k != "random")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "api_key", "APIKEY", "token", "secret", " ", "=", ":", "'", '"', "0123456789abcdef", "deadbeefdeadbeefcafe", "AKIA", "ABCDEFGHIJKLMN09", "é", "longvalue-longvalue", "ſecret", "x", ".", "\n"]), max_size=12))
def test_base_spans_match_the_patterns(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_battery_is_uniform_on_random_tokens_and_low_on_words():
    rng = random.Random(3)
    fair = ["".join(rng.choices(secrets.ALPHABETS["base62"], k=40)) for _ in range(600)]
    words = ["".join(rng.choices(["the", "tion", "er", "on", "es", "with", "ing"], k=14))[:40] for _ in range(600)]
    p, q = secrets.battery(fair, "base62"), secrets.battery(words, "base62")
    assert np.abs(np.mean(p < 0.1, axis=0) - 0.1).max() < 0.06
    assert np.mean(q.min(axis=1) * 3 < 0.01) > 0.95


def test_infer():
    assert [secrets.infer(t) for t in ("00ff00ff00ff00ff", "ABCDEF0123456789", "MFRGGZDFMZTWQ2LK", "abcxyz0123456789", "abcXYZ0123456789", "ab+/XYZ012345678==", "ab-_XYZ0123456789")] == list(secrets.ALPHABETS)
    assert secrets.infer("thisisalongwordindeed") == "letters" and secrets.infer("4111111111111111") is None


def corpus(n=400):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["the", "tion", "er", "on", "es", "with", "ing", "an"], k=rng.randint(6, 20)))
    rows = [(k, " ".join(word() for _ in range(30)), "x") for k in range(n)]
    planted = {}
    for k in range(0, n, 20):
        secret = base64.b64encode(rng.randbytes(30)).decode()
        rows[k] = (k, rows[k][1] + " key " + secret + " end", "x")
        planted[k] = secret
    return rows, planted


def test_random_tokens_are_found_and_words_left(spark):
    rows, planted = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    hits = {r.doc_id: [r.text[s["start"]:s["end"]] for s in r.s if s["kind"] == "random"] for r in
            secrets.scan(docs).withColumnRenamed("spans", "s").join(docs, "doc_id").collect()}
    assert sum(planted[k] in hits[k] for k in planted) >= 0.85 * len(planted)
    assert sum(bool(v) for k, v in hits.items() if k not in planted) <= 2
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(planted[k] not in clean[k] for k in planted if planted[k] in hits[k])
    assert secrets.redact(docs).columns == docs.columns


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "token = abcdefghijklmnop"), (3, "é " * 50000 + "0123456789abcdef0"), (3, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = secrets.op1_secrets_randomness_battery(spark, str(tmp_path)).toPandas()
    assert list(out.columns)[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(out.spans) == ["", "", "", "assign:0:24", "hex:100000:100017"]
    assert (out[out.spans == ""].base_sha256 == hashlib.sha256(b"").hexdigest()).all()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert secrets.op1_secrets_randomness_battery(spark, f"{tmp_path}/none").count() == 0
    assert secrets.masked("abcdef", [("hex", 1, 3), ("random", 2, 4)]) == "a[secret]ef"


def test_query_beside_brute_force(spark, sf):
    out = secrets.op1_secrets_randomness_battery(spark, sf).select("doc_id", "base_sha256", "spans").toPandas().set_index("doc_id")
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert out.base_sha256[row.doc_id] == hashlib.sha256(brute(row.text or "").encode()).hexdigest()
