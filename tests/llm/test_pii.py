import hashlib
import re

from hypothesis import given, settings, strategies as st

from cohort.llm import pii

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in twice) % 10 == 0


def brute(text):
    order = list(RULES)
    found = [(m.start(), order.index(k), k, m.end()) for k, (rule, ok) in RULES.items() for m in re.finditer(rule, text) if ok(m.group())]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123459.@+- ()a_%Zé\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "+1 (921) 555-8394", ".", " ", "-", "x", "@", "+", "5500-0000-0000-0004", "é"]), max_size=9))
def test_base_spans_match_the_patterns_near_each_other(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_cues_and_schemes():
    text = "IBAN: GB82 WEST 1234 5698 7654 32 ssn 078-05-1120, account no. 12345678; https://me:pw@host.example.org/x http://plain.example.org"
    kinds = {k: text[a:b] for k, a, b in pii.find_spans(text)}
    assert kinds["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert kinds["ssn"] == "078-05-1120"
    assert kinds["account"] == "12345678"
    assert kinds["login"] == "https://me:pw@host.example.org"
    assert pii.find_spans("account of the state, iban nothing, ssn x") == []


def test_query_columns_and_edges(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x@y.zz", "c"), (3, "é 1.2.3.4 " + "word " * 60000 + "a@b.co", "d"), (3, "1.2.3.4", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.op9_pii_anchor_expansion(spark, str(tmp_path)).toPandas()
    assert list(out.columns)[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert len(out) == 5
    long = out[out.spans.str.contains("email") & out.spans.str.contains("ip")].iloc[0]
    assert long.spans == f"ip:2:9,email:{10 + 5 * 60000}:{10 + 5 * 60000 + 6}"
    assert long.base_sha256 == hashlib.sha256(long.spans.encode()).hexdigest()
    assert (out[out.spans == ""].base_sha256 == hashlib.sha256(b"").hexdigest()).sum() == 2
    spark.createDataFrame([], frame.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op9_pii_anchor_expansion(spark, f"{tmp_path}/none").count() == 0


def test_query_beside_brute_force(spark, sf):
    out = pii.op9_pii_anchor_expansion(spark, sf).select("doc_id", "base_sha256", "n_email").toPandas().set_index("doc_id")
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = brute(row.text or "")
        assert out.base_sha256[row.doc_id] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert out.n_email[row.doc_id] == sum(k == "email" for k, _, _ in spans)
