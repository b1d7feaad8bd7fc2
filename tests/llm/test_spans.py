import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohort.llm import spans
from cohort.llm.text import Words, utf8


def split(text):
    """Sentences with words, as the rules say, one character at a time (no long ones here)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    cuts = []
    for m in re.finditer(r"(?<=[.!?])(?=[ \t\n\x0b\x0c\r])|(?<=\n)|(?<=[。！？])", text):
        first = word.search(text, m.start())  # what is between belongs to the sentence before
        if first and word.search(text, 0, m.start()):
            cuts.append(first.start())
    cuts = sorted(set(cuts))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if word.search(text) else []


def words(sentence):
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)))


def brute(rows, least=2, most=20):
    cut, seen = {}, {}
    order = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    parts = {(k, t): [words(s) for s in split(t)] for _, k, t in order}
    for _, k, t in order:
        s = parts[(k, t)]
        found = set()
        for a in range(len(s)):
            long = [b for b in range(a + least, len(s) + 1) if sum(map(len, s[a:b])) >= most]
            found.update((a, b) for b in long[:1])
        for b in range(len(s) + 1):
            long = [a for a in range(b - least, -1, -1) if sum(map(len, s[a:b])) >= most]
            found.update((a, b) for a in long[:1])
        for a, b in sorted(found):
            name = tuple(s[a:b])
            if name in seen:
                cut.setdefault((k, t), set()).update(range(a, b))
            seen.setdefault(name, (k, a))
    return {key: sorted(v) for key, v in cut.items()}


def sentence(rng):
    return " ".join("w%d" % rng.randrange(500) for _ in range(rng.randint(3, 14))).capitalize() + rng.choice([".", "!", "?"])


def corpus():
    rng = random.Random(9)
    passage = " ".join(sentence(rng) for _ in range(7))
    rows = []
    for k in range(40):
        body = [sentence(rng) for _ in range(rng.randint(1, 9))]
        if k % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        rows.append((k, rng.choice([" ", "\n"]).join(body)))
    return rows, passage


def test_places_match_brute_force(spark):
    rows, _ = corpus()
    rows += [(50, rows[3][1]), (51, "a. b. a. b."), (52, None), (53, ""), (54, rows[0][1] + " " + rows[0][1])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, place int").repartition(3)
    found = {r.key: sorted(r.places) for r in spans.repeated(docs).collect()}
    assert found == {k: v for (k, _), v in brute(rows).items()}
    out = {r.doc_id: r for r in spans.deduplicated(docs).collect()}
    for k, t in rows:
        if t:
            whole = split(t)
            gone = set(found.get(k, []))
            assert out[k].n_sentences == len(whole) and out[k].n_removed == len(gone)
            assert out[k].text == "".join(s for n, s in enumerate(whole) if n not in gone)
            data = t.encode()
            for r in reversed(out[k].removed):
                data = data[:r["start"]] + data[r["end"]:]
            assert data.decode() == out[k].text
    assert out[52].text is None and out[53].text == "" and out[50].text == ""
    assert out[0].n_removed == 0 and out[3].n_removed >= 7


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows, _ = corpus()
    text = " ".join(["One two three four five six seven eight nine ten eleven."] * 1 + ["A b c d e f g h i j k l m n."])
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "doc_id long, text string")
    out = spans.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.text) for r in out) == [("4", 2, ""), ("4", 2, ""), ("5", 0, None), ("None", 0, text)]
    assert spans.deduplicated(docs.limit(0)).count() == 0


def test_a_passage_without_stops_is_cut_alike():
    rng = random.Random(3)
    passage = " ".join("w%d" % rng.randrange(900) for _ in range(120))
    texts = [passage, "Some other words before it " + passage + " and after"]
    found = spans.sentences(*utf8(pa.array(texts)))
    _, _, name, _ = spans.runs(found)
    rows = found.row[spans.runs(found)[0]]
    shared = set(name[rows == 0].tolist()) & set(name[rows == 1].tolist())
    assert len(shared) >= 0.5 * (rows == 0).sum() > 3


def glued(rng, size, low, high):
    """Two texts that share ``size`` words, glued into other sentences at both ends."""
    def prose(n):
        out, rest = [], rng.randint(low, high)
        for _ in range(n):
            rest -= 1
            out.append("w%d" % rng.randrange(90000) + ("." if not rest and high < 90 else ""))
            rest = rest or rng.randint(low, high)
        return out

    shared = prose(size)
    shared[0], shared[-1] = shared[0].strip("."), shared[-1].strip(".")
    return shared, [" ".join(["q%d" % rng.randrange(90000) for _ in range(rng.randint(1, 30))] + shared + ["z%d" % rng.randrange(90000) for _ in range(rng.randint(1, 30))]) for _ in range(2)]


def test_a_passage_glued_at_both_ends_is_removed(spark):
    rng = random.Random(6)
    rows, shares = [], []
    for case in range(240):
        shared, texts = glued(rng, rng.randint(51, 60), *rng.choice([(18, 24), (20, 30), (6, 14), (99, 99)]))
        shares.append(shared)
        rows += [(2 * case + n, t) for n, t in enumerate(texts)]
    out = {r.doc_id: r for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = dict(rows)
    for case, shared in enumerate(shares):
        assert out[2 * case].text == texts[2 * case]
        left = [w for w in out[2 * case + 1].text.split() if w in shared]
        assert len(left) <= 2 * (spans.WINNOW - 1), case
        data = texts[2 * case + 1].encode()
        for r in reversed(out[2 * case + 1].removed):
            data = data[:r["start"]] + data[r["end"]:]
        assert data.decode() == out[2 * case + 1].text
        assert [w for w in texts[2 * case + 1].split() if w not in shared] == [w for w in out[2 * case + 1].text.split() if w not in shared]


def test_one_name_per_run_is_enough_to_count():
    raw, offsets = utf8(pa.array([t for _, t in corpus()[0]] + [None, ""]))
    apart = Words(raw, offsets, spans._TABLE)
    first, count, name = spans.runs(spans.sentences(raw, offsets, apart, spans.SALTS[:1]))
    again = spans.runs(spans.sentences(raw, offsets))
    assert len(again) == 4 and all((a == b).all() for a, b in zip((first, count, name), again))
    assert len(set(zip(first.tolist(), count.tolist()))) == len(first) > 100
    assert spans.sentences(raw, offsets, apart, ()).keys == ()


@pytest.mark.parametrize("common", [0, 3, 10**6])
def test_common_names_give_the_same_places(spark, monkeypatch, common):
    monkeypatch.setattr(spans, "COMMON", common)
    rows, _ = corpus()
    rows += [(None, rows[3][1]), (50, rows[3][1]), (50, rows[3][1]), (54, rows[0][1] + " " + rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.key: sorted(r.places) for r in spans.repeated(docs).collect()} == {k: v for (k, _), v in brute(rows).items()}


def test_a_very_common_name_is_spread_over_tasks(spark):
    rows = [(k or None, 31 * k, 7, 7, k % 5 << 32, True) for k in range(3000)] + [(k, 31 * k, k % 400, 9, 2, False) for k in range(1200)]
    spots = spark.createDataFrame(rows + rows[:50], "key long, print long, name long, more long, spot long, common boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = spans.later(spots).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    own = [r for r in found if r.more == 7]
    assert sorted((r.key, r.spot) for r in own) == [(k, k % 5 << 32) for k in range(1, 3000)]
    assert {(r.key, r["name"]) for r in found if r.more == 9} == {(k, k % 400) for k in range(400, 1200)}
    tasks = [sum(r.task == t for r in own) for t in {r.task for r in own}]
    assert len(tasks) > 4 and max(tasks) < 0.4 * len(own)
