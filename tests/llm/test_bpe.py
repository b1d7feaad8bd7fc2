import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cohort.llm import bpe
from cohort.llm.text import utf8


@pytest.fixture(scope="module")
def whole():
    inner = Tokenizer.from_file(bpe.default_tokenizer())
    inner.no_padding()
    inner.no_truncation()

    def run(text):
        ids = inner.encode(text or "", add_special_tokens=False).ids
        return ids, inner.decode(ids, skip_special_tokens=False)

    return run


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(bpe.default_tokenizer(), encoding="utf-8").read())


def digest(whole, text):
    ids, back = whole(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


ODD = ["<|endoftext|>", "<|StartOfText|>", "don't", "DON'T...", "a1b2", "İstanbul", "ΣΑΣ.", "é", " ̈x", " ", "　", "\x1c", "\x85", "'s", "!!", "x'.", "\n\n", "\t", " ", "ſ", "日本語", "👍🏽", "ﬁ", "word,", "Word", "\x00", "...", "​", "5.0!"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14), st.integers(0, 2**32))
def test_any_cut_is_repaired(coder, whole, parts, seed):
    text = "".join(parts)
    cuts = sorted(set(random.Random(seed).sample(range(1, len(text)), min(4, len(text) - 1)))) if len(text) > 1 else []
    pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if text else []
    made = []
    for k, piece in enumerate(pieces):
        spaces = [i for i, c in enumerate(piece) if c in " \t\n\r"]
        if (seed >> k) & 1:
            made.append({"text": piece})
        elif spaces:
            made.append({"text": None, "head": piece[:spaces[0]], "tail": piece[spaces[-1] + 1:], "parted": True, "body": bpe._packed(coder.ids_of(piece[spaces[0]:spaces[-1] + 1]), len(coder.name))})
        else:
            made.append({"text": None, "head": piece, "tail": "", "parted": False, "body": b""})
    assert coder.finished(bpe.put_together(coder, made)) == digest(whole, text)
    assert coder.ids_of(text) == whole(text)[0]


def test_chunks_join_to_the_text_and_follow_the_content():
    rng = random.Random(1)
    body = " ".join("".join(rng.choices("abcdefé", k=rng.randint(2, 9))) for _ in range(4000))
    texts = ["", body, "shifted " + body, "short"]
    chunks = list(bpe.chunks_of(*utf8(pa.array(texts)), 8))
    assert [b"".join(c).decode() for c in chunks] == texts
    assert len(set(chunks[1]) & set(chunks[2])) > 0.95 * len(chunks[1]) > 50
    assert all(len(c) for row in chunks for c in row)


def test_shared_chunks_give_whole_encodings(spark, whole):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=900))
    texts = [None, "", "   \n", "alone", passage, passage, "A " + passage + " end.", "x" * 30000 + " " + passage[:2000], passage + "<|endoftext|>", "é" * 5000, "don't " * 20000]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "n") for k, t in enumerate(texts)] + [(5, passage, "n")], "doc_id long, text string, ids string").repartition(3)
    out = bpe.encode(docs, chunk_bits=7, bitmap_bits=20).collect()
    assert len(out) == len(texts) + 1
    want = sorted([(k if k != 3 else None, *digest(whole, t)) for k, t in enumerate(texts)] + [(5, *digest(whole, passage))], key=str)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out], key=str) == want
    back = bpe.decode(spark.createDataFrame(out), "doc_id").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted([(str(k if k != 3 else None), whole(t)[1]) for k, t in enumerate(texts)] + [("5", whole(passage)[1])])
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query_beside_the_library(spark, sf, whole):
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5_bpe_chunk_reuse(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert out[row.doc_id] == digest(whole, row.text)
