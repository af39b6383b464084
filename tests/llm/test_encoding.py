import base64
import os
import random

import pytest

from codeloom.llm.bpe import PATTERN, Encoder, merge_long, merge_short, read_ranks
from codeloom.llm.encoding import VOCABULARY, encode_corpus, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as f:
        return read_ranks(f.read())


def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "don't they'll WE'VE", "  two  spaces \n\n tabs\t\t", "über straße naïve", "検査ツールは古い記号を", "👩‍💻🇧🇷 ⚠️", "<|endoftext|> is text", "x" * 5000, "0123456789" * 300, "\x00\x1b[0m", "á̂" * 40, "\r\n\r\n", "Ω≈ç√∫˜µ≤≥÷", "=" * 700 + " " * 700]


def test_equals_the_public_library(ranks):
    theirs, mine = reference(ranks), Encoder(ranks)
    for t in TEXTS:
        assert mine.encode(t) == theirs.encode_ordinary(t), t[:40]
        assert mine.count(t) == len(mine.encode(t))


def test_random_texts_and_round_trip(ranks):
    theirs, mine, rng = reference(ranks), Encoder(ranks), random.Random(7)
    back = {v: k for k, v in ranks.items()}
    for _ in range(200):
        t = "".join(rng.choice("abcdeé漢 \n'0x_.-́") for _ in range(rng.choice((1, 20, 300))))
        ids = mine.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert b"".join(back[i] for i in ids).decode() == t


def test_both_ways_of_merging_agree(ranks):
    rng = random.Random(3)
    for _ in range(150):
        w = bytes(rng.choice(b"abcdefgh etno\xc3\xa9") for _ in range(rng.randrange(1, 400)))
        assert merge_short(w, ranks) == merge_long(w, ranks)


def test_dataframe(spark, ranks):
    rows = [(1, None, "k"), (2, "", "k"), (3, "hello world", None), (3, "hello world", None), (None, "a" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_corpus(df, keep=["doc_id"])
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=str)
    mine = Encoder(ranks)
    assert got == sorted([(1, []), (2, []), (3, mine.encode("hello world")), (3, mine.encode("hello world")), (None, mine.encode("a" * 3000))], key=str)
    assert [r["n_tokens"] for r in token_counts(df.where("doc_id = 3"), keep=["doc_id"]).collect()] == [2, 2]
    assert encode_corpus(df.limit(0), keep=["doc_id"]).collect() == []
    assert encode_corpus(df).columns == ["doc_id", "ids"]


def test_small_vocabulary(tmp_path, spark):
    p = tmp_path / "v.tiktoken"
    p.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    got = encode_corpus(spark.createDataFrame([(1, "abab é")], "id long, text string"), keep=["id"], vocabulary=str(p)).first()
    assert got["ids"] == [256, 256, 32, 0xC3, 0xA9]
