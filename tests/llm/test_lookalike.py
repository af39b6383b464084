import unicodedata

import pytest

from codeloom.llm.lookalike import canonical_texts, confusables, group_members, lookalike_pairs, mappings, same_form

SAME = [
    ("café", "café"), ("ＡＢＣ１２", "ABC12"), ("ﬁne ﬂow", "fine flow"), ("a b", "a b"), ("a　b c d", "a b c d"), ("zero​width­", "zerowidth"),
    ("раураl", "paypal"), ("Τhe Αnchor", "The Anchor"), ("ｶﾞ", "ガ"), ("ガ", "ガ"), ("ậ", "ậ"), ("x\r\ny", "x\ny"), ("﻿hi", "hi"), ("가", "가"), ("а́", "á"), ("ok\x00\x1b", "ok"), ("é‍̣", "ẹ́"),
]
DIFFERENT = [("x²", "x2"), ("a b", "ab"), ("Case", "case"), ("resume", "résumé"), ("a\nb", "a b"), ("a\tb", "a b"), ("1", "l"), ("0", "O"), ("①", "1"), ("👩‍💻", "👩💻"), ("a-b", "a–b"), ("и", "n"), ("½", "1/2"), ("ñ", "n"), ("a  b", "a b")]


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "p", "q") for i, t in enumerate(texts)], "doc_id long, text string, form string, plain string")
    return {r["doc_id"]: r["form"] for r in same_form(df).collect()}


def test_same_and_different(spark):
    texts = [t for pair in SAME + DIFFERENT for t in pair]
    got = forms(spark, texts)
    for k, (a, b) in enumerate(SAME):
        assert got[2 * k] == got[2 * k + 1], (a, b)
    for k, (a, b) in enumerate(DIFFERENT, len(SAME)):
        assert got[2 * k] != got[2 * k + 1], (a, b)


def test_nulls_blank_and_long(spark):
    long = ("о" * 40_000) + "́" + "x" * 10_000
    got = forms(spark, [None, "", "​", "  ", long, long])
    assert got[0] is None and got[1] == "" and got[2] == "" and got[3] == "  "
    assert got[4] == got[5] == ("o" * 39_999) + "ó" + "x" * 10_000


def test_forms_are_stable(spark):
    texts = [t for pair in SAME + DIFFERENT for t in pair]
    once = forms(spark, texts)
    twice = forms(spark, [once[i] for i in range(len(texts))])
    assert once == twice


def test_pairs(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "abc​"), (5, "​"), (6, ""), (7, None), (8, "Abc"), (None, "аbc"), (9, "xyz"), (9, "xyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lookalike_pairs(df, block=1).collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert lookalike_pairs(df.limit(0)).collect() == []


def test_a_hot_group_gives_every_pair_of_different_strings(spark):
    rows = [(i, "hot") for i in range(60)] + [(i, "hоt") for i in range(60, 90)] + [(i, f"t{i}") for i in range(90, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lookalike_pairs(df, block=7).collect()
    assert len(got) == 60 * 30 and all(r[0] < 60 <= r[1] < 90 for r in got) and len(set(got)) == len(got)


def test_letters_of_the_table_of_confusables(spark):
    alike = confusables(spark)
    pairs = ["УY", "ҮY", "ѴV", "ѵv", "νv", "ՍU", "ՏS", "ᎪA", "ᏟC", "ⲞO", "ⲢP", "ꓐB", "АA", "οo"]
    assert {p: chr(alike[ord(p[0])]) for p in pairs} == {p: p[1] for p in pairs}
    assert not set(map(ord, "гαγρиЯΩж0l1ıſß")) & set(alike) and len(alike) > 120
    assert all(chr(to).isascii() and chr(to).isalpha() for to in alike.values())
    got = forms(spark, ["𝐀𝗯ℝℓ", "AbRl", "Ү", "Y"])
    assert got[0] == got[1] and got[2] == got[3]


def test_broadcast_and_shuffle_give_the_same(spark):
    df = spark.createDataFrame([(i, t) for i, p in enumerate(SAME + DIFFERENT) for t in p], "doc_id long, text string")
    one, two = (sorted(map(tuple, canonical_texts(df, "text", n).collect())) for n in (0, 10**6))
    assert one == two and len(one) > 20


def test_groups(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "abc​"), (5, "​"), (6, ""), (7, None), (8, "Abc"), (None, "аbc"), (9, "xyz"), (9, "xyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, group_members(df).collect())) == [(1, 1, 1, 3), (2, 1, 2, 3), (3, 1, 1, 3), (4, 1, 4, 3)]
    assert group_members(df.limit(0)).collect() == []


def test_a_form_with_many_spellings_goes_by_blocks(spark):
    rows = [(i, "a" * 8 if i == 0 else "".join("а" if i >> k & 1 else "a" for k in range(8))) for i in range(200)]
    got = lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string"), block=9).collect()
    assert len(got) == len(set(got)) == 200 * 199 // 2


def test_mapping_is_small_and_ends(spark):
    table = dict(mappings(confusables(spark)))
    assert len(table) < 9000
    for to in table.values():
        for cp, ccc in to:
            assert ccc == unicodedata.combining(chr(cp))
            assert cp not in table or table[cp] == [(cp, ccc)] or cp == 0x200D


@pytest.mark.parametrize("text", ["Ελληνικά", "Россия", "日本語", "한국어", "français"])
def test_scripts_keep_their_letters(spark, text):
    form = forms(spark, [text])[0]
    assert len(form) == len(text)
