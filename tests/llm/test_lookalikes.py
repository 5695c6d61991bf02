import unicodedata

from pyspark.sql import functions as F

from corpusloom.llm.lookalikes import character_map, classes, plain_form, same_looking

ALIKE = [
    ["The Kuwoaxvilk fluffy café", "Тhе Kuwоахvіlk fluffу саfé", "Ｔｈｅ Ｋｕｗｏａｘｖｉｌｋ ｆｌｕｆｆｙ ｃａｆé", "The K​uwoax­vilk fl‍luffy café".replace("fl‍l", "fl‍"), "The Kuwoaxvilk ﬂuﬀy　café", "The Kuwoaxvilk fluffy café"],
    ["вошёл", unicodedata.normalize("NFD", "вошёл")], ["털이 짙게", unicodedata.normalize("NFD", "털이 짙게")], ["end.", "end․"], ["a\nb", "a\r\nb"], ["o", "ο", "о", "օ", "𝐨", "𝚘"], ["Heft VIII", "Heft Ⅷ", "Неft VІІІ"], ["Ḗ", "\u0112\u0301", "E\u0304\u0301"], ["각", "\u1100\u1161\u11a8", "\uac00\u11a8"],
]
APART = ["Cafe", "cafe", "café", "qibreś", "qibres", "paboskpłam", "paboskplam", "møde", "mode", "5⁰", "50", "a b", "ab", "a  b", "rn", "m", "l", "I", "1", "0", "O", "ß", "ss", "”", "\"", "😀", "😃", "Ⓐ", "A", "٠", "०", "0٠", "각", "간"]
BLANK = ["", " ", "​‍ ", "　", "﻿", "\n\t", "\xa0"]


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, class_id string")


def test_alike(spark, scratch):
    texts, want = [], set()
    for group in ALIKE:
        ids = range(len(texts), len(texts) + len(group))
        want |= {(a, b) for a in ids for b in ids if a < b}
        texts += group
    got = {tuple(r) for r in same_looking(table(spark, texts), scratch).collect()}
    assert got == want


def test_apart_and_blank(spark, scratch):
    df = table(spark, APART + BLANK).unionByName(table(spark, [None, None], 900)).unionByName(spark.createDataFrame([(None, "Cаfe", "x")], "doc_id bigint, text string, class_id string"))
    assert same_looking(df, scratch).count() == 0


def test_copies(spark, scratch):
    df = table(spark, ["pug", "pug", "рug", "рug", "pug"]).unionByName(table(spark, ["pug"]))
    got = {tuple(r) for r in same_looking(df, scratch).collect()}
    assert got == {(a, b) for a in range(5) for b in range(a + 1, 5) if (a in (2, 3)) != (b in (2, 3))}


def test_canonical_member(spark, scratch):
    texts, members = classes(table(spark, ["рug", "pug", "pug", "x" * 100_000]), scratch)
    assert {(r.doc_id, r.class_id, r.canonical, r.variants) for r in texts.collect()} == {(0, 0, 1, 2), (1, 0, 1, 2), (3, 3, 3, 1)}
    assert members.count() == 4
    texts, members = classes(table(spark, []), scratch)
    assert texts.count() == 0 and members.count() == 0


def test_map(spark):
    source, target = character_map()
    assert len(set(source)) == len(source) > len(target) > 300
    assert all(unicodedata.category(c) in ("Cf", "Cc", "Mn") for c in source[len(target) :])
    assert spark.range(1).select(plain_form(F.lit("Ａ​ё ﬁ")).alias("x")).first().x == "Aë fi"


def test_a_third_of_the_documents_in_one_class(spark, scratch):
    texts = ["pug", "рug", "pug\u200b"] * 40 + [f"dog {k}" for k in range(200)]
    classed, _ = classes(table(spark, texts), scratch)
    assert sorted(r.variants for r in classed.collect()) == [1] * 200 + [3] * 3
    got = same_looking(table(spark, texts), scratch).collect()
    assert len(got) == len(set(map(tuple, got))) == 3 * 40 * 40
