"""Problem 9: visually identical text with different characters, brought to one form.

Method: values are mapped to plain look-alikes (column expressions in the JVM), grouped in SQL under
Spark's accent-sensitive UNICODE collation, which takes canonically equivalent sequences as equal and
skips what is invisible; each class gets a deterministic canonical member, which is joined back. Equal plain
forms are folded by digest, and only forms that share their skeleton, which is the form without marks, with another
one are collated, as only these can be equal; all else is digests.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vec import bound
from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch

# Letters and marks drawn alike, each with the plain one, after the confusables of Unicode Technical Standard 39.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    # Greek
    "α": "a", "ϲ": "c", "ϳ": "j", "ο": "o", "ρ": "p", "ν": "v",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    # Armenian
    "զ": "q", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "Տ": "S", "Ս": "U", "Օ": "O",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Marks
    "․": ".", "‐": "-", "‑": "-", "ʼ": "’", " ": "\n", " ": "\n", "\u0085": "\n",
}
# Ligatures drawn like the letters they join.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}


@cache
def ligatures() -> dict[str, str]:
    """What is drawn as several letters: the ligatures, and by rule the Roman numerals."""
    romans = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0x2160, 0x2180)}
    return LIGATURES | {c: letters for c, letters in romans.items() if len(letters) > 1}


@cache
def character_map() -> tuple[str, str]:
    """(from, to) for ``translate``; what has no counterpart in ``to`` is deleted.

    By rule: full-width and half-width forms, letters in another font and Roman numerals become ordinary ones, every
    kind of space the plain one, a marked letter over a look-alike the marked plain letter, and format and control characters nothing.
    """
    table, gone = dict(LOOK_ALIKES), []
    for code in range(0x20000):
        c = chr(code)
        kind = unicodedata.category(c)
        if c in table or kind in ("Cs", "Cn", "Co"):
            continue
        parts = unicodedata.decomposition(c).split()
        if kind == "Zs" and c != " ":
            table[c] = " "
        elif kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or 0xFE00 <= code <= 0xFE0F or c == "͏":
            gone.append(c)
        elif parts[:1] in (["<wide>"], ["<narrow>"]):
            table[c] = chr(int(parts[1], 16))
        elif len(parts) == 2 and (parts[0] == "<font>" or 0x2160 <= code < 0x2180):
            letter = chr(int(parts[1], 16))
            table[c] = LOOK_ALIKES.get(letter, letter)
        elif 0x370 <= code <= 0x52F or 0x1F00 <= code <= 0x1FFF:
            plain = unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFD", c)))
            if len(plain) == 1 and plain != c and plain.isascii() is False and "LATIN" in unicodedata.name(plain, ""):
                table[c] = plain
    return "".join(table) + "".join(gone), "".join(table.values())


def plain_form(text: Column) -> Column:
    """``text`` with every look-alike mapped and everything invisible removed."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    apart = out
    for ligature, letters in ligatures().items():
        apart = F.replace(apart, F.lit(ligature), F.lit(letters))
    out = F.when(text.rlike(r"[\x{132}\x{133}\x{FB00}-\x{FB06}\x{2160}-\x{217F}]"), apart).otherwise(out)
    return F.when(text.rlike(r"[^\t\n\x20-\x7e]"), F.translate(out, *character_map())).otherwise(text)


@cache
def bases() -> tuple[str, str]:
    """(from, to) for ``translate``: each character with a canonical decomposition, and what it begins with."""
    table = {}
    for code in range(0x80, 0x30000):
        c = chr(code)
        if not 0xAC00 <= code <= 0xD7A3 and unicodedata.category(c) not in ("Cs", "Cn", "Co") and (base := unicodedata.normalize("NFD", c)[0]) != c:
            table[c] = base
    return "".join(table), "".join(table.values())


def skeleton(plain: Column) -> Column:
    """``plain`` without marks and Hangul: canonically equivalent texts have one skeleton, however they are composed."""
    bare = F.regexp_replace(F.translate(plain, *bases()), r"[\p{M}\p{IsHangul}]+", "")
    return F.when(plain.rlike(r"[^\x00-\x7f]"), bare).otherwise(plain)


def classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts, members) of ``docs`` (doc_id, text).

    texts has a row per different visible text: digest, class_id, canonical (doc_id of the class's
    canonical member: a text that is its own plain form first, then the smallest doc_id) and variants
    (different texts in the class). members has (doc_id, digest). Null texts and texts with nothing visible
    are in neither; null doc_ids are left out; repeated rows count once. Two texts are one if their SHA-256 is.
    """
    spark = docs.sparkSession
    sha = lambda c: F.unhex(F.sha2(c, 256))
    there = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", sha(F.col("text")).alias("digest"))
    # in a lambda, so that the plain form is made once a row
    of = lambda p: F.struct(sha(p).alias("form"), sha(skeleton(p)).alias("bones"), (F.col("text") != p).alias("changed"), p.rlike(r"[^\s\p{Z}\p{C}]").alias("visible"))
    slim = there.select("doc_id", "digest", bound(plain_form(F.col("text")), of).alias("p"))
    # filtered only once it is written, as the filter would make the plain form again
    slim = scratch.put(slim, "digests").filter("p.visible").select("doc_id", "digest", "p.form", "p.bones", "p.changed")
    texts = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("form", "bones", "changed")])
    texts = scratch.put(texts, "texts")
    shared = scratch.put(texts.groupBy("bones").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).filter("lo <> hi").select("bones"), "shared")
    wanted = scratch.put(skew_join(texts.select("digest", "form", "bones"), shared, "bones", "left_semi").groupBy("form").agg(F.min("digest").alias("digest")), "wanted")
    forms = skew_join(there, wanted, "digest").groupBy("form").agg(F.any_value("text").alias("text"))
    forms = scratch.put(forms.select("form", plain_form(F.col("text")).alias("plain")), "forms")
    spark_sql = """
        SELECT t.form, c.class
        FROM {forms} t JOIN (SELECT plain COLLATE UNICODE AS collated, min(form) AS class FROM {forms} GROUP BY plain COLLATE UNICODE) c
        ON t.plain COLLATE UNICODE = c.collated"""
    classed = scratch.put(spark.sql(spark_sql, forms=forms), "classed")
    texts = scratch.put(skew_join(texts, classed, "form", "left").withColumn("class", F.coalesce("class", "form")), "by-class")
    of = texts.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("changed", "doc_id"))["doc_id"].alias("canonical"), F.count(F.lit(1)).alias("variants"))
    return scratch.put(skew_join(texts, of, "class").select("digest", "doc_id", "class_id", "canonical", "variants"), "classes"), slim.select("doc_id", "digest")


def same_looking(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_a, doc_b) of documents whose texts look the same but differ; doc_a < doc_b. Copies of one text are no pair."""
    texts, members = classes(docs, scratch)
    several = scratch.put(texts.filter("variants > 1").select("digest", "class_id"), "several")
    rows = scratch.put(skew_join(members, several.select("digest"), "digest", "left_semi").distinct(), "members")
    # different texts of a class are paired before their documents are, so copies never meet each other
    a = several.select("class_id", F.col("digest").alias("da"))
    b = several.select("class_id", F.col("digest").alias("db"))
    pairs = scratch.put(skew_join(a, b, "class_id").filter("da < db").select("da", "db"), "pairs")
    own = skew_join(rows.select(F.col("digest").alias("da"), F.col("doc_id").alias("x")), pairs, "da").select("x", "db")
    both = skew_join(own, rows.select(F.col("digest").alias("db"), F.col("doc_id").alias("y")), "db").filter("x <> y")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that look the same but aren't equal character by character."""
    return same_looking(spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "p9"))


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a visible text in its class's one form: whose text that is (form_id), whether it differs from its own, and the text."""
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), Scratch(spark, "p9")
    texts, members = classes(docs, scratch)
    own = skew_join(members, texts.select("digest", F.col("doc_id").alias("first"), "canonical"), "digest")
    out = own.select("doc_id", F.col("canonical").alias("form_id"), (F.col("first") != F.col("canonical")).alias("changed")).distinct()
    out = scratch.put(out, "form-ids")
    wanted = out.filter("changed").select("form_id").distinct()
    changed = docs.join(wanted.withColumnRenamed("form_id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("form_id"), F.col("text").alias("form"))
    changed = scratch.put(changed.distinct(), "changed")
    kept = docs.filter("doc_id IS NOT NULL").distinct().join(out.filter("NOT changed"), "doc_id").select("doc_id", "form_id", "changed", F.col("text").alias("form"))
    return kept.unionByName(skew_join(out.filter("changed"), changed, "form_id").select("doc_id", "form_id", "changed", "form"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every class of several texts that look the same: its smallest document, the one whose text is the form, its different texts and its documents."""
    texts, members = classes(spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "p9"))
    rows = skew_join(members.distinct(), texts.filter("variants > 1").select("digest", "class_id", "canonical", "variants"), "digest")
    return rows.groupBy("class_id", F.col("canonical").alias("form_id"), "variants").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_forms": p9_forms, "p9_classes": p9_classes}


# By rules of its own and letters typed apart from LOOK_ALIKES: full-width forms by arithmetic, spaces and invisible characters by class.
_PLAIN = r"replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
for _a, _b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
_PLAIN = rf"regexp_replace(regexp_replace({_PLAIN}, '[\p{{Cf}}\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{84}}\x{{86}}-\x{{9F}}\x{{FE00}}-\x{{FE0F}}]', '', 'g'), '\p{{Zs}}', ' ', 'g')"
_PLAIN = f"translate({_PLAIN}, '{''.join(map(chr, range(0xFF01, 0xFF5F)))}', '{''.join(map(chr, range(0x21, 0x7F))).replace(chr(39), chr(39) * 2)}')"
_PLAIN = f"""translate({_PLAIN},
  'аеорсухіјѕһԛԝѵӏԁАВЕКМНОРСТХУІЈЅԌԚԜѴӀҮαορνϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿёЁїЇ․‐‑ʼ\u2028\u2029\u0085',
  'aeopcyxijshqwvldABEKMHOPCTXYIJSGQWVIYaopvcjABEZHIKMNOPTYXCJëËïÏ.--’\n\n\n')"""
_SHOWN = f"""t AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, text, text <> {_PLAIN} AS changed, nfc_normalize({_PLAIN}) AS form FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]'))"""

ORACLES = {
    "p9_found": f"WITH {_SHOWN} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM t a JOIN t b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p9_classes": f"""WITH {_SHOWN}
SELECT min(doc_id) AS class_id, min(struct_pack(c := changed, d := doc_id)).d AS form_id, count(DISTINCT text) AS variants, count(*) AS documents FROM t GROUP BY form HAVING count(DISTINCT text) > 1""",
    "p9_forms": f"""WITH {_SHOWN},
c AS (SELECT form, min(struct_pack(c := changed, d := doc_id)).d AS form_id FROM t GROUP BY form)
SELECT t.doc_id, c.form_id, t.text <> o.text AS changed, o.text AS form FROM t JOIN c USING (form) JOIN t o ON o.doc_id = c.form_id""",
}
