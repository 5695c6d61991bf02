"""Names, paths and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frozen set of canonical breeds; ids are positions in this order.
CANONICAL = (
    "basset", "beagle", "bichon_frise", "border_collie", "chihuahua", "cocker_spaniel", "corgi", "french_bulldog", "german_shepherd",
    "golden_retriever", "labrador_retriever", "malamute", "maltese_dog", "miniature_pinscher", "miniature_schnauzer", "papillon", "pomeranian",
    "poodle", "pug", "samoyed", "shiba_inu", "shih_tzu", "siberian_husky", "staffordshire_bullterrier", "yorkshire_terrier",
)
# Labels that are renamed, dropped or left out after spelling is made even.
RENAMED = {
    "toy_poodle": "poodle",
    "miniature_poodle": "poodle",
    "standard_poodle": "poodle",
    "teddy": "poodle",
    "shiba_dog": "shiba_inu",
    "cardigan": "corgi",
    "pembroke": "corgi",
    "staffordshire_bull_terrier": "staffordshire_bullterrier",
    "basset_hound": "basset",
    "shih-tzu": "shih_tzu",
    "maltese": "maltese_dog",
    "chinese_rural_dog": "__DROP__",
    "english_cocker_spaniel": "__NOT_MVP__",
}
CAT_PREFIX, CAT_LABEL, DROP, NOT_LISTED = "CAT_", "__CAT_OOD__", "__DROP__", "__NOT_MVP__"


def source_of(image_id: Column) -> Column:
    """The corpus that an image id begins with."""
    return F.split_part(image_id, F.lit("/"), F.lit(1))


def file_name(path: Column) -> Column:
    """The last part of a path with either separator."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def folder_name(path: Column) -> Column:
    """The last but one part of a path, null if there is none."""
    return F.try_element_at(F.split(path, r"[/\\]"), F.lit(-2))


def stem(name: Column) -> Column:
    """A file name without its last extension; names that only begin with a dot have none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def after_dashes(folder: Column, parts: int) -> Column:
    """What follows the first ``parts - 1`` dashes, or the last part if there are fewer."""
    return F.element_at(F.split(folder, "-", parts), -1)


def before_last_underscore(name: Column) -> Column:
    """A name up to its last underscore; all of it if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*)_[^_]*$", 1), F.lit("")), name)


def even_label(label: Column) -> Column:
    """Lower case, dashes and blanks as underscores."""
    return F.translate(F.lower(label), "- ", "__")


def canonical(label: Column) -> Column:
    """The canonical label: even spelling, then the renames. Cats have one label of their own."""
    even = even_label(label)
    table = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    return F.when(label.startswith(CAT_PREFIX), CAT_LABEL).otherwise(F.coalesce(F.try_element_at(table, even), even))


def breed_number(name: Column) -> Column:
    """Position in the frozen set, null for other labels."""
    found = F.array_position(F.array(*map(F.lit, CANONICAL)), name)
    return F.when(found > 0, (found - 1).cast("int"))


def hash_bits(hex_: Column) -> Column:
    """A 64-bit hash as a signed number; null if it is not 16 hex digits."""
    return F.when(hex_.rlike("^[0-9a-fA-F]{16}$"), F.conv(hex_, 16, -10).cast("bigint"))
