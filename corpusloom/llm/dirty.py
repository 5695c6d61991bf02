"""Cleaning of the values that several problems share; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How people write "nothing here".
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "todo", "unassigned", "unknown"]


def stripped(c: Column) -> Column:
    """Without outer blanks of any kind, invisible ones included."""
    return F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")


def filled_text(c: Column) -> Column:
    """The stripped text, or null if it is a placeholder."""
    s = stripped(c)
    return F.when(~F.lower(s).isin(PLACEHOLDERS), s)


def group_name(c: Column) -> Column:
    """One spelling of a group: DG_ and eight lower-case hex digits, SG_ and the number; null if it names none."""
    s = F.upper(filled_text(c))
    dg, sg = F.regexp_extract(s, r"^DG[\s_-]*([0-9A-F]{1,8})$", 1), F.regexp_extract(s, r"^SG[\s_-]*0*([0-9]+)$", 1)
    return (
        F.when(dg != "", F.concat(F.lit("DG_"), F.lower(F.lpad(dg, 8, "0"))))
        .when(sg != "", F.concat(F.lit("SG_"), sg))
        .otherwise(F.regexp_replace(s, r"[\s_-]+", "_"))
    )


def split_name(c: Column) -> Column:
    """train, val or test, whichever the value spells in its usual forms; null for anything else."""
    s = F.lower(stripped(c))
    return F.when(s.isin("train", "training", "trn"), "train").when(s.isin("val", "valid", "validation"), "val").when(s.isin("test", "testing", "tst"), "test")


def source_name(source: Column, image_id: Column) -> Column:
    """The corpus in lower case; where it is missing, the beginning of image_id."""
    s = F.lower(filled_text(source))
    return F.coalesce(s, F.lower(F.regexp_extract(image_id, r"^[\s./\\]*([^/\\]+)[/\\]", 1)))


def breed_name(c: Column) -> Column:
    """A canonical breed in one spelling; null for placeholders. Names such as __CAT_OOD__ are kept."""
    s = filled_text(c)
    return F.when(s.rlike("^__.*__$"), s).otherwise(F.regexp_replace(F.lower(s), r"[\s_-]+", "_"))
