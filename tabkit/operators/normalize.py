"""Rewrite cells to the width, alignment and number format of a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, currency, fixed_precision, integer_text, left_fill, right_fill, strip
from .profile import NULLABLE_INT, PAD_ONLY, SKIP, FieldProfile, Profile


def stream_cell(c: Column, p: FieldProfile) -> Column:
    """Numbers to the right in blanks, text to the left; what does not parse stays as it is."""
    t = strip(c)
    if p.flag == SKIP:
        return c
    if p.flag == PAD_ONLY:
        return right_fill(t, p.length)
    if p.kind == "int":
        n = integer_text(c)
        n = F.coalesce(left_fill(n, p.length, " "), c)
        return F.when(t == "", F.lit("")).otherwise(n) if p.flag == NULLABLE_INT else n
    if p.kind == "float":
        return F.coalesce(left_fill(fixed_precision(currency(c), p.precision, thousands=True), p.length, " "), c)
    return right_fill(t, p.length)


def record_cell(c: Column, p: FieldProfile) -> Column:
    """Numbers with leading zeros; what does not parse is marked."""
    t = strip(c)
    bad = F.concat(F.lit("[ERROR: "), c, F.lit("]"))
    if p.flag == SKIP:
        return c
    if p.kind == "int":
        return F.coalesce(left_fill(integer_text(c), p.length), bad)
    if p.kind == "float":
        return F.coalesce(left_fill(fixed_precision(currency(c), p.precision), p.length), bad)
    return t


def batch_cell(c: Column, p: FieldProfile) -> Column:
    return right_fill(strip(c), p.length)


_MODES = {"stream": stream_cell, "record": record_cell, "batch": batch_cell}


def normalize(df: DataFrame, profile: Profile, mode: str = "stream") -> DataFrame:
    cell, out = _MODES[mode], []
    for c in df.columns:
        p = profile.of(c)
        text = F.coalesce(col(c).cast("string"), F.lit(""))
        out.append(cell(text, p).alias(c) if p else col(c))
    return df.select(*out)


def warnings(df: DataFrame, profile: Profile) -> DataFrame:
    """Cells of each field that do not parse as its type, in one aggregate."""
    out = []
    for p in profile.fields:
        c = F.coalesce(col(p.name).cast("string"), F.lit(""))
        bad = integer_text(c).isNull() if p.kind == "int" else currency(c).isNull() if p.kind == "float" else F.lit(False)
        out.append(F.count_if(bad & (strip(c) != "")).alias(p.name))
    return df.agg(*out)


def change_log(before: DataFrame, profile: Profile, ordinal: str, mode: str = "stream") -> DataFrame:
    """One row a cell: ordinal, field, original, normalized and status."""
    names = [c for c in before.columns if c != ordinal and profile.of(c)]
    cells = F.array(*(F.struct(F.lit(i).alias("field_index"), F.lit(c).alias("field"), F.coalesce(col(c).cast("string"), F.lit("")).alias("original"), _MODES[mode](F.coalesce(col(c).cast("string"), F.lit("")), profile.of(c)).alias("normalized")) for i, c in enumerate(names)))
    long = before.select(col(ordinal).alias("record_index"), F.inline(cells))
    return long.withColumn("status", F.when(F.col("original") == F.col("normalized"), "same").otherwise("changed"))
