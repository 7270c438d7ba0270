"""Match rows by normalised composite keys: semi and anti joins, splits, lookups.

No side is broadcast by hand: Spark broadcasts a key side whose size it knows
to be small, and otherwise sorts and merges, splitting skewed keys at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import UnknownField, unique_name
from ..functions.text import clean_cell, col, is_digits, is_whole, strip, zero_fill_digits
from .columns import drop_blank_rows
from .ordering import numbered_within


@dataclass(frozen=True)
class KeyStyle:
    """How key cells are normalised.  widths: per key field, for digits; None learns them from the key side, in lookups from both."""

    ignore_case: bool = True
    trim: bool = True
    clean: bool = False
    zero_pad: bool = False
    widths: tuple[int, ...] | None = None


#: Named styles: ``clean`` deletes invisible characters and takes compatibility forms; ``trim_pad`` trims and pads digits
#: (both as splits and merges by key do); ``record`` and ``denorm`` take cells as they are but for edge blanks, with and without case.
PROFILES = {
    "key_clean": KeyStyle(clean=True, zero_pad=True),
    "key_trim_pad": KeyStyle(zero_pad=True),
    "key_record": KeyStyle(ignore_case=False),
    "key_denorm": KeyStyle(),
}


def key_cell(c: Column | str, style: KeyStyle, width: int = 0, kind: str = "string") -> Column:
    """``kind`` is the column's type; whole numbers need no cleaning."""
    t = F.coalesce(col(c).cast("string"), F.lit(""))
    if is_whole(kind):
        return zero_fill_digits(t, width) if style.zero_pad and width else t
    t = clean_cell(t) if style.clean else strip(t) if style.trim else t
    t = F.lower(t) if style.ignore_case else t
    return zero_fill_digits(t, width) if style.zero_pad and width else t


def learn_widths(key: DataFrame, fields: list[str], style: KeyStyle) -> tuple[int, ...]:
    """The longest digit cell of each key field, in one aggregate."""
    kinds = dict(key.dtypes)
    cells = [key_cell(f, style, kind=kinds[f]) for f in fields]
    row = key.agg(*(F.max(F.when(is_digits(c), F.length(c))).alias(f"w{i}") for i, c in enumerate(cells))).first()
    return tuple(row[i] or 0 for i in range(len(fields)))


def keyed(df: DataFrame, fields: list[str], style: KeyStyle, widths: tuple[int, ...]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("*", *(key_cell(f, style, w, kinds[f]).alias(f"__k{i}") for i, (f, w) in enumerate(zip(fields, widths, strict=True))))


def _sides(main: DataFrame, key: DataFrame, on: list[tuple[str, str]], style: KeyStyle) -> tuple[DataFrame, DataFrame, list[str]]:
    left, right = [m for m, _ in on], [k for _, k in on]
    widths = (style.widths or learn_widths(key, right, style)) if style.zero_pad else (0,) * len(on)
    return keyed(main, left, style, widths), keyed(key, right, style, widths), [f"__k{i}" for i in range(len(on))]


def keep_matching(main: DataFrame, key: DataFrame, on: list[tuple[str, str]], style: KeyStyle = KeyStyle()) -> DataFrame:
    """Rows of main whose key occurs in key; none is repeated."""
    m, k, names = _sides(main, key, on, style)
    return m.join(k.select(names), names, "left_semi").select(*map(col, main.columns))


def keep_nonmatching(main: DataFrame, key: DataFrame, on: list[tuple[str, str]], style: KeyStyle = KeyStyle()) -> DataFrame:
    m, k, names = _sides(main, key, on, style)
    return m.join(k.select(names), names, "left_anti").select(*map(col, main.columns))


def merge_by_key(main: DataFrame, key: DataFrame, on: list[tuple[str, str]], mode: str = "inner", style: KeyStyle = KeyStyle()) -> DataFrame:
    return (keep_nonmatching if mode == "anti" else keep_matching)(main, key, on, style)


def flag_by_key(main: DataFrame, key: DataFrame, on: list[tuple[str, str]], style: KeyStyle = KeyStyle(), name: str = "matched") -> DataFrame:
    """Both sides of a split in one scan of main."""
    m, k, names = _sides(main, key, on, style)
    k = k.select(*names, F.lit(True).alias("__hit")).distinct()
    return m.join(k, names, "left").select(*map(col, main.columns), F.coalesce("__hit", F.lit(False)).alias(name))


def split_by_key(main: DataFrame, key: DataFrame, on: list[tuple[str, str]], style: KeyStyle = KeyStyle(), skip_blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of main with and without their key; rows of blank cells alone are in neither, unless asked for."""
    main = drop_blank_rows(main) if skip_blank else main
    return keep_matching(main, key, on, style), keep_nonmatching(main, key, on, style)


def distinct_keys(key: DataFrame, fields: list[str], style: KeyStyle = KeyStyle()) -> DataFrame:
    cells = [key_cell(f, style).alias(f"__k{i}") for i, f in enumerate(fields)]
    return key.select(*cells).distinct().agg(F.count("*").alias("distinct_keys"))


def lookup(main: DataFrame, table: DataFrame, on: list[tuple[str, str]], append: list[str], order_by: list[str], mode: str = "first", style: KeyStyle = KeyStyle(), main_order: list[str] | None = None) -> DataFrame:
    """Append columns of a lookup table.

    first: the first lookup row of a key, unmatched rows go.  all: every
    lookup row, unmatched rows stay with matched false.  fifo: the k-th row of
    a key takes the k-th lookup row of it, unmatched rows stay.
    """
    if style.zero_pad and style.widths is None:
        both = learn_widths(main, [k for k, _ in on], style), learn_widths(table, [k for _, k in on], style)
        style = replace(style, widths=tuple(map(max, *both)))
    m, t, names = _sides(main, table, on, style)
    new = {a: unique_name(a, main.columns) for a in append}
    t = t.select(*names, *map(col, dict.fromkeys(order_by)), *(col(a).alias(f"__a{i}") for i, a in enumerate(append)))
    out = [col(c) for c in main.columns]
    added = [F.col(f"__a{i}").alias(new[a]) for i, a in enumerate(append)]
    if mode == "first":
        # the least row of each key by partial aggregation, with no sort of the table
        firsts = t.groupBy(*names).agg(F.min_by(F.struct(*(f"__a{i}" for i in range(len(append)))), F.struct(*map(col, order_by))).alias("__row"))
        picked = [F.col(f"__row.__a{i}").alias(new[a]) for i, a in enumerate(append)]
        return m.join(firsts, names).select(*out, *picked)
    if mode == "all":
        t = t.select(*names, *(f"__a{i}" for i in range(len(append))), F.lit(True).alias("__hit"))
        return m.join(t, names, "left").select(*out, *added, F.coalesce("__hit", F.lit(False)).alias(unique_name("matched", [*main.columns, *new.values()])))
    t = numbered_within(t, names, [*map(col, order_by)], "__n").select(*names, *(f"__a{i}" for i in range(len(append))), "__n")
    m = numbered_within(m, names, [*map(col, main_order or order_by)], "__n")
    return m.join(t, [*names, "__n"], "left").select(*out, *added)


def lookup_sorted(main: DataFrame, table: DataFrame, on: list[tuple[str, str]], append: list[str], order_by: list[str], mode: str = "first", style: KeyStyle = KeyStyle()) -> DataFrame:
    """A lookup in the order of main's padded keys."""
    widths = (0,) * len(on)
    if style.zero_pad:
        widths = style.widths or tuple(map(max, learn_widths(main, [m for m, _ in on], style), learn_widths(table, [k for _, k in on], style)))
        style = replace(style, widths=widths)
    out = lookup(main, table, on, append, order_by, mode, style)
    kinds = dict(out.dtypes)
    return out.orderBy(*(key_cell(m, style, w, kinds[m]) for (m, _), w in zip(on, widths, strict=True)))


def lookup_counts(main: DataFrame, table: DataFrame, on: list[tuple[str, str]], style: KeyStyle = KeyStyle()) -> DataFrame:
    """How many rows of main a lookup finds and misses."""
    both = match_counts(flag_by_key(main, table, on, style))
    return both.select("rows_read", F.col("rows_matched").alias("hits"), F.col("rows_nonmatched").alias("misses"))


def lookup_table(df: DataFrame, keys: list[str], append: list[str]) -> DataFrame:
    """A loaded table as a lookup table: its key and appended fields alone, trimmed; fields must exist, rows with a missing cell go."""
    if missing := [f for f in (*keys, *append) if f not in df.columns]:
        raise UnknownField(f"no fields {missing} in {df.columns}")
    names = list(dict.fromkeys((*keys, *append)))
    return df.select(*(strip(col(f).cast("string")).alias(f) for f in names)).na.drop()


def match_counts(flagged: DataFrame, name: str = "matched") -> DataFrame:
    return flagged.agg(F.count("*").alias("rows_read"), F.count_if(col(name)).alias("rows_matched"), F.count_if(~col(name)).alias("rows_nonmatched"))
