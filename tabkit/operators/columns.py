"""Choose, add and rewrite columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import UnknownField, resolve, unique_name
from ..functions.text import clean_cell, col, number, replace_text, strip, strip_quotes


def choose_columns(df: DataFrame, names: list[str | int], ignore_case: bool = True, clean: bool = False, from_one: bool = False) -> tuple[DataFrame, list[str]]:
    """An ordered choice, repeats allowed, and warnings; a choice of nothing raises.

    Whole numbers are places from 0.  ``from_one``: digits as text are places
    from 1, as tables without a header have them.
    """
    picked, warnings, taken = [], [], []
    for n in names:
        if from_one and isinstance(n, str) and n.strip().isdigit():
            n = int(n) - 1
        try:
            source = df.columns[n] if isinstance(n, int) and 0 <= n < len(df.columns) else resolve(df.columns, n, ignore_case)
        except UnknownField:
            warnings.append(f"no field {n!r}: left out")
            continue
        alias = unique_name(source, taken)
        taken.append(alias)
        picked.append((clean_cell(col(source).cast("string")) if clean else col(source)).alias(alias))
    if not picked:
        raise UnknownField("none of the fields exists")
    return df.select(*picked), warnings


def chosen_again(df: DataFrame, names: list[str | int], ignore_case: bool = True) -> int:
    """How many of the fields chosen are repeats."""
    found = []
    for n in names:
        try:
            found.append(df.columns[n] if isinstance(n, int) and 0 <= n < len(df.columns) else resolve(df.columns, n, ignore_case))
        except UnknownField:
            continue
    return len(found) - len(set(found))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.concat_ws("", *(strip(F.coalesce(col(c).cast("string"), F.lit(""))) for c in df.columns)) != "")


def fill_missing(df: DataFrame) -> DataFrame:
    """Empty text in place of null text."""
    return df.select(*(F.coalesce(col(c), F.lit("")).alias(c) if t == "string" else col(c) for c, t in df.dtypes))


def clean_cells(df: DataFrame, normal_form: bool = True) -> DataFrame:
    return df.select(*(clean_cell(c, normal_form).alias(c) if t == "string" else col(c) for c, t in df.dtypes))


#: The column that a constant without a name or value makes.
FIXED = {"APPENDED": "Stub"}


def add_constant(df: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    for name, v in (values or FIXED).items():
        df = df.withColumn(unique_name(name, df.columns), F.lit(v))
    return df


def add_fixed_row(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """One more row, with a value for each field named (case does not count) and none for others."""
    own = {resolve(df.columns, k, True): v for k, v in values.items()}
    row = df.sparkSession.range(1).select(*(F.lit(own.get(c)).cast(t).alias(c) for c, t in df.dtypes))
    return df.unionAll(row)


def text_condition(df: DataFrame, field: str, text: str) -> Column:
    return F.lower(col(resolve(df.columns, field)).cast("string")).contains(text.lower())


def numeric_condition(df: DataFrame, field: str, operator: str, value: float) -> Column:
    name = resolve(df.columns, field)
    x = number(col(name)) if dict(df.dtypes)[name] == "string" else col(name).cast("double")
    return {">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value, "==": x == value, "!=": x != value}[operator]


def add_conditional(df: DataFrame, values: dict[str, str], condition: Column, otherwise: str = "") -> DataFrame:
    """New columns with a value where the condition holds; what cannot be judged gets the other."""
    for name, v in values.items():
        df = df.withColumn(unique_name(name, df.columns), F.when(condition, F.lit(v)).otherwise(F.lit(otherwise)))
    return df


def add_date_part(df: DataFrame, name: str, field: str, part: str) -> DataFrame:
    made = {"year": F.year, "month": F.month, "day": F.day}[part](col(resolve(df.columns, field)))
    return df.withColumn(unique_name(name, df.columns), made)


def add_range_label(df: DataFrame, name: str, field: str, ranges: list[tuple[float, float, str]], otherwise: str = "") -> DataFrame:
    """The label of the first range (both ends included) that holds the value."""
    x = number(col(resolve(df.columns, field)).cast("string"))
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in ranges:
        out = out.when(x.between(low, high), F.lit(label))
    return df.withColumn(unique_name(name, df.columns), out.otherwise(F.lit(otherwise)))


def add_membership(df: DataFrame, name: str, field: str, values: list[str], label: str = "Y", otherwise: str = "", ignore_case: bool = True) -> DataFrame:
    """A label where the trimmed cell is in a list."""
    c = strip(col(resolve(df.columns, field)).cast("string"))
    own = [v.strip().lower() if ignore_case else v.strip() for v in values]
    hit = (F.lower(c) if ignore_case else c).isin(own)
    return df.withColumn(unique_name(name, df.columns), F.when(hit, F.lit(label)).otherwise(F.lit(otherwise)))


@dataclass(frozen=True)
class Replacement:
    field: str
    old: str
    new: str
    exact: bool = True
    case_sensitive: bool = False
    strip_quotes: bool = False


def replace_values(df: DataFrame, rules: list[Replacement]) -> tuple[DataFrame, list[str]]:
    """Apply rules in order; an exact rule replaces a whole cell, another a part of the trimmed cell."""
    warnings = []
    for r in rules:
        try:
            name = resolve(df.columns, r.field)
        except UnknownField:
            warnings.append(f"no field {r.field!r}: rule left out")
            continue
        c = col(name)
        t = strip(c)
        if r.exact:
            a, b = (strip_quotes(t), r.old.strip('"').strip("'")) if r.strip_quotes else (t, r.old)
            same = a == F.lit(b) if r.case_sensitive else F.lower(a) == F.lit(b.lower())
            new = F.when(same, F.lit(r.new)).otherwise(c)
        else:
            has = t.contains(r.old) if r.case_sensitive else F.lower(t).contains(r.old.lower())
            new = F.when(has, replace_text(t, r.old, r.new, r.case_sensitive)).otherwise(c)
        df = df.withColumn(name, new)
    return df, warnings


def changed_rows(before: DataFrame, rules: list[Replacement]) -> DataFrame:
    """How many rows the rules change, in one scan."""
    after, _ = replace_values(before.select("*", F.struct(*map(col, before.columns)).alias("__old")), rules)
    return after.agg(F.count_if(~F.col("__old").eqNullSafe(F.struct(*map(col, before.columns)))).alias("rows_changed"), F.count("*").alias("rows_read"))
