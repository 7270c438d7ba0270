"""Filter rules as Spark predicates.  A rule that cannot be judged is false, never null.

On typed columns rules are plain comparisons with literals, which reach the
scan; only text columns are parsed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates
from .fields import resolve
from .text import col, is_numeric, number, strip, strip_quotes


@dataclass(frozen=True)
class Flags:
    case_sensitive: bool = False
    strip_quotes: bool = False
    trim: bool = True


@dataclass(frozen=True)
class TextRule:
    """equals, contains or starts_with one of the values."""

    field: str
    operator: str
    values: tuple[str, ...]

    def column(self, df: DataFrame, flags: Flags) -> Column:
        c = col(resolve(df.columns, self.field)).cast("string")
        values = [str(v) for v in self.values]
        if flags.trim:
            c, values = strip(c), [v.strip() for v in values]
        if flags.strip_quotes:
            c, values = strip_quotes(c), [v.strip('"').strip("'") for v in values]
        if not flags.case_sensitive:
            c, values = F.lower(c), [v.lower() for v in values]
        if self.operator == "equals":
            return c.isin(values)
        test = {"contains": c.contains, "starts_with": c.startswith}[self.operator]
        return reduce(lambda a, b: a | b, (test(v) for v in values), F.lit(False))


@dataclass(frozen=True)
class NumericRule:
    """A comparison with one value, or two for between (both included)."""

    field: str
    operator: str
    value: float
    upper: float | None = None

    def column(self, df: DataFrame, flags: Flags) -> Column:
        name = resolve(df.columns, self.field)
        if is_numeric(dict(df.dtypes)[name]):
            x, v = col(name), self.value
            made = {"between": x.between(v, self.upper), "equals": x == v, "greater_than": x > v, "greater_than_or_equal": x >= v, "less_than": x < v, "less_than_or_equal": x <= v}
            return made[self.operator]
        x, v = number(col(name).cast("string")), F.lit(float(self.value))
        nan = F.isnan(x)
        if self.operator == "between":
            return x.between(v, F.lit(float(self.upper))) & ~nan
        if self.operator == "equals":
            return (x == v) & ~nan
        above = {"greater_than": x > v, "greater_than_or_equal": x >= v, "less_than": x < v, "less_than_or_equal": x <= v}
        return nan | above[self.operator]  # text that spells NaN passes these four


@dataclass(frozen=True)
class DateRule:
    """exact (by day), before, after (both including the day's instant) or range."""

    field: str
    operator: str
    value: str
    upper: str | None = None
    format: str = "%Y-%m-%d"

    def column(self, df: DataFrame, flags: Flags) -> Column:
        name = resolve(df.columns, self.field)
        kind = dict(df.dtypes)[name]
        typed = kind in ("date", "timestamp", "timestamp_ntz")
        t = col(name) if typed else dates.parsed(col(name).cast("string"), self.format)
        as_kind = "timestamp" if kind == "timestamp" else "timestamp_ntz"
        at = self._literal(self.value).cast(as_kind)
        if self.operator == "exact":
            day = dates.parse_literal(self.value, self.format).replace(hour=0, minute=0, second=0, microsecond=0)
            return (t >= _instant(day).cast(as_kind)) & (t < _instant(day + dt.timedelta(days=1)).cast(as_kind))
        if self.operator == "before":
            return t <= at
        if self.operator == "after":
            return t >= at
        return (t >= at) & (t <= self._literal(self.upper).cast(as_kind))

    def _literal(self, text: str) -> Column:
        return _instant(dates.parse_literal(text, self.format))


def _instant(value: dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


Rule = TextRule | NumericRule | DateRule


@dataclass(frozen=True)
class RuleSet:
    """Rules that must all hold; values within a rule are alternatives."""

    rules: tuple[Rule, ...]
    flags: Flags = field(default_factory=Flags)

    def condition(self, df: DataFrame) -> Column:
        """The bare conjunction, for a filter, where null is as good as false."""
        return reduce(lambda a, b: a & b, (r.column(df, self.flags) for r in self.rules))

    def column(self, df: DataFrame) -> Column:
        """Never null, to be negated or kept."""
        return reduce(lambda a, b: a & b, (F.coalesce(r.column(df, self.flags), F.lit(False)) for r in self.rules), F.lit(True))


def rule(kind: str, **values) -> Rule:
    """A rule of kind text, numeric or date from plain values, as job files have them."""
    made = {"text": TextRule, "numeric": NumericRule, "date": DateRule}[kind]
    if "values" in values:
        v = values["values"]
        values["values"] = tuple(x.strip() for x in v.split(",")) if isinstance(v, str) else tuple(v)
    return made(**values)
