"""Column expressions for cell text.  All stay in the JVM but NFKC, which Spark lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that are deleted from cells (BOM, no-break space, zero-width marks).
INVISIBLE = "\ufeff\u00a0\u200b\u200c\u200d"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_numeric(kind: str) -> bool:
    """Whether a Spark type, by its short name, holds numbers."""
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def is_whole(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint")


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space, not spaces alone."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def delete_invisible(c: Column | str) -> Column:
    return F.translate(col(c), INVISIBLE, "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(c: Column | str) -> Column:
    """Compatibility normal form, by Arrow batches."""
    return _nfkc(col(c))


def clean_cell(c: Column | str, normal_form: bool = True) -> Column:
    """Delete invisible characters, normalise, trim; null becomes empty."""
    c = delete_invisible(F.coalesce(col(c), F.lit("")))
    return strip(nfkc(c) if normal_form else c)


def strip_quotes(c: Column | str) -> Column:
    """Drop double quotes at both ends, then single ones."""
    return F.regexp_replace(F.regexp_replace(col(c), r'^"+|"+$', ""), r"^'+|'+$", "")


def is_digits(c: Column | str) -> Column:
    return col(c).rlike(r"^\p{Nd}+$")


def left_fill(c: Column | str, width: int | Column, fill: str = "0") -> Column:
    """Pad on the left; never cuts."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(col(c)) < w, F.lpad(col(c), w, F.lit(fill))).otherwise(col(c))


def right_fill(c: Column | str, width: int | Column, fill: str = " ") -> Column:
    """Pad on the right; never cuts."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(col(c)) < w, F.rpad(col(c), w, F.lit(fill))).otherwise(col(c))


def zero_fill_digits(c: Column | str, width: int | Column) -> Column:
    return F.when(is_digits(c), left_fill(c, width)).otherwise(col(c))


def number(c: Column | str) -> Column:
    """The double a cell spells, or null; suffixes such as 1d are no numbers."""
    t = strip(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def exact_order(c: Column | str) -> list[Column]:
    """Keys that sort the numbers which cells spell by their exact value, however many digits they have: sign, place of the first digit, digits.

    A number is 0.d1d2d3... times ten to a power; of negative ones the power is
    negated and digits are taken from nine, with an end sign above all digits.
    Infinities have the greatest power; a written power beyond 2**61 counts as that;
    what is no number, and nan, has the sign 2.
    """
    t = F.lower(strip(c))
    far, written = F.lit(1 << 62), F.regexp_extract(t, r"e([+-]?\d+)$", 1)
    power = F.coalesce(F.when(written == "", F.lit(0)), F.greatest(F.least(written.try_cast("long"), far / F.lit(2)), -far / F.lit(2)).cast("long"), F.when(written.startswith("-"), -far / F.lit(2)).otherwise(far / F.lit(2)).cast("long"))
    mantissa = F.regexp_replace(t, "^[+-]|e.*$", "")
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    bare = F.ltrim(F.concat(whole, part), F.lit("0"))
    digits = F.rtrim(bare, F.lit("0"))
    place = power + F.length(whole) - (F.length(whole) + F.length(part) - F.length(bare))
    endless, finite = t.rlike("^[+-]?inf"), t.rlike(_NUMBER) & ~t.rlike("n")
    down = t.startswith("-")
    sign = F.when(endless | (finite & (digits != "")), F.when(down, -1).otherwise(1)).when(finite, 0).otherwise(2)
    place = F.when(endless, far).when(finite & (digits != ""), place.cast("long"))
    text = F.when(finite & (digits != ""), F.when(down, F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~"))).otherwise(digits))
    return [sign, F.when(down, -place).otherwise(place), text]


def integer_text(c: Column | str) -> Column:
    """An integer in canonical form, or null."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("decimal(38,0)").cast("string"))


def currency(c: Column | str) -> Column:
    """The double of an amount: $ and commas dropped, parentheses negate."""
    t = strip(c)
    bare = F.regexp_replace(t, r"[$,() ]", "")
    v = number(bare)
    return F.when(t.rlike(r"^\(.*\)$"), -F.abs(v)).otherwise(v)


def fixed_precision(v: Column, digits: int, thousands: bool = False) -> Column:
    return F.format_number(v, digits) if thousands else F.round(v.cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def replace_text(c: Column | str, old: str, new: str, case_sensitive: bool) -> Column:
    """Replace a substring; old and new are literal."""
    if case_sensitive:
        return F.replace(col(c), F.lit(old), F.lit(new))
    quoted = "(?iu)\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(col(c), quoted, new.replace("\\", "\\\\").replace("$", "\\$"))


def guessed_type(c: Column | str) -> Column:
    """int, float or str; a quoted cell is str."""
    t = strip(c)
    return F.when(t.rlike(r'^".*"$|^\'.*\'$'), "str").when(t.rlike(r"^[+-]?\d+$"), "int").when(F.regexp_replace(t, r"[$,() ]", "").rlike(r"^[+-]?(\d+\.\d*|\.\d+)$") & t.contains("."), "float").otherwise("str")


def sign_style(c: Column | str) -> Column:
    """leading, trailing, paren, none, or str for what is no number."""
    t = F.regexp_replace(strip(c), r"[$, ]", "")
    body = r"(\d+\.?\d*|\.\d+)"
    return F.when(t.rlike(rf"^\({body}\)$"), "paren").when(t.rlike(rf"^[+-]{body}$"), "leading").when(t.rlike(rf"^{body}[+-]$"), "trailing").when(t.rlike(rf"^{body}$"), "none").otherwise("str")


def decimals(c: Column | str) -> Column:
    """Digits after the point, zeros at the end left out."""
    t = strip(c)
    return F.when(t.contains("."), F.length(F.rtrim(F.regexp_replace(F.element_at(F.split(t, r"\."), -1), r"[^0-9]", ""), F.lit("0")))).otherwise(0)


def chunks(text: str, width: int = 80) -> list[str]:
    return [text[i : i + width] for i in range(0, len(text), width)] or [""]


def ruler(width: int = 80) -> str:
    return "".join(str(i // 10 % 10) if i % 10 == 0 else "." for i in range(1, width + 1))


def mismatch_mask(a: str, b: str) -> str:
    """~ where two texts differ, blank elsewhere."""
    n = max(len(a), len(b))
    return "".join(" " if x == y else "~" for x, y in zip(a.ljust(n, "\0"), b.ljust(n, "\0"), strict=True))
