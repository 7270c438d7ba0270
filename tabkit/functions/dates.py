"""Date parsing: strptime formats, spreadsheet serials and Julian days, for literals and columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

EXCEL, JULIAN, PREFIXED_JULIAN = "excel", "julian", "prefixed_julian"
#: strptime directives and Spark's pattern letters that take one or two digits.
_DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "h", "%j": "D", "%%": "%"}
#: Formats that a date cell of unknown form is tried with, in order.
LIKELY = ["%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%Y%m%d", "%m/%d/%y"]


def spark_pattern(strptime: str) -> str:
    out, i, quoted = [], 0, ""
    while i < len(strptime):
        two = strptime[i : i + 2]
        if two in _DIRECTIVES:
            out.append((f"'{quoted}'" if quoted else "") + _DIRECTIVES[two])
            quoted, i = "", i + 2
        elif strptime[i].isalpha():
            quoted, i = quoted + strptime[i], i + 1
        else:
            out.append((f"'{quoted}'" if quoted else "") + strptime[i])
            quoted, i = "", i + 1
    return "".join(out) + (f"'{quoted}'" if quoted else "")


def parsed(c: Column | str, form: str) -> Column:
    """The timestamp (without zone) of a text column, or null."""
    t = strip(c)
    if form == EXCEL:
        day = F.when(t.rlike(r"^\d{1,6}$"), F.date_add(F.lit(dt.date(1899, 12, 30)), t.try_cast("int")))
    elif form in (JULIAN, PREFIXED_JULIAN):
        digits = F.regexp_replace(t, r"\D", "") if form == PREFIXED_JULIAN else t
        ok = digits.rlike(r"^\d{5}$") & F.substring(digits, 3, 3).try_cast("int").between(1, 366)
        year = F.lit(2000) + F.substring(digits, 1, 2).try_cast("int")
        day = F.when(ok, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.substring(digits, 3, 3).try_cast("int") - 1))
        day = F.when(F.year(day) == year, day)
    else:
        return F.try_to_timestamp(t, F.lit(spark_pattern(form))).cast("timestamp_ntz")
    return day.cast("timestamp_ntz")


def parse_literal(text: str, form: str) -> dt.datetime:
    """The same rules for a literal; bad text raises ValueError."""
    text = text.strip()
    if form == EXCEL:
        return dt.datetime(1899, 12, 30) + dt.timedelta(days=int(text))
    if form in (JULIAN, PREFIXED_JULIAN):
        digits = "".join(ch for ch in text if ch.isdigit()) if form == PREFIXED_JULIAN else text
        return dt.datetime.strptime("20" + digits, "%Y%j")
    return dt.datetime.strptime(text, form)


def likely_date(c: Column | str) -> Column:
    """A date in one of the likely formats; points and dashes read as slashes, a time is dropped."""
    t = F.regexp_replace(F.element_at(F.split(strip(c), r"[ T]"), 1), r"[.\-]", "/")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(spark_pattern(f))).cast("date") for f in LIKELY))


def timestamp(c: Column | str) -> Column:
    return col(c).cast("timestamp_ntz")
