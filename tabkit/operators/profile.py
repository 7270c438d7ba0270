"""Field profiles: type, sign style, length and precision of text columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, currency, decimals, guessed_type, sign_style, strip

# Words in a field's name and the type they tell, in the order in which they are looked for.
POSTAL = ["zip", "postal", "postcode"]
YEAR = "year"
MONEY = ["amount", "amt", "total", "balance", "bpi"]
CODES = ["state", "province", "abbr", "code"]

STRICT, PAD_ONLY, SKIP, NULLABLE_INT = "strict", "pad_only", "skip", "nullable_int"


def hint(name: str) -> tuple[str, str] | None:
    """Type and flag that a field's name tells: postal codes, years (as last or later word; blanks allowed), money, codes."""
    lower = name.strip().lower()
    if any(w in lower for w in POSTAL):
        return "str", PAD_ONLY
    if lower.endswith(YEAR) or f" {YEAR}" in lower:
        return "int", NULLABLE_INT
    if any(w in lower for w in MONEY):
        return "float", ""
    return ("str", "") if any(w in lower for w in CODES) else None


def hinted_type(name: str) -> str | None:
    known = hint(name)
    return known and known[0]


def default_flag(kind: str, precision: int = 0) -> str:
    """Integers are strict; floats too once a precision is known; text is only padded."""
    return STRICT if kind == "int" or kind == "float" and precision > 0 else PAD_ONLY


@dataclass
class FieldProfile:
    name: str
    kind: str = "str"
    length: int = 0
    precision: int = 0
    sign: str = "none"
    flag: str = PAD_ONLY

    def __post_init__(self):
        if self.kind not in ("int", "float", "str") or self.flag not in (STRICT, PAD_ONLY, SKIP, NULLABLE_INT):
            raise ValueError(f"bad profile of {self.name!r}: {self.kind}, {self.flag}")


@dataclass
class Profile:
    fields: list[FieldProfile] = field(default_factory=list)

    def of(self, name: str) -> FieldProfile | None:
        return next((f for f in self.fields if f.name == name), None)


def _in_one(df: DataFrame, columns: list[str], measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """field and measures of each column: one aggregate over all columns, turned into rows afterwards."""
    text = {c: F.coalesce(col(c).cast("string"), F.lit("")) for c in columns}
    row = df.agg(*(made(text[c]).alias(f"{i} {name}") for i, c in enumerate(columns) for name, made in measures.items()))
    each = (F.struct(F.lit(c).alias("field"), *(F.col(f"`{i} {name}`").alias(name) for name in measures)) for i, c in enumerate(columns))
    return row.select(F.inline(F.array(*each)))


_LENGTHS = {"max_length": lambda c: F.max(F.length(strip(c))), "max_decimals": lambda c: F.max(decimals(c))}


def lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """field, max_length and max_decimals over all rows."""
    return _in_one(df, columns or df.columns, _LENGTHS)


def amount_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lengths of amounts without $, commas and parentheses."""
    bare = lambda c: F.regexp_replace(strip(c), r"[$,() ]", "")
    return _in_one(df, columns, {"max_length": lambda c: F.max(F.length(bare(c))), "max_decimals": lambda c: F.max(F.when(currency(c).isNotNull(), decimals(bare(c))).otherwise(0))})


TYPES, SIGNS = ["float", "int", "str"], ["leading", "none", "paren", "str", "trailing"]


def _votes(what: Callable[[Column], Column], kinds: list[str]) -> dict[str, Callable[[Column], Column]]:
    return {k: lambda c, k=k: F.count_if((what(c) == k) & (strip(c) != "")) for k in kinds}


def _elected(df: DataFrame, columns: list[str], what: Callable[[Column], Column], kinds: list[str], name: str) -> DataFrame:
    """The most frequent kind of each field's cells that are not blank, of fields that have any; ties go to the first in order."""
    votes = _in_one(df, columns, _votes(what, kinds))
    most = F.greatest(*(F.col(k) for k in kinds))
    first = F.coalesce(*(F.when(F.col(k) == most, F.lit(k)) for k in kinds))
    return votes.where(most > 0).select("field", first.alias(name))


def types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _elected(df, columns or df.columns, guessed_type, TYPES, "kind")


def sign_styles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _elected(df, columns or df.columns, sign_style, SIGNS, "sign")


def sample_head(df: DataFrame, rows: int, order_by: list[str] | None = None) -> DataFrame:
    """The first rows in an order; without one, in the order in which the table is scanned, and no more is read than holds them.

    The head of a file in its own order is ``sources.delimited.head``.
    """
    return (df.orderBy(*map(col, order_by)) if order_by else df).limit(rows)


_STATE = _LENGTHS | {f"t {k}": v for k, v in _votes(guessed_type, TYPES).items()} | {f"s {k}": v for k, v in _votes(sign_style, SIGNS).items()}


def profile_state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What a profile is made of, one row a field: place, longest text, most decimals and votes for types and signs.

    It may be stored, and merged with the states of other rows, so that new
    files are read alone.
    """
    columns = columns or df.columns
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("field"))
    return _in_one(df, columns, _STATE).select(place.alias("place"), "*")


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows together; a field that only some have keeps its least place."""
    all_ = reduce(DataFrame.unionByName, states)
    votes = [F.sum(f"`{k}`").alias(k) for k in _STATE if k not in _LENGTHS]
    return all_.groupBy("field").agg(F.min("place").alias("place"), *(F.max(k).alias(k) for k in _LENGTHS), *votes).select("place", "field", *(f"`{k}`" for k in _STATE))


def profile_of(state: DataFrame, strict: bool = False) -> Profile:
    """A profile of every field of a state, by majority.

    Floats are only padded, as integers of a name that hints at a year may be
    blank; ``strict`` formats floats to the precision found.
    """
    out = []
    for r in sorted(state.collect(), key=lambda r: (r["place"], r["field"])):
        kind = max(TYPES, key=lambda k: r[f"t {k}"]) if any(r[f"t {k}"] for k in TYPES) else "str"
        sign = max(SIGNS, key=lambda k: r[f"s {k}"]) if any(r[f"s {k}"] for k in SIGNS) else "none"
        known = hint(r["field"])
        kind = known[0] if known else kind
        precision = r["max_decimals"] or 0
        flag = known[1] if known and known[1] else default_flag(kind, precision if strict else 0)
        out.append(FieldProfile(r["field"], kind, r["max_length"] or 0, precision, sign, flag))
    return Profile(out)


def build_profile(df: DataFrame, sample_rows: int | None = None, columns: list[str] | None = None, order_by: list[str] | None = None, strict: bool = False) -> Profile:
    """``profile_of`` all rows or a head of them (1: the first row alone), in one aggregate."""
    rows = sample_head(df, sample_rows, order_by) if sample_rows else df
    return profile_of(profile_state(rows, columns), strict)


def blank_profile(columns: list[str]) -> Profile:
    """A template to be filled in: every field is text that is left as it is."""
    return Profile([FieldProfile(c, flag=SKIP) for c in columns])


def problems(profile: Profile, columns: list[str]) -> list[str]:
    """What is wrong with a profile for a table: unknown, missing or repeated fields, and widths that hold nothing."""
    names = [f.name for f in profile.fields]
    out = [f"no field {n!r}" for n in names if n not in columns]
    out += [f"field {c!r} has no profile" for c in columns if c not in names]
    out += [f"field {n!r} is repeated" for n in dict.fromkeys(names) if names.count(n) > 1]
    return out + [f"field {f.name!r}: length {f.length}, precision {f.precision}" for f in profile.fields if f.length < 0 or f.precision < 0 or f.precision > 0 and f.kind != "float"]
