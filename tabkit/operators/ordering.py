"""Sorting and de-duplication by chosen fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, exact_order, is_numeric, number, strip
from .checkpoints import written


def sort_keys(fields: list[str], numeric_aware: bool = True, df: DataFrame | None = None) -> list[Column]:
    """Blanks, then numbers by their exact value, then text; or plain text with nulls last.  Numeric columns of ``df`` are their own keys."""
    if not numeric_aware:
        return [col(f).cast("string").asc_nulls_last() for f in fields]
    kinds = dict(df.dtypes) if df is not None else {}
    out = []
    for f in fields:
        if is_numeric(kinds.get(f, "string")):
            out.append(col(f))
            continue
        t = strip(F.coalesce(col(f).cast("string"), F.lit("")))
        n = number(t)
        out += [F.when(t == "", 0).when(n.isNotNull(), 1).otherwise(2), *(F.when(n.isNotNull(), k) for k in exact_order(t)), F.when(n.isNull(), t)]
    return out


def sort_records(df: DataFrame, fields: list[str], numeric_aware: bool = True, ordinal: list[str] | None = None, descending: bool | list[bool] = False, nulls_first: bool | None = None) -> DataFrame:
    """A total order; ``ordinal`` fields keep the order of equal rows.

    ``descending`` is for all fields or one each.  ``nulls_first`` puts null
    cells before or after all others, whatever the direction; without it blanks
    come first in numeric-aware order and last in plain order.
    """
    down = descending if isinstance(descending, list) else [descending] * len(fields)
    if len(down) != len(fields):
        raise ValueError(f"{len(fields)} fields, {len(down)} directions")
    keys = []
    for f, turned in zip(fields, down, strict=True):
        if nulls_first is not None:
            keys.append(col(f).isNull().desc() if nulls_first else col(f).isNull().asc())
        if numeric_aware:
            keys += [k.desc() if turned else k for k in sort_keys([f], True, df)]
        else:
            keys.append(col(f).cast("string").desc_nulls_last() if turned else col(f).cast("string").asc_nulls_last())
    return df.orderBy(*keys, *map(col, ordinal or []))


def top_records(df: DataFrame, fields: list[str], n: int, numeric_aware: bool = True, ordinal: list[str] | None = None) -> DataFrame:
    return sort_records(df, fields, numeric_aware, ordinal).limit(n)


def dedupe_key(f: str) -> Column:
    return F.lower(strip(F.coalesce(col(f).cast("string"), F.lit(""))))


def dedupe_first(df: DataFrame, fields: list[str], order_by: list[str], rewrite_keys: bool = False) -> DataFrame:
    """The first row of each key: least rows are found by partial aggregation, without a sort."""
    keys = [dedupe_key(f).alias(f"__k{i}") for i, f in enumerate(fields)]
    row = F.struct(*map(col, df.columns))
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*map(col, order_by))).alias("__row"))
    kept = {f: F.col(f"__k{i}") for i, f in enumerate(fields)} if rewrite_keys else {}
    return first.select(*(kept.get(c, F.col(f"__row.`{c}`")).alias(c) for c in df.columns))


def duplicates_only(df: DataFrame, fields: list[str], rewrite_keys: bool = False) -> DataFrame:
    """All rows of keys that occur more than once.

    Counts are summed before the shuffle and joined back, so that a key with a
    third of all rows is split by the join and never gathered.
    """
    names = [f"__k{i}" for i in range(len(fields))]
    keyed = df.select("*", *(dedupe_key(f).alias(n) for f, n in zip(fields, names, strict=True)))
    many = keyed.groupBy(*names).agg(F.count("*").alias("__n")).where("__n > 1").select(*names)
    kept = dict(zip(fields, map(F.col, names), strict=True)) if rewrite_keys else {}
    return keyed.join(many, names, "left_semi").select(*(kept.get(c, col(c)).alias(c) for c in df.columns))


def dedupe(df: DataFrame, fields: list[str], mode: str = "dedupe", order_by: list[str] | None = None, rewrite_keys: bool = False) -> DataFrame:
    """By mode: ``dedupe`` keeps the first row of each key, ``keep_duplicates_only`` all rows of keys that occur again, ``cancel`` leaves the table."""
    if mode == "cancel":
        return df
    if mode == "keep_duplicates_only":
        return duplicates_only(df, fields, rewrite_keys)
    if mode != "dedupe":
        raise ValueError(f"no dedupe mode {mode!r}")
    return dedupe_first(df, fields, order_by or df.columns, rewrite_keys)


def dedupe_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    each = df.groupBy(*(dedupe_key(f).alias(f"__k{i}") for i, f in enumerate(fields))).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("rows_removed"))


def normalize_rows(df: DataFrame, upper: bool = False) -> DataFrame:
    """Trim all text cells, and upper-case them if asked."""
    return df.select(*((F.upper(strip(c)) if upper else strip(c)).alias(c) if t == "string" else col(c) for c, t in df.dtypes))


def numbered(df: DataFrame, order_by: list[Column], name: str = "pos") -> DataFrame:
    """A dense number in a total order.

    Rows are range-partitioned and sorted; each part's count gives the next
    part's offset, so no task sees all rows.  Parts are few, and only their
    counts reach the driver.  The table is written, once, while the frame is
    being made.
    """
    flat = df.select("*", *(c.alias(f"__o{i}") for i, c in enumerate(order_by)))
    names = [f"__o{i}" for i in range(len(order_by))]
    parts = flat.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("__p", F.spark_partition_id())
    parts = written(parts.withColumn("__m", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("first")).collect()
    offset, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["__p"]):
        rows.append((r["__p"], offset - r["first"]))
        offset += r["n"]
    table = df.sparkSession.createDataFrame(rows or [(-1, 0)], "__p int, __shift long")
    return parts.join(F.broadcast(table), "__p").select(*map(col, df.columns), (F.col("__m") + F.col("__shift") + 1).alias(name))


def numbered_within(df: DataFrame, keys: list[str], order_by: list[Column], name: str = "pos") -> DataFrame:
    """A dense number within each key, in a total order.

    All rows are numbered by key and order, and each key's least number is
    taken off, so a key that holds a third of the rows lies in a third of the
    parts and no task sees it whole.  Null keys are one key.
    """
    all_ = numbered(df, [*map(col, keys), *order_by], "__pos")
    first = all_.groupBy(*(col(k).alias(f"__f{i}") for i, k in enumerate(keys))).agg(F.min("__pos").alias("__first"))
    same = reduce(lambda a, b: a & b, (col(k).eqNullSafe(F.col(f"__f{i}")) for i, k in enumerate(keys)))
    return all_.join(first, same).select(*map(col, df.columns), (F.col("__pos") - F.col("__first") + 1).alias(name))
