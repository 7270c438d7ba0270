"""Compare two tables row by row in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks, col, mismatch_mask, ruler
from .ordering import numbered

MOST_SHOWN = 50


def paired(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column], omit: list[str] | None = None) -> DataFrame:
    """pos, in_1, in_2, differs: rows joined by number; columns beyond the shorter row and omitted ones do not count."""
    width = min(len(a.columns), len(b.columns))
    keep = [i for i in range(width) if a.columns[i] not in (omit or [])]
    pick = lambda df, order, at: numbered(df, order, "__pos").select(col("__pos").alias("pos"), F.array(*(F.coalesce(col(df.columns[i]).cast("string"), F.lit("")) for i in keep)).alias(at))
    both = pick(a, order_a, "cells_1").join(pick(b, order_b, "cells_2"), "pos", "full")
    return both.select("pos", "cells_1", "cells_2", F.col("cells_1").isNotNull().alias("in_1"), F.col("cells_2").isNotNull().alias("in_2"), (F.col("cells_1") != F.col("cells_2")).alias("differs"))


def compare_counts(pairs: DataFrame) -> DataFrame:
    both = F.col("in_1") & F.col("in_2")
    return pairs.agg(
        F.count_if(both & ~F.col("differs")).alias("matched"),
        F.count_if(both & F.col("differs")).alias("differed"),
        F.count_if(F.col("in_1") & ~F.col("in_2")).alias("only_in_1"),
        F.count_if(~F.col("in_1") & F.col("in_2")).alias("only_in_2"),
    )


def mismatches(pairs: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    return pairs.where("in_1 and in_2 and differs").orderBy("pos").limit(most)


def compare_report(pairs: DataFrame, most: int = MOST_SHOWN, delimiter: str = ",") -> str:
    """Counts, and the first mismatches under a ruler with ~ where they differ."""
    n = compare_counts(pairs).first()
    lines = [f"matched: {n.matched}", f"differed: {n.differed}", f"only in 1: {n.only_in_1}", f"only in 2: {n.only_in_2}"]
    if not n.differed + n.only_in_1 + n.only_in_2:
        return "\n".join([*lines, "all records matched"])
    for r in mismatches(pairs, most).collect():
        x, y = delimiter.join(r.cells_1), delimiter.join(r.cells_2)
        lines.append(f"record {r.pos}")
        for p, q in zip(chunks(x.ljust(len(y))), chunks(y.ljust(len(x))), strict=True):
            lines += ["  " + ruler(), "1 " + p, "2 " + q, "  " + mismatch_mask(p, q)]
    return "\n".join(lines)
