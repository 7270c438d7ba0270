"""Control reports: fixed-layout text of what a run read, kept and warned of."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@contextmanager
def run_log(path: str, name: str = "tabkit") -> Iterator[logging.Logger]:
    """A logger whose file is written anew for each run."""
    log, file = logging.getLogger(name), logging.FileHandler(path, mode="w", encoding="utf-8")
    file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(file)
    log.setLevel(logging.INFO)
    try:
        yield log
    finally:
        log.removeHandler(file)
        file.close()


def control_report(title: str, paths: dict[str, str], totals: dict[str, int], fields: list[str] | None = None, warnings: list[str] | None = None) -> str:
    width = max([len(k) for k in (*paths, *totals)], default=0) + 2
    lines = [title, "=" * len(title), ""]
    lines += [f"{k + ':':<{width}}{v}" for k, v in paths.items()]
    if fields:
        lines += ["", "fields: " + ", ".join(fields)]
    lines += [""] + [f"{k + ':':<{width}}{v:>15,}" for k, v in totals.items()]
    if warnings:
        lines += ["", "warnings:"] + [f"- {w}" for w in warnings]
    return "\n".join(lines) + "\n"


class Totals:
    """Totals that are counted while rows pass on their way to a write, so that none is a scan of its own.

    They are there once the write has ended.  Rows are counted where they
    pass: below a sort, which reads its input twice, they would count twice
    (cut the plan before it, as ``JobSpec.write`` does), and in a stage that
    shuffles and runs again after a lost executor they may.  Filters do not
    move below a count, so count what a scan gives only if that is asked for.
    """

    def __init__(self):
        self._seen: list[tuple[list[str], Observation]] = []

    def watch(self, df: DataFrame, **measures: Column) -> DataFrame:
        """The same rows; each measure is an aggregate under its name, blanks for underscores."""
        seen = Observation()
        self._seen.append((list(measures), seen))
        return df.observe(seen, *(m.alias(n) for n, m in measures.items()))

    def rows(self, df: DataFrame, name: str) -> DataFrame:
        return self.watch(df, **{name: F.count(F.lit(1))})

    def get(self) -> dict[str, int]:
        """All totals in the order in which they were asked for; of a part that the planner found empty, 0."""
        out: dict[str, int] = {}
        for names, seen in self._seen:
            try:
                got = seen.get
            except PySparkException:
                got = {}
            except Exception as e:  # a row without a schema: the part was planned away
                if "AssertionError" not in str(e):
                    raise
                got = {}
            out |= {n: got.get(n) or 0 for n in names}
        return out


def balanced(totals: dict[str, int], whole: str, parts: list[str]) -> bool:
    """Whether parts add up to the whole."""
    return totals[whole] == sum(totals[p] for p in parts)
